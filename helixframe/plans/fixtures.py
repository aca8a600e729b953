"""Alignment, taxonomy and sequence rows derived from the test tables by SQL that both engines run.

The texts hold no lambda and no engine's own function; tables appear as {name}.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# one record a line item; ord is its place within the read name, total over equal rows too
ALN = """
SELECT qname, ord, flag, rname, pos, mapq, cigar, tags, seq, qual, k
FROM (
  SELECT qname, ord, k, rname,
    CAST(1 + CASE WHEN k % 5 <> 0 AND k % 11 <> 0 THEN 2 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 4 ELSE 0 END
         + CASE WHEN k % 17 = 0 THEN 8 ELSE 0 END + CASE WHEN q % 2 = 1 THEN 16 ELSE 0 END + CASE WHEN s % 2 = 1 THEN 32 ELSE 0 END
         + CASE WHEN ord % 2 = 1 OR k % 13 = 0 THEN 64 ELSE 128 END + CASE WHEN k % 19 = 0 THEN 256 ELSE 0 END
         + CASE WHEN k % 23 = 0 THEN 2048 ELSE 0 END AS INT) AS flag,
    CASE WHEN k % 11 = 0 THEN CAST(0 AS BIGINT) ELSE 1 + (k * 7 + q * 13) % 900 END AS pos,
    (k * 3 + q) % 61 AS mapq,
    CASE WHEN k % 11 = 0 THEN '*'
         WHEN k % 6 = 0 THEN CAST(q + 20 AS STRING) || 'M'
         WHEN k % 6 = 1 THEN '5S' || CAST(q + 10 AS STRING) || 'M2I' || CAST(q AS STRING) || 'M'
         WHEN k % 6 = 2 THEN CAST(q AS STRING) || '=1X' || CAST(q + 5 AS STRING) || '='
         WHEN k % 6 = 3 THEN CAST(q + 15 AS STRING) || 'M3D12M'
         WHEN k % 6 = 4 THEN CAST(q AS STRING) || 'M20N' || CAST(q AS STRING) || 'M4H'
         ELSE '3S' || CAST(q + 30 AS STRING) || '=2X' END AS cigar,
    concat_ws(' ', CASE WHEN k % 7 = 0 THEN NULL ELSE 'NM:i:' || CAST(q % 9 AS STRING) END,
              CASE WHEN k % 8 = 0 THEN NULL ELSE 'AS:i:' || CAST(q * 2 - 5 AS STRING) END, 'XZ:Z:v' || CAST(s AS STRING)) AS tags,
    substring(repeat('ACGTTGCANGATTACA', 8), CAST(1 + k % 10 AS INT), CAST(q + 10 AS INT)) AS seq,
    substring(repeat('IHGFEDCBA@', 12), CAST(1 + k % 10 AS INT), CAST(q + 10 AS INT)) AS qual
  FROM (
    SELECT 'r' || CAST(l_orderkey AS STRING) AS qname, l_partkey AS k, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q,
      'ref' || CAST(l_suppkey AS STRING) AS rname,
      CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS BIGINT) AS ord
    FROM {lineitem}) AS a) AS b
"""

REFS = "SELECT 'ref' || CAST(s_suppkey AS STRING) AS ref_name, 600 + (s_suppkey * 37) % 400 AS ref_length FROM {supplier} WHERE s_suppkey % 9 <> 0"

# nodes of a lineage for each supplier: all ranks and one that is no column, some without a name; some
# organisms repeat a rank, have no name, or come in a second entry
LINEAGE = """
SELECT 'ref' || CAST(s_suppkey AS STRING) AS accession, s_suppkey + 5000 AS tax_id, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS name,
  s_suppkey % (10 + n) + 100 * n AS node_id, CASE WHEN (s_suppkey + n) % 11 = 0 THEN NULL ELSE r || ' ' || CAST(s_suppkey % (10 + n) AS STRING) END AS node_name,
  r AS rank, CAST(n AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS entry
  FROM {supplier} CROSS JOIN (VALUES ('realm', 1), ('domain', 2), ('kingdom', 3), ('phylum', 4), ('subphylum', 5), ('class', 6), ('subclass', 7), ('order', 8),
    ('suborder', 9), ('family', 10), ('subfamily', 11), ('genus', 12), ('subgenus', 13), ('species', 14), ('subspecies', 15), ('no rank', 16)) AS v(r, n)
  WHERE (s_suppkey + n) % 5 <> 0
UNION ALL
SELECT 'ref' || CAST(s_suppkey AS STRING), s_suppkey + 5000, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END, s_suppkey + 2000, s_name || ' again',
  CASE WHEN s_suppkey % 2 = 0 THEN 'species' ELSE 'no rank' END, CAST(40 AS BIGINT), CAST(0 AS BIGINT) FROM {supplier} WHERE s_suppkey % 3 = 0
UNION ALL
SELECT 'ref' || CAST(s_suppkey AS STRING), s_suppkey + 6000, s_name || ' new', s_suppkey + 3000, '  ' || s_name || ' genus ', 'genus', CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM {supplier} WHERE s_suppkey % 8 = 0
"""

# whole texts as DNA: letters are mapped onto bases, everything else is dropped
SEQS = """
SELECT doc_id, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'BDEFHIJKLMOPQRSUVWXYZN', 'CAGTACGTACGTACGTACGTAN') AS seq
FROM {documents}
"""

# benchmark texts as DNA, of which the k-mers are a reference set
BENCH = SEQS.replace("{documents}", "{benchmark}").replace("doc_id", "item_id AS doc_id")

SCORES = "SELECT d.doc_id, CAST(n_chars % 61 AS DOUBLE) AS score, quality, toxic FROM {documents} AS d JOIN {labels} AS l ON d.doc_id = l.doc_id"

TASKS = """
SELECT p_brand AS id, CAST(count(*) AS DOUBLE) / 8 AS abundance, CAST(sum(p_size) AS BIGINT) AS genome_length
FROM {part} GROUP BY p_brand
"""

MANIFEST = """
SELECT p_brand AS id, CASE WHEN min(p_size) % 3 = 0 THEN 'Negative' ELSE p_brand END AS keyword, CAST(sum(p_size) AS BIGINT) AS calculated_reads FROM {part} GROUP BY p_brand
"""

TEXTS = {"manifest": MANIFEST, "aln": ALN, "refs": REFS, "lineage": LINEAGE, "seqs": SEQS, "bench": BENCH, "scores": SCORES, "tasks": TASKS}
TABLES = ("region", "nation", "supplier", "lineitem", "documents", "benchmark", "labels", "part")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = TEXTS[name]
    if name in ("seqs", "bench"):
        text = text.replace(", '', 'g')", ", '')")  # all matches are replaced without a flag
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{%s}" % t in text}
    return spark.sql(text, **used)


def with_sql(*names: str) -> str:
    """WITH clause that defines the fixtures for the other engine."""
    parts = [f"{n} AS ({TEXTS[n].format(**{t: t for t in TABLES})})" for n in names]
    return "WITH " + ",\n".join(parts)
