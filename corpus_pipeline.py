"""Corpus pipeline: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents.  ``run`` stages each result in the shared folder.

Rows with nulls, empty or repeated texts pass through the stages as their operators define; an
empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import common, language_id, ngram_join, packing, quality, substring_dedup

#: The best language's pooled probability must be above chance (1 / n for n languages) by this share of
#: what is left above chance, else a document is no language's prose.
LEAST_ABOVE_CHANCE = 1 / 15
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _wrapped(docs: DataFrame) -> DataFrame:
    """The rows in one struct beside their text: no column of docs can clash with a stage's own."""
    return docs.select(F.struct(*docs.columns).alias("r"), F.col("text").alias("text"))


def least_score(n: int) -> float:
    chance = 1 / max(1, n)
    return chance + LEAST_ABOVE_CHANCE * (1 - chance) - 1e-6


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no learned language, go."""
    model, languages = language_id.fit(docs)
    found = language_id.identify(_wrapped(docs), model, languages)
    return found.filter((F.col("_lang_pred") != "und") & (F.col("_score") >= least_score(len(languages)))).select("r.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go.

    Not a filter: it would be pushed below the measures and compute them again for each use."""
    judged = quality.quality(_wrapped(docs))
    return judged.select(F.explode(F.when(F.col("_kept"), F.array("r"))).alias("r")).select("r.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles of five words at 0.8 one row stays: one of the least doc_id.
    Rows without a doc_id or a word stay.  Only keys of rows are grouped, the texts are dealt out once."""
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    groups = common.staged(ngram_join.ngram_join(docs, k=NEAR_WORDS, percent=NEAR_PERCENT, key=key).filter("group_id IS NOT NULL").select("group_id", "doc_id", "row_key"), "groups")
    first = groups.groupBy("group_id").agg(F.min(F.struct("doc_id", "row_key")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    kept_key = common.staged(first.select("group_id", F.col("first.row_key").alias("kept_key")), "kept")
    gone = groups.join(kept_key.hint("merge"), "group_id").filter("row_key <> kept_key").select("row_key").distinct()
    stay = docs.select(key.alias("_key"), F.struct(*docs.columns).alias("r")).join(gone, F.col("_key") == F.col("row_key"), "left_anti")
    # rows that repeat both doc_id and text share a key: one of them stays
    twice = groups.groupBy("row_key").agg(F.count("*").alias("n")).filter("n > 1").select("row_key")
    if twice.limit(1).count():
        same = F.col("_key") == F.col("row_key")
        stay = stay.join(twice, same, "left_anti").unionByName(stay.join(twice, same, "left_semi").dropDuplicates(["_key"]))
    return stay.select("r.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that start earlier too go; other texts stay as they are."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = substring_dedup.substring_dedup(docs, carry=others, as_is=True)
    fresh = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in others:
        fresh["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[(fresh[c] if c in fresh else F.col("carried").getField(c)).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: Language ID and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        was, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.staged(docs, f"stage{i + 1}")
            common.discard(was)
    return docs
