"""Operator 9, quality rules: a threshold table compiled into one projection of SQL expressions.

Every measure is a built-in expression over the row's text; no user function, no shuffle.  A rule
is (name, measure, comparison, threshold, per): the document passes if
``per_scale * measure <comparison> threshold * per``, in whole numbers, so no rounding decides.

Repeated three-word windows are found inside the row: windows are hashed (64 bits), sorted with
their positions, and equal neighbours mark both positions; the marked windows' words are counted
once each.

Cases: a null or empty text has no words, all counts 0, base_failed true, kept false.  Repeated rows
give one row each; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: Very common words of the four languages at hand; a text of prose has some of them.
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by at this have from or an are not "
    "der die das und ist ein eine zu den von mit im auf nicht es sich "
    "le la les de des et un une du en que est pour dans qui sur "
    "el los las y por con para una se no su al lo"
).split()

#: (rule, numerator, comparison, percent, denominator): 100 * numerator <comparison> percent * denominator.
#: Thresholds sit well away from prose, so that clean documents stay: they catch symbol
#: debris, lists and tables cut from pages, lines repeated over and over, and word salad.
RULES = (
    ("mean word length at least 2", "word_chars", ">=", 200, "n_words"),
    ("mean word length at most 15", "word_chars", "<=", 1500, "n_words"),
    ("symbols at most 10 % of words", "n_symbols", "<=", 10, "n_words"),
    ("stop words at least 3 % of words", "n_stop_words", ">=", 3, "n_words"),
    ("repeated lines at most half of the lines", "n_dup_lines", "<=", 50, "n_lines"),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


def _long(c: Column) -> Column:
    return c.cast("long")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column _q of MEASURES (long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaced = F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))
    d = docs.withColumn("_t", text).withColumn("_w", F.filter(F.split(spaced, " "), lambda w: w != ""))
    # one 64-bit hash a window, next to its position: equal windows become neighbours
    window = "transform(sequence(0, size(_w) - 3), i -> struct(xxhash64(_w[i], _w[i + 1], _w[i + 2]) AS h, i AS p))"
    d = d.withColumn("_g", F.expr(f"CASE WHEN size(_w) >= 4 THEN sort_array({window}) ELSE array() END"))
    marked = "filter(transform(_g, (x, i) -> CASE WHEN x.h = get(_g, i - 1).h OR x.h = get(_g, i + 1).h THEN x.p END), p -> p IS NOT NULL)"
    d = d.withColumn("_p", F.expr(f"sort_array({marked})"))
    covered = "aggregate(_p, struct(CAST(0 AS BIGINT) AS n, -3 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n)"
    d = d.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    q = F.struct(
        _long(F.size("_w")).alias("n_words"),
        _long(F.length(F.translate("_t", SPACES, ""))).alias("word_chars"),
        _long(F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).alias("n_symbols"),
        _long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        _long(F.expr(covered)).alias("n_repeat_words"),
        _long(F.size(F.filter("_w", lambda w: F.lower(w).isin(list(dict.fromkeys(STOP_WORDS)))))).alias("n_stop_words"),
        _long(F.size("_l")).alias("n_lines"),
    )
    return d.withColumn("_q", q).drop("_t", "_w", "_g", "_p", "_l")


def base_failed(q: str = "_q") -> Column:
    return (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def compiled(rules=RULES, q: str = "_q") -> Column:
    """The table of rules as one boolean expression."""
    verdict = F.lit(True)
    for _, top, comparison, percent, bottom in rules:
        left, right = 100 * F.col(f"{q}.{top}"), percent * F.col(f"{q}.{bottom}")
        verdict = verdict & ((left >= right) if comparison == ">=" else (left <= right))
    return verdict


def quality(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """docs with _q (measures), _base_failed and _kept; columns of those names are replaced."""
    d = measures(docs, text_col)
    return d.withColumn("_base_failed", base_failed()).withColumn("_kept", ~F.col("_base_failed") & compiled(rules))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality(common.documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", *[F.col(f"_q.{m}").alias(m) for m in MEASURES], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def _rules_sql() -> str:
    return " AND ".join(f"100 * {top} {comparison} {percent} * {bottom}" for _, top, comparison, percent, bottom in RULES)


OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
                  row_number() OVER () AS r FROM documents),
g AS (SELECT r, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM d),
k AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM g),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM k) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(list_filter(w, lambda x: list_contains({[*dict.fromkeys(STOP_WORDS)]!r}, lower(x)))) AS BIGINT) AS n_stop_words,
             CAST(len(l) AS BIGINT) AS n_lines
      FROM d LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {_rules_sql()} AS kept FROM b
"""
