"""Operator 3, token counts: a digest cache joined to content, encoding only distinct misses.

The cache is a Parquet table (version, digest, n_bytes, n_tokens) that only grows.  Content is
normalised (null becomes the empty text; nothing else, since counts are of the exact text) and
digested in the JVM; digests are joined to the stored counts of the tokenizer's version; one text
of each missing digest is encoded and appended.

Cases: a null text counts as empty (0 bytes, 0 tokens).  Repeated rows, also of one doc_id, give
one row each.  An empty table gives an empty result.  Only doc_id and text are read, so further
columns of any name do no harm.  A null doc_id is returned as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vocab

CACHE_SCHEMA = "version string, digest binary, n_bytes long, n_tokens long"
OVER_LIMIT = 4096


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; concurrent appends may repeat a digest."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("version") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _count(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = vocab.encoder(path)
        for rows, _, offsets in common.text_batches(batches):
            n = counter.counts(rows.column("text").to_pylist())
            sizes = offsets[1:] - offsets[:-1]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n)), rows.column("digest"), pa.array(sizes), pa.array(n, pa.int64())], ["version", "digest", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; counts new to the cache are appended to it.

    tokenizer_path must name a sentencepiece .model file; cache_path a folder in a shared store.
    """
    spark = docs.sparkSession
    version = vocab.tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    # copies fold together before the shuffle, so a text that a third of all rows share costs one
    # row of each map task
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache_path, version), "digest", "left_anti")
    misses.mapInArrow(_count(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").option("compression", "zstd").parquet(cache_path)
    # written, so that the join deals out both sides anew and can split a digest of many copies
    known = common.staged(read_cache(spark, cache_path, version), "known")
    sized = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(known.hint("merge"), "digest").select("doc_id", "n_bytes", "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under piece_bpe_32k.model, from a new cache."""
    cache = common.shared_dir(spark, "token-cache")
    counts = token_counts(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)
