"""Token counts through a digest cache.

The cache is a Parquet table of (version, digest, n_tokens); a file holds one version, so others are skipped by their
statistics. A text's digest is the SHA-256 of its normalised content:
null becomes empty, then UTF-8 bytes, nothing else, since any further change could change the count. The version is a
digest of the tokenizer file and of how it is applied. Texts are joined to the stored counts by both; only distinct
misses are encoded, and appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import common
from .tokens import encoder

CACHE = "version string, digest binary, n_tokens long"
LIMIT = 1024


def version_of(tokenizer: str) -> str:
    with open(tokenizer, "rb") as f:
        return hashlib.sha256(b"add_special_tokens=0;truncation=0;padding=0\n" + f.read()).hexdigest()


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The counts of one version; none where the cache has not been written yet. Doubles by lost races are dropped."""
    try:
        found = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], CACHE)
    return found.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). New counts are appended to `cache`.

    Copies travel once per task and batch: a task sends the first text of each digest it meets in a batch, so that a
    text which a third of all rows share does not pile up in one place. Null text: empty, 0 tokens. Rows with null or
    repeated doc_id are kept. An empty table appends nothing. Other columns are ignored.
    """
    spark, version = docs.sparkSession, version_of(tokenizer)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            first: dict[bytes, int] = {}
            for i, d in enumerate(batch.column(0)):
                first.setdefault(d.as_py(), i)
            for part in common.slices(batch.take(pa.array(list(first.values()), pa.int64())), 1, 4 << 20):
                yield pa.record_batch([part.column(0), pa.array([press.compress(x.as_py().encode()) for x in part.column(1)], pa.binary())], ["digest", "packed"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, press, seen = encoder(tokenizer), zstandard.ZstdDecompressor(), set()
        for batch in batches:
            digests, texts, size = [], [], 0

            def done() -> pa.RecordBatch:
                return pa.record_batch([pa.array(digests, pa.binary()), pa.array(tokens.counts(pa.array(texts, pa.string())))], ["digest", "n_tokens"])

            for d, packed in zip(batch.column(0), batch.column(1)):
                if (key := d.as_py()) in seen:
                    continue
                seen.add(key)
                digests.append(key)
                texts.append(press.decompress(packed.as_py()).decode())
                size += len(texts[-1])
                if size > 6 << 20:
                    yield done()
                    digests, texts, size = [], [], 0
            if digests:
                yield done()

    parts = common.shuffle_partitions(spark)
    sent = rows.select("digest", "text").mapInArrow(common.tidied(send), "digest binary, packed binary").repartition(parts, "digest")
    known = stored(spark, cache, version)
    if not known.isEmpty():
        sent = sent.hint("merge").join(known.select("digest").repartition(parts, "digest"), "digest", "left_anti")
    fresh = sent.mapInArrow(common.tidied(encode), "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    common.release(spark)
    counts = stored(spark, cache, version)
    return rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a cache of this call's own, which begins empty."""
    return count_tokens(common.table(spark, sf_dir, "documents"), common.tokenizer_path(common.BYTE_TOKENIZER), common.scratch(spark, "token-cache"))
