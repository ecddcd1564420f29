"""Set helpers on binary keys: connected components without collecting them, and a fixed-size key filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of the key filter, so its size is bounded (4 MB) whatever the data; a full filter only stops saving work.
FILTER_BITS = 1 << 25


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of undirected edges (u, v), root being the component's smallest node.

    Alternating large and small stars (Kiveris et al. 2014): minima are aggregated before the shuffle and joined back,
    so that a node with very many neighbours is split by the engine like any other skewed join. Every round is written
    to the shared folder. Loops are ignored, repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    now, old = common.kept(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # done when every node points at one root and no root points on
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("tail"), F.lit(0).alias("head")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("tail").alias("tail"), F.max("head").alias("head")).filter("tail + head > 1").isEmpty():
            return now.select("u", F.col("v").alias("root")).union(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now, path = common.kept(small, "edges")
        common.remove(spark, old)
        old = path


def key_filter(keys: DataFrame, column: str, bits: list[Column] | None = None) -> np.ndarray:
    """A Bloom filter of keys as 64-bit words, two bits a key, put together by bit_or. Each task packs its words into one
    value; together they are at most FILTER_BITS bits and their places."""
    bits = bits or [F.pmod(F.xxhash64(column, F.lit(s)), F.lit(FILTER_BITS)) for s in (1, 2)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([np.asarray(c, np.int64).tobytes()], pa.binary()) for c in batch.columns], ["words", "bits"])

    rows = keys.select(F.explode(F.array(*bits)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for row in rows.mapInArrow(pack, "words binary, bits binary").collect():
        words[np.frombuffer(row.words, np.int64)] = np.frombuffer(row.bits, np.int64)
    return words.view(np.uint64)


def filter_bits(column: str) -> list:
    return [F.pmod(F.xxhash64(column, F.lit(s)), F.lit(FILTER_BITS)).alias(f"_bit{s}") for s in (1, 2)]


def may_hold(words: np.ndarray, *bits: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(words[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1 for b in bits])
