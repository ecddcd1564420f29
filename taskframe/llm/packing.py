"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces of power-of-two lengths: as many of `longest` as fit, then one piece for each
bit of the rest, large first. Pieces of one length share a bucket and are written to its folder, and every piece is a
sequence by itself, so no sequence crosses documents, none is padded, and a batch drawn from one bucket is rectangular.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .huffman import END_ID
from .tokens import encoder

LONGEST = 4096


def pieces(n: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents with so many ids. A document without ids has no piece."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    n = np.asarray(n, np.int64)
    whole = n // longest
    bits = longest.bit_length() - 1
    sizes = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
    rest = (n % longest)[:, None] & sizes[None, :]
    count = whole + (rest > 0).sum(1)
    doc = np.repeat(np.arange(len(n)), count)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    length = np.full(len(doc), longest, np.int64)
    small = rank >= whole[doc]
    length[small] = rest[rest > 0]
    ends = np.cumsum(length)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    return doc, ends - length - first[doc], length


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end_id: int | None = END_ID, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (0), bucket (= length), ids.

    One pass, no shuffle: a piece needs nothing but its own document. sequence_id is the task's number and the piece's
    place in it, unique and the same when a lost task runs again. Null text: empty, so only the end id; without end id
    an empty text has no piece. Null or repeated doc_ids are kept as they are. Other columns are ignored.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket long" + ", ids array<int>" * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, sequence = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in common.slices(whole, 1, 2 << 20):
                flat, ends = tokens.encode(batch.column(1))
                if end_id is not None:
                    flat, ends = np.insert(flat, ends[1:], end_id), ends + np.arange(len(ends))
                n = np.diff(ends)
                doc, start, length = pieces(n, longest)
                at = ends[doc] + start
                raw = memoryview(flat.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                columns = [batch.column(0).take(pa.array(doc)), start, length, pa.array(crc, pa.int64()), n[doc], sequence + np.arange(len(doc)), np.zeros(len(doc), np.int64), length]
                sequence += len(doc)
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)) if len(at) else [0], pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.tidied(cut), schema)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes pieces so that those of one length stand together: a folder `bucket=<length>` for each."""
    packed.write.partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """The written pieces, or those of one bucket, of which every batch is rectangular; other folders are not read."""
    rows = spark.read.parquet(path).withColumn("bucket", F.col("bucket").cast("long"))
    return rows if length is None else rows.filter(F.col("bucket") == length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces, read back from their buckets."""
    path = common.scratch(spark, "buckets")
    packed = pack(common.table(spark, sf_dir, "documents"), common.tokenizer_path(common.WORD_TOKENIZER), ids=False)
    write_buckets(packed, path)
    return read_buckets(spark, path).select(*packed.columns)
