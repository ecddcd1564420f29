"""Token-ID output: canonical length-limited Huffman files with checkpointed blocks.

File format. A *token file set* is a folder of Parquet containers, so that writes commit atomically on any file system
Spark knows. `codebook` holds one row: the code length of every id (0: unused) and the longest length. `blocks` holds
rows in ascending doc_id order; a block is decodable alone and holds whole documents:

    part, block  place in the global order        start     ids before the block within its part
    doc_ids      int64 little-endian, one each     has_id    one byte each, 0 where doc_id is null
    n_tokens     int64 little-endian, one each     steps     uint16: bits of each run of STEP ids
    payload      bits, most significant first; each document begins on a byte

`steps` are the checkpoints: their running sums give the bit where each run of STEP ids begins, so all runs of a block
decode side by side, one table look-up per id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

#: Ids between two checkpoints; ids in a block (more only where one document has more).
STEP, BLOCK_IDS = 64, 1 << 19
END_ID = 2


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits by package-merge; 0 for ids that never occur.

    No id used: all 0. One id used: length 1. More than 2**longest ids raise ValueError.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids do not fit codes of {longest} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n, levels = len(order), []
    row, is_leaf = weight, np.ones(n, bool)
    levels.append(is_leaf)
    for _ in range(longest - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        by = np.argsort(both, kind="stable")
        row, is_leaf = both[by], by < n
        levels.append(is_leaf)
    # take the cheapest 2n - 2 items of the last row; a package stands for twice as many items of the row below
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = lengths[order].astype(np.int64)
    longest = int(n[-1]) if len(n) else 0
    space = np.cumsum(np.int64(1) << (longest - n)) - (np.int64(1) << (longest - n)) if len(n) else n
    codes[order] = (space >> (longest - n)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, code length) by the next `longest` bits."""
    longest = int(lengths.max(initial=0))
    codes = canonical(lengths)
    order = np.flatnonzero(lengths)
    order = order[np.argsort(codes[order] << (longest - lengths[order]).astype(np.uint64), kind="stable")]
    span = np.int64(1) << (longest - lengths[order].astype(np.int64))
    symbol, size = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.uint8)
    symbol[: span.sum()], size[: span.sum()] = np.repeat(order, span), np.repeat(lengths[order], span)
    return symbol, size, longest


def pack_bits(ids: np.ndarray, ends: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(payload bytes, steps) of documents whose ids end at ends[1:]; each begins on a byte."""
    per_doc = np.diff(ends)
    runs = -(-per_doc // STEP)
    if not len(ids):
        return np.zeros(0, np.uint8), np.zeros(0, np.uint16)
    n = lengths[ids].astype(np.int64)
    total = np.concatenate([[0], np.cumsum(n)])
    doc_bits = total[ends[1:]] - total[ends[:-1]]
    doc_bytes = (doc_bits + 7) >> 3
    doc_at = np.concatenate([[0], np.cumsum(doc_bytes)])
    at = total[:-1] + np.repeat(doc_at[:-1] * 8 - total[ends[:-1]], per_doc)
    word, shift = at >> 6, 64 - (at & 63) - n
    code = codes[ids]
    out = np.zeros(int(doc_at[-1] >> 3) + 2, np.uint64)
    fits = shift >= 0
    high = np.where(fits, code << np.where(fits, shift, 0).astype(np.uint64), code >> np.where(fits, 0, -shift).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(high, first)
    over = np.flatnonzero(~fits)
    out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    # checkpoints
    begin = np.repeat(ends[:-1], runs) + STEP * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    stop = np.minimum(begin + STEP, np.repeat(ends[1:], runs))
    return out.byteswap().view(np.uint8)[: doc_at[-1]], (total[stop] - total[begin]).astype(np.uint16)


def unpack_bits(payload: np.ndarray, steps: np.ndarray, per_doc: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All ids of a block: every run between checkpoints is decoded side by side."""
    symbol, size, longest = table
    n = int(per_doc.sum())
    if not n:
        return np.zeros(0, np.uint32)
    runs = -(-per_doc // STEP)
    steps = steps.astype(np.int64)
    total = np.concatenate([[0], np.cumsum(steps)])
    last = np.cumsum(runs)
    first = last - runs
    doc_bytes = (total[last] - total[first] + 7) >> 3
    doc_at = np.concatenate([[0], np.cumsum(doc_bytes)])[:-1]
    at = total[:-1] + np.repeat(doc_at * 8 - total[first], runs)
    rank = np.arange(runs.sum()) - np.repeat(first, runs)
    left = np.minimum(STEP, np.repeat(per_doc, runs) - rank * STEP)
    where = np.repeat(np.cumsum(per_doc) - per_doc, runs) + rank * STEP
    padded = np.concatenate([payload, np.zeros(8, np.uint8)])
    window = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
    out, down = np.zeros(n, np.uint32), np.uint64(64 - longest)
    order = np.argsort(-left, kind="stable")
    at, left, where = at[order], left[order], where[order]
    alive = len(at) - np.searchsorted(left[::-1], np.arange(1, STEP + 1), "left")  # runs with more than t ids
    for t in range(STEP):
        k = int(alive[t])
        if not k:
            break
        bits = window[at[:k] >> 3].astype(np.uint64) << (at[:k] & 7).astype(np.uint64)
        key = bits >> down
        out[where[:k] + t] = symbol[key]
        at[:k] += size[key]
    return out


def longest_code(n_ids: int) -> int:
    """Four bits more than equal-length codes would need lose next to nothing and keep the table small."""
    return min(24, max(8, int(max(n_ids, 2) - 1).bit_length() + 4))


def token_table(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids): each text's ids by the library, plus the end id, as zstd-packed uint32.

    Null text: empty. Columns other than doc_id and text are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, press = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for batch in common.slices(whole, 1, 8 << 20):
                ids, ends = tokens.encode(batch.column(1))
                if end_id is not None:
                    ids, ends = np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
                narrow = ids.astype("<u2") if len(ids) and ids.max() < 1 << 16 else ids.astype("<u4")
                wide = narrow.dtype.itemsize == 4
                packed = [bytes([wide]) + press.compress(narrow[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.record_batch([batch.column(0), pa.array(np.diff(ends)), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def unpack_ids(packed: bytes, press: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(press.decompress(packed[1:]), "<u4" if packed[0] else "<u2")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs; summed within a task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, press = np.zeros(1 << 16, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            parts, size = [], 0
            for packed in batch.column(0):
                parts.append(unpack_ids(packed.as_py(), press))
                size += len(parts[-1])
                if size > 1 << 20:
                    total, parts, size = _added(total, parts), [], 0
            total = _added(total, parts)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _added(total: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    if not parts:
        return total
    more = np.bincount(np.concatenate(parts))
    if len(more) > len(total):
        total = np.concatenate([total, np.zeros(len(more) - len(total), np.int64)])
    total[: len(more)] += more
    return total


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID) -> None:
    """Writes every text's ids to a token file set at `path`, in ascending doc_id order (null ids first).

    Rows with one doc_id stay next to each other in the order of a digest of their ids; a very frequent doc_id is
    spread over parts that follow each other. Null text: only the end id. An empty table gives an empty file set.
    The codebook is collected to the driver: at most one row per id of the vocabulary.
    """
    spark = docs.sparkSession
    tokens, at = common.kept(token_table(docs, tokenizer, end_id), "ids", "none")
    rows = id_counts(tokens).collect()
    counts = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    counts[[r["id"] for r in rows]] = [r["n"] for r in rows]
    longest = longest_code(len(rows))
    lengths = code_lengths(counts, longest)
    spark.createDataFrame([(bytearray(lengths.tobytes()), int(lengths.max(initial=0)))], "lengths binary, longest int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((canonical(lengths), lengths))  # as large as the vocabulary

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, sizes = shared.value
        press, part, number, start = zstandard.ZstdDecompressor(), TaskContext.get().partitionId(), 0, 0
        ids, docs_, n = [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, start, ids, docs_, n
            per_doc = np.fromiter(map(len, ids), np.int64, len(ids))
            payload, steps = pack_bits(np.concatenate(ids), np.concatenate([[0], np.cumsum(per_doc)]), codes, sizes)
            has = np.fromiter((d is not None for d in docs_), np.uint8, len(docs_))
            doc_ids = np.fromiter((d or 0 for d in docs_), "<i8", len(docs_))
            values = [part, number, start, doc_ids.tobytes(), has.tobytes(), per_doc.astype("<i8").tobytes(), steps.astype("<u2").tobytes(), payload.tobytes()]
            number, start, ids, docs_, n = number + 1, start + n, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["part", "block", "start", "doc_ids", "has_id", "n_tokens", "steps", "payload"])

        for batch in batches:
            for doc, packed in zip(batch.column(0), batch.column(1)):
                one = unpack_ids(packed.as_py(), press)
                if ids and n + len(one) > BLOCK_IDS:
                    yield block()
                ids.append(one)
                docs_.append(doc.as_py())
                n += len(one)
        if ids:
            yield block()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    ordered = tokens.repartitionByRange(common.shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "ids").mapInArrow(blocks, "part long, block long, start long, doc_ids binary, has_id binary, n_tokens binary, steps binary, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    common.remove(spark, at)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Per document of a token file set: doc_id, start, n_tokens and its ids (or with `digest`, their ids_crc32).

    `start` counts the ids of all documents before it in the global order: the totals of the parts (one row per
    written partition) are added up on the driver, the rest is in the blocks.
    """
    row = spark.read.parquet(f"{path}/codebook").collect()[0]
    shared = spark.sparkContext.broadcast(np.frombuffer(bytes(row["lengths"]), np.uint8))
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = sorted((r["part"], r["n"]) for r in blocks.select("part", "n_tokens").mapInArrow(_block_totals, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, offset = {}, 0
    for part, n in totals:
        before[part], offset = offset, offset + n
    kind = "ids_crc32 long" if digest else "ids array<long>"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = decode_table(shared.value)
        for batch in batches:
            for part, start, doc_ids, has, per_doc, steps, payload in zip(*batch.columns):
                n = np.frombuffer(per_doc.as_py(), "<i8")
                ids = unpack_bits(np.frombuffer(payload.as_py(), np.uint8), np.frombuffer(steps.as_py(), "<u2"), n, tables)
                ends = np.concatenate([[0], np.cumsum(n)])
                doc = pa.array(np.frombuffer(doc_ids.as_py(), "<i8"), mask=np.frombuffer(has.as_py(), np.uint8) == 0)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64()) if digest else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.record_batch([doc, pa.array(before[part.as_py()] + start.as_py() + ends[:-1]), pa.array(n), last], ["doc_id", "start", "n_tokens", kind.split()[0]])

    return blocks.select("part", "start", "doc_ids", "has_id", "n_tokens", "steps", "payload").mapInArrow(decode, f"doc_id long, start long, n_tokens long, {kind}")


def _block_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([int(np.frombuffer(x.as_py(), "<i8").sum()) for x in batch.column(1)], pa.int64())], ["part", "n"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, written as a token file set and read back."""
    path = common.scratch(spark, "token-files")
    write_ids(common.table(spark, sf_dir, "documents"), path, common.tokenizer_path(common.WORD_TOKENIZER))
    return read_ids(spark, path, digest=True)
