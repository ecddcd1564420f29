"""Exact removal of repeated byte strings by suffix arrays over shards of the text that can repeat.

Every 100-byte window has one anchor: the window's smallest hashed GRAM-byte string, leftmost of equals. Equal windows
have equal anchors at equal places, so a window whose anchor occurs once in the corpus occurs once itself. The windows
of one anchor occurrence are consecutive; with the bytes they span they are a *region*. Regions are dealt to shards by
anchor, so that all occurrences of a window meet in one shard. A shard builds one suffix array over its regions, each
string of bytes once with all its places (Larsson-Sadakane refinement: only groups that are still tied are sorted
again), takes the common prefixes of neighbours (Kasai), and in every run of suffixes that share 100 bytes marks all but
the earliest. Occurrences of a very frequent anchor are split over many shards, whose sorted windows are merged by binary
search afterwards. Every removed byte is found so, from bytes that were compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .graphs import FILTER_BITS, filter_bits, key_filter, may_hold

LENGTH, GRAM = 100, 40
#: Bytes of text hashed at once and of regions in one suffix array, both for the processor's cache; bytes of compressed
#: texts that regions are cut out of at once; occurrences from which on an anchor is split.
HASH_BYTES, SHARD_BYTES, BATCH_BYTES, SPLIT = 1 << 17, 1 << 16, 1 << 20, 4_096
_NONE = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


# --- suffix arrays ---------------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes of strings laid end to end; each ends in its own terminator, smaller than any byte, earlier
    strings' first. Larsson-Sadakane: ranks by the first h bytes give those by 2 h, sorting tied groups only."""
    n, m = len(text), len(ends) - 1
    if not n:
        return np.zeros(0, np.int64)
    stop = np.repeat(ends[1:], np.diff(ends))
    owner = np.repeat(np.arange(m), np.diff(ends))
    key, at = np.zeros(n, np.uint64), np.arange(n)
    for k in range(7):  # seven bytes to begin with, 0 beyond the end
        key <<= np.uint64(9)
        inside = at[: n - k] + k < stop[: n - k]
        key[: n - k] |= np.where(inside, text[k:].astype(np.uint64) + np.uint64(1), np.uint64(0))
    order = np.argsort(key)  # the order of ties is that of later rounds
    sorted_key = key[order]
    begins = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1], [True]])  # where groups of equal ranks begin
    rank = np.zeros(n, np.int64)  # the first place of the suffix's group
    rank[order] = np.flatnonzero(begins[:-1])[np.cumsum(begins[:-1]) - 1]
    h, where = 7, np.flatnonzero(~(begins[:-1] & begins[1:]))
    while True:
        if not len(where):
            return order
        members = order[where]
        ahead = members + h
        over = ahead >= stop[members]
        second = np.where(over, owner[members], m + rank[np.minimum(ahead, n - 1)])
        group = rank[members]
        by = np.lexsort((second, group)) if n + m >= 1 << 31 else np.argsort(group << 32 | second)
        members, group, second = members[by], group[by], second[by]
        order[where] = members
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        first = where[np.flatnonzero(fresh)]
        rank[members] = first[np.cumsum(fresh) - 1]
        begins[first] = True
        where = where[~(begins[where] & begins[where + 1])]
        h *= 2


def common_prefixes(text: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in `order` and the one before it (0 for the first).

    Kasai: going through the text, a suffix shares at least what the suffix one byte earlier shared, less one; and
    exactly that where both are preceded by the same byte. So bytes are compared at the other places only.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    stop = np.repeat(ends[1:], np.diff(ends))
    start = np.repeat(ends[:-1], np.diff(ends))
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    follows = (at > start) & (before >= 0)
    b = np.where(before >= 0, before, 0)
    follows &= (b > start[b]) & (text[at - 1] == text[b - 1])
    p = np.flatnonzero(~follows & (before >= 0))
    q = before[p]
    most = np.minimum(stop[p] - p, stop[q] - q)
    shared = np.zeros(len(p), np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray(n + 1, "<u8", padded, strides=(1,))
    live = np.arange(len(p))
    while len(live):
        x, y = words[np.minimum(p[live] + shared[live], n)], words[np.minimum(q[live] + shared[live], n)]
        differ = x ^ y
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.frexp(low.astype(np.float64))[1].clip(1) - 1 >> 3)
        shared[live] += same
        live = live[(same == 8) & (shared[live] < most[live])]
    shared = np.minimum(shared, most)
    total = np.full(n, 0)
    known = np.where(before < 0, at, 0)
    known[p] = shared + p
    fixed = ~follows
    source = np.maximum.accumulate(np.where(fixed, at, 0))
    total = known[source] - at
    return total[order]


def later_windows(text: np.ndarray, ends: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of windows that an earlier equal window makes superfluous, places of the first windows in sorted order).

    String i is bytes from `start[i]` on of the document with order rank[i].
    """
    order = suffix_array(text, ends)
    shared = common_prefixes(text, ends, order)
    size = np.diff(ends)
    stop = np.repeat(ends[1:], size)
    full = order + LENGTH <= stop[order]
    order = order[full]
    place = np.flatnonzero(full)
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # two windows share the least of the prefixes from one to the other, shorter suffixes between them included
    joined = np.minimum.reduceat(shared[: place[-1] + 1], np.concatenate([[0], place[:-1] + 1])) >= LENGTH
    joined[0] = False
    owner = np.repeat(np.arange(len(size)), size)[order]
    when = rank[owner] << 32 | start[owner] + order - ends[owner]
    head = np.flatnonzero(~joined)
    least = np.minimum.reduceat(when, head)
    late = when != np.repeat(least, np.diff(np.append(head, len(order))))
    return order[late], order[~late]


# --- anchors ---------------------------------------------------------------------------------------------------------

_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16), b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def regions(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document row, first window, windows, anchor hash, region hash) of all regions of texts laid end to end."""
    n, wide = len(flat), LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    size = np.diff(ends)
    if not (size >= LENGTH).any():
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    power, inverse = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    gram = common.mix64((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    place = np.uint64((1 << 28) - 1)
    mixed = (gram & ~place) | np.arange(len(gram), dtype=np.uint64)  # texts of a batch are below 256 MB
    # the least of each `wide` places, from running minima of blocks
    m = -(-len(mixed) // wide) * wide
    padded = np.concatenate([mixed, np.full(m - len(mixed), ~np.uint64(0))]).reshape(-1, wide)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    anchor = (np.minimum(back[:windows], ahead[wide - 1 : wide - 1 + windows]) & place).astype(np.int64)
    good = np.repeat(ends[1:], size)[:windows] - np.arange(windows) >= LENGTH
    begins = good.copy()
    begins[1:] &= ~good[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(begins)
    stops = good.copy()
    stops[:-1] &= ~good[1:] | (anchor[1:] != anchor[:-1])
    count = np.flatnonzero(stops) - first + 1
    row = np.searchsorted(ends, first, "right") - 1
    span = first + count + LENGTH - 1
    whole = common.mix64((total[span] - total[first]) * inverse[first] + np.uint64(977) * count.astype(np.uint64) + (anchor[first] - first).astype(np.uint64))
    return row, first, count, gram[anchor[first]], whole


def _texts(docs: DataFrame) -> DataFrame:
    """doc (null ids last), tie and text: (doc, tie) names a text and orders texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    return docs.select(_doc().alias("doc"), _tie(digest).alias("tie"), text.alias("text"))


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_NONE)))


def _tie(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(rows, their bytes, where they end, where they begin in the text). A long text comes in pieces that share all
    but one byte of a window, so that each window is in one piece and a piece stays below about twice BATCH_BYTES."""
    for whole in batches:
        for batch in common.slices(whole, column, HASH_BYTES):
            flat, ends = common.text_bytes(batch.column(column))
            if len(ends) > 2 or len(flat) <= 2 * BATCH_BYTES:
                yield batch, flat, ends, 0
                continue
            for at in range(0, len(flat) - LENGTH + 1, BATCH_BYTES):
                piece = flat[at : at + BATCH_BYTES + LENGTH - 1]
                yield batch, piece, np.array([0, len(piece)]), at


def repeats(docs: DataFrame, split: int = SPLIT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc, tie, start, n): runs of n windows of a text, from `start` on, that occur earlier in the corpus."""
    spark = docs.sparkSession
    texts, parts = _texts(docs), common.shuffle_partitions(docs.sparkSession)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flat, ends, _ in _batches(batches, 0):
            hashes, count = np.unique(regions(flat, ends)[3], return_counts=True)
            yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(count)], ["anchor", "n"])

    often = texts.select("text").mapInArrow(common.tidied(anchors), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", (F.col("n") > split).alias("hot"))
    often, _ = common.kept(often, "anchors")
    filled = spark.sparkContext.broadcast(key_filter(often, "anchor", [F.col("anchor").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("anchor", 32).bitwiseAND(FILTER_BITS - 1)]))  # of fixed size
    common.release(spark)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64(FILTER_BITS - 1)
        for batch, flat, ends, begin in _batches(batches, 2):
            row, first, count, anchor, _ = regions(flat, ends)
            hit = may_hold(filled.value, (anchor & mask).astype(np.int64), (anchor >> np.uint64(32) & mask).astype(np.int64))
            row, first, count, anchor = (x[hit] for x in (row, first, count, anchor))
            take = pa.array(row)
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(first - ends[row] + begin), pa.array(count), pa.array(anchor.view(np.int64))], ["doc", "tie", "start", "n", "anchor"])

    # the filter may let others through, above all when it is full; the join does not
    found = texts.mapInArrow(common.tidied(occurrences), "doc long, tie long, start long, n long, anchor long").join(often, "anchor")
    wanted, _ = common.kept(found.groupBy("doc", "tie").agg(F.collect_set(F.struct("anchor", "start", "n", "hot")).alias("wanted")), "wanted")  # bounded by the text's length
    filled.destroy()
    common.release(spark)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, names = zstandard.ZstdDecompressor(), ["anchor", "part", "split", "doc", "tie", "start", "bytes"]
        for whole in batches:
            for batch in common.slices(whole, 2, BATCH_BYTES):
                regions_ = batch.column(3)
                text = [press.decompress(p.as_py()) for p in batch.column(2)]
                row = np.repeat(np.arange(len(text)), np.asarray(regions_.value_lengths()))
                anchor, start, n, hot = regions_.flatten().flatten()
                kinds: dict[tuple[int, bytes], int] = {}  # copies of a region travel once from a batch
                kind = np.array([kinds.setdefault((h, text[r][a : a + k + LENGTH - 1]), len(kinds)) for h, r, a, k in zip(anchor.to_pylist(), row.tolist(), start.to_pylist(), n.to_pylist())], np.int64)
                by = np.argsort(kind, kind="stable")
                first = by[np.searchsorted(kind[by], np.arange(len(kinds)))]
                offsets = pa.array(np.append(np.searchsorted(kind[by], np.arange(len(kinds))), len(by)), pa.int32())
                doc, tie = (np.asarray(batch.column(c))[row] for c in (0, 1))
                wide = np.asarray(hot)[first] if len(first) else np.zeros(0, bool)
                part = np.where(wide, np.abs(doc[first] * 31 + tie[first]) % parts, 0)
                places = [pa.ListArray.from_arrays(offsets, pa.array(x[by])) for x in (doc, tie, np.asarray(start))]
                yield pa.record_batch([pa.array([h for h, _ in kinds], pa.int64()), pa.array(part), pa.array(wide.astype(bool)), *places, pa.array([b for _, b in kinds], pa.binary())], names)

    dealt = _cut(docs, wanted).mapInArrow(common.tidied(extract), "anchor long, part long, split boolean, doc array<long>, tie array<long>, start array<long>, bytes binary")
    dealt = dealt.repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part")
    sort = lambda batches: _shards(batches, 4 * parts, shard_bytes)
    sharded, _ = common.kept(dealt.mapInArrow(common.tidied(sort), "doc long, tie long, start long, n long, anchor long, slot int, windows binary"), "shards")
    common.release(spark)
    inside = sharded.filter("windows IS NULL").select("doc", "tie", "start", "n")
    tables = sharded.filter("windows IS NOT NULL").select("anchor", "slot", "windows").repartition(parts, "slot").sortWithinPartitions("slot")
    return inside.unionByName(tables.mapInArrow(common.tidied(_merge), "doc long, tie long, start long, n long"))


_SORTED = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("start", "<i8"), ("bytes", f"S{LENGTH}")])
#: Windows of split anchors are merged in so many slots, by a hash of their bytes.
SLOTS = 64


def _shards(batches: Iterator[pa.RecordBatch], slots: int = SLOTS, shard_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """From regions sorted by anchor and part, with one place or a list of places each: rows (doc, tie, start, n) of
    superfluous windows, and for split anchors rows (anchor 0, slot, windows) with the shard's sorted first windows. As
    equal windows have equal anchors, tables of several anchors can be merged as one."""
    names = ["doc", "tie", "start", "n", "anchor", "slot", "windows"]
    kinds: dict[tuple[int, bytes], int] = {}  # equal strings are one
    split: list[bool] = []
    owner: list[int] = []
    places: list[tuple[np.ndarray, ...]] = []
    size, limit = 0, shard_bytes or SHARD_BYTES

    def runs(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, (doc, tie, start, n)), *(pa.nulls(len(doc), t) for t in (pa.int64(), pa.int32(), pa.binary()))], names=names)

    def shard() -> Iterator[pa.RecordBatch]:
        strings = [b for _, b in kinds]
        ends = np.concatenate([[0], np.cumsum([len(b) for b in strings])])
        doc, tie, start, count = (np.concatenate(x) for x in zip(*places))
        string = np.repeat(np.array(owner, np.int64), count)
        by = np.lexsort((start, tie, doc, string))
        doc, tie, start, string = doc[by], tie[by], start[by], string[by]
        differ = lambda *x: np.logical_or.reduce([np.concatenate([[True], c[1:] != c[:-1]]) for c in x])
        new = differ(string, doc, tie, start)  # repeated rows of the table
        doc, tie, start, string = doc[new], tie[new], start[new], string[new]
        head = differ(string)
        rest = ~head
        yield runs(doc[rest], tie[rest], start[rest], np.diff(ends)[string[rest]] - LENGTH + 1)
        doc, tie, start = doc[head], tie[head], start[head]
        by = np.lexsort((tie, doc))
        rank = np.zeros(len(doc), np.int64)
        rank[by] = np.cumsum(differ(doc[by], tie[by]))
        text = np.frombuffer(b"".join(strings), np.uint8)
        late, least = later_windows(text, ends, rank, start)
        late.sort()
        own = np.searchsorted(ends, late, "right") - 1
        at = np.flatnonzero(np.concatenate([[True], (late[1:] != late[:-1] + 1) | (own[1:] != own[:-1])])) if len(late) else np.zeros(0, np.int64)
        of = own[at]
        yield runs(doc[of], tie[of], start[of] + late[at] - ends[of], np.diff(np.append(at, len(late))))
        # windows that split anchors have in this shard go on in sorted order
        own = np.searchsorted(ends, least, "right") - 1
        wide = np.array(split, bool)[own]
        least, own = least[wide], own[wide]
        if not len(least):
            return
        table = np.zeros(len(least), _SORTED)
        table["doc"], table["tie"], table["start"] = doc[own], tie[own], start[own] + least - ends[own]
        bytes_ = text[least[:, None] + np.arange(LENGTH)]
        table["bytes"] = np.ascontiguousarray(bytes_).view(f"S{LENGTH}").ravel()
        slot = (common.mix64((bytes_.astype(np.uint64) * (2 * np.arange(LENGTH, dtype=np.uint64) + 1) ** 3).sum(1)) % np.uint64(slots)).astype(np.int64)
        by = np.argsort(slot, kind="stable")
        table, slot = table[by], slot[by]
        at = np.append(np.flatnonzero(differ(slot)), len(slot))
        packed = [table[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(packed), pa.int64()) for _ in range(4)), pa.array(np.zeros(len(packed), np.int64)), pa.array(slot[at[:-1]], pa.int32()), pa.array(packed, pa.binary())], names=names)

    of = None
    for batch in batches:
        anchor, part, wide, data = (batch.column(c).to_pylist() for c in (0, 1, 2, 6))
        listed = pa.types.is_list(batch.schema.field(3).type)
        count = np.asarray(batch.column(3).value_lengths(), np.int64) if listed else np.ones(batch.num_rows, np.int64)
        flat = [np.asarray(batch.column(c).flatten() if listed else batch.column(c), np.int64) for c in (3, 4, 5)]
        ends = np.concatenate([[0], np.cumsum(count)])
        begin = 0
        for i, key in enumerate(zip(anchor, part)):
            # parts of one anchor stay apart, as they would in different tasks
            if kinds and key != of and (size > limit or wide[i] and key[0] == of[0]):
                places.append((*(x[ends[begin] : ends[i]] for x in flat), count[begin:i]))
                yield from shard()
                kinds, split, owner, places, size, begin = {}, [], [], [], 0, i
            of = key
            k = kinds.setdefault((key[0], data[i]), len(kinds))
            if k == len(split):
                split.append(wide[i])
                size += len(data[i])
            owner.append(k)
        places.append((*(x[ends[begin] :] for x in flat), count[begin:]))
    if kinds:
        yield from shard()


def _met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(both sorted tables of different windows as one, in which of equal windows the earliest stays; the others)."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a["bytes"], b["bytes"])
    inside = np.minimum(at, len(a) - 1)
    same = a["bytes"][inside] == b["bytes"]
    mine, theirs = b[same], a[inside[same]]
    earlier = (mine["doc"] < theirs["doc"]) | (mine["doc"] == theirs["doc"]) & ((mine["tie"] < theirs["tie"]) | (mine["tie"] == theirs["tie"]) & (mine["start"] < theirs["start"]))
    a = a.copy()
    a[inside[same][earlier]] = mine[earlier]
    out = np.empty(len(a) + len(b) - len(mine), _SORTED)
    place = at[~same] + np.arange(len(b) - len(mine))
    old = np.ones(len(out), bool)
    old[place] = False
    out[place], out[old] = b[~same], a
    return out, np.where(earlier, theirs, mine)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted windows of split anchors' shards, met by binary search, tables of like size first."""
    of, tables = None, []

    def meet(least: int) -> Iterator[pa.RecordBatch]:
        while len(tables) > 1 and len(tables[-1]) >= least * len(tables[-2]) // 2:
            table, late = _met(tables.pop(), tables.pop())
            tables.append(table)
            if len(late):
                yield pa.record_batch([pa.array(late[c].copy()) for c in ("doc", "tie", "start")] + [pa.array(np.ones(len(late), np.int64))], ["doc", "tie", "start", "n"])

    for batch in batches:
        for anchor, slot, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if of != (anchor, slot):
                yield from meet(0)
                of, tables = (anchor, slot), []
            tables.append(np.frombuffer(packed, _SORTED))
            yield from meet(1)
    yield from meet(0)


# --- removal ---------------------------------------------------------------------------------------------------------


def removed_spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Maximal removed byte runs [a, b), from runs of superfluous windows."""
    by = np.argsort(start, kind="stable")
    a, b = start[by], np.maximum.accumulate((start + n - 1 + LENGTH)[by])
    new = np.concatenate([[True], a[1:] > b[:-1]]) if len(a) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    return np.stack([a[head], b[np.append(head[1:], len(a)) - 1]], 1) if len(head) else np.zeros((0, 2), np.int64)


def spans(docs: DataFrame, split: int = SPLIT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc, tie, spans): the removed byte runs of each text that loses some, as array of [start, stop)."""

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, n = (np.asarray(x, np.int64) for x in batch.column(2).flatten().flatten())
            row = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column(2).value_lengths(), np.int64))
            got = removed_spans(start + (row << 40), n)  # texts one after the other
            ends = 2 * np.searchsorted(got[:, 0] >> 40, np.arange(batch.num_rows + 1))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((got & (1 << 40) - 1).ravel()))], ["doc", "tie", "spans"])

    runs = repeats(docs, split, shard_bytes).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("runs"))  # bounded by the text's length
    return runs.mapInArrow(common.tidied(join_up), "doc long, tie long, spans array<long>")


def _cut(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """(doc, tie, text, spans) of the texts that lose something. A bounded filter keeps the others out of the shuffle."""
    words = docs.sparkSession.sparkContext.broadcast(key_filter(lost, "doc", [F.pmod(F.xxhash64("doc", "tie", F.lit(s)), F.lit(FILTER_BITS)) for s in (1, 2)]))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            hit = np.flatnonzero(may_hold(words.value, np.asarray(whole.column(3)), np.asarray(whole.column(4))))
            for batch in common.slices(whole.take(pa.array(hit)), 2, 4 * BATCH_BYTES):
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array([press.compress(t.as_py().encode()) for t in batch.column(2)], pa.binary())], ["doc", "tie", "packed"])

    bits = [F.pmod(F.xxhash64("doc", "tie", F.lit(s)), F.lit(FILTER_BITS)).alias(f"bit{s}") for s in (1, 2)]
    packed = _texts(docs).select("doc", "tie", "text", *bits).mapInArrow(common.tidied(near), "doc long, tie long, packed binary").groupBy("doc", "tie").agg(F.min("packed").alias("packed"))
    return packed.join(lost, ["doc", "tie"])


def _without(text: bytes, runs: list[int]) -> bytes:
    at, kept = 0, []
    for a, b in zip(runs[::2], runs[1::2]):
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def dedup_report(docs: DataFrame, split: int = SPLIT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are ordered by doc_id, null ids last; different texts of one doc_id by their digest; of repeated rows (same
    doc_id and text) one comes first and the others lose all they can. Null text: empty. Texts below 100 bytes lose
    nothing. Other columns are ignored. An empty table gives no rows.
    """
    lost, _ = common.kept(spans(docs, split, shard_bytes), "spans")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in (part for whole in batches for part in common.slices(whole, 2, BATCH_BYTES)):
            runs = batch.column(3).to_pylist()
            sha = [hashlib.sha256(_without(press.decompress(p.as_py()), r)).hexdigest() for p, r in zip(batch.column(2), runs)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([sum(r[1::2]) - sum(r[::2]) for r in runs], pa.int64()), pa.array([len(r) // 2 for r in runs], pa.int64()), pa.array(sha)], ["doc", "tie", "n_removed", "n_spans", "kept"])

    changed = _cut(docs, lost).mapInArrow(common.tidied(digest), "doc long, tie long, n_removed long, n_spans long, kept string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _doc().alias("doc"), F.sha2(text.cast("binary"), 256).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.groupBy("doc_id", "doc", "sha", "n_bytes").agg(F.count("*").alias("rows")).withColumn("tie", _tie(F.col("sha")))
    rows = rows.join(changed, ["doc", "tie"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    gone = (F.col("copy") > 1) & (F.col("n_bytes") >= LENGTH)
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(nothing)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs, all columns and rows, with the repeated bytes taken out of `text`.

    A run that begins or ends inside a character takes the whole character out. A text that loses everything becomes
    empty, its row stays. Null texts stay null. Of rows with one doc_id and one text of 100 bytes or more, one is the
    first occurrence and the others become empty. A row travels as one struct, so that no column clashes.
    """
    lost, _ = common.kept(spans(docs), "spans")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _doc().alias("doc"), _tie(F.sha2(text.cast("binary"), 256)).alias("tie"), (F.octet_length(text) >= LENGTH).alias("long"))
    again = tagged.filter("long").groupBy("doc", "tie").agg(F.count("*").alias("n")).filter("n > 1").select("doc", "tie", F.lit(True).alias("again"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in (part for whole in batches for part in common.slices(whole, 2, BATCH_BYTES)):
            kept = [_without(press.decompress(p.as_py()), r).decode("utf-8", "ignore") for p, r in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(kept, pa.string())], ["doc", "tie", "kept"])

    changed = _cut(docs, lost).mapInArrow(common.tidied(cut), "doc long, tie long, kept string")
    joined = tagged.join(changed, ["doc", "tie"], "left").join(again, ["doc", "tie"], "left")
    one = joined.filter("again IS NULL").withColumn("nth", F.lit(1))
    more = joined.filter("again").withColumn("nth", F.row_number().over(Window.partitionBy("doc", "tie").orderBy("long")))  # rows repeated in full
    text = F.when(F.col("nth") > 1, "").otherwise(F.coalesce("kept", F.col("row.text")))
    return one.unionByName(more).select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(common.table(spark, sf_dir, "documents"))
