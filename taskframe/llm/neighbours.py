"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, as flat arrays.

Rows are dealt to shards of about SHARD different vectors. A shard's graph has layers of ever fewer nodes; each layer
is an array of neighbour numbers, nodes by degree, padded with -1. Layers are built from the top, in batches that grow
with the layer: a batch's nodes search the graph so far side by side, look at each other, and keep neighbours that are
nearer to them than to a neighbour already kept. Searches go down the layers and keep a beam of the nearest seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Different vectors in a shard; neighbours of a node above and on the lowest layer; beams when building and searching.
SHARD, DEGREE, DEGREE_LOW, BEAM_BUILD, BEAM_SEARCH = 4_096, 16, 32, 64, 160
#: Nodes inserted, or queries searched, side by side; nodes of the beam that a step looks behind.
BATCH, EXPAND = 256, 4
#: Queries in a block; every block meets every shard. Most tasks of a search.
BLOCK, MOST_TASKS = 2_048, 10_000


@dataclass
class Graph:
    vectors: np.ndarray  # float32, nodes in the order of insertion: nodes of high layers first
    layers: list[np.ndarray]  # lowest first; layer l holds the first len(layers[l]) nodes


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of a[i] and b[i, j]."""
    d = b - a[:, None, :]
    return np.einsum("ijk,ijk->ij", d, d)


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of the nearest seen by each query, nearest first, padded with -1 and infinity."""
    m, n = len(queries), len(links)
    rows = np.arange(m)[:, None]
    ids = np.full((m, width), -1)
    dist = np.full((m, width), np.inf, np.float32)
    done = np.zeros((m, width), bool)
    seen = np.zeros((m, n + 1), bool)
    k = min(start.shape[1], width)
    ids[:, :k] = start[:, :k]
    seen[rows, start] = True
    dist[:, :k] = np.where(start[:, :k] >= 0, distances(queries, vectors[start[:, :k]]), np.inf)
    live = np.arange(m)
    while len(live):
        open_ = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
        pick = np.argpartition(open_, min(EXPAND, width) - 1, 1)[:, :EXPAND] if width > EXPAND else np.tile(np.arange(width), (len(live), 1))
        good = np.isfinite(np.take_along_axis(open_, pick, 1))
        more = good.any(1)
        live, pick, good = live[more], pick[more], good[more]
        if not len(live):
            break
        at = live[:, None]
        done[at, pick] = True
        near = np.where(good[:, :, None], links[ids[at, pick]], -1).reshape(len(live), -1)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[at, near]] = -1
        seen[at, near] = True
        seen[:, n] = False
        far = np.where(near >= 0, distances(queries[live], vectors[near]), np.inf).astype(np.float32)
        all_ids, all_dist = np.concatenate([ids[live], near], 1), np.concatenate([dist[live], far], 1)
        all_done = np.concatenate([done[live], np.zeros_like(near, bool)], 1)
        best = np.argpartition(all_dist, width - 1, 1)[:, :width]
        ids[live], dist[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_dist, all_done))
    order = np.argsort(dist, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def diverse(vectors: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """At most `most` of each row's candidates (nearest first, -1 padded): those nearer to the row's node than to any
    candidate kept before, then the nearest of the rest."""
    m, width = ids.shape
    near = vectors[ids]
    norm = np.einsum("ijk,ijk->ij", near, near)
    between = norm[:, :, None] + norm[:, None, :] - 2 * near @ near.transpose(0, 2, 1)
    kept = np.zeros((m, width), bool)
    count = np.zeros(m, np.int64)
    for c in range(width):
        clash = (kept[:, :c] & (between[:, c, :c] < dist[:, c, None])).any(1)
        take = (ids[:, c] >= 0) & ~clash & (count < most)
        kept[:, c] = take
        count += take
    rank = np.where(ids < 0, 3 * width, np.where(kept, 0, width) + np.arange(width))
    best = np.argsort(rank, 1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, best, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _layer(vectors: np.ndarray, n: int, degree: int, above: tuple[np.ndarray, ...] | None) -> np.ndarray:
    """Neighbours of the first n nodes. `above`: the upper layers, for entry points."""
    links = np.full((n, degree), -1)
    at = 0
    while at < n:
        to = min(n, at + max(1, min(BATCH, at)))
        new = np.arange(at, to)
        q = vectors[new]
        ids, dist = np.full((len(new), 1), -1), np.full((len(new), 1), np.inf, np.float32)
        if at:
            entry = _descend(vectors, above, q, limit=at) if above else np.zeros((len(new), 1), np.int64)
            ids, dist = beam(vectors, links[:at], q, entry, min(BEAM_BUILD, at))
        if len(new) > 1:  # the batch's nodes among themselves
            among = distances(q, np.broadcast_to(q, (len(new), *q.shape))).astype(np.float32)
            np.fill_diagonal(among, np.inf)
            k = min(degree, len(new) - 1)
            close = np.argsort(among, 1, kind="stable")[:, :k]
            ids, dist = np.concatenate([ids, new[close]], 1), np.concatenate([dist, np.take_along_axis(among, close, 1)], 1)
            order = np.argsort(dist, 1, kind="stable")[:, :BEAM_BUILD]
            ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        links[new] = diverse(vectors, ids, dist, degree)
        # links back; a node with too many keeps the best
        source, target = np.repeat(new, degree), links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        node, first, count = np.unique(target, return_index=True, return_counts=True)
        for low in range(0, len(node), BATCH):
            part, head, size = node[low : low + BATCH], first[low : low + BATCH], np.minimum(count[low : low + BATCH], 3 * degree)
            extra = np.full((len(part), int(size.max())), -1)
            col = np.arange(extra.shape[1])
            fill = col < size[:, None]
            extra[fill] = source[(head[:, None] + col)[fill]]
            both = np.sort(np.concatenate([links[part], extra], 1), 1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            far = np.where(both >= 0, distances(vectors[part], vectors[both]), np.inf).astype(np.float32)
            order = np.argsort(far, 1, kind="stable")
            links[part] = diverse(vectors, np.take_along_axis(both, order, 1), np.take_along_axis(far, order, 1), degree)
        at = to
    return links


def _descend(vectors: np.ndarray, layers: tuple[np.ndarray, ...], queries: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Entry points below `layers` (lowest of them first): a narrow beam down from the top."""
    entry = np.zeros((len(queries), 1), np.int64)
    for links in reversed(layers):
        entry = beam(vectors, links, queries, entry, 4)[0]
    return np.where(entry >= (limit if limit is not None else len(vectors)), 0, entry)


def build(vectors: np.ndarray) -> Graph:
    """Vectors in random order. Each layer holds a DEGREE-th of the layer below it."""
    vectors = np.ascontiguousarray(vectors, np.float32)
    sizes = [len(vectors)]
    while sizes[-1] > 2 * DEGREE:
        sizes.append(sizes[-1] // DEGREE)
    layers: list[np.ndarray] = []
    for size in reversed(sizes):
        layers.insert(0, _layer(vectors, size, DEGREE_LOW if size == len(vectors) else DEGREE, tuple(layers) or None))
    return Graph(vectors, layers)


def search(graph: Graph, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for at in range(0, len(queries), BATCH):
        q = np.ascontiguousarray(queries[at : at + BATCH], np.float32)
        out.append(beam(graph.vectors, graph.layers[0], q, _descend(graph.vectors, tuple(graph.layers[1:]), q), min(width, len(graph.vectors))))
    return np.concatenate([a for a, _ in out]), np.concatenate([d for _, d in out])


# --- tables ----------------------------------------------------------------------------------------------------------


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of rows with an id and a vector that is not empty, not zero and has only finite numbers."""
    v = F.col(vector_column).cast("array<double>")
    rows = rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def build_index(rows: DataFrame, most_ids: int, id_column: str = "vec_id", vector_column: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(dims, shard, vectors, ids, ends, layers) of every shard, written to the shared folder.

    Equal vectors are one node, which carries the `most_ids` smallest of its ids: enough for any answer of one result
    less. Ids are cut down in every task before the shuffle, so that a very common vector stays small. Vectors of
    different lengths go to different shards.
    """
    spark = rows.sparkSession

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                of.setdefault(np.array(v.values.to_numpy() + 0.0, "<f8").tobytes(), []).append(i)
            yield pa.record_batch([pa.array(list(of), pa.binary()), pa.array([sorted(set(x))[:most_ids] for x in of.values()], pa.list_(pa.int64()))], ["v", "ids"])

    nodes = usable(rows, id_column, vector_column).mapInArrow(smallest, "v binary, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most_ids)  # a list per batch
    nodes, _ = common.kept(nodes.groupBy("v").agg(ids.alias("ids")), "vectors")
    count = nodes.groupBy(F.octet_length("v").alias("size")).agg(F.count("*").alias("n")).collect()  # a row per length
    parts = F.create_map(*[F.lit(x) for r in count for x in (r["size"], -(-r["n"] // shard))]) if count else F.create_map(F.lit(0), F.lit(1))
    dealt = nodes.withColumns({"size": F.octet_length("v"), "mix": F.xxhash64("v", F.lit(3))})
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("v"), F.element_at(parts, F.col("size")).cast("long")))

    def graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, list[int]]] = []
        of = None

        def graph() -> pa.RecordBatch:
            v = np.frombuffer(b"".join(x for x, _ in held), "<f8").reshape(len(held), -1)
            g = build(v)
            flat = np.concatenate([x for _, x in held]).astype("<i8")
            ends = np.cumsum([0] + [len(x) for _, x in held]).astype("<i8")
            return pa.RecordBatch.from_arrays([pa.array([v.shape[1]], pa.int64()), pa.array([of[1]], pa.int64()), pa.array([v.tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary()), pa.array([ends.tobytes()], pa.binary()), pa.array([[x.astype("<i4").tobytes() for x in g.layers]], pa.list_(pa.binary()))], names=["dims", "shard", "vectors", "ids", "ends", "layers"])

        for batch in batches:
            for size, part, v, own in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4))):
                if held and of != (size, part):
                    yield graph()
                    held = []
                of = (size, part)
                held.append((v, own))
        if held:
            yield graph()

    shards = max(1, sum(-(-r["n"] // shard) for r in count))
    dealt = dealt.select("size", "part", "mix", "v", "ids").repartition(shards, "size", "part").sortWithinPartitions("size", "part", "mix", "v")
    index, _ = common.kept(dealt.mapInArrow(graphs, "dims long, shard long, vectors binary, ids binary, ends binary, layers array<binary>"), "index", "none")
    return index


def nearest(index: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding", width: int = BEAM_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of the indexed rows other than its own, by Euclidean
    distance in double precision, ties to the smaller id. Fewer than k rows: all of them. Queries that are null, zero or
    not finite give no rows; repeated queries count once. The index must have been built with more than k ids a node.
    """
    asked = usable(queries, id_column, vector_column).distinct()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1).value_lengths())
            for d in np.unique(dims):
                some = np.flatnonzero(dims == d)
                for at in range(0, len(some), BLOCK):
                    part = batch.take(pa.array(some[at : at + BLOCK]))
                    yield pa.record_batch([pa.array([int(d)]), pa.array([np.asarray(part.column(0), "<i8").tobytes()], pa.binary()), pa.array([np.asarray(part.column(1).flatten(), "<f8").tobytes()], pa.binary())], ["dims", "q_ids", "q_vectors"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, vectors, ids, ends, layers, q_ids, q_vectors in zip(*(batch.column(c) for c in range(7))):
                v = np.frombuffer(vectors.as_py(), "<f8").reshape(-1, dims.as_py())
                ids, ends = np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(ends.as_py(), "<i8")
                degree = [DEGREE_LOW] + [DEGREE] * (len(layers) - 1)
                g = Graph(v.astype(np.float32), [np.frombuffer(x, "<i4").reshape(-1, n).astype(np.int64) for x, n in zip(layers.as_py(), degree)])
                q_id, q = np.frombuffer(q_ids.as_py(), "<i8"), np.frombuffer(q_vectors.as_py(), "<f8").reshape(-1, dims.as_py())
                found, _ = search(g, q, width)
                found = found[:, : max(2 * k, k + 8)]
                row, col = np.nonzero(found >= 0)
                node = found[row, col]
                exact = np.sqrt(((v[node] - q[row]) ** 2).sum(1))
                n = ends[node + 1] - ends[node]
                pick = np.repeat(ends[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
                row, exact, near = np.repeat(row, n), np.repeat(exact, n), ids[pick]
                other = near != q_id[row]
                row, exact, near = row[other], exact[other], near[other]
                order = np.lexsort((near, exact, row))
                row, exact, near = row[order], exact[order], near[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                best = place < k
                yield pa.record_batch([pa.array(q_id[row[best]]), pa.array(near[best]), pa.array(exact[best])], ["query_id", "vec_id", "score"])

    # a stated set of queries against all shards, in blocks: each block goes to every shard by the shard's number
    spark = index.sparkSession
    packed, _ = common.kept(asked.mapInArrow(blocks, "dims long, q_ids binary, q_vectors binary"), "queries", "none")
    shards = {r["dims"]: r["n"] for r in index.groupBy("dims").agg((F.max("shard") + 1).alias("n")).collect()}  # a row per length
    n_blocks = packed.count()
    last = F.create_map(*[F.lit(x) for d, n in shards.items() for x in (d, n - 1)]) if shards else F.create_map(F.lit(0), F.lit(0))
    sent = packed.withColumn("last", F.element_at(last, F.col("dims"))).filter("last IS NOT NULL").select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("shard"), "q_ids", "q_vectors")
    tasks = max(common.shuffle_partitions(spark), min(sum(shards.values()) * max(n_blocks, 1), MOST_TASKS))
    pairs = index.repartition(tasks, "dims", "shard").hint("merge").join(sent.repartition(tasks, "dims", "shard"), ["dims", "shard"])
    pairs = pairs.select("dims", "vectors", "ids", "ends", "layers", "q_ids", "q_vectors")
    found = pairs.mapInArrow(find, "query_id long, vec_id long, score double").distinct()
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row whose id is divisible by 100."""
    rows = common.table(spark, sf_dir, "embeddings")
    return nearest(build_index(rows, 11), rows.filter(F.col("vec_id") % 100 == 0), 10)
