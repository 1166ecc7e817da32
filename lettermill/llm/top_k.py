"""Exact top-k search by integer inner product, with cover trees over queries and data.

The upper levels of the tree are grown on a bounded sample: nets of centres, each covering what
is nearest to it. Every row is assigned to its nearest centre, which gives each node its covering
radius over all rows; a node's rows are dealt into blocks of bounded size, so a vector that a third of all rows
repeat fills many blocks and no large task. Queries are grouped the same way. With c the centre and r the radius of a node,

    <q, p>  <=  <cq, cp> + |cq| rp + |cp| rq + rq rp

bounds every score of a pair of nodes. A query group leaves out the nodes, then the blocks, then
the branches within a block's own tree whose bound is below the worst kth score of the group; that
score starts from the sample and rises as blocks are searched.

Defined results: null vectors and ids, empty vectors and vectors with null or non-finite components take no
part; a shorter vector counts as padded with zeros; of rows with one id the least vector counts, or with
``one_per_id=False`` every row does: it is a candidate to all queries of other ids, and the queries of one
id share one ranking, in which a pair of rows has one place. The registered query and its SQL do the latter;
scores must fit into 63 bits; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.tables import written

SAMPLE, BLOCK, LEAF, FAN, MAX_NODES, SLICES = 4096, 2048, 128, 16, 256, 6


def net(points: np.ndarray, n: int, separation: float = 0.0) -> np.ndarray:
    """Places of up to ``n`` centres, each the point farthest from those before, until all are within ``separation``."""
    chosen = [0]
    nearest = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < n and nearest.max() > separation:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return np.array(chosen)


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (points ** 2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres ** 2).sum(axis=1)
    best = square.argmin(axis=1)
    return best, np.linalg.norm(points - centres[best], axis=1)


def bound(a: Node, b: Node) -> float:
    """No score of a pair from both nodes is above this; a little slack covers rounding."""
    top = a.centre @ b.centre + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
    return top + 1e-9 * (a.norm + a.radius) * (b.norm + b.radius) + 1e-6


class Node:
    """A cover tree node over rows ``places`` of a matrix; children halve the radius where the data allow."""

    def __init__(self, points: np.ndarray, places: np.ndarray | None = None) -> None:
        self.places = np.arange(len(points)) if places is None else places
        own = points[self.places]
        self.centre, self.norm = own[0], float(np.linalg.norm(own[0]))
        self.radius = float(np.linalg.norm(own - own[0], axis=1).max())
        self.children: list[Node] = []
        if len(own) > LEAF and self.radius > 0:
            centres = net(own, FAN, self.radius / 2)
            child, _ = nearest_centre(own, own[centres])
            child[centres] = np.arange(len(centres))
            for i, centre in enumerate(centres):
                rest = np.flatnonzero(child == i)
                order = np.concatenate(([centre], rest[rest != centre]))
                self.children.append(Node(points, self.places[order]))


class Best:
    """The ``k`` best (score, id) of each query of a group; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray) -> None:
        self.ids, self.vectors, self.k, self.least = ids, vectors, k, least
        self.query, self.score, self.found = (np.zeros(0, np.int64) for _ in range(3))
        self.exact = vectors.dtype == np.float64
        self.tree = Node(vectors.astype(np.float64))

    def search(self, ids: np.ndarray, vectors: np.ndarray, tree: Node) -> None:
        pending = [(self.tree, tree)]
        while pending:
            a, b = pending.pop()
            if bound(a, b) < self.least[a.places].min():
                continue
            if a.children and (a.radius >= b.radius or not b.children):
                pairs = [(child, b) for child in a.children]
            elif b.children:
                pairs = [(a, child) for child in b.children]
            else:
                self._leaves(a.places, ids[b.places], vectors[b.places])
                continue
            pending += sorted(pairs, key=lambda pair: bound(*pair))

    def _leaves(self, places: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = self.vectors[places] @ vectors.T
        q, d = np.nonzero((scores >= self.least[places][:, None]) & (self.ids[places][:, None] != ids[None, :]))
        if not len(q):
            return
        query = np.concatenate((self.query, places[q]))
        score = np.concatenate((self.score, scores[q, d].astype(np.int64)))
        found = np.concatenate((self.found, ids[d]))
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        starts = np.searchsorted(query, query)
        rank = np.arange(len(query)) - starts
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        keep = rank < self.k
        self.query, self.score, self.found = query[keep], score[keep], found[keep]


def _matrix(data: bytes, dim: int, wide: bool) -> np.ndarray:
    """Integers as float64 where sums of products are exact in it, else as 64-bit integers."""
    values = np.frombuffer(data, "<i8").reshape(-1, dim)
    return values if wide else values.astype(np.float64)


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = 1024, one_per_id: bool = True) -> DataFrame:
    """(id, v) with v the components times ``scale``, rounded down; one row per id, or all rows."""
    parts = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    whole = F.transform(parts, lambda x: F.floor(x * scale).cast("bigint"))
    rows = usable.select(F.col(key).cast("long").alias("id"), whole.alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v")) if one_per_id else rows


def top_k(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024,
          one_per_id: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` (a condition on ``id``) holds for, its best others."""
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    whole = integer_vectors(df, key, vector, scale, one_per_id).withColumn("is_query", F.coalesce(queries, F.lit(False)))
    # Rows are sampled and dealt by their number, so that an id of many rows fills many blocks.
    rows = written(whole.withColumn("row", F.monotonically_increasing_id()))
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("long")).alias("q"), F.max(F.size("v")).alias("dim"),
                     F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top")).first()
    n, n_queries, dim = about["n"], about["q"] or 0, about["dim"]
    if not n_queries:
        return spark.createDataFrame([], schema)
    wide = about["top"] ** 2 * dim >= 2 ** 53
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 40)) / float(1 << 40)
    # About SAMPLE rows, whatever the table's size: centres, and first lower bounds of the kth scores.
    sample = sorted((r["id"], r["v"]) for r in rows.filter(share < SAMPLE / n).select("id", "v").collect()) or [
        tuple(rows.select("id", "v").first())]
    sample_ids = np.array([i for i, _ in sample])
    points = np.zeros((len(sample), dim), np.int64)
    for i, (_, v) in enumerate(sample):
        points[i, :len(v)] = v
    floats = points.astype(np.float64)
    centres = floats[net(floats, min(MAX_NODES, math.ceil(n / BLOCK)))]
    groups = floats[net(floats, min(MAX_NODES, math.ceil(n_queries / BLOCK)))]
    shared = spark.sparkContext.broadcast((centres, groups, sample_ids, points if wide else floats))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, groups, _, _ = shared.value
        for batch in batches:
            if batch.num_rows:
                m = np.zeros((batch.num_rows, dim), np.int64)
                lists = batch.column(1)
                offsets = np.asarray(lists.offsets)
                values, sizes = lists.values.to_numpy()[offsets[0]:offsets[-1]], np.diff(offsets)
                m[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
                f = m.astype(np.float64)
                node, far = nearest_centre(f, centres)
                group, group_far = nearest_centre(f, groups)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(node, pa.int32()), pa.array(far), pa.array(group, pa.int32()), pa.array(group_far),
                    batch.column(2), batch.column(3), pa.array([row.tobytes() for row in m.astype("<i8")], pa.binary())],
                    names=["id", "node", "far", "group", "group_far", "is_query", "row", "vector"])

    assigned = written(rows.select("id", "v", "is_query", "row").mapInArrow(
        assign, "id long, node int, far double, group int, group_far double, is_query boolean, row long, vector binary"))
    # One row per node; at most MAX_NODES.
    nodes = {r["node"]: r for r in assigned.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    data = _blocks(assigned, "node")
    asked = _blocks(assigned.filter("is_query"), "group").withColumnsRenamed({"node": "group", "block": "part"})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each group of queries the nodes that may hold one of its best, and its kth scores so far."""
        centres, _, sample_ids, points = shared.value
        for batch in batches:
            for group, part, ids, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q, m = np.frombuffer(ids, "<i8"), _matrix(vectors, dim, wide)
                best = Best(q, m, k, np.full(len(q), -np.inf))
                for start in range(0, len(points), BLOCK):
                    part_of = points[start:start + BLOCK]
                    best.search(sample_ids[start:start + BLOCK], part_of, Node(part_of.astype(np.float64)))
                worst, kept = best.least.min(), []
                for node, row in nodes.items():
                    top = Node.__new__(Node)
                    top.centre, top.norm, top.radius = centres[node], float(np.linalg.norm(centres[node])), row["far"]
                    if bound(best.tree, top) >= worst:
                        kept.append(node)
                yield pa.RecordBatch.from_arrays([
                    pa.array([group], pa.int32()), pa.array([part], pa.int64()), pa.array([kept], pa.list_(pa.int32())),
                    pa.array([ids], pa.binary()), pa.array([vectors], pa.binary()), pa.array([best.least.tobytes()], pa.binary())],
                    names=["group", "part", "nodes", "ids", "vectors", "least"])

    chosen = written(asked.mapInArrow(choose, "group int, part long, nodes array<int>, ids binary, vectors binary, least binary"))
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Vectors of queries go once to each slice, not along with each node. Never broadcast: packed rows are far larger than Spark reckons.
    wanted = chosen.select("group", "part", F.explode("nodes").alias("node")).hint("merge")
    slice_ = F.pmod(F.xxhash64("node", "block"), F.lit(SLICES)).cast("int")
    pairs = wanted.join(data.hint("merge"), "node").select(
        "group", "part", slice_.alias("slice"), F.lit(None).cast("binary").alias("least"), "ids", "vectors")
    questions = chosen.select("group", "part", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"), "least", "ids", "vectors")
    order = F.asc_nulls_last("least")
    dealt = questions.unionByName(pairs).repartition(blocks, "group", "part", "slice").sortWithinPartitions("group", "part", "slice", order)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of each query within a group's slice of blocks."""
        def out(best: Best) -> pa.RecordBatch:
            """At most ``k`` rows per id, however many queries have it."""
            ids = best.ids[best.query]
            order = np.lexsort((best.found, -best.score, ids))
            ids = ids[order]
            order = order[np.arange(len(ids)) - np.searchsorted(ids, ids) < k]
            return pa.RecordBatch.from_arrays([pa.array(best.ids[best.query[order]]), pa.array(best.found[order]), pa.array(best.score[order])],
                                              names=["query_id", "vec_id", "score"])

        best = None
        for batch in batches:
            for i in range(batch.num_rows):
                least, ids, vectors = (c[i].as_py() for c in batch.columns)
                ids, m = np.frombuffer(ids, "<i8"), _matrix(vectors, dim, wide)
                if least is None:
                    best.search(ids, m, Node(m.astype(np.float64)))
                    continue
                # The queries of a slice stand before its blocks.
                if best is not None:
                    yield out(best)
                best = Best(ids, m, k, np.frombuffer(least).copy())
        if best is not None:
            yield out(best)

    found = dealt.select("least", "ids", "vectors").mapInArrow(
        search, "query_id long, vec_id long, score long")
    # At most k rows per id of queries, part and slice are left to rank.
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    ranked = found.groupBy("query_id").agg(best.alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("place", "b")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def _blocks(assigned: DataFrame, node: str) -> DataFrame:
    """(node, block, ids, vectors): the rows of a node in blocks of about ``BLOCK`` rows, packed."""
    counts = assigned.groupBy(node).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    parts = int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = assigned.join(F.broadcast(counts), node).select(
        F.col(node).alias("node"), F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block"), "id", "vector")
    sorted_ = dealt.repartition(parts, "node", "block").sortWithinPartitions("node", "block", "id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: tuple, ids: list, vectors: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()),
                pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(vectors)], pa.binary())],
                names=["node", "block", "ids", "vectors"])

        now, ids, vectors = None, [], []
        for batch in batches:
            for n, b, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (n, b) != now:
                    if ids:
                        yield out(now, ids, vectors)
                    now, ids, vectors = (n, b), [], []
                ids.append(i)
                vectors.append(v)
        if ids:
            yield out(now, ids, vectors)

    return sorted_.mapInArrow(packed, "node int, block long, ids binary, vectors binary")
