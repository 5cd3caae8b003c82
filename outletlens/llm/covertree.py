"""Exact top-k inner products by dual-tree search over cover trees.

Data and queries are dealt into blocks around a bounded number of pivots, so a
block is small and close together. Every block of queries is first searched in
the block of data that promises most; after that only those pairs of blocks are
brought together whose balls allow a score that reaches the worst k-th best one
found for the block's queries. Such a pair builds a cover tree of its queries and
one of its data: a node's points lie within its covering radius of its centre,
children's centres are further apart than their radius. A pair of nodes is
dropped when no inner product between balls of those radii can reach the worst
k-th best score of the query node's queries. Points that would be children of
their own stay in a leaf below their node, where each is held against the query
node's ball; what is left is compared as whole matrices. The k best of all pairs
of blocks are merged by rank.

How much is dropped lies in the data: nothing where all vectors are about as far
from each other as from any centre.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from outletlens.llm import common

#: Ratio of a node's covering radius to its children's, and the most points that need no further split.
SHRINK, LEAF = 1.5, 32
#: Parts of so few points become no node; where none of so many points is near another, no part would have more.
ALONE, PROBE = 4, 64
#: Share of the probed points without a neighbour from which on a node isn't split: nearly all parts would be single points.
LONELY = 0.875
PIVOTS = 64
DATA_BLOCK, QUERY_BLOCK = 4096, 2048
LAST = np.iinfo(np.int64).max


class Tree:
    """A node: ``points`` (row numbers) in a leaf, else ``children``; ``centre`` and ``radius`` cover all below."""

    __slots__ = ("centre", "children", "norm", "points", "radius", "size")

    def __init__(self, centre: np.ndarray, radius: float, points: np.ndarray | None, children: list[Tree], size: int) -> None:
        self.centre, self.radius, self.points, self.children, self.size = centre, radius, points, children, size
        self.norm = float(np.sqrt(centre @ centre))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def build(x: np.ndarray, leaf: int = LEAF, alone_of: int = ALONE) -> Tree:
    """The cover tree of the rows of ``x``; up to ``leaf`` points are a leaf, and a node's points in parts of up to ``alone_of`` are one with its ball."""
    start = _distances(x, x[0])
    root = Tree(x[0], float(start.max()), None, [], len(x))
    todo = [(root, np.arange(len(x)), start)]
    while todo:
        node, rows, d = todo.pop()
        if len(rows) <= leaf or node.radius == 0:
            node.points = rows
            continue
        cover = node.radius / SHRINK
        alone, left = [], rows
        centre, far = node.centre, d
        if len(rows) > PROBE:
            some = x[rows[:: len(rows) // PROBE][:PROBE]]
            near = np.sqrt(np.maximum(((some[:, None, :] - some[None]) ** 2).sum(axis=2), 0)) <= cover
            if (near.sum(axis=1) == 1).mean() >= LONELY:
                alone, left = [rows], rows[:0]
        while len(left):
            near = far <= cover
            part = left[near]
            if len(part) > alone_of:
                child = Tree(centre, float(far[near].max()), None, [], len(part))
                node.children.append(child)
                todo.append((child, part, far[near]))
            elif len(part):
                alone.append(part)
            left = left[~near]
            if len(left):
                centre = x[left[0]]
                far = _distances(x[left], centre)
        if alone:
            points = np.concatenate(alone)
            if not node.children:
                node.points = points
            else:
                node.children.append(Tree(node.centre, node.radius, points, [], len(points)))
    return root


class Best:
    """The k best (score, smallest id) of each query so far."""

    def __init__(self, n: int, k: int, kth: np.ndarray | None = None) -> None:
        self.k, self.scored = k, 0
        self.score, self.id, self.kth = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n, np.full(n, -np.inf) if kth is None else kth.copy()

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Offer ``scores`` (queries, ids), where ``own`` marks a query's own row."""
        hit = (scores >= self.kth[queries][:, None]) & ~own
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            q, at = int(queries[i]), hit[i]
            s, d = np.concatenate([self.score[q], scores[i][at].astype(np.int64)]), np.concatenate([self.id[q], ids[at]])
            order = np.lexsort((d, -s))[: self.k]
            self.score[q], self.id[q] = s[order], d[order]
            if len(order) == self.k:
                self.kth[q] = max(self.kth[q], s[order[-1]])


def _bounds(q: Tree, nodes: list[Tree]) -> np.ndarray:
    """The largest inner product that each of ``nodes`` could have with a query below ``q``; a little more, for rounding."""
    c, r, n = np.stack([x.centre for x in nodes]), np.array([x.radius for x in nodes]), np.array([x.norm for x in nodes])
    top = c @ q.centre + q.radius * n + r * q.norm + r * q.radius
    return top + 1e-9 * (np.abs(top) + 1)


def search(queries: np.ndarray, data: np.ndarray, k: int, ids: np.ndarray, query_row: np.ndarray, row: np.ndarray, kth: np.ndarray | None = None) -> Best:
    """The ``k`` best rows of ``data`` for each of ``queries`` by inner product, ties to smaller ``ids``, its own row left out.

    ``kth`` are scores that results must reach. ``Best.scored`` counts the pairs
    of points that were looked at.
    """
    best, exact = Best(len(queries), k, kth), _product(queries, data)
    if not len(queries) or not len(data):
        return best
    x = data.astype(float)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    qt, dt = build(queries.astype(float), 1, 0), build(x)
    below: dict[int, np.ndarray] = {}

    def members(t: Tree) -> np.ndarray:
        if id(t) not in below:
            parts, todo = [], [t]
            while todo:
                u = todo.pop()
                if u.points is not None:
                    parts.append(u.points)
                todo += u.children
            below[id(t)] = np.concatenate(parts)
        return below[id(t)]

    # the pair that allows the highest score first, so every query meets its best points before others
    number = itertools.count()
    todo = [(-float(_bounds(qt, [dt])[0]), next(number), qt, dt)]
    while todo:
        bound, _, q, d = heapq.heappop(todo)
        worst = best.kth[members(q)].min()
        if -bound < worst:
            continue
        if q.points is not None and d.points is not None:
            top = x[d.points] @ q.centre + q.radius * norm[d.points]
            points = d.points[top + 1e-9 * (np.abs(top) + 1) >= worst]
            best.scored += max(len(d.points), len(q.points) * len(points))
            if len(points):
                best.add(q.points, exact(q.points, points), ids[points], query_row[q.points][:, None] == row[points][None, :])
        elif d.points is None and (q.points is not None or d.radius >= q.radius):
            for c, top in zip(d.children, _bounds(q, d.children).tolist(), strict=True):
                if top >= worst:
                    heapq.heappush(todo, (-top, next(number), q, c))
        else:
            for c in q.children:
                heapq.heappush(todo, (-float(_bounds(c, [d])[0]), next(number), c, d))
    return best


def _product(a: np.ndarray, b: np.ndarray):
    """A function from row numbers of both to exact integer products; what 64 bits can't hold is the largest or smallest number that they can."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        x, y = a.astype(float), b.astype(float)
        return lambda i, j: x[i] @ y[j].T
    if most < 1 << 62:
        return lambda i, j: a[i] @ b[j].T
    return lambda i, j: np.clip(a[i].astype(object) @ b[j].T.astype(object), -LAST - 1, LAST).astype(np.int64)


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def _chained(x: np.ndarray) -> np.ndarray:
    """Rows in an order in which each is followed by the nearest that is left, so that neighbouring cells make a close block."""
    order, left = [0], set(range(1, len(x)))
    while left:
        rest = np.array(sorted(left))
        order.append(int(rest[_distances(x[rest], x[order[-1]]).argmin()]))
        left.discard(order[-1])
    return x[order]


def vectors(table: DataFrame) -> DataFrame:
    """row, vec_id and integer components floor(256 x) of all usable vectors, saved.

    Null vectors and those with a null or non-finite component take no part;
    shorter vectors count as padded with zeros.
    """
    e = F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("embedding").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = common.unique_columns(table, "vec_id", "embedding").where(F.coalesce(good, F.lit(False)))
    return common.save(rows.select("vec_id", F.transform(e, lambda x: F.floor(x * 256).cast("long")).alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")


def top_k(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of each row whose vec_id is divisible by ``every``.

    Ties go to the smaller vec_id (a null one last). Rows are told apart by
    place, so rows that repeat a vec_id are queries and candidates of their own.
    Fewer than ``k`` candidates are all returned; an empty table gives no rows.
    """
    spark = table.sparkSession
    data = vectors(table)
    pivots = data.orderBy(F.xxhash64("row")).limit(PIVOTS).collect()
    if not pivots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = data.agg(F.max(F.size("v"))).first()[0]
    centres = _chained(_matrix([r["v"] for r in pivots], width).astype(float))

    def nearest(batches):
        import pyarrow as pa

        half = (centres * centres).sum(axis=1) / 2
        for batch in batches:
            whole = _matrix(batch.column("v").to_pylist(), width)
            x = whole.astype(float)
            cell = (x @ centres.T - half).argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array([r.tobytes() for r in whole], pa.binary()), pa.array(cell, pa.int32())], schema=common.arrow_schema("row long, vec_id long, v binary, cell int"))

    placed = common.save(data.select("row", "vec_id", "v").mapInArrow(nearest, "row long, vec_id long, v binary, cell int"), "cells")
    asked = placed.where(F.col("vec_id") % every == 0)

    def blocks(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
        """Rows with their block: neighbouring cells together up to ``most`` rows, a larger cell dealt by hash."""
        counts = sorted((r["cell"], r["n"]) for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())  # at most PIVOTS
        first, parts, now, room = [], [], -1, 0
        for cell, n in counts:
            need = -(-n // most)
            if need > 1 or n > room:
                now, room = (now + 1, most - n) if need == 1 else (now + 1, 0)
                first.append((cell, now, need))
                now += need - 1
            else:
                room -= n
                first.append((cell, now, 1))
        pick = F.create_map(*[F.lit(x) for c, b, _ in first for x in (c, b)]) if first else F.create_map(F.lit(-1), F.lit(0))
        deal = F.create_map(*[F.lit(x) for c, _, p in first for x in (c, p)]) if first else F.create_map(F.lit(-1), F.lit(1))
        return rows.withColumn("block", (pick[F.col("cell")] + F.pmod(F.xxhash64("row"), deal[F.col("cell")])).cast("int")), now + 1

    d, n_d = blocks(placed, DATA_BLOCK)
    q, n_q = blocks(asked, QUERY_BLOCK)
    if not n_q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def ball(key, rows):
        import pyarrow as pa

        x = _back(rows.column("v"), width).astype(float)
        centre = x.mean(axis=0)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([centre.tobytes()], pa.binary()), pa.array([float(_distances(x, centre).max())])], schema=common.arrow_schema(BALL))

    def bounds(batches):
        import pyarrow as pa

        for batch in batches:
            c, e = (np.frombuffer(b"".join(batch.column(n).to_pylist()), float).reshape(-1, width) for n in ("centre", "data_centre"))
            r, s = (batch.column(n).to_numpy() for n in ("radius", "data_radius"))
            top = np.einsum("ij,ij->i", c, e) + r * np.sqrt(np.einsum("ij,ij->i", e, e)) + s * np.sqrt(np.einsum("ij,ij->i", c, c)) + r * s
            yield pa.RecordBatch.from_arrays([batch.column("qb"), batch.column("db"), pa.array(top + 1e-9 * (np.abs(top) + 1))], schema=common.arrow_schema("qb int, db int, bound double"))

    balls = lambda rows, name: rows.select("block", "v").groupBy("block").applyInArrow(ball, BALL).withColumnRenamed("block", name)
    of_data = balls(d, "db").withColumnsRenamed({"centre": "data_centre", "radius": "data_radius"}).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))  # a row for each two blocks, of their balls alone
    pairs = common.save(of_data.join(balls(q, "qb"), "qb").select("qb", "db", "centre", "radius", "data_centre", "data_radius").mapInArrow(bounds, "qb int, db int, bound double"), "block-pairs")
    left = q.select(*[F.col(a).alias(b) for a, b in (("row", "query_row"), ("vec_id", "query_id"), ("v", "query"), ("block", "qb"))])
    right = d.select("row", "vec_id", "v", F.col("block").alias("db"))

    def pair(queries, rows):
        import pyarrow as pa

        ids = np.array([LAST if i is None else i for i in rows.column("vec_id").to_pylist()], np.int64)
        a, b = _back(queries.column("query"), width), _back(rows.column("v"), width)
        query_row, row = queries.column("query_row").to_numpy(), rows.column("row").to_numpy()
        found = search(a, b, k, ids, query_row, row, queries.column("kth").to_numpy(zero_copy_only=False) if len(a) else None)
        n = [len(s) for s in found.score]
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        got = flat(found.id)
        return pa.Table.from_arrays([pa.array(np.repeat(query_row, n)), pa.array(np.repeat(queries.column("query_id").to_numpy(), n)), pa.array(got, mask=got == LAST), pa.array(flat(found.score))], schema=common.arrow_schema(FOUND))

    def searched(asked, of):
        """Results of the pairs of blocks ``of`` for queries with the score that they must reach."""
        also = of.select(F.col("qb").alias("q_block"), F.col("db").alias("d_block"))  # both sides read it, so their columns need names of their own
        theirs = right.join(also, right["db"] == also["d_block"]).select(*[F.col(c).alias(c) for c in ("row", "vec_id", "v", "q_block", "d_block")])
        return asked.join(of, "qb").groupBy("qb", "db").cogroup(theirs.groupBy("q_block", "d_block")).applyInArrow(pair, FOUND)

    first = common.save(pairs.groupBy("qb").agg(F.max_by("db", F.struct("bound", "db")).alias("db")), "first-pairs")
    found = common.save(searched(left.withColumn("kth", F.lit(float("-inf"))), first), "first-found")
    reached = found.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("kth"))
    asking = common.save(left.join(reached, "query_row", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf")))), "asking")
    worst = asking.groupBy("qb").agg(F.min("kth").alias("worst"))
    more = common.save(pairs.join(first, ["qb", "db"], "left_anti").join(worst, "qb").where("bound >= worst").select("qb", "db"), "more-pairs")
    everything = found.unionByName(searched(asking, more))
    ranked = everything.withColumn("rank", F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


BALL = "block int, centre binary, radius double"
FOUND = "query_row long, query_id long, vec_id long, score long"


def _back(column, width: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.int64).reshape(-1, width)
