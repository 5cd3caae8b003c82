"""Exact integer k-means by partial-distance search.

Vectors are quantised to integers once and written. In each round a task goes
through its vectors block by block: squared differences are added up over a
few dimensions at a time, those of the highest variance first, and a centroid
is given up for a vector as soon as its sum is strictly above the vector's
best whole distance; what is never given up is summed over all dimensions. A
task sends one row for each centroid and dimension, so only sums travel.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletlens.llm import common

#: Dimensions that are added before centroids are looked at again.
STRIDE = 8
#: Integers up to this are exact in sums of 64 squared differences.
LARGEST = 1 << 27
#: Vectors that a task holds at a time.
BLOCK = 4096


def quantised(vectors: DataFrame, dims: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v): ``floor(scale * x)`` of vectors with exactly ``dims`` components, none null or non-finite.

    ``v`` holds little-endian 32-bit integers. Components beyond 2^27 after
    scaling have no exact squared distances in 64 bits; they raise an error.
    """
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))
    kept = vectors.select("vec_id", "embedding").where((F.size("embedding") == dims) & F.forall("embedding", good))
    fits = F.forall("embedding", lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) <= LARGEST)
    told = F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))
    ints = kept.select("vec_id", F.when(fits, F.transform("embedding", lambda x: whole(x).cast("int"))).otherwise(told.cast("array<int>")).alias("v"))

    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([flat[i : i + dims].tobytes() for i in range(0, len(flat), dims)], pa.binary())], ["vec_id", "v"])

    return ints.mapInArrow(packed, f"vec_id {dict(ints.dtypes)['vec_id']}, v binary")


def nearest(block: np.ndarray, centroids: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number), its squared distance, and how many squared differences were made.

    Rows and centroids hold their dimensions in the order of the search. The
    centroid that is best over the first ``stride`` dimensions is finished
    first; another one is dropped for the rows where its partial sum is
    strictly above the best whole distance, and ties survive to be judged by number.
    """
    n, dims = block.shape
    first = ((block[:, None, :stride] - centroids[None, :, :stride]) ** 2).sum(2)
    label, made = first.argmin(1), first.size * min(stride, dims)
    best = first[np.arange(n), label] + ((block[:, stride:] - centroids[label, stride:]) ** 2).sum(1)
    made += n * max(dims - stride, 0)
    begun = label.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((begun != c) & (first[:, c] <= best))
        part = first[rows, c]
        for at in range(stride, dims, stride):
            if not len(rows):
                break
            part = part + ((block[rows, at : at + stride] - centroids[c, at : at + stride]) ** 2).sum(1)
            made += len(rows) * min(stride, dims - at)
            on = part <= best[rows]
            rows, part = rows[on], part[on]
        closer = (part < best[rows]) | ((part == best[rows]) & (c < label[rows]))
        rows, part = rows[closer], part[closer]
        label[rows], best[rows] = c, part
    return label, best, made


def _blocks(batches, order: np.ndarray):
    """(vec_ids, integers in the order of the search) of bounded size."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(at, BLOCK)
            flat = np.frombuffer(b"".join(piece.column("v").to_pylist()), "<i4").astype(np.int64)
            yield piece.column("vec_id"), flat.reshape(piece.num_rows, -1)[:, order]


def _sums(points: DataFrame, centroids: np.ndarray, order: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Rows and component sums of each non-empty centroid's vectors."""
    moved = centroids[:, order]

    def part(batches):
        import pyarrow as pa

        count, total = np.zeros(len(moved), np.int64), np.zeros(moved.shape, np.int64)
        for _, block in _blocks(batches, order):
            label, _, _ = nearest(block, moved)
            count += np.bincount(label, minlength=len(moved))
            for c in np.unique(label):
                total[c] += block[label == c].sum(0)
        there = np.flatnonzero(count)
        k, dims = len(there), total.shape[1] + 1
        values = np.concatenate([count[there, None], total[there]], 1)
        columns = [np.repeat(there, dims).astype(np.int32), np.tile(np.arange(dims, dtype=np.int32), k), values.reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["cluster", "place", "value"])

    rows = points.mapInArrow(part, "cluster int, place int, value long").groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # one row for a centroid and dimension
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r.cluster, {})[r.place] = int(r.value)
    back = np.argsort(order)
    return {c: (x[0], [x[int(p) + 1] for p in back]) for c, x in out.items()}


def search_order(points: DataFrame, dims: int = 64) -> np.ndarray:
    """Dimensions by falling variance of the vectors, ties by number."""

    def part(batches):
        import pyarrow as pa

        n, one, two = 0, [0] * dims, [0] * dims
        for _, block in _blocks(batches, np.arange(dims)):
            n += len(block)
            one = [a + int(b) for a, b in zip(one, block.sum(0), strict=True)]
            two = [a + int(b) for a, b in zip(two, (block.astype(np.float64) ** 2).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([float(n)] * dims), pa.array(map(float, one)), pa.array(map(float, two))], ["d", "n", "one", "two"])

    rows = points.mapInArrow(part, "d int, n double, one double, two double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).collect()
    spread = {r.d: r.two / r.n - (r.one / r.n) ** 2 for r in rows if r.n}
    return np.array(sorted(range(dims), key=lambda d: (-spread.get(d, 0.0), d)))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", dims: int = 64, scale: int = 1024) -> DataFrame:
    """Vectors with their cluster, squared distance and inertias: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids begin as the ``k`` vectors with the smallest sha256 of
    ``seed:vec_id``; equal hashes (repeated vec_ids) go by components, a null
    vec_id has no hash and comes last. With fewer than ``k`` vectors there are
    fewer centroids. A round that changes no centroid is the last that needs
    to be run: all further ones would give the same. Null vectors, vectors of
    another length and those with a null or non-finite component aren't rows
    of the result; repeated rows are rows of their own; an empty table gives none.
    """
    points = common.save(quantised(vectors, dims, scale), "vectors")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    begin = points.withColumn("_mark", mark).orderBy(F.asc_nulls_last("_mark"), F.hex("v")).limit(k).collect()
    begin.sort(key=lambda r: (r._mark is None, r._mark, np.frombuffer(r.v, "<i4").tolist()))
    centroids = np.array([np.frombuffer(r.v, "<i4") for r in begin], np.int64).reshape(-1, dims)
    order = search_order(points, dims)
    for _ in range(rounds if len(centroids) else 0):
        after = centroids.copy()
        for c, (n, total) in _sums(points, centroids, order).items():
            after[c] = [x // n for x in total]
        if (after == centroids).all():
            break
        centroids = after
    moved = centroids[:, order]

    def assigned(batches):
        import pyarrow as pa

        for ids, block in _blocks(batches, order):
            label, best, _ = nearest(block, moved)
            yield pa.RecordBatch.from_arrays([ids, pa.array(label.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    found = common.save(points.mapInArrow(assigned, f"vec_id {dict(points.dtypes)['vec_id']}, cluster int, distance long"), "assigned")
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = F.col("cluster") + 1
    return found.select(
        "vec_id", "cluster", "distance", F.element_at(F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(max(len(names), 1))]), of).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.element_at(F.array(*map(F.lit, names or [""])), of).alias("centroid_sha256"),
    )
