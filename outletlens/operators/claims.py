"""Claim clustering: candidate pairs, verified edges, complete-link clusters, representatives and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from outletlens.functions import text as T
from outletlens.operators.verify import verify
from outletlens.plans.shared import save

CANDIDATE, CONFIDENT, CROSS_SPEAKER = 0.50, 0.50, 0.60


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


#: Claims in a block; a task compares two blocks.
BLOCK = 1024
#: The index is used where its lists' squares hold less than so many times an event's (pairs in several lists are compared once).
WORTH = 2.0


def _packed(claims: DataFrame) -> DataFrame:
    """event_id, idx, v (components as 64-bit floats in one binary) of every claim with a vector."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            vec = batch.column("vec")
            flat, ends = vec.flatten().to_numpy(zero_copy_only=False).astype("<f8"), np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False))
            raw = flat.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("idx"), pa.array([raw[8 * a : 8 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())], ["event_id", "idx", "v"])

    typed = claims.where("vec is not null").select(F.col("event_id").cast("string").alias("event_id"), F.col("idx").cast("long").alias("idx"), "vec")
    return typed.mapInArrow(run, "event_id string, idx long, v binary")


def _matrix(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _prefix(x, order, longest: float, least: float):
    """Which components, in ``order``, stand in each vector's prefix.

    What is left after a prefix is too short to reach ``least`` with any vector
    of length ``longest``, so two vectors that reach it share a component that
    isn't zero in both their prefixes.
    """
    import numpy as np

    y = x[:, order]
    square = y**2
    left = np.sqrt(np.maximum(square[:, ::-1].cumsum(1)[:, ::-1], 0))  # length from each place on
    return (y != 0) & (left * longest >= least - 1e-9)


def _groups(batches, *keys: str):
    """Arrow tables of the rows with the same ``keys``, one after another, from batches sorted by them."""
    import numpy as np
    import pyarrow as pa

    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        cuts = [0, *(np.flatnonzero([a != b for a, b in zip(values, values[1:])]) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if held and values[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _in_event(rows: DataFrame, least: float) -> DataFrame:
    """Pairs that reach ``least`` of packed claims whose events fit in a block, all of an event compared at once."""

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for table in _groups(batches, "event_id"):
            idx, vec = table.column("idx").to_numpy(), _matrix(table.column("v"))
            order = np.argsort(idx, kind="stable")
            idx, vec = idx[order], vec[order]
            sim = np.round(vec @ vec.T, 12)
            r, c = np.nonzero(np.triu(sim >= least, 1))
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array([table.column("event_id")[0].as_py()] * len(r), pa.string()), pa.array(idx[r]), pa.array(idx[c]), pa.array(sim[r, c])], ["event_id", "i", "j", "similarity"])

    return rows.select("event_id", "idx", "v").repartition("event_id").sortWithinPartitions("event_id").mapInArrow(compare, "event_id string, i long, j long, similarity double")


def vector_index(claims: DataFrame, least: float, packed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, lists): exact candidate lists of claims whose inner product can reach ``least``.

    Components are ordered by how few vectors of the event have them. A claim is
    listed (event_id, term) under every component of its prefix; ``mask`` are the
    places of its prefix. Events in which such lists would hold most pairs, as
    with dense vectors, have one list of all claims instead, term -1.
    ``lists`` has event_id, term, m (claims listed) and the event's n.
    """
    rows = save(_packed(claims), "vectors") if packed is None else packed

    def seen(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            events = np.array(batch.column("event_id").to_pylist(), object)
            for event in dict.fromkeys(events):
                x = _matrix(batch.column("v").filter(pa.array(events == event)))
                d = x.shape[1]
                yield pa.RecordBatch.from_pydict({"event_id": [event] * d, "term": pa.array(range(d), pa.int32()), "m": pa.array((x != 0).sum(0)), "n": pa.array([len(x)] * d, pa.int64()), "longest": [float(np.sqrt((x**2).sum(1)).max(initial=0))] * d})

    counted = rows.mapInArrow(seen, "event_id string, term int, m long, n long, longest double").groupBy("event_id", "term").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.max("longest").alias("longest"))
    plans = save(counted.groupBy("event_id").agg(F.max("n").alias("n"), F.max("longest").alias("longest"), F.transform(F.array_sort(F.collect_list(F.struct("m", "term"))), lambda t: t["term"]).alias("order")), "orders")
    if least <= 0:
        plans = plans.withColumn("order", F.array().cast("array<int>"))

    def listed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            events = np.array(batch.column("event_id").to_pylist(), object)
            for event in dict.fromkeys(events):
                own = batch.filter(pa.array(events == event))
                order, longest = np.array(own.column("order")[0].as_py(), np.int64), own.column("longest")[0].as_py()
                if not len(order):
                    continue
                inside = _prefix(_matrix(own.column("v")), order, longest, least)
                r, c = np.nonzero(inside)
                masks = np.packbits(inside, axis=1)
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays([own.column("event_id").take(take), pa.array(c.astype(np.int32)), own.column("idx").take(take), own.column("v").take(take), pa.array([masks[k].tobytes() for k in r], pa.binary())], ["event_id", "term", "idx", "v", "mask"])

    placed = rows.join(plans, "event_id")
    terms = placed.mapInArrow(listed, "event_id string, term int, idx long, v binary, mask binary")
    sizes = terms.groupBy("event_id", "term").agg(F.count(F.lit(1)).alias("m"))
    judged = sizes.groupBy("event_id").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("work"))
    use = plans.select("event_id", "n").join(judged, "event_id", "left").withColumn("indexed", F.coalesce(F.col("work") < WORTH * F.col("n") * F.col("n"), F.lit(least > 0)))
    use = save(use.select("event_id", "n", "indexed"), "choices")
    lists = save(sizes.join(use.where("indexed"), "event_id").select("event_id", "term", "m", "n").unionByName(use.where("not indexed").select("event_id", F.lit(-1).alias("term"), F.col("n").alias("m"), "n")), "lists")
    some = placed.join(use.where("indexed").select("event_id"), "event_id").mapInArrow(listed, "event_id string, term int, idx long, v binary, mask binary")
    rest = rows.join(use.where("not indexed").select("event_id"), "event_id").select("event_id", F.lit(-1).alias("term"), "idx", "v", F.lit(None).cast("binary").alias("mask"))
    return some.unionByName(rest), lists


def compared_share(claims: DataFrame, least: float) -> float:
    """The share of all pairs of an event that stand in a common list, each pair once."""
    postings, lists = vector_index(claims, least)
    all_pairs = lists.select("event_id", "n").distinct().agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0]
    return (_met(postings, lists, None).agg(F.sum("pairs")).first()[0] or 0) / all_pairs if all_pairs else 0.0


def _met(postings: DataFrame, lists: DataFrame, least: float | None) -> DataFrame:
    """Pairs of every list that reach ``least``, or without it the number of pairs that each two blocks compare.

    A list is cut into blocks by hash, and each two blocks are one task's; a pair
    that shares several components is looked at under the first only.
    """
    rows = postings.join(lists.select("event_id", "term", "m"), ["event_id", "term"])
    blocks = F.ceil(F.col("m") / BLOCK)
    cut = rows.withColumn("_b", F.pmod(F.xxhash64("idx"), blocks)).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    both = cut.select("event_id", "term", "idx", "v", "mask", F.least("_b", "_o").alias("p"), F.greatest("_b", "_o").alias("q"), "_b")

    def compare(key, table):
        import numpy as np
        import pyarrow as pa

        event, term, p, q = (k.as_py() for k in key)
        block_of, idx = table.column("_b").to_numpy(), table.column("idx").to_numpy()
        vec = _matrix(table.column("v"))
        x, y = (np.flatnonzero(block_of == k) for k in (p, q))
        first = idx[x][:, None] < idx[y][None, :] if p == q else np.ones((len(x), len(y)), bool)
        if term > 0:
            before = np.unpackbits(np.frombuffer(b"".join(table.column("mask").to_pylist()), np.uint8).reshape(len(idx), -1), axis=1)[:, :term].astype(np.float32)
            first &= before[x] @ before[y].T == 0
        if least is None:
            return pa.table({"event_id": pa.array([event], pa.string()), "pairs": pa.array([int(first.sum())], pa.int64())})
        sim = np.round(vec[x] @ vec[y].T, 12)  # the order of rows must not decide between equal ones
        r, c = np.nonzero((sim >= least) & first)
        a, b = idx[x[r]], idx[y[c]]
        return pa.table({"event_id": pa.array([event] * len(r), pa.string()), "i": pa.array(np.minimum(a, b), pa.int64()), "j": pa.array(np.maximum(a, b), pa.int64()), "similarity": pa.array(sim[r, c])})

    return both.groupBy("event_id", "term", "p", "q").applyInArrow(compare, "event_id string, pairs long" if least is None else "event_id string, i long, j long, similarity double")


def candidate_pairs(claims: DataFrame, least: float = CANDIDATE) -> DataFrame:
    """Pairs i < j of one event whose cosine, to twelve places, reaches ``least``: event_id, i, j, similarity.

    Events of at most a block are compared whole, many of them in a task. In larger
    ones only claims that stand in a common list of ``vector_index`` are compared,
    block by block, so neither a large event nor a frequent component is one task's.
    Claims without a vector have no pairs; idx is unique within an event.
    """
    rows = save(_packed(claims), "vectors")
    large = save(rows.where("event_id is not null").groupBy("event_id").count().where(F.col("count") > BLOCK).select("event_id"), "large-events")
    small = _in_event(rows.where("event_id is not null").join(large, "event_id", "left_anti"), least)
    if large.isEmpty():
        return small
    return small.unionByName(_met(*vector_index(claims, least, rows.join(large, "event_id", "left_semi")), least))


def verified_edges(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs that make the same claim: event_id, i, j, similarity, relation, confidence.

    ``claims`` holds event_id, idx, f (features) and speaker. Claims of
    different speakers must share most of their words besides.
    """
    side = lambda n, k: claims.select(F.col("event_id").cast("string").alias("event_id"), F.col("idx").cast("long").alias(k), F.col("f").alias(f"f{n}"), F.col("speaker").alias(f"s{n}"))
    both = pairs.join(side("a", "i"), ["event_id", "i"]).join(side("b", "j"), ["event_id", "j"])
    judged = verify(both)
    apart = T.speakers_diverge(F.col("sa"), F.col("sb"))
    kept = judged.where(F.col("relation").isin("EQUIVALENT", "COMPATIBLE") & (F.col("confidence") >= CONFIDENT)).where(~apart | (T.jaccard(F.col("fa.content"), F.col("fb.content")) >= CROSS_SPEAKER))
    return kept.select("event_id", "i", "j", "similarity", "relation", "confidence")


def complete_link(nodes: list[int], edges: list[tuple[int, int, float]]) -> list[list[int]]:
    """Greedy clusters in which every two members are joined by an edge; the most similar edges first."""
    joined = {(min(i, j), max(i, j)) for i, j, _ in edges}
    near = lambda a, b: (min(a, b), max(a, b)) in joined
    of: dict[int, set[int]] = {}
    for i, j, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        a, b = of.get(i) or {i}, of.get(j) or {j}
        if a is not b and all(near(x, y) for x in a for y in b):
            merged = a | b
            of |= dict.fromkeys(merged, merged)
    groups = {min(c): sorted(c) for c in (of.get(n) or {n} for n in nodes)}
    return [groups[k] for k in sorted(groups)]


#: Edges of a component that one task may hold.
IN_TASK = 200_000


def clusters(claims: DataFrame, edges: DataFrame, components: DataFrame | None = None, in_task: int = IN_TASK) -> DataFrame:
    """event_id, idx and cluster (its smallest idx) of every claim: ``complete_link``, whatever the size of a component.

    Complete-link clusters never leave an event or a connected component. Events of
    at most ``in_task`` edges are linked in a task each, without a look at their
    components; in larger ones so are components of at most as many, and what is
    larger goes through ``linked_in_rounds`` until what is left of it is small
    enough. Claims without an edge are clusters of their own.
    """
    ids = claims.select(F.col("event_id").cast("string").alias("event_id"), F.col("idx").cast("long").alias("idx"))
    plain = edges.select("event_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "similarity").where("i <> j")
    now = save(plain.groupBy("event_id", "i", "j").agg(F.max("similarity").alias("sim")).select("event_id", F.col("i").alias("a"), F.col("j").alias("b"), F.lit(1).cast("long").alias("n"), F.struct((-F.col("sim")).alias("s"), "i", "j").alias("first")), "links")
    big = save(now.groupBy("event_id").count().where(F.col("count") > in_task).select("event_id"), "large-events")
    whole = _linked(now.join(big, "event_id", "left_anti").withColumn("label", F.lit(0).cast("long")))
    put = lambda merged: ids.join(merged.select("event_id", F.col("node").alias("idx"), "cluster"), ["event_id", "idx"], "left").withColumn("cluster", F.coalesce("cluster", "idx"))
    if big.isEmpty():
        return put(whole)
    now = now.join(big, "event_id", "left_semi")
    comp = components if components is not None else connected(now.select("event_id", F.col("a").alias("i"), F.col("b").alias("j")))
    labelled = now.join(comp.select("event_id", F.col("node").alias("a"), "label"), ["event_id", "a"])
    large = save(labelled.groupBy("event_id", "label").count().where(F.col("count") > in_task).select("event_id", "label"), "large")
    merged = whole.unionByName(_linked(labelled.join(large, ["event_id", "label"], "left_anti")))
    if large.limit(1).count():
        merged = merged.unionByName(linked_in_rounds(labelled.join(large, ["event_id", "label"], "left_semi").drop("label"), in_task))
    return put(merged)


def vector_clusters(claims: DataFrame, least: float) -> DataFrame:
    """event_id, idx, cluster: complete-link clusters of claims (event_id, idx, vec) linked where their cosine reaches ``least``.

    Copies of one unit vector are more like one another than like anything else,
    so the greedy order joins them first and treats them alike after that: the
    first of them goes through pairs and links for all, and no pair of copies is
    made. (Different vectors whose cosine is 1 to twelve places could be joined in another order.)
    Where vectors aren't of length 1 every claim goes through.
    """
    typed = claims.select(F.col("event_id").cast("string").alias("event_id"), F.col("idx").cast("long").alias("idx"), "vec")
    own = typed.withColumn("_n", dot(F.col("vec"), F.col("vec")))
    longest = own.groupBy("event_id").agg(F.max("_n").alias("_most"))
    unit = F.coalesce((F.abs(F.col("_n") - 1) < 1e-6) & (F.col("_most") < 1 + 1e-6), F.lit(False)) & F.lit(least < 1 - 1e-6)
    marked = save(own.join(longest, "event_id").select("event_id", "idx", "vec", F.when(~unit, F.col("idx")).alias("_alone")), "claims")
    firsts = marked.groupBy("event_id", "vec", "_alone").agg(F.min("idx").alias("first"))
    reps = save(firsts.select("event_id", F.col("first").alias("idx"), "vec", "_alone"), "firsts")
    found = clusters(reps, save(candidate_pairs(reps, least), "pairs"))
    named = reps.join(found, ["event_id", "idx"]).select("event_id", F.xxhash64("vec").alias("_h"), F.col("vec").alias("_v"), F.col("_alone").alias("_a"), "cluster")
    m, n = marked.withColumn("_h", F.xxhash64("vec")).alias("m"), named.alias("n")
    same = (F.col("m.event_id") == F.col("n.event_id")) & (F.col("m._h") == F.col("n._h")) & F.col("m.vec").eqNullSafe(F.col("n._v")) & F.col("m._alone").eqNullSafe(F.col("n._a"))
    return m.join(n, same).select("m.event_id", "m.idx", "n.cluster")


def _linked(links: DataFrame) -> DataFrame:
    """(event_id, node, cluster) of the nodes of each component (event_id, label), linked in a task."""

    def link(batches):
        import pyarrow as pa

        for table in _groups(batches, "event_id", "label"):
            a, b, s, i, j = (table.column(c).to_pylist() for c in ("a", "b", "s", "i", "j"))
            order = sorted(range(len(a)), key=lambda k: (s[k], i[k], j[k]))
            e = [(a[k], b[k], -float(n)) for n, k in enumerate(order)]  # all that counts of an edge is its turn
            made = [(m, c[0]) for c in complete_link(sorted({*a, *b}), e) for m in c]
            yield pa.RecordBatch.from_arrays([pa.array([table.column("event_id")[0].as_py()] * len(made), pa.string()), pa.array([m for m, _ in made], pa.int64()), pa.array([c for _, c in made], pa.int64())], ["event_id", "node", "cluster"])

    rows = links.select("event_id", "label", "a", "b", "first.s", "first.i", "first.j").repartition("event_id", "label").sortWithinPartitions("event_id", "label")
    return rows.mapInArrow(link, "event_id string, node long, cluster long")


def linked_in_rounds(links: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(event_id, node, cluster) of all nodes of ``links`` (event_id, a, b, n, first), by merging many clusters at a time.

    Two clusters are linked if all their members are, ``first`` is the first of
    those edges in greedy order. Where a link is the first of both its clusters
    the greedy order would merge them before it touches either, so all such
    links are merged at once. A link between merged clusters that misses a pair
    of members can never be completed and goes. Members of a clique with the same
    neighbours, more like one another than like any neighbour (copies), are one
    cluster from the start. Parts of at most ``in_task`` links end in a task each.
    """
    key = ["event_id", "c"]
    ends = lambda t, *more: t.select("event_id", F.col("a").alias("c"), F.col("b").alias("o"), *more).unionByName(t.select("event_id", F.col("b").alias("c"), F.col("a").alias("o"), *more))
    now = save(links, "links")
    nodes = ends(now).select("event_id", F.col("c").alias("node")).distinct()
    of = save(nodes.withColumn("cluster", F.col("node")), "nodes")
    both = lambda c: [F.sum(F.xxhash64(F.lit(k), c).cast("decimal(38,0)")) for k in (1, 2)]
    around = ends(now).unionByName(nodes.select("event_id", F.col("node").alias("c"), F.col("node").alias("o"))).groupBy(*key).agg(*[h.alias(f"h{k}") for k, h in enumerate(both(F.col("o")))])
    signed = around.select("event_id", "c", F.concat_ws(" ", "h0", "h1").alias("twin"))
    side = lambda n: signed.select("event_id", F.col("c").alias(n), F.col("twin").alias(f"t{n}"))
    seen = now.join(side("a"), ["event_id", "a"]).join(side("b"), ["event_id", "b"])
    near = seen.select("event_id", F.explode(F.array_distinct(F.array("ta", "tb"))).alias("twin"), (F.col("ta") == F.col("tb")).alias("own"), (-F.col("first.s")).alias("sim"))
    good = near.groupBy("event_id", "twin").agg(F.min(F.when(F.col("own"), F.col("sim"))).alias("least"), F.max(F.when(~F.col("own"), F.col("sim"))).alias("most")).where("least > coalesce(most, least - 1)")
    groups = signed.join(good.select("event_id", "twin"), ["event_id", "twin"])
    merges = groups.join(groups.groupBy("event_id", "twin").agg(F.min("c").alias("to")), ["event_id", "twin"]).where("c <> to").select("event_id", "c", "to")
    while True:
        merges = save(merges, "merges")
        to = lambda n: merges.select("event_id", F.col("c").alias(n), F.col("to").alias(f"to_{n}"))  # noqa: E731, B023
        of = save(of.join(to("cluster"), ["event_id", "cluster"], "left").select("event_id", "node", F.coalesce("to_cluster", "cluster").alias("cluster")), "nodes")
        size = lambda n: of.groupBy("event_id", F.col("cluster").alias(n)).agg(F.count(F.lit(1)).alias(f"size_{n}"))  # noqa: E731, B023
        moved = now.join(to("a"), ["event_id", "a"], "left").join(to("b"), ["event_id", "b"], "left").withColumns({"x": F.coalesce("to_a", "a"), "y": F.coalesce("to_b", "b")}).where("x <> y")
        joined = moved.groupBy("event_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        whole = joined.join(size("a"), ["event_id", "a"]).join(size("b"), ["event_id", "b"]).where("n = size_a * size_b").select("event_id", "a", "b", "n", "first")
        now = save(whole, "links")
        if not now.limit(1).count():
            return of
        comp = connected(now.select("event_id", F.col("a").alias("i"), F.col("b").alias("j")))
        labelled = now.join(comp.select("event_id", F.col("node").alias("a"), "label"), ["event_id", "a"])
        large = save(labelled.groupBy("event_id", "label").count().where(F.col("count") > in_task).select("event_id", "label"), "large")
        ended = save(_linked(labelled.join(large, ["event_id", "label"], "left_anti")), "ended").select("event_id", F.col("node").alias("cluster"), F.col("cluster").alias("_to"))
        of = save(of.join(ended, ["event_id", "cluster"], "left").select("event_id", "node", F.coalesce("_to", "cluster").alias("cluster")), "nodes")
        now = save(labelled.join(large, ["event_id", "label"], "left_semi").select("event_id", "a", "b", "n", "first"), "links")
        best = ends(now, "first").groupBy(*key).agg(F.min("first").alias("first"))
        at = lambda n: best.select("event_id", F.col("c").alias(n), F.col("first").alias(f"first_{n}"))  # noqa: E731, B023
        chosen = now.join(at("a"), ["event_id", "a"]).join(at("b"), ["event_id", "b"]).where("first = first_a and first = first_b")
        merges = chosen.select("event_id", F.col("b").alias("c"), F.col("a").alias("to"))


def connected(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(event_id, node, label) of every node of ``edges``; label is the smallest node of its component.

    Each round moves every edge towards the smallest neighbour, first seen from
    the smaller end (large star), then from the larger (small star), until no
    edge changes. Edges that don't settle are an error, never a result.
    """
    mark = lambda t: tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("event_id", "u", "v").cast("decimal(38,0)"))).first())
    key, least = ["event_id", "u"], F.min("v").alias("m")
    now = save(edges.select("event_id", F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v")).where("u <> v").distinct(), "edges")
    was = mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select("event_id", F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(both.groupBy(*key).agg(least), key).select("event_id", F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy(*key).agg(least)
        rest = large.join(low, key).where("v <> m").select("event_id", F.col("v").alias("u"), F.col("m").alias("v"))
        now = save(low.withColumnRenamed("m", "v").unionByName(rest).distinct(), "edges")
        after = mark(now)
        if after == was:
            break
        was = after
    else:
        raise RuntimeError("components didn't settle")
    return now.select("event_id", F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select("event_id", F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def representatives(members: DataFrame) -> DataFrame:
    """event_id, cluster, representative idx: the greatest sum of similarities to its cluster, then the shorter text, then the first.

    ``members`` holds event_id, idx, cluster, text, vec. A claim's sum is its
    product with the cluster's summed vector without its own share, so no pair
    is made; sums are compared to nine places. Claims without a vector have sum 0.
    """
    key = ["event_id", "cluster"]
    parts = members.select(*key, F.posexplode("vec").alias("d", "x")).groupBy(*key, "d").agg(F.sum(F.col("x").cast("double")).alias("x"))
    total = parts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda t: t["x"]).alias("_total"))
    own = dot(F.col("vec"), F.col("_total")) - dot(F.col("vec"), F.col("vec"))
    scored = members.join(total, key, "left").withColumn("_sum", F.round(F.coalesce(own, F.lit(0.0)), 9) + 0.0)
    first = F.min(F.struct((-F.col("_sum")).alias("s"), F.length("text").alias("n"), "idx"))
    return scored.groupBy(*key).agg(first.alias("_first")).select(*key, F.col("_first.idx").alias("representative"))


def coherent(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``members`` (event_id, idx, cluster) as they are, or an error where a cluster misses an edge between two of its claims.

    Complete-link clusters never do, so pruning incoherent members has nothing to do; this makes sure of it.
    """
    side = lambda n: members.select("event_id", F.col("idx").alias(n), F.col("cluster").alias(f"c{n}"))
    inner = edges.select("event_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct().join(side("i"), ["event_id", "i"]).join(side("j"), ["event_id", "j"]).where("ci = cj and i < j")
    there = inner.groupBy("event_id", F.col("ci").alias("cluster")).agg(F.count(F.lit(1)).alias("_edges"))
    sizes = members.groupBy("event_id", "cluster").agg(F.count(F.lit(1)).alias("_n")).join(there, ["event_id", "cluster"], "left")
    whole = F.when(F.coalesce("_edges", F.lit(0)) == F.expr("_n * (_n - 1) / 2"), F.col("cluster")).otherwise(F.raise_error(F.lit("a cluster misses an edge")).cast("long"))
    judged = sizes.select("event_id", whole.alias("cluster"))
    return members.join(judged, ["event_id", "cluster"]).select(*members.columns)


def coverage(members: DataFrame, outlets: DataFrame) -> DataFrame:
    """Coverage of each cluster: members (event_id, cluster, article_id) against outlets (event_id, article_id)."""
    total = outlets.groupBy("event_id").agg(F.countDistinct("article_id").alias("total_articles"), F.array_sort(F.collect_set("article_id")).alias("all_ids"))
    count = members.groupBy("event_id", "cluster").agg(F.array_sort(F.collect_set("article_id")).alias("article_ids"), F.count(F.lit(1)).alias("n_sources"))
    return count.join(total, "event_id").select(
        "event_id", "cluster", "article_ids", "n_sources", F.size("article_ids").alias("coverage_count"), "total_articles", F.round(F.size("article_ids") / F.col("total_articles"), 4).alias("coverage_ratio"), F.array_except("all_ids", "article_ids").alias("absent_ids")
    )


def evidence(members: DataFrame, reps: DataFrame) -> DataFrame:
    """The best similarity of each source sentence to its cluster's representative, between 0 and 1.

    ``members`` holds event_id, idx, cluster, article_id, sentence, vec.
    """
    key = ["event_id", "cluster"]
    chosen = members.join(reps.select("event_id", F.col("representative").alias("idx")), ["event_id", "idx"]).select(*key, F.col("idx").alias("_rep"), F.col("vec").alias("_vec"))
    near = members.join(chosen, key)
    own = F.when(F.col("idx") == F.col("_rep"), 1.0).otherwise(F.coalesce(F.round(dot(F.col("vec"), F.col("_vec")), 12), F.lit(0.0)))
    return near.groupBy(*key, "article_id", "sentence").agg(F.round(F.least(F.greatest(F.max(own), F.lit(0.0)), F.lit(1.0)), 4).alias("similarity"))


def numbered(clusters_: DataFrame) -> DataFrame:
    """Cluster names C01, C02, ... of each event by coverage, then by first member."""
    n = F.row_number().over(W.partitionBy("event_id").orderBy(F.desc("coverage_count"), "cluster"))
    return clusters_.withColumn("cluster_id", F.format_string("C%02d", n))


def category(ratio: Column, widely: float = 0.80, commonly: float = 0.50, minority: float = 0.20) -> Column:
    """How common a claim is among the outlets of its event."""
    return F.when(ratio >= widely, "Widely shared").when(ratio >= commonly, "Commonly reported").when(ratio >= minority, "Minority coverage").otherwise("Rare claim")


def display_category(ratio: Column, count: Column) -> Column:
    """``category`` as reports show it: a claim of one outlet is named so."""
    return F.when(count == 1, "Single-outlet").otherwise(category(ratio))


def coverage_summary(consensus: DataFrame) -> DataFrame:
    """How many claims of each event all, most and single outlets report."""
    count, ratio, total = F.col("coverage_count"), F.col("coverage_ratio"), F.col("total_articles")
    return consensus.groupBy("event_id").agg(
        F.count_if(count == total).alias("n_all"), F.count_if((ratio >= 0.5) & (count > 1) & (count < total)).alias("n_majority"), F.count_if(count == 1).alias("n_single"), F.count(F.lit(1)).alias("n_claims")
    )
