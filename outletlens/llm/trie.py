"""Prefix trie of conversations, its subtree totals by leaf-peeling message passing.

A node is a distinct sequence of first turns, known by its depth and a 128-bit
sum of hashes of (place, turn), so the nodes of a conversation are running sums
and need no walk; an aggregate tells when two different sequences share a sum.
Nodes with the same smallest member follow one another down that conversation:
such a run is peeled as one. Each run holds a counter of the runs below it that
haven't finished; a finished run sends its totals to its parent, until only
the root's run is left. Totals of the nodes inside a run are sums from its end.

Long conversations are cut into pieces wherever something is summed along
them; large families of copies travel as counts and pre-aggregated chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from outletlens.llm import common

#: Turns that are summed in one piece.
PIECE = 1024
#: Conversations whose ids are joined to one chunk of a digest.
CHUNK = 1024
#: The four 32-bit parts of a node's sum.
SUMS = ["s1", "s2", "s3", "s4"]
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _halves(seed: int, *of: Column) -> list[Column]:
    h = F.xxhash64(F.lit(seed), *of)
    return [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]


def running(df: DataFrame, group: list[str], at: Column, values: list[str], piece: int = PIECE) -> DataFrame:
    """``df`` with ``values`` replaced by their sums over the rows of ``group`` up to and with this one, by ``at``, which is unique there.

    A group is cut into pieces of ``piece`` places; only pieces after a group's first need the sums before them.
    """
    rows = df.withColumn("_at", at).withColumn("_piece", F.floor(F.col("_at") / piece))
    inside = W.partitionBy(*group, "_piece").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "_piece").agg(*[F.sum(v).alias(v) for v in values])
    offsets = totals.select(*group, "_piece", *[F.sum(v).over(before).alias(f"_{v}") for v in values]).where(F.col(f"_{values[0]}").isNotNull())
    summed = rows.withColumns({v: F.sum(v).over(inside) for v in values}).join(offsets, [*group, "_piece"], "left")
    return summed.withColumns({v: F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0)) for v in values}).select(*df.columns)


def ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, k, t1, t2, n) of every turn, k its place from 1, and (conv_id, turns) of every conversation.

    Turns go by ``turn`` (null first), then role and text by code point; equal
    rows are interchangeable. Rows are ranged over the whole table, so that one
    long conversation is spread over tasks, and numbered from counts of
    each task. t1 and t2 are hashes of the turn, n its text's code points.
    """
    spark = conversations.sparkSession
    rows = conversations.where("conv_id is not null").select("conv_id", F.col("turn").alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    first = F.asc_nulls_first("turn")
    ranged = rows.repartitionByRange(common.parts(spark), "conv_id", first, F.substring("role", 1, 32), F.substring("text", 1, 64)).sortWithinPartitions("conv_id", first, "role", "text")
    hashes = {f"t{k}": F.xxhash64(F.lit(k), F.octet_length("role"), "role", "text") for k in (1, 2)}
    placed = common.save(ranged.select("conv_id", *[h.alias(c) for c, h in hashes.items()], F.char_length("text").cast("long").alias("n"), F.monotonically_increasing_id().alias("place")), "turns")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    counts = placed.groupBy("conv_id", "part").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("conv_id", "part", (before - F.col("low") + 1).alias("shift"))
    turns = placed.join(begins, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("shift")).alias("k"), "t1", "t2", "n")
    return turns, counts.groupBy("conv_id").agg(F.sum("rows").alias("turns"))


def rebuilt(conversations: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, depth, t1, t2, n, last): the rebuilt conversations' turns and, at depth 0, their roots; ``last`` marks a conversation's end.

    Conversation c takes the first h turns of conversation c - c % ``block``
    (h: unsigned crc32 of c in decimal, modulo ``most``), then its own after its first h.
    """
    turns, convs = ordered(conversations)
    turns, convs = common.save(turns, "numbered"), common.save(convs, "conversations")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = convs.select(F.col("conv_id").alias("base"), F.least("turns", F.lit(most)).alias("there"))
    plans = convs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % block}).join(base, "base", "left")
    plans = plans.withColumn("head", F.least("h", F.coalesce(F.col("there"), F.lit(0)))).withColumn("length", F.col("head") + F.greatest(F.lit(0), F.col("turns") - F.col("h")))
    plans = common.save(plans.select("conv_id", "base", "h", "head", "length"), "plans")
    roots = plans.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "n")], (F.col("length") == 0).alias("last"))
    begins = turns.where(F.col("k") < most).select(F.col("conv_id").alias("base"), "k", "t1", "t2", "n")
    heads = plans.join(begins, "base").where("k <= head").select("conv_id", F.col("k").alias("depth"), "t1", "t2", "n", (F.col("k") == F.col("length")).alias("last"))
    mine = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    short = plans.select("conv_id", (F.col("head") - F.col("h")).alias("less"), "length").join(turns.where(F.col("k") > mine), "conv_id")
    tails = short.select("conv_id", (F.col("k") + F.col("less")).alias("depth"), "t1", "t2", "n", (F.col("k") + F.col("less") == F.col("length")).alias("last"))
    return roots.unionByName(heads).unionByName(tails)


def members(turns: DataFrame) -> DataFrame:
    """Rebuilt turns with the sums that name their nodes (s1..s4) and their parents' (p1..p4)."""
    parts = [*_halves(3, F.col("depth"), F.col("t1"), F.col("t2")), *_halves(4, F.col("depth"), F.col("t2"), F.col("t1"))]
    own = turns.withColumns({f"v{k}": F.when(F.col("depth") > 0, p).otherwise(0) for k, p in enumerate(parts, 1)}).withColumns({s: F.col(f"v{s[1]}") for s in SUMS})
    summed = running(own, ["conv_id"], F.col("depth"), SUMS)
    return summed.withColumns({f"p{k}": F.col(f"s{k}") - F.col(f"v{k}") for k in range(1, 5)}).drop("v1", "v2", "v3", "v4")


def node_table(rows: DataFrame) -> DataFrame:
    """A row for each node: depth, sums, parent's sums, conv_id, n_convs, own (its saved tokens alone), n_children.

    Raises an error where two sequences share a sum: their turns or their parents differ.
    """
    key = ["depth", *SUMS]
    seen = F.xxhash64("t1", "t2", "p1", "p2", "p3", "p4")
    nodes = rows.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("n"), F.min(seen).alias("_a"), F.max(seen).alias("_b"), *[F.min(f"p{k}").alias(f"p{k}") for k in range(1, 5)]
    )
    nodes = nodes.withColumn("own", F.when(F.col("_a") == F.col("_b"), (F.col("n_convs") - 1) * F.col("n")).otherwise(F.raise_error(F.lit("two prefixes share a hash")).cast("long"))).drop("n", "_a", "_b")
    nodes = common.save(nodes, "trie-nodes")
    up = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(f"p{k}").alias(f"s{k}") for k in range(1, 5)]).agg(F.count(F.lit(1)).alias("n_children"))
    return common.save(nodes.join(up, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")


def runs(nodes: DataFrame) -> DataFrame:
    """(run, top, parent, waits, leaves, saved): nodes of one smallest member, the run that they hang from, runs below it, own totals."""
    tops = nodes.groupBy(F.col("conv_id").alias("run")).agg(
        F.min("depth").alias("top"), F.sum("own").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves"), F.min_by(F.struct("p1", "p2", "p3", "p4"), "depth").alias("_up")
    )
    above = nodes.where("n_children > 0").select(F.col("depth").alias("_depth"), *[F.col(s).alias(f"_{s}") for s in SUMS], F.col("conv_id").alias("parent"))
    on = (F.col("top") - 1 == F.col("_depth")) & (F.col("_up.p1") == F.col("_s1")) & (F.col("_up.p2") == F.col("_s2")) & (F.col("_up.p3") == F.col("_s3")) & (F.col("_up.p4") == F.col("_s4"))
    tops = common.save(tops.where("top > 0").join(above, on).select("run", "top", "parent", "leaves", "saved").unionByName(tops.where("top = 0").select("run", "top", F.lit(None).cast("long").alias("parent"), "leaves", "saved")), "runs")
    below = tops.where("parent is not null").groupBy(F.col("parent").alias("run")).agg(F.count(F.lit(1)).alias("waits"))
    return tops.join(below, "run", "left").withColumn("waits", F.coalesce("waits", F.lit(0)))


def peeled(waiting: DataFrame) -> DataFrame:
    """(run, top, parent, leaves, saved) of every run, with the totals of all that hangs below it.

    A round sends the totals of the runs whose counter is 0 to their parents
    and takes them out; each is written. It ends when only the root was left.
    """
    now, finished = common.save(waiting, "peel"), []
    while True:
        left, ready = now.agg(F.count(F.lit(1)), F.count_if(F.col("waits") == 0)).first()
        if not left:
            break
        if not ready:
            raise RuntimeError("no run is finished, yet some are left")
        done = now.where("waits = 0")
        finished.append(done.drop("waits"))
        if ready == left:
            break
        sent = done.groupBy(F.col("parent").alias("run")).agg(F.count(F.lit(1)).alias("_came"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        kept = now.where("waits > 0").join(sent, "run", "left")
        more = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
        now = common.save(kept.select("run", "top", "parent", more("leaves", "_leaves").alias("leaves"), more("saved", "_saved").alias("saved"), (F.col("waits") - F.coalesce(F.col("_came"), F.lit(0))).alias("waits")), "peel")
    out = finished[0] if finished else now.drop("waits")
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def end_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node, ascending, joined by commas: depth, sums, ends_sha256.

    Ids are ranged over tasks and joined to chunks there; a node's chunks then pass one hash.
    """
    key = ["depth", *SUMS]
    spark = rows.sparkSession
    ends = rows.where("last").select(*key, "conv_id").repartitionByRange(common.parts(spark), *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    ddl = "depth long, s1 long, s2 long, s3 long, s4 long"

    def groups(batches, columns):
        held = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*key, *columns)), strict=True):
                if held is None or row[:5] != held:
                    held = row[:5]
                    yield held, True, row[5:]
                else:
                    yield held, False, row[5:]

    def emit(made, *names):
        import pyarrow as pa

        kinds = {"begin": pa.int64(), "ids": pa.string(), "ends_sha256": pa.string()}
        columns = [*key, *names]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], kinds.get(c, pa.int64())) for i, c in enumerate(columns)], columns)

    def chunked(batches):
        made, ids, now, begin = [], [], None, None
        for node, fresh, (i,) in groups(batches, ["conv_id"]):
            if ids and (fresh or len(ids) >= CHUNK):
                made.append((*now, begin, ",".join(ids)))
                ids = []
            if not ids:
                now, begin = node, i
            ids.append(str(i))
            if len(made) >= 4096:
                yield emit(made, "begin", "ids")
                made = []
        if ids:
            made.append((*now, begin, ",".join(ids)))
        if made:
            yield emit(made, "begin", "ids")

    def hashed(batches):
        import hashlib

        made, state, now = [], None, None
        for node, fresh, (_, ids) in groups(batches, ["begin", "ids"]):
            if fresh:
                if state:
                    made.append((*now, state.hexdigest()))
                state, now = hashlib.sha256(ids.encode()), node
            else:
                state.update(b"," + ids.encode())
            if len(made) >= 4096:
                yield emit(made, "ends_sha256")
                made = []
        if state:
            made.append((*now, state.hexdigest()))
        if made:
            yield emit(made, "ends_sha256")

    chunks = ends.mapInArrow(chunked, f"{ddl}, begin long, ids string")
    return chunks.repartition(common.parts(spark), *key).sortWithinPartitions(*key, "begin").mapInArrow(hashed, f"{ddl}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """A row for each node of the rebuilt conversations' trie.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Null roles and texts are empty, null turns come
    first, rows with a null conv_id belong to no conversation and go; turns
    that tie are ordered by role and text; further columns aren't read. An
    empty table has no nodes, not even a root.
    """
    key = ["depth", *SUMS]
    rows = common.save(members(rebuilt(conversations, block, most)), "members")
    nodes = node_table(rows)
    totals = common.save(peeled(runs(nodes)), "totals")
    came = totals.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    hang = totals.select(F.col("run").alias("conv_id"), F.col("top").alias("depth"), F.col("parent").alias("_parent"))
    own = nodes.join(end_digests(rows), key, "left").drop(*SUMS, "p1", "p2", "p3", "p4").join(came, ["conv_id", "depth"], "left").join(hang, ["conv_id", "depth"], "left")
    own = own.withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("long") + F.coalesce("_leaves", F.lit(0)), "saved_tokens": F.col("own") + F.coalesce("_saved", F.lit(0)),
        "parent_conv_id": F.when(F.col("depth") > 0, F.coalesce("_parent", "conv_id")), "ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY_SHA)),
    })
    own = own.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return running(own, ["conv_id"], -F.col("depth"), ["n_leaves", "saved_tokens"])
