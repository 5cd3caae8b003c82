"""Time-varying curriculum: sources mixed to target weights along one training run.

Each source has a weight schedule over training time 0..1, piecewise linear.
Its integral up to time t is the source's token demand by then. A document's
place in its source's (hashed) order is an amount of demanded tokens, and the
time at which the demand reaches that amount is the document's training
position. Sources with more demand than words repeat their documents, at most
``most`` times; the share that no source may take goes to the others by weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from outletlens.llm import common

#: Knots (time, factor) of the schedules that sources take in turn: steady, fading, rising.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.6, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.4, 1.0), (1.0, 1.5)))


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Target words of each source from (source, size) rows.

    Sources by code point, null last, take ``weights`` in turn. With the
    sources sorted by capacity per weight, the water level after the first k
    are full is (total - their capacity) / (weight of the rest); the first
    source whose capacity per weight reaches its level marks the final one.
    One row for each source: source, source_size, rank, weight, target.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.asc_nulls_last("source"))  # rows here are sources
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", turn.cast("long"))
    fill = W.orderBy(F.col("per_weight"), "rank")
    level = (
        ranked.withColumn("capacity", F.lit(most) * F.col("source_size"))
        .withColumn("per_weight", F.col("capacity") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("full", F.coalesce(F.sum("capacity").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("per_weight"), F.struct("per_weight", "rank", "level"))).over(W.partitionBy()))
    )
    target = F.when(F.struct("per_weight", "rank") < F.struct("final.per_weight", "final.rank"), F.col("capacity").cast("double")).otherwise(F.col("final.level") * F.col("weight"))
    return level.select("source", "source_size", "rank", "weight", F.coalesce(target, F.col("capacity").cast("double")).alias("target"))


def _knots(rank: Column, schedules) -> Column:
    """Array of (t, w, area up to t) of a source's schedule, its whole area scaled to 1."""
    made = []
    for knots in schedules:
        area, acc = [0.0], 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            acc += (t1 - t0) * (w0 + w1) / 2
            area.append(acc)
        made.append(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w / acc).alias("w"), F.lit(a / acc).alias("a")) for (t, w), a in zip(knots, area, strict=True)]))
    return F.element_at(F.array(*made), (rank % len(schedules) + 1).cast("int"))


def time_of(share: Column, knots: Column) -> Column:
    """Training time at which the integral of a schedule reaches ``share`` of its whole."""

    def within(i):
        a, b = F.element_at(knots, i), F.element_at(knots, i + 1)
        left, slope = share - a["a"], (b["w"] - a["w"]) / (b["t"] - a["t"])
        root = F.sqrt(F.greatest(a["w"] * a["w"] + 2 * slope * left, F.lit(0.0)))
        return F.when(left <= 0, a["t"]).otherwise(F.least(b["t"], a["t"] + 2 * left / (a["w"] + root)))

    last = F.greatest(F.lit(1), F.least(F.size(F.filter(knots, lambda k: k["a"] <= share)), F.size(knots) - 1))
    return within(last.cast("int"))


def plan(docs: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), schedules=SCHEDULES) -> DataFrame:
    """The mix: doc_id, size, source_size, target, taken, n_copies, position, range-sorted by position.

    Order within a source: md5 of doc_id (of the size where that is null), then
    doc_id and size; rows equal in all of these are interchangeable. A source's demand is its target, rounded;
    documents follow one another in that order, around again as long as demand
    is left, and the last copy is cut at a word so that the words taken are
    the demand exactly. ``taken`` counts the words of all copies, ``n_copies``
    the copies (a cut one too), ``position`` is the first copy's training time
    (null when nothing is taken). Null or empty texts have size 0 and nothing
    is taken of them; a source of no words has target 0; null is a source of
    its own, null doc_ids sort first. An empty table gives no rows.
    """
    sized = docs.select(F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size"))
    return arrange(sized, most, weights, schedules)


def arrange(sized: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), schedules=SCHEDULES, ordered: bool = True) -> DataFrame:
    """``plan`` over (doc_id, source, size) rows; any further columns stay."""
    spark = sized.sparkSession
    goal = targets(sized, most, weights).withColumnsRenamed({"source": "_of"})
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("size"))))  # null doc_ids are dealt by their sizes
    bucket = (F.conv(F.substring(F.col("_mark"), 1, 7), 16, 10).cast("long") * common.parts(spark) / F.lit(1 << 28)).cast("int")
    placed = common.dealt_sum(sized.withColumn("_mark", mark), ["source"], [F.col("_mark"), F.col("doc_id"), F.col("size")], F.col("size"), "_start", F.coalesce(bucket, F.lit(0)))
    joined = placed.join(goal, placed["source"].eqNullSafe(goal["_of"]))
    demand, total = F.round("target").cast("long"), F.col("source_size")
    rounds = F.when(total > 0, F.floor(F.col("_demand") / total)).otherwise(0).cast("long")
    left = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_demand") - F.col("_rounds") * total - F.col("_start")))
    shared = joined.withColumn("_demand", F.least(demand, most * total)).withColumn("_rounds", rounds).withColumn("_part", left)
    done = (
        shared.withColumn("taken", F.col("_rounds") * F.col("size") + F.col("_part"))
        .withColumn("n_copies", F.when(F.col("taken") > 0, F.col("_rounds") + (F.col("_part") > 0).cast("long")).otherwise(F.lit(0)))
        .withColumn("position", F.when(F.col("taken") > 0, time_of(F.col("_start") / F.greatest(F.col("_demand"), F.lit(1)), _knots(F.col("rank"), schedules))))
    )
    rest = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    out = done.select("doc_id", "size", "source_size", "target", "taken", "n_copies", "position", *[F.col("_start").alias("start"), F.col("_demand").alias("demand"), F.col("rank").alias("source_rank")], *rest)
    if not ordered:
        return out
    return out.repartitionByRange(common.parts(spark), F.asc_nulls_last("position"), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_last("position"), F.asc_nulls_first("doc_id"))


def mixed(docs: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), schedules=SCHEDULES) -> DataFrame:
    """The documents of the mix: a row for each copy, range-sorted by training position, columns as in ``docs``.

    Rows are told apart by their place in the files of ``docs``; what isn't
    read from files is written first. Texts stay whole: the last copy of a
    source, which ``plan`` cuts at a word, is taken if at least half of it is.
    Null, empty and wordless texts are never taken; rows that repeat others are
    documents of their own; null sources are one source; an empty table gives no rows.
    """
    spark = docs.sparkSession
    if "_metadata" in docs.columns or not docs.inputFiles():
        docs = common.save(docs, "mix-input")
    file, index, position = common.own_names(docs, "mix_file", "mix_index", "mix_position")
    place = [F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(index)]
    keyed = docs.select("*", *place)
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), *place)
    planned = arrange(sized, most, weights, schedules, ordered=False).where("n_copies > 0")
    copies = planned.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    begin = F.col("start") + F.col("_copy") * F.col("source_size")
    enough = 2 * F.least(F.col("size"), F.col("demand") - begin) >= F.col("size")
    timed = copies.where(enough).select(file, index, time_of(begin / F.greatest(F.col("demand"), F.lit(1)), _knots(F.col("source_rank"), schedules)).alias(position))
    order = [F.col(position), F.asc_nulls_first("doc_id")]
    return keyed.join(timed, [file, index]).repartitionByRange(common.parts(spark), *order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in docs.columns])
