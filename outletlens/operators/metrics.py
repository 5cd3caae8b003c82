"""Quality metrics: binary, confusion, clustering pairs, false merges and the composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the composite score; fixed values.
WEIGHTS = {"svo": 0.15, "passive": 0.10, "predicate": 0.15, "normalisation": 0.10, "actor": 0.20, "relation": 0.15, "clustering": 0.15}
FALSE_MERGE_WEIGHT = 0.20


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / F.when(whole != 0, whole))


def binary(rows: DataFrame, gold: str = "gold", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall, F1 and accuracy of boolean columns; ratios of nothing are 1, F1 of nothing 0."""
    g, p = F.col(gold), F.col(pred)
    counted = rows.groupBy(*(by or [])).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    out = counted.withColumn("precision", _share(tp, tp + fp, 1.0)).withColumn("recall", _share(tp, tp + fn, 1.0))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), both, 0.0)).withColumn("accuracy", _share(tp + tn, tp + fp + fn + tn, 1.0))


def confusion(rows: DataFrame, labels: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """gold, pred, n for every two of ``labels``; other labels are ignored."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(x,) for x in labels], "label string")
    grid = names.select(F.col("label").alias("gold")).join(names.select(F.col("label").alias("pred")))
    n = rows.where(F.col(gold).isin(labels) & F.col(pred).isin(labels)).groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["gold", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cluster_pairs(members: DataFrame, by: list[str]) -> DataFrame:
    """Distinct unordered pairs of texts that share a cluster: by..., a, b from (by..., cluster, text)."""
    other = members.select(*by, "cluster", F.col("text").alias("b"))
    return members.select(*by, "cluster", F.col("text").alias("a")).join(other, [*by, "cluster"]).where("a < b").select(*by, "a", "b").distinct()


def _subsets(name: str) -> Column:
    """Every non-empty subset of the array ``name``."""
    return F.expr(f"transform(sequence(1L, shiftleft(1L, size({name})) - 1), m -> filter({name}, (x, i) -> getbit(m, i) = 1))")


def _shared_pairs(texts: DataFrame, by: list[str], sets: list[str], name: str) -> DataFrame:
    """Unordered pairs of texts that share a cluster in each of ``sets`` (arrays of clusters): by..., ``name``.

    Texts with the same subset of clusters are counted and n * (n - 1) / 2 pairs
    added for an odd, taken off for an even size of it, so no pair is made and
    none counts twice where a text is in several clusters.
    """
    odd = F.lit(0)
    for c in sets:
        texts = texts.where(f"size({c}) > 0").withColumn(c, F.explode(_subsets(c)))
        odd = odd + F.size(c) + 1
    n = texts.groupBy(*by, *sets).agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.expr("_n * (_n - 1) div 2")
    return n.groupBy(*by).agg(F.sum(F.when(odd % 2 == 0, pairs).otherwise(-pairs)).alias(name))


def clustering(gold: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """Pair precision, recall, F1 and Rand index of two clusterings of the same texts, from counts."""
    of = lambda rows, name: rows.dropna(subset=[*by, "cluster", "text"]).groupBy(*by, "text").agg(F.array_sort(F.collect_set("cluster")).alias(name))
    each = of(gold, "_g").join(of(pred, "_p"), [*by, "text"], "full")
    texts = gold.select(*by, "text").unionByName(pred.select(*by, "text")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    joined = texts
    for sets, name in ((["_g", "_p"], "tp"), (["_p"], "_pred"), (["_g"], "_gold")):
        joined = joined.join(_shared_pairs(each, by, sets, name), by, "left").na.fill(0, [name])
    joined = joined.withColumn("fp", F.col("_pred") - F.col("tp")).withColumn("fn", F.col("_gold") - F.col("tp")).select(*by, "n", "tp", "fp", "fn")
    tp, fp, fn, pairs = F.col("tp"), F.col("fp"), F.col("fn"), F.col("n") * (F.col("n") - 1) / 2
    out = joined.withColumn("precision", _share(tp, tp + fp, 1.0)).withColumn("recall", _share(tp, tp + fn, 1.0))
    both_ = F.col("precision") + F.col("recall")
    return out.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), both_, 0.0)).withColumn("rand", _share(pairs - fp - fn, pairs, 1.0))


def false_merges(rows: DataFrame) -> DataFrame:
    """Of pairs that must never be merged (category, merged): n, n_merged and rate of each category."""
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("merged").alias("n_merged")).withColumn("rate", F.col("n_merged") / F.col("n"))


def composite(scores: dict[str, float] | dict[str, Column], false_merge_rate) -> Column:
    """The weighted score from 0 to 100."""
    total = sum((F.lit(w) * (scores[k] if isinstance(scores[k], Column) else F.lit(scores[k])) for k, w in WEIGHTS.items()), F.lit(0.0))
    rate = false_merge_rate if isinstance(false_merge_rate, Column) else F.lit(false_merge_rate)
    return F.round(F.greatest(F.lit(0.0), 100 * (total - FALSE_MERGE_WEIGHT * rate)), 2)
