"""Consensus view, actor by outlet matrix and structural framing clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from outletlens.operators.claims import category


def consensus(coverage: DataFrame, widely: float = 0.80, commonly: float = 0.50, minority: float = 0.20) -> DataFrame:
    """``coverage`` with each claim's category, most widely reported first."""
    return coverage.withColumn("category", category(F.col("coverage_ratio"), widely, commonly, minority)).orderBy("event_id", F.desc("coverage_ratio"), "cluster_id")


def entity_matrix(stats: DataFrame, min_mentions: int = 1) -> DataFrame:
    """Profiles (event_id, name, article_id, counts, ratios, verbs) of actors with enough mentions in all; verbs as agent first, then those as patient only."""
    total = stats.groupBy("event_id", "name").agg(F.sum("mention_count").alias("total_mentions")).where(F.col("total_mentions") >= min_mentions)
    return stats.join(total, ["event_id", "name"]).withColumn("verbs", F.concat("agent_verbs", F.array_except("patient_verbs", "agent_verbs")))


def framing_features(articles: DataFrame, svo: DataFrame, matrix: DataFrame, members: DataFrame) -> DataFrame:
    """Features of each article: passive ratio, mean agent and patient ratio over all profiles, numbers of actors and sentences, claims taken part in.

    ``articles`` holds event_id, article_id, n_sentences. Counts saturate at 10 actors and 30 sentences.
    """
    keys = ["event_id", "article_id"]
    passive = svo.groupBy(*keys).agg(F.avg(F.col("is_passive").cast("double")).alias("passive_ratio"))
    roles = matrix.groupBy(*keys).agg(F.avg("agent_ratio").alias("mean_agent"), F.avg("patient_ratio").alias("mean_patient"), F.countDistinct("name").alias("n_entities"))
    part = members.groupBy(*keys).agg(F.array_sort(F.collect_set("cluster")).alias("clusters"))
    joined = articles.join(passive, keys, "left").join(roles, keys, "left").join(part, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    saturated = lambda c, n: zero(c) / F.greatest(zero(c), F.lit(float(n)))
    all_clusters = members.groupBy("event_id").agg(F.array_sort(F.collect_set("cluster")).alias("all_clusters"))
    wide = joined.join(all_clusters, "event_id", "left")
    flags = F.transform(F.coalesce("all_clusters", F.array().cast("array<long>")), lambda c: F.coalesce(F.array_contains("clusters", c), F.lit(False)).cast("double"))
    base = F.array(zero("passive_ratio"), zero("mean_agent"), zero("mean_patient"), saturated("n_entities", 10), saturated("n_sentences", 30))
    return wide.select(*keys, zero("passive_ratio").alias("passive_ratio"), zero("mean_agent").alias("mean_agent"), zero("mean_patient").alias("mean_patient"), zero("n_entities").alias("n_entities"), zero("n_sentences").alias("n_sentences"), F.concat(base, flags).alias("features"))


def lloyd(x, k: int, rounds: int = 50, seed: int = 42):
    """Labels of plain k-means from ``k`` drawn rows; each row its own cluster where there are no more than ``k``."""
    import numpy as np

    x = np.asarray(x, float)
    if len(x) <= k:
        return np.arange(len(x))
    centre = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        now = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        made = np.stack([x[now == c].mean(axis=0) if (now == c).any() else centre[c] for c in range(k)])
        if (now == label).all() and np.allclose(made, centre):
            break
        label, centre = now, made
    return label


def scaled(x, k: int, rounds: int = 300, seed: int = 42):
    """Labels of k-means over standardised columns, the first centres drawn far apart.

    A column without variance counts as 0 everywhere. Where fewer than ``k``
    rows differ there are as many clusters as different rows.
    """
    import numpy as np

    x = np.asarray(x, float)
    spread = x.std(axis=0)
    x = (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1.0)
    rng = np.random.default_rng(seed)
    centre = x[[rng.integers(len(x))]]
    near = ((x - centre[0]) ** 2).sum(axis=1)
    while len(centre) < k and near.max() > 1e-12:
        centre = np.vstack([centre, x[rng.choice(len(x), p=near / near.sum())]])
        near = np.minimum(near, ((x - centre[-1]) ** 2).sum(axis=1))
    label = None
    for _ in range(rounds):
        now = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        if label is not None and (now == label).all():
            break
        label = now
        centre = np.stack([x[label == c].mean(axis=0) if (label == c).any() else centre[c] for c in range(len(centre))])
    return label


def framing_clusters(features: DataFrame, k: int | None = None, cluster_fn=lloyd) -> DataFrame:
    """event_id, article_id, label: structural clusters of each event's articles; events of one article have none.

    k is 3 or what is asked for, at least 1 and at most the number of articles.
    ``cluster_fn`` takes (matrix, k) and returns a label for each row.
    """

    def run(key, table):
        import pyarrow as pa

        rows = sorted(zip(table.column("article_id").to_pylist(), table.column("features").to_pylist(), strict=True))
        n = len(rows)
        label = cluster_fn([f for _, f in rows], max(1, min(k or min(3, n), n))) if n > 1 else []
        ids = [a for a, _ in rows] if n > 1 else []
        return pa.table({"event_id": pa.array([key[0].as_py()] * len(ids), pa.string()), "article_id": pa.array(ids, pa.string()), "label": pa.array([int(v) for v in label], pa.int32())})

    typed = features.select(F.col("event_id").cast("string").alias("event_id"), F.col("article_id").cast("string").alias("article_id"), "features")
    return typed.groupBy("event_id").applyInArrow(run, "event_id string, article_id string, label int")


def centroids(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean of the five base features of each cluster, as a map."""
    names = ["passive_ratio", "mean_agent", "mean_patient", "n_entities", "n_sentences"]
    joined = features.join(labels, ["event_id", "article_id"])
    means = joined.groupBy("event_id", "label").agg(*[F.round(F.avg(c), 4).alias(c) for c in names], F.array_sort(F.collect_list("article_id")).alias("article_ids"))
    return means.select("event_id", "label", "article_ids", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names)).alias("centroid"))


def top_actors(actors: DataFrame, n: int | None = 5) -> DataFrame:
    """The ``n`` most important actors of each event (all for None), by importance, then name."""
    ranked = actors.withColumn("rank", F.row_number().over(W.partitionBy("event_id").orderBy(F.desc("importance"), "name")))
    return ranked if n is None else ranked.where(F.col("rank") <= n)
