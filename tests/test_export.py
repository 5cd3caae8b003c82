"""The nested export of an event, and k-means over standardised features."""

import json

import numpy as np
from pyspark.sql import functions as F

from outletlens import cli
from outletlens.operators.consensus import framing_clusters, scaled

TEXT = {
    "a": "Police arrested 30 protesters. The council approved the budget. Guards detained marchers.",
    "b": "Protesters were arrested by police. The council approved the budget.",
    "c": "The council approved the budget. Rain fell heavily on the city.",
}


def test_scaled_kmeans_ignores_units():
    rng = np.random.default_rng(3)
    middle = np.repeat(np.array([[0.0, 0, 0], [5, 5, 0], [0, 9, 9]]), 20, axis=0)
    x = middle + rng.normal(0, 0.1, middle.shape)
    groups = lambda label: {tuple(np.flatnonzero(label == c)) for c in set(label.tolist())}
    known = {tuple(range(k, k + 20)) for k in (0, 20, 40)}
    assert groups(scaled(x, 3)) == known
    assert groups(scaled(x * [1000.0, 1, 0.001], 3)) == known
    assert (scaled(x, 3) == scaled(x, 3)).all()


def test_scaled_kmeans_edges():
    assert scaled(np.ones((4, 2)), 3).tolist() == [0, 0, 0, 0]
    assert len(set(scaled([[0.0], [1.0], [1.0]], 3).tolist())) == 2
    assert scaled([[1.0, 2.0]], 1).tolist() == [0]


def test_framing_with_scaled_features(spark):
    rows = [("e", f"a{k}", [float(k // 2), 100.0 * (k // 2)]) for k in range(4)] + [("one", "x", [0.0, 0.0])]
    got = framing_clusters(spark.createDataFrame(rows, "event_id string, article_id string, features array<double>"), 2, scaled).collect()
    label = {r["article_id"]: r["label"] for r in got}
    assert set(label) == {"a0", "a1", "a2", "a3"}
    assert label["a0"] == label["a1"] != label["a2"] == label["a3"]


def test_event_export(spark, tmp_path):
    for name, text in TEXT.items():
        (tmp_path / f"{name}.txt").write_text(text)
    out = tmp_path / "out.json"
    args = cli.parser().parse_args(["analyze", str(tmp_path), "--format", "json", "-o", str(out)])
    cli.analyze(spark, args)
    made = json.loads(out.read_text())
    assert made["article_ids"] == ["a", "b", "c"]
    budget = next(c for c in made["claims"] if c["coverage_count"] == 3)
    assert {e["article_id"] for e in budget["evidence"]} == {"a", "b", "c"}
    assert all("budget" in e["sentence"] and 0 <= e["similarity"] <= 1 for e in budget["evidence"])
    assert [c["cluster_id"] for c in made["claims"]] == sorted(c["cluster_id"] for c in made["claims"])
    assert made["actors"] and all({p["article_id"] for p in a["profiles"]} == {"a", "b", "c"} for a in made["actors"])
    assert [a["importance"] for a in made["actors"]] == sorted((a["importance"] for a in made["actors"]), reverse=True)
    assert sorted(x for g in made["framing"] for x in g["article_ids"]) == ["a", "b", "c"]


def test_event_export_of_nothing(spark):
    from outletlens.sources.reports import event_export

    none = lambda ddl: spark.createDataFrame([], ddl)
    made = event_export(
        spark.createDataFrame([("e", "a")], "event_id string, article_id string"),
        none("event_id string, cluster long, cluster_id string, representative string, coverage_count int, total_articles long, coverage_ratio double, category string, article_ids array<string>, absent_ids array<string>"),
        none("event_id string, cluster long, article_id string, sentence string, similarity double"),
        none("event_id string, actor long, name string, type string, surfaces array<string>, article_ids array<string>, importance double"),
        none("event_id string, actor long, article_id string, mention_count long, agent_count long, patient_count long, passive_patient_count long, agent_ratio double, patient_ratio double, passive_patient_ratio double, agent_verbs array<string>, patient_verbs array<string>, modifiers array<string>"),
        none("event_id string, article_id string, label int"),
    )
    row = made.select("event_id", "article_ids", *[F.size(c).alias(c) for c in ("claims", "actors", "framing")]).collect()
    assert [tuple(r) for r in row] == [("e", ["a"], 0, 0, 0)]
