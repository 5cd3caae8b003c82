"""Candidate pairs by an exact index and complete-link in rounds give what plain versions give."""

import random

import numpy as np
import pytest

from outletlens.operators import claims as C


def claims_of(spark, vectors):
    return spark.createDataFrame([(e, k, [float(x) for x in v]) for e, k, v in vectors], "event_id string, idx long, vec array<double>")


def plain_pairs(vectors, least):
    out = set()
    for n, (e, i, v) in enumerate(vectors):
        for f, j, w in vectors[n + 1 :]:
            if e == f and round(float(np.dot(v, w)), 12) >= least:
                out.add((e, min(i, j), max(i, j)))
    return out


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n else v


def mixed_vectors(seed):
    """An event of sparse vectors, one of dense ones, one with copies, zero vectors and negative components."""
    rng = np.random.default_rng(seed)
    out = [("sparse", k, unit(rng.poisson(0.12, 40).astype(float))) for k in range(250)]
    out += [("dense", k, unit(rng.normal(size=40) + rng.integers(0, 4) * np.eye(40)[rng.integers(0, 3)] * 3)) for k in range(150)]
    same = unit(rng.normal(size=40))
    out += [("copies", k, same if k % 3 else unit(rng.normal(size=40))) for k in range(90)] + [("copies", 90 + k, np.zeros(40)) for k in range(3)]
    out += [("long", k, 2 * unit(rng.poisson(0.1, 40).astype(float) * rng.choice([-1, 1], 40))) for k in range(80)] + [("one", 0, same)]
    return out


@pytest.mark.parametrize(("least", "block"), [(0.5, 1024), (0.83, 32), (0.0, 64), (-0.3, 1024)])
def test_candidates_are_those_of_all_pairs(spark, monkeypatch, least, block):
    monkeypatch.setattr(C, "BLOCK", block)
    vectors = mixed_vectors(3)
    found = [(r.event_id, r.i, r.j) for r in C.candidate_pairs(claims_of(spark, vectors), least).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_pairs(vectors, least)


def test_the_index_leaves_out_most_pairs_of_sparse_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = [("e", k, unit((rng.random(400) < 0.02).astype(float))) for k in range(900)]
    assert C.compared_share(claims_of(spark, vectors), 0.8) < 0.15


def test_pairs_of_nothing(spark):
    none = spark.createDataFrame([], "event_id string, idx long, vec array<double>")
    assert C.candidate_pairs(none).collect() == [] and C.compared_share(none, 0.5) == 0
    assert C.candidate_pairs(spark.createDataFrame([("e", 1, None), ("e", 2, [1.0])], "event_id string, idx long, vec array<double>")).collect() == []


def graph(rnd, n, p, levels):
    return [(i, j, rnd.randint(1, levels) / levels) for i in range(n) for j in range(i + 1, n) if rnd.random() < p]


def check(spark, graphs, in_task):
    nodes = spark.createDataFrame([(e, k) for e, (n, _) in graphs.items() for k in range(n)], "event_id string, idx long")
    edges = spark.createDataFrame([(e, i, j, s) for e, (_, es) in graphs.items() for i, j, s in es], "event_id string, i long, j long, similarity double")
    got = {(r.event_id, r.idx): r.cluster for r in C.clusters(nodes, edges, in_task=in_task).collect()}
    assert got == {(e, m): c[0] for e, (n, es) in graphs.items() for c in C.complete_link(list(range(n)), es) for m in c}


@pytest.mark.parametrize("in_task", [0, 12])
def test_rounds_give_the_greedy_clusters(spark, in_task):
    rnd = random.Random(9)
    graphs = {f"r{k}": (n, graph(rnd, n, p, levels)) for k, (n, p, levels) in enumerate([(14, 0.5, 100), (16, 0.7, 3), (12, 0.9, 1), (25, 0.15, 50), (6, 0.0, 1)])}
    copies = [(i, j, 1.0) for i in range(9) for j in range(i + 1, 9)] + [(i, 9, 0.8) for i in range(9)] + [(i, 10, 0.7) for i in range(4)]
    graphs["copies"] = 11, copies
    check(spark, graphs, in_task)


def test_many_copies_are_one_cluster_at_once(spark):
    n = 120
    check(spark, {"e": (n + 1, [(i, j, 1.0) for i in range(n) for j in range(i + 1, n)] + [(i, n, 0.9) for i in range(n)])}, 50)


def test_a_component_of_a_hundred_thousand_claims(spark):
    n = 100_000
    nodes = spark.range(n).selectExpr("'e' event_id", "id idx")
    edges = spark.range(n - 1).selectExpr("'e' event_id", "id i", "id + 1 j", "1 - (id % 1000) / 2000.0D similarity")
    found = C.clusters(nodes, edges).groupBy("cluster").count()
    counts = {r["count"] for r in found.select("count").distinct().collect()}
    assert counts <= {1, 2} and found.count() < 0.7 * n


def test_medoids_and_evidence_need_no_pairs(spark):
    rng = np.random.default_rng(8)
    vectors = [("e", k, unit(rng.normal(size=6))) for k in range(40)]
    rows = [(e, k, k % 5, f"a{k % 3}", "x" * (k % 4 + 1), [float(x) for x in v]) for e, k, v in vectors] + [("e", 40, 9, "a0", "y", None)]
    members = spark.createDataFrame(rows, "event_id string, idx long, cluster long, article_id string, text string, vec array<double>")
    reps = C.representatives(members)
    got = {r.cluster: r.representative for r in reps.collect()}
    for c in range(5):
        own = [v for _, k, v in vectors if k % 5 == c]
        ids = [k for k in range(40) if k % 5 == c]
        sums = [round(sum(float(a @ b) for b in own) - float(a @ a), 9) for a in own]
        assert got[c] == min(zip([-s for s in sums], [k % 4 for k in ids], ids, strict=True))[2]
    assert got[9] == 40
    found = {(r.cluster, r.article_id, r.sentence): r.similarity for r in C.evidence(members.withColumnRenamed("text", "sentence"), reps).collect()}
    assert found[9, "a0", "y"] == 1.0
    for (c, a, s), x in found.items():
        if c < 5:
            near = [1.0 if k == got[c] else float(v @ vectors[got[c]][2]) for _, k, v in vectors if (k % 5, f"a{k % 3}", "x" * (k % 4 + 1)) == (c, a, s)]
            assert abs(x - min(max(max(near), 0), 1)) < 6e-5


def test_clusters_that_miss_an_edge_are_told(spark):
    members = spark.createDataFrame([("e", 0, 0), ("e", 1, 0), ("e", 2, 2)], "event_id string, idx long, cluster long")
    edge = "event_id string, i long, j long"
    assert C.coherent(members, spark.createDataFrame([("e", 1, 0), ("e", 1, 2)], edge)).count() == 3
    with pytest.raises(Exception, match="misses an edge"):
        C.coherent(members, spark.createDataFrame([("e", 1, 2)], edge)).collect()


def test_copies_go_through_once(spark):
    vectors = mixed_vectors(6) + [("lots", k, unit(np.array([1.0, k % 3, 0, 0]))) for k in range(400)]
    claims = claims_of(spark, vectors)
    got = {(r.event_id, r.idx): r.cluster for r in C.vector_clusters(claims, 0.6).collect()}
    want = {(r.event_id, r.idx): r.cluster for r in C.clusters(claims, C.candidate_pairs(claims, 0.6)).collect()}
    assert got == want and len(got) == len(vectors)


def test_many_small_events_need_no_index_and_no_components(spark, monkeypatch):
    def dear(*_):
        raise AssertionError("an event that one task holds was indexed or searched for components")

    monkeypatch.setattr(C, "vector_index", dear)
    monkeypatch.setattr(C, "connected", dear)
    vectors = [(f"{e}{n}", k, v) for n in range(3) for e, k, v in mixed_vectors(n)] + [(None, k, np.ones(2)) for k in range(2)]
    claims = claims_of(spark, vectors)
    found = C.candidate_pairs(claims, 0.7)
    want = plain_pairs([v for v in vectors if v[0]], 0.7)
    assert sorted((r.event_id, r.i, r.j) for r in found.collect()) == sorted(want)
    got = {(r.event_id, r.idx): r.cluster for r in C.clusters(claims, found).collect()}
    assert len(got) == len(vectors) and all(got[e, i] != got[e, j] for (e, i), (f, j) in zip(list(got), list(got)[1:]) if e == f and (e, min(i, j), max(i, j)) not in want)
