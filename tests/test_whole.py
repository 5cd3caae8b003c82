"""Operators do the whole job: nothing is cut by id, by rounds or by order."""

import random
from collections import defaultdict
from itertools import combinations

import duckdb
import pytest

from outletlens.operators import metrics as M
from outletlens.plans.queries import ORACLE, QUERIES
from tests.test_oracle import rows_of


@pytest.mark.parametrize("name", ["pair_metrics"])
def test_pair_metrics_match_sql_beyond_300_documents(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    found = QUERIES[name](spark, sf)
    assert rows_of(found.toPandas()) == rows_of(con.execute(ORACLE[name]).df())


def test_clustering_counts_pairs_without_making_them(spark):
    rnd = random.Random(3)
    gold, pred = [[("e", f"{side}{rnd.randrange(4)}", f"t{rnd.randrange(30)}") for _ in range(60)] for side in "gp"]
    gold.append(("e", None, "alone"))
    pairs = []
    for rows in (gold, pred):
        by = defaultdict(set)
        for _, cluster, text in rows:
            if cluster:
                by[cluster].add(text)
        pairs.append({p for texts in by.values() for p in combinations(sorted(texts), 2)})
    n = len({r[2] for r in gold + pred})
    g, p = pairs
    ddl = "event_id string, cluster string, text string"
    r = M.clustering(spark.createDataFrame(gold, ddl), spark.createDataFrame(pred, ddl), ["event_id"]).first()
    assert (r.tp, r.fp, r.fn) == (len(g & p), len(p - g), len(g - p))
    assert r.rand == pytest.approx(1 - len(g ^ p) / (n * (n - 1) / 2))


def test_clustering_of_many_texts(spark):
    """200,000 texts in one cluster have 2e10 pairs."""
    n = 200_000
    rows = spark.range(n).selectExpr("'e' as event_id", "'c' as cluster", "cast(id as string) as text")
    r = M.clustering(rows, rows, ["event_id"]).first()
    assert (r.tp, r.fp, r.fn, r.rand) == (n * (n - 1) // 2, 0, 0, 1.0)


def test_connected_settles_on_long_chains(spark):
    """Chains with random node numbers, the same numbers in two events, a hub and repeated edges."""
    from outletlens.operators import claims as C

    rnd = random.Random(5)
    edges, want = [], {}
    for event, size in (("a", 300), ("b", 300), ("b", 7)):
        start = 1000 if size == 7 else 0
        nodes = rnd.sample(range(start, start + size), size)
        edges += [(event, *rnd.sample(e, 2)) for e in zip(nodes, nodes[1:], strict=False)]
        want |= {(event, n): start for n in nodes}
    edges += [("c", 9, n) for n in range(10, 60)] + edges[:5]
    want |= {("c", n): 9 for n in range(9, 60)}
    found = C.connected(spark.createDataFrame(edges, "event_id string, i long, j long")).collect()
    assert len(found) == len(want) and {(r.event_id, r.node): r.label for r in found} == want


def test_a_chain_of_claims_is_one_component(spark):
    """A claim has one cluster, however long the chain of candidates around it."""
    from outletlens.operators import claims as C

    nodes = random.Random(6).sample(range(400), 400)
    pairs = [("e", *sorted(e), 0.9 - k / 1000) for k, e in enumerate(zip(nodes, nodes[1:], strict=False))]
    claims = spark.createDataFrame([("e", n) for n in nodes], "event_id string, idx long")
    members = C.clusters(claims, spark.createDataFrame(pairs, "event_id string, i long, j long, similarity double")).collect()
    want = {n: c[0] for c in C.complete_link(nodes, [p[1:] for p in pairs]) for n in c}
    assert len(members) == 400 and {r.idx: r.cluster for r in members} == want
