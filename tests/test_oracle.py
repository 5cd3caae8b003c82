"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from outletlens.plans.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return tuple(map(_plain, x)) if isinstance(x, list) else x


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(map(_plain, r))) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(ORACLE[name]).df())


def test_claim_clusters_are_cliques(spark):
    from outletlens.operators.claims import candidate_pairs
    from outletlens.plans.queries import _vector_claims

    claims = _vector_claims(spark, SF)
    pairs = {(r.event_id, r.i, r.j) for r in candidate_pairs(claims, 0.6).collect()}
    members = QUERIES["claim_clusters"](spark, SF).collect()
    assert len(members) == claims.count()
    by = {}
    for r in members:
        by.setdefault((r.event_id, r.cluster), []).append(r.idx)
    for (event, _), ids in by.items():
        ids.sort()
        assert all((event, a, b) in pairs for k, a in enumerate(ids) for b in ids[k + 1 :])


def test_sentence_clusters_are_those_of_a_plain_version(spark):
    """Real edges: clusters of several sentences, chains that must be cut, and sentences without any."""
    from outletlens.operators.claims import candidate_pairs, complete_link
    from outletlens.plans import stories

    claims = stories._claims(spark, SF).where("event_id < '2'")
    edges, nodes = {}, {}
    for r in candidate_pairs(claims, stories.LEAST).collect():
        edges.setdefault(r.event_id, []).append((r.i, r.j, r.similarity))
    for r in claims.select("event_id", "idx").collect():
        nodes.setdefault(r.event_id, []).append(r.idx)
    want = {(e, n): c[0] for e, ns in nodes.items() for c in complete_link(ns, edges.get(e, [])) for n in c}
    got = {(r.event_id, r.idx): r.cluster for r in QUERIES["sentence_clusters"](spark, SF).where("event_id < '2'").collect()}
    assert got == want and len(edges) > 10
    sizes = {}
    for k, c in want.items():
        sizes[k[0], c] = sizes.get((k[0], c), 0) + 1
    assert max(sizes.values()) > 2
    for e, es in edges.items():  # every two members are joined, and no two clusters that could be one are apart
        joined = {(i, j) for i, j, _ in es}
        of = {n: want[e, n] for n in nodes[e]}
        groups = {}
        for n, c in of.items():
            groups.setdefault(c, []).append(n)
        assert all((a, b) in joined for g in groups.values() for k, a in enumerate(sorted(g)) for b in sorted(g)[k + 1 :])


def test_complete_link_keeps_singletons():
    from outletlens.operators.claims import complete_link

    assert complete_link(list(range(8)), []) == [[k] for k in range(8)]
    assert complete_link([5, 1, 3, 9], [(1, 5, 0.9), (3, 5, 0.8)]) == [[1, 5], [3], [9]]


def test_files_of_the_same_name_are_told_apart(spark, tmp_path):
    from outletlens.sources import articles

    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.txt").write_text(f"text of {folder}")
    rows = articles.load(spark, [str(tmp_path / "b" / "x.txt"), str(tmp_path / "a" / "x.txt")]).collect()
    assert sorted((r.ordinal, r.text) for r in rows) == [(0, "text of b"), (1, "text of a")]


def test_confidences_round_half_to_even(spark):
    from pyspark.sql import functions as F

    from outletlens.operators.verify import _half_even

    assert spark.range(1).select(_half_even(F.lit(0.78125)), _half_even(F.lit(0.78135))).first()[:] == (0.7812, 0.7814)


def test_framing_clusters_cover_every_article(spark):
    found = QUERIES["framing_clusters"](spark, SF).collect()
    assert len({(r.event_id, r.article_id) for r in found}) == len(found)
    assert all(0 <= r.label < 3 for r in found)
