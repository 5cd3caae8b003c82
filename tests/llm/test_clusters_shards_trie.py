"""Centroid clustering, sharding and the prefix trie against plain versions, on hard rows and hot groups."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from outletlens.llm import centroids, sharding, trie


def plain_kmeans(rows, k=8, rounds=10):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid hash) of (vec_id, vector) rows, in whole numbers."""
    kept = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    found = [v for _, _, v in sorted((i is None, "" if i is None else mark(i), v) for i, v in kept)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(found))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for n, members in groups.items():
            found[n] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = defaultdict(int)
    for _, c, d in out:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, found[c])).encode()).hexdigest()) for i, c, d in out), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, b"x", 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v binary, distance int")


def test_clustering_equals_a_plain_version(spark):
    rnd = random.Random(5)
    exact = lambda x: float(np.float32(x))
    around = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [exact(x + rnd.gauss(0, 0.3 if d < 9 else 0.01)) for d, x in enumerate(rnd.choice(around))]) for i in range(260)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]  # a hot group of copies
    rows += [(7, rows[7][1]), (7, rows[9][1]), (None, rows[3][1]), (500, None), (501, []), (502, [0.5] * 63), (503, [0.5] * 65), (504, [None] * 64), (505, [float("nan")] * 64), (506, [0.0] * 63 + [float("-inf")])]
    got = sorted(map(tuple, centroids.cluster(vectors(spark, rows)).collect()), key=repr)
    assert got == plain_kmeans(rows) and len(got) == 260 + 120 + 3


def test_clustering_of_few_equal_and_no_vectors(spark):
    for rows in ([], [(1, None)], [(4, [0.25] * 64)], [(i, [0.5] * 64) for i in range(20)], [(i, [float(i % 2)] + [-0.3] * 63) for i in range(11)]):
        rows = [(i, v and [float(np.float32(x)) for x in v]) for i, v in rows]
        assert sorted(map(tuple, centroids.cluster(vectors(spark, rows)).collect()), key=repr) == plain_kmeans(rows)


def test_numbers_too_large_for_exact_distances_are_told(spark):
    with pytest.raises(Exception, match="beyond 134217728"):
        centroids.cluster(vectors(spark, [(1, [1e9] * 64)])).collect()


def test_partial_distances_are_exact_and_fewer():
    rng = np.random.default_rng(2)
    spread = np.r_[np.full(8, 900), np.full(56, 9)]
    middles = (rng.normal(0, 1, (8, 64)) * spread).astype(np.int64)
    middles[5] = middles[2]  # a tie for every vector near them
    block = middles[rng.integers(0, 8, 3000)] + (rng.normal(0, 0.1, (3000, 64)) * spread).astype(np.int64)
    label, best, made = centroids.nearest(block, middles)
    whole = ((block[:, None] - middles[None]) ** 2).sum(2)
    assert (label == whole.argmin(1)).all() and (best == whole.min(1)).all()
    assert made < 0.4 * block.shape[0] * 8 * 64
    label, best, _ = centroids.nearest(block, np.zeros((8, 64), np.int64))
    assert (label == 0).all() and (best == (block**2).sum(1)).all()


def places(df):
    return sorted(((r.shard, r.slot, r.doc_id, r.text) for r in df.collect()), key=lambda r: r[:2])


def test_shards_hold_every_record_once(spark, edge, corpus, tmp_path):
    docs = corpus.unionByName(edge.select(corpus.columns)).unionByName(spark.range(300).selectExpr("7L doc_id", "'the same' text", "'en' lang", "'s' source", "8L n_chars"))
    root = f"file://{tmp_path}/out"
    schema = sharding.write(docs, root, bucket_bytes=2000)
    found = sharding.digest(sharding.read(spark, root, schema)).collect()
    n = docs.count()
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == want and len(found) == n
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(by) == set(range(8)) and {len(x) for x in by.values()} <= {n // 8, n // 8 + 1}
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_a_shuffle_can_be_repeated_and_mixes(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.range(4000).selectExpr("id doc_id", "repeat('x', int(id % 50)) text", "id shard", "id shuffle_bucket", "id _metadata").repartitionByRange(4, "doc_id").write.parquet(path)
    docs = spark.read.parquet(path)
    one, two = places(sharding.shuffled(docs, bucket_bytes=10_000)), places(sharding.shuffled(docs, bucket_bytes=10_000))
    assert one == two and one != places(sharding.shuffled(docs, seed=13, bucket_bytes=10_000))
    assert {"shuffle_bucket", "_metadata"} < set(sharding.shuffled(docs).columns)
    order = [i for *_, i, _ in one]
    assert abs(np.corrcoef(order, range(4000))[0, 1]) < 0.06
    near = np.array([abs(a - b) for a, b in zip(order, order[1:], strict=False)])
    assert 1150 < near.mean() < 1520  # a third of the range: neighbours have nothing to do with one another


def test_fisher_yates_is_fair():
    seen = defaultdict(int)
    for bucket in range(6000):
        seen[tuple(sharding.fisher_yates(3, 1, bucket))] += 1
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())
    assert [sharding.fisher_yates(n, 1, 1).tolist() for n in (0, 1)] == [[], [0]]


def test_few_and_no_records(spark, edge, tmp_path):
    for k, n in enumerate((0, 1, 3)):
        root = f"file://{tmp_path}/few{k}"
        found = sharding.digest(sharding.read(spark, root, sharding.write(edge.limit(n), root))).collect()
        assert len(found) == n and all(r.slot == 0 for r in found) and len({r.shard for r in found}) == n


def plain_trie(rows, block=100, most=6):
    """Nodes of (conv_id, turn, role, text) rows, from prefixes as tuples."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        made[c] = own.get(c - int(math.fmod(c, block)), [])[:h] + own[c][h:]
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = sum(saved[x] for x in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(made[c]) == len(p)).encode()).hexdigest()
    return sorted((min(members[p]), len(p), min(members[p[:-1]]) if p else -(10**9), len(members[p]), len(children[p]), leaves[p], saved[p], ends(p)) for p in members)


def nodes(df):
    return sorted((r.conv_id, r.depth, -(10**9) if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_convs string, parent string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def random_rows(seed, ids, kinds=3, longest=7):
    rnd = random.Random(seed)
    rows = []
    for c in ids:
        for turn in range(rnd.randint(1, longest)):
            rows.append((c, turn if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant", None, ""]), rnd.choice([None, "", "é漢", "a", "bb", "a\nb"][:kinds])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_a_plain_version(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    monkeypatch.setattr(trie.running, "__defaults__", (3,))
    rnd = random.Random(seed)
    ids = sorted({*range(0, 40), *range(100, 130), *range(201, 230), *(-x for x in range(1, 25)), *(rnd.randrange(10**6) for _ in range(30))})
    rows = random_rows(seed, ids, kinds=6 if seed > 1 else 3)
    rows += [(5, 0, "user", "twice")] * 3 + [(None, 1, "user", "nobody"), (None, None, None, None)]
    rows += [(900, t, "user", f"t{t // 2}") for t in range(60)]  # one long conversation, with copies and a late fork
    rows += [(c, t, "user", f"t{t // 2}") for c in (900 + zlib.crc32(b"900") % 1, 1000) for t in range(50)]
    rows += [(c, 0, "system", "the same") for c in range(2000, 2100)]
    assert nodes(trie.prefix_trie(conversations(spark, rows))) == plain_trie(rows)


def test_runs_that_hang_from_one_another_are_peeled_in_turn(spark):
    """Conversation n leaves the one before it a turn later: as many rounds as conversations, none lost."""
    ids = [c for c in range(0, 100 * 400, 100)][:14]
    rows = [(c, t, "user", f"{min(t, n)}-{t}") for n, c in enumerate(ids) for t in range(16)]
    assert nodes(trie.prefix_trie(conversations(spark, rows))) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(conversations(spark, [])).collect() == []
    assert trie.prefix_trie(conversations(spark, [(None, 1, "a", "b")])).collect() == []
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = nodes(trie.prefix_trie(conversations(spark, [(turnless, 0, "user", "gone")])))
    assert got == plain_trie([(turnless, 0, "user", "gone")]) and len(got) == 1


def test_prefixes_that_share_a_hash_are_told(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(trie, "_halves", lambda seed, *of: [F.lit(1).cast("long")] * 2)
    with pytest.raises(Exception, match="share a hash"):
        trie.prefix_trie(conversations(spark, [(0, 0, "user", "a"), (100, 0, "user", "b")])).collect()
