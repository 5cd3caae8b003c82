"""Each operator against a plain version, and on nulls, long and empty texts, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from outletlens.llm import chat, covertree, html, langid, media, minhash, mixing, packing, pieces, pii, token_store
from outletlens.llm import common

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def tokenizer(path):
    """The library as it comes: strings of special tokens become their ids."""
    return Tokenizer.from_file(path)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("stage", "kept"), [(lambda docs: langid.predict(docs, None), False), (minhash.sketch, False), (lambda docs: packing.encode(docs, WORD), True)])
def test_workers_keep_encoders_for_stages_that_tokenize_only(edge, monkeypatch, stage, kept):
    made, whole, back = [], type(edge).mapInArrow, []
    monkeypatch.setattr(type(edge), "mapInArrow", lambda self, f, schema: made.append(f) or whole(self, f, schema))
    stage(edge)
    monkeypatch.setattr(pieces, "_encoders", {(WORD, "word"): None})
    monkeypatch.setattr(common, "give_back", lambda: back.append(len(pieces._encoders)), raising=False)
    assert list(made[0](iter([]))) is not None
    assert bool(pieces._encoders) == kept and back == [int(kept)]  # freed memory goes back when a task ends


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_the_library_gets_a_bounded_share_of_new_pieces_at_a_time(path, monkeypatch):
    e, most = pieces.Encoder(path, "word" if path == WORD else "byte"), []

    class Counted:
        def encode_batch_fast(self, texts, inner=e.tokenizer, **how):
            most.append(len(texts))
            return inner.encode_batch_fast(texts, **how)

    e.tokenizer = Counted()
    text = " ".join(f"{a}{b}{c}" for a in "abcdefghijklmnopqrst" for b in ("ka", "lo", "mi", "nu", "pe") * 2 for c in (f"x{'y' * k}z" for k in range(200)))
    ids, _ = e.encode([text.encode(), "漢字".encode(), "かな".encode()])
    assert ids.tolist() == [x for t in (text, "漢字", "かな") for x in tokenizer(path).encode(t, add_special_tokens=False).ids]
    assert max(most) <= 4096 and len(most) > 3


@pytest.mark.parametrize(("path", "style"), [(BYTE, "byte"), (WORD, "word")])
def test_pieces_give_the_tokenizers_ids(path, style):
    rnd = random.Random(1)
    parts = ["a", "B's", "'s", "''re", "'ve", " ", "  ", "\n", "1", "23", "!", "?é", "É", "ß", "×", "漢", "\t", "́", "<|endoftext|>", "\0"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(1500)] + ["", "a's", "'"]
    ids, at = pieces.Encoder(path, style, most=500).encode([t.encode() for t in texts])
    t = tokenizer(path)
    assert all(ids[at[k] : at[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids for k, x in enumerate(texts))
    ids, at = pieces.Encoder(path, style, plain_specials=True).encode([t.encode() for t in texts])
    t.encode_special_tokens = True
    assert all(ids[at[k] : at[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids for k, x in enumerate(texts))


def thue_morse(n):
    """Two texts of 2 ** n letters that polynomial sums modulo 2 ** 64 take for one."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize(("path", "style"), [(BYTE, "byte"), (WORD, "word")])
def test_pieces_are_told_apart_by_their_bytes(path, style, monkeypatch):
    texts = [*thue_morse(9), *thue_morse(10), *thue_morse(12), "a" * 511, "a" * 512, "a" * 513, "b" * 513, "hi <|endoftext|> there", "ab cd ba dc"]
    t = tokenizer(path)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts * 2]
    ids, at = pieces.Encoder(path, style).encode([x.encode() for x in texts * 2])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    monkeypatch.setattr(pieces, "range_hash", lambda buf, start, end, seed=0: (end - start).astype(np.uint64))  # all pieces of a length collide
    ids, at = pieces.Encoder(path, style).encode([x.encode() for x in texts * 2])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_packing(edge, corpus, empty):
    t = tokenizer(WORD)
    for docs in (edge, corpus.unionByName(corpus.select("doc_id", F.repeat(F.concat("text", F.lit(" ")), 9).alias("text"), "lang", "source", "n_chars"))):
        rows = packing.pack(docs, WORD, with_ids=True).collect()
        want = sorted((str(r.doc_id), tuple(t.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in docs.select("doc_id", "text").collect())
        seqs, by = {}, {}
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
            by.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, r.ids))
        for parts in seqs.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= packing.WINDOW
        total = sum(len(i) for _, i in want)
        assert sum(r.length for r in rows) == total and len(seqs) <= total / packing.WINDOW * 1.03 + 2
        for (doc, n), parts in by.items():
            texts = [i for d, i in want if d == doc and len(i) == n]
            if len(texts) == 1:
                assert b"".join(i for _, i in sorted(parts)) == np.array(texts[0], "<u4").tobytes()
        whole = packing.sequences(packing.pack(docs, WORD, with_ids=True)).collect()
        assert all(len(w.ids) == 4 * w.n_tokens for w in whole)
    assert packing.pack(empty, WORD).count() == 0


def test_patterns_stay_within_the_histogram():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, packing.BINS + 1)
    counts[0] = 0
    used = np.zeros_like(counts)
    for parts, times in packing.patterns(counts):
        assert sum(parts) <= packing.BINS
        for p in parts:
            used[p] += times
    assert (used <= counts).all() and used.sum() > 0.8 * counts.sum()


def test_top_k(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(8, 6))
    rows = [(int(i), (base[i % 8] + 0.05 * rng.normal(size=6)).tolist()) for i in range(700)]
    rows += [(50, rows[50][1]), (1000, None), (1001, [1.0, None] + [0.0] * 4), (1002, [float("nan")] + [0.0] * 5), (1050, [float("inf")] * 6), (None, rows[3][1])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, row int")
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (q, x) in enumerate(good):
        if q is not None and q % 50 == 0:
            best = sorted((-int(x @ y), i if i is not None else 1 << 62) for b, (i, y) in enumerate(good) if a != b)[:5]
            want += [(q, k + 1, None if i == 1 << 62 else i, -s) for k, (s, i) in enumerate(best)]
    got = [tuple(r) for r in covertree.top_k(table).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert covertree.top_k(table.limit(0)).count() == 0
    big = covertree._product(np.full((1, 2), 1 << 40), np.full((1, 2), 1 << 20))
    assert big(slice(None), slice(None)).tolist() == [[1 << 61]]


def test_the_trees_leave_out_what_is_far():
    """Clustered vectors: a small share of all pairs is scored, and the result is that of all pairs."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 200
    x = np.round(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 4).astype(np.int64)
    x[:50] = x[0]  # repeated rows
    tree, seen = covertree.build(x.astype(float)), []
    todo = [tree]
    while todo:
        t = todo.pop()
        todo += t.children
        inside, stack = [], [t]
        while stack:
            u = stack.pop()
            inside += [] if u.points is None else u.points.tolist()
            stack += u.children
        assert len(inside) == t.size and np.linalg.norm(x[inside] - t.centre, axis=1).max() <= t.radius + 1e-9
        seen += [] if t.points is None else t.points.tolist()
    assert sorted(seen) == list(range(4000)) and tree.children
    rows, queries = np.arange(4000), np.arange(0, 4000, 50)
    best = covertree.search(x[queries], x, 5, rows, queries, rows)
    assert best.scored < 0.25 * len(queries) * len(x)
    for i, q in enumerate(queries.tolist()):
        scores = x @ x[q]
        want = sorted(((-int(s), int(r)) for r, s in enumerate(scores) if r != q))[:5]
        assert list(zip((-best.score[i]).tolist(), best.id[i].tolist(), strict=True)) == want


def test_blocks_that_are_far_never_meet(spark, monkeypatch):
    """Several blocks: fewer pairs of blocks are searched than there are, with the result of all."""
    monkeypatch.setattr(covertree, "DATA_BLOCK", 200)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.01 * rng.normal(size=8)).tolist()) for i in range(2400)]
    counted, real = {}, common.save

    def save(df, name, *more):
        out = real(df, name, *more)
        counted[name] = out.count()
        return out

    monkeypatch.setattr(common, "save", save)
    got = sorted(tuple(r) for r in covertree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect())
    x = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    want = []
    for q in range(0, 2400, 10):
        best = sorted((-int(s), r) for r, s in enumerate(x @ x[q]) if r != q)[:5]
        want += [(q, k + 1, r, -s) for k, (s, r) in enumerate(best)]
    assert got == sorted(want)
    assert counted["first-pairs"] + counted["more-pairs"] < 0.8 * counted["block-pairs"]


def test_media(edge, empty):
    stored = media.encode(edge)
    raw = {(r.doc_id, r.n_bytes): r.media for r in stored.collect()}
    for r in media.features(stored).collect():
        m = raw[r.doc_id, r.n_bytes]
        payload = media.payload_of(m)
        texts = [t for i, t in edge.select("doc_id", "text").collect() if i == r.doc_id]
        assert payload in [media.pad((t or "").encode()) for t in texts] and m.endswith(payload)
        assert (r.payload_bytes, r.payload_sha256, r.media_bytes) == (len(payload), hashlib.sha256(payload).hexdigest(), len(m))
    assert {x[0] for x in media.walk(memoryview(media.mux(b" " * 192)))} >= {b"/moov/trak/mdia/minf/stbl/stsz", b"/mdat"}
    spans = media.keyframes(stored.where("doc_id = 7")).orderBy("keyframe").collect()
    assert [s.keyframe for s in spans] == list(range(0, 157, 64)) and all(a.end_byte == b.first_byte for a, b in zip(spans, spans[1:], strict=False))
    assert media.features(media.encode(empty)).count() == 0
    for n in (1, 64, 65, 200):  # the feature, computed from the payload's length alone
        m = media.mux(b"x" * 192 * n)
        base = len(m) - 192 * n
        cuts = [*range(0, n, 64), n]
        spans = np.array([(base + 192 * a, base + 192 * b) for a, b in zip(cuts, cuts[1:])], "<i8")
        assert media._features(1, 5, m)[7] == f"raw:{192 * n}/48000:{n}:{len(cuts) - 1}:{zlib.crc32(spans.tobytes()):08x}"
    with pytest.raises(ValueError, match="size"):
        list(media.walk(memoryview(b"\0\0\1\0mdat")))


def test_media_of_others(spark):
    """Null, empty and broken media, containers without a track, other tables, and samples of two tracks in turn."""
    good = media.mux(b"a" * 192 * 40)
    no_track = media._box(b"ftyp", b"isom", bytes(4)) + media._box(b"moov")
    broken = good.replace(b"stsc", b"free")
    small = media._full(b"stz2", b"\0\0\0\x08", bytes([0, 0, 0, 4]), bytes([10, 20, 30, 40]))
    parts = lambda sizes, *more: media._box(b"moov", media._box(b"trak", media._box(b"mdia", media._box(b"minf", media._box(b"stbl", sizes, *more)))))
    chunks = lambda *at: media._full(b"stco", len(at).to_bytes(4, "big"), *(x.to_bytes(4, "big") for x in at))
    per = media._full(b"stsc", (1).to_bytes(4, "big"), b"".join(x.to_bytes(4, "big") for x in (1, 2, 1)))
    times = media._full(b"stts", (2).to_bytes(4, "big"), b"".join(x.to_bytes(4, "big") for x in (3, 5, 1, 7)))
    other = parts(small, chunks(300, 400), per, times) + bytes(600)
    found = media.probe(other)["tracks"][0]
    assert found["samples"].tolist() == [[300, 10], [310, 20], [400, 30], [430, 40]] and found["duration"] == 22
    assert media._keyframe_ranges(found | {"keyframes": np.array([1])}).tolist() == [[1, 310, 330], [1, 400, 470]]
    deep = b"moov"
    for _ in range(2000):
        deep = media._box(b"moov", deep)
    huge = good.replace(media._full(b"stsz", (192).to_bytes(4, "big"), (40).to_bytes(4, "big")), media._full(b"stsz", (192).to_bytes(4, "big"), b"\xff" * 4))
    rows = [(1, None), (2, b""), (3, b"\0\0\1\0mdat"), (4, no_track), (5, broken), (6, good), (6, good), (None, good), (7, deep), (8, huge), (9, good[:-5])]
    table = spark.createDataFrame([(i, 3, m, "x") for i, m in rows], "doc_id long, n_bytes long, media binary, codec string")
    got = {r.doc_id: r for r in media.features(table).collect()}
    assert all(got[i].error and got[i].payload_sha256 is None for i in (1, 2, 3, 4, 5, 7, 8, 9)) and got[6].error is None and got[None].payload_bytes == 192 * 40
    assert {r.doc_id for r in media.keyframes(table).collect()} == {6, None}


KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(KINDS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0
            if (kind != "ip" or all(int(x) <= 255 for x in m[0].split("."))) and (kind != "card" or (12 <= len(d) <= 19 and luhn)) and (kind != "phone" or 9 <= len(d) <= 15):
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_pii(spark, edge, empty):
    rnd = random.Random(2)
    parts = ["a", "b@c.d", "@", ".", "x@y", "1", "22.3.4.5", " ", "+1", "(555) 123-4567", "4284896609045836", "-", "é", "𝒳", "255.256.1.1", "001.2.3.4", "a.b@c-d.e.", "\n", "_d@e.f", "+49 30 1234567", "Mr. John Smith", "123-45-6789"]
    texts = [(i, "".join(rnd.choices(parts, k=rnd.randint(0, 20)))) for i in range(300)] + [(900, "9" * 20_000 + "." + "a" * 20_000 + "@b.c")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for table in (docs, edge):
        text = {(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()}
        for r in pii.digest(pii.detect(table)).collect():
            plain = [plain_spans(t or "") for i, t in text if i == r.doc_id]
            assert r.base_sha256 in [hashlib.sha256(p.encode()).hexdigest() for p in plain]
            assert any(set(filter(None, p.split(","))) <= set(r.spans.split(",")) for p in plain)
    clean = {r.doc_id: r for r in pii.cleaned(edge).collect()}
    assert clean[11].text == "mail [EMAIL] or [PHONE], [IP] and [CARD]." and clean[11].n_chars == len(clean[11].text) and clean[1].text is None
    assert pii.detect(empty).count() == 0 and pii.cleaned(empty).columns == empty.columns


def test_secrets_and_names_are_found_and_prose_is_left_alone(spark):
    """Planted tokens, keys and names among the given documents: nearly all found, clean texts untouched."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rnd = random.Random(12)
    hexa = lambda n: "".join(rnd.choices("0123456789abcdef", k=n))
    planted, clean = [], []
    for i in range(60):
        planted.append((-1 - i, rnd.choice([f'so the token = "{hexa(40)}" was', f"password: Tr0ub4dor-{hexa(6)} here", f"api_key='{hexa(32)}'", f"AKIA{hexa(16).upper()} is", "dear Mr. John Smith, we", "call Maria Keller now"])))
        clean.append((-1000 - i, rnd.choice(["the token is a word here", "a secret garden: flowers", "page 12 of version 1.2.3", "password rules are long", "In May 2020 it rained", "token = x"])))
    both = docs.unionByName(spark.createDataFrame(planted + clean, docs.schema))
    got = {r.doc_id: r.spans for r in pii.digest(pii.detect(both)).collect()}
    assert sum(bool(got[i]) for i, _ in planted) >= 57 and not any(got[i] for i, _ in clean)
    given = {r.doc_id: r.text or "" for r in docs.collect()}
    held = {i for i, t in given.items() if re.search(r'(?i)token = "[0-9a-f]{40}', t)}
    assert held and sum("secret:" in got[i] for i in held) >= 0.95 * len(held)
    bare = [i for i, t in given.items() if not re.search(r"[0-9@]", t)]
    assert len(bare) > 100 and not any(got[i] for i in bare)


def test_reliabilities_separate_good_labelers(spark):
    spans = [([1, 1, 0, 1, 0, 0], 40), ([1, 0, 0, 0, 0, 0], 10), ([-1, 0, 0, -1, 0, -1], 40), ([0, 0, 0, 1, 0, 0], 5)]
    rows = [([(0, "tel", 1, False, v, ["tel", "1", "space", "space", "9", "9", "other"])] * n,) for v, n in spans]
    found = spark.createDataFrame(rows, "spans array<struct<start:int,kind:string,end:int,base:boolean,votes:array<int>,features:array<string>>>")
    post = {tuple(r.votes): r.posterior for r in pii.reliabilities(found).collect()}
    assert post[1, 1, 0, 1, 0, 0] > 0.9 and post[-1, 0, 0, -1, 0, -1] < 0.1


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 20_000)).astype(np.uint64)
    h = token_store.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert token_store.PerfectHash.build(np.zeros(0, np.uint64)).slots(keys[:3]).tolist() == [-1] * 3


def test_one_key_takes_a_few_small_reads(tmp_path):
    """However many keys a shard has, the bytes read for one stay the same."""
    reads = {}
    for n in (1000, 200_000):
        keys = np.arange(n, dtype=np.int64) * 7 - 1000
        perfect = token_store.PerfectHash.build(keys.view(np.uint64))
        slot = perfect.slots(keys.view(np.uint64))
        mark, first = np.empty(n, np.uint32), np.empty(n, np.int64)
        mark[slot], first[slot] = token_store.fingerprints(keys.view(np.uint64)), np.arange(n)
        with open(tmp_path / f"{n}.idx", "wb") as f:
            token_store._write_index(f, {"bounds": np.arange(n + 1), "keys": keys, "sizes": perfect.sizes, "bits": perfect.bits, "ranks": perfect.ranks, "fingerprint": mark, "first": first}, {"nulls": 0, "width": 2})
        (tmp_path / f"{n}.bin").write_bytes(bytes(2 * n))
        shard = token_store.Shard(f"file://{tmp_path}", str(n))
        shard.whole("sizes")
        real, sizes = shard.part, []
        shard.part = lambda name, a, b, real=real, sizes=sizes: sizes.append(b - a) or real(name, a, b)
        some = keys[:: n // 500]
        assert [shard.find_one(int(k)) for k in some] == np.arange(n)[:: n // 500].tolist() and shard.find_one(3) == -1
        reads[n] = sum(sizes) / len(some), max(sizes)
        assert shard.find(keys).tolist() == list(range(n))
    assert reads[200_000][1] == reads[1000][1] == 8 and reads[200_000][0] < 1.2 * reads[1000][0]


def test_token_store(spark, edge, empty):
    t, root = tokenizer(BYTE), common.scratch_path(spark, "ids")
    manifest = token_store.write(edge, root, BYTE)
    rows = sorted(token_store.read_back(spark, manifest, root).collect(), key=lambda r: r.start)
    texts = sorted(((i is not None, i or 0, x or "") for i, x in edge.select("doc_id", "text").collect()))
    start = 0
    for r, (there, i, x) in zip(rows, texts, strict=True):
        ids = t.encode(x, add_special_tokens=False).ids + [0]
        assert tuple(r) == (i if there else None, start, len(ids), crc(ids))
        start += len(ids)
    found = token_store.lookup(manifest, spark.createDataFrame([(4,), (999,), (None,)], "doc_id long"), root).collect()
    assert [(r.doc_id, r.ids) for r in found] == [(4, t.encode("one two three four", add_special_tokens=False).ids + [0])]
    root = common.scratch_path(spark, "ids")
    assert token_store.read_back(spark, token_store.write(empty, root, BYTE), root).count() == 0
    same = spark.range(40).selectExpr("if(id < 20, null, 5L) as doc_id", "concat('t', id % 3) as text").repartition(3)  # one key, and none, over several shards
    for _ in range(2):
        root = common.scratch_path(spark, "ids")
        manifest = token_store.write(same, root, BYTE)
        rows = sorted(token_store.read_back(spark, manifest, root).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == [None] * 20 + [5] * 20 and [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
        assert token_store.lookup(manifest, spark.createDataFrame([(5,), (5,)], "doc_id long"), root).count() == 1


def plain_components(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 75 * (len(sets[a][1]) + len(sets[b][1]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k, (i, s) in enumerate(sets):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted((str(i), len(s), str(least[find(k)])) for k, (i, s) in enumerate(sets))


def test_shingles_of_patterned_words_differ():
    a, b = (s.tolist() for s in minhash.shingle_sets([x.encode() for x in thue_morse(10)]))
    assert len(a) == len(b) == 1 and a != b
    rnd = random.Random(9)
    texts = [" ".join(rnd.choices(["a", "B", "bb", "\tc", "dd" * 300, "é"], k=rnd.randint(0, 40))) + rnd.choice(["", " ", "\n"]) for _ in range(300)]
    sets = minhash.shingle_sets([t.encode() for t in texts], seed=5)
    plain = []
    for t in texts:
        w = t.encode().lower().split()
        plain.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    assert [len(s) for s in sets] == list(map(len, plain)) and all((np.diff(s.astype(object)) > 0).all() for s in sets if len(s) > 1)
    assert all(len(np.intersect1d(sets[i], sets[i + 1])) == len(plain[i] & plain[i + 1]) for i in range(299))


def test_bitmaps_never_overstate_a_difference():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, m = rng.integers(0, 3000, 2)
        x, y = (np.unique(rng.integers(0, 1 << 63, k, dtype=np.uint64)) for k in (n, m))
        y = np.union1d(y, x[: rng.integers(0, n + 1)])
        differ = len(np.setxor1d(x, y))
        assert minhash._differ(*(np.frombuffer(minhash.bitmap(s), np.uint64) for s in (x, y))) <= differ
        both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        assert minhash._too_far(differ, len(x), len(y)) == (100 * both < 75 * union)


def test_near_duplicates_of_long_texts(spark):
    """Texts of several hundred shingles around the threshold, groups of copies and a passage, against all pairs."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 6)))
    passage, texts = [word() for _ in range(120)], []
    for _ in range(60):
        w = [word() for _ in range(rnd.choice([210, 260, 400, 900, 2500]))]
        if rnd.random() < 0.4:
            w += passage
        texts.append(w)
        for _ in range(rnd.choice([0, 1, 2, 9])):
            v = list(w)
            for _ in range(rnd.randint(0, len(v) // 28)):
                v[rnd.randrange(len(v))] = word()
            texts.append(v[rnd.randint(0, len(v) // 6) :])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = minhash.near_duplicates(docs).collect()
    want = plain_components(docs.collect())
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert len({c for _, _, c in want}) < len(texts) * 0.8


def test_texts_that_share_a_hash_stay_apart(spark, corpus, monkeypatch):
    real = minhash.node_of
    monkeypatch.setattr(minhash, "node_of", lambda text, shared=(): F.when((F.length(F.coalesce(text, F.lit(""))) % 40).isin([int(x) for x in shared]), real(text)).otherwise((F.length(F.coalesce(text, F.lit(""))) % 40).cast("long")))
    got = minhash.near_duplicates(corpus).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain_components(corpus.select("doc_id", "text").collect())


def test_near_duplicates(edge, corpus, empty, monkeypatch):
    for docs in (edge, corpus):
        got = minhash.near_duplicates(docs).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain_components(docs.select("doc_id", "text").collect())
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(empty).count() == 0
    left = minhash.without_duplicates(corpus)
    assert left.count() == sum(r.kept for r in minhash.near_duplicates(corpus).collect()) and left.columns == corpus.columns
    for name, value in (("LIST", 2), ("STARS", (2,)), ("BLOCK", 5), ("HOT_LEAST", 3), ("PER_TASK", 500)):  # long and split lists
        monkeypatch.setattr(minhash, name, value)
    got = minhash.near_duplicates(corpus).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain_components(corpus.select("doc_id", "text").collect())
    clash = corpus.selectExpr("*", "1 as _id", "2 as _node", "3 as id", "4 as node", "5 as id_")
    left = minhash.without_duplicates(clash)
    assert left.columns == clash.columns and left.count() == sum(r.kept for r in got)
    assert minhash.without_duplicates(empty).count() == 0


def test_language(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    there = model.idf < model.idf.max()
    assert 0.5 < (model.weights[:, there] == 0).mean() < 1  # the penalty makes the weights sparse
    got = {r.doc_id: r.lang_pred for r in langid.predict(edge, model).collect()}
    assert got[1] == got[2] == got[10] == "und" and got[5] != "und" and len(langid.predict(edge, model).collect()) == edge.count()
    assert {r.lang_pred for r in langid.predict(edge, None).collect()} == {"und"} and langid.train(empty) is None
    kept = {r.doc_id for r in langid.accepted(edge, model, 0.0).collect()}
    assert kept == {r.doc_id for r in edge.collect()} - {1, 2, 10}
    assert [r.held_out for r in langid.predict(edge.where("doc_id = 3"), model).collect()] == [zlib.crc32(b"3") % 5 == 0]


def test_chat(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "ok"), (2, 0, None, None), (4, 0, "user", "same"), (5, 0, "user", "same"), (None, 0, "user", "lost")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    got = {r.pair_id: r for r in chat.preferences(chat.neighbours(table)).collect()}
    a = got[0]
    assert a.prompt == "<|im_start|>user\nhi<|im_end|>\n" and a.prompt_turns == 1 and a.chosen == "<|im_start|>assistant\nyo<|im_end|>\n"
    assert [a.chosen[s.start : s.end] for s in a.chosen_spans] == ["yo<|im_end|>"] and [a.rejected[s.start : s.end] for s in a.rejected_spans] == ["no<|im_end|>"]
    assert got[1].rejected is None and got[1].prompt_turns == 0 and (got[2].chosen, got[2].rejected) == ("", "") and set(got) == {0, 1, 2}
    assert chat.preferences(chat.neighbours(table.limit(0))).count() == 0


def test_mixing(edge, corpus, empty):
    for docs in (edge, corpus):
        sizes, got = {}, mixing.plan(docs).collect()
        for r in docs.select("source", "text").collect():
            sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
        weight = {s: k % 3 + 1 for k, s in enumerate(names)}
        goal, full = {}, set()
        while True:  # share, stop those above, share again
            rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
            goal = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
            over = {s for s in names if s not in full and goal[s] > 3 * sizes[s]}
            if not over:
                break
            full |= over
        taken = {}
        for r in got:
            taken.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
            assert 0 <= r.taken <= 3 * r.size and (r.taken > 0) == (r.position is not None)
        assert {k: sum(v) for k, v in taken.items()} == {(sizes[s], round(goal[s], 6)): int(goal[s] + 0.5) for s in names}
        again = mixing.plan(docs.repartition(3)).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))
        copies = mixing.mixed(docs)
        assert copies.columns == docs.columns
        whole, times = {(r.doc_id, r.text) for r in docs.collect()}, {}
        for r in copies.collect():
            assert (r.doc_id, r.text) in whole
            times[r.source] = times.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        longest = max(r.size for r in got)
        assert all(abs(times.get(s, 0) - goal[s]) <= longest / 2 + 1 for s in names)
    assert mixing.plan(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mixed(corpus.selectExpr("*", "1 as mix_file", "2 as _mix_file", "3 as mix_position")).columns[-3:] == ["mix_file", "_mix_file", "mix_position"]


def test_schedules_are_inverted(spark):
    knots = ((0.0, 1.5), (0.6, 1.0), (1.0, 0.5))
    t = np.linspace(0, 1, 21)
    weight = np.interp(np.linspace(0, 1, 200_001), [k for k, _ in knots], [w for _, w in knots])
    area = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    share = np.interp(t, np.linspace(0, 1, 200_001), area / area[-1])
    rows = spark.createDataFrame([(float(s),) for s in share], "s double").select(mixing.time_of(F.col("s"), mixing._knots(F.lit(1), mixing.SCHEDULES)).alias("t")).collect()
    assert np.allclose([r.t for r in rows], t, atol=1e-6)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<p>b", "a\n\nb"),
        ("<ul><li>a<li>b<ol start=3><li>x</ol></ul>", "- a\n- b\n  3. x"),
        ("<table><tr><th>Name<th>N<tr><td>abc<td>1</table>", "Name | N\nabc  | 1"),
        ("<table><tr><td rowspan=2>z<td>22<tr><td>33</table>", "z | 22\n  | 33"),
        ("<title>t</title><script>no</script><p hidden>no</p><div style='display: none'>no</div>yes", "yes"),
        ("<pre> a\n  b</pre>", " a\n  b"),
        ("a &amp; b<br>c", "a & b\nc"),
        ("x < y <b>z", "x < y z"),
        ("", ""),
        ("<!-- c --><p>un<b>closed", "unclosed"),
        ("<a href=x title=don't>one</a> two <b>it's</b>", "one two it's"),
        ("<p title=it's>hello</p>", "hello"),
        ("<p title = \"a > b\" data-x='>' hidden=until-found>x<br/>y", "x\ny"),
        ("a<p title=\"never closed>b</p>", "a"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b><ul><li>no</ul></div>", "yes"),
        ("<table><tr><td>日本<td>1<tr><td>abcde<td>2</table>", "日本  | 1\nabcde | 2"),
        ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>", "wide cell | z\na | b     | c"),
    ],
)
def test_html(page, text):
    assert html.extract(page) == text


def test_html_hostile_pages():
    """Deep, wide and unbalanced pages take time and memory as their length does."""
    import time

    began = time.time()
    assert html.extract("<table><tr><td>" * 6000 + "deep") == "deep"
    assert html.extract("<div>" * 20_000 + "</p></i>" * 20_000 + "x").strip() == "x"
    wide = html.extract("<table>" + "<tr><td colspan=1000 rowspan=1000>a" * 500 + "</table>")
    assert wide.count("a") == 500 and len(wide) < 2_000_000
    assert html.extract("<p " + "a=b " * 50_000 + ">x") == "x" and html.extract("<p " + "'" * 50_000) == ""
    assert html.extract("<i>" + "<table><tr><td>" + "<div>" * 5000 + "</i>" * 5000 + "y").strip() == "y"
    assert time.time() - began < 20


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("&#" + "9" * 5000 + ";x", "\ufffdx"), ("&#" + "0" * 5000 + "65;", "A"), ("&#x" + "f" * 5000 + ";", "\ufffd"), ("&#128512;&#x1F600;", "😀😀"),
        ("<table><tr><td colspan=" + "5" * 5000 + " rowspan=" + "7" * 5000 + ">a</table>", "a"), ("<select size=" + "3" * 5000 + "><option>a<option>b</select>", "a\nb"),
        ("<ol start=" + "9" * 4300 + "><li>a<li>b</ol>", "1000000000. a\n1000000001. b"), ("<ol start=-2><li>a<li>b</ol>", "-2. a\n-1. b"),
        ("<ruby>字<rp>(</rp><rt>zi</rt><rp>)</rp></ruby><progress value=1>no</progress><meter>no</meter>", "字zi"), ("<input type=submit value=Send><input type=text value=no>", "Send"),
        ("<svg><text><![CDATA[a < b]]></text></svg>", "a < b"), ("<p>a<![CDATA[x]]>b", "ab"), ("<p>a<plaintext><b>c</b>", "a\n\n<b>c</b>"),
    ],
)
def test_html_numbers_and_rare_elements(page, text):
    assert html.extract(page).strip() == text


def words(rnd, n):
    return " ".join(rnd.choice(["a", "bc", "déf", "漢字"]) for _ in range(n))


def test_html_against_a_plain_reader():
    """Random well-formed pages: the words are those that a reader of the standard library meets outside hidden elements, in order."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += bool(self.off) or tag in ("script", "template") or "hidden" in dict(attrs)

        def handle_endtag(self, tag):
            self.off -= bool(self.off)

        def handle_data(self, data):
            self.out += [] if self.off else data.split()

    rnd = random.Random(12)

    def page(depth):
        if depth == 0:
            return words(rnd, rnd.randint(1, 4))
        tag = rnd.choice(["div", "p", "blockquote", "b", "section", "h2", "pre", "ul", "table", "template", "div hidden"])
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{page(depth - 1)}</li>" for _ in range(2)) + "</ul>"
        if tag == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td>{words(rnd, 1)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"
        inner = words(rnd, 2) if tag == "p" else "".join(page(depth - 1) + " " for _ in range(rnd.randint(1, 3)))
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    for _ in range(300):
        text = page(4)
        reader = Reader()
        reader.feed(text)
        assert [w for w in html.extract(text).split() if w not in ("-", "|", ">")] == reader.out, text


@pytest.mark.parametrize(
    ("piece", "n"),
    [("<ul><li>a", 8000), ("<blockquote>a", 4000), ("<table><tr><td>a", 4000), ("<dl><dd>a", 4000), ("<ol><li><table><tr><td>a<td>b", 1500)],
)
def test_html_of_nested_text_grows_with_the_page(piece, n):
    import time

    took, sizes = [], []
    for k in (n // 2, n):
        began = time.time()
        out = html.extract(piece * k)
        took.append(time.time() - began)
        sizes.append(len(out))
        assert out.count("a") == k
    assert sizes[1] < 2.5 * sizes[0] and sizes[1] < 12 * len(piece) * n and took[1] < 4 + 3 * took[0]


def test_html_of_wide_rows_grows_with_the_page():
    head = "<tr>" + "<td>x" * 2000
    page = "<table>" + head + "<tr><td colspan=1000><td colspan=999><td>y" * 4000 + "</table>"
    assert len(html.extract(page)) < 40 * len(page) and html.extract(page).count("y") == 4000


def test_deep_boxes_are_told():
    import struct

    def nested(n):
        inner = b""
        for _ in range(n):
            inner = struct.pack(">I4s", 8 + len(inner), b"moov") + inner
        return memoryview(inner)

    assert sum(1 for _ in media.walk(nested(900))) == 900
    with pytest.raises(ValueError, match="deep"):
        list(media.walk(nested(1200)))


def test_the_table_of_pieces_is_bounded_by_bytes():
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abcdefgh", k=3000)) for _ in range(300)]
    e = pieces.Encoder(BYTE, "byte", most_bytes=100_000)
    t = tokenizer(BYTE)
    for k in range(0, 300, 10):
        ids, at = e.encode([x.encode() for x in texts[k : k + 10]])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts[k : k + 10]]
        assert len(e.raw) <= 1 << 18


def test_html_pages(spark):
    table = spark.createDataFrame([(1, "<p>a", "t"), (2, None, "t"), (None, "", "t"), (1, "<p>a", "t"), (3, "<div>" * 5000 + "deep", "t")], "page_id long, html string, text string")
    assert sorted(map(str, ((r.page_id, r.text) for r in html.pages_text(table).collect()))) == sorted(map(str, [(1, "a"), (2, None), (None, ""), (1, "a"), (3, "deep")]))
    assert html.pages_text(table.limit(0)).count() == 0
