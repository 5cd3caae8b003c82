"""Near-duplicate documents by bottom-k sketches of one hash function.

Every document keeps the smallest hashes of its distinct word shingles, as many
as it takes (``retained``) that two similar documents can't but share one of
them. Inverted lists of retained values bring documents together. Values that
many documents retain count as the largest of all, so passages that many
documents share stay out of the lists; as the same order holds for every
document, no similar pair is lost. The sketch of the union of two sets estimates
how similar a listed pair is, and where that isn't clearly enough a parity bitmap
rules out the pairs whose sets differ in too many elements for certain. Whole
shingle sets decide.

Texts are nodes by their hash (a second hash tells apart texts that share it),
so a group of equal texts is one node. A list longer than ``LIST`` first links
its members to two of them only; in the next round (``STARS``) to some members of
its largest part and some others; at last all pairs of a list that are still in
different components are looked at, block by block, and those that the bitmaps
leave are tested. A pair is dropped where its places in a list leave too few
further values to share: in the first list that it has in common nothing came
before, so no similar pair is lost. Lists of frequent values are dealt over
several tasks.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletlens.llm import common
from outletlens.llm.components import components
from outletlens.llm.pieces import mix, range_hash, raw_texts, slices

WORDS = 5
SIMILAR = 75
#: Values of a sketch that estimate a union; a pair estimated at SURE or more goes to its whole sets at once, any other is held against the bitmaps.
FILTER_K, SURE = 32, 0.95
#: Bits of a parity bitmap for each element of the set, and the least and most of them.
BITS, LEAST_BITS, MOST_BITS = 2, 256, 1 << 16
LIST = 6
#: Members of the largest part of a long list, and of the others, that the rounds between link all its members to.
STARS = (32,)
#: A group of near copies shares many lists, so each of these rounds takes one in so many; the last round takes all.
STAR_SHARE = 4
#: The most frequent retained values are ordered by count; of all others only the hash counts. Bounds what is sent to executors (2 MB).
HOT, HOT_LEAST = 1 << 17, 8
#: Retained values that a task of the lists takes on average, and members of one list that are held in one task.
PER_TASK, BLOCK = 400_000, 20_000
#: Candidate nodes up to this number may be broadcast (16 MB) to find their texts.
SENT = 1 << 21

SKETCH = "doc_id long, node long, check long, n long, sketch binary, bitmap binary"
PACKED = "range int, values binary, nodes binary, sizes binary, places binary"
MET = "kind int, a long, b long, n long, place int"

_GAP = np.zeros(256, bool)
_GAP[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[bytes], words: int = WORDS, seed: int = 0) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text, all keyed by ``seed``."""
    buf = np.frombuffer(b" " + b" ".join(texts) + bytes(b" " * 9), np.uint8)
    gap = _GAP[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1  # starts and ends of words in turn
    first, last = edge[0::2], edge[1::2]
    word = np.searchsorted(first, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)]))
    said = range_hash(_LOWER[buf], first, last, seed)
    count = np.diff(word)
    h = said.copy()  # h[i]: the words from i on
    sets: list[np.ndarray | None] = [None] * len(texts)
    for k in range(1, words):  # texts of k words have one shingle, the whole
        for i in np.flatnonzero(count == k).tolist():
            sets[i] = mix(h[word[i] : word[i] + 1] ^ np.uint64(k))
        h = mix(h[:-1] * _ODD + said[k:]) if len(h) else h
    h = mix(h ^ np.uint64(words))
    for i, (a, n) in enumerate(zip(word.tolist(), count.tolist(), strict=False)):
        if sets[i] is None:
            s = np.sort(h[a : a + n - words + 1]) if n else h[:0]
            sets[i] = s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
    return sets


def retained(n: int) -> int:
    """How many of its smallest values a set of ``n`` must keep to share one with every similar set."""
    return n - -(-SIMILAR * n // 100) + 1 if n else 0


def bitmap(s: np.ndarray) -> bytes:
    """For every place of a power of two, whether an odd number of elements falls on it."""
    m = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * max(1, len(s)) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(bool), bitorder="little").tobytes()


def _folded(b: np.ndarray) -> np.ndarray:
    """Bitmaps (rows) of half the size: places that differ in the highest bit meet."""
    half = b.shape[-1] // 2
    return b[..., :half] ^ b[..., half:]


def _differ(x: np.ndarray, y: np.ndarray) -> int:
    """A number of elements by which two sets differ at least."""
    while len(x) > len(y):
        x = _folded(x)
    while len(y) > len(x):
        y = _folded(y)
    return int(np.bitwise_count(x ^ y).sum())


def _too_far(differ, a, b):
    """Whether sets of a and b elements that differ in so many can't be similar."""
    return (100 + SIMILAR) * differ > (100 - SIMILAR) * (a + b)


def node_of(text: Column, shared: tuple[int, ...] = ()) -> Column:
    """The node of a text: its hash, or another one where the first is among ``shared``."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.xxhash64(whole)
    return F.when(plain.isin(list(shared)), F.xxhash64(F.lit("again"), whole)).otherwise(plain) if shared else plain


def sketch(docs: DataFrame, words: int = WORDS, seed: int = 0) -> tuple[DataFrame, tuple[int, ...]]:
    """doc_id, node, check (a second hash of the text), n (set size), sketch (``retained`` smallest hashes and ``FILTER_K`` at least, ascending) and bitmap, saved; and the hashes that different texts share."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in slices(batch.column("text")):
                texts = raw_texts(batch.column("text").slice(a, b - a))
                sets = shingle_sets(texts, words, seed)
                check = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in texts]
                columns = [batch.column("doc_id").slice(a, b - a), batch.column("node").slice(a, b - a), pa.array(check, pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
                columns += [pa.array([s[: max(FILTER_K, retained(len(s)))].tobytes() for s in sets], pa.binary()), pa.array([bitmap(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=common.arrow_schema(SKETCH))

    shared: tuple[int, ...] = ()
    for _ in range(3):
        made = common.save(docs.select("doc_id", node_of(F.col("text"), shared).alias("node"), "text").mapInArrow(common.lean(run), SKETCH), "sketches")
        mixed = made.groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("node").collect()  # about rows ** 2 / 2 ** 65 of them
        if not mixed:
            return made, shared
        shared = tuple({*shared, *(r["node"] for r in mixed)})
    raise RuntimeError("different texts keep the same hashes")


def _fresh(batches, columns):
    """Python rows of ``columns`` whose node wasn't seen in this task before."""
    seen: set[int] = set()
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
            if row[0] not in seen:
                seen.add(row[0])
                yield row


def hot_values(sketches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The at most ``HOT`` most frequent retained values, ascending, and how many sketches hold each.

    Counts cover all sketches: each task counts its own, and the counts of a
    range of values meet in one task as packed arrays.
    """
    spark = sketches.sparkSession
    total_n = sketches.agg(F.sum(F.length("sketch"))).first()[0] or 0
    tasks = max(common.parts(spark), -(-total_n // (8 * PER_TASK)))
    ranges = 4 * tasks

    def local(batches):
        import pyarrow as pa

        schema = pa.schema([("range", pa.int32()), ("values", pa.binary()), ("counts", pa.binary())])

        def packed(held):
            v, c = np.unique(np.concatenate(held), return_counts=True)
            where = (v >> np.uint64(32)) % np.uint64(ranges)
            order = np.argsort(where, kind="stable")
            v, c, where = v[order], c[order], where[order].astype(np.int64)
            cut = np.searchsorted(where, np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(cut))
            many = lambda a, b: c[a:b].astype(np.uint32).tobytes() if (c[a:b] > 1).any() else b""
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([v[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary()), pa.array([many(cut[r], cut[r + 1]) for r in some], pa.binary())], schema=schema)

        held, size = [], 0
        for _, n, raw in _fresh(batches, ("node", "n", "sketch")):
            held.append(np.frombuffer(raw, np.uint64)[: retained(n)])
            size += len(held[-1])
            if size > PER_TASK:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def total(batches):
        import pyarrow as pa

        def top(values, counts):
            v, at = np.unique(np.concatenate(values), return_inverse=True)
            c = np.bincount(at, np.concatenate(counts)).astype(np.int64)
            v, c = v[c >= HOT_LEAST], c[c >= HOT_LEAST]
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c)], schema=common.arrow_schema("value long, n long"))

        for rows in common.runs(batches, "range", ("values", "counts")):
            values, counts = [], []
            for v, c in rows:
                values.append(np.frombuffer(v, np.uint64))
                counts.append(np.frombuffer(c, np.uint32).astype(np.int64) if c else np.ones(len(values[-1]), np.int64))
            yield top(values, counts)

    spread = sketches.select("node", "n", "sketch").mapInArrow(common.lean(local), "range int, values binary, counts binary")
    counted = spread.repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(common.lean(total), "value long, n long")
    most = counted.orderBy(F.desc("n"), "value").limit(HOT).collect()
    v, c = np.array([x["value"] for x in most], np.int64).view(np.uint64), np.array([x["n"] for x in most], np.int64)
    order = np.argsort(v)
    return v[order], c[order]


def postings(docs: DataFrame, sketches: DataFrame, words: int = WORDS, seed: int = 0, shared: tuple[int, ...] = ()) -> tuple[DataFrame, int]:
    """The inverted lists, packed by ranges of values (``PACKED``), and the number of tasks they are for.

    A document is listed under its first ``retained`` values, frequent ones last;
    its place in them counts from 1. A node may be listed again by another task.
    """
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_values(sketches))
    tasks = max(common.parts(spark), -(-int(sketches.agg(F.sum("n")).first()[0] or 0) * (100 - SIMILAR) // (100 * PER_TASK)))
    ranges = 4 * tasks

    def run(batches):
        import pyarrow as pa

        often, count = hot.value
        schema, seen = common.arrow_schema(PACKED), set()

        def packed(held):
            v = np.concatenate([x for _, _, x in held])
            size = np.array([len(x) for _, _, x in held])
            place = (np.arange(1, len(v) + 1) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint32)
            node, n = np.repeat(np.array([x for x, _, _ in held], np.int64), size), np.repeat(np.array([x for _, x, _ in held], np.uint32), size)
            deal = v >> np.uint64(32)
            if len(often):  # a list that is too long for one task goes to as many as it needs
                at = np.minimum(np.searchsorted(often, v), len(often) - 1)
                cut = np.where(often[at] == v, -(-count[at] // BLOCK), 1).astype(np.uint64)
                deal = np.where(cut > 1, mix(v ^ (mix(node.view(np.uint64)) % cut)) >> np.uint64(32), deal)
            where = (deal % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(cut))
            part = lambda x: pa.array([x[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(part(x[order]) for x in (v, node, n, place))], schema=schema)

        held, size = [], 0
        for batch in batches:
            for a, b in slices(batch.column("text")):
                nodes = batch.column("node").slice(a, b - a).to_pylist()
                new = [i for i, x in enumerate(nodes) if x not in seen and not seen.add(x)]
                texts = raw_texts(batch.column("text").slice(a, b - a))
                for i, v in zip(new, shingle_sets([texts[i] for i in new], words, seed), strict=True):
                    if not len(v):
                        continue
                    n, keep = len(v), retained(len(v))
                    if len(often):
                        at = np.minimum(np.searchsorted(often, v), len(often) - 1)
                        c = np.where(often[at] == v, count[at], 0)
                        v = v[np.argsort(c, kind="stable")] if c.any() else v
                    held.append((nodes[i], n, v[:keep]))
                    size += keep
                    if size > PER_TASK // 2:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)

    return docs.select(node_of(F.col("text"), shared).alias("node"), "text").mapInArrow(common.lean(run), PACKED), tasks


def _may_be_near(n: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows x, y of a list can be similar by their sizes and by the values that follow their places."""
    a, b = n[x], n[y]
    near = 100 * np.minimum(a, b) >= SIMILAR * np.maximum(a, b)
    return near & (1 + np.minimum(a - place[x], b - place[y]) >= -(-SIMILAR * (a + b) // (100 + SIMILAR)))


def _pair_batch(a, b, kind, schema):
    import pyarrow as pa

    low, high = _different(np.minimum(a, b), np.maximum(a, b))
    n = len(low)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(low), pa.array(high), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32))], schema=schema)


def meet(lists: DataFrame, tasks: int) -> DataFrame:
    """Rows (kind, a, b, n, place) from packed lists: kind 0, the pair a < b met; kind 1, node b of size n has this place in the long list a."""

    def run(batches):
        import pyarrow as pa

        schema = common.arrow_schema(MET)
        kinds = (np.uint64, np.int64, np.uint32, np.uint32)
        for rows in common.runs(batches, "range", ("values", "nodes", "sizes", "places")):
            value, node, n, place = (np.concatenate([np.frombuffer(x, k) for x in column]) for column, k in zip(zip(*rows, strict=True), kinds, strict=True))
            order = np.argsort(value, kind="stable")
            same = value[order][1:] == value[order][:-1]
            order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # most values are in one set only
            order = order[np.lexsort((node[order], value[order]))]
            value, node, n, place = value[order], node[order], n[order].astype(np.int64), place[order].astype(np.int64)
            keep = np.concatenate([[True], (value[1:] != value[:-1]) | (node[1:] != node[:-1])]) if len(value) else np.zeros(0, bool)
            value, node, n, place = value[keep], node[keep], n[keep], place[keep]
            if not len(value):
                continue
            first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            size = np.diff(np.append(first, len(value)))
            left, right = [], []
            for s in np.unique(size[(size > 1) & (size <= LIST)]).tolist():
                at = first[size == s][:, None] + np.arange(s)
                i, j = np.triu_indices(s, 1)
                x, y = at[:, i].ravel(), at[:, j].ravel()
                near = _may_be_near(n, place, x, y)
                left.append(node[x[near]])
                right.append(node[y[near]])
            long = [(f, s) for f, s in zip(first[size > LIST].tolist(), size[size > LIST].tolist(), strict=True)]
            for f, s in long:
                by_size = f + np.argsort(n[f : f + s], kind="stable")
                all_of = np.arange(f, f + s)
                for pivot in {f, int(by_size[0])}:
                    near = _may_be_near(n, place, all_of, np.full(s, pivot)) & (all_of != pivot)
                    left.append(node[f : f + s][near])
                    right.append(np.full(near.sum(), node[pivot]))
            if long:
                members = np.concatenate([np.arange(f, f + s) for f, s in long])
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(members), np.int32)), pa.array(value[members].view(np.int64)), pa.array(node[members]), pa.array(n[members]), pa.array(place[members].astype(np.int32))], schema=schema)
            if left:
                yield _pair_batch(np.concatenate(left), np.concatenate(right), 0, schema)

    return lists.repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(common.lean(run), MET)


def _merged(members: DataFrame) -> DataFrame:
    """Long lists (value, node, n, place) with those of the same members taken together, as the values of a passage have; each node at its first place.

    Lists are told apart by two sums over their members; taking others together
    too would only bring more pairs about.
    """
    both = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"sum{k}") for k in (0, 1)]
    of = members.groupBy("value").agg(F.count(F.lit(1)).alias("size"), *both).select(F.col("value").alias("of_value"), F.xxhash64("size", "sum0", "sum1").alias("list"))
    return members.join(of, members["value"] == of["of_value"]).groupBy(F.col("list").alias("value"), "node").agg(F.max("n").alias("n"), F.min("place").alias("place"))


def _apart(members: DataFrame, maps: DataFrame, star: int) -> DataFrame:
    """Different pairs (a, b) of long lists (value, node, n, place, label) that may be near and have different labels; ``maps`` holds the bitmaps of nodes.

    With ``star`` only the pairs of so many members of a list's most common
    label and so many others, the first by hash; else all. A list of more than
    ``BLOCK`` members is dealt into parts, and without ``star`` each two parts
    meet. A task packs its pairs into arrays by a range of the first node, where
    the same pairs of all tasks meet.
    """
    spark = members.sparkSession
    tasks = common.parts(spark)
    ranges = 4 * tasks
    packed, columns = "range int, pairs binary", ("node", "n", "place", "label", "part", "bitmap")

    def pack(held):
        import pyarrow as pa

        low, high = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
        low, high = _different(np.minimum(low, high), np.maximum(low, high))
        where = (mix(low.view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        both, cut = np.stack([low, high], axis=1)[order], np.searchsorted(where[order], np.arange(ranges + 1))
        some = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([both[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary())], schema=common.arrow_schema(packed))

    def run(batches):
        held, size = [], 0
        for rows in common.runs(batches, "block", columns):  # sorted by n
            node, n, place, label, part = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:5])
            maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # bits -> rows, their bitmaps
            lengths = np.array([len(r[5]) for r in rows])
            for m in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == m)
                maps[m] = at, np.frombuffer(b"".join(rows[i][5] for i in at.tolist()), np.uint64).reshape(len(at), -1)
            row_of = np.zeros(len(rows), np.int64)
            for at, _ in maps.values():
                row_of[at] = np.arange(len(at))

            def far(i, to):
                """Which of ``to`` differ from i in too many elements; sizes are so near that a bitmap is folded once at most."""
                out, m = np.zeros(len(to), bool), int(lengths[i])
                mine = maps[m][1][row_of[i]]
                for other in np.unique(lengths[to]).tolist():
                    some = np.flatnonzero(lengths[to] == other)
                    theirs, own = maps[other][1][row_of[to[some]]], mine
                    while theirs.shape[1] > len(own):
                        theirs = _folded(theirs)
                    while len(own) > theirs.shape[1]:
                        own = _folded(own)
                    out[some] = _too_far(np.bitwise_count(theirs ^ own).sum(axis=1, dtype=np.int64), n[i], n[to[some]])
                return out

            e = len(node)
            if star:
                names, count = np.unique(label, return_counts=True)
                most = label == names[count.argmax()]
                order = np.argsort(mix(node.view(np.uint64)))
                pivots = np.concatenate([order[most[order]][:star], order[~most[order]][:star]])
                from_to = ((i, np.arange(e)) for i in pivots.tolist())
            else:
                from_to = ((i, np.arange(i + 1, i + 1 + int(np.searchsorted(n[i + 1 :], 100 * n[i] // SIMILAR, side="right")))) for i in range(e - 1))
            for i, to in from_to:
                other = to[label[to] != label[i]]
                if not star and part[0] != part[-1]:  # two parts of a list: pairs within one have their own task
                    other = other[part[other] != part[i]]
                other = other[_may_be_near(n, place, other, np.full(len(other), i))]
                other = other[~far(i, other)] if len(other) else other
                if len(other):
                    held.append((np.full(len(other), node[i]), node[other]))
                    size += len(other)
                    if size > PER_TASK:
                        yield pack(held)
                        held, size = [], 0
        if size:
            yield pack(held)

    def unpack(batches):
        import pyarrow as pa

        for rows in common.runs(batches, "range", ("pairs",)):
            both = np.concatenate([np.frombuffer(x, np.int64) for x, in rows]).reshape(-1, 2)
            low, high = _different(both[:, 0], both[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], schema=common.arrow_schema("a long, b long"))

    sizes = members.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt = members.join(sizes, "value").withColumn("part", F.pmod(F.xxhash64("node", F.lit(star)), "parts").cast("long"))
    if star:
        blocks = dealt.withColumn("block", F.xxhash64("value", "part"))
    else:
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))
        blocks = dealt.withColumn("_other", other).withColumn("block", F.xxhash64("value", F.least("part", "_other"), F.greatest("part", "_other")))
    placed = blocks.join(maps, "node").select("block", *columns).repartition(tasks, "block").sortWithinPartitions("block", "n", "node")
    return placed.mapInArrow(common.lean(run), packed).repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(common.lean(unpack), "a long, b long")


def _different(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order, each once."""
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(low) else np.zeros(0, bool)
    return low[new], high[new]


def _likely(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs that their union sketches, and where those can't decide their bitmaps, don't rule out.

    The sketch of the union holds its smallest values: what it shows of both sets
    is exact, and of what it doesn't show each set has a known number left. Where
    even those all being shared would be too few, the pair goes; a union that fits
    into its sketch is decided there. Pairs estimated at SURE skip the bitmaps.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for (x, y), (v, w), a, b in zip(zip(batch.column("x"), batch.column("y"), strict=True), zip(batch.column("v"), batch.column("w"), strict=True), batch.column("n").to_pylist(), batch.column("m").to_pylist(), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                full = min(len(p), len(q), FILTER_K)
                union = np.union1d(p, q)[:full]  # the sketch of the union
                of_p, of_q = np.isin(union, p, assume_unique=True), np.isin(union, q, assume_unique=True)
                both = int((of_p & of_q).sum())
                most = both + min(a - int(of_p.sum()), b - int(of_q.sum()))
                if (100 + SIMILAR) * most < SIMILAR * (a + b):
                    keep.append(False)
                    continue
                keep.append(both >= SURE * max(1, full) or not _too_far(_differ(np.frombuffer(v.as_buffer(), np.uint64), np.frombuffer(w.as_buffer(), np.uint64)), a, b))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=common.arrow_schema("a long, b long")).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(heads, pairs["a"] == heads["node"]).select("a", "b", F.col("head").alias("x"), F.col("bitmap").alias("v"), "n")
    two = one.join(heads.withColumnRenamed("n", "m"), one["b"] == heads["node"]).select("a", "b", "x", "v", "n", F.col("head").alias("y"), F.col("bitmap").alias("w"), "m")
    return two.mapInArrow(common.lean(run), "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int = WORDS, seed: int = 0, shared: tuple[int, ...] = ()) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets are similar enough."""

    def sets(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            for a, b in slices(batch.column("text")):
                ids = batch.column("node").slice(a, b - a).to_pylist()
                texts = raw_texts(batch.column("text").slice(a, b - a))
                new = [k for k, i in enumerate(ids) if i not in seen and not seen.add(i)]
                if new:
                    made = shingle_sets([texts[k] for k in new], words, seed)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in new], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], schema=common.arrow_schema("node long, whole binary"))

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):  # no copies: sets can be long
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(100 * both >= SIMILAR * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=common.arrow_schema("a long, b long")).filter(pa.array(keep, pa.bool_()))

    wanted = common.save(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)
    texts = docs.select(node_of(F.col("text"), shared).alias("node"), "text").join(wanted, "node", "left_semi")
    whole = texts.select("node", "text").mapInArrow(common.lean(sets), "node long, whole binary").dropDuplicates(["node"])
    one = pairs.join(whole, pairs["a"] == whole["node"]).select("a", "b", F.col("whole").alias("x"))
    two = one.join(whole, one["b"] == whole["node"]).select("a", "b", "x", F.col("whole").alias("y"))
    return two.mapInArrow(common.lean(verify), "a long, b long")


def links(docs: DataFrame, sketches: DataFrame, words: int = WORDS, seed: int = 0, shared: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) between nodes, and the components (node, label) that they make."""
    how = (words, seed, shared)
    lists, tasks = postings(docs, sketches, *how)
    found_met = common.save(meet(lists, tasks), "met")
    tested = common.save(found_met.where("kind = 0").select("a", "b").distinct(), "pairs")
    heads = sketches.select("node", "n", F.substring("sketch", 1, 8 * FILTER_K).alias("head"), "bitmap").dropDuplicates(["node"])
    edges = common.save(_confirmed(common.save(_likely(tested, heads), "likely"), docs, *how), "links")
    found = common.save(components(edges), "components")
    listed_in = common.save(_merged(found_met.where("kind = 1").select(F.col("a").alias("value"), F.col("b").alias("node"), "n", "place").distinct()), "long-lists")
    maps = sketches.select("node", "bitmap").dropDuplicates(["node"])
    for turn, star in enumerate((*STARS, 0)):
        some = listed_in.where(F.shiftrightunsigned("value", 7).bitwiseAND(F.lit(STAR_SHARE - 1)) == turn) if star else listed_in
        long = some.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = long.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("value")
        members = common.save(long.join(mixed, "value").select("value", "node", "n", "place", "label"), "members")
        apart = common.save(_apart(members, maps, star).join(tested, ["a", "b"], "left_anti"), "apart")
        if apart.isEmpty():
            continue
        tested = tested.unionByName(apart)
        more = common.save(_confirmed(apart, docs, *how), "links")
        if not more.isEmpty():
            edges = edges.unionByName(more)
            found = common.save(components(edges), "components")
    return edges, found


def _labelled(docs: DataFrame, words: int) -> tuple[DataFrame, tuple[int, ...]]:
    """doc_id, node, n_shingles, component_id, kept of every row, and the hashes that different texts share."""
    seed = int.from_bytes(os.urandom(8), "little")  # nobody can write texts that collide; results don't depend on it
    sketches, shared = sketch(docs, words, seed)
    _, found = links(docs, sketches, words, seed, shared)
    texts = sketches.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    labelled = texts.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    of_node = labelled.join(smallest, "label").select("node", "component_id")
    out = sketches.select("doc_id", "node", F.col("n").alias("n_shingles")).join(of_node, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "node", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")), shared


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; others ignored).

    Null and wordless texts have no shingles, stay alone and are kept. Rows
    with equal texts are one component. component_id is the smallest doc_id of
    the component (null only where all are null); kept is doc_id =
    component_id, so rows repeating that doc_id are all kept. An empty table
    gives no rows.
    """
    return _labelled(common.unique_columns(docs, "doc_id", "text"), words)[0].drop("node")


def without_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` doesn't keep, all columns kept.

    Null, empty and wordless texts stay; of repeated rows those stay that carry
    the component's doc_id. An empty table gives no rows.
    """
    found, shared = _labelled(common.unique_columns(docs, "doc_id", "text"), words)
    key, node = common.own_names(docs, "id", "node")
    gone = common.save(found.where("not kept").select(F.col("doc_id").alias(key), F.col("node").alias(node)).distinct(), "duplicates")
    if gone.count() <= SENT:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(key)) & (node_of(docs["text"], shared) == F.col(node)), "left_anti")
