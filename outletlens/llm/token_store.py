"""Token-ID output: raw id payloads with a minimal perfect hash index per shard.

Documents are range-partitioned by key, so shards follow ascending doc_id.
Each task streams its documents through the tokenizer into one payload file
and then writes one index file beside it:

* ``<shard>.bin``: the ids of all its documents, little-endian unsigned 16- or
  32-bit numbers (16 when the vocabulary fits), nothing else;
* ``<shard>.idx``: a line of JSON that says where each array is, then the
  arrays: ``bounds`` (id offset of each document and the end), ``keys`` (doc_ids
  in file order, for scans), and of the minimal perfect hash the level ``sizes``,
  ``bits`` (in words of 64) and ``ranks`` (bits set before each 512), and for each
  slot the ``fingerprint`` of its key and the ordinal ``first`` of its first document.

One key is found with a fixed number of small reads, however large the shard is.
Shards are named by their partition: a task that runs again after a lost
executor writes under a name of its own and then takes the place of what was
there; names that were never taken up are deleted at the end.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from outletlens.llm import common
from outletlens.llm.pieces import encoder, mix, raw_texts, slices

#: Bits of a level of the hash for each key that is still without a slot.
GAMMA = 2
LEVELS = 40


def _level_hash(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix(keys ^ salt) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """32 bits of a hash that the levels don't use."""
    return (mix(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a cascade of collision-free bit levels.

    A key's slot is the rank of its bit among all bits set so far, found with
    one stored count for each 512 bits: constant time, about 4 bits a key.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray | None = None) -> None:
        self.sizes, self.bits = sizes, bits
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        if ranks is None:
            counts = np.bitwise_count(bits).reshape(-1, 8).sum(axis=1, dtype=np.int64)
            ranks = np.cumsum(counts) - counts
        self.ranks = ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, GAMMA * len(left))
            at = _level_hash(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys aren't distinct")
        flat = np.packbits(np.concatenate(levels), bitorder="little") if levels else np.zeros(0, np.uint8)
        return cls(np.array(sizes, np.int64), np.concatenate([flat, np.zeros(-len(flat) % 64, np.uint8)]).view("<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some keys that were never in the set."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            bit = self.first[level] + _level_hash(keys[left], level, size)
            hit = (self.bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[hit]] = self._rank(bit[hit])
            left = left[~hit]
        return out

    def _rank(self, bit: np.ndarray) -> np.ndarray:
        block, word = bit >> 9, bit >> 6
        out = self.ranks[block].copy()
        for k in range(7):  # the whole words before the bit's own
            at = (block << 3) + k
            out += np.where(at < word, np.bitwise_count(self.bits[at]), 0)
        below = (np.uint64(1) << (bit & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(self.bits[word] & below)


def _files(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _write_shards(root: str, tokenizer: str, style: str, end_id: int):
    def write(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        store, base = _files(root)
        part = TaskContext.get().partitionId()
        name, own, attempt = f"part-{part:06d}", None, uuid.uuid4().hex
        counts, keys, nulls, total = [], [], 0, 0
        for batch in batches:
            if own is None:
                store.create_dir(base, recursive=True)
                own = store.open_output_stream(f"{base}/_{attempt}.bin")
            text, ids = batch.column("text"), batch.column("doc_id")
            for a, b in slices(text):
                enc = encoder(tokenizer, style)
                flat, bounds = enc.encode(raw_texts(text.slice(a, b - a)))
                n = np.diff(bounds) + 1
                out = np.empty(len(flat) + len(n), np.uint32 if end_id > 65535 else enc.dtype)
                last = np.cumsum(n) - 1
                inner = np.ones(len(out), bool)
                inner[last] = False
                out[inner], out[last] = flat, end_id
                own.write(out.astype(out.dtype.newbyteorder("<")).tobytes())
                counts.append(n)
                total += len(out)
                width = out.dtype.itemsize
            nulls += ids.null_count
            keys.append(ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        if own is None:
            return
        own.close()
        keys, bounds = np.concatenate(keys), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        distinct, first = np.unique(keys, return_index=True)
        perfect = PerfectHash.build(distinct.view(np.uint64))
        slot = perfect.slots(distinct.view(np.uint64))
        mark, at = np.empty(len(slot), np.uint32), np.empty(len(slot), np.int64)
        mark[slot], at[slot] = fingerprints(distinct.view(np.uint64)), first + nulls
        arrays = {"bounds": bounds, "keys": keys, "sizes": perfect.sizes, "bits": perfect.bits, "ranks": perfect.ranks, "fingerprint": mark, "first": at}
        with store.open_output_stream(f"{base}/_{attempt}.idx") as f:
            _write_index(f, arrays, {"nulls": nulls, "width": width})
        for kind in ("bin", "idx"):
            store.move(f"{base}/_{attempt}.{kind}", f"{base}/{name}.{kind}")
        low, high = (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)
        yield pa.RecordBatch.from_pylist([{"part": part, "shard": name, "low": low, "high": high, "nulls": nulls, "n_docs": len(bounds) - 1, "n_ids": total}], schema=common.arrow_schema(MANIFEST))

    return write


def _write_index(f, arrays: dict[str, np.ndarray], more: dict) -> None:
    """A line of JSON with kind, place and length of each array, then the arrays."""
    at, places = 0, {}
    for name, x in arrays.items():
        x = arrays[name] = x.astype(x.dtype.newbyteorder("<"))
        places[name] = [x.dtype.str, at, len(x)]
        at += x.nbytes
    f.write(json.dumps({"arrays": places} | more).encode() + b"\n")
    for x in arrays.values():
        f.write(x.tobytes())


MANIFEST = "part long, shard string, low long, high long, nulls long, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write(docs: DataFrame, root: str, tokenizer: str, style: str = "byte", end_id: int = 0) -> DataFrame:
    """Encode ``docs`` (doc_id, text; others ignored) into shards under ``root``; return the saved manifest.

    Null text counts as empty: its document holds ``end_id`` alone. Documents
    with a null doc_id come first; rows that repeat a doc_id stay together, in
    the order of their texts. An empty table gives an empty manifest. ``root``
    is a URI that pyarrow can open on every executor.
    """
    spark = docs.sparkSession
    rows = common.unique_columns(docs, "doc_id", "text")
    dealt = rows.repartitionByRange(common.parts(spark), F.asc_nulls_first("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
    manifest = common.save(dealt.mapInArrow(_write_shards(root, tokenizer, style, end_id), MANIFEST), "manifest")
    store, base = _files(root)
    from pyarrow import fs

    for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if info.base_name.startswith("_"):  # left by attempts that were lost
            store.delete_file(info.path)
    return manifest


class Shard:
    """One shard, opened for keyed access: its index is read array by array or, for one key, a few bytes at a time."""

    def __init__(self, root: str, name: str) -> None:
        store, base = _files(root)
        self.idx, self.file = store.open_input_file(f"{base}/{name}.idx"), store.open_input_file(f"{base}/{name}.bin")
        head = self.idx.read(1 << 12).split(b"\n", 1)[0]
        self.start, said = len(head) + 1, json.loads(head)
        self.places, self.nulls = said["arrays"], said["nulls"]
        self.dtype = np.dtype("<u2" if said["width"] == 2 else "<u4")
        self.held: dict[str, np.ndarray] = {}

    def part(self, name: str, a: int, b: int) -> np.ndarray:
        """Entries a to b of an array, read from the file."""
        kind, at, _ = self.places[name]
        kind = np.dtype(kind)
        return np.frombuffer(self.idx.read_at((b - a) * kind.itemsize, self.start + at + a * kind.itemsize), kind)

    def whole(self, name: str) -> np.ndarray:
        if name not in self.held:
            self.held[name] = self.part(name, 0, self.places[name][2])
        return self.held[name]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ordinal of each key's first document; -1 where the fingerprint says that there is none."""
        raw = np.asarray(keys, np.int64).view(np.uint64)
        slot = PerfectHash(self.whole("sizes"), self.whole("bits"), self.whole("ranks")).slots(raw)
        if not len(self.whole("first")):
            return slot
        known = (slot >= 0) & (self.whole("fingerprint")[slot] == fingerprints(raw))
        return np.where(known, self.whole("first")[slot], -1)

    def find_one(self, key: int) -> int:
        """``find`` of one key: one word of bits for each level, then 64 bytes, a count, a fingerprint and an ordinal are read."""
        raw, first = np.array([key], np.int64).view(np.uint64), 0
        for level, size in enumerate(self.whole("sizes").tolist()):
            bit = first + int(_level_hash(raw, level, size)[0])
            if int(self.part("bits", bit >> 6, (bit >> 6) + 1)[0]) >> (bit & 63) & 1:
                block = bit >> 9
                words = self.part("bits", 8 * block, 8 * block + 8)
                inside = sum(int(w).bit_count() for w in words[: (bit >> 6) & 7]) + (int(words[(bit >> 6) & 7]) & (1 << (bit & 63)) - 1).bit_count()
                slot = int(self.part("ranks", block, block + 1)[0]) + inside
                return int(self.part("first", slot, slot + 1)[0]) if self.part("fingerprint", slot, slot + 1)[0] == fingerprints(raw)[0] else -1
            first += size
        return -1

    def ids(self, ordinal: int, to: int | None = None) -> np.ndarray:
        """Ids of one document, or of all from ``ordinal`` up to ``to``."""
        a, b = (int(x) for x in (self.part("bounds", ordinal, ordinal + 2) if to is None else self.whole("bounds")[[ordinal, to]]))
        return np.frombuffer(self.file.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)


def _read_shards(root: str):
    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(root, row["shard"])
                bounds, keys, nulls = shard.whole("bounds"), shard.whole("keys"), shard.nulls
                first = shard.find(keys)
                if (first < nulls).any():
                    raise ValueError(f"{row['shard']}: a key isn't in its index")
                same = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
                run = np.arange(len(keys)) - np.maximum.accumulate(np.where(same, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)
                ordinal = np.concatenate([np.arange(nulls), first + run])
                step = 4096
                for a in range(0, len(ordinal), step):
                    some = ordinal[a : a + step]
                    crc = []
                    low, high = int(some.min()), int(some.max()) + 1
                    flat = shard.ids(low, high)
                    for o in some.tolist():
                        crc.append(zlib.crc32(flat[bounds[o] - bounds[low] : bounds[o + 1] - bounds[low]].astype("<u4").tobytes()))
                    ids = [None] * max(0, min(nulls, a + step) - a) + keys[max(0, a - nulls) : max(0, a + step - nulls)].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bounds[some] + row["before"]), pa.array(bounds[some + 1] - bounds[some]), pa.array(crc, pa.int64())], schema=common.arrow_schema(READ))

    return read


def read_back(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """Every document of the shards, fetched through each shard's index: doc_id, start, n_tokens, ids_crc32."""
    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each shard
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    return placed.repartition(common.parts(spark), "shard").mapInArrow(_read_shards(root), READ)


def lookup(manifest: DataFrame, keys: DataFrame, root: str) -> DataFrame:
    """The ids of given doc_ids (column doc_id): each key goes to the shards whose range holds it.

    Returns doc_id and ids (array of long) of its first document in file order;
    null keys, repeats of a key and keys in no shard give no further row.
    """
    import pyarrow as pa

    def fetch(batches):
        name, shard = None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["shard"] != name:
                    name, shard = row["shard"], Shard(root, row["shard"])
                o = shard.find_one(row["doc_id"])
                if o >= 0:
                    found.append({"doc_id": row["doc_id"], "part": row["part"], "ids": shard.ids(o).tolist()})
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    wanted = keys.select("doc_id").where("doc_id is not null").distinct()
    placed = wanted.join(manifest, (F.col("doc_id") >= F.col("low")) & (F.col("doc_id") <= F.col("high"))).select("doc_id", "part", "shard")
    found = placed.repartition("shard", "doc_id").sortWithinPartitions("shard").mapInArrow(fetch, "doc_id long, part long, ids array<long>")
    return found.groupBy("doc_id").agg(F.min_by("ids", "part").alias("ids"))
