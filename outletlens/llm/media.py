"""ISO media containers: a writer for raw samples and a box walker that never decodes them.

A container holds one track. ``ftyp``, then ``moov`` with ``mvhd`` and one
``trak`` (``tkhd``, ``mdia``: ``mdhd``, ``hdlr``, ``minf``: ``smhd``, ``dinf``, ``stbl``: ``stsd``,
``stts``, ``stss``, ``stsc``, ``stsz``, ``co64``), then ``mdat``. Samples are blocks of 192
bytes of 8-bit audio (codec ``raw ``); every 64th is marked as a sync sample
and 16 make a chunk. No times of day are stored, so equal payloads give equal
files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from outletlens.llm import common
from outletlens.llm.pieces import raw_texts, slices

BLOCK = 192
RATE = 48_000
KEY_EVERY = 64
CHUNK = 16
#: Boxes whose payload is boxes again, with the bytes before the first of them.
PARENTS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of the block size."""
    return raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)


def mux(payload: bytes) -> bytes:
    """A container whose samples are the blocks of ``payload``."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("the payload isn't a positive multiple of the block size")
    n = len(payload) // BLOCK
    chunks = -(-n // CHUNK)
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0), b"isomiso2")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16 & 0xFFFFFFFF))
    runs = [(1, CHUNK)] if n % CHUNK == 0 or chunks == 1 else [(1, CHUNK), (chunks, n % CHUNK)]
    if chunks == 1:
        runs = [(1, n)]

    def moov(at: int) -> bytes:
        offsets = (at + np.arange(chunks, dtype=np.int64) * CHUNK * BLOCK).astype(">u8").tobytes()
        keys = np.arange(1, n + 1, KEY_EVERY, dtype=np.int64).astype(">u4").tobytes()
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, BLOCK)),
            _full(b"stss", struct.pack(">I", len(keys) // 4), keys),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, k, 1) for a, k in runs)),
            _full(b"stsz", struct.pack(">II", BLOCK, n)),
            _full(b"co64", struct.pack(">I", chunks), offsets),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, n * BLOCK, 0x55C4, 0), version=1),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl),
        )
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n * BLOCK), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), unity, bytes(8), version=1, flags=3)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, n * BLOCK, 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    large = len(payload) + 8 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    size = len(moov(0))
    return b"".join((ftyp, moov(len(ftyp) + size + len(head)), head, payload))


#: Boxes inside one another; real files have under ten. More is a broken container, and told as such.
DEEPEST = 1000


def walk(data: memoryview, start: int = 0, end: int | None = None):
    """(path, first byte, end) of every box's payload, outer boxes first; payloads aren't read."""
    todo = [(start, len(data) if end is None else end, b"")]
    while todo:
        start, end, path = todo.pop()
        if start + 8 > end:
            continue
        size, kind, head = int.from_bytes(data[start : start + 4], "big"), bytes(data[start + 4 : start + 8]), 8
        if size == 1:
            size, head = int.from_bytes(data[start + 8 : min(end, start + 16)], "big"), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has a bad size")
        inner = path + b"/" + kind
        yield inner, start + head, start + size
        todo.append((start + size, end, path))
        if kind in PARENTS:
            if len(inner) > 5 * DEEPEST:
                raise ValueError(f"boxes nest more than {DEEPEST} deep")
            todo.append((start + head + PARENTS[kind], start + size, inner))


def probe(media: bytes) -> dict:
    """Codec, duration and byte ranges of the tracks of a container, from its boxes and sample tables alone.

    The result has ``brand``, ``seconds`` and ``tracks``: for each track that has
    sample tables ``codec``, ``timescale``, ``duration`` (the sum of its samples',
    or what the header says where there is no table of them), ``samples`` (array
    of first byte and size of each), ``keyframes`` (numbers, from 0, of sync
    samples; all where no table lists them). What is no container, or one whose
    tables don't fit together, is a ValueError; no track is none.
    """
    try:
        return _probe(memoryview(media))
    except (struct.error, IndexError, KeyError, UnicodeDecodeError) as e:
        raise ValueError(f"broken container: {e!r}") from e


def _probe(data: memoryview) -> dict:
    tracks, brand, seconds = [], "", 0.0

    def u4(at, n):
        if n < 0 or at + 4 * n > len(data):
            raise ValueError("a table ends beyond its file")
        return np.frombuffer(data, ">u4", n, at).astype(np.int64)

    for path, a, b in walk(data):
        kind = path.rpartition(b"/")[2]
        if kind == b"ftyp":
            brand = bytes(data[a : a + 4]).decode("latin-1")
        elif kind == b"mvhd":
            scale, length = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
            seconds = length / scale if scale else 0.0
        elif kind == b"trak":
            tracks.append({})
        elif not tracks:
            continue
        elif kind == b"mdhd":
            tracks[-1]["timescale"], tracks[-1]["duration"] = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        elif kind == b"stsd":
            tracks[-1]["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1")
        elif kind == b"stts":
            runs = u4(a + 8, 2 * int(u4(a + 4, 1)[0])).reshape(-1, 2)
            tracks[-1]["times"] = int((runs[:, 0] * runs[:, 1]).sum())
        elif kind == b"stss":
            tracks[-1]["stss"] = u4(a + 8, int(u4(a + 4, 1)[0])) - 1
        elif kind == b"stsz":
            one, n = map(int, u4(a + 4, 2))
            if one * n > len(data):
                raise ValueError("more samples than bytes")
            tracks[-1]["sizes"] = np.full(n, one, np.int64) if one else u4(a + 12, n)
        elif kind == b"stz2":
            bits, n = data[a + 7], int(u4(a + 8, 1)[0])
            if bits not in (4, 8, 16) or n * bits > 8 * (b - a):
                raise ValueError("a table ends beyond its file")
            raw = np.frombuffer(data, ">u2" if bits == 16 else "u1", -(-n * bits // (16 if bits == 16 else 8)), a + 12).astype(np.int64)
            tracks[-1]["sizes"] = (np.stack([raw >> 4, raw & 15], axis=1).ravel() if bits == 4 else raw)[:n]
        elif kind == b"stsc":
            tracks[-1]["stsc"] = u4(a + 8, 3 * int(u4(a + 4, 1)[0])).reshape(-1, 3)
        elif kind in (b"stco", b"co64"):
            n = int(u4(a + 4, 1)[0])
            if kind == b"co64":
                u4(a + 8, 2 * n)
            tracks[-1]["chunks"] = u4(a + 8, n) if kind == b"stco" else np.frombuffer(data, ">u8", n, a + 8).astype(np.int64)
    tracks = [t for t in tracks if {"sizes", "chunks", "stsc"} <= t.keys()]
    for t in tracks:
        sizes, chunks, runs = t.pop("sizes"), t.pop("chunks"), t.pop("stsc")
        spans = np.diff(np.append(runs[:, 0], len(chunks) + 1))
        if (spans < 0).any() or (len(chunks) and (not len(runs) or runs[0, 0] != 1)) or (spans * runs[:, 1]).sum() != len(sizes):
            raise ValueError("chunks and samples don't fit together")
        chunk = np.repeat(np.arange(len(chunks)), np.repeat(runs[:, 1], spans))
        before = np.cumsum(sizes) - sizes
        first = np.searchsorted(chunk, np.arange(len(chunks)))
        at = chunks[chunk] + before - (before[np.minimum(first, len(sizes) - 1)][chunk] if len(sizes) else 0)
        if len(at) and (at.min() < 0 or (at + sizes).max() > len(data)):
            raise ValueError("a sample lies beyond its file")
        t["samples"] = np.stack([at, sizes], axis=1)
        t["keyframes"] = t.pop("stss", np.arange(len(sizes)))
        if len(t["keyframes"]) and (t["keyframes"].min() < 0 or t["keyframes"].max() >= len(sizes)):
            raise ValueError("a sync sample is none of the samples")
        t["duration"] = t.pop("times", t.get("duration", 0))
        t.setdefault("codec", "")
        t.setdefault("timescale", 0)
    return {"brand": brand, "seconds": seconds, "tracks": tracks}


def payload_of(media: bytes) -> bytes:
    """The samples of the first track, read back in their order; nothing without a track."""
    tracks = probe(media)["tracks"]
    if not tracks:
        return b""
    data, s = memoryview(media), tracks[0]["samples"]
    if len(s) and (s[1:, 0] == s[:-1, 0] + s[:-1, 1]).all():
        return bytes(data[int(s[0, 0]) : int(s[-1].sum())])
    return b"".join(bytes(data[a : a + n]) for a, n in s.tolist())


ENCODED = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, seconds double, n_keyframes long, error string"


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the container (``media``) of every text.

    Null text is stored as the empty one; equal texts give equal containers;
    texts of any length are stored whole; an empty table gives no rows.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in slices(batch.column("text")):
                raw = raw_texts(batch.column("text").slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(list(map(len, raw)), pa.int64()), pa.array([mux(pad(x)) for x in raw], pa.binary())], schema=common.arrow_schema(ENCODED))

    return common.unique_columns(docs, "doc_id", "text").mapInArrow(run, ENCODED)


def stored(docs: DataFrame) -> DataFrame:
    """The media table of ``encode``, written to the shared folder."""
    return common.save(encode(docs), "media", "zstd")


def _keyframe_ranges(track: dict) -> np.ndarray:
    """(number of the keyframe, first byte, end) of every run of bytes from one keyframe to the next; samples of other tracks between them cut it."""
    s, k = track["samples"], np.sort(track["keyframes"])
    if not len(k):
        return np.zeros((0, 3), np.int64)
    s, group = s[k[0] :], np.searchsorted(k, np.arange(k[0], len(s)), side="right") - 1
    begins = np.concatenate([[True], (s[1:, 0] != s[:-1, 0] + s[:-1, 1]) | (group[1:] != group[:-1])])
    at = np.flatnonzero(begins)
    last = np.append(at[1:], len(s)) - 1
    return np.stack([k[group[at]], s[at, 0], s[last].sum(axis=1)], axis=1)


KEYFRAMES = "doc_id long, codec string, keyframe long, first_byte long, end_byte long"


def keyframes(media: DataFrame) -> DataFrame:
    """One row for each run of bytes of a keyframe and what follows it: doc_id, codec, keyframe (number), first_byte, end_byte.

    Null media, what is no container and containers without a track give no
    rows; repeated rows give repeated results; an empty table gives no rows.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in slices(batch.column("media")):
                for i, m in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), batch.column("media").slice(a, b - a).to_pylist(), strict=True):
                    try:
                        tracks = probe(m)["tracks"] if m is not None else []
                    except ValueError:
                        tracks = []
                    for t in tracks:
                        r = _keyframe_ranges(t)
                        yield pa.RecordBatch.from_arrays([pa.array([i] * len(r), pa.int64()), pa.array([t["codec"]] * len(r), pa.string()), *(pa.array(r[:, c]) for c in range(3))], schema=common.arrow_schema(KEYFRAMES))

    return media.select("doc_id", "media").mapInArrow(run, KEYFRAMES)


def _features(i, n, m) -> tuple:
    """A row of ``FEATURES``."""
    try:
        found = probe(m) if m is not None else {"tracks": []}
        error = None if found["tracks"] else "no track" if m is not None else "no media"
    except ValueError as e:
        found, error = {"tracks": []}, str(e)
    size, digest = (len(m), hashlib.sha256(m).hexdigest()) if m is not None else (None, None)
    if not found["tracks"]:
        return (i, n, None, None, None, size, digest, None, None, found.get("seconds"), None, error)
    back, t = payload_of(m), found["tracks"][0]
    ranges = _keyframe_ranges(t)
    text = f"{t['codec'].strip()}:{t['duration']}/{t['timescale']}:{len(t['samples'])}:{len(t['keyframes'])}:{zlib.crc32(ranges[:, 1:].astype('<i8').tobytes()):08x}"
    return (i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), size, digest, text, t["codec"], found["seconds"], len(t["keyframes"]), None)


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes say (columns as in ``FEATURES``); the text is not looked at again.

    ``feature`` is codec, duration/timescale, samples, keyframes and a crc32 of
    all keyframe byte ranges. Null media and what can't be read as a container
    with a track have null features and say why in ``error``; repeated rows give
    repeated results; an empty table gives no rows.
    """

    def run(batches):
        import pyarrow as pa

        schema = common.arrow_schema(FEATURES)
        for batch in batches:
            for a, b in slices(batch.column("media")):
                columns = (batch.column(c).slice(a, b - a).to_pylist() for c in ("doc_id", "n_bytes", "media"))
                rows = [_features(*row) for row in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
