"""Vectorised front of the tokenizers library.

A byte-pair encoder never merges across its pre-tokenizer's pieces, so the ids
of a text are the ids of its pieces in order. Whole batches are cut into pieces
with numpy; each distinct piece is encoded once by the tokenizers library and
then looked up by a 64-bit hash, and its bytes are compared on every hit. Only
texts of printable ASCII, line feeds and the letters U+00C0-U+00FF are cut here,
as every version of Unicode agrees on their classes; any other text goes to the
library whole, and so does one that holds the string of a special token.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Byte classes: 0 separator, 1 white space, 2 letter, 3 digit, 4 other, 5 not cut here.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[0] = 0
_CLASS[[0x20, 0x0A]] = 1
for _b in range(0x21, 0x7F):
    _CLASS[_b] = 2 if chr(_b).isalpha() else 3 if chr(_b).isdigit() else 4
_CLASS[0xC3] = 2
_CLASS[0x80:0xC0] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_CONTRACTIONS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")
#: The bytes of a little-endian word that count, by how many are left.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Ranges longer than this are hashed and compared one by one.
_LONG = 512
#: New pieces that the library encodes at a time: its result takes many times the bytes of the ids.
_AT_ONCE = 4096


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``buf`` on, as one number; nothing is copied."""
    return np.ndarray((max(0, len(buf) - 7),), "<u8", buf, 0, (1,))


def range_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges buf[start:end], eight bytes a step; ``buf`` has eight spare bytes at its end.

    Every step mixes all bits, so texts that follow a pattern don't collide as
    they do under polynomial sums. Equal hashes are still only a hint: who needs
    certainty compares the bytes or keeps ``seed`` from whoever writes the texts.
    """
    words, size, key = _words(buf), end - start, np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    h = mix((words[start] & _KEEP[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64) * _STEP ^ key))
    left, at = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(left):
        rest = size[left] - at
        h[left] = mix((h[left] + _STEP) ^ mix(words[start[left] + at] & _KEEP[np.minimum(rest, 8)] ^ key))
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, key=int(key).to_bytes(8, "little")).digest(), "little")
    return h


def same_bytes(a: np.ndarray, first: np.ndarray, size: np.ndarray, b: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether a[first : first + size] equals b[other : other + size], range by range; both have eight spare bytes."""
    x, y = _words(a), _words(b)
    out = ((x[first] ^ y[other]) & _KEEP[np.minimum(size, 8)]) == 0
    left, at = np.flatnonzero(out & (size > 8) & (size <= _LONG)), 8
    while len(left):
        rest = size[left] - at
        equal = ((x[first[left] + at] ^ y[other[left] + at]) & _KEEP[np.minimum(rest, 8)]) == 0
        out[left[~equal]] = False
        left, at = left[equal & (rest > 8)], at + 8
    for i in np.flatnonzero(out & (size > _LONG)).tolist():
        out[i] = bool((a[first[i] : first[i] + size[i]] == b[other[i] : other[i] + size[i]]).all())
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Table:
    """Open addressing from 64-bit hashes to dense numbers, for whole arrays."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.key, self.number = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        mask, slot = (1 << self.bits) - 1, (h >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.key[slot]
        out = np.where(there == h, self.number[slot], -1)
        left = np.flatnonzero((there != h) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            there = self.key[slot[left]]
            hit = there == h[left]
            out[left[hit]] = self.number[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Number new, distinct hashes from ``n`` on."""
        if 2 * (self.n + len(h)) > len(self.key):
            used = self.key != 0
            old = self.key[used][np.argsort(self.number[used])]
            self.bits = max(self.bits, int(4 * (self.n + len(h))).bit_length())
            self.key, self.number = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(old, 0)
        self._put(h, self.n)
        self.n += len(h)

    def _put(self, h: np.ndarray, first: int) -> None:
        mask, slot = (1 << self.bits) - 1, (h >> np.uint64(64 - self.bits)).astype(np.int64)
        number, left = np.arange(first, first + len(h), dtype=np.int32), np.arange(len(h))
        while len(left):
            at = slot[left]
            free = self.key[at] == 0
            self.key[at[free]] = h[left[free]]
            placed = self.key[at] == h[left]
            self.number[at[placed]] = number[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & mask


class Encoder:
    """Ids of whole texts, exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    ``style`` is "byte" for a byte-level pre-tokenizer that keeps one leading
    space with each piece, "word" for one that lower-cases, drops white space
    and takes digits one by one. Strings of special tokens in a text become
    their ids, as the library has it, or with ``plain_specials`` ordinary text.
    The table of pieces restarts at ``most`` entries, or when its pieces take ``most_bytes``,
    so a worker holds a bounded table even of texts whose pieces are long and never repeat.
    """

    def __init__(self, path: str, style: str, most: int = 500_000, plain_specials: bool = False, most_bytes: int = 16 << 20) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.specials = [] if plain_specials else [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.style, self.most, self.most_bytes = style, most, most_bytes
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._restart()

    def _restart(self) -> None:
        self.table, self.used = _Table(), 0
        self.length, self.first, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(1 << 16, self.dtype)
        self.raw, self.raw_used, self.raw_at, self.raw_size = np.zeros(1 << 16, np.uint8), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _special(self, joined: bytes, bounds: np.ndarray) -> np.ndarray:
        """Numbers of the texts that hold a special token's string, in any case of its letters."""
        low, found = joined.lower(), []
        for s in self.specials:
            at = low.find(s)
            while at >= 0:
                found.append(int(np.searchsorted(bounds, at, side="right")) - 1)
                at = low.find(s, at + 1)
        return np.unique(np.array(found, np.int64))

    def encode(self, texts: list[bytes], whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of UTF-8 texts one after another, and len(texts) + 1 offsets; ``whole`` numbers texts that go to the library as they are."""
        joined = b"\0" + b"\0".join(texts) + b"\0"
        buf = np.frombuffer(joined + bytes(8), np.uint8)  # spare bytes to look ahead
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])  # where the separators are
        kind = _CLASS[buf]
        odd = kind == 5
        lead = np.flatnonzero(buf[:-1] == 0xC3)
        odd[lead[(buf[lead + 1] == 0x97) | (buf[lead + 1] == 0xB7)]] = True
        zero = np.flatnonzero(buf[: bounds[-1] + 1] == 0)
        if len(zero) != len(bounds):  # a text holds NUL
            odd[np.setdiff1d(zero, bounds)] = True
        whole = np.union1d(self._special(joined, bounds) if whole is None else whole, np.searchsorted(bounds, np.flatnonzero(odd), side="right") - 1)
        if self.style == "word":
            buf = _LOWER[buf]
            second = lead[(buf[lead + 1] >= 0x80) & (buf[lead + 1] <= 0x9E) & (buf[lead + 1] != 0x97)] + 1
            buf[second] += 0x20
        start = self._starts(buf, kind)
        end = np.append(start[1:], len(buf))
        first_kind = kind[start]
        keep = first_kind != 0
        if self.style == "word":
            keep &= first_kind != 1
        start, end = start[keep], end[keep]
        if len(whole):
            inside = np.zeros(len(texts) + 1, bool)
            inside[whole] = True
            keep = ~inside[np.searchsorted(bounds, start, side="right") - 1]
            start, end = start[keep], end[keep]
        number = self._numbers(buf, start, end)
        other = (self.raw_size[number] != end - start) | ~same_bytes(buf, start, np.minimum(end - start, self.raw_size[number]), self.raw, self.raw_at[number])
        if other.any():  # another piece has this hash
            return self.encode(texts, np.union1d(whole, np.searchsorted(bounds, start[other], side="right") - 1))
        length = self.length[number].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.repeat(self.first[number] - before[:-1], length) + np.arange(before[-1])]
        offsets = before[np.searchsorted(start, bounds)]
        if len(whole):
            return self._merge(texts, ids, offsets, whole)
        return ids, offsets

    def _merge(self, texts: list[bytes], ids: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.diff(offsets)
        out, at = [], 0
        for i in whole:
            got = np.array(self.tokenizer.encode_batch_fast([texts[i].decode()], add_special_tokens=False)[0].ids, self.dtype)
            out += [ids[at : offsets[i]], got]
            counts[i], at = len(got), offsets[i]
        return np.concatenate([*out, ids[at:]]), np.concatenate([[0], np.cumsum(counts)])

    def _starts(self, buf: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where pieces start; a separator is a piece of its own."""
        begin = np.empty(len(buf), bool)
        begin[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begin[1:])
        run = begin.copy() if self.style == "byte" else begin
        if self.style == "byte":
            last = np.flatnonzero((kind[:-1] == 1) & (kind[1:] > 1))  # the last of a run of white space before a word
            begin[last] = True
            begin[last[buf[last] == 0x20] + 1] = False
        else:
            begin |= kind == 3
        begin |= kind == 0
        mark = np.flatnonzero((buf[:-3] == 0x27) & run[:-3] & (kind[1:-2] == 2))  # an apostrophe that starts a run
        if len(mark):
            if self.style == "byte":
                mark = mark[buf[mark - 1] != 0x20]
            for tail in _CONTRACTIONS:
                hit = mark[buf[mark + 1] == tail[0]]
                if len(tail) == 2:
                    hit = hit[buf[hit + 2] == tail[1]]
                begin[hit + 1] = False
                after = hit + 1 + len(tail)
                begin[after[kind[after] == 2]] = True
        return np.flatnonzero(begin)

    def _numbers(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = range_hash(buf, start, end)
        h[h == 0] = 1
        number = self.table.find(h)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            more = int((end[missing[at]] - start[missing[at]]).sum())
            if self.table.n and (self.table.n + len(new) > self.most or self.raw_used + more > self.most_bytes):
                self._restart()
                return self._numbers(buf, start, end)
            raw, at = buf.tobytes(), missing[at]
            pieces = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            ids = []
            for k in range(0, len(pieces), _AT_ONCE):
                ids += [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces[k : k + _AT_ONCE]], add_special_tokens=False)]
            self._remember(pieces)
            length = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter((x for e in ids for x in e), self.dtype, int(length.sum()))
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.first = np.concatenate([self.first, self.used + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.used += len(flat)
            self.table.add(new)
            number[missing] = self.table.find(h[missing])
        return number


    def _remember(self, pieces: list[bytes]) -> None:
        """Keep the bytes of new pieces for later comparison."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        total = int(size.sum())
        while self.raw_used + total + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.raw[self.raw_used : self.raw_used + total] = np.frombuffer(b"".join(pieces), np.uint8)
        self.raw_at, self.raw_size = np.concatenate([self.raw_at, self.raw_used + np.cumsum(size) - size]), np.concatenate([self.raw_size, size])
        self.raw_used += total


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, style: str) -> Encoder:
    """The worker's own encoder; its pieces are kept between batches and tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, style) not in _encoders:
        _encoders[path, style] = Encoder(path, style)
    return _encoders[path, style]


def forget() -> None:
    """Let go of the worker's encoders; the next text builds its own anew."""
    _encoders.clear()


def slices(column, most: int = 1 << 20):
    """Row ranges of an Arrow string or binary column of about ``most`` bytes each, or one row."""
    n = len(column)
    if not n:
        return
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield at, to
        at = to


def raw_texts(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
