"""Packing documents into fixed windows by non-negative least squares.

Document lengths beyond whole windows are counted in a histogram of
``WINDOW / QUANTUM`` bins. Every combination of up to three bins that fills a
window exactly is a strategy; non-negative least squares finds how often each
strategy should repeat so that together they use up the histogram. Counts are
rounded and held within the histogram, what remains is packed greedily by bins
into nearly full windows, and what fits nowhere follows one stream that is cut
at window ends. The histogram and the strategies have fixed bounds; documents
are matched to slots by their rank within their bin, without a window over a
whole bin.
"""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from outletlens.llm import common
from outletlens.llm.pieces import encoder, raw_texts, slices

WINDOW = 4096
QUANTUM = 16
BINS = WINDOW // QUANTUM
#: Least share of a window that a greedy pattern fills; other remainders go to the stream.
FULL_ENOUGH = 0.995

ENCODED = "doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def strategies(bins: int = BINS) -> np.ndarray:
    """All ways to write ``bins`` as one, two or three parts, largest first, unused parts 0."""
    out = [(bins, 0, 0)] + [(a, bins - a, 0) for a in range((bins + 1) // 2, bins)]
    for a in range(-(-bins // 3), bins - 1):
        for b in range(max(1, -(-(bins - a) // 2)), min(a, bins - a - 1) + 1):
            out.append((a, b, bins - a - b))
    return np.array(out)


def least_squares(parts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative repeats of each strategy whose use of bins is closest to ``counts`` (index 0 unused).

    Active-set method: free the strategy with the steepest gradient, solve the
    free ones by least squares, step back to the bounds where that turns negative.
    """
    n, target = len(parts), counts.astype(float)
    target[0] = 0
    use = lambda s: np.stack([np.bincount(parts[k][parts[k] > 0], minlength=len(target)) for k in s], axis=1).astype(float)
    x, free, rest = np.zeros(n), [], target.copy()
    least = 1e-6 * max(1.0, target.max(initial=0))
    for _ in range(3 * len(target)):
        padded = rest.copy()
        padded[0] = 0
        slope = padded[parts].sum(axis=1)
        slope[free] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= least:
            break
        free.append(best)
        while free:
            a = use(free)
            got = np.linalg.lstsq(a, target, rcond=None)[0]
            if (got > 1e-9).all():
                x[:] = 0
                x[free] = got
                break
            now, low = x[free], got <= 1e-9
            step = np.min(now[low] / np.maximum(now[low] - got[low], 1e-12))
            moved = now + step * (got - now)
            x[free] = moved
            keep = moved > 1e-9
            keep[low] &= moved[low] > 1e-9
            if keep.all():
                keep[np.argmin(moved)] = False
            x[[f for f, k in zip(free, keep, strict=True) if not k]] = 0
            free = [f for f, k in zip(free, keep, strict=True) if k]
        rest = target - (use(free) @ x[free] if free else 0)
    else:
        warnings.warn("the repeats of fillings haven't settled; sequences may hold more padding", stacklevel=2)
    return x


def patterns(counts: np.ndarray, bins: int = BINS) -> list[tuple[tuple[int, ...], int]]:
    """(parts, repeats) that use no bin more often than ``counts`` has it.

    First the rounded least-squares strategies, then greedy patterns: the
    largest bin left, filled up with the largest bins that still fit.
    """
    left, out = counts.astype(np.int64).copy(), []
    parts = strategies(bins)
    repeats = least_squares(parts, left)
    for k in np.argsort(-repeats, kind="stable"):
        want = int(np.floor(repeats[k] + 0.5))
        if want <= 0:
            break
        need = np.bincount(parts[k][parts[k] > 0], minlength=bins + 1)
        times = min(want, int((left[need > 0] // need[need > 0]).min()))
        if times > 0:
            out.append((tuple(int(p) for p in parts[k] if p), times))
            left -= times * need
    skip = np.zeros(bins + 1, bool)
    while True:
        open_bins = np.flatnonzero((left > 0) & ~skip)
        open_bins = open_bins[open_bins > 0]
        if not len(open_bins):
            return out
        room, chosen, now = bins, [], left.copy()
        at = int(open_bins[-1])
        while at > 0:
            chosen.append(at)
            room -= at
            now[at] -= 1
            fits = np.flatnonzero(now[: room + 1] > 0)
            fits = fits[fits > 0]
            at = int(fits[-1]) if len(fits) else 0
        if (bins - room) < FULL_ENOUGH * bins:
            skip[chosen[0]] = True
            continue
        need = np.bincount(chosen, minlength=bins + 1)
        times = int((left[need > 0] // need[need > 0]).min())
        out.append((tuple(chosen), times))
        left -= times * need


def encode(docs: DataFrame, tokenizer: str, style: str = "word", end_id: int = 2) -> DataFrame:
    """Ids of every document with ``end_id`` after them, saved with a row number; null text is empty."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in slices(batch.column("text"), 1 << 18):  # what cutting and the library need besides is many times that
                flat, bounds = encoder(tokenizer, style).encode(raw_texts(batch.column("text").slice(a, b - a)))
                tail = np.array([end_id], flat.dtype).tobytes()
                raw, width = flat.tobytes(), flat.dtype.itemsize
                at = (bounds * width).tolist()
                ids = [raw[p:q] + tail for p, q in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(bounds) + 1), pa.array(ids, pa.binary())], schema=common.arrow_schema(ENCODED))

    rows = common.unique_columns(docs, "doc_id", "text").mapInArrow(common.lean(run, tokenizes=True), ENCODED)
    return common.save(rows.withColumn("row", F.monotonically_increasing_id()), "packing-ids")


@dataclass
class Layout:
    """Where every document goes: ``full`` has its first whole window, ``rest`` its remaining pieces."""

    full: DataFrame
    rest: DataFrame


def layout(lengths: DataFrame) -> Layout:
    """Assign (row, n) to sequences.

    ``full``: row, full_base (sequence of its first whole window; the others
    follow). ``rest``: row, pieces (array of start, length, sequence_id, offset).
    """
    spark = lengths.sparkSession
    marked = lengths.select(
        "row", "n", (F.col("n") % WINDOW).alias("r"), F.floor(F.col("n") / WINDOW).cast("long").alias("w"), F.shiftrightunsigned(F.xxhash64("row"), 33).alias("_at")
    ).withColumn("bin", F.ceil(F.col("r") / QUANTUM).cast("int"))
    bucket = F.floor(F.col("_at") * common.parts(spark) / F.lit(1 << 31)).cast("int")
    order = [F.col("_at"), F.col("row")]
    seen = marked.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).collect()  # at most BINS + 1 rows
    counts = np.zeros(BINS + 1, np.int64)
    for x in seen:
        counts[x["bin"]] = x["n"]
    counts[0] = 0
    chosen = patterns(counts)
    segments, used, base = [], np.zeros(BINS + 1, np.int64), 0
    for parts, times in chosen:
        for place, b in enumerate(parts):
            segments.append((b, int(used[b]), int(used[b]) + times, base, place))
            used[b] += times
        base += times
    whole = sum(x["w"] for x in seen)
    full = common.dealt_sum(marked.where("w > 0"), [], order, F.col("w"), "_before", bucket).select("row", (F.col("_before") + base).alias("full_base"))
    # at most 3 segments for each freed strategy or greedy pattern: a few thousand rows
    slots = spark.createDataFrame(segments or [(-1, 0, 0, 0, 0)], "slot_bin int, low long, high long, base long, place int")
    ranked = common.dealt_sum(marked.where("r > 0"), ["bin"], order, F.lit(1).cast("long"), "rank", bucket)
    inside = (F.col("bin") == F.col("slot_bin")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(F.broadcast(slots), inside, "left")
    placed = placed.select("row", "r", "w", "_at", (F.col("base") + F.col("rank") - F.col("low")).alias("seq"), "place")
    placed = common.save(placed, "packing-placed")  # read three times below; a few numbers a document
    in_pattern = W.partitionBy("seq").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    matched = placed.where("seq is not null").select("row", (F.col("w") * WINDOW).alias("start"), F.col("r").alias("length"), F.col("seq").alias("sequence_id"), F.coalesce(F.sum("r").over(in_pattern), F.lit(0)).alias("offset"))
    stream = common.dealt_sum(placed.where("seq is null"), [], order, F.col("r"), "p", bucket)
    first = F.least(F.col("r"), WINDOW - F.col("p") % WINDOW)
    start, seq = F.col("w") * WINDOW, F.lit(base + whole) + F.floor(F.col("p") / WINDOW).cast("long")
    piece = lambda s, n, q, o: F.struct(s.cast("long").alias("start"), n.cast("long").alias("length"), q.cast("long").alias("sequence_id"), o.cast("long").alias("offset"))
    head, tail = piece(start, first, seq, F.col("p") % WINDOW), piece(start + first, F.col("r") - first, seq + 1, F.lit(0))
    cut = stream.select("row", F.when(first < F.col("r"), F.array(head, tail)).otherwise(F.array(head)).alias("pieces"))
    whole_rests = matched.select("row", F.array(piece(*[F.col(c) for c in ("start", "length", "sequence_id", "offset")])).alias("pieces"))
    return Layout(full, whole_rests.unionByName(cut))


def _cut_up(with_ids: bool):
    def run(batches):
        import pyarrow as pa

        schema = common.arrow_schema(PIECES + (", ids binary" if with_ids else ""))
        for batch in (x.slice(a, b - a) for x in batches for a, b in slices(x.column("ids"))):  # ids of about 1 MB at a time
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "full_base", "pieces")]
            for doc, n, raw, base, rest in zip(*columns, strict=True):
                ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)
                cuts = [(k * WINDOW, WINDOW, base + k, 0) for k in range(n // WINDOW)] + [(p["start"], p["length"], p["sequence_id"], p["offset"]) for p in rest or ()]
                for start, length, seq, offset in cuts:
                    part = ids[start : start + length].astype("<u4").tobytes()
                    rows.append((doc, start, length, zlib.crc32(part), n, seq, offset) + ((part,) if with_ids else ()))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer: str, style: str = "word", end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: ``PIECES``, and with ``with_ids`` their ids (little-endian unsigned 32-bit).

    A null or empty text has the one id ``end_id``; a text of any length is cut
    into whole windows and a remainder. Repeated rows and repeated or null
    doc_ids are packed row by row. Only the last stream window can hold much
    padding. An empty table gives no pieces.
    """
    encoded = encode(docs, tokenizer, style, end_id)
    at = layout(encoded.select("row", "n"))
    joined = encoded.join(at.full, "row", "left").join(at.rest, "row", "left")
    return joined.select("doc_id", "n", "ids", "full_base", "pieces").mapInArrow(common.lean(_cut_up(with_ids), tokenizes=True), PIECES + (", ids binary" if with_ids else ""))


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole training sequences from ``pack(..., with_ids=True)``: sequence_id, n_tokens, ids, lengths of its pieces."""
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return parts.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("p", lambda x: x["length"]).alias("lengths"))
