"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one space, and all
1- to 3-grams are hashed into ``2 ** BITS`` features. A feature's value is its
share of the text's n-grams times its inverse document frequency, which is
counted over all documents that may be learned from. The weights come from
follow-the-regularised-leader with an elastic-net penalty on a bounded sample
of labelled rows (about ``SAMPLE`` for each language, less where that many
languages would exceed ``SAMPLE_TOTAL``, but never under ``SAMPLE_LEAST``);
another part of that sample sets the temperature of the scores.

Scores only tell learned languages apart. Whether a text is in one of them is
judged by its mean inverse document frequency and its share of letters, against
what is usual in all texts of the language it was given.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from outletlens.llm import common
from outletlens.llm.pieces import forget, slices

BITS = 15
ORDERS = (1, 2, 3)
SCALE = 20.0
SAMPLE, SAMPLE_TOTAL, SAMPLE_LEAST = 1200, 6000, 50
#: L1 leaves about one weight in seven of the features that occur.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.2, 1e-5
EPOCHS = 3
#: Texts of fewer n-grams have theirs sorted to count them once; longer ones mark all features.
DENSE = 600
UNKNOWN = "und"
#: A text is foreign if its mean n-gram is rarer than that of the quantile USUAL of its language's texts by more than
#: GAP of the way to one never seen and SLACK standard errors (n-grams overlap, so OVERLAP of them count as one), or if
#: its share of letters is below LETTERS times the low quantile of all texts.
BINS = 4096
USUAL, GAP, SLACK, OVERLAP, LETTERS = 0.99, 0.2, 4.0, 6.0, 1 / 3

_fold: np.ndarray | None = None


def _folded() -> np.ndarray:
    """Code point -> its lower-case letter, or a space; 0 stays 0."""
    global _fold
    if _fold is None:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        table[0] = 0
        _fold = table
    return _fold


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature) of every n-gram, sorted by text, and whether each text has a letter."""
    joined = "\0".join(("" if t is None else t.replace("\0", " ")) for t in texts) + "\0"
    c = _folded()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    edge = c == 0
    text = np.cumsum(edge) - edge
    letters = np.bincount(text[(c != 32) & ~edge], minlength=len(texts))[: len(texts)] > 0
    keep = np.ones(len(c), bool)
    keep[1:] = ~((c[1:] == 32) & (c[:-1] == 32))
    c, text, edge = c[keep].astype(np.uint64), text[keep], edge[keep]
    out, of, code, inside = [], [], np.zeros(len(c), np.uint64), np.ones(len(c), bool)
    for order in range(1, max(ORDERS) + 1):
        k = order - 1
        code = code[: len(c) - k] * np.uint64(0x100000001B3) + c[k:]
        inside = inside[: len(c) - k] & ~edge[k:]
        if order in ORDERS:
            mixed = (code + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            ok = inside & ~((c[: len(c) - k] == 32) & (order == 1))
            out.append((mixed[ok] >> np.uint64(64 - BITS)).astype(np.int32))
            of.append(text[: len(c) - k][ok].astype(np.int32))
    return np.concatenate(of), np.concatenate(out), letters


def letter_shares(texts: list[str | None]) -> np.ndarray:
    """The share of letters among the characters of each text that aren't white space."""
    joined = "\0".join(("" if t is None else t.replace("\0", " ")) for t in texts) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = c == 0
    text = np.cumsum(edge) - edge
    count = lambda chosen: np.bincount(text[chosen & ~edge], minlength=len(texts))[: len(texts)]
    return count(_folded()[c] != 32) / np.maximum(count((c > 32) & (c != 0xA0) & (c != 0x3000)), 1)


@dataclass
class Model:
    """Weights of every language; ``scores`` gives calibrated probabilities, ``known`` whether a text is in a learned language."""

    langs: list[str]
    weights: np.ndarray  # (languages, features), inverse document frequency multiplied in
    bias: np.ndarray
    temperature: float
    idf: np.ndarray | None = None
    usual: np.ndarray | None = None  # (languages, 2): greatest mean idf of long texts, standard deviation within texts
    least_letters: float = 0.0

    def known(self, texts: list[str | None], grams_: tuple, best: np.ndarray) -> np.ndarray:
        """Whether each text is like those of its best language; all are without a sample to compare with."""
        if self.usual is None:
            return np.ones(len(texts), bool)
        of, feature, _ = grams_
        n = np.maximum(np.bincount(of, minlength=len(texts)), 1)
        mean = np.bincount(of, self.idf[feature], minlength=len(texts)) / n
        high, spread = self.usual[best].T
        return (mean <= high + SLACK * spread * np.sqrt(OVERLAP / n)) & (letter_shares(texts) >= self.least_letters)

    def scores(self, texts: list[str | None], grams_: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (texts, languages), and which texts have a letter."""
        of, feature, letters = grams_ or grams(texts)
        n = np.maximum(np.bincount(of, minlength=len(texts)), 1)
        logits = np.stack([np.bincount(of, w[feature], minlength=len(texts)) for w in self.weights], axis=1) * (SCALE / n)[:, None] + self.bias
        z = logits / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), letters


def fold_of(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5; 0 (held out) for a null doc_id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each feature occurs, and the number of texts."""

    def run(batches):
        import pyarrow as pa

        count, n, seen = np.zeros(1 << BITS, np.int64), 0, np.zeros(1 << BITS, bool)
        for batch in batches:
            for a, b in slices(batch.column("text"), 1 << 18):
                part = batch.column("text").slice(a, b - a).to_pylist()
                of, feature, _ = grams(part)
                size = np.bincount(of, minlength=len(part))
                short = size[of] < DENSE
                pairs = np.unique(of[short].astype(np.int64) << BITS | feature[short])
                count += np.bincount(pairs & (1 << BITS) - 1, minlength=1 << BITS)
                of, feature = of[~short], feature[~short]
                order = np.argsort(of, kind="stable")
                of, feature = of[order], feature[order]
                for i in np.flatnonzero(size >= DENSE).tolist():
                    seen[:] = False
                    seen[feature[np.searchsorted(of, i) : np.searchsorted(of, i, side="right")]] = True
                    count += seen
                n += len(part)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(count[some], n))], schema=common.arrow_schema("feature long, n long"))

    found = texts.select("text").mapInArrow(common.lean(run), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # one row a feature
    out, n = np.zeros(1 << BITS, np.int64), 0
    for r in found:
        if r["feature"] < 0:
            n = r["n"]
        else:
            out[r["feature"]] = r["n"]
    return out, n


def _sampled(labelled: DataFrame) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(lang, fold, features, their shares) of a bounded sample, chosen by a hash of doc_id and text."""
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not totals:
        return []
    size = max(SAMPLE_LEAST, min(SAMPLE, SAMPLE_TOTAL // len(totals)))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(totals.items()) for x in (lang, min(1.0, size / n))])
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id", "text"), 11) / F.lit(float(1 << 53))
    chosen = labelled.where(draw < share[F.col("lang")]).select("lang", fold_of(F.col("doc_id")).cast("long").alias("fold"), "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in slices(batch.column("text"), 1 << 18):
                part = batch.column("text").slice(a, b - a).to_pylist()
                of, feature, _ = grams(part)
                order = np.argsort(of, kind="stable")
                feature, cut = feature[order], np.searchsorted(of[order], np.arange(len(part) + 1))
                f, v = [], []
                for i in range(len(part)):
                    x, n = np.unique(feature[cut[i] : cut[i + 1]], return_counts=True)
                    f.append(x.astype(np.uint16).tobytes())
                    v.append((n / max(1, n.sum())).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), batch.column("fold").slice(a, b - a), pa.array(f, pa.binary()), pa.array(v, pa.binary())], schema=common.arrow_schema("lang string, fold long, f binary, v binary"))

    rows = chosen.mapInArrow(common.lean(run), "lang string, fold long, f binary, v binary").collect()  # a bounded sample
    rows.sort(key=lambda r: (r["lang"], r["fold"], r["f"], r["v"]))
    return [(r["lang"], r["fold"], np.frombuffer(r["f"], np.uint16), np.frombuffer(r["v"], np.float32)) for r in rows]  # views, no copies


def _usual(texts: DataFrame, langs: list[str], idf: np.ndarray) -> tuple[np.ndarray, float]:
    """``Model.usual`` and ``Model.least_letters`` of all of ``texts`` (lang, text), not of a sample.

    Means and shares are counted in ``BINS`` bins, so quantiles are those of all
    texts, rounded outwards to a bin; variances are summed in whole millionths.
    """
    number, top = {lang: k for k, lang in enumerate(langs)}, float(idf.max())
    held = texts.sparkSession.sparkContext.broadcast((number, idf))  # one entry a language, one value a feature
    ddl = "lang long, bin long, n long, noise long"

    def run(batches):
        import pyarrow as pa

        number, idf = held.value
        for batch in batches:
            for a, b in slices(batch.column("text"), 1 << 18):
                part = batch.column("text").slice(a, b - a).to_pylist()
                lang = np.array([number.get(x, -1) for x in batch.column("lang").slice(a, b - a).to_pylist()], np.int64)
                of, feature, _ = grams(part)
                size = np.bincount(of, minlength=len(part))
                mean, square = (np.bincount(of, x[feature], minlength=len(part)) / np.maximum(size, 1) for x in (idf, idf**2))
                noise = np.rint(np.maximum(square - mean**2, 0) * 1e6)
                place = lambda x: np.minimum(x * BINS, BINS - 1).astype(np.int64)
                some = (size > 0) & (lang >= 0)
                key = np.append((lang * BINS + place(mean / top))[some], -BINS + place(letter_shares(part)))  # letters: language -1
                seen, at = np.unique(key, return_inverse=True)
                sums = [np.bincount(at, minlength=len(seen)), np.bincount(at, np.append(noise[some], np.zeros(len(part))), minlength=len(seen)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen // BINS, seen % BINS, *sums)], schema=common.arrow_schema(ddl))

    bins = texts.select("lang", "text").mapInArrow(common.lean(run), ddl).groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum("noise").alias("noise"))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy("bin"))
    share = F.when(F.col("lang") < 0, 1 - USUAL).otherwise(USUAL)
    ranked = bins.withColumns({"upto": upto, "total": F.sum("n").over(W.partitionBy("lang"))}).withColumn("bin", F.when(F.col("upto") >= share * F.col("total"), F.col("bin")))
    out, least = np.full((len(langs), 2), np.inf), 0.0
    for r in ranked.groupBy("lang").agg(F.min("bin").alias("bin"), F.sum("n").alias("n"), F.sum("noise").alias("noise")).collect():  # one row a language
        if r["lang"] < 0:
            least = LETTERS * r["bin"] / BINS
        else:
            high = top * (r["bin"] + 1) / BINS
            out[r["lang"]] = high + GAP * max(0.0, top - high), np.sqrt(r["noise"] / 1e6 / r["n"])
    return out, least


def _leader(rows, langs: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal weights and biases from (language number, features, values)."""
    size = (1 << BITS) + 1  # the last feature is the bias
    z, n = np.zeros((len(langs), size)), np.zeros((len(langs), size))

    def weights(at):
        zs, ns = z[:, at], n[:, at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            lang, f, v = rows[i]
            at, x = np.append(f, size - 1), np.append(v * idf[f] * SCALE, 1.0)
            w = weights(at)
            logit = w @ x
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[lang] -= 1
            g = p[:, None] * x
            before = n[:, at]
            after = before + g * g
            z[:, at] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[:, at] = after
    final = weights(np.arange(size))
    return final[:, :-1] * idf, final[:, -1]


def _temperature(model: Model, rows) -> float:
    """The temperature of least log loss on (language number, features, values)."""
    if not rows:
        return 1.0
    logits = np.stack([(model.weights[:, f] * v).sum(axis=1) * SCALE + model.bias for _, f, v in rows])
    y = np.array([r[0] for r in rows])

    def loss(t):
        s = logits / t
        s -= s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return float(min(np.geomspace(0.1, 10, 81), key=lambda t: (round(loss(t), 4), abs(np.log(t)))))


def train(docs: DataFrame, foreign: bool = True) -> Model | None:
    """A model of the languages in ``docs`` (doc_id, text, lang) outside the held-out fifth; None if nothing is labelled.

    With ``foreign`` one more pass over all those rows finds what is usual in
    each language, by which ``Model.known`` tells texts in no learned language.
    """
    usable = common.unique_columns(docs, "doc_id", "text", "lang").where("text is not null and lang is not null").where(fold_of(F.col("doc_id")) != 0)
    sample = _sampled(usable)
    if not sample:
        return None
    frequency, n = _document_frequencies(usable)
    idf = np.log((1 + n) / (1 + frequency)) + 0.2
    langs = sorted({r[0] for r in sample})
    rows = [(langs.index(lang), fold, f, v) for lang, fold, f, v in sample]
    learn = [(lang, f, v) for lang, fold, f, v in rows if fold != 1] or [(lang, f, v) for lang, _, f, v in rows]
    weights, bias = _leader(learn, langs, idf)
    model = Model(langs, weights.astype(np.float64), bias, 1.0)
    model.temperature = _temperature(model, [(lang, f, v) for lang, fold, f, v in rows if fold == 1])
    if foreign:
        model.idf = idf
        model.usual, model.least_letters = _usual(usable, langs, idf)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text; others are ignored).

    ``und`` with score 0 for null texts and texts without a letter, and for all
    when there is no model. Ties go to the language that sorts first; repeated
    rows give repeated results; an empty table gives no rows.
    """
    ddl = "doc_id long, held_out boolean, lang_pred string, score double"
    held = docs.sparkSession.sparkContext.broadcast(model)  # features times languages

    def run(batches):
        import pyarrow as pa

        model = held.value
        for batch in batches:
            for a, b in slices(batch.column("text"), 1 << 18):
                part = batch.column("text").slice(a, b - a).to_pylist()
                if model is None:
                    lang, score = [UNKNOWN] * len(part), [0.0] * len(part)
                else:
                    p, letters = model.scores(part)
                    best = p.argmax(axis=1)
                    lang = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                    score = np.where(letters, p[np.arange(len(part)), best], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema=common.arrow_schema(ddl))

    return docs.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "text").mapInArrow(common.lean(run), ddl)


def accepted(docs: DataFrame, model: Model | None, least: float, only_known: bool = False) -> DataFrame:
    """The rows of ``docs`` with a letter in their text and a score of ``least`` or more, all columns kept; with ``only_known`` just those like the texts learned from.

    Without a model every text with a letter stays. Null and empty texts go;
    repeated rows stay or go together; an empty table gives no rows. Only the
    texts go to Python, and one boolean for each comes back.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def stays(text):
        import pyarrow as pa

        forget()
        model = held.value or Model([UNKNOWN], np.zeros((1, 1 << BITS)), np.zeros(1), 1.0)
        out = [np.zeros(0, bool)]
        for a, b in slices(text, 1 << 18):
            texts = text.slice(a, b - a).to_pylist()
            made = grams(texts)
            p, letters = model.scores(texts, made)
            keep = letters & (p.max(axis=1) >= least)
            if only_known:
                keep &= model.known(texts, made, p.argmax(axis=1))
            out.append(keep)
        common.give_back()
        return pa.array(np.concatenate(out))

    return docs.where(F.arrow_udf(stays, "boolean")(docs["text"]))
