"""Training-data operators do the whole job, on rows that the given tables lack."""

import random

import pytest


def test_language_sample_holds_every_language(spark):
    """Nine languages stored one after the other, the last one rare."""
    from outletlens.llm import langid

    rnd = random.Random(8)
    langs = [f"l{k}" for k in range(9)]
    rows = []
    for k, lang in enumerate(langs):
        letters = "abcdefghijklmnopqrstuvwxyz"[2 * k : 2 * k + 6]
        for _ in range(1300 if k < 8 else 40):
            rows.append((len(rows), " ".join("".join(rnd.choices(letters, k=4)) for _ in range(6)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    sample = langid._sampled(docs)
    assert {r[0] for r in sample} == set(langs) and len(sample) < langid.SAMPLE_TOTAL * 1.1
    model = langid.train(docs)
    assert model.langs == langs
    found = langid.predict(docs, model).join(docs, "doc_id").where("held_out and lang in ('l7', 'l8')").collect()
    assert sum(r.lang == r.lang_pred for r in found) > 0.9 * len(found)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=t>x=2</annotation></math> holds", "so x=2 holds"),
        ("<math><mtable><mtr><mtd>1<mtd>2</mtd></mtr></mtable></math>", "1 2"),
        ("<map name=m><area href=x>way <a href=y>out</a></map>", "way out"),
        ("<p>a<textarea rows=2>\nb  c\nd &amp; e</textarea>f", "a b  c\nd & e f"),
        ("<p>a<svg><title>t</title><line x1=0 /><g/><style>s</style><text>b<tspan> c</tspan></text><g><text>d</text></g><defs><text>no</text></defs></svg>e", "a b c d e"),
        ("<svg><text display=none>x</text><switch><foreignObject><div/>in</foreignObject><text>no</text></switch></svg>", "in"),
        ("<p>a <select><option>b<option selected>c<option>d</select> e", "a c e"),
        ("<select><option disabled>b<optgroup label=g disabled><option>c</optgroup><option label=l>d</select>", "l"),
        ("<select multiple><optgroup label=g><option>b<option hidden>x<option>c</select>", "g\nb\nc"),
        ("<p>a</p><dialog>no</dialog><dialog open>yes</dialog>", "a\n\nyes"),
        ("<datalist><option>no</datalist><canvas>no</canvas>a", "a"),
    ],
)
def test_html_shows_what_a_browser_shows(page, text):
    from outletlens.llm import html

    assert html.extract(page) == text


def test_pipeline_drops_what_is_in_no_learned_language(spark):
    """Planted junk and unlearned languages go, all given documents with a letter and clean short texts stay."""
    import re

    import corpus_pipeline

    planted = {
        -1: "это совсем другой язык который раньше никто не видел " * 4, -2: "日本語の文章はここにあります。これは学習されていない言語です。" * 3, -3: "qxz jkvq wzxj pqvk xzzq kjwq vvxq zqjx " * 3,
        -4: "12 34 a !! 99", -5: "11111 x 2222 ;;; 333 " * 20, -6: "== -- 0x 0 __ 77 ## 12,5 %% 81",
    }
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        rows = [(i, t, None, "s", len(t)) for i, t in [*planted.items(), (-7, "The and of the."), (-8, "Das ist der und die.")]]
        both = docs.unionByName(spark.createDataFrame(rows, docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
        kept = {r.doc_id for r in corpus_pipeline.language_id(spark, both, "").select("doc_id").collect()}
        assert kept == {r.doc_id for r in both.collect() if re.search(r"[^\W\d_]", r.text or "")} - set(planted)


def test_what_is_usual_comes_from_all_texts(spark, monkeypatch):
    """The sample is a tenth of the rows here; the thresholds are those of all rows outside the held-out fifth."""
    import zlib

    import numpy as np

    from outletlens.llm import langid

    monkeypatch.setattr(langid, "SAMPLE", 50)
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 100)
    rnd = random.Random(5)
    words = {"a": ["bad", "cab", "dab", "fee", "gab"], "b": ["zoo", "yolk", "wok", "vow", "now"]}
    rows = [(k, " ".join(rnd.choices(words["ab"[k % 2]], k=6)) + ("".join(chr(rnd.randrange(97, 123)) for _ in range(k % 41)) if k % 20 > 17 else "") + " 7" * (k % 5), "ab"[k % 2]) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    used = [(t, x) for k, t, x in rows if zlib.crc32(str(k).encode()) % 5]
    top = model.idf.max()
    for n, lang in enumerate(model.langs):
        texts = [t for t, x in used if x == lang]
        of, feature, _ = langid.grams(texts)
        size = np.bincount(of)
        mean, square = (np.bincount(of, x[feature]) / size for x in (model.idf, model.idf**2))
        high = (model.usual[n, 0] - langid.GAP * top) / (1 - langid.GAP)
        assert np.mean(mean <= high) >= langid.USUAL > np.mean(mean <= high - top / langid.BINS)
        assert abs(model.usual[n, 1] ** 2 - np.mean(square - mean**2)) < 1e-5
    shares = langid.letter_shares([t for t, _ in used])
    least = model.least_letters / langid.LETTERS
    assert np.mean(shares < least) <= 1 - langid.USUAL <= np.mean(shares < least + 1 / langid.BINS)
    assert langid.train(docs, foreign=False).usual is None
