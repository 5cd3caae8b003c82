"""Registered queries: SQL where there is some, and the pipeline against its parts."""

import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from outletlens.llm.oracle import ORACLE
from outletlens.llm.queries import QUERIES
from tests.llm.test_operators import plain_components, plain_spans
from tests.test_oracle import rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    plain = lambda df: rows_of(df.astype(object).where(df.notna(), None))
    found, want = QUERIES[name](spark, SF), con.execute(ORACLE[name])
    got = pd.DataFrame([tuple(r) for r in found.collect()], columns=found.columns, dtype=object)  # as pandas has it, a null makes floats of integers
    assert plain(got) == plain(pd.DataFrame(want.fetchall(), columns=[c[0] for c in want.description], dtype=object))


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 14))


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    from outletlens.llm import common

    for name, stage in pipeline.STAGES:
        path = common.scratch_path(spark, name, tracked=False)
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept.append((before.collect(), docs.collect()))
        if name != "pack":
            assert docs.columns == before.columns
    (_, named), (_, single), (_, cleaned), (_, mixed), (_, packed) = kept
    assert {r.doc_id for r in named} == {r.doc_id for r in kept[0][0] if re.search(r"[^\W\d_]", r.text or "")}
    assert {str(r.doc_id) for r in single} == {i for i, _, c in plain_components([(r.doc_id, r.text) for r in named]) if i == c}
    assert {r.doc_id for r in cleaned} == {r.doc_id for r in single} and not any(plain_spans(r.text) for r in cleaned)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, len(ids := t.encode(r.text, add_special_tokens=False).ids + [2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in mixed)
    whole = sorted((r.doc_id, r.doc_tokens, r.ids_crc32) for r in packed if r.length == r.doc_tokens)
    assert sum(r.length for r in packed) == sum(n for _, n, _ in want) and set(whole) <= set(want)
    assert pipeline.run(spark, SF).count() == len(packed)
