"""Small cases with known results, empty inputs and invariants of the domain operators."""

import pytest
from pyspark.sql import functions as F

from outletlens.functions import quantities as Q
from outletlens.functions import text as T
from outletlens.operators import claims as C
from outletlens.operators import metrics as M
from outletlens.operators import propositions as P
from outletlens.operators import syntax as S
from outletlens.operators import verify as V
from outletlens.plans import annotate, event
from outletlens.sources import articles as A

TEXT = {
    "a": "Police arrested 30 protesters. The council approved the budget. Guards detained marchers.",
    "b": "Protesters were arrested by police. The council approved the budget.",
    "c": "The council approved the budget. Rain fell heavily on the city.",
}


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in rows.orderBy("k").select(f(F.col("v")).alias("x")).collect()]


def test_cleaning(spark):
    raw = "Advertisement\nRead more\nBy:Smith\nThe vote passed. (Photo: AP)\n廣告\n2024-01-02\n12:30\nFollow us here\n\nSecond line (12:30)"
    assert column(spark, [raw, "", "Daily News"], T.clean_text) == ["The vote passed.\nSecond line", "", ""]


def test_language(spark):
    assert column(spark, ["", None, "123", "Hello", "議會通過", "Hello 議"], T.detect_language) == ["zh", "zh", "zh", "en", "zh", "zh"]


def test_sentences(spark):
    assert column(spark, ["He paid 3.5 euros. Then left.\n警方逮捕！結束。", ""], T.sentences) == [["He paid 3.5 euros.", "Then left.", "警方逮捕！", "結束。"], []]


def test_lemma(spark):
    words = ["studies", "carried", "running", "making", "closed", "stopped", "arrested", "passes", "votes", "press"]
    assert column(spark, words, T.lemma_en) == ["study", "carry", "run", "make", "close", "stop", "arrest", "pass", "vot", "press"]


def test_speakers(spark):
    rows = spark.createDataFrame([("President Lee", "Lee", False), ("Lee", "Kim", True), (None, "Kim", False)], "a string, b string, apart boolean")
    assert all(r.x == r.apart for r in rows.withColumn("x", T.speakers_diverge(F.col("a"), F.col("b"))).collect())


def test_attribution(spark):
    got = column(spark, ["Minister Lee said, the budget passed.", "院長表示，預算通過。", "Nothing here."], T.attribution)
    assert [(r.speaker, r.kind) for r in got] == [("Minister Lee", "attributed_fact"), ("院長", "attributed_fact"), (None, "none")]


def test_numerals():
    assert Q.numeral_zh("二十三") == 3 and Q.numeral_zh("二十三", compat=False) == 23
    assert Q.numeral_zh("三百五十", compat=False) == 350 and Q.numeral_zh("abc") is None
    assert Q.value_of("1,200 homes") == 1200 and Q.value_of("") is None


@pytest.mark.parametrize(
    ("sentence", "texts"),
    [
        ("", []),
        ("Advertisement", []),
        ("However,", []),
        ("The council approved 2,000 permits, and the mayor signed the order.", ["The council approved 2,000 permits", "the mayor signed the order"]),
        ("After the storm passed, crews repaired the bridge.", ["After the storm passed, crews repaired the bridge"]),
    ],
)
def test_decomposition(sentence, texts):
    assert [p["text"] for p in P.decompose(sentence)] == texts


def test_reattach_and_trace():
    assert P.reattach(["警方表示", "逮捕三人", "造成交通中斷"]) == ["警方表示，逮捕三人，造成交通中斷"]
    assert "[split]" in P.trace_text("After the storm passed, crews repaired the bridge.")


def test_complete_link():
    edges = [(0, 1, 0.9), (1, 2, 0.8), (0, 2, 0.7), (2, 3, 0.95)]
    assert C.complete_link([0, 1, 2, 3, 4], edges) == [[0, 1], [2, 3], [4]]


def test_other_agent():
    assert V.other_agent("Alpha closed the northern bridge", "Omega closed the northern bridge")
    assert not V.other_agent("Alpha closed it", "Alpha closed it")


def test_event(spark):
    articles = spark.createDataFrame([("e", k, v) for k, v in TEXT.items()], "event_id string, article_id string, text string")
    sentences = event.sentence_rows(articles)
    roles = S.svo(annotate.rule_tokens(sentences))
    none = spark.createDataFrame([], "event_id string, article_id string, name string, type string, modifiers array<string>, pos int")
    done = event.analyse(articles, sentences, roles, none)
    top = done.consensus.first()
    assert (top.cluster_id, top.coverage_count, top.category, top.representative) == ("C01", 3, "Widely shared", "The council approved the budget")
    members = done.members.collect()
    assert len({(r.event_id, r.idx) for r in members}) == len(members)
    stats = {(r.name.lower(), r.article_id): (r.agent_count, r.patient_count, r.passive_patient_count) for r in done.stats.collect()}
    assert stats["protesters", "b"] == (0, 1, 1) and stats["protesters", "a"] == (0, 1, 0) and stats["guards", "a"] == (1, 0, 0)
    assert all(r.agent_ratio + r.patient_ratio in (0.0, 1.0) for r in done.stats.collect())
    with pytest.raises(ValueError, match="fewer than two"):
        event.analyse(articles.where("article_id = 'a'"))


def test_event_order_does_not_matter(spark):
    rows = [("e", k, v) for k, v in TEXT.items()]
    got = []
    for order in (rows, rows[::-1]):
        articles = spark.createDataFrame(order, "event_id string, article_id string, text string").repartition(3)
        done = event.analyse(articles)
        got.append(sorted((r.cluster_id, r.coverage_count, r.representative) for r in done.consensus.collect()))
    assert got[0] == got[1]


def test_diff_with_an_empty_side(spark):
    sides = spark.createDataFrame([("p", "a", "a"), ("p", "b", "b")], "pair_id string, article_id string, side string")
    only = spark.createDataFrame([("a", 0, "The council approved the budget.")], "article_id string, sentence_idx int, sentence string")
    aligned, only_a, only_b = event.compare(sides, only)
    assert [(r.sent_b, r.similarity) for r in aligned.collect()] == [(None, 0.0)]
    assert only_a.count() == 1 and only_b.count() == 0


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "gold boolean, pred boolean")
    r = M.binary(none).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (1.0, 1.0, 1.0, 1.0) or r.f1 == 1.0


def test_folder(spark, tmp_path):
    for name, text in {"b.txt": "two", "a.TXT": " one \n", ".c.txt": "hidden", "d.md": "other", "e.txt": "  "}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "f.txt").write_bytes(b"\xff\xfe")
    with pytest.warns(UserWarning):
        found = A.discover(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.article_id, r.text) for r in found] == [("a", "one"), ("b", "two")]
    with pytest.raises(NotADirectoryError):
        A.discover(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError, match="fewer"):
        A.load(spark, [str(tmp_path / "b.txt")])


def test_empty_tables(spark):
    claims = spark.createDataFrame([], "event_id string, idx long, vec array<double>")
    assert C.candidate_pairs(claims).count() == 0
    tokens = spark.createDataFrame([], "event_id string, article_id string, sent_idx int, i int, text string, lemma string, pos string, dep string, head int, ws boolean")
    assert S.svo(tokens).count() == 0


def test_decimals_are_rejoined_without_a_growing_list(spark):
    from pyspark.sql import functions as F

    from outletlens.functions import text as T

    cases = [(["It rose by 3.", "5.", "2 percent.", None, "It fell.", "1"], ["It rose by 3.5.2 percent.", "It fell.", "1"]), ([], []), (None, None), (["1.", "a", "2.", "3"], ["1.", "a", "2.3"]), ([".", "5"], [".", "5"])]
    found = spark.createDataFrame(cases, "s array<string>, want array<string>").withColumn("got", T.rejoin_decimals(F.col("s")))
    assert [r for r in found.collect() if r.got != r.want] == []
    assert "aggregate(" not in found._jdf.queryExecution().analyzed().toString()


def test_what_a_surface_shares_is_worked_out_once(spark):
    from outletlens.operators import actors as A

    rows = [("三人",), (" police officers ",), ("12%",), ("",), (None,), ("x" * 21,), ("x" * 20 + " ",), ("a b c d e f g",), ("2024年5月1日",), ("-ab",), ("警 察",)]
    s, x = F.col("s"), A.surface_form(F.col("s"))
    d = spark.createDataFrame(rows, "s string").withColumn("x", x)
    got = d.select("x.*", A.quantity_or_date(s).alias("a"), A.valid_surface(s).alias("b"), A.valid_name(s).alias("c"), A.valid_participant(s).alias("d"))
    for r in got.collect():
        assert tuple(r)[:4] == tuple(r)[4:]
    assert [r.valid for r in got.collect()] == [False, True, False, False, None, True, True, True, False, False, True]
    assert [r.is_name for r in got.collect()] == [False, True, False, False, None, False, False, True, False, False, True]
    plan = d.select("x.counts", "x.valid", "x.is_name", "x.is_participant")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)^\s+|\s+$") == 1


def test_features_of_a_claim_work_its_attribution_out_once(spark):
    from outletlens.operators import verify as V

    plan = V.features(spark.createDataFrame([("x",)], "s string"), "s")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("noted|added") <= 3  # 14 where every feature had it worked out anew


def test_predicates_dont_work_out_who_joins_a_phrase(spark):
    kind = "event_id string, article_id string, sent_idx int, toks array<struct<i:int,text:string,lemma:string,pos:string,dep:string,head:int,ws:boolean>>"
    toks = [(1, "刪", "刪", "VERB", "conj", 0, False), (0, "砍", "砍", "VERB", "ROOT", 0, False)]
    found = S.predicates(spark.createDataFrame([("e", "a", 0, toks)], kind))
    assert sorted((r.position, r.raw) for r in found.collect()) == [(0, "砍"), (1, "刪")]
    assert "總經理" not in found._jdf.queryExecution().optimizedPlan().toString()
