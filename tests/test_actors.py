"""Candidates in phrases and merging names, found through indexes, against every pair."""

import random

from pyspark.sql import functions as F

from outletlens.functions import lexicons as L
from outletlens.operators import actors as A

KEYS = ["event_id", "article_id"]


def every_mention(found, svo):
    """All candidates with all records of their article."""
    r = svo.where((F.coalesce("verb", F.lit("")) == "") | A.valid_predicate(F.col("verb"), F.lit("zh"))).drop("modifiers")
    both = found.join(r, KEYS)
    sides = [(0, "subjects", F.when(F.col("is_passive") | A.unaccusative(F.col("verb")), "patient").otherwise("agent")), (1, "objects", F.when(F.col("is_passive"), "agent").otherwise("patient"))]
    rows = []
    for side, column, role in sides:
        rows += both.where(F.exists(column, lambda x: A.in_span(F.col("surface"), x))).select(*KEYS, "surface", "type", "svo_idx", "verb", "is_passive", "modifiers", F.lit(side), role).collect()
    return sorted(map(repr, map(tuple, rows)))


def test_mentions_equal_those_of_every_pair(spark):
    rnd = random.Random(8)
    bits = ["卓榮泰", "院長", "行政院", "民進黨", "黨團", "立委", "的", "早苗", "高市", "Union", " council ", "Bank", "the ", "of ", "Ann", "Ann Lee", "police", "台北", "市", "政府"]
    text = lambda n: "".join(rnd.choice(bits) for _ in range(rnd.randint(1, n)))
    found = [("e", rnd.choice("ab"), text(2), rnd.choice(["PERSON", "ORG", A.SVO_TYPE]), ["m"]) for _ in range(150)]
    found += found[:20] + [("e", "a", " ", "ORG", []), ("e", "a", "", "ORG", []), ("e", "a", "市", "GPE", None)]
    svo = [("e", rnd.choice("ab"), k % 3, rnd.choice(["批評", "發生", "", "arrest", "的"]), [text(4) for _ in range(rnd.randint(0, 3))], [text(4) for _ in range(rnd.randint(0, 2))], rnd.random() < 0.4) for k in range(120)]
    found = spark.createDataFrame(found, "event_id string, article_id string, surface string, type string, modifiers array<string>")
    svo = spark.createDataFrame(svo + svo[:10], "event_id string, article_id string, svo_idx int, verb string, subjects array<string>, objects array<string>, is_passive boolean")
    got = A.mentions(found, svo)
    rows = sorted(map(repr, map(tuple, got.select(*KEYS, "surface", "type", "svo_idx", "verb", "is_passive", "modifiers", "side", "role").collect())))
    assert rows == every_mention(found, svo) and len(rows) > 500


def test_merging_names_are_those_of_every_pair(spark):
    """Merges of each kind: same key, words in common, titles, short prefixes, parties, initials, places."""
    rnd = random.Random(4)
    names = ["卓榮泰", "行政院長卓榮泰", "卓榮", "高市早苗", "首相高市早苗", "高市", "民進黨", "民進黨團", "民進黨立院黨團", "立院民進黨團", "各民進黨團", "民進", "台北", "台北市", "台北縣", "united nations", "un", "nat", "north atlantic treaty", "north atlantic treaty organization"]
    names += ["senator ann lee", "ann lee", "lee", "ann", "a b c d", "a b c", "b c d e", "a b c d e", "minister of state", "state minister of", "x", "xy", "xyz"]
    bits = [*L.MERGE_TITLES[:4], "卓", "榮泰", "高", "民進", "黨", "團", "市", "町", "立院", "各", " ann", " lee", " b", "un"]
    names += ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 5))).strip() for _ in range(220)]
    kinds = ["PERSON", "PER", "ORG", "GPE", "LOC", "NORP", "FAC", A.SVO_TYPE]
    rows = {(e, n, t) for n in names for e in "ef" for t in rnd.sample(kinds, 3)}
    ddl = "event_id string, id long, key string, type string"
    v = spark.createDataFrame([(e, k, n, t) for k, (e, n, t) in enumerate(sorted(rows))], ddl)
    o = v.select("event_id", F.col("id").alias("ib"), F.col("key").alias("kb"), F.col("type").alias("tb"))
    every = v.join(o, "event_id").where((F.col("id") < F.col("ib")) & A.same_actor(F.col("key"), F.col("type"), F.col("kb"), F.col("tb"))).select("id", "ib").collect()
    got = A.merging(v).collect()
    assert {(r.i, r.j) for r in got} <= {(r.id, r.ib) for r in every} and len(got) == len({(r.i, r.j) for r in got})

    def parts(pairs):
        of = {k: k for k in range(len(rows))}

        def top(k):
            while of[k] != k:
                k = of[k]
            return k

        for i, j in pairs:
            of[max(top(i), top(j))] = min(top(i), top(j))
        return [top(k) for k in of]

    assert parts((r.i, r.j) for r in got) == parts((r.id, r.ib) for r in every)
    # Pairs of different keys are all there, not only enough of them to connect the same names.
    kind = {r.id: (r.event_id, r.key, r.g) for r in v.withColumn("g", A._group(F.col("type"))).collect()}
    assert {frozenset((kind[r.i], kind[r.j])) for r in got if kind[r.i] != kind[r.j]} == {frozenset((kind[r.id], kind[r.ib])) for r in every if kind[r.id] != kind[r.ib]}


def test_merging_nothing(spark):
    assert A.merging(spark.createDataFrame([], "event_id string, id long, key string, type string")).count() == 0


def test_words_in_spans_stand_between_other_characters(spark):
    rows = [("aa", "aaa aa", True), ("aa", "aaa", False), ("a\\Eb", "x a\\Eb y", True), ("a\\Eb", "xa\\Eb", False), ("a.c", "abc a.cd", False), (".b", "a.b .b", True), ("smith", "smith party", False), ("smith", "smith parties", True), ("", "x", False), (" SMITH ", "Mr Smith", True)]
    found = spark.createDataFrame(rows, "c string, s string, inside boolean").withColumn("got", A.in_span(F.col("c"), F.col("s")))
    assert [r for r in found.collect() if r.got != r.inside] == []


def test_pairs_of_names_and_spans_are_not_shuffled(spark):
    from outletlens.plans.queries import QUERIES

    plan = QUERIES["names_in_spans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "sequence(1, greatest" not in plan


def test_no_token_is_shuffled_alone(spark):
    from outletlens.plans.queries import QUERIES

    for name in ("svo_sentences", "descriptors_of_articles"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan, name  # which brought a sentence's tokens together again


def test_tokens_of_sentences_are_those_of_the_table(spark):
    from outletlens.plans import annotate

    said = ["Guards were detained by angry marchers", "police arrested the union", "by police", "the council was rejected", "Closed"]
    rows = spark.createDataFrame([("e", "a", k, s) for k, s in enumerate(said)], "event_id string, article_id string, sentence_idx int, sentence string")
    got = {(r.sent_idx, r.i): (r.text, r.pos, r.dep, r.head) for r in annotate.rule_tokens(rows).collect()}
    assert len(got) == 6 + 4 + 4 + 1 and got[0, 0] == ("Guards", "NOUN", "nsubjpass", 2) and got[0, 1] == ("were", "AUX", "auxpass", 2) and got[0, 5] == ("marchers", "NOUN", "pobj", 3)
    assert got[1, 3] == ("union", "NOUN", "dobj", 1) and got[0, 3] == ("by", "ADP", "agent", 2) and got[3, 1] == ("council", "NOUN", "nsubjpass", 3) and got[4, 0] == ("Closed", "VERB", "ROOT", 0)


def test_mentions_dont_join_their_records_again(spark):
    svo = spark.createDataFrame([("e", "a", 0, "arrested", ["Police", "police"], ["men"], False), ("e", "a", 1, "closed", None, ["the police"], True)], "event_id string, article_id string, svo_idx int, verb string, subjects array<string>, objects array<string>, is_passive boolean")
    none = spark.createDataFrame([], "event_id string, article_id string, name string, type string, modifiers array<string>, pos int")
    said = A.mentions(A.candidates(svo, none), svo)
    assert {(r.surface, r.svo_idx, r.side, r.role, r.is_passive) for r in said.collect()} >= {("Police", 0, 0, "agent", False), ("Police", 1, 1, "agent", True), ("men", 0, 1, "patient", False)}
    plan = said._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Relation [" in x and "record#" in x for x in plan) == 3  # 4 with the records read again


def test_a_token_without_children_follows_no_pointers(spark):
    import time

    from pyspark.sql import functions as F

    from outletlens.operators import participants as P

    n = 2000
    toks = [(f"w{i}", i - 1 if i and i % 2 else 0) for i in range(n)]
    ts = spark.createDataFrame([(toks,)], "ts array<struct<text:string,up:int>>")
    began = time.time()
    found = ts.select(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda h: F.when(h % 2 == 1, F.size(P._hanging(F.col("ts"), h, lambda t: F.lit(True))))).alias("x")).first().x
    assert set(found) == {1, None} and time.time() - began < 60
    whole = ts.select(P._hanging(F.col("ts"), F.lit(0), lambda t: F.lit(True)).alias("x"), P._hanging(F.col("ts"), F.lit(2), lambda t: F.lit(True)).alias("y")).first()
    assert whole.x == list(range(n)) and whole.y == [2, 3]
