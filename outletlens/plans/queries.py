"""Registered queries of the domain operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outletlens.functions import lexicons as L
from outletlens.functions import text as T
from outletlens.operators import actors as A
from outletlens.operators import claims as C
from outletlens.operators import consensus as N
from outletlens.operators import diff as D
from outletlens.operators import metrics as M
from outletlens.operators import syntax as S
from outletlens.plans.shared import spread
from outletlens.streaming import articles as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query, with its SQL where there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _re2(pattern: str, flags: str = "i") -> str:
    """A pattern of the lexicons as DuckDB's engine and quoting need it."""
    wide = re.sub(r"\\w", r"\\p{L}\\p{N}_", pattern)
    return f"(?{flags}){wide}".replace("'", "''")


# Claim coverage over documents: an event is 20 neighbouring documents, an outlet their source.

_EXACT = """
with s as (
  select {event} as event_id, source as article_id, trim(unnest(regexp_split_to_array(text, '[.!?\\n;]'))) as sentence from documents where text is not null
), m as (select * from s where sentence <> '' and event_id is not null),
o as (select {event} as event_id, count(distinct source) as total_articles from documents where text is not null group by 1),
c as (
  select event_id, sentence, count(distinct article_id) as coverage_count, total_articles, round(count(distinct article_id) / total_articles, 4) as coverage_ratio
  from m join o using (event_id) group by event_id, sentence, total_articles
), k as (
  select *, case when coverage_ratio >= 0.8 then 'Widely shared' when coverage_ratio >= 0.5 then 'Commonly reported' when coverage_ratio >= 0.2 then 'Minority coverage' else 'Rare claim' end as category from c
)
"""
_BY_DOC, _BY_LANG = _EXACT.replace("{event}", "cast(doc_id // 20 as varchar)"), _EXACT.replace("{event}", "lang")


def exact_claims(spark: SparkSession, sf_dir: str, event: Column) -> tuple[DataFrame, DataFrame]:
    """(members, outlets) of claims that are equal sentences."""
    docs = _t(spark, sf_dir, "documents").where("text is not null").withColumn("event_id", event)
    parts = docs.select("event_id", F.col("source").alias("article_id"), F.explode(F.split("text", r"[.!?\n;]")).alias("s")).withColumn("cluster", F.trim("s"))
    return parts.where(F.col("cluster") != "").where("event_id is not null").select("event_id", "cluster", "article_id"), docs.select("event_id", F.col("source").alias("article_id")).distinct()


def _coverage(members: DataFrame, outlets: DataFrame) -> DataFrame:
    """Counts only: partial aggregation before the shuffle, the outlets' totals sent along."""
    total = outlets.groupBy("event_id").agg(F.countDistinct("article_id").alias("total_articles"))
    n = members.groupBy("event_id", "cluster").agg(F.countDistinct("article_id").alias("coverage_count")).join(total, "event_id")
    ratio = F.round(F.col("coverage_count") / F.col("total_articles"), 4)
    return n.withColumn("coverage_ratio", ratio).withColumn("category", C.category(ratio))


def _by_doc() -> Column:
    return F.expr("cast(doc_id div 20 as string)")


@query(_BY_DOC + "select event_id, sentence, coverage_count, total_articles, coverage_ratio, category from k")
def claim_coverage_exact(spark, sf_dir):
    return _coverage(*exact_claims(spark, sf_dir, _by_doc())).withColumnRenamed("cluster", "sentence")


@query(_BY_LANG + "select event_id, sentence, coverage_count, total_articles, coverage_ratio, category from k")
def claim_coverage_by_lang(spark, sf_dir):
    return _coverage(*exact_claims(spark, sf_dir, F.col("lang"))).withColumnRenamed("cluster", "sentence")


@query(_BY_LANG + "select event_id, count(*) filter (where coverage_count = total_articles) as n_all, count(*) filter (where coverage_ratio >= 0.5 and coverage_count > 1 and coverage_count < total_articles) as n_majority, count(*) filter (where coverage_count = 1) as n_single, count(*) as n_claims from k group by event_id")
def coverage_summary(spark, sf_dir):
    return C.coverage_summary(_coverage(*exact_claims(spark, sf_dir, F.col("lang"))))


@query(_BY_LANG + "select event_id, case when coverage_count = 1 then 'Single-outlet' else category end as label, count(*) as n from k group by 1, 2")
def coverage_categories(spark, sf_dir):
    c = _coverage(*exact_claims(spark, sf_dir, F.col("lang")))
    return c.groupBy("event_id", C.display_category(F.col("coverage_ratio"), F.col("coverage_count")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(_BY_LANG + """, w as (select event_id, sentence from k where coverage_count > 1), a as (select distinct event_id, sentence, article_id from m),
 u as (select event_id, list_sort(list(distinct article_id)) as ids from (select lang as event_id, source as article_id from documents where text is not null) group by 1)
select w.event_id, w.sentence, array_to_string(list_filter(ids, lambda x: not list_contains(p.present, x)), ',') as absent from w join u using (event_id)
join (select event_id, sentence, list(article_id) as present from a group by 1, 2) p using (event_id, sentence)""")
def absent_outlets(spark, sf_dir):
    members, outlets = exact_claims(spark, sf_dir, F.col("lang"))
    c = C.coverage(members.distinct(), outlets.where("event_id is not null")).where("coverage_count > 1")
    return c.select("event_id", F.col("cluster").alias("sentence"), F.array_join("absent_ids", ",").alias("absent"))


@query(_BY_DOC + "select event_id, m.article_id, count(distinct sentence) as n_only_here from k join (select distinct event_id, sentence, article_id from m) m using (event_id, sentence) where coverage_count = 1 group by 1, 2")
def outlet_single_claims(spark, sf_dir):
    members, outlets = exact_claims(spark, sf_dir, _by_doc())
    alone = members.groupBy("event_id", "cluster").agg(F.countDistinct("article_id").alias("n"), F.first("article_id").alias("article_id")).where("n = 1")
    return alone.groupBy("event_id", "article_id").agg(F.count(F.lit(1)).alias("n_only_here"))


# Cleaning, language, eligibility and claim features.

_NOISE_SQL = " or ".join(f"regexp_full_match(line, '{_re2(p)}')" for p in L.NOISE_LINES)
_LINES = "with l as (select doc_id, regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '^\\s+|\\s+$', '', 'g') as line from documents)"


@query(f"{_LINES} select doc_id, count(*) filter (where line = '') as n_blank, count(*) filter (where line <> '' and ({_NOISE_SQL})) as n_noise, count(*) as n_lines from l group by doc_id")
def noise_line_counts(spark, sf_dir):
    ls = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("x")).select("doc_id", T.strip(F.col("x")).alias("line"))
    return ls.groupBy("doc_id").agg(F.count_if(F.col("line") == "").alias("n_blank"), F.count_if((F.col("line") != "") & T.is_noise(F.col("line"))).alias("n_noise"), F.count(F.lit(1)).alias("n_lines"))


@query(f"{_LINES}, k as (select doc_id, count(*) as n, sum(len(line)) as n_chars from l where line <> '' and not ({_NOISE_SQL}) group by 1) select doc_id, coalesce(n, 0) as n_lines, coalesce(n_chars, 0)::bigint as n_chars from (select distinct doc_id from documents) left join k using (doc_id)")
def clean_lines(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").withColumn("c", T.clean_lines(F.coalesce("text", F.lit(""))))
    return d.select("doc_id", F.size("c").cast("long").alias("n_lines"), F.aggregate("c", F.lit(0).cast("long"), lambda a, s: a + F.length(s)).alias("n_chars"))


_SHARE = "len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}]')) / nullif(len(regexp_extract_all(text, '\\p{L}')), 0)"


@query(f"select doc_id, case when coalesce({_SHARE}, 1) >= 0.15 then 'zh' else 'en' end as language from documents")
def language_detect(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.detect_language(F.col("text")).alias("language"))


_SENT = "select doc_id, trim(unnest(regexp_split_to_array(text, '[.!?\\n;]'))) as s from documents where text is not null"


def _sentences(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.explode(F.split("text", r"[.!?\n;]")).alias("x")).select("doc_id", F.trim("x").alias("s"))


def _has(p: str) -> str:
    return f"regexp_matches(s, '{_re2(p)}')"


_RAW = "regexp_replace(s, '^\\s+|\\s+$', '', 'g')"
_WORDS = "len(regexp_extract_all(raw, '[a-zA-Z]{2,}'))"
_BYLINE_REST = f"regexp_replace(regexp_replace(raw, '{_re2('^' + L.BYLINE)}', ''), '^\\s+|\\s+$', '', 'g')"
_ELIGIBLE = f"""
case when raw = '' then 'empty' when cjk = 0 and {_WORDS} = 0 then 'no words' when cjk < 2 and {_WORDS} = 0 and not (cjk = 1 and regexp_matches(raw, '\\d')) then 'single character'
when regexp_full_match(raw, '{_re2(L.UI_NOISE)}') then 'page furniture'
when regexp_full_match(raw, '{_re2(L.CREDIT_BRACKETS)}') and regexp_matches(raw, '{_re2(L.CREDIT_WORDS)}') then 'credit'
when regexp_matches(raw, '{_re2('^' + L.BYLINE)}') and len(regexp_extract_all({_BYLINE_REST}, '[\\x{{4E00}}-\\x{{9FFF}}]')) < 4 and len(regexp_extract_all({_BYLINE_REST}, '[a-zA-Z0-9]+')) <= 4 then 'byline'
when regexp_full_match(raw, '{_re2(L.ATTRIBUTION_ONLY)}') then 'attribution only'
when regexp_full_match(raw, '{_re2(L.DISCOURSE_ZH, 's')}') or regexp_full_match(raw, '{_re2(L.DISCOURSE_EN)}') then 'discourse particle'
when len(raw) <= 12 and regexp_full_match(raw, '{_re2(L.TEMPORAL_ZH, 's')}') then 'time only'
when regexp_matches(raw, '{_re2(L.SPEECH_ZH, 's')}') and len(regexp_replace(trim(regexp_extract(raw, '{_re2(L.SPEECH_ZH, 's')}', 2)), '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 2 then 'attribution only'
when regexp_matches(raw, '{_re2(L.SPEECH_EN)}') and len(regexp_extract_all(regexp_extract(raw, '{_re2(L.SPEECH_EN)}', 2), '\\S+')) < 2 then 'attribution only'
else 'eligible' end
"""


@query(f"with s as ({_SENT}), r as (select doc_id, {_RAW} as raw from s), c as (select *, len(regexp_extract_all(raw, '[\\x{{4E00}}-\\x{{9FFF}}]')) as cjk from r) select doc_id, {_ELIGIBLE} as reason, count(*) as n from c group by 1, 2")
def claim_eligibility_reasons(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", T.eligibility(F.col("s"))["reason"].alias("reason")).groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n"))


_NEG = f"(regexp_matches(s, '{_re2(L.NEGATION_ZH, 's')}') or len(list_intersect(regexp_extract_all(lower(s), '[a-z]+'), [{', '.join(repr(w) for w in L.NEGATION_EN)}])) > 0)"


@query(f"""with s as ({_SENT}) select case when {_has(L.DEMAND_ZH)} or {_has(L.DEMAND_EN)} then 'demand' when {_has(L.PLAN_ZH)} or {_has(L.PLAN_EN)} then 'plan' when {_has(L.OPINION_ZH)} or {_has(L.OPINION_EN)} then 'opinion' else 'statement' end as modality, {_NEG} as negated, count(*) as n from s group by 1, 2""")
def modality_counts(spark, sf_dir):
    return _sentences(spark, sf_dir).groupBy(T.modality(F.col("s"), F.col("s")).alias("modality"), T.negated(F.col("s")).alias("negated")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with s as ({_SENT}) select {_has(L.COMPLETED)} as over, {_has(L.INITIATED)} as begun, {_has(L.INCREASE)} as up, {_has(L.DECREASE)} as down, count(*) as n from s group by 1, 2, 3, 4")
def direction_phase_flags(spark, sf_dir):
    flag = lambda p, n: T.finds(F.col("s"), p).alias(n)
    return _sentences(spark, sf_dir).groupBy(flag(L.COMPLETED, "over"), flag(L.INITIATED, "begun"), flag(L.INCREASE, "up"), flag(L.DECREASE, "down")).agg(F.count(F.lit(1)).alias("n"))


@query("""with t as (select doc_id, list_distinct(list_transform(list_filter(regexp_extract_all(text, '[a-zA-Z]+'), lambda w: len(w) >= 2), lambda w: lower(w))) as w from documents where text is not null)
select a.doc_id, len(list_intersect(a.w, b.w)) as shared, case when len(list_distinct(list_concat(a.w, b.w))) = 0 then 1.0 else len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) end as jaccard from t a join t b on b.doc_id = a.doc_id + 1""")
def token_jaccard_pairs(spark, sf_dir):
    t = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.content_tokens(F.col("text")).alias("w"))
    n = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return t.join(n, "doc_id").select("doc_id", F.size(F.array_intersect("w", "v")).cast("long").alias("shared"), T.jaccard(F.col("w"), F.col("v")).alias("jaccard"))


def _stem(n: int) -> str:
    return f"substr(w, 1, len(w) - {n})"


def _suffix(stem: str, ends: list[str]) -> str:
    return "(" + " or ".join(f"ends_with({stem}, '{e}')" for e in ends) + ")"


def _twice(stem: str) -> str:
    return f"(len({stem}) > 2 and right({stem}, 1) = substr({stem}, len({stem}) - 1, 1) and right({stem}, 1) not in ('l', 's'))"


@query(f"""with v as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]+')) as word from documents), l as (select word, lower(word) as w from v)
select word, case when len(w) > 4 and (ends_with(w, 'ies') or ends_with(w, 'ied')) then {_stem(3)} || 'y'
when ends_with(w, 'ing') then case when {_twice(_stem(3))} then {_stem(4)} when {_suffix(_stem(3), L.MUTE_E_ING)} then {_stem(3)} || 'e' else {_stem(3)} end
when ends_with(w, 'ed') then case when {_suffix(_stem(2), L.WHOLE_ED)} then {_stem(2)} when {_suffix(_stem(2), L.MUTE_E_ED)} then {_stem(2)} || 'e' when {_twice(_stem(2))} then {_stem(3)} else {_stem(2)} end
when len(w) > 3 and ends_with(w, 's') and not ends_with(w, 'ss') then case when ends_with(w, 'es') then {_stem(2)} else {_stem(1)} end else w end as lemma from l""")
def lemma_en(spark, sf_dir):
    words = _t(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.lemma_en(F.col("word")).alias("lemma"))


# Alignment and candidates over embeddings.

_VEC = "with v as (select vec_id // 50 as pair_id, vec_id as idx, vec_id % 2 as side, list_transform(embedding, lambda x: x::double) as v from embeddings)"
_SIM = f"{_VEC}, s as (select a.pair_id, a.idx, b.idx as j, round(list_inner_product(a.v, b.v), 12) as s from v a join v b on a.pair_id = b.pair_id and a.side = {{x}} and b.side = {{y}}), m as (select pair_id, idx, arg_min(j, (-s, j)) as match, greatest(max(s), 0) as similarity from s group by 1, 2)"


def _sides(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("pair_id"), F.col("vec_id").alias("idx"), (F.col("vec_id") % 2).alias("side"), F.col("embedding").alias("vec"))
    return e.where("side = 0").drop("side"), e.where("side = 1").drop("side")


@query(_SIM.format(x=0, y=1) + " select pair_id, idx, match, round(similarity, 6) as similarity from m")
def align_best_match(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return D.best_matches(a, b, ["pair_id"]).withColumn("similarity", F.round("similarity", 6))


@query(_SIM.format(x=0, y=1) + " select pair_id, idx from m where similarity < 0.6")
def unshared_a(spark, sf_dir):
    return D.unshared(*_sides(spark, sf_dir), ["pair_id"])


@query(_SIM.format(x=1, y=0) + " select pair_id, idx from m where similarity < 0.6")
def unshared_b(spark, sf_dir):
    return D.unshared(*reversed(_sides(spark, sf_dir)), ["pair_id"])


def _vector_claims(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("event_id"), F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))


@query("select a.label::varchar as event_id, a.vec_id as i, b.vec_id as j from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where list_inner_product(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)) >= 0.5")
def claim_candidates(spark, sf_dir):
    return C.candidate_pairs(_vector_claims(spark, sf_dir)).select("event_id", "i", "j")


@query()
def claim_clusters(spark, sf_dir):
    """Complete-link clusters of the candidate graph; greedy, so tested against a plain version instead of SQL."""
    return C.vector_clusters(_vector_claims(spark, sf_dir), 0.6)


# Metrics over labels.


@query("""with c as (select count(*) filter (where quality = 1 and toxic = 1) as tp, count(*) filter (where quality <> 1 and toxic = 1) as fp, count(*) filter (where quality = 1 and toxic <> 1) as fn, count(*) filter (where quality <> 1 and toxic <> 1) as tn from labels),
r as (select *, case when tp + fp = 0 then 1.0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 1.0 else tp / (tp + fn) end as recall from c)
select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1, (tp + tn) / (tp + fp + fn + tn) as accuracy from r""")
def binary_metrics(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("gold"), (F.col("toxic") == 1).alias("pred"))
    return M.binary(rows)


@query("with g as (select unnest(['0', '1']) as gold), p as (select unnest(['0', '1']) as pred) select gold, pred, (select count(*) from labels where quality::varchar = gold and toxic::varchar = pred) as n from g cross join p")
def confusion_matrix(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("gold"), F.col("toxic").cast("string").alias("pred"))
    return M.confusion(rows, ["0", "1"])


@query("""with d as (select lang, source as g, doc_id % 7 as p from documents),
g as (select lang, (sum(n * (n - 1)) // 2)::bigint as n from (select lang, count(*) as n from d where g is not null group by lang, g) group by lang),
p as (select lang, (sum(n * (n - 1)) // 2)::bigint as n from (select lang, count(*) as n from d where p is not null group by lang, p) group by lang),
b as (select lang, (sum(n * (n - 1)) // 2)::bigint as n from (select lang, count(*) as n from d where g is not null and p is not null group by lang, g, p) group by lang),
a as (select lang, count(*) * (count(*) - 1) / 2 as n from d group by lang),
c as (select lang, a.n, coalesce(b.n, 0) as tp, coalesce(p.n, 0) - coalesce(b.n, 0) as fp, coalesce(g.n, 0) - coalesce(b.n, 0) as fn from a left join g using (lang) left join p using (lang) left join b using (lang))
select lang, tp, fp, fn, case when n = 0 then 1.0 else (n - fp - fn) / n end as rand from c""")
def pair_metrics(spark, sf_dir):
    return _pair_metrics(_t(spark, sf_dir, "documents"))


def _pair_metrics(documents: DataFrame) -> DataFrame:
    d = documents.withColumn("text", F.col("doc_id").cast("string"))
    gold, pred = d.select("lang", F.col("source").alias("cluster"), "text"), d.select("lang", F.concat(F.lit("k"), F.col("doc_id") % 7).alias("cluster"), "text")
    return M.clustering(gold, pred, ["lang"]).select("lang", "tp", "fp", "fn", "rand")


@query("select role as category, count(*) as n, count(*) filter (where turn % 2 = 1) as n_merged, count(*) filter (where turn % 2 = 1) / count(*) as rate from conversations group by role")
def false_merge_by_category(spark, sf_dir):
    return M.false_merges(_t(spark, sf_dir, "conversations").select(F.col("role").alias("category"), (F.col("turn") % 2 == 1).alias("merged")))


@query("""with c as (select count(*) filter (where quality = 1 and toxic = 1) as tp, count(*) filter (where quality <> 1 and toxic = 1) as fp, count(*) filter (where quality = 1 and toxic <> 1) as fn, count(*) as n from labels),
r as (select 2.0 * tp / nullif(2 * tp + fp + fn, 0) as f1, (n - fp - fn) / n as accuracy, (select count(*) filter (where turn % 2 = 1) / count(*) from conversations) as rate from c)
select round(greatest(0, 100 * (0.15 * f1 + 0.10 * f1 + 0.15 * f1 + 0.10 * accuracy + 0.20 * f1 + 0.15 * accuracy + 0.15 * accuracy - 0.20 * rate)), 2) as score from r""")
def composite_score(spark, sf_dir):
    """The weighted score, with the labels' F1 and accuracy in the place of the parts."""
    m = M.binary(_t(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("gold"), (F.col("toxic") == 1).alias("pred")))
    merged = _t(spark, sf_dir, "conversations").agg(F.avg((F.col("turn") % 2 == 1).cast("double")).alias("rate"))
    parts = {k: F.col("accuracy") if k in ("normalisation", "relation", "clustering") else F.col("f1") for k in M.WEIGHTS}
    return m.withColumn("one", F.lit(1)).join(merged.withColumn("one", F.lit(1)), "one").select(M.composite(parts, F.col("rate")).alias("score"))


# Streams' batch twins.


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def event_windows(spark, sf_dir):
    return streams.event_windows(_t(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query("""with o as (select user_id, ts, case when ts >= lag(ts) over w + interval 30 minute or lag(ts) over w is null then 1 else 0 end as starts from events window w as (partition by user_id order by ts)),
g as (select *, sum(starts) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from g group by user_id, k""")
def event_sessions(spark, sf_dir):
    return streams.sessions(_t(spark, sf_dir, "events"))


# Small fixed inputs whose results are known; these rules need scripts and trees that the tables don't have.


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names})"


_TOKENS = [
    ("a", 0, 0, "Guards", "guard", "NOUN", "nsubj", 1, True), ("a", 0, 1, "detained", "detain", "VERB", "ROOT", 1, True), ("a", 0, 2, "angry", "angry", "ADJ", "amod", 3, True), ("a", 0, 3, "marchers", "marcher", "NOUN", "dobj", 1, False), ("a", 0, 4, ".", ".", "PUNCT", "punct", 1, False),
    ("b", 0, 0, "Marchers", "marcher", "NOUN", "nsubjpass", 2, True), ("b", 0, 1, "were", "be", "AUX", "auxpass", 2, True), ("b", 0, 2, "detained", "detain", "VERB", "ROOT", 2, True), ("b", 0, 3, "quickly", "quickly", "ADV", "advmod", 2, True), ("b", 0, 4, "by", "by", "ADP", "agent", 2, True), ("b", 0, 5, "guards", "guard", "NOUN", "pobj", 4, False),
]


def _tokens(spark):
    return spark.createDataFrame([("e", *t) for t in _TOKENS], "event_id string, article_id string, sent_idx int, i int, text string, lemma string, pos string, dep string, head int, ws boolean")


@query(_values([("a", "Guards", "ORG", ""), ("a", "marchers", "EVENT_NOUN", "angry"), ("b", "detained", "VERB_ACTION", "quickly")], "article_id, name, type, modifiers"))
def entity_modifiers_passes(spark, sf_dir):
    ents = spark.createDataFrame([("e", "a", 0, 0, 1, "ORG"), ("e", "a", 0, 3, 4, "DATE")], "event_id string, article_id string, sent_idx int, start int, end int, label string")
    return S.descriptors(_tokens(spark), ents).select("article_id", "name", "type", F.array_join("modifiers", ",").alias("modifiers"))


def _event(spark):
    svo = spark.createDataFrame(
        [("e", "a", 0, "detain", ["Guards"], ["marchers"], False), ("e", "b", 0, "detain", ["Marchers"], ["guards"], True), ("e", "c", 0, "occur", ["Harbour City"], [], False), ("e", "c", 1, "praise", ["President Lee"], ["the guards"], False), ("e", "a", 1, "meet", ["Lee"], ["marchers"], False)],
        "event_id string, article_id string, svo_idx int, verb string, subjects array<string>, objects array<string>, is_passive boolean",
    )
    entities = spark.createDataFrame([("e", "c", "President Lee", "PERSON", ["calm"], 0), ("e", "a", "Lee", "PERSON", [], 0), ("e", "a", "Monday", "DATE", [], 1)], "event_id string, article_id string, name string, type string, modifiers array<string>, pos int")
    articles = spark.createDataFrame([("e", x) for x in "abc"], "event_id string, article_id string")
    return svo, entities, articles


@query(_values([("President Lee", "PERSON", "Lee,President Lee", "a,c", 4.266667), ("the guards", A.SVO_TYPE, "Guards,guards,the guards", "a,b,c", 6.1), ("marchers", A.SVO_TYPE, "Marchers,marchers", "a,b", 4.766667)], "name, type, surfaces, article_ids, importance"))
def actor_names(spark, sf_dir):
    """Names of merged actors: most mentions, then the longest, then the first."""
    actors, _ = A.resolve(*_event(spark))
    return actors.select("name", "type", F.array_join("surfaces", ",").alias("surfaces"), F.array_join("article_ids", ",").alias("article_ids"), F.round("importance", 6).alias("importance"))


@query(_values([("police", "the police said", True), ("police", "new policies", False), ("Japan", "Japan Airlines", False), ("卓榮泰", "行政院長卓榮泰", True), ("日本", "日本氣象廳", False), ("熊本", "熊本縣今日", True)], "c, s, inside"))
def span_containment(spark, sf_dir):
    rows = spark.createDataFrame([("police", "the police said"), ("police", "new policies"), ("Japan", "Japan Airlines"), ("卓榮泰", "行政院長卓榮泰"), ("日本", "日本氣象廳"), ("熊本", "熊本縣今日")], "c string, s string")
    return rows.withColumn("inside", A.in_span(F.col("c"), F.col("s")))


@query(_values([("a", 0.0, 0.666667, 0.333333), ("b", 1.0, 0.333333, 0.333333), ("c", 0.0, 0.333333, 0.333333)], "article_id, passive_ratio, mean_agent, mean_patient"))
def framing_features(spark, sf_dir):
    svo, entities, articles = _event(spark)
    _, stats = A.resolve(svo, entities, articles)
    members = spark.createDataFrame([("e", "a", 0), ("e", "b", 0), ("e", "c", 1)], "event_id string, article_id string, cluster long")
    f = N.framing_features(articles.withColumn("n_sentences", F.lit(3)), svo, N.entity_matrix(stats), members)
    return f.select("article_id", *[F.round(c, 6).alias(c) for c in ("passive_ratio", "mean_agent", "mean_patient")])


@query()
def framing_clusters(spark, sf_dir):
    """k-means over outlets of each language; no SQL twin, tested for its invariants."""
    d = _t(spark, sf_dir, "documents").groupBy(F.col("lang").alias("event_id"), F.col("source").alias("article_id")).agg(F.avg("n_chars").alias("c"), F.avg(F.length(F.regexp_replace("text", "[^0-9]", ""))).alias("d"))
    return N.framing_clusters(d.where("event_id is not null and article_id is not null").select("event_id", "article_id", F.array("c", "d").alias("features")))


from outletlens.plans import stories  # noqa: E402, F401  registers its queries here
from outletlens.plans import trees  # noqa: E402, F401
