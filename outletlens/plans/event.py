"""Whole analyses: from sentences of many events to claims, actors, framing and consensus, and the diff of two articles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from outletlens.functions import text as T
from outletlens.operators import actors as A
from outletlens.operators import claims as C
from outletlens.operators import consensus as N
from outletlens.operators import diff as D
from outletlens.operators import propositions as P
from outletlens.operators import verify as V
from outletlens.plans.annotate import embedded
from outletlens.plans.shared import save


@dataclass
class Analysis:
    """The tables of an analysis, each keyed by event_id."""

    claims: DataFrame
    pairs: DataFrame
    edges: DataFrame
    members: DataFrame
    consensus: DataFrame
    evidence: DataFrame
    actors: DataFrame | None
    stats: DataFrame | None
    framing: DataFrame | None


def sentence_rows(articles: DataFrame) -> DataFrame:
    """event_id, article_id, sentence_idx, sentence from article texts."""
    clean = articles.withColumn("_s", T.sentences(T.clean_text(F.coalesce("text", F.lit("")))))
    return clean.select(F.col("event_id").cast("string").alias("event_id"), F.col("article_id").cast("string").alias("article_id"), F.posexplode("_s").alias("sentence_idx", "sentence"))


def claim_tables(sentences: DataFrame, embed_fn=None, least: float = C.CANDIDATE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(claims, candidate pairs, verified edges, cluster members) of events' sentences."""
    props = P.propositions(sentences)
    order = W.partitionBy("event_id").orderBy("article_id", "sentence_idx", "prop_idx")
    claims = save(V.features(embedded(props, embed_fn).withColumn("idx", (F.row_number().over(order) - 1).cast("long"))), "claims")
    pairs = save(C.candidate_pairs(claims, least), "pairs")
    edges = save(C.verified_edges(claims, pairs), "edges")
    members = save(C.coherent(claims.select("event_id", "article_id", "idx", "text", "sentence", "speaker", "vec").join(C.clusters(claims, edges), ["event_id", "idx"]), edges), "members")
    return claims, pairs, edges, members


def analyse(articles: DataFrame, sentences: DataFrame | None = None, svo: DataFrame | None = None, entities: DataFrame | None = None, embed_fn=None, n_clusters: int | None = None, least: float = C.CANDIDATE) -> Analysis:
    """Everything about the events of ``articles`` (event_id, article_id, text).

    Actors and framing need ``svo`` and ``entities``. Every event must have two articles.
    """
    few = articles.groupBy("event_id").agg(F.countDistinct("article_id").alias("n")).where("n < 2").first()
    if few:
        raise ValueError(f"event {few['event_id']} has fewer than two articles")
    sentences = sentences if sentences is not None else sentence_rows(articles)
    outlets = articles.select(F.col("event_id").cast("string").alias("event_id"), F.col("article_id").cast("string").alias("article_id")).distinct()
    claims, pairs, edges, members = claim_tables(sentences, embed_fn, least)
    reps = C.representatives(members)
    text = members.select("event_id", F.col("idx").alias("representative"), F.col("text").alias("_text"))
    covered = C.numbered(C.coverage(members, outlets)).join(reps, ["event_id", "cluster"]).join(text, ["event_id", "representative"]).drop("representative").withColumnRenamed("_text", "representative")
    view = N.consensus(covered)
    actors = stats = framing = None
    if svo is not None and entities is not None:
        actors, stats = A.resolve(svo, entities, outlets)
        stats = save(stats, "stats")
        counted = outlets.join(sentences.groupBy("event_id", "article_id").agg(F.count(F.lit(1)).alias("n_sentences")), ["event_id", "article_id"], "left")
        framing = N.framing_clusters(N.framing_features(counted, svo, N.entity_matrix(stats), members), n_clusters)
    return Analysis(claims, pairs, edges, members, view, C.evidence(members, reps), actors, stats, framing)


def compare(articles: DataFrame, sentences: DataFrame, svo: DataFrame | None = None, embed_fn=None, threshold: float = 0.60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(alignments of A, sentences only in A, sentences only in B) of pairs of articles.

    ``articles`` holds pair_id, article_id, side (a or b); ``sentences`` article_id, sentence_idx, sentence.
    """
    rows = embedded(sentences.join(articles.select("pair_id", "article_id", "side"), "article_id").withColumnRenamed("sentence_idx", "idx"), embed_fn, "sentence")
    a, b = rows.where("side = 'a'"), rows.where("side = 'b'")
    named = lambda t, key, n: t.select("pair_id", F.col("idx").alias(key), F.col("sentence").alias(f"sent_{n}"))
    aligned = D.alignments(a, b, ["pair_id"], threshold).join(named(a, "idx", "a"), ["pair_id", "idx"]).join(named(b, "match", "b"), ["pair_id", "match"], "left")
    with_text = lambda t, u: t.join(u.select("pair_id", "idx", "sentence"), ["pair_id", "idx"])
    return aligned.select("pair_id", "idx", "sent_a", "similarity", "sent_b"), with_text(D.unshared(a, b, ["pair_id"], threshold), a), with_text(D.unshared(b, a, ["pair_id"], threshold), b)
