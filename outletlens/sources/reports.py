"""Plain-text reports; what they say is counted, never judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletlens.operators.claims import display_category


def table(rows: list[list[str]], heads: list[str]) -> str:
    """Columns padded to their widest cell."""
    cells = [heads, *[["" if c is None else str(c) for c in r] for r in rows]]
    widths = [max(map(len, c)) for c in zip(*cells, strict=True)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells)


def diff_report(names: tuple[str, str], ratios: tuple[float, float], aligned: DataFrame, only_a: DataFrame, only_b: DataFrame, contrast: DataFrame) -> str:
    """Header, alignment, unshared sentences and descriptors of two articles.

    ``aligned`` holds sent_a, similarity, sent_b, is_passive; ``only_a`` and
    ``only_b`` a sentence each; ``contrast`` name, type, modifiers_a, modifiers_b.
    """
    parts = [f"Comparing: {names[0]} vs {names[1]}", f"Passive ratio A: {ratios[0]:.1%}   Passive ratio B: {ratios[1]:.1%}", "", "Sentence alignment"]
    parts.append(table([[r["sent_a"], f"{r['similarity']:.2f}", r["sent_b"] or "[not covered]", "passive" if r["is_passive"] else "active"] for r in aligned.collect()], [names[0], "Sim", names[1], "Voice A"]))
    a, b = ([r["sentence"] for r in t.collect()] for t in (only_a, only_b))
    if a or b:
        n = max(len(a), len(b))
        parts += ["", "Unshared claims", table([[x, y] for x, y in zip(a + [""] * (n - len(a)), b + [""] * (n - len(b)), strict=True)], [f"Only in {names[0]}", f"Only in {names[1]}"])]
    rows = [[f"[{tag(r['type'])}] {r['name']}", r["type"], ", ".join(r["modifiers_a"]) or "—", ", ".join(r["modifiers_b"]) or "—"] for r in contrast.collect()]
    return "\n".join([*parts, "", "Framing descriptors", table(rows, ["Target", "Type", f"Modifiers in {names[0]}", f"Modifiers in {names[1]}"])] if rows else parts)


def tag(kind: str) -> str:
    return {"VERB_ACTION": "ACTION", "EVENT_NOUN": "EVENT", "PER": "PERSON"}.get(kind, kind)


def event_export(outlets: DataFrame, consensus: DataFrame, evidence: DataFrame, actors: DataFrame, stats: DataFrame, framing: DataFrame) -> DataFrame:
    """One nested row for each event of ``outlets`` (event_id, article_id).

    ``claims`` hold the ``evidence`` of each, by article and sentence; ``actors``
    the ``profiles`` of each in every article; ``framing`` its structural
    clusters. Lists that nothing belongs to are empty.
    """
    rows = lambda name, *cols: F.array_sort(F.collect_list(F.struct(*cols))).alias(name)
    said = evidence.groupBy("event_id", "cluster").agg(rows("evidence", "article_id", "sentence", "similarity"))
    claims = consensus.join(said, ["event_id", "cluster"], "left").groupBy("event_id").agg(
        rows("claims", "cluster_id", "representative", "coverage_count", "total_articles", "coverage_ratio", "category", "article_ids", "absent_ids", "evidence")
    )
    profile = ["article_id", "mention_count", "agent_count", "patient_count", "passive_patient_count", "agent_ratio", "patient_ratio", "passive_patient_ratio", "agent_verbs", "patient_verbs", "modifiers"]
    each = stats.groupBy("event_id", "actor").agg(rows("profiles", *profile))
    ranked = actors.join(each, ["event_id", "actor"], "left").withColumn("_order", -F.col("importance"))
    people = ranked.groupBy("event_id").agg(rows("actors", "_order", "name", "type", "surfaces", "article_ids", "importance", "profiles")).withColumn("actors", F.transform("actors", lambda a: a.dropFields("_order")))
    groups = framing.groupBy("event_id", "label").agg(F.array_sort(F.collect_list("article_id")).alias("article_ids")).groupBy("event_id").agg(rows("framing", "label", "article_ids"))
    out = outlets.groupBy("event_id").agg(F.array_sort(F.collect_set("article_id")).alias("article_ids"))
    for part in (claims, people, groups):
        out = out.join(part, "event_id", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("claims", "actors", "framing")})


def event_report(event_id: str, consensus: DataFrame, actors: DataFrame, stats: DataFrame, framing: DataFrame, details: bool = False, verbose: bool = False) -> str:
    """Claim coverage, participants and structural clusters of one event.

    ``consensus`` holds cluster_id, coverage_count, total_articles, coverage_ratio, absent_ids, article_ids, representative.
    """
    rows = consensus.where(F.col("event_id") == event_id).withColumn("label", display_category(F.col("coverage_ratio"), F.col("coverage_count"))).orderBy(F.desc("coverage_count"), "cluster_id").collect()
    total = rows[0]["total_articles"] if rows else 0
    whole = sum(r["coverage_count"] == total for r in rows)
    most = sum(1 < r["coverage_count"] < total and r["coverage_ratio"] >= 0.5 for r in rows)
    single = sum(r["coverage_count"] == 1 for r in rows)
    parts = [f"Event: {event_id}   Articles: {total}   Claim clusters: {len(rows)}", "", "Claim Coverage", f"Shared by all outlets: {whole}", f"Shared by majority: {most}", f"Single-outlet claims: {single}", ""]
    parts.append(table([[r["cluster_id"], f"{r['coverage_count']}/{total}", r["label"], ", ".join(r["absent_ids"]) or "—", r["representative"]] for r in rows], ["Claim", "Coverage", "Category", "Missing", "Representative"]) if rows else "No claim clusters found.")
    if details:
        parts += ["", *[f"{r['cluster_id']}: in {', '.join(r['article_ids'])}; not in {', '.join(r['absent_ids']) or '—'}" for r in rows]]
    from outletlens.operators.consensus import top_actors

    people = top_actors(actors.where(F.col("event_id") == event_id), None if verbose else 5).orderBy("rank").collect()
    for p in people:
        each = stats.where((F.col("event_id") == event_id) & (F.col("name") == p["name"]) & (F.col("type") == p["type"])).orderBy("article_id").collect()
        parts += ["", f"{p['name']} ({p['type']})", table([[s["article_id"], s["agent_count"], s["patient_count"], s["passive_patient_count"], ", ".join(s["agent_verbs"]), ", ".join(s["patient_verbs"])] for s in each], ["Outlet", "Agent", "Patient", "Passive", "Verbs as agent", "Verbs as patient"])]
    groups = framing.where(F.col("event_id") == event_id).groupBy("label").agg(F.array_sort(F.collect_list("article_id")).alias("ids")).orderBy("label").collect()
    return "\n".join([*parts, "", "Structural clusters", *[f"Cluster {g['label']}: {', '.join(g['ids'])}" for g in groups]])
