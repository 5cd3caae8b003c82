"""Command line: ``diff FILE_A FILE_B`` and ``analyze SOURCES...``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from outletlens.operators import diff as D
from outletlens.operators.syntax import svo as svo_of
from outletlens.plans import annotate, event
from outletlens.sources import articles as S
from outletlens.sources import reports as R


def _unit(s: str) -> float:
    v = float(s)
    if not 0 <= v <= 1:
        raise argparse.ArgumentTypeError("must be from 0 to 1")
    return v


def _clusters(s: str) -> int:
    v = int(s)
    if not 1 <= v <= 20:
        raise argparse.ArgumentTypeError("must be from 1 to 20")
    return v


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="outletlens", description="How several outlets report one event.")
    commands = p.add_subparsers(dest="command", required=True)
    d, a = commands.add_parser("diff"), commands.add_parser("analyze")
    d.add_argument("files", nargs=2)
    a.add_argument("sources", nargs="+")
    for c in (d, a):
        c.add_argument("--threshold", type=_unit, default=0.60 if c is d else None)
        c.add_argument("--format", choices=["console", "json"], default="console")
        c.add_argument("-o", "--output")
    a.add_argument("--clusters", type=_clusters)
    a.add_argument("--details", action="store_true")
    a.add_argument("-v", "--verbose", action="store_true")
    return p


def _emit(text: str, output: str | None) -> None:
    if output:
        Path(output).write_text(text, encoding="utf-8")
    else:
        print(text)


def diff(spark: SparkSession, a: str, b: str, threshold: float, as_json: bool, output: str | None) -> None:
    rows = S.raw_pair(spark, a, b).withColumn("event_id", F.lit("pair"))
    names = Path(a).stem, Path(b).stem
    sentences = event.sentence_rows(rows)
    sides = spark.createDataFrame([("pair", names[0], "a"), ("pair", names[1], "b")], "pair_id string, article_id string, side string")
    aligned, only_a, only_b = event.compare(sides, sentences.drop("event_id"), threshold=threshold)
    roles = svo_of(annotate.rule_tokens(sentences))
    ratio = {r["article_id"]: r["passive_ratio"] for r in D.passive_ratio(roles, rows).collect()}
    if as_json:
        report = aligned.orderBy("idx").agg(F.collect_list(F.struct("sent_a", "sent_b", "similarity")).alias("alignments")).withColumn("article_a_id", F.lit(names[0])).withColumn("article_b_id", F.lit(names[1])).withColumn("passive_ratio_a", F.lit(ratio[names[0]])).withColumn("passive_ratio_b", F.lit(ratio[names[1]]))
        _emit(S.to_json(report).first()["json"], output)
        return
    flags = roles.where(F.col("article_id") == names[0]).groupBy("sentence").agg(F.max_by("is_passive", "svo_idx").alias("is_passive"))
    shown = aligned.join(flags, aligned["sent_a"] == flags["sentence"], "left").orderBy("idx")
    none = spark.createDataFrame([], "name string, type string, modifiers_a array<string>, modifiers_b array<string>")
    print(R.diff_report(names, (ratio[names[0]], ratio[names[1]]), shown, only_a.orderBy("idx"), only_b.orderBy("idx"), none))


def analyze(spark: SparkSession, args: argparse.Namespace) -> None:
    folder = len(args.sources) == 1 and Path(args.sources[0]).is_dir()
    found = S.discover(spark, args.sources[0]) if folder else S.load(spark, args.sources)
    event_id = Path(args.sources[0]).resolve().name if folder else "event"
    rows = found.withColumn("event_id", F.lit(event_id))
    sentences = event.sentence_rows(rows)
    tokens = annotate.rule_tokens(sentences)
    none = spark.createDataFrame([], "event_id string, article_id string, name string, type string, modifiers array<string>, pos int")
    done = event.analyse(rows, sentences, svo_of(tokens), none, n_clusters=args.clusters, **({"least": args.threshold} if args.threshold is not None else {}))
    if args.format == "json":
        _emit(S.to_json(R.event_export(rows, done.consensus, done.evidence, done.actors, done.stats, done.framing)).first()["json"], args.output)
    else:
        _emit(R.event_report(event_id, done.consensus, done.actors, done.stats, done.framing, args.details, args.verbose), args.output)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("outletlens").getOrCreate()
    try:
        if args.command == "diff":
            diff(spark, *args.files, args.threshold, args.format == "json", args.output)
        else:
            analyze(spark, args)
    except (OSError, ValueError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
