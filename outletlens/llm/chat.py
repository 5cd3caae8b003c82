"""Preference formatting: chosen and rejected conversations with their common prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _render(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _spans(turns: Column) -> Column:
    """Trained code points of a completion: the text of each assistant turn and its closing mark, as start and end."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.lit(len(OPEN) + 1) + F.length(t["role"])
        end = begin + F.length(t["text"]) + F.lit(len(CLOSE))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preferences(turns: DataFrame) -> DataFrame:
    """One row for each pair from (pair_id, chosen, turn, role, text) rows.

    ``chosen`` says which conversation of its pair a turn belongs to. Turns go
    by number (null first), then role and text; null role or text counts as
    empty. The prompt is the longest run of equal first turns of both sides,
    rendered once; each completion is the rest of its side with the spans of
    its assistant turns, the only characters that are trained. A pair lacking a
    side has no prompt and a null completion there; equal sides have empty
    completions. Rows without pair_id or chosen are left out; an empty table
    gives no rows. One pair, being one value, is held whole.
    """
    clean = turns.where("pair_id is not null and chosen is not null").select("pair_id", "chosen", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    side = lambda is_chosen: F.array_sort(F.collect_list(F.when(F.col("chosen") == is_chosen, F.col("t"))))
    both = clean.groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    differs = F.filter(F.sequence(F.lit(0), least), lambda i: (i == least) | (F.get("c", i)["role"] != F.get("r", i)["role"]) | (F.get("c", i)["text"] != F.get("r", i)["text"]))
    cut = both.withColumn("prompt_turns", F.get(differs, F.lit(0)))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.size(c))
    some = lambda c, x: F.when(F.size(c) > 0, x)
    cut = cut.select("pair_id", "prompt_turns", _text(F.slice("c", F.lit(1), F.col("prompt_turns"))).alias("prompt"), "c", "r", rest("c").alias("rc"), rest("r").alias("rr"))
    return cut.select(
        "pair_id",
        "prompt_turns",
        "prompt",
        some("c", _text(F.col("rc"))).alias("chosen"),
        some("c", _spans(F.col("rc"))).alias("chosen_spans"),
        some("r", _text(F.col("rr"))).alias("rejected"),
        some("r", _spans(F.col("rr"))).alias("rejected_spans"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected), as ``preferences`` takes them."""
    return conversations.select(F.shiftright("conv_id", 1).alias("pair_id"), (F.col("conv_id").bitwiseAND(F.lit(1)) == 0).alias("chosen"), "turn", "role", "text")
