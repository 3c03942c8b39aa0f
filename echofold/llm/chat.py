"""Preference formatting of paired conversations, in DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered once as
the prompt; what follows is rendered as two completions, each with the code-point spans that a loss may
count (assistant turns with their end mark; start marks and other roles are masked).

Turns meet under (pair, turn), so no task gathers a conversation before the prefix is known; the prefix
ends at the smallest turn that differs, a partial aggregation. Rendered turns are gathered in parts of
``part_turns`` turn numbers, so that a conversation of any length gives rows of bounded size; offsets
count from the part's start, and prompt, chosen and rejected of a pair are its parts in order.

Defined results: a conversation without a partner is a pair with the other side's id null and text empty
(its prompt is empty). Repeated rows count once; several different rows of one turn stand in order of role
and text. A null turn counts as turn -1, a null role as ``unknown``, a null text as empty; rows of a null
conv_id form the pair null, as chosen side. An empty table gives none. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 4096
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"


def by_parity(conversations: DataFrame) -> DataFrame:
    """Pairs of neighbours: conversation 2k is chosen, 2k + 1 rejected. Adds pair_id and side (0 chosen, 1 rejected)."""
    n = F.col("conv_id").cast("long")
    return conversations.select(
        n.alias("conv_id"), F.floor(n / F.lit(2).cast("decimal(20,0)")).cast("long").alias("pair_id"),
        F.coalesce(F.pmod(n, F.lit(2)), F.lit(0)).cast("int").alias("side"), "turn", "role", "text",
    )


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))))


def spans(turns: Column) -> Column:
    """start:end of what a loss may count, comma-joined: text and end mark of each assistant turn."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    head = lambda t: F.lit(len(START) + len(MIDDLE)) + F.char_length(t["role"])
    size = lambda t: F.char_length(t["text"]) + F.lit(len(END))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + head(t)
        span = F.concat(begin.cast("string"), F.lit(":"), (begin + size(t)).cast("string"))
        return F.struct((begin + size(t)).alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, zero, step, lambda acc: F.array_join(acc["out"], ","))


def preferences(sides: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """sides: pair_id, side (0 chosen, 1 rejected), conv_id, turn, role, text.

    Returns pair_id, part, chosen_id, rejected_id, n_prompt_turns (of this part), prompt, chosen,
    chosen_spans, rejected, rejected_spans.
    """
    turn = F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    of = lambda k: F.sort_array(F.collect_set(F.when(F.col("side") == k, turn)))
    met = (
        sides.withColumn("pos", F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")))
        .groupBy("pair_id", "pos")
        .agg(of(0).alias("c"), of(1).alias("r"), F.max(F.when(F.col("side") == 0, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(F.col("side") == 1, F.col("conv_id"))).alias("rejected_id"))
    )
    ends = met.groupBy("pair_id").agg(
        F.min(F.when(F.col("c") != F.col("r"), F.col("pos"))).alias("differs"),
        F.max("chosen_id").alias("chosen_id"), F.max("rejected_id").alias("rejected_id"),
    ).withColumnRenamed("pair_id", "of_pair")
    shared = F.col("differs").isNull() | (F.col("pos") < F.col("differs"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    rows = (
        met.drop("chosen_id", "rejected_id")
        .join(ends, F.col("pair_id").eqNullSafe(F.col("of_pair")))
        .select(
            "pair_id", "chosen_id", "rejected_id", F.floor(F.greatest("pos", F.lit(0)) / part_turns).cast("long").alias("part"),
            F.struct("pos", F.when(shared, F.col("c")).otherwise(none).alias("p"), F.when(shared, none).otherwise(F.col("c")).alias("c"), F.when(shared, none).otherwise(F.col("r")).alias("r")).alias("t"),
        )
    )
    parts = rows.groupBy("pair_id", "part").agg(F.first("chosen_id").alias("chosen_id"), F.first("rejected_id").alias("rejected_id"), F.sort_array(F.collect_list("t")).alias("t"))
    flat = parts.select("pair_id", "part", "chosen_id", "rejected_id", *[F.flatten(F.col(f"t.{x}")).alias(x) for x in "pcr"])
    return flat.select(
        "pair_id", "part", "chosen_id", "rejected_id", F.size("p").cast("long").alias("n_prompt_turns"),
        render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), spans(F.col("c")).alias("chosen_spans"),
        render(F.col("r")).alias("rejected"), spans(F.col("r")).alias("rejected_spans"),
    )
