"""Preference formatting of conversations (operator 10).

The longest common turn prefix of a chosen and a rejected conversation is
rendered once as prompt; what follows in each becomes a completion in segments,
of which those the model is to learn are marked. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitlens.llm.common import stored
from admitlens.llm.mixing import ranked

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"
BUCKET = 1024            # neighbours among which replies are exchanged, at least


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): turns in order of turn, ties by role and text; null roles
    and texts are empty. Rows without conv_id take no part."""
    t = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = F.transform(F.sort_array(F.collect_list(t)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return conversations.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(said.alias("turns"))


def _safe(c: Column) -> Column:
    """Text cannot pass for a marker."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(t["role"]), F.lit(MIDDLE))


def _body(t: Column) -> Column:
    return F.concat(_safe(t["text"]), F.lit(CLOSE))


def rendered(said: Column) -> Column:
    return F.array_join(F.transform(said, lambda t: F.concat(_head(t), _body(t))), "")


def segments(said: Column) -> Column:
    """(text, learn) in order: who speaks, never learnt, and what they say."""
    return F.flatten(F.transform(said, lambda t: F.array(
        F.struct(_head(t).alias("text"), F.lit(False).alias("learn")),
        F.struct(_body(t).alias("text"), (t["role"] == LEARNED).alias("learn")))))


def common_turns(a: Column, b: Column) -> Column:
    """Turns at the start that are the same in role and text."""
    shared = F.least(F.size(a), F.size(b))
    places = F.when(shared > 0, F.sequence(F.lit(0), shared - 1)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: ~(F.get(a, i).eqNullSafe(F.get(b, i))))
    return F.coalesce(F.get(differ, F.lit(0)), shared)


def preferences(pairs: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """(pair_id, chosen, rejected: arrays of (role, text)) -> pair_id, prompt,
    prompt_turns, chosen, rejected, chosen_segments, rejected_segments, valid.

    A completion is the concatenation of its segments. ``valid`` says whether
    both completions hold something to learn and differ; equal conversations
    have empty completions and are not valid, nor are those of which one is the
    beginning of the other. A null conversation is one without turns.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    p = pairs.select(id_col, F.coalesce("chosen", empty).alias("c"), F.coalesce("rejected", empty).alias("r"))
    p = p.withColumn("n", common_turns(F.col("c"), F.col("r")))

    def rest(x):
        return F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))

    p = p.select(id_col, rendered(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"), F.col("n").alias("prompt_turns"),
                 rest(F.col("c")).alias("c"), rest(F.col("r")).alias("r"))
    learns = F.exists("c", lambda t: t["role"] == LEARNED) & F.exists("r", lambda t: t["role"] == LEARNED)
    return p.select(id_col, "prompt", "prompt_turns", rendered(F.col("c")).alias("chosen"),
                    rendered(F.col("r")).alias("rejected"), segments(F.col("c")).alias("chosen_segments"),
                    segments(F.col("r")).alias("rejected_segments"), learns.alias("valid"))


def exchanged_replies(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): each conversation up to its last reply against
    the same turns with the last reply of the next conversation in its place.
    Next goes by conv_id, however far apart ids lie: conversations are ranked over range
    partitions and exchange within blocks of at least ``BUCKET`` neighbours (fewer, if
    there are no more), the first behind the last, so an exchange is a bounded sort.
    Conversations without a reply have nothing to prefer and are left out; a single
    one meets itself."""
    t = turns(conversations)
    last = F.array_max(F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get("turns", i - 1)["role"] == LEARNED))
    t = stored(t.withColumn("last", last).where(F.col("last").isNotNull())
               .withColumn("reply", F.get("turns", F.col("last") - 1)["text"]), "replies")
    blocks = max(t.count() // BUCKET, 1)
    placed = ranked(t.select("conv_id", "reply"), F.col("conv_id").asc(), "rank").withColumn(
        "block", F.least(F.floor(F.col("rank") / BUCKET), F.lit(blocks - 1)))
    by = Window.partitionBy("block").orderBy("rank")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.coalesce(F.lead("reply").over(by), F.first("reply").over(whole))
    t = t.join(placed.select("conv_id", other.alias("other")), "conv_id")
    before = F.slice("turns", F.lit(1), F.col("last") - 1)
    swapped = F.array(F.struct(F.lit(LEARNED).alias("role"), F.col("other").alias("text")))
    return t.select(F.col("conv_id").alias("pair_id"), F.slice("turns", F.lit(1), F.col("last")).alias("chosen"),
                    F.concat(before, swapped).alias("rejected"))
