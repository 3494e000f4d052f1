"""Preference formatting: the common turns of chosen and rejected conversations once as prompt, and paired masked completions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSISTANT = "assistant"


def conversations_as_rows(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, an array of (turn, role, text) in order of (turn, role, text).

    Turns without a conversation are left out; a null role or text is an empty string; a repeated row is one turn.
    A conversation becomes one row, as it is what gets rendered.
    """
    clean = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    return clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("\n"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
def _spans(role: pd.Series, text: pd.Series, spoken: pd.Series) -> pd.Series:
    """Where the spoken turns' texts lie in the rendered turns, by the turns' numbers of characters: one running sum."""
    out = []
    for r, t, s in zip(role, text, spoken, strict=True):
        r, t, s = np.asarray(r, np.int64), np.asarray(t, np.int64), np.asarray(s, bool)
        end = np.cumsum(r + t + 6) - 1
        out.append([{"start": a, "end": b} for a, b in zip((end - t)[s].tolist(), end[s].tolist(), strict=True)])
    return pd.Series(out, dtype=object)


def _masked(turns: Column) -> Column:
    """(start, end) character ranges of the assistant's words in the rendered turns: what a loss counts."""
    return _spans(F.transform(turns, lambda t: F.length(t["role"])), F.transform(turns, lambda t: F.length(t["text"])), F.transform(turns, lambda t: t["role"] == ASSISTANT))


def preference_format(pairs: DataFrame) -> DataFrame:
    """Format ``pairs(pair_id, chosen, rejected)``, whose sides are arrays of (turn, role, text).

    Returns ``pair_id``, ``prompt_turns`` (length of the longest common prefix; turns are equal if role and text are),
    ``prompt`` (those turns rendered), and for each side the rendered rest (``chosen``, ``rejected``) with the character
    ranges that a loss counts (``chosen_mask``, ``rejected_mask``): the assistant's words. A null side has no turns, a null
    turn is none, a null role or text is empty; equal sides have empty completions. Other columns are ignored.
    """
    kind = "array<struct<turn: bigint, role: string, text: string>>"

    def side(name: str) -> Column:
        some = F.filter(F.coalesce(F.col(name).cast(kind), F.expr(f"cast(array() as {kind})")), lambda t: t.isNotNull())
        return F.transform(some, lambda t: F.struct(t["turn"].alias("turn"), F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))

    p = pairs.select("pair_id", side("chosen").alias("c"), side("rejected").alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    equal = F.zip_with(F.slice("c", F.lit(1), least), F.slice("r", F.lit(1), least), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    p = p.withColumn("differs", F.array_position(equal, F.lit(False)).cast("int")).withColumn("prompt_turns", F.when(F.col("differs") > 0, F.col("differs") - 1).otherwise(least).cast("int"))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    text = lambda turns: F.array_join(F.transform(turns, _rendered), "")
    p = p.select("pair_id", "prompt_turns", F.slice("c", F.lit(1), F.col("prompt_turns")).alias("head"), rest("c").alias("c"), rest("r").alias("r"))
    return p.select("pair_id", "prompt_turns", text(F.col("head")).alias("prompt"), text(F.col("c")).alias("chosen"), _masked(F.col("c")).alias("chosen_mask"), text(F.col("r")).alias("rejected"), _masked(F.col("r")).alias("rejected_mask"))


def mask_text(mask: str) -> Column:
    """A mask as text: ``start-end`` of each range, set apart by blanks."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"], s["end"])), " ")


def stale_reply_pairs(turns: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: the rejected side gives the assistant's last reply as its reply before that.

    One pair for each conversation in which the assistant speaks; a first reply has an empty one as its rejected form, and
    turns after the last reply are left out of both sides. Null ids, roles, texts and repeated rows as in :func:`conversations_as_rows`; a null
    ``turn`` comes first. Other columns are ignored.
    """
    rows = conversations_as_rows(turns)
    last = F.aggregate("turns", F.struct(F.lit(0).alias("i"), F.lit(0).alias("at")), lambda a, t: F.struct((a["i"] + 1).alias("i"), F.when(t["role"] == ASSISTANT, a["i"] + 1).otherwise(a["at"]).alias("at")), lambda a: a["at"])
    rows = rows.withColumn("at", last).where("at > 0")
    head = F.slice("turns", F.lit(1), F.col("at") - 1)
    spoken = F.filter(head, lambda t: t["role"] == ASSISTANT)
    stale = F.coalesce(F.try_element_at(spoken, F.lit(-1))["text"], F.lit(""))
    reply = F.element_at("turns", F.col("at"))
    rejected = F.concat(head, F.array(F.struct(reply["turn"].alias("turn"), reply["role"].alias("role"), stale.alias("text"))))
    return rows.select(F.col("conv_id").alias("pair_id"), F.slice("turns", F.lit(1), F.col("at")).alias("chosen"), rejected.alias("rejected"))
