"""Preference formatting with DataFrame functions: shared turns once as prompt, paired masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, running

#: The roles whose text a model learns from.
TRAINED = ("assistant",)
_TURNS = "array<struct<role:string,text:string>>"


def rendered(turn: Column) -> Column:
    """One turn between its markers; signs of markers inside a role or a text are taken apart."""
    return F.concat(F.lit("<|"), _role(turn), F.lit("|>\n"), F.replace(turn["text"], F.lit("<|"), F.lit("< |")), F.lit("\n<|end|>\n"))


def _role(turn: Column) -> Column:
    return F.replace(F.replace(F.replace(turn["role"], F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")), F.lit("\n"), F.lit(" "))


def clean_turns(turns: Column) -> Column:
    """Null roles are unknown, null texts empty, null turns absent."""
    return F.transform(F.filter(F.coalesce(turns, F.array().cast(_TURNS)), lambda t: t.isNotNull()), lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns are equal."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, x: F.struct((acc["n"] + (acc["on"] & x).cast("int")).alias("n"), (acc["on"] & x).alias("on")), lambda acc: acc["n"])


def _mask(turns: Column) -> Column:
    """start:end in code points, comma-joined, of what is learnt in a completion: the trained roles' texts with their end markers."""

    def spans(ts: Column) -> Column:
        before = running(F.transform(ts, lambda t: F.length(rendered(t)).cast("long")))
        head = lambda t: F.length(_role(t)) + 5
        placed = F.zip_with(ts, before, lambda t, b: F.struct(t["role"].alias("role"), (b + head(t)).alias("start"), (b + F.length(rendered(t))).alias("end")))
        return F.transform(F.filter(placed, lambda p: p["role"].isin(*TRAINED)), lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string")))

    return F.concat_ws(",", let(turns, spans))


def preference_pairs(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask for each row of pairs.

    pairs has the columns key, chosen and rejected, these as arrays of struct role, text. The prompt is the
    longest run of leading turns that both share; what follows on each side is its completion, and the masks
    tell which code points of a completion are learnt. Null or empty conversations give empty strings; equal
    conversations are all prompt, with two empty completions. Repeated rows stay; other columns are not read; an
    empty table gives none.
    """
    rows = pairs.select(F.col(key), clean_turns(F.col("chosen")).alias("chosen"), clean_turns(F.col("rejected")).alias("rejected"))
    rows = rows.withColumn("n", common_prefix(F.col("chosen"), F.col("rejected")))
    tail = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c), F.lit(1)))
    text = lambda turns: F.array_join(F.transform(turns, rendered), "")
    return rows.select(
        key,
        F.col("n").cast("long").alias("prompt_turns"),
        text(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"),
        text(tail("chosen")).alias("chosen"),
        text(tail("rejected")).alias("rejected"),
        _mask(tail("chosen")).alias("chosen_mask"),
        _mask(tail("rejected")).alias("rejected_mask"),
    )


def self_pairs(conversations: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected from conversations (conv_id, turn, role, text).

    Chosen ends with the conversation's last assistant turn. Rejected has in that place the text of its first
    assistant turn or, if there is only one, that of its first turn, said again by the assistant. A conversation
    without an assistant turn is paired with itself. Repeated rows count once; turns of one number are ordered by
    role and text, nulls first. Rows without a conv_id take no part.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("pair_id is not null")
    # set, not list: repeated rows are dropped before the shuffle
    rows = turns.groupBy("pair_id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    rows = rows.withColumn("places", places)
    bare = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rows = rows.select("pair_id", bare.alias("turns"), F.try_element_at("places", F.lit(-1)).alias("last"), F.try_element_at("places", F.lit(1)).alias("first"))
    again = F.get("turns", F.when(F.col("first") < F.col("last"), F.col("first")).otherwise(F.lit(0)))
    other = F.array(F.struct(F.lit("assistant").alias("role"), again["text"].alias("text"))).cast(_TURNS)
    chosen, rejected = F.slice("turns", F.lit(1), F.col("last") + 1), F.concat(F.slice("turns", F.lit(1), F.col("last")), other)
    return rows.select("pair_id", F.coalesce(chosen, "turns").alias("chosen"), F.coalesce(rejected, "turns").alias("rejected"))
