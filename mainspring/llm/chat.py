"""Preference formatting: one prompt from the common turns, and two masked completions.

Only DataFrame functions: turns become an array per conversation, the longest common prefix is
the place of the first differing pair, and templates are rendered by array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def turns(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """key and `turns`, an array of (turn, role, text) in order; rows with a null key are left out."""
    return conversations.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def _head(x: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(x["role"], F.lit("")), F.lit(CLOSE))


def _body(x: Column) -> Column:
    return F.concat(F.coalesce(x["text"], F.lit("")), F.lit(END))


def _render(own: Column) -> Column:
    return F.array_join(F.transform(own, lambda x: F.concat(_head(x), _body(x))), "")


PIECE = 64


def _starts(sizes: Column) -> Column:
    """The sum of the sizes before each one.

    Running sums grow an array by a copy a step, so they run over pieces of PIECE sizes, and over
    the pieces' totals: many turns cost little more than a few.
    """
    def running(own: Column, first: Column) -> Column:
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(own, F.struct(first.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), step, lambda acc: acc["out"])

    count = F.ceil(F.size(sizes) / PIECE).cast("int")
    pieces = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(sizes, k * PIECE + 1, F.lit(PIECE)))).otherwise(F.array().cast("array<array<bigint>>"))
    totals = F.transform(pieces, lambda own: F.aggregate(own, F.lit(0).cast("long"), lambda acc, n: acc + n))
    return F.flatten(F.zip_with(pieces, running(totals, F.lit(0)), running))


def _mask(own: Column, trained: str) -> Column:
    """start:end of what is trained on: the text and end mark of the `trained` role's turns."""
    sizes = F.transform(own, lambda x: (F.length(_head(x)) + F.length(_body(x))).cast("long"))

    def span(x, at):
        start = at + F.length(_head(x))
        return F.when(x["role"] == trained, F.concat(start.cast("string"), F.lit(":"), (start + F.length(_body(x))).cast("string")))

    return F.array_join(F.zip_with(own, _starts(sizes), span), ",")  # nulls are left out


def format_preferences(pairs: DataFrame, trained: str = "assistant", equal: str = "keep") -> DataFrame:
    """Prompt and completions of pairs (pair_id, chosen, rejected), both arrays of turns.

    Returns pair_id, common (number of turns of the longest common prefix, by role and text),
    prompt (those turns, rendered once), chosen and rejected (the other turns), chosen_mask and
    rejected_mask (start:end of the characters of each completion that are trained on, comma
    joined). A null array counts as empty; null roles and texts equal each other and render as
    nothing. Equal conversations have empty completions, which teach no preference: `equal`
    says whether such pairs keep their row ("keep") or not ("drop"). Without a common turn the
    prompt is empty. Repeated pairs each get a row; other columns are left out. A pair is one
    row, so its rendered turns must fit into one string of 2 GB.
    """
    if equal not in ("keep", "drop"):
        raise ValueError(f"equal {equal!r} is neither keep nor drop")
    empty = F.array().cast("array<struct<turn: bigint, role: string, text: string>>")
    a, b = F.coalesce("chosen", empty), F.coalesce("rejected", empty)
    shape = lambda x: F.transform(x, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    own = pairs.select("pair_id", shape(a).alias("a"), shape(b).alias("b"))
    differ = F.zip_with("a", "b", lambda x, y: ~(x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])) | x.isNull() | y.isNull())
    first = F.array_position(differ, True).cast("int")
    own = own.withColumn("common", F.when(first > 0, first - 1).otherwise(F.least(F.size("a"), F.size("b"))))
    if equal == "drop":
        own = own.where((F.col("common") < F.size("a")) | (F.col("common") < F.size("b")))
    rest = lambda c: F.slice(c, F.col("common") + 1, F.size(c))
    own = own.select("pair_id", "common", F.slice("a", F.lit(1), F.col("common")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return own.select("pair_id", F.col("common").cast("long").alias("common"), _render(F.col("p")).alias("prompt"), _render(F.col("a")).alias("chosen"), _render(F.col("b")).alias("rejected"), _mask(F.col("a"), trained).alias("chosen_mask"), _mask(F.col("b"), trained).alias("rejected_mask"))


def revisit_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from conversations alone: the last assistant turn against the first one's text.

    chosen is each conversation, rejected the same up to its last assistant turn, which there
    repeats the first assistant turn's answer; later turns are left out of both. Conversations
    without an assistant turn give no pair; one with a single such turn, or whose first and last
    answers are the same, pairs equal ones. Turns with equal numbers are ordered by role and
    text, so repeated rows are repeated turns.
    """
    own = turns(conversations).withColumnRenamed("conv_id", "pair_id")
    own = own.withColumn("roles", F.transform("turns", lambda x: F.coalesce(x["role"], F.lit("")) == "assistant"))
    own = own.where(F.array_contains("roles", True))
    first = F.array_position("roles", True).cast("int")
    last = F.size("roles") - F.array_position(F.reverse("roles"), True).cast("int") + 1
    answer = F.element_at("turns", first)["text"]
    final = F.element_at("turns", last)
    swapped = F.concat(F.slice("turns", F.lit(1), last - 1), F.array(F.struct(final["turn"].alias("turn"), final["role"].alias("role"), answer.alias("text"))))
    return own.select("pair_id", F.slice("turns", F.lit(1), last).alias("chosen"), swapped.alias("rejected"))
