"""Mixing sources to target weights by fitting token budgets exactly.

Documents are counted by source and exact length. Per source, all but the last CAPACITY words
of the budget beyond whole copies are spent in proportion over the lengths, and a
bounded-knapsack program over the documents that remain fits the rest. Which documents of a
length go in is decided by a seeded order, whose cut-off for each length is found by counting.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, drop_materialised, materialise

WEIGHTS = (3, 1, 2)
CAPACITY = 1 << 16
COLUMNS = ("size", "source_size", "target", "taken")


def targets(sizes: dict, share: Fraction = Fraction(3, 2), most: int = 2, weights: tuple = WEIGHTS) -> dict:
    """Words for each source: by weight, at most `most` times its size, the excess dealt again.

    Sources go by code point, null last, and take the weights in turn.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: Fraction(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def fill(lengths: list[int], counts: list[int], budget: int, capacity: int = CAPACITY) -> list[int]:
    """How many documents of each length make up `budget` words, never more than it.

    All but `capacity` words are spent in proportion, then longest first; the program finds the
    best subset sum of the documents left over for the words left over. So a budget of up to
    `capacity` words gets its best subset sum, and a larger one the best that goes with what
    was spent before: short of it only if no documents left over sum to the words left over.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if total <= budget or not total:
        return list(counts)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    spend = max(0, budget - capacity)
    take = [c * spend // total if n else 0 for n, c in zip(lengths, counts, strict=True)]
    left = budget - sum(n * k for n, k in zip(lengths, take, strict=True))
    for i in order:
        if lengths[i] and left > capacity:
            k = min(counts[i] - take[i], (left - capacity) // lengths[i])
            take[i] += k
            left -= k * lengths[i]
    for i in reversed(order):  # only where every document left over is longer than left - capacity
        while lengths[i] and left > 4 * capacity and take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= lengths[i]
    free = [(lengths[i], i, min(counts[i] - take[i], left // lengths[i])) for i in order if 0 < lengths[i] <= left]
    unit = gcd(*(n for n, _, c in free if c > 0)) or 1
    goal, reach, steps = left // unit, 1, []
    whole = (1 << (goal + 1)) - 1
    for n, i, c in free:
        lot = 1
        while c > 0 and not reach >> goal & 1:
            lot = min(lot, c)
            more = reach | reach << lot * n // unit & whole
            if more != reach:  # what adds no sum is not needed on the way back
                steps.append((reach, i, lot))
            reach, c, lot = more, c - lot, 2 * lot
    best = reach.bit_length() - 1
    for before, i, lot in reversed(steps):
        if not before >> best & 1:
            best -= lot * lengths[i] // unit
            take[i] += lot
    return take


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def _order(seed: int) -> list[Column]:
    """h, i, m: the seeded order of documents of one source and length. m only tells apart rows of one id."""
    doc = F.col("doc_id").cast("long")
    return [F.xxhash64(doc, F.lit(seed)).alias("h"), F.coalesce(doc, F.lit(-(1 << 63))).alias("i"), F.monotonically_increasing_id().alias("m")]


def _running(groups: list[str], order: list[str], what: str) -> Column:
    """The sum of a column over the rows of the group before this one."""
    return F.coalesce(F.sum(what).over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def plan_mix(own: DataFrame) -> DataFrame:
    """For each source and length (s, size): source_size, target, copies of every document, and the
    last document (ch, ci, cm) that goes in once more; c of them there are, and n go in.

    Takes s, size, h, i, m of every row. Only counts are ever ranked: documents of a length are
    counted in about the square root of their number of ranges of h, then one range by id, then
    the rows of one id by partition, so a group of any size, or of one id, is spread out.
    """
    total = {r["s"]: r["n"] for r in own.groupBy("s").agg(F.sum("size").alias("n")).collect()}
    names = {s[1:] if s else None: n for s, n in total.items()}
    goal = targets(names)
    plan = {("=" + s if s is not None else ""): (names[s], float(t), *divmod(t.__floor__(), names[s])) if names[s] else (0, float(t), 0, 0) for s, t in goal.items()}

    def budget(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        whole, goal_, copies, rest = plan[pdf["s"].iloc[0]]
        take = fill(pdf["size"].tolist(), pdf["c"].tolist(), rest)
        return pd.DataFrame({"s": pdf["s"], "size": pdf["size"], "c": pdf["c"], "n": np.array(take, np.int64), "source_size": whole, "target": goal_, "copies": copies})

    lengths = own.groupBy("s", "size").agg(F.count("*").alias("c"))
    chosen = materialise(lengths.groupBy("s").applyInPandas(budget, "s string, size long, c long, n long, source_size long, target double, copies long"))
    group = ["s", "size"]
    part = chosen.where("0 < n AND n < c").select(*group, "n", F.ceil(F.sqrt(F.col("c").cast("double"))).alias("parts"))
    ranged = own.join(_small(part), group).withColumn("r", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("parts")))
    held = ranged.groupBy(*group, "n", "r").agg(F.count("*").alias("k")).withColumn("b", _running(group, ["r"], "k"))
    one = held.where("b < n AND n <= b + k").select(*group, "r", (F.col("n") - F.col("b")).alias("need"))
    by_id = ranged.join(_small(one), [*group, "r"]).groupBy(*group, "need", "h", "i").agg(F.count("*").alias("k"))
    by_id = by_id.withColumn("b", _running(group, ["h", "i"], "k"))
    cut = materialise(by_id.where("b < need AND need <= b + k").select(*group, F.col("h").alias("ch"), F.col("i").alias("ci"), (F.col("need") - F.col("b")).alias("need"), "k"))
    tied = own.join(_small(cut.where("need < k")), group).where("h = ch AND i = ci").withColumn("p", F.shiftright("m", 33))
    held = tied.groupBy(*group, "need", "p").agg(F.count("*").alias("k2")).withColumn("b", _running(group, ["p"], "k2"))
    one = held.where("b < need AND need <= b + k2").select(*group, "p", (F.col("need") - F.col("b")).alias("at"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("m"))
    last = tied.join(_small(one), [*group, "p"]).withColumn("rank", rank).where("rank = at").select(*group, F.col("m").alias("cm"))
    return chosen.join(cut.select(*group, "ch", "ci"), group, "left").join(last, group, "left")


def _small(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A table of lengths, written; for broadcasting if it is within `most` bytes."""
    df = materialise(df)
    return F.broadcast(df) if df.count() * 100 <= most else df


def _once_more() -> Column:
    """Whether a document goes in beyond the copies of its source."""
    before = (F.col("h") < F.col("ch")) | (F.col("h") == F.col("ch")) & ((F.col("i") < F.col("ci")) | (F.col("i") == F.col("ci")) & (F.col("m") <= F.coalesce("cm", F.col("m"))))
    return F.when(F.col("n") == F.col("c"), F.lit(True)).otherwise(F.coalesce(before, F.lit(False)))


def mix(docs: DataFrame, seed: int = 41) -> DataFrame:
    """What the mix takes of every document.

    Returns doc_id, size, source_size, target, taken (repeats counted); doc_id is a whole
    number (long). Null texts have size 0 and take nothing; a null source is a source of its
    own, last in order; a null id is ordered before all others. Of repeated rows each is a
    document; which of wholly equal ones goes in is of no account. No source, no row; an empty
    table gives none. Other columns are left out. Reruns agree: the order of documents of one
    source and length is a seeded hash of the id, then the id. A source's taken words never
    exceed its target, and are what fill() reaches.

    The totals of the sources come to the driver, which assumes sources are few beside
    documents; so are lengths, whose counts are broadcast if they are small enough.
    """
    own = materialise(docs.select("doc_id", _source().alias("s"), _size().alias("size"), *_order(seed)))
    out = own.join(_small(plan_mix(own)), ["s", "size"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + _once_more().cast("long"))).alias("taken"))


def take(docs: DataFrame, seed: int = 41) -> DataFrame:
    """The rows of docs that mix() takes, with size, source_size, target and taken.

    Columns of docs with one of these four names are replaced. Rows are judged one by one by
    the cut-off of their length, so texts stay where they are unless lengths are too many to
    broadcast; null ids and repeated rows as in mix().
    """
    keep = [c for c in docs.columns if c.lower() not in COLUMNS]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(keep)], _source().alias("s"), _size().alias("size"), *_order(seed))
    own = materialise(docs.select(_source().alias("s"), _size().alias("size"), *_order(seed)))
    plan = _small(plan_mix(own))
    drop_materialised(own)
    taken = (F.col("size") * (F.col("copies") + _once_more().cast("long"))).alias("taken")
    out = rows.join(plan, ["s", "size"]).select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(keep)], "size", "source_size", "target", taken)
    return out.where("taken > 0")
