"""Exact order statistics of many groups at once, without holding a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slicework.functions import kernels

#: Bits that each histogram refines; a group has at most 2^16 slots under one prefix.
STEP = 16


def _located(hist: DataFrame, within: list[str], shift: int) -> DataFrame:
    """One row for each prefix that holds a wanted rank, with those ranks and their places inside the prefix."""
    w = W.partitionBy(*within).orderBy("prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = hist.withColumn("upto", F.sum("n").over(w))
    below = F.col("upto") - F.col("n")
    own = F.filter("wanted", lambda x: (x["rest"] >= below) & (x["rest"] < F.col("upto")))
    own = F.transform(own, lambda x: F.struct(x["rank"].alias("rank"), (x["rest"] - below).alias("rest")))
    return counted.select("g", F.col("prefix").alias("parent"), "size", own.alias("wanted")).where(F.size("wanted") > 0)


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """``by`` and ``q``, the quantiles of the doubles in ``value`` with linear interpolation, in the order of ``probs``.

    Nulls don't count, and a group without values has no row; null keys are a group. NaN is the greatest value (a
    quantile that it takes part in is null), and both zeros are one. Values are counted by group and value before anything is shuffled. Doubles are taken as whole numbers
    of the same order; a histogram of their upper 16 bits finds the slots that hold the wanted ranks, and three more
    refine these slots, all groups and ranks together. A task sorts the 65,536 slots of one prefix at most; the table
    of wanted slots has as many rows as groups times twice the quantiles, and is left to the planner to join.
    """
    present = df.where(F.col(value).isNotNull())
    bits = kernels.ordered_bits()(F.col(value).cast("double"))
    counts = present.select(F.struct(*by, F.lit(0).alias("__")).alias("g"), bits.alias("b")).groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"))
    at = lambda p: F.lit(float(p)) * (F.col("size") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(p)), F.ceil(at(p))) for p in probs])))
    top = counts.groupBy("g", F.shiftright("b", 64 - STEP).alias("prefix")).agg(F.sum("n").alias("n"))
    top = top.withColumn("size", F.sum("n").over(W.partitionBy("g")))
    found = _located(top.withColumn("wanted", F.transform(ranks, lambda r: F.struct(r.alias("rank"), r.alias("rest")))), ["g"], 64 - STEP)
    for shift in range(64 - 2 * STEP, -1, -STEP):
        held = counts.withColumn("parent", F.shiftright("b", shift + STEP)).join(found, ["g", "parent"])
        slots = held.groupBy("g", "parent", F.shiftright("b", shift).alias("prefix")).agg(F.sum("n").alias("n"), F.first("size").alias("size"), F.first("wanted").alias("wanted"))
        found = _located(slots, ["g", "parent"], shift)
    each = found.select("g", "size", F.explode("wanted.rank").alias("rank"), kernels.from_ordered_bits()(F.col("parent")).alias("v"))
    own = each.groupBy("g", "size").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("v"))  # two entries a quantile

    def between(p: float) -> Column:
        low, high = F.element_at("v", F.floor(at(p))), F.element_at("v", F.ceil(at(p)))
        return F.when(low == high, low).otherwise(low + (high - low) * (at(p) - F.floor(at(p))))

    return own.select(*[F.col("g")[c].alias(c) for c in by], F.array(*[between(p) for p in probs]).alias("q"))
