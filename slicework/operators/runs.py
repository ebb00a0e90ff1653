"""Training-log analytics: series of (run, step, value) and result histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def filter_metrics(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, key: str = "key") -> DataFrame:
    """Metrics whose name has any of ``include`` and none of ``exclude``, in any case; it is an error if none is left."""
    low = F.lower(key)
    keep = F.lit(True)
    if include:
        keep = F.lit(False)
        for s in include:
            keep = keep | low.contains(s.lower())
    for s in exclude or []:
        keep = keep & ~low.contains(s.lower())
    out = df.where(keep)
    if out.isEmpty():
        raise ValueError(f"no metric with {include or 'any name'} and without {exclude or 'any'}")
    return out


def last_hours(df: DataFrame, ts: str, hours: float) -> DataFrame:
    """Rows of the last hours before the latest time; all rows if none has a time."""
    top = df.agg(F.max(ts).alias("__top"))
    keep = F.col("__top").isNull() | (F.col(ts) >= F.col("__top") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0)))
    return df.join(F.broadcast(top), F.lit(True)).where(keep).drop("__top")  # one row


def moving_average(df: DataFrame, run: str, step: str, value: str, width: int) -> DataFrame:
    """Mean of the last points, fewer at the start; the raw value where the width is 1 or more than the series."""
    w = W.partitionBy(run).orderBy(step)
    mean = F.avg(value).over(w.rowsBetween(-(width - 1), 0)) if width > 1 else F.col(value)
    n = F.count(F.lit(1)).over(W.partitionBy(run))
    return df.withColumn("smooth", F.when(F.lit(width) > n, F.col(value)).otherwise(mean))


def every_n(df: DataFrame, run: str, step: str, n: int) -> DataFrame:
    return df.withColumn("__i", F.row_number().over(W.partitionBy(run).orderBy(step)) - 1).where(F.col("__i") % n == 0).drop("__i")


def tail_percent(df: DataFrame, run: str, step: str, percent: float) -> DataFrame:
    """The last part of each series, one row at least."""
    p = max(0.0, min(100.0, percent))
    n = F.count(F.lit(1)).over(W.partitionBy(run))
    first = F.least(F.floor(n * (1 - p / 100)), n - 1)
    i = F.row_number().over(W.partitionBy(run).orderBy(step)) - 1
    return df.withColumns({"__i": i, "__f": first}).where("__i >= __f").drop("__i", "__f")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def best_step(df: DataFrame, run: str, step: str, value: str, mode: str = "max") -> DataFrame:
    """Of each series the first row of the best value; NaN and null never win."""
    sign = 1 if mode == "max" else -1
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    w = W.partitionBy(run).orderBy(F.desc(F.col(value) * sign), step)
    return ok.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def early_stop(df: DataFrame, run: str, step: str, loss: str, patience: int = 30) -> DataFrame:
    """Running best, steps since the last strict improvement, and whether training has stopped by then."""
    w = W.partitionBy(run).orderBy(step)
    i = F.row_number().over(w)
    out = df.withColumns({"__i": i, "best": F.min(loss).over(w.rowsBetween(W.unboundedPreceding, 0)), "__before": F.min(loss).over(w.rowsBetween(W.unboundedPreceding, -1))})
    better = F.col("__before").isNull() | (F.col(loss) < F.col("__before"))
    out = out.withColumn("since", F.col("__i") - F.max(F.when(better, F.col("__i"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = out.withColumn("stopped", F.max(F.col("since") >= patience).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.drop("__i", "__before")


def select_radii(df: DataFrame, task: str, radii: list[int], radius: str = "radius") -> DataFrame:
    whole = F.expr(f"try_cast(`{radius}` as int)")
    return df.where((F.col("task") == task) & whole.isin(*radii)).withColumn(radius, whole)


def error_bars(df: DataFrame) -> DataFrame:
    return df.withColumns({"err_low": F.col("mean") - F.col("ci_low"), "err_high": F.col("ci_high") - F.col("mean")})
