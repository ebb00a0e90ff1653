"""Queries on training logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from slicework.functions import names as n
from slicework.operators import runs
from slicework.plans.registry import query
from slicework.sources.sinks import scratch
from slicework.sources.tables import read_run_logs

S = "s as (select event_type as run, event_id as step, round(value,4) as value, ts from events)"


def series(t):
    return t.events.select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.round("value", 4).alias("value"), F.col("ts").cast("timestamp").alias("ts"))


@query("s12_read_run_logs", "select event_type as run, count(*) as n from events where event_id % 3 <> 1 group by 1")
def _(t):
    path = scratch(t.spark, "logs")
    line = F.expr("case line_no % 3 when 1 then substring_index(line,'Iteration',1) when 2 then upper(line) else line end")
    t.logs.select("run", line.alias("line")).write.partitionBy("run").text(path)
    folders = [f"{path}/run={r[0]}" for r in t.logs.select("run").distinct().collect()]
    return read_run_logs(t.spark, folders).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query("p11_metric_name_filter", "select count(*) as n, round(sum(value),4) as s from events")
def _(t):
    kv = runs.filter_metrics(n.parse_log_kv(t.logs), ["LOSS"], ["teacher"])
    return kv.join(t.events.select(F.col("event_id").alias("line_no"), F.col("value").alias("v")), "line_no").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("s"))


@query("p12_last_hours", f"with {S} select run, step, value from s where ts >= (select max(ts) from s) - interval 48 hours")
def _(t):
    return runs.last_hours(series(t), "ts", 48).select("run", "step", "value")


@query("w01_moving_average", f"with {S} select run, step, round(avg(value) over (partition by run order by step rows between 4 preceding and current row),6) as smooth from s")
def _(t):
    return runs.moving_average(series(t), "run", "step", "value", 5).select("run", "step", F.round("smooth", 6).alias("smooth"))


@query("w02_downsample_every", f"with {S} select run, step from s qualify (row_number() over (partition by run order by step)-1) % 10 = 0")
def _(t):
    return runs.every_n(series(t), "run", "step", 10).select("run", "step")


@query("w03_tail_percent", f"with {S}, i as (select *, row_number() over (partition by run order by step)-1 i, count(*) over (partition by run) n from s) select run, step from i where i >= least(floor(n*(1-12.5/100)), n-1)")
def _(t):
    return runs.tail_percent(series(t), "run", "step", 12.5).select("run", "step")


@query("w04_last_per_key", "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def _(t):
    return runs.last_per_key(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("w05_best_step", f"with {S} select run, step, value, 'max' as mode from s qualify row_number() over (partition by run order by value desc, step) = 1 union all select run, step, value, 'min' from s qualify row_number() over (partition by run order by value, step) = 1")
def _(t):
    best = lambda m: runs.best_step(series(t), "run", "step", "value", m).select("run", "step", "value", F.lit(m).alias("mode"))
    return best("max").unionByName(best("min"))


@query("w06_early_stopping", f"with {S}, a as (select *, row_number() over w i, min(value) over (w rows between unbounded preceding and current row) best, min(value) over (w rows between unbounded preceding and 1 preceding) before from s window w as (partition by run order by step)), b as (select *, i - max(case when before is null or value < before then i end) over (partition by run order by step rows between unbounded preceding and current row) since from a) select run, step, best, since::int as since, max(since >= 30) over (partition by run order by step rows between unbounded preceding and current row) as stopped from b")
def _(t):
    return runs.early_stop(series(t), "run", "step", "value", 30).select("run", "step", "best", "since", "stopped")


@query("p13_task_radius_filter", "select p_partkey, p_size as radius from part where p_type = 'SMALL' and p_size in (1,5,9)")
def _(t):
    p = t.part.select("p_partkey", F.col("p_type").alias("task"), F.col("p_size").cast("string").alias("radius"))
    return runs.select_radii(p, "SMALL", [1, 5, 9]).select("p_partkey", "radius")


@query("p15_error_bars", "select event_type, round(avg(value)-min(value),6) as err_low, round(max(value)-avg(value),6) as err_high from events group by 1")
def _(t):
    e = t.events.groupBy("event_type").agg(F.avg("value").alias("mean"), F.min("value").alias("ci_low"), F.max("value").alias("ci_high"))
    return runs.error_bars(e).select("event_type", F.round("err_low", 6).alias("err_low"), F.round("err_high", 6).alias("err_high"))


@query("j14_compare_variants", "with a as (select event_type, round(avg(value),6) v from events where user_id % 2 = 0 group by 1), b as (select event_type, round(avg(value),6) v from events where user_id % 2 = 1 group by 1) select event_type, a.v as value_a, b.v as value_b from a full join b using (event_type)")
def _(t):
    from slicework.operators.pairs import compare_variants

    side = lambda k: t.events.where(F.col("user_id") % 2 == k).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("value"))
    return compare_variants(side(0), side(1), ["event_type"], "value")
