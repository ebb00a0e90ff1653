"""Queries that write and read tables, stream them, or fit models on them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from slicework.operators import learn
from slicework.plans.registry import query
from slicework.sources import sinks
from slicework.streaming.ingest import incremental_ingest, keep_recent, live_metrics

c = F.col


def slices(t):
    return t.images.select("image_id", "volume_id", F.expr("if(volume_id % 5 = 0,'val','train')").alias("split"), F.concat(F.lit("ds"), c("volume_id") % 3).alias("dataset"), "px")


COUNTS = "select split, dataset, count(*) as n from (select case when volume_id % 5 = 0 then 'val' else 'train' end as split, 'ds'||(volume_id % 3) as dataset from fx_images) group by 1,2"


@query("k01_write_slices", COUNTS)
def _(t):
    path = sinks.scratch(t.spark, "slices")
    sinks.write_slices(slices(t), path)
    return t.spark.read.parquet(path).groupBy("split", "dataset").agg(F.count(F.lit(1)).alias("n"))


@query("k04_overwrite_mode", COUNTS)
def _(t):
    path = sinks.scratch(t.spark, "slices")
    sinks.write_slices(slices(t), path)
    sinks.overwrite_partitions(slices(t).where("split = 'val'"), path, ["split", "dataset"])
    return t.spark.read.parquet(path).groupBy("split", "dataset").agg(F.count(F.lit(1)).alias("n"))


@query("k07_write_metrics_csv", "select o_orderkey, o_totalprice from orders")
def _(t):
    path = sinks.scratch(t.spark, "metrics")
    sinks.write_csv(t.orders, path, ["o_orderkey", "o_totalprice"])
    kinds = dict(t.orders.dtypes)
    return t.spark.read.schema(f"o_orderkey {kinds['o_orderkey']}, o_totalprice {kinds['o_totalprice']}").csv(path, header=True)


@query("k13_write_feature_store", "select image_id, round(list_sum(px),6) as s from fx_images")
def _(t):
    path = sinks.scratch(t.spark, "features")
    sinks.write_features(t.images.select("image_id", "px"), path, "image_id")
    return t.spark.read.parquet(path).select("image_id", F.round(F.aggregate("px", F.lit(0.0), lambda a, v: a + v), 6).alias("s"))


@query("k14_write_predictions", "select task, run, count(*) as n from fx_predictions group by 1,2")
def _(t):
    path = sinks.scratch(t.spark, "predictions")
    sinks.write_predictions(t.predictions, path)
    return t.spark.read.parquet(path).groupBy("task", "run").agg(F.count(F.lit(1)).alias("n"))


@query("k16_append_history", "select n_nationkey from nation union all select n_nationkey + 100 from nation")
def _(t):
    path = sinks.scratch(t.spark, "history")
    sinks.append_history(t.nation.select("n_nationkey"), path)
    sinks.append_history(t.nation.select((c("n_nationkey") + 100).alias("n_nationkey")), path)
    return t.spark.read.schema(f"n_nationkey {dict(t.nation.dtypes)['n_nationkey']}").csv(path, header=True)


@query("m01_incremental_ingest", "select image_id, label from fx_images")
def _(t):
    root, target, mark = (sinks.scratch(t.spark, x) for x in ("incoming", "ingested", "progress"))
    rows = t.images.select("image_id", "label")
    for part in (0, 1):  # the second run sees only the second part
        rows.where(c("image_id") % 2 == part).write.mode("append").parquet(root)
        incremental_ingest(t.spark, root, rows.schema, lambda df: df, target, mark)
    return t.spark.read.parquet(target)


#: Hours whose end the watermark has passed: ten minutes behind the last event.
M02 = "select date_trunc('hour', ts)::timestamp as start, event_type, round(avg(value),6) as mean, count(*) as n from events where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 10 minutes group by 1,2"


@query("m02_live_metrics", M02)
def _(t):
    target, mark = sinks.scratch(t.spark, "live"), sinks.scratch(t.spark, "live-progress")
    stream = _as_stream(t, t.events.schema)
    q = live_metrics(stream, keys=("event_type",)).writeStream.format("parquet").option("path", target).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(target).withColumn("mean", F.round("mean", 6))


@query("m02_recent_hours", f"with m as ({M02}) select * from m where start >= (select max(start) from m) - interval 6 hour")
def _(t):
    target, mark = sinks.scratch(t.spark, "recent"), sinks.scratch(t.spark, "recent-progress")
    keep_recent(live_metrics(_as_stream(t, t.events.schema), keys=("event_type",)), target, mark, 6.0, ("event_type",)).awaitTermination()
    return sinks.read_snapshot(t.spark, target).withColumn("mean", F.round("mean", 6))


def _as_stream(t, schema):
    """The events table as a stream of files in order of time, so that the watermark moves.

    A stream takes files by the times when they were written, and tasks of one job end in any order: so each range of
    time is written after the one before it.
    """
    ranges, root = sinks.scratch(t.spark, "ranges"), sinks.scratch(t.spark, "events")
    t.events.repartitionByRange(8, "ts").withColumn("__range", F.spark_partition_id()).write.partitionBy("__range").parquet(ranges)
    dealt = t.spark.read.schema(StructType([*schema, StructField("__range", IntegerType())])).parquet(ranges)
    for i in range(8):
        dealt.where(c("__range") == i).drop("__range").coalesce(1).write.mode("append").parquet(root)
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(root)


def features(t):
    return t.images.select("image_id", "px", c("px").alias("features"), (c("label") % 3).cast("double").alias("target"))


#: Every third image has its outputs stored, as whole numbers; some have only one of the two, and are pending.
X01 = "select image_id, case when image_id % 3 = 0 and image_id % 2 = 0 then image_id::double else round(list_avg(px[1:32]),4) end as first, case when image_id % 3 = 0 and image_id % 2 = 0 then 1.0::double else round(list_avg(px[33:64]),4) end as second, case when image_id % 3 = 0 and image_id % 2 = 0 then 2.0::double else round(list_max(px),4) end as top from fx_images"


@query("x01_batch_infer", X01)
def _(t):
    stored = F.expr("if(image_id % 3 = 0, array(cast(image_id as float), 1F), null)").alias("tokens"), F.expr("if(image_id % 6 = 0, array(2F), null)").alias("cls")
    rows = t.images.select("image_id", F.transform("px", lambda v: v.cast("float")).alias("x"), *stored)
    out = learn.batch_infer(rows, learn.mean_and_max(), "x", [64], {"tokens": "array<float>", "cls": "array<float>"})
    value = lambda a, i: F.round(c(a)[i].cast("double"), 4)
    return out.select("image_id", value("tokens", 0).alias("first"), value("tokens", 1).alias("second"), value("cls", 0).alias("top"))


def held_out():
    return c("image_id") % 5 == 0


def metrics(t, model):
    """On rows that no model here was fitted on."""
    return learn.ev.evaluate(learn.predict(model, features(t).where(held_out())).withColumn("task", F.lit("head")), ["task"])


@query("l01_fit_linear_head")
def _(t):
    return metrics(t, learn.fit_linear_head(features(t).where(~held_out())))


@query("l02_class_weighted_fit")
def _(t):
    return metrics(t, learn.fit_linear_head(learn.class_weighted(features(t).where(~held_out())), weight="weight"))


@query("l03_random_search")
def _(t):
    rest = features(t).where(~held_out())
    val = c("image_id") % 5 == 1
    head, _ = learn.random_search(rest.where(~val), rest.where(val), trials=6, metric="qwk", steps=20)
    return learn.ev.evaluate(head.predict(features(t).where(held_out())).withColumn("task", F.lit("head")), ["task"])


@query("l01_head_by_validation")
def _(t):
    rest = features(t).where(~held_out())
    val = c("image_id") % 5 == 1
    head = learn.fit_heads(rest.where(~val), rest.where(val), [{"lr": 0.1, "reg": 0.01}], steps=25)[0]
    return learn.ev.evaluate(head.predict(features(t).where(held_out())).withColumn("task", F.lit("head")), ["task"])


@query("l04_project_pca")
def _(t):
    out = learn.project_pca(features(t))
    return out.select("image_id", *[F.round(c("pca")[i], 6).alias(f"p{i}") for i in range(3)])


def encoded(rows, kind: str):
    """Files made of table rows by the tasks, as ``path``, ``content``: gzip volumes whose voxels count up, or array bundles."""

    def run(frames):
        import gzip
        import io
        import struct

        import numpy as np
        import pandas as pd

        for f in (frame[i : i + 512] for frame in frames for i in range(0, len(frame), 512)):
            out = []
            for r in f.to_dict("records"):
                if kind == "volume":
                    shape = (r["nx"], r["ny"], r["nz"])
                    head = bytearray(352)
                    struct.pack_into("<i", head, 0, 348)
                    struct.pack_into("<8h", head, 40, 3, *shape, 1, 1, 1, 1)
                    struct.pack_into("<h", head, 70, 16)
                    struct.pack_into("<8f", head, 76, 1, r["dx"], r["dy"], r["dz"], 1, 1, 1, 1)
                    struct.pack_into("<f", head, 108, 352)
                    data = np.arange(np.prod(shape), dtype="<f4").reshape(shape)
                    content = gzip.compress(bytes(head) + data.tobytes(order="F"), 1)
                else:
                    b = io.BytesIO()
                    np.savez(b, slice=np.array(r["px"], "f4").reshape(8, 8), **({"mask": np.array(r["gt_px"], "u1")} if r["key"] % 3 else {}))
                    content = b.getvalue()
                out.append(content if r["key"] % 50 else b"broken")
            yield pd.DataFrame({"path": f["key"].astype(str), "content": out})

    return rows.repartition("key").mapInPandas(run, "path string, content binary")  # a table of one file would be encoded by one task


@query("s02_decode_volumes", "select volume_id::varchar as path, case when volume_id % 50 <> 0 then nx end as nx, case when volume_id % 50 <> 0 then ny end as ny, case when volume_id % 50 <> 0 then nz end as nz, case when volume_id % 50 <> 0 then round(dx::float::double,6) end as dx, case when volume_id % 50 <> 0 then (nx*ny*nz-1)*(nx*ny*nz)*(2*nx*ny*nz-1)/6.0::double end as s, volume_id % 50 = 0 as bad from fx_volumes")
def _(t):
    from slicework.sources.files import decode_volumes

    out = decode_volumes(encoded(t.volumes.select(c("volume_id").alias("key"), "nx", "ny", "nz", "dx", "dy", "dz"), "volume"))
    square = F.aggregate(F.transform("voxels", lambda v, i: v.cast("double") * i), F.lit(0.0), lambda a, v: a + v)
    return out.select("path", "nx", "ny", "nz", F.round("dx", 6).alias("dx"), square.alias("s"), c("error").isNotNull().alias("bad"))


@query("s05_read_array_bundles", "select image_id::varchar as path, case when image_id % 50 <> 0 then 8 end as h, case when image_id % 50 <> 0 then round(list_sum(list_transform(px, lambda v: v::float::double)),5) end as s, case when image_id % 50 <> 0 and image_id % 3 <> 0 then list_sum(gt_px)::double end as m, image_id % 50 = 0 as bad from fx_images join fx_masks using (image_id)")
def _(t):
    from slicework.sources.files import decode_array_bundles

    rows = t.images.join(t.masks, "image_id").select(c("image_id").alias("key"), "px", "gt_px")
    out = decode_array_bundles(encoded(rows, "bundle"), ["slice", "mask"])
    total = lambda a: F.aggregate(F.transform(a, lambda v: v.cast("double")), F.lit(0.0), lambda x, v: x + v)
    return out.select("path", F.get("slice_shape", F.lit(0)).alias("h"), F.round(total("slice"), 5).alias("s"), total("mask").alias("m"), c("error").isNotNull().alias("bad"))


@query("l05_score_linear_head", "select image_id, round(list_sum([px[i]*(i%3-1) for i in range(1,65)])+0.5,6) as z0, round(list_sum([px[i]*(i%2) for i in range(1,65)])-0.25,6) as z1 from fx_images")
def _(t):
    w = [[float(i % 3 - 1) for i in range(1, 65)], [float(i % 2) for i in range(1, 65)]]
    out = learn.score_linear_head(features(t), w, [0.5, -0.25])
    return out.select("image_id", F.round(c("logits")[0], 6).alias("z0"), F.round(c("logits")[1], 6).alias("z1"))


@query("l06_regime_study")
def _(t):
    """Every image is of a subject; the fold columns give all training subjects, and half of them."""
    subject = F.format_string("sub-%d", c("image_id") % 97)
    number = F.pmod(F.xxhash64(c("subject_id")), F.lit(100))
    all_of, half_of = F.when(number < 80, "train").otherwise("val"), F.when(number < 40, "train").when(number >= 80, "val").otherwise("")
    folds = t.images.select(subject.alias("subject_id")).distinct().select("subject_id", F.when(F.crc32(c("subject_id")) % 5 == 0, "1").otherwise("0").alias("is_test"), all_of.alias("all_split"), half_of.alias("half_split"))
    samples = features(t).withColumn("name", F.concat(subject, F.lit("_img"), c("image_id")))
    return learn.regime_study(samples, folds, ["all_split", "half_split"], steps=15)
