"""Queries that read trees of files: each writes its table's rows as files of their own names first, by the tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from slicework.operators import pairs
from slicework.plans.pairing import IGN
from slicework.plans.registry import query
from slicework.plans.storage import encoded
from slicework.sources import tables as src
from slicework.sources.files import read_images
from slicework.sources.named import write_files
from slicework.sources.sinks import scratch

c = F.col


def written(t, files) -> str:
    root = scratch(t.spark, "files")
    write_files(files, root)
    return root


def pictures(t, path: str, broken: str = "false"):
    """A grey PNG of 8 by 8 for each image, ``path`` by an expression; bytes that are no PNG where ``broken`` holds."""
    rows = t.images.select("image_id", F.expr(path).alias("path"), F.expr(broken).alias("broken"), F.transform("px", lambda v, i: F.when(v > 0, 200).otherwise(i)).alias("px"))

    def run(frames):
        import struct
        import zlib

        def block(kind, data):
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        for f in frames:
            out = []
            for px, broken in zip(f["px"], f["broken"]):
                lines = b"".join(b"\0" + bytes(int(v) for v in px[i : i + 8]) for i in range(0, 64, 8))
                png = b"\x89PNG\r\n\x1a\n" + block(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)) + block(b"IDAT", zlib.compress(lines)) + block(b"IEND", b"")
                out.append(b"broken" if broken else png)
            yield f.assign(content=out)[["path", "content"]]

    return rows.repartition("path").mapInPandas(run, "path string, content binary")  # a table of one file would be drawn by one task


def image_id(path: str = "path"):
    return F.regexp_extract(path, r"img(\d+)", 1).cast("long").alias("image_id")


def texts(rows, path: str, content: str = "'x'"):
    return rows.select(F.expr(path).alias("path"), F.expr(content).cast("binary").alias("content")).repartition("path")  # as in pictures


@query("s01_scan_volumes", f"select volume_id, path from fx_volumes where path like '%.nii.gz' and not {IGN}")
def _(t):
    content = encoded(t.volumes.select(c("volume_id").alias("key"), "nx", "ny", "nz", "dx", "dy", "dz"), "volume").withColumnRenamed("path", "volume_id")
    files = t.volumes.select("volume_id", "path").join(content.withColumn("volume_id", c("volume_id").cast("long")), "volume_id")
    other = texts(t.volumes.where("volume_id % 10 = 0"), "replace(path, '.nii.gz', '.json')", "'{}'")
    root = written(t, files.select("path", "content").unionByName(other))
    return src.scan_volumes(t.spark, root).select(F.regexp_extract("path", r"sub-(\d+)/", 1).cast("long").alias("volume_id"), "path")


#: Files of one class are no images, but it has a number; some names begin with tmp.
CLASS_FILE = "concat(if(image_id % 23 = 0, 'a-notes', concat('c', label)), '/', if(image_id % 10 = 3, 'tmp', ''), 'img', image_id, case when image_id % 23 = 0 then '.txt' when image_id % 9 = 0 then '.WEBP' when image_id % 9 = 1 then '.npz' else '.png' end)"


@query("s03_read_class_folder", "with e as (select image_id, case when image_id % 23 = 0 then 'a-notes' else 'c'||label end as class_name from fx_images), k as (select *, (dense_rank() over (order by class_name)-1)::int as target from e) select * from k where class_name <> 'a-notes' and image_id % 10 <> 3")
def _(t):
    return src.read_class_folder(t.spark, written(t, pictures(t, CLASS_FILE))).select(image_id(), "class_name", "target")


@query("s04_drop_empty_classes", "select image_id, (dense_rank() over (order by label)-1)::int as target from fx_images qualify label <> 2 and image_id % 3 > 0")
def _(t):
    root = written(t, pictures(t, "concat('c', label, '/img', image_id, '.png')", "label = 2 or image_id % 3 = 0"))
    decoded = read_images(t.spark, root).select(image_id(), c("error").isNull().alias("valid"))
    listed = src.read_class_folder(t.spark, root).select(image_id(), "target")
    return src.drop_empty_classes(listed.join(decoded, "image_id")).select("image_id", "target")


@query("s06_read_image_files", "select image_id::varchar as path, case when image_id % 50 <> 0 then 8 end as h, case when image_id % 50 <> 0 then 8 end as w, case when image_id % 50 <> 0 then list_sum([(case when px[i+1] > 0 then 200 else i end) * i for i in range(64)])::bigint end as s, image_id % 50 = 0 as bad from fx_images")
def _(t):
    out = read_images(t.spark, written(t, pictures(t, "concat(image_id % 7, '/img', image_id, '.png')", "image_id % 50 = 0")))
    total = F.aggregate(F.transform("px", lambda v, i: (v * i).cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return out.select(image_id().cast("string").alias("path"), "h", "w", total.alias("s"), c("error").isNotNull().alias("bad"))


PLANE_FILE = "concat('relax/', label, '/', element_at(array('sag', 'AX', 'cor'), cast(image_id % 3 as int) + 1), '_img', image_id, element_at(array('.png', '.webp', '.npz', '.tiff'), cast(image_id % 4 as int) + 1))"


@query("s07_list_images_by_plane", "select image_id from fx_images where image_id % 3 = 1 and image_id % 4 <> 2")
def _(t):
    return src.list_images(t.spark, written(t, pictures(t, PLANE_FILE)), "ax").select(image_id())


@query("s10_read_sidecars", "select label_id, case when label_id % 9 <> 0 then severity end as severity, label_id % 9 = 0 as missing from fx_labels")
def _(t):
    name = lambda end: f"concat('d', abs(label_id) % 7, '/lab', label_id, '_label{end}')"
    labels, js = texts(t.labels_fx, name(".nii.gz")), texts(t.labels_fx.where("label_id % 9 <> 0"), name(".json"), "to_json(struct(severity as PathologySeverity))")
    out = src.read_sidecars(t.spark, written(t, labels.unionByName(js)))
    return out.select(F.regexp_extract("path", r"lab(-?\d+)_", 1).cast("long").alias("label_id"), F.get_json_object("js", "$.PathologySeverity").alias("severity"), c("error").isNotNull().alias("missing"))


@query("s14_read_split_tree", "select image_id, case image_id % 4 when 0 then 'valid' when 1 then 'val' else 'train' end as role, 'c'||label as class_name from fx_images")
def _(t):
    root = written(t, pictures(t, "concat(case image_id % 4 when 0 then 'test' when 1 then 'val' else 'train' end, '/c', label, '/img', image_id, '.png')"))
    return src.read_split_tree(t.spark, root).select(image_id(), "role", "class_name")


@query("s16_read_paired_layout", "select case when p_partkey % 5 = 0 then 'Ts' else 'Tr' end as part, 'p'||p_partkey as stem, p_partkey % 6 = 0 as missing from part where p_partkey % 10 <> 0")
def _(t):
    side = "if(p_partkey % 5 = 0, 'Ts', 'Tr')"
    images = texts(t.part, f"concat('images', {side}, '/p', p_partkey, '_0000.nii.gz')")
    masks = texts(t.part.where("p_partkey % 6 <> 0"), f"concat('labels', {side}, '/p', p_partkey, '.nii.gz')")
    cached = t.part.where("p_partkey % 10 = 0").select(F.expr("concat('p', p_partkey)").alias("stem"))
    return src.read_paired_layout(t.spark, written(t, images.unionByName(masks)), cached).select("part", "stem", "missing")


@query("j05_unpaired_files", "select 'p'||p_partkey as stem from part where p_partkey % 6 = 0")
def _(t):
    """Images of a tree without a mask, by the listing alone."""
    root = written(t, texts(t.part, "concat('images/p', p_partkey, '.png')").unionByName(texts(t.part.where("p_partkey % 6 <> 0"), "concat('masks/p', p_partkey, '.png')")))
    listed = src.list_files(t.spark, root).select(F.substring_index("path", "/", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("stem"))
    return pairs.pair(listed.where("folder = 'images'").select("stem"), listed.where("folder = 'masks'").select("stem"), "stem")[1]
