"""Sources that end in ordinary tables: listings, fold tables, sidecars, predictions, logs, histories."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicework.operators.volumes import not_ignored
from slicework.sources.listing import below, list_files, read_contents
from slicework.sources.sinks import scratch

#: Extensions of images (fixed values); class folders may hold array bundles as well.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
BUNDLE_EXTENSION = "npz"


def extension(path: str) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def scan_volumes(spark: SparkSession, root: str, apply_filters: bool = True) -> DataFrame:
    files = list_files(spark, root, "*.nii.gz")
    return files.where(not_ignored(F.col("path"))) if apply_filters else files


def class_folders(files: DataFrame, path: str = "path", skip_tmp: bool = True) -> DataFrame:
    """``path``, ``class_name`` and ``target`` of files ``.../class/file`` with the extension of an image or a bundle.

    All folders have numbers, those without such files as well.
    """
    from slicework.operators.splits import label_encode

    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    out = label_encode(files.where(F.size(parts) > 1).withColumn("class_name", F.element_at(parts, -2)), "class_name")
    out = out.where(extension(path).isin(*IMAGE_EXTENSIONS, BUNDLE_EXTENSION))
    return out.where(~name.startswith("tmp")) if skip_tmp else out


def read_class_folder(spark: SparkSession, root: str) -> DataFrame:
    """Files of class folders; it is an error if there is no folder or no file. The tree is listed once, to a table that
    the numbers of the folders, the checks and the result are read from."""
    listed = scratch(spark, "listed")
    list_files(spark, root).write.parquet(listed)
    files = spark.read.schema("path string, size long").parquet(listed)
    out = class_folders(files)
    if out.isEmpty():
        raise ValueError(f"no class folders in {root}" if files.where(F.instr("path", "/") > 0).isEmpty() else f"no images or bundles in {root}")
    return out


def drop_empty_classes(df: DataFrame, valid: str = "valid", label: str = "target") -> DataFrame:
    """Valid rows; classes without any go, and the others keep their numbers."""
    full = df.groupBy(label).agg(F.count_if(F.col(valid)).alias("n")).where("n > 0").select(label)
    return df.where(F.col(valid)).join(full, label, "left_semi")


def list_images(spark: SparkSession, root: str, plane: str | None = None) -> DataFrame:
    """Images below the root; with a plane (``sag``, ``ax``) those whose file's name, whatever its folders, holds it."""
    from slicework.operators.volumes import plane_filter

    images = list_files(spark, root).where(extension("path").isin(*IMAGE_EXTENSIONS))
    return plane_filter(images, F.substring_index("path", "/", -1), plane)


def read_folds(spark: SparkSession, path: str, fold_column: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    return folds(df, fold_column)


def folds(df: DataFrame, fold_column: str) -> DataFrame:
    if fold_column not in df.columns:
        raise ValueError(f"no fold column {fold_column}; there are {df.columns[:10]}")
    return df.where(F.trim("is_test") != "1").select("subject_id", F.col(fold_column).alias("side")).where("side in ('train', 'val')")


def fold_list(js: DataFrame, column: str) -> DataFrame:
    """``fold``, ``split``, ``id`` from a JSON list of folds."""
    schema = "array<struct<train:array<string>,val:array<string>>>"
    each = js.select(F.posexplode(F.from_json(column, schema)).alias("fold", "f"))
    return each.select("fold", F.expr("stack(2, 'train', f.train, 'val', f.val) as (split, ids)")).select("fold", "split", F.explode("ids").alias("id"))


def read_fold_list(spark: SparkSession, path: str) -> DataFrame:
    return fold_list(spark.read.text(path, wholetext=True), "value")


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of each label below the root, or of the label that a JSON file is for, ``js``, its text, and ``error`` where it has none."""
    texts = read_contents(list_files(spark, root, "*_label.json"), root)
    js = texts.select(F.regexp_replace("path", r"_label\.json$", "_label.nii.gz").alias("path"), F.nullif(F.col("content").cast("string"), F.lit("")).alias("js"))
    labels = list_files(spark, root, "*_label.nii.gz").select("path")
    return labels.join(js, "path", "full").withColumn("error", F.when(F.col("js").isNull(), "no sidecar"))


def read_predictions(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The pooled predictions of one file or of a tree of runs, of whatever depth; it is an error if there are none.

    ``run_dir`` is the folder of a row's file below the root (empty for the root itself). Folders ``name=value`` on the
    way give columns, whole numbers if all values are, unless the files hold such a column. Columns that some runs lack are null there.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").option("pathGlobFilter", "*.parquet")
    try:
        df = reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(f"no predictions in {path}") from e
        raise
    decoded = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    file_path = decoded(F.col("_metadata.file_path"))
    folders = F.regexp_replace(below(file_path, path), "/?[^/]*$", "")
    given: dict[str, set[str]] = {}
    for file in df.inputFiles():  # the list that the reader itself holds
        for name, value in re.findall(r"/([^/=]+)=([^/]*)(?=/)", file):
            given.setdefault(name, set()).add(value)
    found = {}
    for name in sorted(given.keys() - set(df.columns)):
        value = F.nullif(F.regexp_extract(file_path, f"/{re.escape(name)}=([^/]*)/", 1), F.lit(""))
        value = decoded(F.nullif(value, F.lit("__HIVE_DEFAULT_PARTITION__")))
        whole = all(re.fullmatch(r"-?[0-9]{1,9}", v) for v in given[name] - {"__HIVE_DEFAULT_PARTITION__"})
        found[name] = value.cast("int") if whole else value
    df = df.withColumns({**found, "run_dir": folders})
    if df.isEmpty():
        raise FileNotFoundError(f"no predictions in {path}")
    return df.where(F.col("split") == split) if split else df


def run_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.where(F.lower(column).contains("loss") & F.col(column).rlike(r"(?i)Iteration:\s*\d+\s*/\s*\d+"))


def read_run_logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    return run_log_lines(spark.read.text(paths).withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)/[^/]*$", 1)))


def read_result_history(spark: SparkSession, path: str, mode: str, schema: str, form: str = "json") -> DataFrame:
    """JSON lines or CSV (``form``) results of one mode; lines that can't be read are left out."""
    if form not in ("json", "csv"):
        raise ValueError("form is json or csv")
    reader = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE")
    rows = reader.json(path) if form == "json" else reader.option("columnNameOfCorruptRecord", "_corrupt_record").csv(path, header=True)
    return rows.where((F.col("mode") == mode) & (F.col("_corrupt_record").isNull() | F.lit(form == "json"))).drop("_corrupt_record")


def split_tree(files: DataFrame, path: str = "path") -> DataFrame:
    """``split``, ``class_name`` of ``split/class/file``, and the ``role``: ``valid`` is the split ``val``, or ``test`` if there is one and no split of that very name."""
    parts = F.split(path, "/")
    out = files.withColumns({"split": F.element_at(parts, -3), "class_name": F.element_at(parts, -2)})
    any_of = lambda name: F.coalesce(F.bool_or(F.col("split") == name), F.lit(False))
    side = out.agg(F.when(any_of("test") & ~any_of("valid"), "test").otherwise("val").alias("__side"))
    return out.join(F.broadcast(side), F.lit(True)).withColumn("role", F.when(F.col("split") == F.col("__side"), "valid").otherwise(F.col("split"))).drop("__side")  # one row


def read_split_tree(spark: SparkSession, root: str) -> DataFrame:
    return split_tree(list_files(spark, root))


def ingest(sources: dict[str, DataFrame], done: DataFrame | None = None) -> DataFrame:
    """Several sources with their dataset's name; datasets that are done already are left out."""
    every = reduce(DataFrame.unionByName, [df.withColumn("dataset", F.lit(name)) for name, df in sources.items()])
    return every.join(done.select("dataset").distinct(), "dataset", "left_anti") if done is not None else every


def paired_layout(images: DataFrame, masks: DataFrame, cached: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Images ``<stem>_0000`` with their mask ``<stem>`` of the same ``by``: ``stem`` and ``missing``; cached stems are left out."""
    from slicework.functions.names import strip_channel_suffix

    a = images.withColumn("stem", strip_channel_suffix(F.col("stem")))
    b = masks.select(*by, F.col("stem"), F.lit(True).alias("__have")).distinct()
    out = a.join(b, [*by, "stem"], "left").withColumn("missing", F.col("__have").isNull()).drop("__have")
    return out.join(cached.select("stem"), "stem", "left_anti") if cached is not None else out


def read_paired_layout(spark: SparkSession, root: str, cached: DataFrame | None = None) -> DataFrame:
    """Images of ``imagesTr`` and ``imagesTs`` with their masks in ``labelsTr`` and ``labelsTs``: ``part``, ``stem``, ``path``, and
    whether the mask is ``missing``."""
    files = list_files(spark, root, "*.nii.gz")
    parts = F.split("path", "/")
    named = files.select("path", F.element_at(parts, -2).alias("folder"), F.regexp_replace(F.element_at(parts, -1), r"\.nii\.gz$", "").alias("stem"))
    side = lambda kind: named.where(F.col("folder").isin(f"{kind}Tr", f"{kind}Ts")).withColumn("part", F.right("folder", F.lit(2))).drop("folder")
    return paired_layout(side("images"), side("labels"), cached, ("part",)).select("stem", "path", "missing", "part")
