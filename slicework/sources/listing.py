"""Trees of files listed and read by the tasks, so that no list of files is held by the driver."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED = pa.schema([("path", pa.string()), ("size", pa.int64())])


def below(path: Column, root: str) -> Column:
    """The part of a file's path below the root."""
    bare = re.sub("^file:/+", "/", root.rstrip("/"))
    return F.substring(F.regexp_replace(path, "^file:/+", "/"), len(bare) + 2, 1 << 30)


def _uri(spark: SparkSession, root: str) -> str | None:
    """The root's full name if it is a folder of a file system that Arrow knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path) or not system.getFileStatus(path).isDirectory():
        return None
    full = system.makeQualified(path)
    uri = full.toUri().getPath() if full.toUri().getScheme() == "file" else full.toUri().toString()
    try:
        pafs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, NotImplementedError, OSError):
        return None
    return uri


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name[0] == "." or name.endswith("._COPYING_") or (name[0] == "_" and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def _children(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """Names in a folder, with the sizes of files and None for folders; of a local one without holding them all."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                try:
                    yield e.name, None if e.is_dir() else e.stat().st_size
                except FileNotFoundError:  # a link to nothing, or gone since
                    continue
    else:
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            yield info.base_name, info.size if info.type == pafs.FileType.File else None


def _expanded(entries: DataFrame, uri: str, deep: bool) -> DataFrame:
    """``path``, ``size`` of entries with each folder, which has no size, replaced by what is in it, or by all files below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        found: list[tuple[str, int | None]] = []
        for b in batches:
            files = b.filter(b.column(1).is_valid())
            if files.num_rows:
                yield files
            left = b.filter(b.column(1).is_null()).column(0).to_pylist()
            while left:
                folder = left.pop()
                for name, size in _children(fs, f"{root.rstrip('/')}/{folder}"):
                    if _hidden(name):
                        continue
                    path = f"{folder}/{name}" if folder else name
                    if size is None and deep:
                        left.append(path)
                        continue
                    found.append((path, size))
                    if len(found) == 10_000:
                        yield _listed(found)
                        found = []
        if found:
            yield _listed(found)

    return entries.mapInArrow(run, "path string, size long")


def _listed(found: list[tuple[str, int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], LISTED.field(i).type) for i in (0, 1)], schema=LISTED)


def _dealt(df: DataFrame) -> DataFrame:
    """A file costs far more than the bytes of its name, so the number of tasks is given, and follows the cores."""
    return df.repartition(max(32, 2 * df.sparkSession.sparkContext.defaultParallelism), "path")


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path`` below the root and ``size`` of all files whose names match, empty ones as well, without their contents.

    The root and its folders are listed by a task each, what is below these folder by folder. Where Arrow doesn't know the
    file system, or the root is no folder, Spark's reader lists it in the driver, without empty files.
    """
    uri = _uri(spark, root)
    if uri is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
        return files.select(below(F.col("path"), root).alias("path"), F.col("length").alias("size"))
    top = spark.range(0, 1, 1, 1).selectExpr("'' as path", "cast(null as long) as size")
    files = _expanded(_dealt(_expanded(_dealt(_expanded(top, uri, False)), uri, False)), uri, True)
    if glob == "*":
        return files
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    return files.where(F.substring_index("path", "/", -1).rlike(rf"^(?s:{pattern})\z"))


def read_contents(files: DataFrame, root: str, held: int = 4 << 20) -> DataFrame:
    """``path`` and ``content`` of files by their ``path`` below the root; a task holds ``held`` bytes and a file."""
    spark = files.sparkSession
    uri = _uri(spark, root)
    if uri is None:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        return found.select(below(F.col("path"), root).alias("path"), "content").join(files.select("path"), "path", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(uri)
        paths, contents, size = [], [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_file(f"{base.rstrip('/')}/{path}") as file:
                    paths.append(path)
                    contents.append(file.read())
                size += len(contents[-1])
                if size >= held or len(paths) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], ["path", "content"])
                    paths, contents, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], ["path", "content"])

    return _dealt(files.select("path")).mapInArrow(run, "path string, content binary")
