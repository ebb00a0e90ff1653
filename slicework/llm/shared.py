"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank and the five controls from tab to carriage return (fixed values).
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names. Only on one machine is there a default."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (root or "/tmp/checkpoints").rstrip("/")


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that ``materialize`` writes meanwhile, in order."""
    token = _written.set(paths := [])
    try:
        yield paths
    finally:
        _written.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables that no result reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage, and a lost executor costs no recomputation of what came before. The options are the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if (paths := _written.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Each query that runs meanwhile drops its shuffle files when it ends; for tables that are written and read again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def words(text: Column) -> Column:
    """Words of a text in order: runs of anything but the white space above; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def unsigned_crc32(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary"))
