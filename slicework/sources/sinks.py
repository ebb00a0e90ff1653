"""Sinks: Parquet by partitions, CSV, text and prediction tables; and the folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or '/tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_slices(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("split", "dataset").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Recomputed partitions take the place of their old ones; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.csv(path, header=True)


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(column).write.text(path)


def write_features(df: DataFrame, path: str, key: str = "path") -> None:
    """The feature store, sorted by key so that lookups skip row groups."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """By task, run and split, as far as the table has them."""
    df.write.mode("append").partitionBy(*[c for c in ("task", "run", "split") if c in df.columns]).parquet(path)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a snapshot that were written to their end."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = [f.getPath() for f in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName()[1:]) for p in done if p.getName()[:1] == "v")


def swap_snapshot(df: DataFrame, path: str) -> None:
    """A whole new version beside the old ones. Readers take the last one that was written to its end, so they see the
    old rows or all the new ones; a run that fails leaves the old version."""
    version = max(_versions(df.sparkSession, path), default=0) + 1
    df.write.parquet(f"{path}/v{version:08d}")


def has_snapshot(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no snapshot in {path}")
    return spark.read.parquet(f"{path}/v{found[-1]:08d}")
