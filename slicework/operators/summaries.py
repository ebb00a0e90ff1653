"""Data-set summaries, reports and history tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dataset_summary(files: DataFrame) -> DataFrame:
    """Per dataset the files, axial and sagittal ones, most first; a TOTAL row last."""
    out = files.rollup("dataset").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("orientation") == "axial").alias("axial"), F.count_if(F.col("orientation") == "sagittal").alias("sagittal"), F.grouping("dataset").alias("__g"))
    return out.withColumn("dataset", F.when(F.col("__g") == 1, "TOTAL").otherwise(F.col("dataset"))).orderBy("__g", F.desc("total"), "dataset").drop("__g")


def facet_counts(files: DataFrame, facets: list[str]) -> DataFrame:
    """Counts of each value of each facet by itself."""
    out = files.groupingSets([[f] for f in facets], *facets).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__g"))
    k = len(facets)
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, f in enumerate(facets):
        own = F.col("__g") == ((1 << k) - 1) ^ (1 << (k - 1 - i))
        facet, value = F.when(own, F.lit(f)).otherwise(facet), F.when(own, F.coalesce(f, F.lit("unknown"))).otherwise(value)
    return out.select(facet.alias("facet"), value.alias("value"), "n")


def extraction_summary(results: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return results.agg(count("ok").alias("extracted"), count("skipped").alias("skipped"), count("error").alias("errors"), count("exists").alias("skipped_existing"), F.sum("slices").alias("slices"), F.sum("outputs").alias("outputs"))


def exclusion_totals(gone: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by every combination of the dimensions, with the totals."""
    return gone.cube(*dims).agg(F.count(F.lit(1)).alias("n"))


def top_by(df: DataFrame, column: str, n: int | None = None, tie: str | None = None) -> DataFrame:
    out = df.orderBy(F.desc(column), *([tie] if tie else []))
    return out.limit(n) if n is not None else out


def first_n_issues(issues: DataFrame, n: int = 200) -> DataFrame:
    return issues.orderBy("name", "issue").limit(n)


def head_errors(df: DataFrame, n: int, message: str = "error_msg") -> DataFrame:
    return df.where(F.col(message).isNotNull()).orderBy(message).limit(n)


def report_lines(results: DataFrame) -> DataFrame:
    """A line for each volume, by path, with the message of a skip or an error; those done before are left out."""
    name, message = F.substring_index("path", "/", -1), F.col("message")
    ok = F.format_string("[OK]    %s  slices=%d  outputs=%d", name, "slices", "outputs")
    skip = F.concat(F.format_string("[SKIP/%s]  %s", F.coalesce("tag", F.lit("skip")), "path"), F.when(message != "", F.concat(F.lit("  | "), message)).otherwise(""))
    error = F.format_string("[ERROR]  %s\n  %s", "path", F.coalesce(message, F.lit("")))
    line = F.when(F.col("status") == "ok", ok).when(F.col("status") == "skipped", skip).when(F.col("status") == "error", error)
    return results.where("status <> 'exists'").orderBy("path").select(line.alias("line"))


def report_totals(results: DataFrame, unmatched_labels: DataFrame | None = None) -> DataFrame:
    """The block below the lines: ``place`` and ``line`` of each total, with the number of labels without an image if they are given."""
    rule = "=" * 50
    sums = extraction_summary(results).withColumnsRenamed({"slices": "total_slices", "outputs": "total_outputs"})
    names = ["extracted", "skipped", "errors", "skipped_existing", "total_slices", "total_outputs"]
    if unmatched_labels is not None:
        sums = sums.join(F.broadcast(unmatched_labels.agg(F.count(F.lit(1)).alias("unmatched_labels"))), F.lit(True))  # one row
        names.append("unmatched_labels")
    lines = [F.lit(rule), F.lit("SUMMARY"), *[F.format_string(f"  {x:<17}: %d", x) for x in names], F.lit(rule)]
    return sums.select(F.posexplode(F.array(*lines)).alias("place", "line"))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, or an error when it runs if a key occurs twice."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").agg(F.count(F.lit(1)).alias("__bad"))
    checked = F.when(F.col("__bad") > 0, F.raise_error(F.concat(F.lit("duplicate keys: "), F.col("__bad")))).otherwise(F.lit(True))
    return df.join(F.broadcast(twice), F.lit(True)).where(checked.cast("boolean")).drop("__bad")  # one row


def skip_existing(df: DataFrame, target: DataFrame, keys: list[str], complete: Column | None = None) -> DataFrame:
    """Rows whose output the target lacks; with ``complete`` an output counts only where that holds."""
    have = target if complete is None else target.where(complete)
    return df.join(have.select(*keys), keys, "left_anti")


def pending(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that lack one of the wanted columns' values."""
    keep = F.lit(False)
    for c in columns:
        keep = keep | (F.col(c).isNull() if c in df.columns else F.lit(True))
    return df.where(keep)


def strip_columns(df: DataFrame, keep: list[str]) -> tuple[DataFrame, bool]:
    """Only the columns to keep, and whether any went."""
    return df.select(*[c for c in df.columns if c in keep]), bool(set(df.columns) - set(keep))


def add_columns(df: DataFrame, new: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """The stored rows with the new columns; values that are there already stay unless told otherwise."""
    added = [c for c in new.columns if c != key]
    out = df.join(new.select(key, *[F.col(c).alias(f"__new_{c}") for c in added]), key, "left")
    for c in added:
        fresh = F.col(f"__new_{c}")
        out = out.withColumn(c, fresh if c not in df.columns else F.coalesce(fresh, F.col(c)) if overwrite else F.coalesce(F.col(c), fresh))
    return out.drop(*[f"__new_{c}" for c in added])


def upsert(df: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the last row in order; a new row always wins."""
    both = df.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = W.partitionBy(key).orderBy(F.desc("__new"), F.desc(order))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__new")


def insert_if_absent(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return df.unionByName(new.join(df.select(*keys), keys, "left_anti").select(*df.columns))


def to_markdown(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row with the table as Markdown; numbers have four digits. For result tables, a row for each task."""
    cell = [F.format_string("%.4f", c) if t == "double" else F.col(c).cast("string") for c, t in df.select(*columns).dtypes]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return df.agg(F.concat(F.lit(head + "\n"), F.array_join(rows, "\n")).alias("markdown"))


def summary_json(df: DataFrame, key: str, columns: list[str], digits: int = 4) -> DataFrame:
    """One row with a nested JSON summary: key to rounded values."""
    value = F.struct(*[F.round(c, digits).alias(c) for c in columns])
    return df.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), value.alias("v")))))).alias("json"))
