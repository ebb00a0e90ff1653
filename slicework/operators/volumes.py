"""Plans on volume headers: plane classes, statuses, expected outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a file name may not have, and folders that a file may not be in (fixed values).
IGNORED_WORDS = ("preproc", "cor", "dwi", "_ct", "epi", "fieldmap")
IGNORED_FOLDERS = ("derivatives", ".git", "sourcedata")


def classify_plane(dx: Column, dy: Column, dz: Column, tol: float = 0.1, eps: float | None = None) -> Column:
    hi, lo = F.greatest(dx, dy, dz), F.least(dx, dy, dz)
    even = hi - lo <= eps if eps is not None else hi / lo <= 1 + tol
    return F.when(even, "isotropic").when((dz > dx) & (dz > dy), "axial").when((dx > dy) & (dx > dz), "sagittal").when((dy > dx) & (dy > dz), "coronal").otherwise("axial")


def not_ignored(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    bad = name.rlike("|".join(IGNORED_WORDS)) | F.exists(folders, lambda p: p.isin(*IGNORED_FOLDERS))
    return ~bad


def plane_filter(df: DataFrame, name: str | Column, plane: str | None) -> DataFrame:
    if plane is None:
        return df
    if plane not in ("sag", "ax"):
        raise ValueError("plane is sag or ax")
    return df.where(F.lower(name).contains(plane))


def with_plane_status(df: DataFrame) -> DataFrame:
    """Coronal volumes are skipped, with their spacing as the reason."""
    reason = F.format_string("coronal (%.2f, %.2f, %.2f)", "dx", "dy", "dz")
    return df.withColumns({"status": F.when(F.col("plane") == "coronal", "skipped").otherwise("ok"), "skip_reason": F.when(F.col("plane") == "coronal", reason)})


def with_shape_status(df: DataFrame, a: tuple[str, ...], b: tuple[str, ...]) -> DataFrame:
    same = F.lit(True)
    for x, y in zip(a, b, strict=True):
        same = same & F.col(x).eqNullSafe(F.col(y))
    return df.withColumn("status", F.when(same, "ok").otherwise("shape_mismatch"))


def predict_manifest(headers: DataFrame) -> DataFrame:
    """All output names of each volume from its header alone (``path, nx, ny, nz, dx, dy, dz, plane``).

    Headers are dealt by path before they become many rows: a file of them is small, so one task would have all names.
    """
    from slicework.functions import names as n
    from slicework.functions.pixels import plane_slice

    s = plane_slice(headers.repartition("path"))
    name = n.slice_name(F.col("path"), n.base_name(F.col("path")), F.col("slice_plane"), F.col("slice_idx"), F.lit(0), n.fmt_spacing(F.col("sp_h"), F.col("sp_w")))
    return s.withColumn("name", name)


def finished_volumes(manifest: DataFrame, present: DataFrame, key: str, name: str = "name") -> DataFrame:
    """Volumes all of whose expected outputs exist; one without expected outputs is never finished."""
    have = present.select(F.col(name).alias("__n")).distinct().withColumn("__have", F.lit(True))
    joined = manifest.join(have, manifest[name] == have["__n"], "left")
    return joined.groupBy(key).agg(F.bool_and(F.coalesce("__have", F.lit(False))).alias("done")).where("done").select(key)
