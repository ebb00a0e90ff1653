"""Joins of images, labels, samples, folds and stores. Every status is a column; only strict modes raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicework.functions import names

#: Classes of the severities that sidecars name (fixed values).
SEVERITY = {"Normal/Mild": 0, "Moderate": 1, "Severe": 2}


def label_path(path: Column, suffix: str) -> Column:
    return F.regexp_replace(path, r"\.nii\.gz$", f"{suffix}.nii.gz")


def match_labels(images: DataFrame, labels: DataFrame, suffix: str) -> DataFrame:
    """Images with the label at the same relative path."""
    keyed = images.withColumn("label_path", label_path(F.col("path"), suffix))
    return keyed.join(labels.select(F.col("path").alias("label_path"), *[c for c in labels.columns if c not in ("path", *images.columns)]), "label_path")


def unmatched_images(images: DataFrame, labels: DataFrame, suffix: str) -> DataFrame:
    keyed = images.withColumn("label_path", label_path(F.col("path"), suffix))
    return keyed.join(labels.select(F.col("path").alias("label_path")), "label_path", "left_anti").drop("label_path")


def unmatched_labels(images: DataFrame, labels: DataFrame, suffix: str) -> DataFrame:
    expected = images.select(label_path(F.col("path"), suffix).alias("path"))
    return labels.join(expected, "path", "left_anti")


def candidate_labels(images: DataFrame, labels: DataFrame, suffix: str) -> DataFrame:
    """Expected label paths that exist."""
    expected = images.select(label_path(F.col("path"), suffix).alias("path"))
    return expected.join(labels.select("path"), "path", "left_semi")


def pair(images: DataFrame, masks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Pairs on a key, and the images without a mask."""
    return images.join(masks, key), images.join(masks.select(key), key, "left_anti")


def assign_folds(samples: DataFrame, folds: DataFrame, column: str) -> DataFrame:
    """Samples of training subjects with their side; test subjects and unassigned ones go. An empty side is an error."""
    if column not in folds.columns:
        raise ValueError(f"no fold column {column}; there are {folds.columns[:10]}")
    sides = folds.where((F.trim("is_test") != "1") & F.col(column).isin("train", "val")).select("subject_id", F.col(column).alias("side"))
    out = samples.withColumn("subject_id", F.substring_index("name", "_", 1)).join(sides, "subject_id")
    for side in ("train", "val"):
        if out.where(F.col("side") == side).isEmpty():
            raise ValueError(f"no {side} samples in {column}")
    return out


def select_test(samples: DataFrame, folds: DataFrame) -> DataFrame:
    test = folds.where(F.trim("is_test") == "1").select("subject_id")
    return samples.withColumn("subject_id", F.substring_index("name", "_", 1)).join(test, "subject_id", "left_semi")


def volume_labels(volumes: DataFrame, labels: DataFrame, pattern: str) -> DataFrame:
    """Each volume with its labels: same subject folder, a name that begins with the volume's and fits the pattern."""
    folder = lambda c: F.regexp_extract(c, r"(sub-[^/_]+)", 1)
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    a = volumes.withColumns({"__f": folder(F.col("path")), "__stem": F.regexp_replace(name(F.col("path")), r"\.nii\.gz$", "")})
    b = labels.select(folder(F.col("path")).alias("__f"), name(F.col("path")).alias("label_name"), F.col("path").alias("label_path"), *[c for c in labels.columns if c not in ("path", *volumes.columns)])
    return a.join(b, "__f").where(F.col("label_name").startswith(F.col("__stem")) & F.col("label_name").rlike(pattern)).drop("__f", "__stem")


def attach_severity(labels: DataFrame, sidecars: DataFrame, key: str, js: str) -> DataFrame:
    """The class that a label's sidecar names; a status where there is none or it is unknown."""
    table = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    out = labels.join(sidecars, key, "left").withColumn("severity", F.get_json_object(js, "$.PathologySeverity"))
    out = out.withColumn("target", F.try_element_at(table, F.col("severity")))
    return out.withColumn("status", F.when(F.col(js).isNull(), "missing").when(F.col("target").isNull(), "unknown").otherwise("ok"))


def backfill_spacing(samples: DataFrame, headers: DataFrame, plane: str, overwrite: bool = False, name: str = "name") -> DataFrame:
    """``spacing_mm``, the mean spacing in the plane (``sag``, ``ax``), from the volume that a sample's name tells.

    ``headers``: ``path`` below the root, ``dx``, ``dy``, ``dz``, ``error``. ``status``: null where a sample has its spacing already, SKIP if its name tells
    no volume, WARN if there is no such volume, ERROR if its header can't be read, and else OK.
    """
    if plane not in ("sag", "ax"):
        raise ValueError("plane is sag or ax")
    bids = names.parse_bids(F.col(name))
    volume = F.format_string(f"%s/anat/%s_acq-{plane}_rec-%s_%s.nii.gz", bids["subject"], bids["subject"], bids["recording"], bids["modality"])
    mean = (F.col("dy") + F.col("dz")) / 2 if plane == "sag" else (F.col("dx") + F.col("dy")) / 2
    own = headers.groupBy("path").agg(F.first(mean).alias("__new"), F.first("error").alias("__error")).withColumnRenamed("path", "__volume")
    known = F.col("spacing_mm").isNotNull() & F.lit(not overwrite)
    out = samples.withColumn("__volume", F.when(bids["subject"].isNotNull(), volume)).join(own.withColumn("__found", F.lit(True)), "__volume", "left")
    status = F.when(known, None).when(F.col("__volume").isNull(), "SKIP").when(F.col("__found").isNull(), "WARN").when(F.col("__error").isNotNull() | F.col("__new").isNull(), "ERROR").otherwise("OK")
    return out.withColumn("status", status).withColumn("spacing_mm", F.when(F.col("status") == "OK", F.col("__new")).otherwise(F.col("spacing_mm"))).drop("__volume", "__new", "__error", "__found")


def join_ground_truth(pred: DataFrame, truth: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Predictions with their truth; of several truths the highest counts, predictions without one go."""
    return pred.join(truth.groupBy(*keys).agg(F.max(label).alias(label)), keys)


def lookup_features(samples: DataFrame, store: DataFrame, key: str = "path", strict: bool = True) -> DataFrame:
    if strict:
        missing = samples.join(store.select(key), key, "left_anti").limit(1).count()
        if missing:
            raise KeyError("samples without features")
    return samples.join(store, key)


def link_folds(folds: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Fold members with a flag for those that the store lacks."""
    have = store.select(key).distinct().withColumn("__have", F.lit(True))
    return folds.join(have, key, "left").withColumn("missing", F.col("__have").isNull()).drop("__have")


def compare_variants(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    left = a.select(*keys, F.col(value).alias(f"{value}_a"))
    return left.join(b.select(*keys, F.col(value).alias(f"{value}_b")), keys, "full")


def sanity_check(images: DataFrame, labels: DataFrame, pattern: str) -> DataFrame:
    """One row for each problem: ``name``, ``issue``. Images and labels have ``name``, ``h``, ``w`` and ``error``."""
    b = labels.select("name", F.col("h").alias("lh"), F.col("w").alias("lw"), F.col("error").alias("lerror"), F.lit(True).alias("has_label"))
    a = images.join(b, "name", "left")
    issues = F.array_compact(
        F.array(
            F.when(~F.col("name").rlike(pattern), "bad_name"),
            F.when(F.col("has_label").isNull(), "missing_label"),
            F.when(F.col("has_label") & ((F.col("h") != F.col("lh")) | (F.col("w") != F.col("lw"))), "size_mismatch"),
            F.when(F.col("error").isNotNull() | F.col("lerror").isNotNull(), "unreadable"),
        )
    )
    return a.select("name", F.explode(issues).alias("issue"))


def empty_splits(images: DataFrame, labels: DataFrame, splits: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """``split`` and ``issue`` of the asked splits (of columns ``split``) whose images or labels are missing."""
    asked = images.sparkSession.createDataFrame([(x,) for x in splits], "split string")
    has = lambda df, name: df.select("split").distinct().withColumn(name, F.lit(True))
    both = asked.join(has(images, "__i"), "split", "left").join(has(labels, "__l"), "split", "left")
    issue = F.when(F.col("__i").isNull(), "missing_images").when(F.col("__l").isNull(), "missing_labels")
    return both.select("split", issue.alias("issue")).where("issue is not null")


def apply_exclusions(df: DataFrame, rules: DataFrame, dataset: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows that no rule (``rule_id``, ``dataset`` or null for any, ``pattern`` with ``*`` and ``?``, ``reason``) takes out,
    and the others with the first rule.

    The rules, a short list that people write, are gathered in one row; every row of the table is held against them
    where it stands.
    """
    text = F.col("pattern")
    for sign in ("\\", "%", "_"):
        text = F.replace(text, F.lit(sign), F.lit("\\" + sign))
    like = F.replace(F.replace(text, F.lit("*"), F.lit("%")), F.lit("?"), F.lit("_"))
    one = rules.agg(F.sort_array(F.collect_list(F.struct("rule_id", F.col("dataset").alias("of"), like.alias("like"), "reason"))).alias("__rules"))
    hit = lambda r: (r["of"].isNull() | (r["of"] == F.col(dataset))) & F.like(F.col(path), r["like"])
    found = df.join(F.broadcast(one), F.lit(True)).withColumn("__rule", F.get(F.filter("__rules", hit), F.lit(0))).drop("__rules")  # one row
    gone = found.where("__rule is not null").withColumns({"rule_id": F.col("__rule.rule_id"), "reason": F.col("__rule.reason")}).drop("__rule")
    return found.where("__rule is null").drop("__rule"), gone
