"""Functions on names, paths, log lines and keys: Column to Column, all built in."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns and lists that must read the names and logs of existing data (fixed values): the stem of a slice name with
#: plane, slice, tile, two spacings and perhaps a further index; contrasts, which merge by the aliases; a patch name;
#: key and number of a training log.
SLICE_NAME = r"(?i)^.*__(sagittal|axial)__s(\d{3,6})__t(\d{3,6})__sp(\d{3,4})x(\d{3,4})(?:__(\d+))?$"
SPACING = r"(?i)__sp(\d{3,4})x(\d{3,4})"
TILE = r"(?i)__t\d{3,6}__"
CONTRASTS = "T2starw|T2star|T1w|T2w|MTS|FLAIR|PSIR|MP2RAGE|STIR|PDw|T1rho|MTon|MToff|bold"
PATCH_NAME = r"^(sub-\d+)_acq-(?:sag|ax)_rec-(\d+)_(T1w|T2w)_desc-"
LOG_KEY_VALUE = r"([A-Za-z][A-Za-z0-9 _/\-]*?):\s*([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
ALIASES = {"T2starw": "T2star(w)", "T2star": "T2star(w)", "MTon": "MTS", "MToff": "MTS"}
#: Keys of training logs that are no metrics (fixed values).
NO_METRICS = ("Global Rank", "Memory")


def half_even(c: Column, digits: int = 0) -> Column:
    """Round half to even, as the data's own tools do."""
    return F.bround(c, digits)


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where the pattern or the group doesn't match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def sanitize_token(c: Column) -> Column:
    """Everything but letters, digits, dot, underscore and hyphen becomes a hyphen."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "-")


def normalize_label_suffix(c: Column) -> Column:
    return F.when((c == "") | c.startswith("_"), c).otherwise(F.concat(F.lit("_"), c))


def fmt_spacing(h: Column, w: Column) -> Column:
    """Spacings in micrometres, four digits at least each."""
    um = lambda c: half_even(c * 1000).cast("int")
    return F.format_string("sp%04dx%04d", um(h), um(w))


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.nii\.gz$", "")


def slice_name(src: Column, base: Column, plane: Column, idx: Column, tile: Column, spacing: Column) -> Column:
    first = F.when(F.instr(src, "/") > 0, F.substring_index(src, "/", 1)).otherwise(F.lit("."))
    return F.concat(first, F.lit("__"), base, F.lit("__"), plane, F.format_string("__s%04d__t%03d__", idx.cast("int"), tile.cast("int")), spacing, F.lit(".png"))


def parse_slice_name(c: Column) -> Column:
    """Struct of the parts of a slice's file name; its fields are null where the name doesn't fit."""
    stem = F.regexp_replace(c, r"\.[^./]*$", "")
    kinds = (("plane", "string"), ("slice", "int"), ("tile", "int"), ("sp_h", "int"), ("sp_w", "int"), ("extra", "int"))
    return F.struct(*[found(stem, SLICE_NAME, i + 1).cast(k).alias(n) for i, (n, k) in enumerate(kinds)])


def parse_spacing(c: Column) -> Column:
    """Millimetres from a name; a spacing of 10 mm or more has five digits, of which only four can be read."""
    of = lambda i: found(c, SPACING, i).cast("double") / 1000
    return F.struct(of(1).alias("h"), of(2).alias("w"))


def replace_spacing(c: Column, mm: float) -> Column:
    um = round(mm * 1000)
    return F.regexp_replace(c, SPACING, f"__sp{um:04d}x{um:04d}")


def tile_stem(c: Column, tile_id: Column) -> Column:
    tag = F.format_string("__t%03d", tile_id.cast("int"))
    marked = F.concat(F.regexp_extract(c, r"(?i)^(.*?)__t\d{3,6}__", 1), tag, F.lit("__"), F.regexp_extract(c, r"(?i)__t\d{3,6}__(.*)$", 1))
    return F.when(c.rlike(TILE), marked).otherwise(F.concat(c, tag))


def dataset_from_url(c: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
    return F.coalesce(F.nullif(F.regexp_replace(last, r"\.git$", ""), F.lit("")), F.lit("repo"))


def parse_bids(c: Column) -> Column:
    """Subject, recording and modality of a patch name; null where it doesn't fit."""
    return F.struct(*[found(c, PATCH_NAME, i + 1).alias(x) for i, x in enumerate(("subject", "recording", "modality"))])


def subject_of(c: Column, sep: str = "_") -> Column:
    return F.substring_index(c, sep, 1)


def normalize_level(c: Column) -> Column:
    """``desc-T12L1`` becomes ``t12_l1``, by the first part that begins with ``desc-``; null where it is no level."""
    first = F.get(F.filter(F.split(c, "_"), lambda x: x.startswith("desc-")), F.lit(0))
    part = lambda i: F.lower(found(first, r"^desc-([A-Za-z]+\d+)([A-Za-z]+\d+)", i))
    return F.concat(part(1), F.lit("_"), part(2))


def split_label_key(c: Column) -> Column:
    """``subject_pathology..._a_b``: subject, pathology, level."""
    p = F.split(c, "_")
    n = F.size(p)
    pathology = F.array_join(F.slice(p, 2, F.greatest(n - 3, F.lit(0))), "_")
    return F.struct(F.get(p, F.lit(0)).alias("subject"), pathology.alias("pathology"), F.array_join(F.slice(p, F.greatest(n - 1, F.lit(1)), F.lit(2)), "_").alias("level"))


def contrast_of(c: Column) -> Column:
    raw = found(c, f"_({CONTRASTS})__")
    out = F.when(raw.isNull(), F.lit("unknown"))
    for a, b in ALIASES.items():
        out = out.when(raw == a, F.lit(b))
    return out.otherwise(raw)


def dataset_of(path: Column, name: Column) -> Column:
    p = F.split(path, "/")
    return F.when(F.size(p) >= 3, F.get(p, F.lit(1))).otherwise(F.coalesce(found(name, r"^([^_]+)(?=__sub)"), F.lit("unknown")))


def orientation_of(c: Column) -> Column:
    return F.coalesce(found(c, r"__(axial|sagittal)__"), F.lit("unknown"))


def split_of(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def strip_channel_suffix(c: Column) -> Column:
    return F.regexp_replace(c, "_0000$", "")


def model_short_name(c: Column) -> Column:
    """The last part of a model path that says something; a hub folder ``models--org--name`` gives ``name``.

    Folders of a hub's cache and hashes, eight hexadecimal digits or more, say nothing. If no part does, the last one
    is taken, and ``fm`` for a path without parts.
    """
    parts = F.filter(F.split(c, "/"), lambda p: ~p.isin("", "."))
    told = F.filter(parts, lambda p: ~p.isin("snapshots", "blobs", "refs") & ~p.rlike("^[0-9a-fA-F]{8,}$"))
    last = F.coalesce(F.get(told, F.size(told) - 1), F.when(c.startswith("/"), "/"), F.get(parts, F.size(parts) - 1), F.lit("fm"))
    return F.when(last.rlike("^models--.*--"), F.element_at(F.split(last, "--"), -1)).otherwise(last)


def feature_key(name: Column, suffix: str = "", prefix: str = "patch_tokens") -> Column:
    return F.concat(F.lit(f"{prefix}_"), name, F.lit(f"_{suffix}" if suffix else ""))


def parse_iteration(c: Column) -> Column:
    return found(c, r"(?i)Iteration:\s*(\d+)\s*/\s*\d+").cast("long")


def parse_ts(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(found(c, r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})"), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))


def parse_log_kv(df: DataFrame, line: str = "line", keep: tuple[str, ...] = ("run", "line_no")) -> DataFrame:
    """One row for each metric of a log line: run, line_no, iter, ts, key, value. Of a key that a line repeats the last counts."""
    part = lambda i: F.regexp_extract_all(line, F.lit(LOG_KEY_VALUE), F.lit(i))
    pairs = F.arrays_zip(F.transform(part(1), F.trim).alias("k"), part(2).alias("v"))
    own = df.select(*keep, parse_iteration(F.col(line)).alias("iter"), parse_ts(F.col(line)).alias("ts"), pairs.alias("kv"))
    last = F.filter("kv", lambda x, i: ~F.exists(F.slice("kv", i + 2, F.size("kv")), lambda y: y["k"] == x["k"]))
    out = own.select(*keep, "iter", "ts", F.explode(last).alias("kv"))
    return out.select(*keep, "iter", "ts", F.col("kv.k").alias("key"), F.col("kv.v").cast("double").alias("value")).where(~F.col("key").isin(*NO_METRICS))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def hash_uniform(key: Column) -> Column:
    """A number in [0, 1) from 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def hash_split(key: Column, seed: int | str, ratio: float, mode: str = "native") -> Column:
    """``train`` where the seeded hash of the key is below the ratio, else ``val``.

    ``exact`` takes the 64-bit BLAKE2b digest, for parity with splits made by other tools; it needs Python workers.
    """
    if mode == "exact":
        @F.pandas_udf("double")
        def uniform(keys: pd.Series) -> pd.Series:
            return keys.map(lambda k: int.from_bytes(hashlib.blake2b(f"{seed}{k}".encode(), digest_size=8).digest(), "big") / (2**64 - 1))

        u = uniform(key)
    else:
        u = hash_uniform(F.concat(F.lit(str(seed)), key))
    return F.when(u < ratio, "train").otherwise("val")


def params_fingerprint(*cols: Column) -> Column:
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def json_field(c: Column, name: str) -> Column:
    return F.get_json_object(c, f"$.{name}")


def round_n(c: Column, n: int) -> Column:
    return F.bround(c, n)
