"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Each text gives a vector of transformed statistics. For each group the location and scatter of its most
concentrated part are found by concentration steps; texts whose Mahalanobis distance from them is large are
rejected. Everything is DataFrame work: a step is one aggregation by group and distance bin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slicework.llm.shared import materialize, words

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIM = 5
X = [f"x{i}" for i in range(1, DIM + 1)]
#: Smallest standard deviation believed in each coordinate, in its own unit; keeps constant statistics invertible.
FLOOR = (1.5, 0.25, 0.05, 0.05, 0.05)
#: Share of a group that its estimates rest on, and the factor that makes such a scatter consistent for a
#: normal sample of five coordinates.
SHARE, CONSISTENT = 0.75, 1.41
#: Squared distance beyond which a text goes: the chi-square quantile of five degrees of freedom at 1 - 6e-7.
CUTOFF = 37.0
#: Groups with fewer texts take the estimates of their language, and those of all texts where that has too few.
MIN_GROUP = 50
STEPS = 4
BINS = 160
WINDOW = 5


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of STATS and ``n_lines``; null and empty texts have none of anything.

    Windows of five words are compared by 64-bit hashes inside a text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__w", words(F.col(text)))
    df = df.withColumn("n_words", F.size("__w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"))
    df = df.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    df = df.withColumn("n_lines", F.size("__lines").cast("long")).drop("__lines")
    w, last = F.col("__w"), F.size("__w") - WINDOW
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))
    df = df.withColumn("__h", F.when(last > 0, windows).otherwise(F.array().cast("array<bigint>"))).drop("__w")
    some = F.size(F.array_distinct("__h")) < F.size("__h")
    at = F.sort_array(F.transform("__h", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    df = df.withColumn("__at", F.when(some, at)).drop("__h")
    a = F.col("__at")
    twice = F.filter(a, lambda x, k: ((k > 0) & (F.get(a, k - 1)["v"] == x["v"])) | F.coalesce(F.get(a, k + 1)["v"] == x["v"], F.lit(False)))
    df = df.withColumn("__pos", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__at")
    p = F.col("__pos")
    fresh = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(fresh, F.lit(0), lambda acc, x: acc + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("__pos")


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list:
    """The transformed statistics: log length, and rates that are shrunk for short texts."""
    n = F.col("n_words").cast("double")
    return [
        F.log1p(n),
        (F.col("word_chars") + 100.0) / (n + 20.0),
        F.sqrt(F.col("n_symbols") / (n + 20.0)),
        F.col("n_dup_lines") / (F.col("n_lines") + 5.0),
        F.col("n_repeat_words") / (n + 20.0),
    ]


def _pairs():
    return [(i, j) for i in range(DIM) for j in range(i + 1)]


def _sums():
    first = [F.sum(x).alias(f"s{i}") for i, x in enumerate(X)]
    return [F.count(F.lit(1)).alias("n"), *first, *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{i}{j}") for i, j in _pairs()]]


def _estimates(sums: DataFrame, keys: list[str], factor: float, diagonal: bool = False) -> DataFrame:
    """Means, the Cholesky factor of the floored scatter, and its log determinant, from sums and products."""
    df = sums.select(*keys, "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(DIM)], *[(F.col(f"p{i}{j}") / F.col("n")).alias(f"q{i}{j}") for i, j in _pairs()])
    for i, j in _pairs():
        c = (F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * factor
        c = F.greatest(c, F.lit(0.0)) + FLOOR[i] ** 2 if i == j else F.lit(0.0) if diagonal else c
        c = reduce(lambda acc, k: acc - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), c)
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-12))) if i == j else c / F.col(f"l{j}{j}"))
    log_det = reduce(lambda a, b: a + b, [F.ln(f"l{i}{i}") for i in range(DIM)])
    return df.select(*keys, *[f"m{i}" for i in range(DIM)], *[f"l{i}{j}" for i, j in _pairs()], log_det.alias("log_det"))


def _distance(df: DataFrame, out: str) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    for i in range(DIM):
        y = reduce(lambda acc, k: acc - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(X[i]) - F.col(f"m{i}"))
        df = df.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return df.withColumn(out, reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIM)]))


def fit_mcd(rows: DataFrame, keys: list[str], steps: int = STEPS) -> DataFrame:
    """MCD estimates per group of ``rows`` (columns ``keys`` and X): one row per group.

    Two deterministic starts, the full and the diagonal classical scatter, go through the concentration
    steps together; the one with the smaller determinant wins, the full one on a tie. A step keeps the bins
    of smallest distance that together hold the wanted share, so no group is sorted or brought to one task.
    """
    sums = materialize(rows.groupBy(*keys).agg(*_sums()), "mcd-all")
    both = [*keys, "start"]
    est = _estimates(sums.withColumn("start", F.lit(0)), both, 1.0).unionByName(_estimates(sums.withColumn("start", F.lit(1)), both, 1.0, True))
    by_bin = W.partitionBy(*both).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    adds = [F.sum(c).alias(c) for c in ("n", *[f"s{i}" for i in range(DIM)], *[f"p{i}{j}" for i, j in _pairs()])]
    for step in range(steps):
        near = _distance(_with_estimates(rows, est, keys), "d2")
        bins = near.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.log2(1 + F.col("d2")) * 16)).cast("int")).groupBy(*both, "bin").agg(*_sums())
        kept = bins.withColumn("before", F.coalesce(F.sum("n").over(by_bin), F.lit(0))).withColumn("all", F.sum("n").over(W.partitionBy(*both)))
        kept = kept.where(F.col("before") < F.col("all") * SHARE)
        est = materialize(_estimates(kept.groupBy(*both).agg(*adds), both, CONSISTENT), f"mcd-{step}")
    best = W.partitionBy(*keys).orderBy("log_det", "start")
    return est.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "start")


def _with_estimates(rows: DataFrame, est: DataFrame, keys: list[str]) -> DataFrame:
    """Rows joined to their group's estimates; null keys match each other."""
    renamed = est.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in est.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return rows.join(renamed, on).drop(*[f"__{k}" for k in keys])


def quality_verdicts(docs: DataFrame, lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``distance`` (null where none is defined) and ``kept``.

    Null language or source form groups of their own. A text that fails the base rules is not kept; a group
    too small falls back to its language, then to all texts. Columns of ``docs`` other than those stay.
    """
    named = docs.withColumn("g_lang", F.col(lang)).withColumn("g_source", F.col(source))
    rows = text_statistics(named).withColumn("base_failed", base_failed())
    rows = rows.withColumns(dict(zip(X, vector(), strict=True)))
    rows = materialize(rows, "quality")
    sized = rows.where("n_words >= 10").groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("n"))
    sized = sized.withColumn("n_lang", F.sum("n").over(W.partitionBy("g_lang")))
    level = F.when(F.col("n") >= MIN_GROUP, 2).when(F.col("n_lang") >= MIN_GROUP, 1).otherwise(0)
    groups = materialize(sized.select("g_lang", "g_source", level.alias("level")), "quality-groups")
    near = lambda df: _with_estimates(df, groups, ["g_lang", "g_source"])
    keys = ["level", "k_lang", "k_source"]
    keyed = lambda df: df.withColumns({"k_lang": F.when(F.col("level") > 0, F.col("g_lang")), "k_source": F.when(F.col("level") > 1, F.col("g_source"))})
    ready = keyed(near(rows.where("n_words >= 10").select("g_lang", "g_source", *X)))
    # the two fallbacks rest on all texts of the language, or on all texts
    levels = {r["level"] for r in groups.select("level").distinct().collect()}  # of 0, 1 and 2
    none = F.lit(None).cast("string").alias("k_source")
    wide = ready.where("level = 2").select(*keys, *X)
    if 1 in levels:
        few = groups.where("level = 1").select(F.col("g_lang").alias("__l")).distinct()
        part = ready.join(few, ready["g_lang"].eqNullSafe(few["__l"]), "left_semi")
        wide = wide.unionByName(part.select(F.lit(1).alias("level"), F.col("g_lang").alias("k_lang"), none, *X))
    if 0 in levels:
        wide = wide.unionByName(ready.select(F.lit(0).alias("level"), F.lit(None).cast("string").alias("k_lang"), none, *X))
    est = fit_mcd(materialize(wide, "quality-vectors"), keys)
    judged = _distance(_with_estimates(keyed(near(rows.where("n_words >= 10"))), est, keys), "distance")
    judged = judged.select(*rows.columns, "distance")
    short = rows.where("n_words < 10").withColumn("distance", F.lit(None).cast("double"))
    out = judged.unionByName(short).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff))
    return out.withColumn("kept", F.coalesce("kept", F.lit(False))).drop("g_lang", "g_source", "n_lines", *X)


def op4_robust_outliers(docs: DataFrame) -> DataFrame:
    """The counts of every text, whether the base rules fail it, and whether it is kept."""
    slim = docs.select("doc_id", "text", "lang", "source")
    return quality_verdicts(slim).select("doc_id", *STATS, "base_failed", "kept", F.round("distance", 6).alias("distance"))
