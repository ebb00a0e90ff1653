"""Classification metrics of prediction tables: DataFrame to DataFrame, one row or one small table for each group.

A prediction table has ``y`` (int) and ``logits`` (array<double>) and any grouping columns. All metrics but the
probabilistic ones rest on one confusion table, so predictions are aggregated before anything is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slicework.functions.pixels import argmax, log_softmax, softmax
from slicework.operators.splits import numbered


def with_prediction(df: DataFrame) -> DataFrame:
    return df.withColumn("p", argmax(F.col("logits")))


def class_distribution(df: DataFrame, label: str = "y") -> DataFrame:
    """Count of each class, zero for absent ones up to the largest."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = df.agg(F.max(label).alias("top")).where("top is not null").select(F.explode(F.sequence(F.lit(0), "top")).alias(label))
    return every.join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def confusion_matrix(df: DataFrame, by: list[str] | None = None, normalize: bool = True) -> DataFrame:
    """Counts of true and predicted classes over the union of labels, and each row's shares."""
    by = by or []
    found = with_prediction(df).groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("n"))
    labels = found.select(*by, F.explode(F.array("y", "p")).alias("c")).distinct()
    grid = labels.select(*by, F.col("c").alias("y")).join(labels.select(*by, F.col("c").alias("p")), by) if by else labels.select(F.col("c").alias("y")).join(labels.select(F.col("c").alias("p")), F.lit(True))
    out = grid.join(found, [*by, "y", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if normalize:
        out = out.withColumn("share", F.coalesce(F.col("n") / F.nullif(F.sum("n").over(W.partitionBy(*by, "y")), F.lit(0)), F.lit(0.0)))
    return out


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def per_class(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group and class (of truth or prediction): tp, support, predicted, precision, recall, f1."""
    by = by or []
    n = with_prediction(df).groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("n"))
    parts = n.select(*by, F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("q"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("q"), F.lit(0).cast("long").alias("h")))).alias("x"))
    out = parts.groupBy(*by, F.col("x.c").alias("class")).agg(F.sum("x.h").alias("tp"), F.sum("x.t").alias("support"), F.sum("x.q").alias("predicted"))
    out = out.withColumn("precision", _ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", _ratio(F.col("tp"), F.col("support")))
    return out.withColumn("f1", _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")))


def accuracy(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return with_prediction(df).groupBy(*(by or [])).agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))


def balanced_accuracy(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean recall of the classes that occur."""
    return per_class(df, by).where("support > 0").groupBy(*(by or [])).agg(F.avg("recall").alias("balanced_accuracy"))


def f1(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return per_class(df, by).groupBy(*(by or [])).agg(F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def classification_report(df: DataFrame) -> DataFrame:
    """Rows by class, then accuracy, macro and weighted averages; only classes that occur."""
    rows = per_class(df).where("support > 0")
    body = rows.select(F.col("class").cast("string").alias("label"), "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    total = F.sum("support").cast("double").alias("support")
    macro = rows.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total)
    weighted = rows.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], total)
    hit = F.sum("tp") / F.sum("support")
    acc = rows.agg(F.lit("accuracy").alias("label"), hit.alias("precision"), hit.alias("recall"), hit.alias("f1"), total)
    return reduce(DataFrame.unionByName, [body, acc, macro, weighted])


def agreement(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa, quadratic weighted kappa (by position in the sorted union of labels) and Matthews' coefficient."""
    by = by or []
    cells = confusion_matrix(df, by, normalize=False)
    cells = cells.withColumn("i", F.dense_rank().over(W.partitionBy(*by).orderBy("y"))).withColumn("j", F.dense_rank().over(W.partitionBy(*by).orderBy("p")))
    s = F.sum("n").over(W.partitionBy(*by))
    t, q = F.sum("n").over(W.partitionBy(*by, "y")), F.sum("n").over(W.partitionBy(*by, "p"))
    cells = cells.select(*by, "n", "i", "j", s.alias("s"), (t.cast("double") * q / s).alias("e"))
    off, square = (F.col("i") != F.col("j")).cast("double"), (F.col("i") - F.col("j")) ** 2
    sums = cells.groupBy(*by).agg(
        F.sum(F.col("n") * off).alias("o1"), F.sum(F.col("e") * off).alias("e1"), F.sum(F.col("n") * square).alias("o2"), F.sum(F.col("e") * square).alias("e2"),
        F.sum(F.when(F.col("i") == F.col("j"), F.col("n"))).alias("c"), F.sum(F.when(F.col("i") == F.col("j"), F.col("e") * F.col("s"))).alias("pt"), F.max("s").alias("s"),
    )
    squares = with_prediction(df).groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("n"))
    tt = squares.groupBy(*by, "y").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(F.col("n").cast("double") ** 2).alias("tt"))
    pp = squares.groupBy(*by, "p").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(F.col("n").cast("double") ** 2).alias("pp"))
    joined = sums.join(tt, by).join(pp, by) if by else sums.join(tt, F.lit(True)).join(pp, F.lit(True))
    under = F.sqrt((F.col("s").cast("double") ** 2 - F.col("pp")) * (F.col("s").cast("double") ** 2 - F.col("tt")))
    mcc = F.coalesce((F.col("c").cast("double") * F.col("s") - F.col("pt")) / F.nullif(under, F.lit(0.0)), F.lit(0.0))
    return joined.select(*by, (1 - F.col("o1") / F.nullif("e1", F.lit(0.0))).alias("kappa"), (1 - F.col("o2") / F.nullif("e2", F.lit(0.0))).alias("qwk"), mcc.alias("mcc"))


def cross_entropy(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(-F.get(log_softmax(F.col("logits")), F.col("y"))).alias("cross_entropy"))


def weighted_cross_entropy(df: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 4.0), by: list[str] | None = None) -> DataFrame:
    """Clipped, renormalised probabilities; the mean is over samples, not over weights."""
    return df.groupBy(*(by or [])).agg(F.avg(_weighted_loss(weights)).alias("wbce"))


def _weighted_loss(weights: tuple[float, ...]) -> Column:
    p = F.transform(softmax(F.col("logits")), lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(1e-7)))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return -F.get(F.array(*map(F.lit, weights)), F.col("y")) * F.ln(F.get(p, F.col("y")) / total)


#: Ranges of scores of a class that are ranked apart.
SCORE_RANGES = 64


def auc_ovr(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rank AUC of each class against the rest on softmax probabilities, with mid-ranks; macro and weighted means.

    Null where a class has no sample. Scores are collapsed before ranks are summed, and dealt into ranges of about equal
    size, so a window runs over the scores of a range. With two classes only the second one's column counts.
    """
    by = by or []
    long = df.select(*by, "y", F.size("logits").alias("k"), F.posexplode(softmax(F.col("logits"))).alias("class", "s")).where("k <> 2 or class = 1")
    return _auc_of_weighted(long.groupBy(*by, "class", "s").agg(F.sum((F.col("y") == F.col("class")).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")), by, SCORE_RANGES)


def _in_ranges(tied: DataFrame, by: list[str], ranges: int) -> DataFrame:
    """``tied`` with ``range``, the place of each score among some quantiles of its group and class, and ``before``, the
    other classes' samples in lower ranges. Whatever the quantiles, ranks are exact; these only share out the work."""
    group = [*by, "class"]
    quantiles = F.percentile_approx("s", [i / ranges for i in range(1, ranges)], 1000)
    cuts = tied.groupBy(*group).agg(quantiles.alias("__cuts"))  # one row for each group and class
    ranged = tied.join(cuts, group).withColumn("range", F.size(F.filter("__cuts", lambda x: x < F.col("s")))).drop("__cuts")
    sums = ranged.groupBy(*group, "range").agg(F.sum(F.col("n") - F.col("pos")).alias("__n"))
    w = W.partitionBy(*group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # as many rows as ranges
    return ranged.join(sums.select(*group, "range", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("before")), [*group, "range"])


def _auc_of_weighted(tied: DataFrame, by: list[str], ranges: int = 1) -> DataFrame:
    """From ``by``, ``class``, distinct score ``s``, and how many samples, ``n``, and of the class, ``pos``, have it."""
    tied = _in_ranges(tied, by, ranges) if ranges > 1 else tied.withColumns({"range": F.lit(0), "before": F.lit(0)})
    w = W.partitionBy(*by, "class", "range").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    tied = tied.withColumn("below", F.col("before") + F.coalesce(F.sum(F.col("n") - F.col("pos")).over(w), F.lit(0)))
    neg = F.col("n") - F.col("pos")
    auc = tied.groupBy(*by, "class").agg(F.sum("pos").alias("np"), F.sum(neg).alias("nn"), F.sum(F.col("pos") * (F.col("below") + neg / 2.0)).alias("u"))
    auc = auc.withColumn("auc", F.col("u") / F.nullif(F.col("np").cast("double") * F.col("nn"), F.lit(0.0)))
    complete = F.count("auc") == F.count(F.lit(1))
    return auc.groupBy(*by).agg(F.when(complete, F.avg("auc")).alias("auc_macro"), F.when(complete, F.sum(F.col("auc") * F.col("np")) / F.sum("np")).alias("auc_weighted"))


def _losses() -> tuple[Column, Column]:
    """Cross entropy and weighted cross entropy of a row; see ``cross_entropy`` and ``weighted_cross_entropy``."""
    return -F.get(log_softmax(F.col("logits")), F.col("y")), _weighted_loss((1.0, 2.0, 4.0))


def evaluate(df: DataFrame, by: list[str]) -> DataFrame:
    """All metrics in one row for each group.

    One confusion table, with the sums of the losses, gives all but the AUC: of each group its cells, as many as pairs
    of classes, are gathered in an array. With t, q the sums of true and predicted class, i their place among the sorted
    classes, s the number of samples: expected disagreement is (s s - sum t q) / s, squared
    sum t i i + sum q i i - 2 (sum t i) (sum q i) / s.
    """
    plain, weighted = _losses()
    cells = with_prediction(df).groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("n"), F.sum(plain).alias("plain"), F.sum(weighted).alias("weighted"))
    own = cells.groupBy(*by).agg(F.collect_list(F.struct("y", "p", "n")).alias("cells"), (F.sum("plain") / F.sum("n")).alias("cross_entropy"), (F.sum("weighted") / F.sum("n")).alias("wbce"))
    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))
    own = own.withColumn("classes", F.array_sort(F.array_distinct(F.flatten(F.transform("cells", lambda x: F.array(x["y"], x["p"]))))))
    place = lambda c: F.array_position("classes", c).cast("double")
    count = lambda c, f: add("cells", lambda x: F.when(f(x, c), x["n"].cast("double")).otherwise(0.0))
    each = F.transform("classes", lambda c: F.struct(place(c).alias("i"), count(c, lambda x, c: (x["y"] == c) & (x["p"] == c)).alias("h"), count(c, lambda x, c: x["y"] == c).alias("t"), count(c, lambda x, c: x["p"] == c).alias("q")))
    own = own.withColumn("each", each)
    sums = {
        "s": lambda x: x["t"], "c": lambda x: x["h"], "tq": lambda x: x["t"] * x["q"], "tt": lambda x: x["t"] ** 2, "qq": lambda x: x["q"] ** 2,
        "ti": lambda x: x["t"] * x["i"], "qi": lambda x: x["q"] * x["i"], "ii": lambda x: (x["t"] + x["q"]) * x["i"] ** 2,
        "recalls": lambda x: _ratio(x["h"], x["t"]), "f1s": lambda x: _ratio(2 * x["h"], x["t"] + x["q"]), "f1t": lambda x: _ratio(2 * x["h"], x["t"] + x["q"]) * x["t"],
    }
    own = own.select(*by, "cross_entropy", "wbce", "each", add("cells", lambda x: x["n"] * place(x["y"]) * place(x["p"])).alias("ij"), *[add("each", f).alias(k) for k, f in sums.items()])
    s, tq = F.col("s"), F.col("tq")
    under = F.sqrt((s * s - F.col("qq")) * (s * s - F.col("tt")))
    out = own.select(
        *by,
        (F.col("c") / s).alias("accuracy"),
        (F.col("recalls") / F.size(F.filter("each", lambda x: x["t"] > 0))).alias("balanced_accuracy"),
        (F.col("f1s") / F.size("each")).alias("f1_macro"),
        (F.col("f1t") / s).alias("f1_weighted"),
        (1 - (s - F.col("c")) * s / F.nullif(s * s - tq, F.lit(0.0))).alias("kappa"),
        (1 - (F.col("ii") - 2 * F.col("ij")) / F.nullif(F.col("ii") - 2 * F.col("ti") * F.col("qi") / s, F.lit(0.0))).alias("qwk"),
        F.coalesce((F.col("c") * s - tq) / F.nullif(under, F.lit(0.0)), F.lit(0.0)).alias("mcc"),
        "cross_entropy",
        "wbce",
    )
    return out.join(auc_ovr(df, by), by)


def bootstrap_ci(df: DataFrame, key: str = "sample_id", draws: int = 1000, seed: int = 42) -> DataFrame:
    """``metric``, ``mean``, ``ci_low``, ``ci_high``, ``n_draws``: accuracy and one-against-rest AUC, macro and weighted,
    over resamples with replacement. Resamples that lack a class have no AUC and don't count for it.

    Samples are numbered in the order of a digest of their key, by buckets; draw k of resample b is the sample whose
    number the MD5 of seed, b and k gives. Draws are counted by resample and number before they meet the samples.
    """
    spark = df.sparkSession
    own = with_prediction(df).select(key, "y", softmax(F.col("logits")).alias("s"), (F.col("y") == F.col("p")).cast("double").alias("hit"))
    samples = numbered(own, F.md5(F.concat_ws("/", F.lit(str(seed)), key)), key, out="i")
    n = df.count()
    pick = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), "b", "k")), 1, 13), 16, 10).cast("bigint")
    grid = spark.range(draws * n).select(F.expr(f"id div {n}").alias("b"), F.expr(f"id % {n}").alias("k")).select("b", (pick % n).alias("i"))
    drawn = grid.groupBy("b", "i").agg(F.count(F.lit(1)).alias("m")).join(samples, "i")
    hits = drawn.groupBy("b").agg((F.sum(F.col("m") * F.col("hit")) / F.sum("m")).alias("accuracy"))
    long = drawn.select("b", "y", "m", F.size("s").alias("k"), F.posexplode("s").alias("class", "v")).where("k <> 2 or class = 1")
    aucs = _auc_of_weighted(long.groupBy("b", "class", "v").agg(F.sum(F.when(F.col("y") == F.col("class"), F.col("m")).otherwise(0)).alias("pos"), F.sum("m").alias("n")).withColumnRenamed("v", "s"), ["b"])
    each = hits.join(aucs, "b").select("b", F.expr("stack(3, 'accuracy', accuracy, 'auc_macro', auc_macro, 'auc_weighted', auc_weighted) as (metric, v)"))
    return each.groupBy("metric").agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.025)).alias("ci_low"), F.percentile("v", F.lit(0.975)).alias("ci_high"), F.count("v").alias("n_draws"))


def balanced_class_weights(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(label, (F.sum("n").over(W.partitionBy()) / (F.count(F.lit(1)).over(W.partitionBy()) * F.col("n"))).alias("weight"))


def ensemble(df: DataFrame, key: str) -> DataFrame:
    """Mean logits over models, then softmax: the class and its probability."""
    long = df.select(key, F.posexplode("logits").alias("c", "v")).groupBy(key, "c").agg(F.avg("v").alias("v"))
    mean = long.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("logits"))
    return mean.select(key, argmax(F.col("logits")).alias("p"), F.array_max(softmax(F.col("logits"))).alias("prob"))


def regime_table(df: DataFrame, regime: str = "task", run: str = "run") -> DataFrame:
    """Per regime the metrics of its last run by name, AUC, accuracy, QWK and WBCE among them, and its size."""
    last = df.groupBy(regime).agg(F.max(run).alias(run))
    own = df.join(F.broadcast(last), [regime, run])  # one row for each regime
    sizes = own.groupBy(regime, run).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(evaluate(own, [regime, run]), [regime, run])


def complete_groups(df: DataFrame, group: str, value: str, required: int) -> DataFrame:
    """Rows of groups that have all the required values."""
    full = df.groupBy(group).agg(F.count_distinct(value).alias("k")).where(F.col("k") >= required).select(group)
    return df.join(full, group, "left_semi")


def weighted_mean(df: DataFrame, value: str, size: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(size)) / F.sum(size)).alias("mean"))


def sinkhorn(scores: DataFrame, temperature: float, iterations: int = 3) -> DataFrame:
    """Balanced soft assignment of ``sample`` to ``proto`` from ``score``: rows and columns normalised in turn.

    Sums of a prototype are partial sums of all tasks, one row a prototype; a sample's rows, one a prototype, stay together.
    """
    top = scores.agg(F.max("score").alias("top"), F.count_distinct("proto").alias("k"), F.count_distinct("sample").alias("b"))
    df = scores.join(F.broadcast(top), F.lit(True)).withColumn("q", F.exp((F.col("score") - F.col("top")) / temperature))  # one row
    for _ in range(iterations):
        sums = df.groupBy("proto").agg(F.sum("q").alias("sum"))
        df = df.join(sums, "proto").withColumn("q", F.col("q") / F.col("sum") / F.col("k")).drop("sum")
        df = df.withColumn("q", F.col("q") / F.sum("q").over(W.partitionBy("sample")) / F.col("b"))
    return df.withColumn("q", F.col("q") * F.col("b")).select(*scores.columns, "q")
