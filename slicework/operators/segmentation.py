"""Segmentation metrics, tiles and image statistics: DataFrame to DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicework.functions import kernels
from slicework.functions.pixels import boundary, has_foreground, total
from slicework.operators.quantiles import quantiles

EPS = 1e-7
SUMMARY = ("mean", "std", "median", "p25", "p75", "min", "max")


def seg_metrics(df: DataFrame, gt: str = "gt_px", pred: str = "pred_px") -> DataFrame:
    """Per image tp, fp, fn, tn and the ratios on them, with EPS above and below."""
    both = F.arrays_zip(F.col(gt).alias("g"), F.col(pred).alias("p"))
    count = lambda g, p: F.size(F.filter(both, lambda x: ((x["g"] > 0) == F.lit(g)) & ((x["p"] > 0) == F.lit(p)))).cast("long")
    out = df.withColumns({"tp": count(True, True), "fp": count(False, True), "fn": count(True, False), "tn": count(False, False)})
    ratio = lambda a, b: (a + EPS) / (b + EPS)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"dice": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp)})
    return out.withColumn("has_fg", has_foreground(F.col(gt)))


def boundary_points(df: DataFrame, key: str, mask: str) -> DataFrame:
    on = F.filter(F.transform(boundary(F.col(mask), F.col("h"), F.col("w")), lambda v, i: F.when(v == 1, i)), lambda i: i.isNotNull())
    return df.select(key, "w", F.explode(on).alias("i")).select(key, F.floor(F.col("i") / F.col("w")).alias("y"), (F.col("i") % F.col("w")).alias("x"))


def nearest_boundary(df: DataFrame, key: str, of: str, to: str) -> DataFrame:
    """For each boundary point of the mask ``of`` the nearest one of the mask ``to`` of the same row, and its distance ``d``.

    Masks stay in their task, and no pairs of points are formed.
    """
    points = kernels.nearest_points()(F.col(of), F.col(to), F.col("h"), F.col("w"))
    return df.select(key, F.inline(points))


def hausdorff95(df: DataFrame, key: str = "image_id", gt: str = "gt_px", pred: str = "pred_px") -> DataFrame:
    """95th percentile of the boundary distances both ways; 0 if both masks are empty, null if one is.

    An image's masks stay in their task: a kernel measures each boundary pixel by distances along columns, in time
    of boundary pixels times width, where joining all pairs of boundary pixels would shuffle their product.
    """
    value = kernels.hausdorff95()(F.col(gt), F.col(pred), F.col("h"), F.col("w"))
    return df.select(key, F.nullif(value, F.lit(float("nan"))).alias("hd95"))


def _seven(long: DataFrame, by: list[str]) -> DataFrame:
    """Per group the summary of ``v`` and its count ``n``; null keys are a group."""
    plain = long.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n"))
    q = quantiles(long, by, "v", [0.5, 0.25, 0.75]).select(*[F.col(c).alias(f"__{c}") for c in by], "q")
    both = plain.join(q, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]))
    named = {"median": F.col("q")[0], "p25": F.col("q")[1], "p75": F.col("q")[2]}
    return both.select(*by, *[named.get(c, F.col(c)).alias(c) for c in SUMMARY], "n")


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row for each metric, NaN as null."""
    pairs = ", ".join(f"'{m}', cast(nullif(`{m}`, double('NaN')) as double)" for m in metrics)
    return df.select(*keys, F.expr(f"stack({len(metrics)}, {pairs}) as (metric, v)"))


def summarise(df: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, median, quartiles, least and greatest of each metric; none for a metric without values."""
    by = by or []
    long = long_metrics(df, by, metrics).where("v is not null")
    return _seven(long, [*by, "metric"])


def summary_by(df: DataFrame, subject: str, metrics: list[str], has_fg: str = "has_fg") -> DataFrame:
    """The summary over all images and over those with foreground, in total (null subject) and by subject."""
    tagged = df.withColumn("subset", F.explode(F.when(F.col(has_fg), F.array(F.lit("all"), F.lit("foreground"))).otherwise(F.array(F.lit("all")))))
    long = long_metrics(tagged, ["subset", subject], metrics).where("v is not null")
    own = F.struct(F.lit(False).alias("total"), F.col(subject).alias("of"))
    total = F.struct(F.lit(True).alias("total"), F.lit(None).cast(df.schema[subject].dataType).alias("of"))  # apart from rows of no subject
    both = long.select("subset", "metric", "v", F.inline(F.array(own, total)))
    return _seven(both, ["subset", "metric", "total", "of"]).drop("total").withColumnRenamed("of", subject)


def dice_loss(df: DataFrame, p: str, t: str, eps: float = 1e-6) -> DataFrame:
    inter = total(F.zip_with(p, t, lambda a, b: a * b))
    return df.agg((1 - F.avg((2 * inter + eps) / (total(F.col(p)) + total(F.col(t)) + eps))).alias("dice_loss"))


def dice_score(df: DataFrame, p: str, t: str, eps: float = 1e-6) -> DataFrame:
    hard = F.transform(p, lambda v: (v > 0.5).cast("double"))
    inter = total(F.zip_with(hard, t, lambda a, b: a * b))
    return df.agg(F.avg((2 * inter + eps) / (total(hard) + total(F.col(t)) + eps)).alias("dice"))


def bce_with_pos_weight(df: DataFrame, logits: str, t: str, pos_weight: float = 1.0) -> DataFrame:
    """Mean pixel loss in the stable form."""
    soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))  # noqa: E731  log(1 + exp(x))
    each = F.zip_with(logits, t, lambda x, y: pos_weight * y * soft(-x) + (1 - y) * soft(x))
    return df.agg((F.sum(total(each)) / F.sum(F.size(logits))).alias("bce"))


def pixel_stats(df: DataFrame, px: str = "px") -> DataFrame:
    return df.select(F.explode(px).alias("v")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


#: Side of the blocks in which overlapping tiles are added.
BLOCK = 256


def stitch(tiles: DataFrame, key: str, size: DataFrame, block: int = BLOCK) -> DataFrame:
    """Overlapping tiles averaged back to images of the size in ``size`` (``key``, ``height``, ``width``).

    Tiles (``y0``, ``x0``, ``w``, ``px`` in rows) are cut at the borders of a grid of blocks, and what is shuffled are these pieces, as arrays.
    The pieces of a block are added in one task, and an image is put together from its blocks. Parts of tiles outside
    the image go; pixels without a tile are null.
    """
    h = F.floor(F.size("px") / F.col("w"))
    rows = tiles.join(size, key).withColumns({"bottom": F.least(F.col("y0") + h, F.col("height")), "right": F.least(F.col("x0") + F.col("w"), F.col("width"))})
    first, last = (lambda c: F.floor(F.greatest(F.col(c), F.lit(0)) / block)), (lambda c: F.floor((F.col(c) - 1) / block))
    rows = rows.where("bottom > 0 and right > 0 and y0 < bottom and x0 < right and y0 < height and x0 < width")
    cut = rows.withColumn("by", F.explode(F.sequence(first("y0"), last("bottom")))).withColumn("bx", F.explode(F.sequence(first("x0"), last("right"))))
    cut = cut.withColumns({"y1": F.greatest(F.col("by") * block, F.col("y0"), F.lit(0)), "x1": F.greatest(F.col("bx") * block, F.col("x0"), F.lit(0)), "x2": F.least((F.col("bx") + 1) * block, F.col("right"))})
    lines = F.sequence(F.col("y1"), F.least((F.col("by") + 1) * block, F.col("bottom")) - 1)
    piece = F.flatten(F.transform(lines, lambda y: F.slice("px", ((y - F.col("y0")) * F.col("w") + F.col("x1") - F.col("x0") + 1).cast("int"), (F.col("x2") - F.col("x1")).cast("int"))))
    place = lambda c, b: (F.col(c) - F.col(b) * block).cast("int")
    high, wide = (F.least(F.lit(block), F.col(n) - F.col(b) * block).cast("int") for n, b in (("height", "by"), ("width", "bx")))
    pieces = cut.select(key, "height", "width", "by", "bx", F.struct(place("y1", "by").alias("y"), place("x1", "bx").alias("x"), (F.col("x2") - F.col("x1")).cast("int").alias("w"), piece.alias("px")).alias("piece"))
    blocks = pieces.groupBy(key, "height", "width", "by", "bx").agg(F.collect_list("piece").alias("pieces"))  # as many as tiles overlap a block
    blocks = blocks.select(key, "height", "width", F.struct("by", "bx", kernels.overlap_mean()(F.col("pieces"), high, wide).alias("px")).alias("block"))
    whole = blocks.groupBy(key, "height", "width").agg(F.collect_list("block").alias("blocks"))
    return whole.select(key, kernels.join_blocks(block)(F.col("blocks"), F.col("height"), F.col("width")).alias("px"))


def batch_pad_size(df: DataFrame, batch: str, k: int = 8) -> DataFrame:
    up = lambda c: (F.ceil(F.max(c) / k) * k).cast("int")
    return df.groupBy(batch).agg(up("h").alias("pad_h"), up("w").alias("pad_w"))


def argmax_slice(masks: DataFrame, volume: str, idx: str, mask: str) -> DataFrame:
    """Of each volume the slice with most positive pixels, the first on ties; none if there are none."""
    n = masks.select("*", F.size(F.filter(mask, lambda v: v > 0)).alias("n_pos")).where("n_pos > 0")
    best = n.groupBy(volume).agg(F.max(F.struct(F.col("n_pos"), (-F.col(idx)).alias("back"))).alias("b"))
    best = best.select(volume, (-F.col("b.back")).alias(idx))
    return n.join(best, [volume, idx])


def overlay_examples(df: DataFrame, k: int, key: str, gt: str = "gt_px", pred: str = "pred_px") -> DataFrame:
    """First k images with any truth or prediction, topped up with empty ones."""
    empty = ~(has_foreground(F.col(gt)) | has_foreground(F.col(pred)))
    return df.withColumn("is_empty", empty).orderBy("is_empty", key).limit(k)
