"""Seeded splits, samples and manifests. All draws are orders by MD5 of seed and key, equal on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slicework.functions.names import half_even, hash_uniform


def draw(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws("/", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def numbered(df: DataFrame, digest: Column, tie: str, by: tuple[str, ...] = (), out: str = "__i", digits: int = 4) -> DataFrame:
    """``df`` with positions from 0 in the order of a hexadecimal digest, then of ``tie``, in each group of ``by``.

    The digest's first digits are buckets in that order; rows are ranked inside a bucket, and the counts of the
    buckets before, 16 ** digits of them at most in a group, are added. So no task holds a whole group.
    """
    dealt = df.withColumn("__d", digest).withColumn("__b", F.substring("__d", 1, digits))
    keys = [*by, "__b"]
    sizes = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(*keys, F.coalesce(before, F.lit(0)).alias("__before"))
    inside = dealt.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("__d", tie)))
    on = [inside[k].eqNullSafe(offsets[k]) for k in keys]
    kept = [inside[c] for c in df.columns]
    return inside.join(offsets, on).select(*kept, (F.col("__before") + F.col("__r") - 1).alias(out))


def numbered_by_key(df: DataFrame, key: str, out: str = "__i", cuts: int = 255) -> DataFrame:
    """``df`` with positions from 0 in the order of its distinct keys, by buckets between cuts that a random choice of
    so many keys gives; any cuts are right, and these are even."""
    chosen = sorted(r[0] for r in df.where(F.col(key).isNotNull()).orderBy(draw("cut", F.col(key)), key).limit(cuts).select(key).collect())
    kind = df.schema[key].dataType
    bucket = F.size(F.filter(F.array(*[F.lit(x).cast(kind) for x in chosen]), lambda x: x <= F.col(key))) if chosen else F.lit(0)
    return numbered(df, F.format_string("%04x", F.greatest(bucket, F.lit(0))), key, out=out)


def label_encode(df: DataFrame, column: str, out: str = "target") -> DataFrame:
    """Position of each class among the sorted distinct ones."""
    classes = df.select(column).distinct().withColumn(out, F.dense_rank().over(W.orderBy(column)) - 1)
    return df.join(F.broadcast(classes), column)  # one row for each class


def stratified_split(df: DataFrame, label: str, key: str, val: float = 0.15, seed: int = 42) -> DataFrame:
    """The exact share of each class, rounded half to even, goes to ``val``."""
    quota = df.groupBy(F.col(label).alias("__label")).agg(half_even(F.count(F.lit(1)) * val).alias("__quota"))
    ranked = numbered(df, draw(seed, F.col(key)), key, by=(label,))
    side = F.when(F.col("__i") < F.col("__quota"), "val").otherwise("train")
    return ranked.join(F.broadcast(quota), F.col(label).eqNullSafe(F.col("__label"))).withColumn("side", side).drop("__i", "__label", "__quota")  # one row for each class


def shuffled_split(ids: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Of distinct ids the share goes to ``val``, one at least."""
    n = ids.select(key).distinct()
    cut = n.groupBy().agg(F.greatest(F.lit(1), half_even(F.count(F.lit(1)) * share).cast("int")).alias("n_val"))
    return numbered(n, draw(seed, F.col(key)), key).join(F.broadcast(cut), F.lit(True)).select(key, F.when(F.col("__i") < F.col("n_val"), "val").otherwise("train").alias("side"))


def centred_block(df: DataFrame, subject: str, order: str, size: int) -> DataFrame:
    """Of each subject's rows in order, a block around the middle; all if there are fewer."""
    df = df.withColumn("__i", F.row_number().over(W.partitionBy(subject).orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(subject)))
    start = F.greatest(F.lit(0), F.least(F.floor(F.col("__n") / 2) - size // 2, F.col("__n") - size))
    return df.where((F.col("__i") >= start) & (F.col("__i") < start + size)).drop("__i", "__n")


def epoch_manifest(df: DataFrame, key: str, size: int, epoch: int, seed: int, world: int, shuffle: bool = True) -> DataFrame:
    """``position``, ``rank`` and sample of one epoch: ids tiled to the size, then dealt to ranks in strides."""
    ids = df.select(key).distinct()
    n = ids.count()
    copies = F.explode(F.sequence(F.lit(0), F.lit(-(-size // max(n, 1)) - 1)))
    if shuffle:
        placed = numbered(ids.withColumn("copy", copies), draw(seed, epoch, F.col(key), F.col("copy")), key, by=("copy",))
    else:
        placed = numbered_by_key(ids, key).withColumn("copy", copies)
    position = (F.col("copy").cast("long") * n + F.col("__i")).alias("position")
    return placed.select(key, position).where(F.col("position") < size).select(F.lit(epoch).alias("epoch"), "position", (F.col("position") % world).alias("rank"), key)


def endless_manifest(df: DataFrame, key: str, epochs: int, advance: int, seed: int, world: int) -> DataFrame:
    """Fresh permutations one after another, dealt in strides, the first ``advance`` items of each rank left out."""
    n = df.select(key).distinct()
    every = n.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    inside = numbered(every, draw(seed, F.col("epoch"), F.col(key)), key, by=("epoch",))
    sizes = n.agg(F.count(F.lit(1)).alias("__n"))
    out = inside.join(F.broadcast(sizes), F.lit(True)).select("epoch", (F.col("epoch") * F.col("__n") + F.col("__i")).alias("position"), key)
    return out.withColumn("rank", F.col("position") % world).withColumn("turn", F.floor(F.col("position") / world)).where(F.col("turn") >= advance)


def sharded_manifest(df: DataFrame, key: str, passes: int, seed: int, world: int) -> DataFrame:
    """One permutation dealt to ranks evenly (leftover rows go); each rank shuffles its own share anew in each pass."""
    n = df.select(key).distinct()
    full = n.agg((F.floor(F.count(F.lit(1)) / world) * world).alias("__full"))
    own = numbered(n, draw(seed, F.col(key)), key).join(F.broadcast(full), F.lit(True)).where("__i < __full").select(key, (F.col("__i") % world).alias("rank"))
    own = own.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    return numbered(own, draw(seed, F.col("pass"), F.col("rank"), F.col(key)), key, by=("pass", "rank"), out="turn").select("pass", "rank", "turn", key)


def sample_cap(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A random subset of at most ``n`` rows."""
    return df.orderBy(draw(seed, F.col(key)), key).limit(n)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 0, rows_per_bucket: int = 256) -> DataFrame:
    """``n`` draws with replacement in proportion to weight: ``draw_id`` and the key.

    Rows stand in 4096 wide buckets, each of them in as many narrow ones as the number of rows asks for. A draw finds
    its wide bucket by a table of 4096 rows, then its narrow one, then its row, so no task sees all rows and no draw
    is held against more than some hundreds of them. Ends are those of the row or bucket before, so every draw has
    exactly one.
    """
    weighed = df.select(key, F.col(weight).cast("double").alias("wt")).where("wt > 0")
    narrow = max(1, -(-weighed.count() // (4096 * rows_per_bucket)))
    digest = F.md5(F.col(key).cast("string"))
    number = lambda a, k: F.conv(F.substring(digest, a, k), 16, 10).cast("int")
    rows = weighed.withColumn("wide", number(1, 3)).withColumn("narrow", number(4, 6) % narrow)

    def ends(sums: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
        """Running sums ``hi`` in each group, the ``lo`` before, none above the last one."""
        w = W.partitionBy(*by).orderBy(order)
        hi = F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0))
        out = sums.withColumn(f"{name}_hi", hi).withColumn(f"{name}_lo", F.coalesce(F.lag(f"{name}_hi").over(w), F.lit(0.0)))
        last = F.lead(f"{name}_lo").over(w).isNull()
        return out.withColumn(f"{name}_end", F.when(last, F.lit(float("inf"))).otherwise(F.col(f"{name}_hi")))

    sums = rows.groupBy("wide", "narrow").agg(F.sum("wt").alias("t"))
    inner = ends(sums, ["wide"], "narrow", "t", "n")
    outer = ends(sums.groupBy("wide").agg(F.sum("t").alias("t")), [], "wide", "t", "w")  # 4096 rows at most
    outer = outer.withColumn("all", F.max("w_hi").over(W.partitionBy()))
    placed = ends(rows, ["wide", "narrow"], key, "wt", "r")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw_id"), hash_uniform(F.concat_ws("/", F.lit(str(seed)), "id")).alias("u"))
    inside = lambda at, name: (at >= F.col(f"{name}_lo")) & (at < F.col(f"{name}_end"))
    one = draws.join(F.broadcast(outer), inside(F.col("u") * F.col("all"), "w")).select("draw_id", "wide", (F.col("u") * F.col("all") - F.col("w_lo")).alias("at"))
    two = one.join(inner, "wide").where(inside(F.col("at"), "n")).select("draw_id", "wide", "narrow", (F.col("at") - F.col("n_lo")).alias("at"))
    return two.join(placed, ["wide", "narrow"]).where(inside(F.col("at"), "r")).select("draw_id", key)
