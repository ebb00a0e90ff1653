"""Functions on arrays: pixels in row-major order with height and width, logits, tokens. Column to Column, all built in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


# numbers

def softmax(x: Column) -> Column:
    e = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return let(e, lambda y: let(total(y), lambda s: F.transform(y, lambda v: v / s)))


def log_softmax(x: Column) -> Column:
    def shifted(top: Column) -> Column:
        return let(F.ln(total(F.transform(x, lambda v: F.exp(v - top)))), lambda s: F.transform(x, lambda v: v - top - s))

    return let(F.array_max(x), shifted)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def argmax(x: Column) -> Column:
    """Position of the largest value, the first on ties."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def to_uint8(px: Column, lo: float = 0.5, hi: float = 99.5) -> Column:
    """Pixels stretched between two percentiles (linear, without NaN) to 0..255; a flat image is zero."""
    s = F.sort_array(F.filter(px, lambda v: ~F.isnan(v)))

    def level(sorted_px: Column, q: float) -> Column:
        at = (F.size(sorted_px) - 1) * q / 100.0
        low = F.get(sorted_px, F.floor(at).cast("int"))
        high = F.get(sorted_px, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    bounds = let(s, lambda x: F.struct(level(x, lo).alias("lo"), level(x, hi).alias("hi")))
    scaled = lambda v, b: F.floor(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - b["lo"]) / (b["hi"] - b["lo"]))) + 0.5).cast("int")
    return let(bounds, lambda b: F.transform(px, lambda v: F.when(b["hi"] > b["lo"], scaled(v, b)).otherwise(0)))


def labels_to_uint8(px: Column) -> Column:
    usable = lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    return F.transform(px, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(usable(v)))).cast("int"))


def zscore(px: Column, ddof: int = 0, eps: float = 1e-6) -> Column:
    def scaled(m: Column) -> Column:
        var = total(F.transform(px, lambda v: (v - m) * (v - m))) / (F.size(px) - ddof)
        return let(F.sqrt(var), lambda sd: F.transform(px, lambda v: (v - m) / (sd + eps)))

    return let(mean(px), scaled)


def minmax(px: Column, eps: float = 1e-7) -> Column:
    span = F.array_max(px) - F.array_min(px)
    bounds = F.struct(F.array_min(px).alias("lo"), (F.nullif(span, F.lit(0.0)) if eps == 0 else span + eps).alias("span"))
    return let(bounds, lambda b: F.transform(px, lambda v: (v - b["lo"]) / b["span"]))


def standardize(px: Column, means: tuple[float, ...], stds: tuple[float, ...]) -> Column:
    """Interleaved channels, each by its constants."""
    m, s, k = F.array(*map(F.lit, means)), F.array(*map(F.lit, stds)), len(means)
    return F.transform(px, lambda v, i: (v - F.get(m, i % k)) / F.get(s, i % k))


def resampled_size(n: Column, spacing: Column, target: float) -> Column:
    return F.greatest(F.lit(1), F.bround(n * spacing / target).cast("int"))


def overlap_px(tile: int, pct: float) -> int:
    if not 0 <= pct < 100:
        raise ValueError("overlap must be from 0 up to 100 per cent")
    return max(0, min(tile - 1, round(tile * pct / 100)))


def overlap_of(tile: Column, pct: Column) -> Column:
    """The same of columns; null where the percentage is out of range."""
    return F.when((pct >= 0) & (pct < 100), F.greatest(F.lit(0), F.least(tile - 1, F.bround(tile * pct / 100, 0).cast("int"))))


def sliding_positions(n: Column, tile: int, overlap: int) -> Column:
    """Starts of windows along an axis: strides, and a last one that reaches the end; one if the axis is short."""
    last = n - tile
    steps = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(tile - overlap))
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(steps, F.array(last))))


# images

def at(px: Column, h: Column, w: Column, y: Column, x: Column) -> Column:
    """Pixel, or 0 outside."""
    inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
    return F.when(inside, F.get(px, (y * w + x).cast("int"))).otherwise(F.lit(0.0))


def window(px: Column, h: Column, w: Column, y0: Column, x0: Column, wh: Column, ww: Column) -> Column:
    """A rectangle of an image; what lies outside is 0."""
    idx = F.sequence(F.lit(0), (wh * ww - 1).cast("int"))
    return let(px, lambda p: F.transform(idx, lambda i: at(p, h, w, y0 + F.floor(i / ww), x0 + i % ww)))


def pad_centred(px: Column, h: Column, w: Column, min_h: int, min_w: int) -> Column:
    """Zero-padded to the least size, the smaller half first."""
    ph, pw = F.greatest(h, F.lit(min_h)), F.greatest(w, F.lit(min_w))
    return window(px, h, w, -F.floor((ph - h) / 2), -F.floor((pw - w) / 2), ph, pw)


def tile_explode(df: DataFrame, tile: int = 224, overlap_pct: float = 25, threshold: int = 512) -> DataFrame:
    """Large images as row-major tiles (``tile_id``, ``y0``, ``x0``, ``h``, ``w``, ``px``); others as one tile of their own size.

    Images smaller than a tile along one axis are padded first.
    """
    over = overlap_px(tile, overlap_pct)
    large = F.greatest("h", "w") > threshold
    ph, pw = F.greatest("h", F.lit(tile)), F.greatest("w", F.lit(tile))
    padded = F.when(large, pad_centred(F.col("px"), F.col("h"), F.col("w"), tile, tile)).otherwise(F.col("px"))
    out = df.withColumns({"px": padded, "h": F.when(large, ph).otherwise(F.col("h")), "w": F.when(large, pw).otherwise(F.col("w")), "__large": large})
    ys = F.when(F.col("__large"), sliding_positions(F.col("h"), tile, over)).otherwise(F.array(F.lit(0)))
    xs = F.when(F.col("__large"), sliding_positions(F.col("w"), tile, over)).otherwise(F.array(F.lit(0)))
    grid = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("y0"), x.alias("x0")))))
    out = out.select("*", F.posexplode(grid).alias("tile_id", "__at"))
    th, tw = (F.when(F.col("__large"), F.lit(tile)).otherwise(F.col(c)) for c in ("h", "w"))
    cut = F.when(F.col("__large"), window(F.col("px"), F.col("h"), F.col("w"), F.col("__at.y0"), F.col("__at.x0"), th, tw)).otherwise(F.col("px"))
    rest = [c for c in df.columns if c not in ("px", "h", "w")]
    out = out.select(*rest, "tile_id", F.col("__at.y0").alias("y0"), F.col("__at.x0").alias("x0"), th.cast("int").alias("__th"), tw.cast("int").alias("__tw"), cut.alias("__cut"))
    return out.select(*rest, "tile_id", "y0", "x0", F.col("__th").alias("h"), F.col("__tw").alias("w"), F.col("__cut").alias("px"))


def resize_mask(mask: Column, h: Column, w: Column, size: int) -> Column:
    """Positive pixels moved to a square grid by truncation: row-major 0/1 array."""
    moved = F.transform(mask, lambda v, i: F.when(v > 0, F.least(F.floor(F.floor(i / w) * size / h), F.lit(size - 1)) * size + F.least(F.floor((i % w) * size / w), F.lit(size - 1))))
    targets = F.array_sort(F.array_distinct(F.array_compact(moved)))
    # runs of zeros, each ended by a one: time of the targets and the cells, not of their product
    zeros = lambda n: F.array_repeat(F.lit(0), n.cast("int"))
    run = lambda on: F.transform(on, lambda v, i: F.concat(zeros(v - F.coalesce(F.get(on, i - 1), F.lit(-1)) - 1), F.array(F.lit(1))))
    rest = lambda on: zeros(size * size - 1 - F.coalesce(F.array_max(on), F.lit(-1)))
    return let(targets, lambda on: F.when(on.isNotNull(), F.concat(F.flatten(run(on)), rest(on))))


def crop_mm(px: Column, mask: Column, h: Column, w: Column, spacing: Column, cm: float) -> Column:
    """A square of so many centimetres around the first positive pixel, or the centre; 0 outside the image."""
    side = F.bround(F.lit(cm * 10.0) / spacing).cast("int")
    first = F.array_position(F.transform(mask, lambda v: v > 0), True) - 1
    cy = F.when(first >= 0, F.floor(first / w)).otherwise(F.floor(h / 2))
    cx = F.when(first >= 0, first % w).otherwise(F.floor(w / 2))
    return window(px, h, w, cy - F.floor(side / 2), cx - F.floor(side / 2), side, side)


def mask_to_grid(mask: Column, size: int, patch: int) -> Column:
    """Greatest mask value of each patch, row-major."""
    n = size // patch
    inside = F.sequence(F.lit(0), F.lit(patch * patch - 1))
    cell = lambda m, c: F.array_max(F.transform(inside, lambda i: F.get(m, ((F.floor(c / n) * patch + F.floor(i / patch)) * size + (c % n) * patch + i % patch).cast("int"))))
    return let(mask, lambda m: F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda c: cell(m, c)))


def mean_pool(tokens: Column) -> Column:
    """Mean vector of an array of vectors."""
    dims = F.sequence(F.lit(0), F.size(F.get(tokens, F.lit(0))) - 1)
    return F.transform(dims, lambda d: total(F.transform(tokens, lambda t: F.get(t, d))) / F.size(tokens))


def masked_mean_pool(tokens: Column, weights: Column, empty: str = "mean") -> Column:
    """Weighted mean of the vectors; without any weight their plain mean, or zeros."""
    dims = F.sequence(F.lit(0), F.size(F.get(tokens, F.lit(0))) - 1)
    s = total(weights)
    pooled = F.transform(dims, lambda d: total(F.zip_with(tokens, weights, lambda t, q: F.get(t, d) * q)) / F.greatest(s, F.lit(1e-6)))
    return pooled if empty == "zero" else F.when(s > 0, pooled).otherwise(mean_pool(tokens))


def token_grid(tokens: Column, n_special: int = 0) -> Column:
    """Tokens without the special ones before them; raises unless they fill a square."""
    own = F.slice(tokens, n_special + 1, F.greatest(F.size(tokens) - n_special, F.lit(0)))
    side = F.sqrt(F.size(own).cast("double"))
    return F.when(side == F.floor(side), own).otherwise(F.raise_error(F.lit("tokens do not fill a square grid")))


def plane_slice(df: DataFrame) -> DataFrame:
    """Slices of volumes (``nx, ny, nz, dx, dy, dz, plane``; ``voxels`` in x, y, z order): axial over z, sagittal over x.

    An isotropic volume gives both, a coronal one none. Slices are transposed, so rows follow the second axis.
    """
    axial = F.when(F.col("plane").isin("axial", "isotropic"), F.transform(F.sequence(F.lit(0), F.col("nz") - 1), lambda k: F.struct(F.lit("axial").alias("p"), k.alias("k"))))
    sagittal = F.when(F.col("plane").isin("sagittal", "isotropic"), F.transform(F.sequence(F.lit(0), F.col("nx") - 1), lambda k: F.struct(F.lit("sagittal").alias("p"), k.alias("k"))))
    none = F.slice(F.array(F.struct(F.lit("").alias("p"), F.lit(0).alias("k"))), 1, 0)
    out = df.select("*", F.explode(F.concat(F.coalesce(axial, none), F.coalesce(sagittal, none))).alias("__s"))
    ax = F.col("__s.p") == "axial"
    h, w = F.when(ax, F.col("ny")).otherwise(F.col("nz")), F.when(ax, F.col("nx")).otherwise(F.col("ny"))
    out = out.withColumns({"slice_plane": F.col("__s.p"), "slice_idx": F.col("__s.k"), "h": h, "w": w, "sp_h": F.when(ax, F.col("dy")).otherwise(F.col("dz")), "sp_w": F.when(ax, F.col("dx")).otherwise(F.col("dy"))})
    if "voxels" in df.columns:
        x, y = lambda i: i % F.col("w"), lambda i: F.floor(i / F.col("w"))
        voxel = lambda i: F.when(F.col("slice_plane") == "axial", (x(i) * F.col("ny") + y(i)) * F.col("nz") + F.col("slice_idx")).otherwise((F.col("slice_idx") * F.col("ny") + x(i)) * F.col("nz") + y(i))
        out = out.withColumn("px", F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda i: F.get("voxels", voxel(i).cast("int")))).drop("voxels")
    return out.drop("__s")


def binarise(px: Column, threshold: float = 0.0) -> Column:
    return F.transform(px, lambda v: (v > threshold).cast("int"))


def boundary(mask: Column, h: Column, w: Column) -> Column:
    """Positive pixels with a neighbour above, below, left or right that isn't, the outside included."""

    def edge(m: Column, v: Column, i: Column) -> Column:
        y, x = F.floor(i / w), i % w
        near = [at(m, h, w, y + a, x + b) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]
        return ((v > 0) & (F.least(*near) <= 0)).cast("int")

    return let(mask, lambda m: F.transform(m, lambda v, i: edge(m, v, i)))


def overlay_code(gt: Column, pred: Column) -> Column:
    """0 neither, 1 truth only, 2 prediction only, 3 both."""
    return F.zip_with(gt, pred, lambda a, b: (a > 0).cast("int") + 2 * (b > 0).cast("int"))


def top_left_crop(px: Column, h: Column, w: Column, size: int) -> Column:
    """Padded, then the first rows and columns; byte images are brought to 0..1."""
    ph, pw = F.greatest(h, F.lit(size)), F.greatest(w, F.lit(size))
    cut = let(pad_centred(px, h, w, size, size), lambda p: window(p, ph, pw, F.lit(0), F.lit(0), F.lit(size), F.lit(size)))
    return F.when(F.array_max(px) > 1, F.transform(cut, lambda v: v / 255.0)).otherwise(cut)


def inplane_spacing(dx: Column, dy: Column, dz: Column, axis: Column) -> Column:
    return F.when(axis == 0, (dy + dz) / 2).otherwise((dx + dy) / 2)


def has_foreground(mask: Column) -> Column:
    return F.coalesce(F.exists(mask, lambda v: v > 0), F.lit(False))


def resize_image(df: DataFrame, target_h: int, target_w: int, interp: str = "bilinear") -> DataFrame:
    """Images at another size; ``nearest`` or ``bilinear``, pixel centres aligned."""
    def pick(i: Column) -> Column:
        ty, tx = F.floor(i / target_w), i % target_w
        sy, sx = (ty + 0.5) * F.col("h") / target_h - 0.5, (tx + 0.5) * F.col("w") / target_w - 0.5
        edge = lambda v, n: F.greatest(F.lit(0), F.least(n - 1, v))
        get = lambda y, x: F.get("px", (edge(y, F.col("h")) * F.col("w") + edge(x, F.col("w"))).cast("int"))
        if interp == "nearest":
            return get(F.floor(sy + 0.5), F.floor(sx + 0.5))
        y0, x0 = F.floor(sy), F.floor(sx)
        a, b = sy - y0, sx - x0
        return (1 - a) * ((1 - b) * get(y0, x0) + b * get(y0, x0 + 1)) + a * ((1 - b) * get(y0 + 1, x0) + b * get(y0 + 1, x0 + 1))

    px = F.transform(F.sequence(F.lit(0), F.lit(target_h * target_w - 1)), pick)
    return df.withColumn("px", px).withColumns({"h": F.lit(target_h), "w": F.lit(target_w)})
