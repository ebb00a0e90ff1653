"""Vector kernels that need arrays in Python: Arrow-batched functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _linear(mask: np.ndarray, size: int) -> np.ndarray:
    """Linear resize, pixel centres aligned; more than a half is on, or more than half the maximum if nothing is."""
    h, w = mask.shape
    along = lambda n: np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    y, x = along(h), along(w)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    a, b = (y - y0)[:, None], (x - x0)[None, :]
    out = (1 - a) * ((1 - b) * mask[np.ix_(y0, x0)] + b * mask[np.ix_(y0, x1)]) + a * ((1 - b) * mask[np.ix_(y1, x0)] + b * mask[np.ix_(y1, x1)])
    on = out > 0.5
    return on if on.any() or not out.max() else out > out.max() / 2


def resize_mask_linear(size: int):
    @F.pandas_udf("array<int>")
    def run(mask: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([_linear(np.asarray(m, float).reshape(a, b), size).astype(int).ravel().tolist() for m, a, b in zip(mask, h, w, strict=True)])

    return run


def filter_weights(n: int, size: int, kind: str) -> np.ndarray:
    """Weights (``size`` by ``n``) of a separable filter that widens when it shrinks an image; each row's sum is 1."""
    support = {"bilinear": 1.0, "bicubic": 2.0, "lanczos": 3.0}[kind]
    scale = n / size
    wide = max(scale, 1.0)
    centre = (np.arange(size)[:, None] + 0.5) * scale
    first = np.maximum(0, np.floor(centre - support * wide + 0.5))
    last = np.minimum(n, np.floor(centre + support * wide + 0.5))
    at = np.arange(n)[None, :]
    x = np.abs((at + 0.5 - centre) / wide)
    if kind == "bilinear":
        w = np.maximum(0, 1 - x)
    elif kind == "bicubic":  # the cubic through -0.5
        w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
    else:
        w = np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0)
    w = np.where((at >= first) & (at < last), w, 0)
    return w / w.sum(axis=1, keepdims=True)


def resize_filtered(target_h: int, target_w: int, kind: str = "lanczos"):
    """Images at another size by a filter: ``bilinear``, ``bicubic`` or ``lanczos``."""

    @F.pandas_udf("array<double>")
    def run(px: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        weights: dict[tuple[int, int], np.ndarray] = {}

        def get(n: int, size: int) -> np.ndarray:
            if (n, size) not in weights:
                weights[n, size] = filter_weights(n, size, kind)
            return weights[n, size]

        return pd.Series([(get(a, target_h) @ np.asarray(p, float).reshape(a, b) @ get(b, target_w).T).ravel() for p, a, b in zip(px, h, w, strict=True)])

    return run


def _edge(mask: np.ndarray) -> np.ndarray:
    """Pixels that are on and have a neighbour, of four, that isn't or is outside."""
    on = np.pad(mask > 0, 1)
    return on[1:-1, 1:-1] & ~(on[:-2, 1:-1] & on[2:, 1:-1] & on[1:-1, :-2] & on[1:-1, 2:])


def nearest_rows(other: np.ndarray) -> np.ndarray:
    """Of each pixel the row of the nearest pixel of its column that is on, the upper one of two; -1 in empty columns."""
    h = len(other)
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(other, rows, -4 * h), axis=0)
    below = np.minimum.accumulate(np.where(other, rows, 4 * h)[::-1], axis=0)[::-1]
    near = np.where(rows - above <= below - rows, above, below)
    return np.where(other.any(axis=0)[None, :], near, -1)


def lower_envelope(height: list[int | None], at: list[int]) -> list[int]:
    """Of places ``at``, in order, the column whose parabola (x - column)^2 + height is lowest there; columns of no height have none."""
    columns: list[int] = []
    begins: list[float] = []
    for q, f in enumerate(height):
        if f is None:
            continue
        begin = -math.inf
        while columns:
            p = columns[-1]
            begin = ((f + q * q) - (height[p] + p * p)) / (2 * (q - p))
            if begin > begins[-1]:
                break
            columns.pop()
            begins.pop()
            begin = -math.inf
        columns.append(q)
        begins.append(begin)
    out, k = [], 0
    for x in at:
        while k + 1 < len(columns) and begins[k + 1] < x:
            k += 1
        out.append(columns[k])
    return out


def feature_transform(edge: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edge pixels (y, x) and the nearest pixel of the other mask of each: first along columns, then by each row's lower envelope.

    Time of the image, whatever the numbers of pixels on either side; ``other`` has a pixel.
    """
    near = nearest_rows(other)
    y, x = np.nonzero(edge)
    column = np.empty(len(y), np.int64)
    for row in np.unique(y):
        own = y == row
        height = [None if n < 0 else (n - int(row)) ** 2 for n in near[row].tolist()]
        column[own] = lower_envelope(height, x[own].tolist())
    return y, x, near[y, column], column


def _to_nearest(edge: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Distance of each edge pixel to the nearest one of the other mask."""
    y, x, ny, nx = feature_transform(edge, other)
    return np.sqrt((y - ny) ** 2.0 + (x - nx) ** 2.0)


def nearest_points():
    """Of two masks: each edge pixel of the first with the nearest edge pixel of the second and its distance; none if either is empty."""

    @F.pandas_udf("array<struct<y:int,x:int,near_y:int,near_x:int,d:double>>")
    def run(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for m, o, r, c in zip(a, b, h, w, strict=True):
            edge, other = (_edge(np.asarray(v).reshape(r, c)) for v in (m, o))
            if not other.any():
                out.append([])
                continue
            y, x, ny, nx = feature_transform(edge, other)
            d = np.sqrt((y - ny) ** 2.0 + (x - nx) ** 2.0)
            out.append([dict(zip(("y", "x", "near_y", "near_x", "d"), p)) for p in zip(y.tolist(), x.tolist(), ny.tolist(), nx.tolist(), d.tolist())])
        return pd.Series(out)

    return run


def _hd95(gt: np.ndarray, pred: np.ndarray) -> float | None:
    a, b = _edge(gt), _edge(pred)
    if not a.any() and not b.any():
        return 0.0
    if not a.any() or not b.any():
        return None
    return float(np.percentile(np.concatenate([_to_nearest(a, b), _to_nearest(b, a)]), 95))


def hausdorff95():
    """95th percentile of the boundary distances of two masks both ways; 0 if both are empty, null if one is."""

    @F.pandas_udf("double")
    def run(gt: pd.Series, pred: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([_hd95(np.asarray(g).reshape(a, b), np.asarray(p).reshape(a, b)) for g, p, a, b in zip(gt, pred, h, w, strict=True)], dtype="float64")

    return run


_SIGN = np.int64(2**63 - 1)


def ordered_bits():
    """A double as a whole number of the same order; both zeros are one, and NaN is above all."""

    @F.pandas_udf("long")
    def run(v: pd.Series) -> pd.Series:
        bits = np.where(np.isnan(v), np.nan, v.to_numpy(float) + 0.0).view(np.int64)
        return pd.Series(np.where(bits < 0, bits ^ _SIGN, bits))

    return run


def from_ordered_bits():
    """The double of such a number; null for NaN."""

    @F.pandas_udf("double")
    def run(b: pd.Series) -> pd.Series:
        bits = b.to_numpy(np.int64)
        return pd.Series(np.where(bits < 0, bits ^ _SIGN, bits).view(np.float64))

    return run


def overlap_mean():
    """The mean of pieces that lie over one another in a block, in rows; null where none lies."""

    @F.pandas_udf("array<double>")
    def run(pieces: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for of, high, wide in zip(pieces, h, w, strict=True):
            total, n = np.zeros((high, wide)), np.zeros((high, wide))
            for p in sorted(of, key=lambda p: (p["y"], p["x"])):  # one order, so that sums are the same in each run
                px = np.asarray(p["px"], float).reshape(-1, p["w"])
                at = np.s_[p["y"] : p["y"] + len(px), p["x"] : p["x"] + p["w"]]
                total[at] += px
                n[at] += 1
            out.append(np.where(n > 0, total / np.maximum(n, 1), np.nan).ravel())
        return pd.Series(out)

    return run


def join_blocks(side: int):
    """The image, in rows, of blocks ``by``, ``bx``, ``px`` of a grid; null where there is none."""

    @F.pandas_udf("array<double>")
    def run(blocks: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for of, high, wide in zip(blocks, h, w, strict=True):
            whole = np.full((high, wide), np.nan)
            for b in of:
                y, x = b["by"] * side, b["bx"] * side
                part = whole[y : y + side, x : x + side]
                part[:] = np.asarray(b["px"], float).reshape(part.shape)
            out.append([None if v != v else v for v in whole.ravel().tolist()])
        return pd.Series(out)

    return run
