"""Decoders of volume files, array bundles and images. A file that can't be decoded is a row with an error."""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Data types of the volume format by code (fixed values).
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
VOLUME = "path string, nx int, ny int, nz int, dx double, dy double, dz double, voxels array<float>, error string"


def _canonical(data: np.ndarray, zooms: list[float], affine: np.ndarray | None) -> tuple[np.ndarray, list[float]]:
    """Axes in x, y, z order, each running upwards."""
    if affine is None or not np.isfinite(affine).all() or not affine.any():
        return data, zooms
    order, taken = [], set()
    for row in range(3):
        best = max((k for k in range(3) if k not in taken), key=lambda k: abs(affine[row, k]))
        order.append(best)
        taken.add(best)
    data = np.transpose(data, order)
    for row, k in enumerate(order):
        if affine[row, k] < 0:
            data = np.flip(data, row)
    return data, [zooms[k] for k in order]


def decode_volume(content: bytes, header_only: bool = False, label: bool = False) -> dict:
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    end = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dims = struct.unpack(end + "8h", raw[40:56])
    code = struct.unpack(end + "h", raw[70:72])[0]
    if code not in DTYPES:
        raise ValueError(f"data type {code} has no single value for each voxel")
    shape = [max(1, d) for d in dims[1 : 1 + max(3, dims[0])]]
    zooms = [abs(float(z)) for z in struct.unpack(end + "3f", raw[80:92])]
    offset = int(struct.unpack(end + "f", raw[108:112])[0])
    has_affine = struct.unpack(end + "h", raw[254:256])[0] > 0
    affine = np.array(struct.unpack(end + "12f", raw[280:328])).reshape(3, 4)[:, :3] if has_affine else None
    if header_only:
        _, zooms = _canonical(np.zeros((1, 1, 1)), zooms, affine)
        dims3 = _canonical(np.empty(shape[:3], "u1"), zooms, affine)[0].shape
        return {"nx": dims3[0], "ny": dims3[1], "nz": dims3[2], "dx": zooms[0], "dy": zooms[1], "dz": zooms[2], "voxels": None}
    data = np.frombuffer(raw, end + DTYPES[code], count=int(np.prod(shape)), offset=offset).reshape(shape, order="F").astype("f4")
    slope, inter = struct.unpack(end + "2f", raw[112:120])
    if slope and np.isfinite(slope):
        data = data * slope + inter
    while data.ndim > 3:
        data = data[..., 0] if label else data.mean(axis=-1)
    data, zooms = _canonical(data, zooms, affine)
    return {"nx": data.shape[0], "ny": data.shape[1], "nz": data.shape[2], "dx": zooms[0], "dy": zooms[1], "dz": zooms[2], "voxels": data.ravel()}


#: Numbers that a batch of decoded files gathers: a batch for each small file would cost more than its decoding, and one
#: for many large files might not fit.
GATHERED = 1 << 18


def _arrays(values: list[np.ndarray | None], kind: str = "f4") -> pa.Array:
    """A column of arrays of numbers, some of them null, without an object for each number."""
    size = np.array([0 if v is None else v.size for v in values], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    flat = np.concatenate([np.zeros(0, kind), *(v.ravel().astype(kind) for v in values if v is not None)])
    return pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([v is None for v in values], pa.bool_()))


def _gathered(rows: Iterator[dict], weight: Callable[[dict], int]) -> Iterator[list[dict]]:
    """Rows in lists of some ``GATHERED`` numbers, or of one row if it has more."""
    own, held = [], 0
    for row in rows:
        own.append(row)
        held += 16 + weight(row)
        if held >= GATHERED:
            yield own
            own, held = [], 0
    if own:
        yield own


def _size(v: np.ndarray | None) -> int:
    return 0 if v is None else v.size


def decode_volumes(files: DataFrame, header_only: bool = False, label: bool = False) -> DataFrame:
    """Of ``path``, ``content``: dimensions, spacing and voxels in x, y, z order; one row a file, with its error if it has one."""

    def decoded(b: pa.RecordBatch) -> Iterator[dict]:
        for i in range(b.num_rows):
            try:
                row = {"error": None} | decode_volume(b.column(1)[i].as_py(), header_only, label)
            except Exception as e:  # noqa: BLE001  the error is the row's result
                row = {"error": str(e)[:200] or type(e).__name__}
            yield row | {"path": b.column(0)[i].as_py()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in _gathered(decoded(b), lambda r: _size(r.get("voxels"))):
                numbers = [pa.array([r.get(k) for r in own], pa.int32() if k[0] == "n" else pa.float64()) for k in ("nx", "ny", "nz", "dx", "dy", "dz")]
                text = [pa.array([r[k] for r in own], pa.string()) for k in ("path", "error")]
                yield pa.RecordBatch.from_arrays([text[0], *numbers, _arrays([r.get("voxels") for r in own]), text[1]], ["path", "nx", "ny", "nz", "dx", "dy", "dz", "voxels", "error"])

    return files.select("path", "content").mapInArrow(run, VOLUME)


def read_volumes(spark: SparkSession, root: str, header_only: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.nii.gz").option("recursiveFileLookup", "true").load(root)
    return decode_volumes(files, header_only)


def decode_array_bundles(files: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``path``, ``content``: each named array with its shape, null where the bundle lacks it; one row a file, with its error if it has one."""

    def decoded(b: pa.RecordBatch) -> Iterator[dict]:
        for i in range(b.num_rows):
            found, error = {}, None
            try:
                with np.load(io.BytesIO(b.column(1)[i].as_py()), allow_pickle=False) as z:
                    found = {k: z[k] for k in keys if k in z.files}
            except Exception as e:  # noqa: BLE001
                error = str(e)[:200] or type(e).__name__
            yield {"path": b.column(0)[i].as_py(), "error": error, "found": found}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in _gathered(decoded(b), lambda r: sum(map(_size, r["found"].values()))):
                text = [pa.array([r[k] for r in own], pa.string()) for k in ("path", "error")]
                shapes = [pa.array([list(r["found"][k].shape) if k in r["found"] else None for r in own], pa.list_(pa.int32())) for k in keys]
                yield pa.RecordBatch.from_arrays([*text, *(_arrays([r["found"].get(k) for r in own]) for k in keys), *shapes], ["path", "error", *keys, *(f"{k}_shape" for k in keys)])

    schema = ", ".join(["path string", "error string", *(f"`{k}` array<float>" for k in keys), *(f"`{k}_shape` array<int>" for k in keys)])
    return files.select("path", "content").mapInArrow(run, schema)


def read_array_bundles(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    return decode_array_bundles(spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(root), keys)


def one_channel(images: DataFrame) -> DataFrame:
    """Of Spark's image columns ``origin``, ``height``, ``width``, ``nChannels``, ``data``: ``path``, ``h``, ``w``, ``px``
    (one channel, row-major; colour by its mean) and ``error``; one row an image."""

    def decoded(b: pa.RecordBatch) -> Iterator[dict]:
        for i in range(b.num_rows):
            h, w, k = (b.column(c)[i].as_py() for c in (1, 2, 3))
            data = np.frombuffer(b.column(4)[i].as_py() or b"", np.uint8)
            ok = bool(h and w and k) and min(h, w, k) > 0 and data.size == h * w * k
            px = np.rint(data.reshape(-1, k).mean(axis=1)).astype(np.int32) if ok else None
            yield {"path": b.column(0)[i].as_py(), "h": h if ok else None, "w": w if ok else None, "px": px, "error": None if ok else "not an image"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in _gathered(decoded(b), lambda r: _size(r["px"])):
                column = lambda k, kind: pa.array([r[k] for r in own], kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([column("path", pa.string()), column("h", pa.int32()), column("w", pa.int32()), _arrays([r["px"] for r in own], "i4"), column("error", pa.string())], ["path", "h", "w", "px", "error"])

    return images.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "path string, h int, w int, px array<int>, error string")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Images below a folder; files that can't be decoded are rows with an error."""
    found = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root)
    return one_channel(found.select("image.*"))
