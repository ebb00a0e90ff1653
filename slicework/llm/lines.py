"""Fuzzy line deduplication by MinHash.

Lines of five words or of 20 characters or more are compared by the sets of their character shingles. Signatures
are cut into bands; lines that share a band are candidates, exact Jaccard similarity decides, and union-find joins
the links. Of each component one line stays, its first by document id and line number; all others go. Shorter lines
stay, or go if they repeat exactly (``short_lines``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicework.llm.graph import connected_components
from slicework.llm.shared import materialize

#: A line with either takes part; scripts without blanks between words have only the second.
LEAST_WORDS, LEAST_CHARACTERS = 5, 20
#: Characters of a shingle, a power of two.
SHINGLE = 8
SIMILARITY = 0.8
#: Bands of rows: a pair at the similarity shares a band with probability 0.99.
BANDS, ROWS = 9, 4
HASHES = BANDS * ROWS
#: Characters that are hashed together: few enough for the processor's cache. And those of the lines of one batch of results.
CHUNK, BATCH = 30_000, 600_000
#: 64-bit parts of a sketch.
PARTS = 16
#: Bits of the filter that spares lines without a candidate the way to the join; of fixed size, and exact work follows.
FILTER_BITS = 1 << 26

#: Columns of a sketch.
SKETCH = ["size", *(str(k) for k in range(PARTS))]

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors, one for each hash function.
_FACTORS = np.random.default_rng(11).integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    x *= _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x


def normalized(line: str) -> str:
    return " ".join(line.lower().split())


def line_id(norm: str) -> int:
    """64-bit digest of a normalised line, signed."""
    return xxhash.xxh64_intdigest(norm.encode("utf-8", "surrogatepass")) - (1 << 63)


def takes_part(norm: str) -> bool:
    return len(norm) >= LEAST_CHARACTERS or norm.count(" ") >= LEAST_WORDS - 1


def eligible_lines(text: str | None) -> Iterator[tuple[int, str]]:
    """Line numbers and normalised lines that take part."""
    for i, line in enumerate((text or "").split("\n")):
        norm = normalized(line)
        if takes_part(norm):
            yield i, norm


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash at each shingle of the lines, where each line's begin, and how many it has (1 at least)."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    stream = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h, step, base = stream, 1, 0x100000001B3
    while step < SHINGLE:  # of each 2, 4, 8 characters
        far, h = h[step:], h[:-step] * np.uint64(base)
        h += far
        step, base = 2 * step, base * base % (1 << 64)
    size = np.array([len(x) for x in padded])
    n = size - SHINGLE + 1
    at = np.arange(n.sum()) + np.repeat(np.arange(len(n)) * (SHINGLE - 1), n)
    return _mixed(h[at], 1), np.cumsum(n) - n, n


def _chunks(lines: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for x in lines:
        part.append(x)
        size += len(x)
        if size > CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def band_keys(lines: list[str]) -> np.ndarray:
    """The band keys of each line, one row a line."""
    return np.concatenate([np.zeros((0, BANDS), np.int64), *map(_band_keys, _chunks(lines))])


def _band_keys(lines: list[str]) -> np.ndarray:
    """A hash function multiplies the upper halves of the shingles' hashes by an odd factor of its own."""
    h, begin, _ = shingle_hashes(lines)
    short = (h >> np.uint64(32)).astype(np.uint32)
    product = np.empty_like(short)
    least = np.empty((HASHES, len(lines)), np.uint32)
    for k, factor in enumerate(_FACTORS):
        np.multiply(short, factor, out=product)
        np.minimum.reduceat(product, begin, out=least[k])
    least = least.reshape(BANDS, ROWS, -1)
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
    for k in range(ROWS):
        keys = _mixed(keys ^ least[:, k], 3 + k)
    return np.ascontiguousarray(keys.T).view(np.int64)


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The different shingles of each line as sorted 64-bit hashes, which tell all shingles apart for practical purposes."""
    sets = []
    for part in _chunks(lines):
        h, begin, n = shingle_hashes(part)
        for b, k in zip(begin.tolist(), n.tolist(), strict=True):
            own = np.sort(h[b : b + k])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
    return sets


def similar(a: list[str], b: list[str]) -> np.ndarray:
    """Which pairs of lines have the similarity."""
    distinct = list(dict.fromkeys([*a, *b]))
    place, sets = {x: i for i, x in enumerate(distinct)}, shingle_sets(distinct)
    out = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        p, q = sets[place[x]], sets[place[y]]
        if len(p) > len(q):
            p, q = q, p
        if len(p) >= SIMILARITY * len(q):
            both = np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p)
            out[i] = both >= SIMILARITY * (len(p) + len(q) - both)
    return out


def sketches(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the shingle sets, and 64 * PARTS bits: of the shingles that fall on a bit, whether the number is odd."""
    width = 64 * PARTS
    sets = shingle_sets(lines)
    size = np.array([len(s) for s in sets], np.int64)
    bit = (_mixed(np.concatenate(sets), 5) >> np.uint64(32)).astype(np.int64) % width
    odd = (np.bincount(np.repeat(np.arange(len(sets)), size) * width + bit, minlength=len(sets) * width) & 1).astype(np.uint8)
    return size.astype(np.int32), np.packbits(odd.reshape(len(sets), width), axis=1, bitorder="little").view("<i8")


def _plausible(a: str, b: str):
    """Whether two lines' sets can have the similarity; it refuses no pair that has.

    The smaller set has at least that share of the larger. Each shingle that only one set has changes one bit, so
    no more bits differ than shingles, and of those there are at most (1 - s) / (1 + s) of both sizes' sum.
    """
    differ = F.lit(0)
    for k in range(PARTS):
        differ = differ + F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}")))
    x, y = F.col(f"{a}size"), F.col(f"{b}size")
    slack = 1e-6
    return (F.least(x, y) >= SIMILARITY * F.greatest(x, y) - slack) & (differ <= (1 - SIMILARITY) / (1 + SIMILARITY) * (x + y) + slack)


def _occurrences(docs: DataFrame, short_lines: bool) -> DataFrame:
    """``line`` (id) at each place (``doc_id``, ``digest`` of the text, ``number``), with the line's band ``keys``.

    Of the places of a line in one task only the first has the keys, and those of short lines have none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # starts anew when large
        for b in batches:
            rows, numbers, ids, fresh, lines, size = [], [], [], [], [], 0

            def settle(b=b) -> pa.RecordBatch:
                keys = band_keys(lines).ravel()
                cuts = np.concatenate([[0], np.cumsum(np.array(fresh, np.int32) * BANDS)]).astype(np.int32)
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b.column(0).take(at), b.column(1).take(at), pa.array(numbers, pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys))], ["line", "doc_id", "digest", "number", "keys"])

            for r, t in enumerate(b.column(2).to_pylist()):
                for n, line in enumerate((t or "").split("\n")):
                    norm = normalized(line)
                    large = takes_part(norm)
                    if large or short_lines and norm:
                        i = line_id(norm)
                        new = large and i not in seen
                        rows.append(r), numbers.append(n), ids.append(i), fresh.append(new)
                        if new:
                            seen.add(i)
                            lines.append(norm)
                            size += len(norm)
                if size > BATCH:
                    yield settle()
                    rows, numbers, ids, fresh, lines, size = [], [], [], [], [], 0
                if len(seen) > 500_000:
                    seen.clear()
            if rows:
                yield settle()

    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, f"line long, doc_id {kind}, digest long, number int, keys array<long>")


def _filter(*columns: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS with the bits of all values set, gathered by Spark's bitmap aggregate."""
    values = columns[0].toDF("v")
    for more in columns[1:]:
        values = values.unionByName(more.toDF("v"))
    at = F.col("v").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1  # bitmaps count from 1
    parts = values.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("i")).groupBy("b").agg(F.bitmap_construct_agg("i").alias("m")).toArrow()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bits in zip(parts["b"].to_pylist(), parts["m"].to_pylist(), strict=True):
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``line`` and its normalised text ``norm`` for ``wanted``: ``line`` and ``digest`` of a text that holds it."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(wanted.select("line"), wanted.select("digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bits.value
        has = lambda v: bitmap[(v & (FILTER_BITS - 1)) >> 3] >> (v & 7) & 1
        for b in batches:
            for digest, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if has(digest):
                    found = {i: norm for _, norm in eligible_lines(t.as_py()) if has(i := line_id(norm))}
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], ["line", "norm"])

    return docs.select(F.xxhash64("text").alias("digest"), "text").mapInArrow(run, "line long, norm string")


def _with_sketches(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                sizes, bits = sketches(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), *(pa.array(bits[:, k].copy()) for k in range(PARTS))], ["line", *SKETCH])

    return texts.select("line", "norm").mapInArrow(run, "line long, size int, " + ", ".join(f"`{c}` long" for c in SKETCH[1:]))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ``src``, ``dst`` those whose lines have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                yield b.select(["src", "dst"]).filter(pa.array(similar(b.column(2).to_pylist(), b.column(3).to_pylist())))

    a = texts.select(F.col("line").alias("src"), F.col("norm").alias("a"))
    b = texts.select(F.col("line").alias("dst"), F.col("norm").alias("b"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def line_components(docs: DataFrame, places: DataFrame, first: DataFrame) -> DataFrame:
    """``node`` (line id) and ``component`` of the lines that are linked to another; ``first`` has ``line``, ``times``
    and the first place.

    In each band the most frequent line is the pivot, and all others are held against it. Then, in bands whose
    lines are not yet one component, lines of different components are held against each other, so every
    candidate pair that could join two components is verified, without the pairs inside dense bands.
    """
    bands = places.select(F.explode("keys").alias("key"), "line").repartition("key")  # dealt once, read for the sums and for the members
    crowded = bands.groupBy("key").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo < hi").select("key")
    members = materialize(bands.join(crowded.hint("shuffle_hash"), "key").distinct(), "bands")
    shared = materialize(members.join(first.select("line", "times"), "line"), "bands")
    wanted = materialize(shared.select("line").distinct().join(first, "line").select("line", "first.digest"), "band-ids")
    texts = materialize(_texts(docs, wanted).join(wanted.select("line"), "line").dropDuplicates(["line"]), "band-lines")
    pivots = shared.groupBy("key").agg(F.max(F.struct("times", "line")).alias("p")).select("key", F.col("p.line").alias("pivot"))
    ends = lambda a, b: [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]
    stars = shared.select("key", "line").join(pivots, "key").where("line <> pivot").select(*ends("line", "pivot")).distinct()
    tried = materialize(stars, "stars")
    links = materialize(_verified(tried, texts), "links")
    nodes = connected_components(links)
    placed = materialize(shared.join(nodes, shared["line"] == nodes["node"], "left").select("key", "line", F.coalesce("component", "line").alias("c")), "placed")
    torn = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    rest = materialize(placed.join(torn, "key"), "torn")
    sketch = materialize(_with_sketches(texts.join(rest.select("line").distinct(), "line", "left_semi")), "sketches")
    rest = materialize(rest.join(sketch, "line"), "torn")
    as_ = lambda p: rest.select("key", *[F.col(c).alias(f"{p}{c}") for c in ("line", "c", *SKETCH)])
    pairs = as_("a").join(as_("b"), "key").where((F.col("ac") < F.col("bc")) & _plausible("a", "b")).select(*ends("aline", "bline")).distinct()
    more = materialize(_verified(pairs.join(tried, ["src", "dst"], "left_anti"), texts), "links")
    if not more.take(1):
        return nodes
    return connected_components(links.unionByName(more))


def drop_fuzzy_lines(docs: DataFrame, short_lines: str = "keep") -> DataFrame:
    """``docs`` (``doc_id``, ``text`` and any others) with repeated lines taken out, ``n_lines`` and ``n_dropped``.

    Null text stays null with no lines. A text whose lines all go becomes empty. Rows alike in id and text count
    as one document and are treated alike. Document ids that are null come first. Lines too short to take part
    stay; with ``short_lines="exact"`` those that repeat exactly go as well, but blank ones stay.
    """
    if short_lines not in ("keep", "exact"):
        raise ValueError(f"short_lines is 'keep' or 'exact', not {short_lines!r}")
    places = materialize(_occurrences(docs, short_lines == "exact"), "line-places")
    place = F.struct("doc_id", "digest", "number")
    first = materialize(places.groupBy("line").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")), "line-firsts")
    nodes = materialize(line_components(docs, places, first), "line-components")
    tied = first.join(nodes, first["line"] == nodes["node"], "left").withColumn("component", F.coalesce("component", "line"))
    keep = tied.groupBy("component").agg(F.min("first").alias("keep"), F.sum("times").alias("all")).where(F.col("all") > 1)
    gone = tied.join(keep, "component").select("line", "keep")
    lost = places.drop("keys").join(gone, "line").where(~place.eqNullSafe(F.col("keep")))
    per_doc = lost.groupBy("doc_id", "digest").agg(F.collect_set("number").alias("__gone"))
    per_doc = per_doc.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "__gone")
    whole = docs.withColumn("__own", F.xxhash64("text"))
    joined = whole.join(per_doc, whole["doc_id"].eqNullSafe(per_doc["__id"]) & (whole["__own"] == per_doc["__digest"]), "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")  # numbers of the lines that stay, in order
    out = joined.withColumns(
        {
            "n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"),
            "n_dropped": F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0)).cast("long"),
            "text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(lines), lambda x: F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")), F.lit(0))),
        }
    )
    return out.drop("__own", "__id", "__digest", "__gone")


def op8_fuzzy_lines(docs: DataFrame) -> DataFrame:
    """One row per document: its text without repeated lines, and how many lines it had and lost."""
    return drop_fuzzy_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")
