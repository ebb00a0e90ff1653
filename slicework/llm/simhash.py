"""SimHash near duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint falls into three segments. Of two or fewer differing bits, some segment has none and the
segment after it, in a ring, has one at most. So a fingerprint's keys are, for each segment, its exact bits
with the indices of the codewords of the (23,12) Golay code near the next segment: the one within distance 3,
and where that distance is 3, the five at distance 4 as well. Fingerprints one bit apart share such a codeword.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicework.llm.graph import connected_components
from slicework.llm.shared import materialize

#: Generator polynomial of the Golay code (fixed value).
GENERATOR = 0xAE3
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MOST_BITS = 2
#: Fingerprints that share a key are compared in pairs up to this many; see ``crowded_links`` for more.
MOST_PAIRED = 32


def syndrome(x: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    x = x.astype(np.int64)
    for bit in range(22, 10, -1):
        x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - 11)), x)
    return x


def error_table() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome up to six error masks, and their number: one of weight 3 or less, and five of weight 4."""
    masks = [np.array([sum(1 << b for b in c) for c in combinations(range(23), w)], np.int64) for w in range(5)]
    table, n = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    heavy = np.zeros(2048, bool)
    for w, group in enumerate(masks):
        for mask, s in zip(group.tolist(), syndrome(group).tolist(), strict=True):
            if w < 4 or heavy[s]:
                table[s, n[s]] = mask
                n[s] += 1
                heavy[s] |= w == 3
    return table, n


def golay_keys(fps: np.ndarray, errors: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``fps`` (uint64) and their keys; about 16 keys each."""
    table, n = errors
    at, keys = [], []
    for k, (first, width) in enumerate(SEGMENTS):
        nxt, nxt_width = SEGMENTS[(k + 1) % 3]
        exact = (fps >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
        fuzzy = (fps >> np.uint64(nxt) & np.uint64((1 << nxt_width) - 1)).astype(np.int64)
        s = syndrome(fuzzy)
        for j in range(6):
            has = np.flatnonzero(j < n[s])
            at.append(has)
            keys.append(((k << 22 | exact[has]) << 12) | (fuzzy[has] ^ table[s[has], j]) >> 11)
    return np.concatenate(at), np.concatenate(keys)


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles of a text with A-Z in lower case; 0 for one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends = memoryview(b" ".join(words)), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], "<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``fp`` (bigint, the fingerprint's bits) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, fp long")


def fuzzy_keys(distinct: DataFrame) -> DataFrame:
    """Each fingerprint with each of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors = error_table()
        for b in batches:
            fps = b.column(0).to_numpy()
            at, keys = golay_keys(fps.view(np.uint64), errors)
            yield pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(keys)], ["fp", "key"])

    return distinct.select("fp").mapInArrow(run, "fp long, key long")


def crowded_links(members: DataFrame) -> DataFrame:
    """Links among fingerprints of crowded keys without pairs.

    Two fingerprints differ in two or fewer bits if and only if some word is within one bit of both. So each
    is filed under the 65 words within one bit of it, and all that share a word are linked to the least of them.
    """
    one = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    filed = members.select("fp").distinct().select("fp", F.explode(one).alias("word"))
    least = filed.groupBy("word").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return filed.join(least, "word").where("fp <> least").select(F.col("fp").alias("src"), F.col("least").alias("dst")).distinct()


def near_links(distinct: DataFrame) -> DataFrame:
    """Links ``src``, ``dst`` that join all distinct fingerprints of two or fewer differing bits, directly or by others."""
    keys = materialize(fuzzy_keys(distinct), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(keys.join(sizes, "key"), "golay-shared")
    few = shared.where(F.col("n") <= MOST_PAIRED)
    pairs = few.select("key", F.col("fp").alias("src")).join(few.select("key", F.col("fp").alias("dst")), "key").where("src > dst").select("src", "dst")
    close = pairs.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= MOST_BITS).distinct()
    return close.unionByName(crowded_links(shared.where(F.col("n") > MOST_PAIRED)))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``key``, ``fp`` and ``component_id``, the smallest key that its links reach.

    Null, empty and blank texts share the fingerprint zero, which links like any other. Repeated rows share a
    component. A null key is in no minimum: a component of null keys alone has a null id.
    """
    prints = materialize(fingerprints(docs, text, key), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(key).alias("first")), "distinct-fingerprints")
    nodes = connected_components(near_links(distinct))
    rooted = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id``, ``text`` and any others) with one row of each component: the least by id, then by digest of the text."""
    keyed = docs.select(F.struct("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("digest")).alias("key"), "text")
    kept = near_duplicates(keyed, key="key").select(F.col("component_id.doc_id").alias("__id"), F.col("component_id.digest").alias("__digest")).distinct()
    on = docs["doc_id"].eqNullSafe(kept["__id"]) & (F.xxhash64(docs["text"]) == kept["__digest"])
    own = docs.join(kept, on, "left_semi").withColumn("__digest", F.xxhash64("text"))
    return own.dropDuplicates(["doc_id", "__digest"]).drop("__digest")


def op5_golay_simhash(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint and its component."""
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
