"""Byte-level BPE with Spark higher-order functions: ranked merges folded over the bytes of distinct words.

A word starts as the ids of its bytes. Each step of the fold finds the adjacent pair of lowest rank, by
look-ups in a literal rank map, and merges it; a word of n bytes needs n - 1 steps at most. The map is an
array addressed by a perfect hash, since Spark's own map type is searched from end to end. In long words a step
merges all pairs like the lowest one at once.

Words that occur more than once are folded once and their ids broadcast as Arrow buffers, the most frequent
MAX_WORDS of them at most; of the other words each text's distinct ones are folded where the text stands, so texts
are never shuffled. Runs of known words' ids and folded words are put together, and pieces of ids joined, in Arrow batches.
What is looked up is written before that, so that no task has two Python workers at once.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from slicework.llm.shared import materialize, recorded, remove

#: Bound of the table of frequent words, about 25 bytes each; what it doesn't hold is folded in place, with equal results.
MAX_WORDS = 1 << 20
#: Stands for "not in the map".
NO_RANK = 1 << 16
#: Stands for two bytes that no piece has side by side.
NEVER = NO_RANK + 1
#: Ranks are below this, so that 256 more is a character of one UTF-16 unit (merges of like pairs in long words).
MOST_RANKS = 0xD800 - 256
#: Words of more bytes than this are folded by merging all like pairs in a step.
LONG_WORD = 96
#: Words that are looked up together.
CHUNK = 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line for each piece, in base 64, with its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Factors of bytes and of places in a word's hash.
_BYTES, _POWERS = (np.random.default_rng(k).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k, n in ((3, 256), (4, 4096)))


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def last_merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two ids that the last merge of a piece joins, or none where its merges stop before.

    Two ids that stand side by side in any word came about by merges inside each of them, and these are, in order, the
    merges of their joined bytes alone. So of all ways to cut a piece in two this is the only one that a fold can meet.
    """
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 2:
        low, k = min((ranks.get(parts[k] + parts[k + 1], NO_RANK), k) for k in range(len(parts) - 1))
        if low == NO_RANK:
            return None
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None


def perfect_hash(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots ``key << 16 | value`` and displacements, with slot(key) = (key mod P + shift[key mod Q]) mod P.

    P and Q are primes whose product exceeds all keys, so the keys that share a displacement differ mod P.
    """
    p = _prime(int(len(keys) * 1.2) + 11)
    q = _prime(max(int(len(keys) * 0.4), int(keys.max(initial=0)) // p) + 11)
    slots, shift = np.full(p, -1, np.int64), np.zeros(q, np.int64)
    order = np.argsort(keys % q, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order] % q, prepend=-1))
    groups = sorted(np.split(order, cuts[1:]) if len(cuts) else [], key=len, reverse=True)
    rng = np.random.default_rng(1)
    for g in groups:
        at = keys[g] % p
        while True:
            d = int(rng.integers(p))
            to = (at + d) % p
            if (slots[to] < 0).all():
                break
        slots[to], shift[keys[g[0]] % q] = (keys[g] << 16) | values[g], d
    return slots, shift


class RankMap:
    """The literal tables of one vocabulary, and the fold over them."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= MOST_RANKS:
            raise ValueError(f"ranks must be below {MOST_RANKS}")
        pairs = [((cut[0] << 16) | cut[1], r) for t, r in ranks.items() if (cut := last_merge(t, ranks))]
        keys, values = np.array(pairs, np.int64).reshape(-1, 2).T
        slots, shift = perfect_hash(keys, values)
        self.p, self.q = len(slots), len(shift)
        literal = lambda xs, kind: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")  # noqa: E731  Spark folds it to one literal
        inside = {t[k : k + 2] for t in ranks for k in range(len(t) - 1)}
        two = literal([ranks.get(x, NO_RANK if x in inside else NEVER) for a in range(256) for b in range(256) for x in [bytes([a, b])]], "bigint")
        self.two = two
        self.one = literal([ranks[bytes([b])] for b in range(256)], "bigint")
        self.slots, self.shift = literal(slots.tolist(), "bigint"), literal(shift.tolist(), "bigint")

    def bound(self, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
        """``body(fold)``, with the literals bound once outside of it.

        Spark describes a plan by strings, each expression's holding those of all below it. So literals of a megabyte
        deep in the fold would be copied at each level, some hundred megabytes of garbage in the driver a description.
        """
        names = ("two", "one", "slots", "shift")

        def bind(tables: Column, own: RankMap, left: tuple[str, ...]) -> Column:
            def inside(x: Column) -> Column:
                more = copy(own)
                setattr(more, left[0], x)
                return bind(tables, more, left[1:])

            return _let(tables[left[0]], inside) if left else body(own.fold)

        return _let(F.struct(*[getattr(self, x).alias(x) for x in names]), lambda tables: bind(tables, self, names))

    def rank(self, key: Column) -> Column:
        """The rank of the piece that two pieces make, or NO_RANK; the key is the first times NO_RANK plus the second."""
        slot = F.get(self.slots, (key % self.p + F.get(self.shift, key % self.q)) % self.p)
        return _let(slot - key * NO_RANK, lambda r: F.when((r >= 0) & (r < NO_RANK), r).otherwise(F.lit(NO_RANK).cast("bigint")))

    def fold(self, word: Column) -> Column:
        """Ids of a word: array<int>; none for the empty word.

        Long words are cut between bytes that no piece has side by side, since no merge can join them.
        """
        chars = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.ascii(c))
        pairs = lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda a, i: F.get(self.two, a * 256 + F.get(c, i + 1)))
        part = lambda c, r: F.struct(c.alias("c"), r.alias("r"))

        def parts(c: Column, r: Column) -> Column:
            never = F.filter(F.transform(r, lambda v, i: F.when(v == NEVER, i + 1).otherwise(-1)), lambda i: i > 0)
            cut = lambda at: F.transform(at, lambda i, k: _let(F.coalesce(F.get(at, k + 1), F.size(c)) - i, lambda n: part(F.slice(c, i + 1, n), F.slice(r, i + 1, n - 1))))
            return F.when(F.size(c) > LONG_WORD, _let(F.concat(F.array(F.lit(0)), never), cut)).otherwise(F.array(part(c, r)))

        ids = lambda c: _let(pairs(c), lambda r: F.flatten(F.transform(parts(c, r), self._fold)))
        return F.when(F.octet_length(word) > 0, _let(chars, ids).cast("array<int>")).otherwise(F.array().cast("array<int>"))

    def _fold(self, part: Column) -> Column:
        """The state holds the ids ``x``, the ranks ``r`` of the adjacent pairs, and ``m``, the lowest rank.

        A merge looks up only the two pairs that it makes. In a long part all pairs like the one at the first place
        are merged at once, from left to right as single merges would; where unlike pairs have that rank, as two cuts
        of one piece can, only the first is merged, so the order of merges stays.
        """
        long = F.size(part["c"]) > LONG_WORD
        gone = F.lit(-1).cast("bigint")
        state = lambda x, r: F.struct(x.alias("x"), r.alias("r"), F.array_min(r).alias("m"))
        kept = lambda x: F.filter(x, lambda v: v != -1)

        def single(x: Column, low: Column, k: Column) -> Column:
            return F.transform(F.filter(x, lambda v, i: i != k + 1), lambda v, i: F.when(i == k, low).otherwise(v))

        def every(x: Column, r: Column, low: Column, k: Column) -> Column:
            sign = lambda i: F.decode(F.unhex(F.lpad(F.hex(i + 256), 4, "0")), "UTF-16BE")  # noqa: E731  runs of one id are merged in twos by a replacement in a string
            text = F.replace(F.array_join(F.transform(x, sign), ""), F.repeat(sign(F.get(x, k)), 2), sign(low))
            run = F.transform(F.split(text, ""), lambda c: (F.ascii(c) - 256).cast("bigint"))
            apart = kept(F.transform(x, lambda v, i: F.when(F.get(r, i) == low, low).when(F.get(r, i - 1) == low, gone).otherwise(v)))
            unlike = F.filter(r, lambda v, i: (v == low) & ((F.get(x, i) != F.get(x, k)) | (F.get(x, i + 1) != F.get(x, k + 1))))
            return F.when(F.size(unlike) > 0, single(x, low, k)).when(F.get(x, k) == F.get(x, k + 1), run).otherwise(apart)

        def merge(x: Column, r: Column, low: Column, k: Column) -> Column:
            """The look-up, and its literals, stand in one place: for all pairs of a long part, else for the two around the merge."""
            left, right = F.get(x, k - 1) * NO_RANK + low, low * NO_RANK + F.get(x, k + 2)
            pairs = lambda y: F.transform(F.slice(y, 1, F.size(y) - 1), lambda a, i: a * NO_RANK + F.get(y, i + 1))
            keys = lambda y: F.when(long, pairs(y)).otherwise(F.filter(r, lambda v, i: i != k))
            ranks = lambda y: F.transform(keys(y), lambda v, i: F.when(((i < k - 1) | (i > k)) & ~long, v).otherwise(self.rank(F.when(long, v).when(i < k, left).otherwise(right))))
            fresh = lambda y: _let(ranks(y), lambda new: state(y, new))
            return _let(F.when(long, every(x, r, low, k)).otherwise(single(x, low, k)), fresh)

        def step(acc: Column, _: Column) -> Column:
            first = F.struct(acc["m"].alias("low"), (F.array_position(acc["r"], acc["m"]) - 1).cast("int").alias("k"))
            return F.when(acc["m"] < NO_RANK, _let(first, lambda f: merge(acc["x"], acc["r"], f["low"], f["k"]))).otherwise(acc)

        start = state(F.transform(part["c"], lambda b: F.get(self.one, b)), part["r"])
        return F.aggregate(F.sequence(F.lit(1), F.size(part["c"])), start, step, lambda acc: acc["x"])


class Pieces:
    """The bytes of each id's piece, for the way back."""

    def __init__(self, ranks: dict[bytes, int]):
        own = {r: t for t, r in ranks.items()}
        self.pieces = pa.array([own.get(r, b"") for r in range(max(own, default=-1) + 1)], pa.binary())

    def decoded(self, ids: np.ndarray, edge: np.ndarray) -> pa.Array:
        """Of each text, whose ids lie between two edges, the bytes of its ids' pieces, one after the other."""
        found = self.pieces.take(pa.array(ids))
        ends = np.asarray(pa.Array.from_buffers(pa.int32(), len(ids) + 1, [None, found.buffers()[1]])) if len(ids) else np.zeros(1, np.int32)
        return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(ends[edge].astype(np.int32)), found.buffers()[2]])


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column, pattern: str) -> Column:
    """The matches of the pattern in a text. The pattern's white space is Unicode's, which Java has under another name."""
    own = pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(own), F.lit(0))


def word_counts(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """The distinct words of all texts and how often they occur: ``word``, ``n``."""
    return docs.select(F.explode(split_words(F.col(text), pattern)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def frequent_words(counts: DataFrame, max_words: int) -> DataFrame:
    """Words that occur twice or more, down to the count at which at most ``max_words`` remain: bounded whatever the corpus."""
    ties = counts.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count(F.lit(1)).alias("words"))
    above = ties.withColumn("words", F.sum("words").over(W.orderBy(F.desc("n"))))
    least = above.where(F.col("words") <= max_words).agg(F.min("n")).first()[0]
    return counts.where(F.col("n") >= F.lit(1 << 62 if least is None else max(2, least))).select("word")


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of some non-empty strings; so many at a time that the numbers for each byte stay few."""
    parts = [_word_hashes(words.slice(lo, CHUNK // 10)) for lo in range(0, len(words), CHUNK // 10)]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


def _word_hashes(words: pa.Array) -> np.ndarray:
    edge = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[edge[0] : edge[-1]]
    begin = edge[:-1] - edge[0]
    at = np.arange(len(data)) - np.repeat(begin, np.diff(edge))
    h = np.add.reduceat(_BYTES[data] * _POWERS[at % len(_POWERS)], begin)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0x9E3779B97F4A7C15)


class Known:
    """Words and their ids, as the Arrow table that is broadcast; each Python worker makes its index once.

    The index is an open-addressing table over hashes, of twice as many slots as words at least; what it finds is
    compared with the word itself.
    """

    def __init__(self, table: pa.Table):
        self.table, self.slots = table, None

    def __reduce__(self):
        return Known, (self.table,)

    def _build(self) -> None:
        lists = self.table["ids"].combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        names = self.table["word"].combine_chunks()
        self.names = names if isinstance(names, pa.Array) else pa.concat_arrays(names.chunks)
        self.cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        self.table = None
        self.hash = word_hashes(self.names)
        self.bits = max(4, (2 * len(self.names)).bit_length())
        slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(self.names), dtype=np.int32)
        at = self._first(self.hash)
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = left[free]
            lost = slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(slots) - 1)
        self.slots = slots

    def _first(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """Of each word its place in the table, or -1."""
        if self.slots is None:
            self._build()
        h, out = word_hashes(words), np.full(len(words), -1, np.int64)
        left, at = np.arange(len(words)), self._first(h)
        while len(left):
            found = self.slots[at]
            some = found >= 0
            hit = some.copy()
            hit[some] = self.hash[found[some]] == h[left[some]]
            out[left[hit]] = found[hit]
            on = some & ~hit
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)
        hits = np.flatnonzero(out >= 0)
        same = pc.equal(words.take(pa.array(hits)), self.names.take(pa.array(out[hits]))).to_numpy(zero_copy_only=False)
        out[hits[~same.astype(bool)]] = -1
        return out


def _packed(ids: np.ndarray, edge: np.ndarray, kind: str = "<i4") -> pa.Array:
    """Of each text, whose ids lie between two edges, these as little-endian integers of a kind."""
    ids = ids.astype(kind)
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((ids.itemsize * edge).astype(np.int32)), pa.py_buffer(ids)])


def _unpacked(packed: pa.Array) -> pa.ListArray:
    """Packed ids of two bytes as lists, over the same memory."""
    edge = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // 2
    values = pa.Array.from_buffers(pa.uint16(), int(edge[-1]), [None, packed.buffers()[2] or pa.py_buffer(b"")])
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), values)


def _looked_up(words: pa.ListArray, known: Known) -> list[pa.Array]:
    """Of texts as lists of words: the ids of known words, packed in two bytes each, and how many stand in each of the runs that other words part; the
    distinct other words of each text; and which of them follows each run but the last."""
    edge, values = np.asarray(words.offsets, np.int64), words.flatten()
    edge = edge - edge[0]
    pos = known.places(values)
    flat, cuts = known.flat, known.cuts
    rare = np.flatnonzero(pos < 0)
    n = np.where(pos < 0, 0, np.diff(cuts)[pos] if len(cuts) > 1 else 0)
    upto = np.concatenate([[0], np.cumsum(n)])
    ids = flat[np.repeat(cuts[pos] - upto[:-1], n) + np.arange(upto[-1])]
    doc = np.searchsorted(edge, rare, "right") - 1
    per_doc = np.bincount(doc, minlength=len(words))
    outer = np.concatenate([[0], np.cumsum(per_doc + 1)])
    starts = np.full(outer[-1], -1, np.int64)
    starts[outer[:-1]] = upto[edge[:-1]]
    starts[starts < 0] = upto[rare]
    coded = values.take(pa.array(rare)).dictionary_encode()
    each, at = np.unique(doc * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_inverse=True)
    own = np.concatenate([[0], np.cumsum(np.bincount(each // max(1, len(coded.dictionary)), minlength=len(words)))])
    others = coded.dictionary.take(pa.array(each % max(1, len(coded.dictionary))))
    of = lambda offsets, x: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x)
    return [
        _packed(ids, upto[edge], "<u2"),
        of(outer, pa.array(np.diff(np.append(starts, upto[-1])), pa.int32())),
        of(own, others),
        of(np.concatenate([[0], np.cumsum(per_doc)]), pa.array(at - own[doc], pa.int32())),
    ]


def _put_together(ids: pa.ListArray, runs: pa.ListArray, folded: pa.ListArray, at: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in their order, and where each text begins and the last one ends; see ``_looked_up``."""
    flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
    edges = lambda x: np.asarray(x.offsets, np.int64) - x.offsets[0].as_py()
    words, docs = folded.flatten(), np.arange(len(ids))
    known, size = flat(ids), flat(runs).astype(np.int64)
    doc = np.repeat(docs, np.diff(edges(at)))
    word = edges(folded)[doc] + flat(at)
    begin, n = np.empty(len(size) + len(word), np.int64), np.empty(len(size) + len(word), np.int64)
    of_run = 2 * np.arange(len(size)) - np.repeat(docs, np.diff(edges(runs)))
    of_word = 2 * np.arange(len(word)) + doc + 1
    cuts = edges(words) if len(words) else np.zeros(1, np.int64)
    begin[of_run], n[of_run] = np.cumsum(size) - size, size
    begin[of_word], n[of_word] = len(known) + cuts[word], np.diff(cuts)[word]
    upto = np.concatenate([[0], np.cumsum(n)])
    out = np.concatenate([known, flat(words)]).astype(np.int32)[np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])]
    return out, upto[2 * edges(runs) - np.arange(len(ids) + 1)]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", max_words: int = MAX_WORDS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``ids`` (binary: the token ids as little-endian 32-bit integers) and ``decoded`` (binary).

    Null and empty texts have no ids; there are no special tokens. Rows are written once on their way and
    not shuffled, as word counts are. Columns of the input named ``ids`` or ``decoded`` are replaced. A word of n letters takes some n
    steps at most, and long words fall into parts that no merge joins: a hundred thousand random letters take seconds.
    """
    ranks = load_ranks(vocabulary)
    rank_map, pieces = RankMap(ranks), Pieces(ranks)
    spark = docs.sparkSession
    with recorded() as paths:
        counts = materialize(word_counts(docs, pattern, text), "bpe-words")
        frequent = materialize(frequent_words(counts, max_words).repartition(spark.sparkContext.defaultParallelism, "word"), "bpe-frequent")  # so the plan with the literals has no shuffle, and is described once
        known = materialize(frequent.select("word", rank_map.bound(lambda fold: fold(F.col("word"))).alias("ids")), "bpe-ids")
        shared = spark.sparkContext.broadcast(Known(known.toArrow()))
    remove(spark, paths)
    keep = [c for c in keep or docs.columns if c not in ("ids", "decoded")]

    def parts(batch: pa.RecordBatch, lists: pa.ListArray) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
        """Rows that have some CHUNK values in their lists, and these."""
        edge, lo = np.asarray(lists.offsets), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + CHUNK, "right")) - 1)
            yield batch.slice(lo, hi - lo), lists.slice(lo, hi - lo)
            lo = hi

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part, words in parts(batch, batch.column("__words")):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *_looked_up(words, known)], [*keep, "__ids", "__runs", "__rare", "__at"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, known_ids in parts(batch, _unpacked(batch.column("__ids"))) if batch.num_rows else ():
                ids, edge = _put_together(known_ids, *(part.column(c) for c in ("__runs", "__rare", "__at")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), _packed(ids, edge), pieces.decoded(ids, edge)], [*keep, "ids", "decoded"])

    own = [docs.schema[c] for c in keep]
    ints = T.ArrayType(T.IntegerType())
    looked_up = T.StructType([*own, T.StructField("__ids", T.BinaryType()), T.StructField("__runs", ints), T.StructField("__rare", T.ArrayType(T.StringType())), T.StructField("__at", ints)])
    split = docs.select(*keep, split_words(F.col(text), pattern).alias("__words")).mapInArrow(look_up, looked_up)
    split = materialize(split, "bpe-known", compression="zstd")
    shared.destroy()  # nothing looks up any more
    folded = split.withColumn("__rare", rank_map.bound(lambda fold: F.transform("__rare", fold)))
    return folded.mapInArrow(put_together, T.StructType([*own, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]))


def op9_byte_bpe(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per document the number of ids and the digests of its ids and of the bytes that they decode to."""
    out = encode_documents(docs.select("doc_id", "text"), vocabulary, pattern, keep=("doc_id",))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
