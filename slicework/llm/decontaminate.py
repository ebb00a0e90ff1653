"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages of words. Passages and benchmark items become TF-IDF vectors over the
content words of the benchmark; a randomised SVD, whose products with the passage matrix are sums over all tasks,
gives a latent space. Passages whose latent vector has a high cosine with an item's are candidates. A candidate
is a leak if the longest common subsequence of words covers most of the item, or a good part of it with the
item's answer, its last words.

An item whose words are mostly common, as they become if many documents hold it, has no place of its own in the
latent space. Every passage whose words could cover enough of such an item goes to the same check: as a leak lacks
two fifths of the item's words at most, it has some of any larger choice of them, and the rarest are chosen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicework.llm.shared import materialize

#: Words of a passage, and from one passage to the next.
PASSAGE, STRIDE = 64, 32
#: Words in more than this share of the blocks of STRIDE words carry no weight,
COMMON = 0.002
#: but not words of this many blocks or fewer, however small the corpus.
NEVER_COMMON = 20
#: Content words that a passage needs in the latent space.
LEAST_CONTENT = 4
#: Items with fewer rare words, or a smaller share of their distinct words, are sought by their words alone, since a leak
#: of them may have no rare word. And how many of the chosen words are asked for then.
FEW_RARE, RARE_SHARE, NEEDED = 8, 0.4, 6
#: Size of the latent space, and further directions that the random search takes along.
RANK, EXTRA = 256, 16
COSINE = 0.5
#: Share of an item's words in the common subsequence; with the answer's words, and without.
WITH_ANSWER, WITHOUT = 0.6, 0.7
ANSWER_WORDS, ANSWER_SHARE = 8, 0.75
#: Items that are held against the passages at a time.
ITEM_BLOCK = 2048

#: Signs beyond ASCII that part words: Latin-1 signs, general and ideographic punctuation.
SIGNS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]")
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def word_list(text: str | None) -> list[bytes]:
    """Words in lower case, without ASCII signs and the signs above."""
    low = (text or "").lower()
    if not low.isascii():
        low = SIGNS.sub(" ", low)
    return low.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


class Items:
    """The benchmark: ids, words as numbers, and the vocabulary. It is a stated query set, and small."""

    def __init__(self, rows: list):
        rows = sorted((r for r in rows if word_list(r["text"])), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        words = [word_list(r["text"]) for r in rows]
        self.ids = [r["item_id"] for r in rows]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for x in words for w in x}))}  # 0: any other word
        self.words = [[self.vocabulary[w] for w in x] for x in words]


def document_words(docs: DataFrame, items: Items) -> DataFrame:
    """``doc_id``, ``digest`` (of the text) and ``words``: the numbers of all words, four bytes each."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for b in batches:
            packed = [np.array([number(w, 0) for w in word_list(t.as_py())], "<i4").tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["doc_id", "digest", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, f"doc_id {kind}, digest long, words binary")


def _batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch of documents, and where each document begins and the last one ends."""
    packed = column.to_pylist()
    size = np.array([len(x) // 4 for x in packed], np.int64)
    return np.frombuffer(b"".join(packed), "<i4"), np.concatenate([[0], np.cumsum(size)])


def _passages(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of these sizes: how many passages each has and how many come before, and rows and first words of
    all passages. A passage begins at each STRIDE; the last reaches the end."""
    n = -(-np.maximum(1, size - PASSAGE + STRIDE) // STRIDE)
    base = np.cumsum(n) - n
    rows = np.repeat(np.arange(len(size)), n)
    return n, base, rows, (np.arange(len(rows)) - base[rows]) * STRIDE


def _terms(column: pa.Array, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of documents: rows and first words of its passages, and as two arrays passage and number of each
    word of positive weight."""
    words, edge = _batch(column)
    n, base, rows, firsts = _passages(np.diff(edge))
    at = np.flatnonzero(weight[words] > 0)
    doc = np.searchsorted(edge, at, "right") - 1
    local = at - edge[doc]
    last = np.minimum(local // STRIDE, n[doc] - 1)
    of, numbers = [], []
    for back in range(PASSAGE // STRIDE):
        p = last - back
        ok = (p >= 0) & (local < p * STRIDE + PASSAGE)
        of.append(base[doc[ok]] + p[ok])
        numbers.append(words[at[ok]])
    return rows, firsts, np.concatenate(of), np.concatenate(numbers)


def block_frequencies(words: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many blocks of STRIDE words each word of the vocabulary is, and how many blocks there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(size, np.int64), 0
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                numbers, edge = _batch(b.column(0).slice(lo, 1000))
                blocks = -(-np.diff(edge) // STRIDE)
                at = np.flatnonzero(numbers)
                doc = np.searchsorted(edge, at, "right") - 1
                block = (np.cumsum(blocks) - blocks)[doc] + (at - edge[doc]) // STRIDE
                pair = np.sort(block * size + numbers[at])
                n += np.bincount(pair[np.diff(pair, prepend=-1) != 0] % size, minlength=size)
                total += int(blocks.sum())
        n[0] = total
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["number", "n"])

    got = words.select("words").mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["number"].to_numpy()] = got["n"].to_numpy()
    return out, int(out[0])


def _matrix(column: pa.Array, weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The TF-IDF rows of the passages with enough content: their document row and first word, and the entries
    (row, number, value) sorted by row, with unit rows."""
    rows, firsts, of, numbers = _terms(column, weight)
    size = len(weight)
    pair, tf = np.unique(of * size + numbers, return_counts=True)
    of, numbers = pair // size, pair % size
    n = np.bincount(of, minlength=len(rows))
    keep = n[of] >= least
    of, numbers, tf = of[keep], numbers[keep], tf[keep]
    chosen, of = np.unique(of, return_inverse=True)
    value = (1 + np.log(tf)) * weight[numbers]
    norm = np.sqrt(np.bincount(of, value**2, minlength=len(chosen)))
    return rows[chosen], firsts[chosen], of, numbers, value / norm[of] if len(of) else value


def _times(of: np.ndarray, numbers: np.ndarray, value: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Product of the sparse rows and ``basis``."""
    if not len(of):
        return np.zeros((0, basis.shape[1]), np.float32)
    begin = np.flatnonzero(np.diff(of, prepend=-1))
    return np.add.reduceat(basis[numbers] * value[:, None].astype(np.float32), begin, axis=0)


def _gram_product(words: DataFrame, weight: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """A'A times ``basis`` for the matrix A of all passages, and the number of A's rows.

    Each task sends its sum, one row for each word, and Spark adds them up: nothing depends on the corpus but time.
    """
    shared = words.sparkSession.sparkContext.broadcast((weight, basis.astype(np.float32)))
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, basis = shared.value
        total, n = np.zeros((len(weight), k)), 0
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                _, _, of, numbers, value = _matrix(b.column(0).slice(lo, 1000), weight, LEAST_CONTENT)
                y = _times(of, numbers, value, basis)
                n += len(y)
                order = np.argsort(numbers, kind="stable")
                if len(order):
                    s = numbers[order]
                    begin = np.flatnonzero(np.diff(s, prepend=-1))
                    total[s[begin]] += np.add.reduceat(y[of[order]] * value[order, None].astype(np.float32), begin, axis=0)
        at = np.flatnonzero(np.abs(total).sum(axis=1))
        at = np.concatenate([[0], at[at > 0]])
        total[0] = 0
        total[0, 0] = n
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at].astype(np.float32)), pa.list_(pa.float32()))], ["number", "v"])

    parts = words.select("words").mapInArrow(run, "number long, v array<float>")
    sums = parts.groupBy("number").agg(F.array(*[F.sum(F.get("v", F.lit(i)).cast("double")) for i in range(k)]).alias("v")).toArrow()
    out = np.zeros((len(weight), k))
    if sums.num_rows:
        out[sums["number"].to_numpy()] = np.array(sums["v"].to_pylist())
    n = float(out[0, 0])
    out[0] = 0
    return out, n


def latent_space(words: DataFrame, items: Items, weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Basis (vocabulary by rank) of the passages and items by randomised SVD; the items weigh as much as the passages.

    One pass: from the product of the Gram matrix and a random test matrix, the Nystroem form gives the leading
    right singular vectors.
    """
    packed = pa.array([np.array(x, "<i4").tobytes() for x in items.words], pa.binary())
    _, _, of, numbers, value = _matrix(packed, weight, 1)
    n_rows = int(of.max()) + 1 if len(of) else 0
    dense = np.zeros((n_rows, len(weight)), np.float32)
    dense[of, numbers] = value
    rank = min(rank, max(1, n_rows))  # the items span no more
    k = min(rank + EXTRA, max(1, int((weight > 0).sum())))
    test = np.linalg.qr(np.random.default_rng(7).standard_normal((len(weight), k)))[0]
    product, n = _gram_product(words, weight, test)
    product += max(n, 1.0) / max(n_rows, 1) * (dense.T @ (dense @ test))
    shift = 1e-7 * float(np.linalg.norm(product)) + 1e-12
    product += shift * test
    core = test.T @ product
    half = np.linalg.solve(np.linalg.cholesky((core + core.T) / 2), product.T).T
    return np.linalg.svd(half, full_matrices=False)[0][:, :rank]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = masks.get(w)
        if m:
            u = v & m
            v = (v + u) | (v - u)
            v &= full
    return len(a) - v.bit_count()


def is_leak(item: list[int], region: list[int]) -> tuple[bool, float]:
    """Whether a region of a document has an item, and the share of the item in the common subsequence."""
    share = lcs(item, region) / len(item)
    if share >= WITHOUT:
        return True, share
    answer = item[-ANSWER_WORDS:]
    return share >= WITH_ANSWER and lcs(answer, region) >= ANSWER_SHARE * len(answer), share


def _reach(item: list[int]) -> int:
    """Words before and after a passage that are searched for an item."""
    return max(STRIDE, len(item) // 2)


def weak_items(words: list[list[int]], weight: np.ndarray) -> list[int]:
    """Positions of the items that have too few rare words for the latent space."""
    distinct = [set(x) for x in words]
    return [i for i, x in enumerate(distinct) if sum(weight[w] > 0 for w in x) < max(FEW_RARE, RARE_SHARE * len(x))]


class Sought:
    """Items that are sought by their words alone: of each its rarest words, and how many of these a leak must have."""

    def __init__(self, items: list[int], words: list[list[int]], n: np.ndarray):
        own, self.need = [], np.zeros(max(items, default=0) + 1, np.int64)
        for i in items:
            missing = int((1 - min(WITH_ANSWER, WITHOUT)) * len(words[i]) + 1e-9)
            chosen = sorted(set(words[i]), key=lambda w: (n[w], w))[: missing + NEEDED]
            self.need[i] = max(1, len(chosen) - missing)
            own += [(w, i) for w in chosen]
        own.sort()
        self.item = np.array([i for _, i in own], np.int64)
        self.cut = np.searchsorted(np.array([w for w, _ in own], np.int64), np.arange(len(n) + 1))
        self.reach = max((_reach(words[i]) for i in items), default=0)

    def pairs(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch of documents: rows and first words of its passages, and as two arrays passage and item where the
        passage with its reach has enough of the item's chosen words."""
        words, edge = _batch(column)
        n, base, rows, firsts = _passages(np.diff(edge))
        size, items = len(self.cut) - 1, len(self.need)
        many = np.diff(self.cut)
        at = np.flatnonzero(many[words])
        doc = np.searchsorted(edge, at, "right") - 1
        local = at - edge[doc]
        of, numbers = [], []
        for back in range(-(-(PASSAGE + 2 * self.reach) // STRIDE)):
            p = (local + self.reach) // STRIDE - back
            ok = (p >= 0) & (p < n[doc]) & (local < p * STRIDE + PASSAGE + self.reach)
            of.append(base[doc[ok]] + p[ok])
            numbers.append(words[at[ok]])
        pair = np.unique(np.concatenate(of) * size + np.concatenate(numbers))
        of, numbers = pair // size, pair % size
        k = many[numbers]
        posting = np.repeat(self.cut[numbers] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        both, count = np.unique(np.repeat(of, k) * items + self.item[posting], return_counts=True)
        both = both[count >= self.need[both % items]]
        return rows, firsts, both // items, both % items


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``digest``, ``item_id``, ``share`` (of the item's words) and ``cosine`` (null if only the words
    led there), one row a leak.

    Null and empty texts have no leaks, null and empty items are in none; an empty benchmark has none. Rows of
    ``docs`` alike in id and text give one row an item.
    """
    spark = docs.sparkSession
    items = Items(benchmark.select("item_id", "text").collect())
    words = materialize(document_words(docs, items), "document-words")
    size = len(items.vocabulary) + 1
    n, total = block_frequencies(words, size)
    weight = np.where(n <= max(COMMON * total, NEVER_COMMON), np.log((total + 1) / (n + 1.0)) + 1, 0.0)
    weight[0] = 0
    weak = weak_items(items.words, weight)
    basis = latent_space(words, items, weight)
    packed = pa.array([np.array(x, "<i4").tobytes() for x in items.words], pa.binary())
    owner, _, of, numbers, value = _matrix(packed, weight, 1)
    latent = _times(of, numbers, value, basis.astype(np.float32))
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    strong = ~np.isin(owner, weak)
    shared = spark.sparkContext.broadcast((weight, basis.astype(np.float32), latent[strong], owner[strong], items.words, Sought(weak, items.words, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, basis, latent, owner, item_words, sought = shared.value
        for b in batches:
            best: dict[tuple[int, int], tuple[float, float | None]] = {}

            def check(part: pa.Array, lo: int, row: int, first: int, item: int, cosine: float | None, best=best) -> None:
                reach = _reach(item_words[item])
                text = np.frombuffer(part[row].as_py(), "<i4")
                leak, share = is_leak(item_words[item], text[max(0, first - reach) : first + PASSAGE + reach].tolist())
                if leak:
                    old = best.get((lo + row, item), (0.0, None))
                    best[lo + row, item] = (max(old[0], share), max((c for c in (old[1], cosine) if c is not None), default=None))

            for lo in range(0, b.num_rows, 1000):
                part = b.column(2).slice(lo, 1000)
                rows, firsts, of, numbers, value = _matrix(part, weight, LEAST_CONTENT)
                y = _times(of, numbers, value, basis)
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
                for block in range(0, len(latent), ITEM_BLOCK):
                    cosine = y @ latent[block : block + ITEM_BLOCK].T
                    for p, q in zip(*np.nonzero(cosine >= COSINE), strict=True):
                        check(part, lo, int(rows[p]), int(firsts[p]), int(owner[block + q]), float(cosine[p, q]))
                if len(sought.item):
                    rows, firsts, passages, found = sought.pairs(part)
                    for p, item in zip(passages.tolist(), found.tolist(), strict=True):
                        check(part, lo, int(rows[p]), int(firsts[p]), item, None)
            at = pa.array([r for r, _ in best], pa.int64())
            found = [pa.array([i for _, i in best], pa.int32()), pa.array([s for s, _ in best.values()], pa.float64()), pa.array([c for _, c in best.values()], pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *found], ["doc_id", "digest", "place", "share", "cosine"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = words.select("doc_id", "digest", "words").mapInArrow(run, f"doc_id {kind}, digest long, place int, share double, cosine double")
    names = spark.createDataFrame(list(enumerate(items.ids)), T.StructType([T.StructField("place", T.IntegerType()), T.StructField("item_id", benchmark.schema["item_id"].dataType)]))
    found = found.join(F.broadcast(names), "place")  # as many rows as items, which the tasks hold anyway
    return found.groupBy("doc_id", "digest", "item_id").agg(F.max("share").alias("share"), F.max("cosine").alias("cosine"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that have a leak."""
    leaks = materialize(find_leaks(docs, benchmark), "leaks").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["__id"]) & (F.xxhash64(docs["text"]) == leaks["__digest"]), "left_anti")


def op10_latent_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    return find_leaks(docs.select("doc_id", "text"), benchmark).select("doc_id", "item_id", F.round("share", 6).alias("share"))
