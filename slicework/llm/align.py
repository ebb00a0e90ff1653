"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and corpus-wide links between their ids.

Both id lists of a text become dictionaries from cumulative byte ends to indices; the sorted intersection of their keys
cuts both lists into groups. The dictionaries of some megabytes of texts are arrays addressed by the byte end. Links of a
group are all pairs of its ids. A link's count is the number of documents that hold it, over all documents.

Texts never leave their task: a text's distinct links are kept as arrays of codes, counts are aggregated before
they are shuffled, and come back to the texts as a broadcast table of the ``MOST_SHARED`` most frequent links at most; rarer
ones are joined by their code. Null and empty texts, and texts that a tokenizer's bytes do not give back (normalised
characters, say), have no tokens. Rows are documents, so repeated rows count each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicework.llm.shared import materialize

#: How byte-level vocabularies split texts (fixed value).
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose pieces a worker keeps.
MOST_WORDS = 1 << 18
#: Bound of the broadcast table, 17 bytes a link; rarer links are joined, with equal results.
MOST_SHARED = 1 << 20
#: Characters that are tokenized together, and links that are expanded together.
CHARS, LINKS = 1 << 20, 1 << 21


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, then U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked(path: str):
    """A byte-level vocabulary file as an encoder by ranks, which gives the same ids some five times faster: where the
    merges stand in the order of the ids that they make, the id is the rank. None for other files."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        js = json.load(f)
    before, model, of = js.get("pre_tokenizer") or {}, js["model"], byte_alphabet()
    if js.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model["type"] != "BPE":
        return None
    special = {x["content"] for x in js.get("added_tokens", ())}
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made) or any(c not in of for k in model["vocab"] if k not in special for c in k):
        return None
    ranks = {bytes(of[c] for c in k): i for k, i in model["vocab"].items() if k not in special}
    return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})


class Aligned(NamedTuple):
    """Ids of some texts one after the other; of each text the numbers of ids and groups; of each group those of its ids."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    m: np.ndarray
    n: np.ndarray


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where a run of blanks follows a character that is surely no white space, as a mask over the bytes of UTF-8.

    Neither tokenizer joins anything over such a place. After the lead bytes C2 and E1 to E3, which begin the white space
    beyond ASCII, no place is marked.
    """
    before = (data > 0x20) & (data != 0x7F)
    for lead, back in ((0xC2, 1), (0xE1, 2), (0xE2, 2), (0xE3, 2)):
        before[back:] &= (data[:-back] != lead) | (data[back:] < 0x80)
    starts = data == 0x20
    starts[1:] &= before[:-1]
    return starts


def binary_parts(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of an array of binaries without nulls, one after the other, and where each begins and the last ends."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    return memoryview(values.buffers()[2] or b"").cast("B"), offsets


def cut_bytes(ids: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """The bytes of 32-bit integers, cut at some places."""
    joined, cuts = ids.tobytes(), (4 * np.append(0, ends)).astype(np.int64).tolist()
    return (joined[lo:hi] for lo, hi in zip(cuts, cuts[1:]))


class Tokenizers:
    """Both tokenizers, loaded where they are first used, and the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: str):
        self.paths, self.a, self.b = (byte_level, pieces), None, None

    def __reduce__(self):
        return Tokenizers, self.paths

    def load(self) -> Tokenizers:
        if self.a is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import sentencepiece
            from tokenizers import Tokenizer

            self.a, self.b = Tokenizer.from_file(self.paths[0]), sentencepiece.SentencePieceProcessor(model_file=self.paths[1])
            self.a.encode_special_tokens = True
            self.ranked = ranked(self.paths[0])
            of = byte_alphabet()
            pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
            # no piece goes over the start of a run of blanks, so such runs begin words that are encoded apart
            self.by_words = self.ranked is not None and not any(re.search("[^▁]▁", p) for p in pieces) and self.b.encode("a", out_type=str)[0].startswith("▁")
            self.blank, self.known = [self.b.piece_to_id("▁")], ({}, {})
            size = 1 + max(self.a.get_vocab().values())
            names = [self.a.id_to_token(i) or "" for i in range(size)]
            self.bytes_a = pa.array([bytes(of[c] for c in name) if all(c in of for c in name) else name.encode() for name in names], pa.binary())
            self.bytes_b = pa.array([bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(pieces)], pa.binary())
            #: Decimal ids, each with the three signs that can follow it.
            self.decimal = pa.array([f"{i}{sign}".encode() for i in range(max(size, len(pieces))) for sign in ",|;"], pa.binary())
        return self

    def sizes(self) -> tuple[int, int]:
        self.load()
        return len(self.bytes_a), len(self.bytes_b)

    def ids_a(self, text: str) -> list[int]:
        if self.ranked is None or len(text) > CHARS:
            return self.a.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)

    def ids_b(self, text: str) -> list[int]:
        """Ids of the pieces of one text."""
        return self.load().encoded([text])[2][1][0].tolist() if text else []

    def _pieces(self, spaced: list[str]) -> list[list[int]]:
        return [ids if len(x) > 1 else self.blank for x, ids in zip(spaced, self.b.encode([x[1:] for x in spaced], num_threads=1))] if spaced else []

    def _all_a(self, words: list[str]) -> list[bytes]:
        """``ids_a`` of each word as 32-bit integers: of words that end in no white space in one call, cut by their bytes."""
        apart = {w: array("i", self.ids_a(w)).tobytes() for w in words if self.ranked is None or len(w) > CHARS or w[-1].isspace()}
        together = [w for w in words if w not in apart] if apart else words
        ids = np.array(self.ranked.encode_ordinary("".join(together)) if together else [], np.int32)
        ends = np.searchsorted(np.cumsum(np.diff(binary_parts(self.bytes_a)[1])[ids]), np.cumsum([len(w.encode()) for w in together])) + 1
        cut = cut_bytes(ids, ends)
        return [apart[w] if w in apart else next(cut) for w in words] if apart else list(cut)

    def _all_b(self, words: list[str]) -> list[bytes]:
        ids = self._pieces(words)
        return list(cut_bytes(np.fromiter(chain.from_iterable(ids), np.int32), np.cumsum(list(map(len, ids)))))

    def _ids(self, words: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of both tokenizers for words, which begin with a blank, as 32-bit integers; words that come again once."""
        found, new = [list(map(x.get, words)) for x in self.known], []
        for i, ids in enumerate(found[0]):
            if ids is None:
                new.append(i)
        fresh = [words[i] for i in new]
        if len(self.known[0]) + len(new) > MOST_WORDS:
            for known in self.known:
                known.clear()
        for known, out, every in zip(self.known, found, (self._all_a, self._all_b)):
            for i, w, ids in zip(new, fresh, every(fresh)):
                out[i] = ids
                if len(w) <= 48 and len(known) < MOST_WORDS:
                    known[w] = ids
        return found[0], found[1]

    def encoded(self, texts: list[str]) -> tuple[bytes, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The bytes of texts, a blank before each, one after the other; where each begins and the last ends; and of both
        tokenizers the ids, and how many each text has. No text is empty.

        A text that is its own normal form is encoded word by word, distinct words once; any other one as a whole.
        """
        parts = [b" " + x.encode() for x in texts]
        data, edge = b"".join(parts), np.cumsum([0, *map(len, parts)])
        starts = word_starts(np.frombuffer(data, np.uint8))
        for i, x in enumerate(texts):
            if not self.by_words or "▁" in x or self.b.normalize(x) != "▁" + x.replace(" ", "▁"):
                starts[edge[i] : edge[i + 1]] = False
        starts[edge[:-1]] = True
        at = np.flatnonzero(starts)
        offsets = np.append(at, len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        of, first, out = words.indices.to_numpy(), np.searchsorted(at, edge[:-1]), []
        for ids in self._ids(words.dictionary.to_pylist()):
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            n, flat = size[of], np.frombuffer(b"".join(ids), np.int32)
            upto = np.cumsum(n)
            out.append((flat[np.repeat((np.cumsum(size) - size)[of] - upto + n, n) + np.arange(upto[-1])], np.add.reduceat(n, first)))
        return data, edge, out

    def aligned(self, texts: list[str | None]) -> Aligned:
        self.load()
        some = [i for i, t in enumerate(texts) if t]
        numbers = np.zeros((3, len(texts)), np.int64)
        none = np.zeros(0, np.int64)
        if not some:
            return Aligned(none, none, *numbers, none, none)
        data, edge, both = self.encoded([texts[i] for i in some])
        kept = np.ones(len(some), bool)
        for (ids, n), pieces in zip(both, (self.bytes_a, self.bytes_b)):
            joined, ends = binary_parts(pieces.take(pa.array(ids)))
            own = ends[np.cumsum(np.append(0, n))]
            kept &= [joined[own[i] : own[i + 1]] == data[edge[i] : edge[i + 1]] for i in range(len(some))]
        (a, n_a), (b, n_b) = ((ids[np.repeat(kept, n)], n * kept) for ids, n in both)
        size = int((np.diff(edge) * kept).sum())
        index = []
        for ids, pieces in ((a, self.bytes_a), (b, self.bytes_b)):
            ends = np.cumsum(np.diff(binary_parts(pieces)[1])[ids])
            index.append(np.zeros(size + 1, np.int32))
            index[-1][ends] = np.arange(1, len(ids) + 1)
        common = np.flatnonzero((index[0] > 0) & (index[1] > 0))
        m, n = (np.diff(x[common], prepend=0).astype(np.int64) for x in index)
        groups = np.diff(np.searchsorted(common, np.cumsum(np.diff(edge) * kept), "right"), prepend=0)
        numbers[:, some] = n_a, n_b, groups
        return Aligned(a.astype(np.int64), b.astype(np.int64), *numbers, m, n)

    def align(self, texts: list[str | None]) -> list[tuple[list[int], list[int], list[int], list[int]]]:
        """Of each text the ids of both tokenizers and the ends of the groups in either list."""
        x = self.aligned(texts)
        cut = lambda values, n: np.split(values, np.cumsum(n)[:-1])
        ids, groups = [cut(x.a, x.n_a), cut(x.b, x.n_b)], [cut(x.m, x.n_groups), cut(x.n, x.n_groups)]
        return [(a.tolist(), b.tolist(), np.cumsum(m).tolist(), np.cumsum(n).tolist()) for a, b, m, n in zip(*ids, *groups)] if texts else []

    def digests(self, x: Aligned) -> list[str]:
        """Of each text the SHA-256 of its groups as decimal ids, ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        codes = np.empty(len(x.a) + len(x.b), np.int64)
        last_a, last_b = np.cumsum(x.m), np.cumsum(x.n)
        for ids, at, last, sign in ((x.a, np.repeat(last_b - x.n, x.m), last_a - 1, 1), (x.b, np.repeat(last_a, x.n), last_b - 1, 2)):
            own = ids * 3
            own[last] += sign
            codes[np.arange(len(ids)) + at] = own
        written, ends = binary_parts(self.decimal.take(pa.array(codes)))
        cuts = ends[np.cumsum(np.append(0, x.n_a + x.n_b))].tolist()
        return [hashlib.sha256(written[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(cuts, cuts[1:])]


def parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some ``CHARS`` characters."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text or "") > CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(text or "")
    if lo < len(texts):
        yield lo, len(texts)


def links_of(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, doc: np.ndarray, docs: int, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct links of texts: offsets by text, codes ``a * size_b + b`` in order, and how often each occurs.

    ``a``, ``b``: ids of all texts one after the other; ``m``, ``n``: ids of each group; ``doc``: its text.
    """
    at_a, at_b = np.cumsum(m) - m, np.cumsum(n) - n
    one = (m == 1) & (n == 1)
    codes = a[at_a[one]] * size_b + b[at_b[one]]
    found = [(doc[one], codes, np.ones(len(codes), np.int64))] if len(codes) else []
    at_a, at_b, m, n, doc = (x[~one] for x in (at_a, at_b, m, n, doc))
    lo, upto = 0, np.cumsum(m * n)
    while lo < len(m):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + LINKS, "right")))
        if hi == lo + 1 and m[lo] * n[lo] > LINKS:
            ids_a, times_a = np.unique(a[at_a[lo] : at_a[lo] + m[lo]], return_counts=True)
            ids_b, times_b = np.unique(b[at_b[lo] : at_b[lo] + n[lo]], return_counts=True)
            codes, times, of = (ids_a[:, None] * size_b + ids_b).ravel(), np.outer(times_a, times_b).ravel(), doc[lo]
        else:
            each = (m * n)[lo:hi]
            group = np.repeat(np.arange(lo, hi), each)
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            codes = a[at_a[group] + at // n[group]] * size_b + b[at_b[group] + at % n[group]]
            times, of = np.ones(len(codes), np.int64), doc[group]
        found.append((np.broadcast_to(of, codes.shape), codes, times))
        lo = hi
    if not found:
        return np.zeros(docs + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, codes, times = (np.concatenate(x) for x in zip(*found))
    span = int(codes.max()) + 1
    keys = of * span + codes
    if (times == 1).all():
        keys.sort()
        times = np.ones(len(keys), np.int64)
    else:
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys = keys[first]
    return np.concatenate([[0], np.cumsum(np.bincount(keys // span, minlength=docs))]), keys % span, np.add.reduceat(times, first)


def align_documents(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row its key, the ids of both tokenizers, and where each group ends in either list (``a_cuts``, ``b_cuts``)."""
    both, kind = Tokenizers(byte_level, pieces), docs.schema[key].dataType.simpleString()
    names = ["a_ids", "b_ids", "a_cuts", "b_cuts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in parts(texts):
                lists = [pa.array(list(x), pa.list_(pa.int32())) for x in zip(*both.align(texts[lo:hi]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *lists], [key, *names])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} array<int>" for c in names))


def linked_documents(docs: DataFrame, both: Tokenizers) -> DataFrame:
    """Per row of (``doc_id``, ``text``): numbers of ids, groups and links, the digest of the groups, and distinct links with
    how often they occur; ``row`` tells rows of one id apart, once this is written."""
    kind, size_b = docs.schema["doc_id"].dataType.simpleString(), both.sizes()[1]
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in parts(texts):
                x, k = both.aligned(texts[lo:hi]), hi - lo
                digests = both.digests(x)
                cuts, codes, times = links_of(x.a, x.b, x.m, x.n, np.repeat(np.arange(k), x.n_groups), k, size_b)
                upto = np.concatenate([[0], np.cumsum(times)])
                numbers = [np.arange(row, row + k), x.n_a, x.n_b, x.n_groups, upto[cuts[1:]] - upto[cuts[:-1]]]
                ints = [pa.array(np.asarray(x, np.int64)) for x in numbers]
                offsets = pa.array(cuts, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(codes)), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([ints[0], batch.column(0).slice(lo, k), *ints[1:], pa.array(digests, pa.string()), *lists], names)
                row += k

    return docs.select("doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>, times array<int>")


def link_counts(linked: DataFrame, size_b: int) -> DataFrame:
    """Per link its ``count`` of rows that hold it, and whether that is the highest of its first id, ties included."""
    counts = linked.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("count"))
    counts = counts.withColumn("a", F.expr(f"link div {size_b}"))
    # one row for each id of the first vocabulary
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), "a").select("link", "count", (F.col("count") == F.col("highest")).alias("best"))


def frequent(counts: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The links of the highest counts, ``most`` at most by classes of an eighth of a power of two, and whether these are all."""
    level = F.floor(8 * F.log2("count"))
    classes = {r.level: r.n for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    least, room = None, most
    for k in sorted(classes, reverse=True):
        room -= classes[k]
        if room < 0:
            break
        least = k
    return counts.where(level >= least) if least is not None else counts.limit(0), room >= 0


def sums_of_links(linked: DataFrame, counts: DataFrame, most: int = MOST_SHARED) -> DataFrame:
    """Per ``row``: the links that are the best of their first id, and the sum of the counts of all links."""
    top, complete = frequent(counts, most)
    shared = top.toArrow()
    order = np.argsort(shared["link"].to_numpy())
    known = linked.sparkSession.sparkContext.broadcast([shared[c].to_numpy()[order] for c in ("link", "count", "best")])
    kept = [c for c in linked.columns if c not in ("links", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, count, best = known.value
        for batch in batches:
            lists, times = batch.column("links"), batch.column("times").flatten().to_numpy().astype(np.int64)
            cuts, codes = np.asarray(lists.offsets, np.int64), lists.flatten().to_numpy()
            cuts = cuts - cuts[0]
            at = np.minimum(np.searchsorted(link, codes), max(0, len(link) - 1))
            hit = link[at] == codes if len(link) else np.zeros(len(codes), bool)
            at = np.where(hit, at, 0)
            added = [np.concatenate([[0], np.cumsum(x)]) for x in ((times * (hit & best[at]), times * np.where(hit, count[at], 0)) if len(link) else (times * 0, times * 0))]
            sums = [pa.array(x[cuts[1:]] - x[cuts[:-1]], pa.int64()) for x in added]
            missed = pa.array(np.concatenate([[0], np.cumsum(~hit)])[cuts], pa.int32())
            rest = [pa.ListArray.from_arrays(missed, pa.array(x[~hit])) for x in (codes, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *sums, *rest], [*kept, "n_best", "count_sum", "links", "times"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in linked.select(*kept).schema) + ", n_best long, count_sum long, links array<long>, times array<long>"
    out = linked.mapInArrow(run, schema)
    if complete:
        return out.drop("links", "times")
    out = materialize(out, "align-sums")
    rest = out.select("row", F.explode(F.arrays_zip("links", "times")).alias("x")).select("row", "x.links", "x.times").withColumnRenamed("links", "link")
    more = rest.join(counts, "link").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_sum"))
    both = out.drop("links", "times").join(more, "row", "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_best", "more_sum")


def op13_token_alignment(docs: DataFrame, byte_level: str, pieces: str, most_shared: int = MOST_SHARED) -> DataFrame:
    """Per document the numbers of ids, groups and links of both tokenizers, the links that are best of their first id,
    the sum of the links' counts, and the digest of the groups (empty without tokens)."""
    both = Tokenizers(byte_level, pieces)
    linked = materialize(linked_documents(docs, both), "align-links")
    counts = materialize(link_counts(linked, both.sizes()[1]), "align-counts")
    return sums_of_links(linked, counts, most_shared).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
