"""Removal of byte strings that repeat across documents, by suffix arrays.

Each string of ``length`` bytes has a key that only its bytes decide: the least hash of the 16-byte grams in it (of equal
grams the first counts). It also has an anchor, that gram and the 16 bytes beside it, on the side where the string has more. So equal
strings meet under one key, and a document is a row of segments: runs of strings of one key. Strings whose anchor one document
alone holds go first: in a large corpus most grams are in several documents by chance, 32 bytes hardly are. Segments
of the others are brought together by key; equal segments are one, with the smallest
document that holds it. Of different segments under one key, what lies between the first and the last string that another
has too, by hashes of the strings, is put in one suffix array, where equal strings are neighbours. Each string's
smallest document then goes back to all documents that hold it.

Distinct texts are kept in a bucketed table of blocks of some megabytes, so texts are shuffled once, and only what a block
holds once, whatever its number of copies, is sent out. Anchors go out as 32 bits within their part, and a bit for each
comes back, as a block's order of anchors is its own: a chance hit only sends more. Strings whose anchor many blocks hold (``HOT_BLOCKS``)
have keys of their own, so no anchor gathers more than a string a block under one key. Segments are equal when their key and a second
64-bit hash are. The shuffles behind a written table are removed with its writing, not when the driver happens to collect its garbage.

Texts are UTF-8; null is empty. A null doc_id counts as larger than all others. Rows of one doc_id are never repeats of each other.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicework.llm.shared import materialize, shared_root, shuffles_removed
from slicework.llm.suffixes import suffix_array

#: Bytes of a repeat, and of the gram whose hash is the key.
LENGTH, GRAM = 50, 16
#: Bytes of a block of texts, keys of a part, blocks that an anchor's strings may be sent from as a whole.
BLOCK, PART, HOT_BLOCKS = 4 << 20, 2_000_000, 4096
#: Bytes that one suffix array takes, bytes of contents that are compared at once; strings that are hashed at once, so that
#: a place among their grams has 16 bits.
TOGETHER, SEARCHED, CHUNK = 1 << 14, 1 << 22, (1 << 16) - LENGTH
U, MIX = np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
NO_ID = (1 << 63) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(MIX[1])
    x = (x ^ (x >> U(27))) * U(MIX[2])
    return x ^ (x >> U(31))


def gram_hashes(buf: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the 16 bytes at each position, or at the given ones; ``buf`` is contiguous."""
    low = np.ndarray((len(buf) - 7,), "<u8", buffer=buf.data, strides=(1,)) if len(buf) >= GRAM else np.zeros(8, U)
    a, b = (low[: len(buf) - GRAM + 1], low[8 : len(buf) - GRAM + 9]) if at is None else (low[at], low[at + 8])
    x = a * U(MIX[0]) ^ (b * U(MIX[2]))
    x ^= x >> U(29)
    x *= U(MIX[1])
    return x ^ (x >> U(32))


def joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a block as bytes, and their offsets."""
    column = table.column("text").combine_chunks()
    column = (column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)).cast(pa.large_binary())
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.ascontiguousarray(raw[offsets[0] : offsets[-1]]), offsets - offsets[0]


def runs(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of one key and anchor: key, hash of the anchor, first position, number of strings, text."""
    found, places = [], np.arange(CHUNK + LENGTH - GRAM, dtype=U)
    for lo in range(0, len(buf) - LENGTH + 1, CHUNK):
        grams = gram_hashes(buf[lo : lo + CHUNK + LENGTH - 1])
        # the place decides between equal grams, and tells where the least one is
        h = grams & ~U(0xFFFF)
        h |= places[: len(h)]
        width, span = LENGTH - GRAM + 1, 1
        while 2 * span <= width:
            h, span = np.minimum(h[:-span], h[span:]), 2 * span
        if width > span:
            h = np.minimum(h[: len(h) - (width - span)], h[width - span :])
        new = np.ones(len(h), bool)
        np.not_equal(h[1:], h[:-1], out=new[1:])
        # a text begins a run of its own
        new[cuts[np.searchsorted(cuts, lo) : np.searchsorted(cuts, lo + len(h))] - lo] = True
        at = np.flatnonzero(new)
        end, gram = np.append(at[1:], len(h)), (h[at] & U(0xFFFF)).astype(np.int64)
        # first the strings with half or more of the other bytes before the gram, then the rest
        turn = np.clip(gram - (LENGTH - GRAM) // 2, at, end)
        start, stop = np.stack([at, turn], 1).ravel(), np.stack([turn, end], 1).ravel()
        anchor, gram = np.stack([gram - GRAM, gram], 1).ravel(), np.repeat(gram, 2)
        text = np.searchsorted(cuts, start + lo, "right") - 1
        n = np.minimum(stop, cuts[text + 1] - LENGTH + 1 - lo) - start
        some = n > 0
        anchor, gram, start, n, text = anchor[some], gram[some], start[some], n[some], text[some]
        if not len(n):
            continue
        key, anchor = grams[gram], mixed(grams[anchor] * U(MIX[0]) + grams[anchor + GRAM])
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
        found.append((key[first], anchor[first], start[first] + lo, np.add.reduceat(n, first), text[first]))
    if not found:
        return np.zeros(0, U), np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def codes(anchor: np.ndarray, parts: int) -> np.ndarray:
    """The part of each anchor, and 32 other bits of it."""
    return ((anchor & U(0xFFFFFFFF)) % U(parts)) << U(32) | anchor >> U(32)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def content_hashes(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes that is independent of the keys: bytes weighed by their place."""
    if not len(start):
        return np.zeros(0, U)
    at = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(at, size)
    weight = mixed((np.arange(size.max(), dtype=U) + U(1)) * U(MIX[0])) | U(1)
    return mixed(np.add.reduceat((buf[ranges(start, size)].astype(U) + U(1)) * weight[place], at) + size.astype(U))


class Entries:
    """The distinct segments of a block under anchors that other documents hold too, in an order that only the block decides."""

    def __init__(self, buf: np.ndarray, cuts: np.ndarray, ids: np.ndarray, parts: int, masks: list[tuple[int, bytes, bytes]]):
        key, anchor, start, n, text = runs(buf, cuts)
        code, of = np.unique(codes(anchor, parts), return_inverse=True)
        edges = np.searchsorted(code >> U(32), np.array([p for p, _, _ in masks], U)[:, None] + np.array([0, 1], U))
        keep, hot = np.zeros(len(code), bool), np.zeros(len(code), bool)
        for (a, b), (_, k, h) in zip(edges.tolist(), masks):
            keep[a:b] = np.unpackbits(np.frombuffer(k, np.uint8), count=b - a)
            if h:
                hot[a:b] = np.unpackbits(np.frombuffer(h, np.uint8), count=b - a)
        known = keep[of]
        key, start, n, text, burst = key[known], start[known], n[known], text[known], hot[of[known]]
        # strings of hot anchors stand alone
        single = ranges(start[burst], n[burst])
        of = np.repeat(text[burst], n[burst])
        key, start, n, text, burst = key[~burst], start[~burst], n[~burst], text[~burst], content_hashes(buf, single, np.full(len(single), LENGTH))
        # runs of one key that follow each other are one segment
        if len(n):
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + n[:-1])]))
            key, start, n, text = key[first], start[first], np.add.reduceat(n, first), text[first]
        key, start, n, text = (np.concatenate(x) for x in ((key, burst), (start, single), (n, np.ones(len(single), np.int64)), (text, of)))
        size = n + LENGTH - 1
        content = content_hashes(buf, start, size)
        order = np.lexsort((ids[text], content, key))
        self.key, self.start, self.n, self.text = key[order], start[order], n[order], text[order]
        content = content[order]
        first = np.ones(len(order), bool)
        first[1:] = (self.key[1:] != self.key[:-1]) | (content[1:] != content[:-1])
        self.entry = np.cumsum(first) - 1
        self.first = np.flatnonzero(first)


def smallest_of_strings(contents: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """Of contents, the smallest document of each string of ``LENGTH`` bytes in any of them, by one suffix array."""
    size = np.array([len(c) + 1 for c in contents])
    text = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    ends = np.cumsum(size)
    inner = np.ones(len(text), bool)
    inner[ends - 1] = False
    order = suffix_array(np.append(np.where(inner, text.astype(np.int64) + 2, 1), 0))
    of = np.repeat(np.arange(len(contents)), size)
    fits = np.append(np.arange(len(text)) + LENGTH <= np.repeat(ends, size) - 1, False)
    order = order[fits[order]]
    strings = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[order]
    first = np.ones(len(order), bool)
    first[1:] = (strings[1:] != strings[:-1]).any(axis=1)
    least = np.minimum.reduceat(docs[of[order]], np.flatnonzero(first))[np.cumsum(first) - 1]
    out = np.empty(len(text), np.int64)
    out[order] = least
    begin = ends - size
    return [out[b : b + len(c) - LENGTH + 1] for b, c in zip(begin.tolist(), contents)]


def whole_keys(keys: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole keys, as many as have ``most`` bytes together, one at least."""
    edges = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]])) + 1 if len(keys) else np.zeros(0, np.int64)
    upto, lo = np.concatenate([[0], np.cumsum(sizes)[edges - 1]]) if len(keys) else None, 0
    while lo < len(edges):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1)
        yield (int(edges[lo - 1]) if lo else 0), int(edges[hi - 1])
        lo = hi


def shared_range(contents: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each content the first string that another content of its key may have too, by a hash, and the last; none: -1."""
    size = np.array([len(c) for c in contents], np.int64)
    h, begin, n = gram_hashes(np.frombuffer(b"".join(contents), np.uint8)), np.cumsum(size) - size, size - LENGTH + 1
    at, of = ranges(begin, n), np.repeat(np.arange(len(contents)), n)
    string = keys[of]
    for step in (0, GRAM, 2 * GRAM, LENGTH - GRAM):
        string = mixed(string * U(MIX[0]) + h[at + step])
    order = np.argsort(string, kind="stable")
    string, by = string[order], of[order]
    new = np.flatnonzero(np.concatenate([[True], string[1:] != string[:-1]]))
    met = np.maximum.reduceat(by, new) > np.minimum.reduceat(by, new)
    both = np.zeros(len(at), bool)
    both[order] = np.repeat(met, np.diff(np.append(new, len(at))))
    place = at - begin[of]
    first = np.minimum.reduceat(np.where(both, place, len(h)), np.cumsum(n) - n)
    last = np.maximum.reduceat(np.where(both, place, -1), np.cumsum(n) - n)
    return np.where(last < 0, -1, first), last


def shared_strings(contents: list[bytes], keys: np.ndarray, docs: np.ndarray) -> dict[int, np.ndarray]:
    """Of distinct contents in order of their keys: for those that share strings with others, each string's smallest document."""
    out: dict[int, np.ndarray] = {}
    like = np.concatenate([[False], keys[1:] == keys[:-1], [False]])
    several = np.flatnonzero(like[1:] | like[:-1])
    size = np.array([len(contents[i]) for i in several.tolist()], np.int64)
    first, last = np.full(len(several), -1), np.full(len(several), -1)
    for a, b in whole_keys(keys[several], size, SEARCHED):
        first[a:b], last[a:b] = shared_range([contents[i] for i in several[a:b].tolist()], keys[several[a:b]])
    some = last >= 0
    several, first, last = several[some], first[some], last[some]
    for a, b in whole_keys(keys[several], last - first + LENGTH, TOGETHER):
        own = list(zip(several[a:b].tolist(), first[a:b].tolist(), last[a:b].tolist()))
        least = smallest_of_strings([contents[i][x : y + LENGTH] for i, x, y in own], docs[several[a:b]])
        for (i, x, y), found in zip(own, least):
            out[i] = np.full(len(contents[i]) - LENGTH + 1, docs[i])
            out[i][x : y + 1] = found
    return out


def _bytes(table: pa.Table, column: str) -> list[bytes]:
    return table.column(column).to_pylist()


def _keys_of_block(parts: int):
    def run(table: pa.Table) -> pa.Table:
        buf, cuts = joined(table)
        _, anchor, _, _, text = runs(buf, cuts)
        code = codes(anchor, parts)
        order = np.lexsort((text, code))
        code, text = code[order], text[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        many = np.maximum.reduceat(text, first) > text[first] if len(first) else np.zeros(0, bool)
        code = code[first]
        part, key = (code >> U(32)).astype(np.int64), (code & U(0xFFFFFFFF)).astype("<u4")
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
        block = table.column("block")[0].as_py() if table.num_rows else 0
        rows = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
        return pa.table({"part": pa.array([int(part[a]) for a, _ in rows], pa.int64()), "block": pa.array([block] * len(rows), pa.int64()), "keys": pa.array([key[a:b].tobytes() for a, b in rows], pa.binary()), "many": pa.array([np.packbits(many[a:b]).tobytes() for a, b in rows], pa.binary())})

    return run


def _repeated_keys(table: pa.Table, hot_blocks: int) -> pa.Table:
    """Which anchors of a part two documents hold, back to their blocks as bits in their order; and which of them many blocks hold."""
    keys = [np.frombuffer(x, "<u4") for x in _bytes(table, "keys")]
    many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(_bytes(table, "many"), keys)]
    cut = np.cumsum([0, *(len(k) for k in keys)])
    key, many = np.concatenate(keys), np.concatenate(many)
    _, of, n = np.unique(key, return_inverse=True, return_counts=True)
    keep = (n[of] > 1) | (np.bincount(of, many)[of] > 0)
    hot = keep & (n[of] > hot_blocks)
    rows = [i for i in range(len(keys)) if keep[cut[i] : cut[i + 1]].any()]
    bits = lambda x, i: np.packbits(x[cut[i] : cut[i + 1]]).tobytes()
    return pa.table({"part": table.column("part").take(pa.array(rows, pa.int64())), "block": table.column("block").take(pa.array(rows, pa.int64())), "keys": pa.array([bits(keep, i) for i in rows], pa.binary()), "hot": pa.array([bits(hot, i) if hot[cut[i] : cut[i + 1]].any() else b"" for i in rows], pa.binary())})


def _entries(left: pa.Table, parts: int, masks: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Entries]:
    buf, cuts = joined(left)
    ids = left.column("first").to_numpy()
    return buf, cuts, ids, Entries(buf, cuts, ids, parts, masks)


def _segments_of_block(parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        buf, _, ids, e = _entries(left, parts, list(zip(right.column("part").to_pylist(), _bytes(right, "keys"), _bytes(right, "hot"))))
        part = (mixed(e.key[e.first]) % U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at, part = e.first[order], part[order]
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
        block = left.column("block")[0].as_py() if left.num_rows else 0
        out: dict[str, list] = {c: [] for c in ("part", "block", "keys", "docs", "sizes", "bytes")}
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own, size = at[a:b], e.n[at[a:b]] + LENGTH - 1
            for c, x in zip(out, (int(part[a]), block, e.key[own].tobytes(), ids[e.text[own]].tobytes(), size.astype(np.int32).tobytes(), buf[ranges(e.start[own], size)].tobytes())):
                out[c].append(x)
        return pa.table({c: pa.array(x, pa.int64() if c in ("part", "block") else pa.binary()) for c, x in out.items()})

    return run


def _smallest_documents(table: pa.Table) -> pa.Table:
    """Of the segments of a part, for each block: runs of strings and the smallest document of each run."""
    keys, docs, sizes, data = (_bytes(table, c) for c in ("keys", "docs", "sizes", "bytes"))
    known: dict = {}
    content, least, key_of, per_row = [], [], [], []
    for k, d, s, raw in zip(keys, docs, sizes, data):
        at, own = 0, []
        for key, doc, size in zip(np.frombuffer(k, U).tolist(), np.frombuffer(d, np.int64).tolist(), np.frombuffer(s, np.int32).tolist()):
            piece = raw[at : at + size]
            at += size
            i = known.setdefault((key, piece), len(content))
            if i == len(content):
                content.append(piece)
                least.append(doc)
                key_of.append(key)
            elif doc < least[i]:
                least[i] = doc
            own.append(i)
        per_row.append(np.array(own, np.int64))
    known.clear()
    key_of, least = np.array(key_of, U), np.array(least, np.int64)
    order = np.argsort(key_of, kind="stable")
    found = shared_strings([content[i] for i in order.tolist()], key_of[order], least[order])
    runs, values = np.ones(len(content), np.int64), {}
    for i, docs_of in found.items():
        values[int(order[i])] = docs_of
    lens, mins = [np.array([len(c) - LENGTH + 1]) for c in content], [least[i : i + 1] for i in range(len(content))]
    for i, x in values.items():
        new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        lens[i], mins[i], runs[i] = np.diff(np.append(new, len(x))), x[new], len(new)
    lens, mins = np.concatenate(lens or [[]]).astype(np.int32), np.concatenate(mins or [[]]).astype(np.int64)
    cut = np.cumsum(runs) - runs
    got = [ranges(cut[own], runs[own]) for own in per_row]
    return pa.table({"part": table.column("part"), "block": table.column("block"), "keys": pa.array([lens[x].tobytes() for x in got], pa.binary()), "hot": pa.array([mins[x].tobytes() for x in got], pa.binary())})


def _cut_block(parts: int, spans: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        part = right.column("part").to_pylist()
        data = list(zip(part, _bytes(right, "keys"), _bytes(right, "hot")))
        # parts below zero are those of anchors
        buf, cuts, ids, e = _entries(left, parts, [(-1 - p, k, h) for p, k, h in data if p < 0])
        results = sorted((p, k, h) for p, k, h in data if p >= 0)
        n = e.n[e.first]
        order = np.argsort((mixed(e.key[e.first]) % U(parts)).astype(np.int64), kind="stable")
        lens = np.concatenate([np.frombuffer(k, np.int32) for _, k, _ in results] or [np.zeros(0, np.int32)])
        mins = np.concatenate([np.frombuffer(h, np.int64) for _, _, h in results] or [np.zeros(0, np.int64)])
        least = np.repeat(mins, lens)
        begin = np.empty(len(n), np.int64)
        begin[order] = np.cumsum(n[order]) - n[order]
        gone = least[ranges(begin[e.entry], e.n)] < np.repeat(ids[e.text], e.n)
        at = ranges(e.start, e.n)[gone]
        depth = np.zeros(len(buf) + 1, np.int32)
        depth[at] += 1
        depth[at + LENGTH] -= 1
        covered = np.cumsum(depth)[:-1] > 0
        rise = covered.copy()
        rise[1:] &= ~covered[:-1]
        inner = cuts[1:-1][cuts[1:-1] < len(buf)]
        rise[inner] = covered[inner]
        upto, risen = (np.concatenate([[0], np.cumsum(x)]) for x in (covered, rise))
        kept, digests = buf[~covered].tobytes(), left.column("digest").to_pylist()
        edges = cuts - upto[cuts]
        out: dict = {"digest": left.column("digest"), "first": left.column("first"), "n_removed": pa.array(np.diff(upto[cuts]), pa.int64()), "n_spans": pa.array(np.diff(risen[cuts]), pa.int64())}
        removed = np.diff(upto[cuts])
        if spans:
            fall = covered.copy()
            fall[:-1] &= ~covered[1:]
            fall[cuts[1:][cuts[1:] > 0] - 1] = covered[cuts[1:][cuts[1:] > 0] - 1]
            begins, ends = np.flatnonzero(rise), np.flatnonzero(fall) + 1
            base = cuts[np.searchsorted(cuts, begins, "right") - 1]
            offsets = pa.array(risen[cuts], pa.int32())
            out |= {"begins": pa.ListArray.from_arrays(offsets, pa.array(begins - base)), "ends": pa.ListArray.from_arrays(offsets, pa.array(ends - base))}
        out["kept"] = pa.array([hashlib.sha256(kept[a:b]).digest() if r else d for a, b, r, d in zip(edges[:-1].tolist(), edges[1:].tolist(), removed.tolist(), digests)], pa.binary())
        return pa.table(out)

    return run


def _first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts once in each task; later copies only where their document is smaller, and without the text."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        keep, bare = [], []
        for i, (digest, doc) in enumerate(zip(batch.column("digest").to_pylist(), batch.column("first").to_pylist())):
            if (old := seen.get(digest)) is None or doc < old:
                seen[digest] = doc
                keep.append(i)
                bare.append(old is not None)
        part = batch.take(pa.array(keep, pa.int64()))
        text = pa.array([None if b else t for b, t in zip(bare, part.column("text").to_pylist())], pa.string()) if any(bare) else part.column("text")
        yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("first"), text], ["digest", "first", "text"])


def repeated_spans(docs: DataFrame, spans: bool = True, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """Of each distinct text of ``docs`` (``doc_id`` of an integer type, ``text``): its SHA-256 ``digest``, the smallest document
    ``first`` that has it, and of that document how many bytes go in how many spans, where these begin and end
    (``spans``), and the SHA-256 ``kept`` of the rest. Later copies go whole if they have ``LENGTH`` bytes.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("first"), text.alias("text"))
    with shuffles_removed(spark):
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(-(-size // (4 * BLOCK)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks, parts = max(-(-size // BLOCK), 4 * buckets), max(-(-size // (18 * PART)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = min(buckets, 50_000)
    once = rows.mapInArrow(_first_in_task, "digest binary, first long, text string").withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks)))
    texts = once.repartition(buckets, "block").groupBy("block", "digest").agg(F.min("first").alias("first"), F.first("text", ignorenulls=True).alias("text"))
    name = f"texts_{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        texts.write.format("parquet").bucketBy(buckets, "block").sortBy("block").option("compression", "zstd").option("path", f"{shared_root(spark)}/{name}").saveAsTable(name)
    texts = spark.table(name)
    keys = texts.select("block", "text").groupBy("block").applyInArrow(_keys_of_block(parts), "part long, block long, keys binary, many binary")
    with shuffles_removed(spark):
        repeated = materialize(keys.groupBy("part").applyInArrow(lambda table: _repeated_keys(table, hot_blocks), "part long, block long, keys binary, hot binary"), "repeated-keys")
    sent = texts.select("block", "first", "text").groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_segments_of_block(parts), "part long, block long, keys binary, docs binary, sizes binary, bytes binary")
    least = sent.groupBy("part").applyInArrow(_smallest_documents, "part long, block long, keys binary, hot binary")
    back = repeated.withColumn("part", F.lit(-1) - F.col("part")).unionByName(least)
    lists = "begins array<long>, ends array<long>, " if spans else ""
    return texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_cut_block(parts, spans), f"digest binary, first long, n_removed long, n_spans long, {lists}kept binary")


def op12_lyndon_repeats(docs: DataFrame, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """Per document its bytes, how many of them go in how many runs, and the digest of the rest. Other columns are ignored."""
    found = repeated_spans(docs, spans=False, hot_blocks=hot_blocks)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    copy = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) > F.col("first")
    whole = copy & (F.col("n_bytes") >= LENGTH)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.join(found, "digest").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).when(copy, F.lit(0)).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).when(copy, F.lit(0)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.lower(F.hex(F.when(copy, F.col("digest")).otherwise(F.col("kept"))))).alias("kept_sha256"),
    )
