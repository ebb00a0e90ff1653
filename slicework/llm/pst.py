"""Probabilistic suffix tree over the bytes of texts.

Contexts of up to DEPTH bytes are counted over all training texts. A context becomes a state if it is frequent
enough to be believed and its next-symbol distribution diverges from that of its longest proper suffix. A
state's distribution is smoothed with its suffix's, down to the uniform one over 256 bytes. A text is scored by
the longest suffix state before each byte; the tree is unfolded into an automaton, so that many stretches of
text take each step together.

Symbols are the bytes of a text's words (A-Z in lower case) with one blank between words, then a line feed as
the end, which no word has: so the probabilities of all texts add up to one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slicework.llm.shared import materialize, unsigned_crc32

DEPTH = 6
#: Contexts up to this length are counted at all positions; longer ones where their parts of this length and one more are frequent.
SHALLOW = 4
#: A context is at least this share of all positions: so at most 1 / LEAST_SHARE contexts of each length.
LEAST_SHARE = 1e-5
#: Least divergence from the suffix's distribution, in nats over all of the context's occurrences.
LEAST_DIVERGENCE = 10.0
#: Weight of the suffix's distribution, as so many observations.
PRIOR = 2.0
#: Bound of the table of words whose counts are sent to all tasks; other words are looked up by a join.
MAX_WORDS = 1 << 18
END, NOTHING = 0x0A, 0x09
CHUNK = 1_500_000
LANES = 8192
#: Sums that a task holds before it sends them on.
MOST_SUMS = 1_500_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct words of ``docs`` and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        table = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(seen.values(), pa.int64())})
        for b in batches:
            for t in b.column(0):
                seen.update(tokens(t.as_py()))
                if len(seen) > 400_000:
                    yield table()
                    seen.clear()
        yield table()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _codes(stream: np.ndarray, depth: int) -> np.ndarray:
    """For each byte but the first, the context of up to ``depth`` bytes before it and itself, as one integer.

    A context reaches back to the last END at most; NOTHING fills it up.
    """
    padded = np.concatenate([np.full(depth - 1, NOTHING, np.uint8), stream])
    n = len(stream) - 1
    code = np.zeros(n, np.int64)
    cut = np.zeros(n, bool)
    for k in range(depth):  # from the nearest byte outwards
        at = padded[depth - 1 - k : depth - 1 - k + n].astype(np.int64)
        code |= np.where(cut, NOTHING, at) << (8 * (k + 1))
        cut |= at == END
    return code | stream[1:]


def _filter_slots(grams: np.ndarray) -> np.ndarray:
    return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)


def context_counts(docs: DataFrame, depth: int, frequent: np.ndarray | None = None, text: str = "text") -> DataFrame:
    """``gram`` (bytes of context and next symbol as an integer) and ``n``, over all texts.

    With ``frequent`` (all frequent strings of SHALLOW + 1 bytes) only contexts whose parts of that length are all
    frequent are counted, for no other can be; a few more slip through the filter and do no harm.
    """
    wide = SHALLOW + 1
    shared = None if frequent is None else docs.sparkSession.sparkContext.broadcast(frequent)

    def kept(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Codes whose nearest part is frequent, cut to the longest context of frequent parts."""
        mask = np.int64((1 << 8 * wide) - 1)
        own = codes[known[_filter_slots(codes >> 8 & mask)]]
        for k in range(1, depth - SHALLOW):
            far = known[_filter_slots(own >> (8 * (k + 1)) & mask)]
            short = own & np.int64((1 << 8 * (wide + k)) - 1)
            fill = sum(NOTHING << 8 * j for j in range(wide + k, depth + 1))
            own = np.where(far, own, short | np.int64(fill))
        return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        if shared is not None:
            known = np.zeros(1 << 24, bool)
            known[_filter_slots(shared.value)] = True
        parts, size = [b"\n"], 0
        sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def added() -> tuple[np.ndarray, np.ndarray]:
            """The sums so far and what the pending texts have."""
            codes = _codes(np.frombuffer(b"".join(parts), np.uint8), depth)
            grams, n = np.unique(codes if known is None else kept(codes, known), return_counts=True)
            both, at = np.unique(np.concatenate([sums[0], grams]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([sums[1], n]), len(both)).astype(np.int64)

        for b in batches:
            for t in b.column(0):
                parts += [b" ".join(tokens(t.as_py())), b"\n"]
                size += len(parts[-2]) + 1
                if size > CHUNK:
                    sums = added()
                    parts, size = [b"\n"], 0
                    if len(sums[0]) > MOST_SUMS:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, sums)], ["gram", "n"])
                        sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if size:
            sums = added()
        yield pa.RecordBatch.from_arrays([*map(pa.array, sums)], ["gram", "n"])

    return docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _level(grams: DataFrame, k: int, least: float) -> DataFrame:
    """``context``, ``symbol``, ``n`` and the context's ``all`` for the contexts of ``k`` bytes that occur often enough."""
    own = F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
    whole = F.lit(True) if k == 0 else F.shiftright(own, 8 * k) != NOTHING
    rows = grams.where(whole).groupBy(own.alias("own")).agg(F.sum("n").alias("n"))
    rows = rows.select(F.shiftright("own", 8).alias("context"), F.col("own").bitwiseAND(F.lit(255)).alias("symbol"), "n")
    often = rows.groupBy("context").agg(F.sum("n").alias("all")).where(F.col("all") >= least)
    return materialize(rows.join(often, "context"), f"pst-{k}")


def retained(train: DataFrame, depth: int = DEPTH, share: float = LEAST_SHARE, divergence: float = LEAST_DIVERGENCE) -> DataFrame:
    """Rows ``k`` (length), ``context``, ``symbol``, ``n`` of the contexts that pass both tests, and of the root.

    At most ``1 / share`` contexts of each length pass, whatever the corpus.
    """
    shallow = min(depth, SHALLOW)
    grams = materialize(context_counts(train, shallow), "pst-grams")
    least = max(2.0, share * (grams.agg(F.sum("n")).first()[0] or 0))
    level = [_level(grams, k, least if k else 0.0) for k in range(shallow + 1)]
    if depth > shallow:
        whole = F.shiftright("gram", 8 * shallow) != NOTHING
        frequent = grams.where(whole & (F.col("n") >= least)).select("gram").toArrow()["gram"].to_numpy()  # at most 1 / share
        deep = materialize(context_counts(train, depth, frequent), "pst-grams")
        level += [_level(deep, k, least) for k in range(shallow + 1, depth + 1)]
    out = level[0].select(F.lit(0).alias("k"), "context", "symbol", "n")
    for k in range(1, depth + 1):
        short = level[k - 1].select(F.col("context").alias("suffix"), "symbol", (F.col("n") / F.col("all")).alias("q"))
        rows = level[k].withColumn("suffix", F.col("context").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)))
        gain = F.col("n") * F.ln(F.col("n") / F.col("all") / F.col("q"))
        good = rows.join(short, ["suffix", "symbol"]).groupBy("context").agg(F.sum(gain).alias("gain")).where(F.col("gain") >= divergence)
        out = out.unionByName(level[k].join(good, "context", "left_semi").select(F.lit(k).alias("k"), "context", "symbol", "n"))
    return out


class Automaton:
    """The tree's states with, for each class of symbols, the next state and the log10 probability."""

    def __init__(self, rows: pa.Table, prior: float = PRIOR):
        own: dict[bytes, tuple[list[int], list[int]]] = {}
        for k, context, symbol, n in zip(*(rows[c].to_pylist() for c in ("k", "context", "symbol", "n")), strict=True):
            got = own.setdefault(context.to_bytes(k, "big"), ([], []))
            got[0].append(symbol)
            got[1].append(n)
        states = {b"", b"\n"} | {c[i:j] for c in own for i in range(len(c)) for j in range(i + 1, len(c) + 1)}
        order = sorted(states, key=lambda c: (len(c), c))
        place = {c: i for i, c in enumerate(order)}
        used = sorted({s for got in own.values() for s in got[0]} | {END, *(c[-1] for c in order if c)})
        self.classes = np.full(256, len(used), np.int64)  # the last class: bytes that were never seen
        self.classes[used] = np.arange(len(used))
        width = len(used) + 1
        prob = np.full((len(order), width), 1 / 256)
        self.next = np.zeros((len(order), width), np.int32)
        for i, c in enumerate(order):
            if c:
                prob[i], self.next[i] = prob[place[c[1:]]], self.next[place[c[1:]]]
            if c in own:
                symbols, n = own[c]
                row = np.zeros(width)
                row[self.classes[symbols]] = n
                prob[i] = (row + prior * prob[i]) / (row.sum() + prior)
            # the longest suffix of context and symbol: the suffix's answer, unless the longer one is a state
        children: dict[int, list[tuple[int, int]]] = {}
        for c, i in place.items():
            if c and c[:-1] in place:
                children.setdefault(place[c[:-1]], []).append((int(self.classes[c[-1]]), i))
        for i, c in enumerate(order):
            if c:
                self.next[i] = self.next[place[c[1:]]]
            for s, j in children.get(i, ()):
                self.next[i, s] = j
        self.next[:, self.classes[END]] = place[b"\n"]
        self.log = np.log10(prob).astype(np.float32)
        self.depth = max(map(len, order))
        self.start = place[b"\n"]

    def score(self, stream: np.ndarray) -> np.ndarray:
        """Log10 probability of each byte of a stream that follows an END."""
        s = self.classes[stream]
        lanes = max(1, min(LANES, len(s) // 64))
        length = -(-len(s) // lanes)
        s = np.concatenate([s, np.zeros(lanes * length - len(s), np.int64)])
        begin = np.arange(lanes) * length
        state = np.zeros(lanes, np.int64)
        for j in range(-self.depth, 0):  # a lane's first state follows from the bytes before it
            state = np.where(begin + j >= 0, self.next[state, s[np.maximum(begin + j, 0)]], state)
        state[begin < self.depth] = 0
        for i in np.flatnonzero(begin < self.depth):
            at = self.start
            for x in s[: begin[i]]:
                at = self.next[at, x]
            state[i] = at
        out = np.empty((length, lanes))
        width, nxt, log = self.next.shape[1], self.next.ravel(), self.log.ravel()
        grid = s.reshape(lanes, length).T.copy()
        for j in range(length):
            at = state * width + grid[j]
            out[j] = log[at]
            state = nxt[at].astype(np.int64)
        return out.T.ravel()[: len(stream)]


def op2_suffix_tree(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per document: the base's and the tree's log10 probability of its text.

    Null text is the empty text, whose one token is its end. Repeated rows are scored each. A null doc_id
    counts as the text ``null`` for the split. Without training texts all words are unknown.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text", (unsigned_crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 7 == 2).alias("held_out"))
    train = slim.where(~F.col("held_out"))
    counts = materialize(word_counts(train), "pst-words")
    n_docs = train.select("held_out").count()
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + n_docs, v + (n_docs > 0)
    tree = Automaton(retained(train, depth).toArrow())
    ties = counts.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count(F.lit(1)).alias("words"))
    above = ties.withColumn("words", F.sum("words").over(W.orderBy(F.desc("n"))))
    least = above.where(F.col("words") <= MAX_WORDS).agg(F.min("n")).first()[0]
    known = counts.where(F.col("n") >= F.lit(1 << 62 if least is None else least)).toArrow()
    shared = spark.sparkContext.broadcast((known["word"].to_pylist(), known["n"].to_numpy(), tree))
    every = math.log10(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, freq, tree = shared.value
        logs = dict(zip(names, np.log10(freq + 1.0).tolist(), strict=True))
        for b in batches:
            count, seen, base, score, rare = [], [], [], [], []
            parts, ends = [], []

            def settle(parts=parts, ends=ends, score=score) -> None:
                if parts:
                    each = tree.score(np.frombuffer(b"".join(parts), np.uint8))
                    score += np.add.reduceat(each, np.cumsum([0, *ends])[:-1]).tolist()
                    parts.clear(), ends.clear()

            size = 0
            for t in b.column(1):
                words = tokens(t.as_py())
                got = [logs.get(w) for w in words]
                lost = [w for w, x in zip(words, got, strict=True) if x is None]
                count.append(len(words) + 1)
                seen.append(len(words) - len(lost) + (n_docs > 0))
                base.append(math.fsum(x for x in got if x is not None) + math.log10(n_docs + 1) - every * (len(words) + 1))
                rare.append(lost)
                parts.append(b" ".join(words) + b"\n")
                ends.append(len(parts[-1]))
                size += ends[-1]
                if size > CHUNK:
                    settle()
                    size = 0
            settle()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *map(pa.array, (count, seen, base, score)), pa.array(rare, pa.list_(pa.binary()))], ["doc_id", "held_out", "n_tokens", "seen", "base", "score", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = slim.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, seen long, base double, score double, rare array<binary>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "pst-scores")
    lost = rows.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    found = lost.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("extra"))
    out = rows.drop("rare").join(found, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("extra", F.lit(0.0))).alias("base_score"), "score",
    )
