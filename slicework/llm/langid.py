"""Languages of multilingual texts by mixture inference.

Every word of a text is drawn from one of the learned languages; its likelihood in each comes from the letter
trigrams of the word. Expectation-maximisation estimates the text's language proportions. Then the sets made
of its strongest language, its two strongest and so on are refitted, as long as one more language raises the
text's likelihood by more than the penalty for it (two are always tried); other sets than these are not. Texts are
handled together for speed alone: none is read into the next one, and each stops by itself, so a text's row is the
same wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicework.llm.shared import unsigned_crc32

#: Trigrams of bytes are hashed to so many buckets; bounds the model at that many numbers for each language.
BUCKETS = 1 << 16
#: Added to each count.
ALPHA = 0.05
EM_STEPS, REFIT_STEPS = 8, 4
#: Loss of log-likelihood for each language more, times the logarithm of the number of words.
PENALTY = 2.0
#: Bytes handled together, over the number of languages.
CHUNK = 2_000_000

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 0x80 or 65 <= c <= 90 or 97 <= c <= 122 else 0x20 for c in range(256))


def _letters(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case and blanks for other ASCII than letters, single and at both ends."""
    return b" " + b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()) + b" "


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of folded texts, a blank put after each: the bytes, the bucket of the trigram at each byte but the last two, and
    where the trigrams of each text end. A text's last one begins at its last letter."""
    stream = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    s = stream.astype(np.uint32)
    code = (s[:-2] << np.uint32(16)) | (s[1:-1] << np.uint32(8)) | s[2:]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 2
    return stream, ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), ends


def trigram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``bucket``, ``n`` over all rows with a language and a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[bytes]] = {}
            size = 0

            def settle(by=by) -> None:
                for g, parts in by.items():
                    _, buckets, ends = _trigrams(parts)
                    across = np.concatenate([ends, ends + 1])  # begin at a text's last blank and at the one put after it
                    n = np.bincount(np.delete(buckets, across[across < len(buckets)]), minlength=BUCKETS)
                    sums[g] = sums[g] + n if g in sums else n
                by.clear()

            for t, g in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own = _letters(t.as_py())
                if len(own) > 2:
                    by.setdefault(g, []).append(own)
                    size += len(own)
                if size > CHUNK:
                    settle()
                    size = 0
            settle()
        for g, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [g] * len(at), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    rows = docs.where(F.col(lang).isNotNull()).select(text, lang).mapInArrow(run, "lang string, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def log_likelihoods(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probability of each bucket (rows) in each language (columns)."""
    t = counts.toArrow()
    langs = sorted(set(t["lang"].to_pylist()))
    table = np.full((BUCKETS, len(langs)), ALPHA)
    place = {g: i for i, g in enumerate(langs)}
    table[t["bucket"].to_numpy(), [place[g] for g in t["lang"].to_pylist()]] += t["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _em(p: np.ndarray, cuts: np.ndarray, sizes: np.ndarray, share: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        r = p * np.repeat(share, sizes, axis=0)
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        share = np.add.reduceat(r, cuts, axis=0) / sizes[:, None]
    return share


def infer(texts: list[bytes], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty folded texts, the shares of the chosen languages (0 for the others), and the number chosen."""
    stream, buckets, ends = _trigrams(texts)
    space = stream == 0x20
    first = np.flatnonzero(space[:-1] & ~space[1:])  # a word's trigrams begin with the blank before it
    cuts = np.searchsorted(first, np.concatenate([[0], ends[:-1] + 2]))
    sizes = np.diff([*cuts, len(first)])
    until = np.append(first[1:], 0)
    until[cuts + sizes - 1] = ends  # a text's last word has no next one to end at
    log_p = model[np.append(buckets, 0)]  # one row more, for the last end
    words = np.add.reduceat(log_p, np.stack([first, until], axis=1).ravel(), axis=0)[::2].astype(np.float64)
    p = np.exp(words - words.max(axis=1, keepdims=True))
    k = p.shape[1]
    share = _em(p, cuts, sizes, np.full((len(texts), k), 1 / k), EM_STEPS)
    order = np.argsort(-share, axis=1, kind="stable")
    best, chosen, number = np.full(len(texts), -np.inf), np.zeros_like(share), np.ones(len(texts), np.int64)
    going = np.arange(len(texts))  # texts whose last language was worth it
    for m in range(1, k + 1):
        some = np.zeros((len(going), k))
        np.put_along_axis(some, order[going, :m], np.maximum(np.take_along_axis(share[going], order[going, :m], 1), 1e-3), 1)
        some /= some.sum(axis=1, keepdims=True)
        some = _em(p, cuts, sizes, some, REFIT_STEPS) if m > 1 else some
        each = np.log(np.maximum((p * np.repeat(some, sizes, axis=0)).sum(axis=1), 1e-300))
        value = np.add.reduceat(each, cuts) - PENALTY * (m - 1) * np.log(sizes + 1)
        better = value > best[going]
        at = going[better]
        best[at], chosen[at], number[at] = value[better], some[better], m
        stay = better if m > 1 else np.ones(len(going), bool)
        if not stay.any():
            break
        if not stay.all():
            p, sizes, going = p[np.repeat(stay, sizes)], sizes[stay], going[stay]
            cuts = np.cumsum(sizes) - sizes
    return chosen, number


def predict_languages(docs: DataFrame, langs: list[str], model: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``lang_pred``, ``score`` (its share of the words) and ``languages``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Whole texts of any length
    count; equal texts get equal values, and repeated rows stay. Columns of the input with these names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((langs, model))
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score", "languages")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, model = shared.value
        letter = regex.compile(r"\p{L}")
        for b in batches:
            raw = b.column(text)
            pred, score, sets = ["und"] * len(raw), [0.0] * len(raw), [""] * len(raw)
            some: list[tuple[int, bytes]] = []

            def settle(some=some, pred=pred, score=score, sets=sets) -> None:
                if some and langs:
                    shares, number = infer([t for _, t in some], model)
                    for (i, _), row, m in zip(some, shares, number, strict=True):
                        order = np.argsort(-row, kind="stable")[:m]
                        pred[i], score[i] = langs[order[0]], float(min(1.0, row[order[0]]))
                        sets[i] = ",".join(langs[j] for j in order)
                some.clear()

            size = 0
            for i, t in enumerate(raw):
                t = t.as_py()
                if t and letter.search(t):
                    own = _letters(t)
                    if len(own) > 2:
                        some.append((i, own))
                        size += len(own)
                if size > CHUNK // max(1, len(langs)):
                    settle()
                    size = 0
            settle()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(pred), pa.array(score), pa.array(sets)], [*keep, "lang_pred", "score", "languages"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double, languages string"])
    return docs.mapInArrow(run, schema)


def op7_language_mixture(docs: DataFrame) -> DataFrame:
    """Learn from three quarters of the labelled documents and predict for all.

    A null doc_id counts as the text ``null`` for the split.
    """
    slim = docs.select("doc_id", "text", "lang", (unsigned_crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 4 == 2).alias("held_out"))
    langs, model = log_likelihoods(trigram_counts(slim.where(~F.col("held_out"))))
    return predict_languages(slim.select("doc_id", "held_out", "text"), langs, model)
