"""Suffix arrays against sorting, and the removal of repeats against a plain version."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from slicework.llm import repeats, suffixes


def plain(rows, length=50):
    first = {}
    data = [(doc, (text or "").encode()) for doc, text in rows]
    for doc, b in data:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, 1 << 62), (1 << 61) if doc is None else doc)
    out = []
    for doc, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < ((1 << 61) if doc is None else doc):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), bytes(gone).replace(b"\0\1", b"\0\2").count(b"\2") + gone.startswith(b"\1"), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_suffix_array():
    draw = random.Random(1)
    for _ in range(1500):
        s = bytes(draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(draw.randrange(0, 40))) * draw.choice([1, 1, 2, 3])
        x = np.array([*(c + 1 for c in s), 0])
        assert suffixes.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def made():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 9)))
    passages = [" ".join(word() for _ in range(draw.randint(8, 60))) for _ in range(30)]
    texts = [None, "", "short", "a" * 300, "a" * 120, "ab" * 90, "é" * 80, "x" * 49, "y" * 50, "y" * 50, "y" * 51, "abc" * 40 + "abd" * 40]
    for _ in range(150):
        parts = [draw.choice(passages) if draw.random() < 0.5 else " ".join(word() for _ in range(20)) for _ in range(draw.randint(1, 5))]
        text = " ".join(parts)
        cut = draw.randrange(len(text))
        texts += draw.choice([[text], [text, text], [text, text[:cut] + "Q" + text[cut + 1 :]], [text, text[cut:]]])
    ids = draw.sample(range(10_000), len(texts))
    return list(zip(ids, texts)) + [(ids[20], texts[20]), (ids[20], passages[0] + passages[1]), (None, passages[2] + "!"), (None, passages[3])]


@pytest.mark.parametrize("hot", [4096, 1, 0])
def test_repeats_equal_plain(spark, hot):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"first": F.lit(1), "digest": F.lit("x"), "block": F.lit(3)})
    assert found(repeats.op12_lyndon_repeats(df.repartition(5), hot)) == plain(rows)


def test_odd(spark):
    df = spark.createDataFrame([(1, "z" * 60)], "doc_id long, text string")
    assert repeats.op12_lyndon_repeats(df.limit(0)).collect() == []
    assert found(repeats.op12_lyndon_repeats(df)) == plain([(1, "z" * 60)])


def test_spans(spark):
    rows = made()
    spans = {r["first"]: r for r in repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(reversed(rows))
    for doc, n, removed, n_spans, kept in plain(rows):
        if doc in spans and spans[doc].n_removed == removed and doc is not None and [r[0] for r in rows].count(doc) == 1:
            data = (texts[doc] or "").encode()
            cut = [0, *(x for pair in zip(spans[doc].begins, spans[doc].ends) for x in pair), len(data)]
            assert hashlib.sha256(b"".join(data[a:b] for a, b in zip(cut[::2], cut[1::2]))).hexdigest() == kept


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = found(repeats.op12_lyndon_repeats(df))
    assert got == plain([tuple(r) for r in df.select("doc_id", "text").collect()]) and any(r[2] for r in got)


def test_only_anchors_that_others_hold_are_sent():
    # the grams around the passages are in several texts, 32 bytes of them in one only
    draw = random.Random(7)
    letters = lambda n: "".join(draw.choice("bcdfghjklm") for _ in range(n))
    grams, passage = [letters(16) for _ in range(20)], letters(200)
    texts = [("".join(letters(17) + draw.choice(grams) for _ in range(60)) + (passage if k in (3, 8) else "")) for k in range(12)]
    lefts = [pa.table({"block": pa.array([b] * 3, pa.int64()), "first": pa.array([3 * b + i for i in range(3)], pa.int64()), "text": texts[3 * b : 3 * b + 3]}) for b in range(4)]
    parts = 3

    def grouped(tables, column, value):
        table = pa.concat_tables(tables)
        return table.filter(pc.equal(table.column(column), value))

    keys = [repeats._keys_of_block(parts)(left.select(["block", "text"])) for left in lefts]
    found = [repeats._repeated_keys(grouped(keys, "part", part), 4096) for part in range(parts)]
    sent = pa.concat_tables([repeats._segments_of_block(parts)(left, grouped(found, "block", b)) for b, left in enumerate(lefts)])
    assert set(sent.column("block").to_pylist()) == {1, 2}
    assert sum(len(x) // 4 for x in sent.column("sizes").to_pylist()) < 60


def test_strings_of_contents_under_one_key():
    draw = random.Random(8)
    for _ in range(40):
        base = bytes(draw.choice(b"ab") for _ in range(90))
        contents = list({base[i:j] for i, j in ((draw.randrange(0, 30), draw.randrange(81, 91)) for _ in range(5))} | {bytes(draw.choice(b"ab") for _ in range(70)) for _ in range(3)})
        docs = np.array([draw.randrange(9) for _ in contents])
        got = repeats.shared_strings(contents, np.full(len(contents), 5, np.uint64), docs)
        for i, c in enumerate(contents):
            least = [min(d for x, d in zip(contents, docs) if c[p : p + 50] in x) for p in range(len(c) - 49)]
            assert got.get(i, np.full(len(least), docs[i])).tolist() == least


def test_shuffles_of_written_tables_go(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in map(str, (lambda f: [f.apply(i) for i in range(f.size())])(files.getAllFiles())) if "/shuffle_" in x}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, conf = shuffled(), spark.conf.get(key)
    df = repeats.op12_lyndon_repeats(spark.createDataFrame(made(), "doc_id long, text string"))
    for _ in range(20):
        if not (left := shuffled() - before):
            break
        time.sleep(0.25)
    assert not left and spark.conf.get(key) == conf
    assert df.count() == len(made())
