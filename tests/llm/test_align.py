"""Token alignment against a plain version, and on texts that are odd."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from slicework.llm import align

COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
ODD = [None, "", " ", "  two  blanks ", "a", "\n\n\n", "same text", "same text", "<|endoftext|> and <s> stay text", "ﬁ ligature", "日本語 テスト 😀😀 ok", "é" * 30, "x" * 5000, "▁ mark", "tab\tand\r\nline", "the end " * 400]


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")


def plain(rows, paths):
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a_tok, b_tok = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a_tok.encode_special_tokens = True
    alphabet = {}
    for b in range(256):
        if b in range(0x21, 0x7F) or b in range(0xA1, 0xAD) or b in range(0xAE, 0x100):
            alphabet[chr(b)] = b
    for b in sorted(set(range(256)) - set(alphabet.values())):
        alphabet[chr(256 + len(alphabet) - 188)] = b
    assert ByteLevel().decode(list(alphabet)[:94]) == bytes(range(0x21, 0x7F)).decode()
    groups = []
    for _, text in rows:
        own = []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            pa_ = [bytes(alphabet[c] for c in a_tok.id_to_token(i)) for i in a]
            pb_ = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(pa_) == b"".join(pb_) == (" " + text).encode():
                i = j = 0
                while i < len(a):
                    x, y = [i], [j]
                    ends = [len(pa_[i]), len(pb_[j])]
                    i, j = i + 1, j + 1
                    while ends[0] != ends[1]:
                        if ends[0] < ends[1]:
                            ends[0] += len(pa_[i])
                            x.append(i)
                            i += 1
                        else:
                            ends[1] += len(pb_[j])
                            y.append(j)
                            j += 1
                    own.append(([a[k] for k in x], [b[k] for k in y]))
        groups.append(own)
    links = [collections.Counter((x, y) for ga, gb in own for x in ga for y in gb) for own in groups]
    count = collections.Counter(p for own in links for p in own)
    highest = collections.defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc, _), own, ln in zip(rows, groups, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)
        out.append((doc, sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), sum(ln.values()), sum(n for p, n in ln.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in ln.items()), hashlib.sha256(text.encode()).hexdigest() if own else ""))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in df.collect()), key=repr)


def test_odd(spark, paths, monkeypatch):
    rows = list(enumerate(ODD)) + [(6, "same text"), (99, "again x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "link": F.lit(2), "count": F.lit("n")})
    want = plain(rows, paths)
    assert sum(r[1] > 0 for r in want) >= 9
    assert found(align.op13_token_alignment(df, *paths)) == want
    assert found(align.op13_token_alignment(df.repartition(5), *paths, most_shared=20)) == want
    assert found(align.op13_token_alignment(df, *paths, most_shared=0)) == want
    assert align.op13_token_alignment(df.limit(0), *paths).collect() == []
    monkeypatch.setattr(align, "LINKS", 3)
    both = align.Tokenizers(*paths)
    assert sum(len(x[2]) for x in both.align(ODD)) == sum(r[3] for r in want) - sum(r[3] for r in want if r[0] == 99) - next(r[3] for r in want if r[0] == 6)
    got = align.align_documents(df, *paths).where("doc_id = 10").first()
    assert got.a_cuts[-1] == len(got.a_ids) and got.b_cuts[-1] == len(got.b_ids)


def test_large_groups(monkeypatch):
    import numpy as np

    a, b = np.array([5, 5, 6, 7, 7]), np.array([1, 2, 2, 3])
    m, n, doc = np.array([3, 2]), np.array([3, 1]), np.array([0, 1])
    want = [x.tolist() for x in align.links_of(a, b, m, n, doc, 3, 10)]
    monkeypatch.setattr(align, "LINKS", 2)
    assert [x.tolist() for x in align.links_of(a, b, m, n, doc, 3, 10)] == want == [[0, 4, 5, 5], [51, 52, 61, 62, 73], [2, 4, 1, 2, 2]]


def test_given_table(spark, paths):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(align.op13_token_alignment(df, *paths)) == plain([tuple(r) for r in df.select("doc_id", "text").collect()], paths)


def test_ranks_give_the_ids_of_the_file(paths):
    import random

    from tokenizers import Tokenizer

    plain_a = Tokenizer.from_file(paths[0])
    plain_a.encode_special_tokens = True
    both, draw = align.Tokenizers(*paths).load(), random.Random(1)
    assert both.ranked is not None
    kinds = ["aeiou", " \t\n\u3000", "0123", ".,!?'", "éßçñ", "日本語テ", "😀🏽\u200d", "'s 't 'll", "<|endoftext|>"]
    texts = [t for t in ODD if t] + ["".join(draw.choice(draw.choice(kinds)) for _ in range(draw.randint(1, 80))) for _ in range(3000)] + [chr(draw.choice([draw.randrange(0xD800), draw.randrange(0xE000, 0x110000)])) * 2 + "a1 " for _ in range(3000)]
    assert [both.ids_a(t) for t in texts] == [plain_a.encode(t, add_special_tokens=False).ids for t in texts]
    assert both.by_words
    texts += ["".join(draw.choice(["  ", " ", "the", "ing", "▁", "é", "日", "\n", "　", "ﬁ", "x"]) for _ in range(draw.randint(1, 40))) for _ in range(3000)] + [" ", "  ", "a ", "a  ", " a"]
    normal = [t for t in texts if both.b.normalize(t) == "▁" + t.replace(" ", "▁")]
    assert len(normal) > 3000 and [both.ids_b(t) for t in texts] == both.b.encode(texts, num_threads=1)
    _, _, ((a, n_a), (b, n_b)) = both.encoded(texts)
    whole = [[plain_a.encode(" " + t, add_special_tokens=False).ids for t in texts], both.b.encode(texts, num_threads=1)]
    assert [n_a.tolist(), n_b.tolist()] == [list(map(len, x)) for x in whole]
    assert [a.tolist(), b.tolist()] == [sum(x, []) for x in whole]


def test_distinct_words_are_encoded_once(paths, monkeypatch):
    both, seen = align.Tokenizers(*paths).load(), []
    monkeypatch.setattr(both, "b", type("Once", (), {"encode": lambda self, x, num_threads, own=both.b: seen.extend(x) or own.encode(x, num_threads=num_threads), "normalize": both.b.normalize})())
    both.align(["the cat and the dog", "the  dog\n and the cat", "dog\u3000 cat é x"])
    assert len(seen) == len(set(seen)) and {"cat", "dog\u3000 cat", "x"} <= set(seen)
