"""The operators against plain versions on small data, and on rows that are odd."""

import random
import collections
import hashlib
import math
import re
import struct
import zlib
from html import unescape

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slicework.llm import bpe, decontaminate, graph, html, langid, license, lines, pst, quality, sharding, simhash
from slicework.llm.queries import vocabulary

LONG = " ".join(f"wort{i % 977}" for i in range(30_000))
ODD = [None, "", " \t\n", "a", "Zwei Wörter", "x\ny\nx\n\n", "!!! ### |", LONG, "same text here, twice over and over", "same text here, twice over and over", "é" * 50, "日本語 テスト ok", "a b c d e f " * 40]
WS = re.compile(r"[\x20\x09-\x0D]+")


def docs_of(spark, texts, first=0):
    rows = [(i + first, t, ["en", "de", None][i % 3], f"src{i % 2}", len(t or ""), i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra int")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, one of them repeated, with names that the operators use themselves."""
    df = docs_of(spark, ODD)
    return df.unionByName(df.where("doc_id = 8")).withColumns({"n": F.lit(1), "key": F.lit("k"), "rank": F.lit(2), "fp": F.lit(3), "kept": F.lit(True)})


def empty(df):
    return df.limit(0)


# pages

def test_html():
    page = """<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><header>Site</header><div id="cookie-notice">We use cookies, ok?</div>
    <div class="layout"><div class="content"><h2>Title &amp; more</h2><p>Some   long prose,\nwith punctuation. It goes on; <b>really</b>.<p>Short</p><ul><li>one<li>two</ul></div>
    <div class="sidebar"><p>Side text, with commas, periods. Long text.</p></div></div><script>var a = "<p>";</script><form><p>Subscribe, now.</p></form>
    <section id="comments"><p>Great post, thanks. I liked it, a lot.</p></section><footer>c 2020</footer></body></html>"""
    assert html.main_text(page) == "Title & more\nSome long prose, with punctuation. It goes on; really.\nShort\none\ntwo"
    assert [html.main_text(x) for x in (None, "", "<p>", "<!-- x", "<script>a", "a &lt; b", "<p>cut &am", "<a href='x>y")] == ["", "", "", "", "", "a < b", "cut &am", "y"]


PROSE = "It rained for a week, and the river rose; nobody had seen it so high. People came to look, day after day, and went home again. "
BODY = f"<p>{PROSE * 3}</p><p>{PROSE * 2}</p>"
WANT = [" ".join((PROSE * k).split()) for k in (3, 2)]


def test_html_layouts():
    """Pages without the usual elements or with misleading names: the ratios of the paths tell the text from the rest."""
    links = "".join(f"<div><a href=/{k}>Story number {k}</a></div>" for k in range(12))
    cells = "".join(f"<td><span>Buy {k}</span></td>" for k in range(9))
    cards = "<article><h3>Card</h3><p>Another story.</p></article>" * 2
    soup = f"<div><div><div>{links}</div></div><div><div>{BODY}</div></div><div>Imprint</div><div>Contact</div></div>"
    pages = [
        f"<body><div id=content>{BODY}</div><div class=cards>{cards}</div></body>",
        soup,
        f"<table><tr>{cells}<tr><td><div>{BODY}</div></td></tr></table>",
        f"<body><div class='share-price-report'>{BODY}</div><div>ok.</div></body>",
        f"<body><div class='content social'>{BODY}</div><span>ok</span></body>",
        f"<form id=aspnet><div>{links}</div><div>{BODY}</div></form>",
        f"<article>{BODY}<div class='ad'>buy, now.</div></article><div><p>Made elsewhere.</div>",
        f"<main><h1>Head</h1>{BODY}</main><aside><p>{PROSE}</p></aside><section class=comments><p>{PROSE}</p></section>",
        f"<ul>{''.join(f'<li>{k}' for k in range(20))}</ul><section>{BODY}</section>",
        f"<div><b>Menu<i>of</b> things</i></div><div><blockquote>{BODY}</blockquote></div>",
    ]
    for page in pages:
        got = html.main_text(page).split("\n")
        assert [x for x in got if x in WANT] == WANT and len(got) <= 3, page[:80]
    assert html.main_text(pages[7]) == "\n".join(["Head", *WANT])


def test_html_scores_decide(monkeypatch):
    page = f"<div><div><p>First</p><p>Second</p></div><section>{BODY}</section><div>{'<em>x</em> <p>Sign</p>' * 5}</div></div>"
    assert html.main_text(page).split("\n") == WANT
    monkeypatch.setattr(html, "path_scores", lambda paths, found: list(paths.factor))
    assert len(html.main_text(page).split("\n")) > 4


def test_html_hidden_is_an_attribute():
    for start in ('article title="The hidden valley"', "main class='x hidden y'", 'section data-t="a > hidden gem"', "div data-hidden=1", 'div title=" hidden "'):
        page = f"<{start}>{BODY}</{start.split()[0]}><span>ok.</span>"
        assert html.main_text(page).split("\n")[:2] == WANT, start
    for start in ("p hidden", "p HIDDEN", "p hidden=until-found", 'p class="a"hidden', "p style='Display: None'"):
        assert html.main_text(f"<{start}>{PROSE}</p>{BODY}").split("\n") == WANT, start


def article_of(page):
    body = page.split("<article>")[1].split("</article>")[0]
    texts = [" ".join(unescape(re.sub(r"<[^>]*(>|$)", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in texts if b)


def test_html_ratios_alone(spark, monkeypatch):
    """Without lists of elements and words, the ratios alone find the text of most of the given pages."""
    factor = html._factor
    monkeypatch.setattr(html, "_factor", lambda *a: 0.0 if factor(*a) == 0.0 else 1.0)
    monkeypatch.setattr(html, "IN_ARTICLE", 1.0)
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert sum(html.main_text(p) == article_of(p) for p in pages) >= 0.8 * len(pages)


def test_path_smoothing():
    rng = np.random.default_rng(4)
    parent = [-1, *(int(rng.integers(0, k)) for k in range(1, 60))]
    value = rng.integers(0, 9, 60).astype(float).tolist()

    def up(v):
        return [v, *(up(parent[v]) if v else [])]

    def edges(a, b):
        x, y = up(a)[::-1], up(b)[::-1]
        k = sum(1 for p, q in zip(x, y, strict=False) if p == q)
        return len(x) + len(y) - 2 * k

    want = [sum(html.NEAR ** edges(a, b) * value[b] for b in range(60)) for a in range(60)]
    assert np.allclose(html.smoothed(parent, value), want)


def test_html_deep_nesting():
    import time

    begin = time.time()
    for tag in ("<div>x", "<div><p>x", "<b>x", "<ul><li>x", "<a>x</i>", "<span class=ad>x"):
        text = html.main_text(tag * 20_000)
        assert text.count("x") == 20_000 or tag[1] in "a"
    assert html.main_text("<b>" * 20_000 + "x" + "</b>" * 20_000) == "x"
    assert time.time() - begin < 20


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {r.page_id: r for r in html.op1_tag_path_ratios(pages).collect()}
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows.values())
    for p in pages.collect():
        assert rows[p.page_id].text == article_of(p.html)
    assert html.main_text("<article>" + BODY + "</article>") == "\n".join(WANT)
    odd_pages = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (2, "u", "<p>" + "a, b. " * 50_000, "y")], "page_id long, url string, html string, text string")
    assert [r.n_chars for r in html.op1_tag_path_ratios(odd_pages).orderBy("page_id").collect()] == [0, 0, 299_999]
    assert html.op1_tag_path_ratios(empty(odd_pages)).count() == 0


# scoring

def crc(x):
    return zlib.crc32(str(x).encode() if x is not None else b"null")


def test_suffix_tree(spark, corpus):
    rows = {r.doc_id: r for r in pst.op2_suffix_tree(corpus).collect()}
    texts = {r.doc_id: [w for w in WS.split((r.text or "").translate({c: c + 32 for c in range(65, 91)})) if w] for r in corpus.collect()}
    train = [w + ["\n"] for d, w in texts.items() if crc(d) % 7 != 2]
    counts = collections.Counter(x for w in train for x in w)
    n, v = sum(counts.values()), len(counts)
    for d, w in texts.items():
        r, toks = rows[d], w + ["\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(d) % 7 == 2, len(toks), sum(x in counts for x in toks), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in toks), rel_tol=1e-9)
        assert r.score < 0


def plain_score(tree_rows, text, prior=pst.PRIOR):
    """Longest suffix in a dictionary, byte by byte."""
    own = collections.defaultdict(dict)
    for r in tree_rows:
        own[r.context.to_bytes(r.k, "big")][r.symbol] = r.n

    def prob(context, s):
        below = prob(context[1:], s) if context else 1 / 256
        if context not in own:
            return below
        n = own[context]
        return (n.get(s, 0) + prior * below) / (sum(n.values()) + prior)

    stream, out = b" ".join(pst.tokens(text)) + b"\n", 0.0
    for i, s in enumerate(stream):
        context = (b"\n" + stream[:i])[-pst.DEPTH:]
        out += math.log10(prob(context, s))
    return out


def test_automaton_is_the_tree(spark, corpus):
    train = corpus.limit(60)
    kept = pst.retained(train, divergence=3.0, share=1e-4)
    table = kept.toArrow()
    tree, rows = pst.Automaton(table), kept.collect()
    for r in corpus.limit(8).collect():
        stream = np.frombuffer(b" ".join(pst.tokens(r.text)) + b"\n", np.uint8)
        assert math.isclose(tree.score(stream).sum(), plain_score(rows, r.text), rel_tol=1e-5)
    counts = collections.Counter()
    for r in train.collect():
        s = b"\n" + b" ".join(pst.tokens(r.text)) + b"\n"
        for i in range(1, len(s)):
            context = s[max(0, i - 6) : i]
            counts[context[context.rfind(b"\n") if b"\n" in context else 0 :][-3:], s[i]] += 1
    for r in rows:
        if r.k == 3:
            assert counts[r.context.to_bytes(3, "big"), r.symbol] == r.n


def test_retained_contexts_are_those_of_a_plain_count(spark, corpus):
    """All contexts of up to six bytes, counted one by one, and both tests on each."""
    train = corpus.limit(40)
    counts = collections.defaultdict(collections.Counter)
    for r in train.collect():
        s = b"\n" + b" ".join(pst.tokens(r.text)) + b"\n"
        for i in range(1, len(s)):
            for k in range(min(i, 6) + 1):
                counts[s[i - k : i]][s[i]] += 1
    total = sum(counts[b""].values())
    for share, divergence in ((3e-4, 5.0), (1e-3, 20.0)):
        want = {b"": dict(counts[b""])}
        for c, n in counts.items():
            own, below = sum(n.values()), sum(counts[c[1:]].values())
            if c and own >= max(2.0, share * total) and sum(x * math.log(x / own / (counts[c[1:]][s] / below)) for s, x in n.items()) >= divergence:
                want[c] = dict(n)
        got = collections.defaultdict(dict)
        for r in pst.retained(train, share=share, divergence=divergence).collect():
            got[r.context.to_bytes(r.k, "big")][r.symbol] = r.n
        assert got == want and max(map(len, want)) >= 5


def test_scoring_odd(spark, odd):
    rows = pst.op2_suffix_tree(odd).collect()
    assert len(rows) == len(ODD) + 1 and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert pst.op2_suffix_tree(empty(odd)).count() == 0


# sharding

def test_shards(spark, corpus):
    rows = sharding.op3_hash_tree(corpus).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(16))
    text = {r.doc_id: (r.text or "").encode() for r in corpus.collect()}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in rows)

    def u(key, salt):
        return (int(hashlib.md5(f"{salt}/{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    def win(key, children):
        return min(children, key=lambda c: -math.log(u(key, c[0])) / c[1])

    for r in rows:
        region = win(r.doc_id, [("region:r0", 8), ("region:r1", 8)])[0][-1]
        rack = win(r.doc_id, [(f"rack:k{2 * int(region) + i}", 4) for i in range(2)])[0][-1]
        assert r.shard == int(win(r.doc_id, [(f"shard:{4 * int(rack) + i}", 1) for i in range(4)])[0][6:])


def test_shards_odd(spark, odd):
    rows = sharding.op3_hash_tree(odd.withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))).collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) == len(ODD) + 1
    assert sharding.op3_hash_tree(empty(odd)).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.op3_hash_tree(many).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in got) and len(got) == 16 and max(r.n for r in got) < 1500
    for n in (1, 2, 7, 15, 20):
        rows = sharding.op3_hash_tree(many.limit(3000), n).collect()
        assert {r.shard for r in rows} <= set(range(n)) and all(r.grown_shard in (r.shard, n) for r in rows) and any(r.grown_shard == n for r in rows)
    heavy = [sharding.Leaf(0, "a", "r", 3.0), sharding.Leaf(1, "a", "r", 1.0)]
    share = sharding.assign_shards(many, heavy).where("shard = 0").count() / 20_000
    assert 0.73 < share < 0.77


# quality

def plain_stats(t):
    ws = [w for w in WS.split(t or "") if w]
    ln = [x for x in (t or "").split("\n") if WS.sub("", x)]
    seen = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    cover = {i + k for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for k in range(5)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ln) - len(set(ln)), len(cover)


def test_quality(spark, corpus, odd):
    for df in (corpus, odd):
        rows = quality.op4_robust_outliers(df).collect()
        want = {r.doc_id: plain_stats(r.text) for r in df.collect()}
        assert len(rows) == df.count()
        for r in rows:
            assert tuple(r[c] for c in quality.STATS) == want[r.doc_id]
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    judged = quality.op4_robust_outliers(corpus).where("not base_failed").join(labels, "doc_id")
    assert judged.where("quality = 1 and not kept").count() == 0 and judged.where("n_symbols > n_words / 4 and kept").count() == 0
    assert quality.op4_robust_outliers(empty(odd)).count() == 0


def test_mcd_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) @ np.diag([2, 1, 1, 1, 1])
    x[:80] += 40
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{c} double" for c in quality.X))
    est = quality.fit_mcd(df, ["g"], steps=6).first()
    assert np.allclose([est[f"m{i}"] for i in range(5)], x[80:].mean(0), atol=0.4)
    assert 1.0 < est["l00"] < 3.5


def plain_mcd(x):
    """Location, scatter's Cholesky factor by two starts and concentration steps on distance bins."""
    def estimate(part, factor, diagonal=False):
        m = part.mean(axis=0)
        c = (part.T @ part / len(part) - np.outer(m, m)) * factor
        c = np.diag(np.diag(c)) if diagonal else c
        return m, np.linalg.cholesky(c + np.diag(np.maximum(-np.diag(c), 0)) + np.diag(np.array(quality.FLOOR) ** 2))

    def distance(m, low):
        return (np.linalg.solve(low, (x - m).T) ** 2).sum(axis=0)

    best = None
    for diagonal in (False, True):
        m, low = estimate(x, 1.0, diagonal)
        for _ in range(quality.STEPS):
            bins = np.minimum(quality.BINS - 1, np.floor(np.log2(1 + distance(m, low)) * 16)).astype(int)
            before = np.cumsum(np.bincount(bins, minlength=quality.BINS)) - np.bincount(bins, minlength=quality.BINS)
            m, low = estimate(x[before[bins] < len(x) * quality.SHARE], quality.CONSISTENT)
        det = np.log(np.diag(low)).sum()
        if best is None or det < best[0] - 1e-9:
            best = (det, m, low)
    return best[1], best[2]


def test_verdicts_against_numpy(spark):
    """Groups, fall-backs, estimates and distances by hand on 1,000 documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in quality.op4_robust_outliers(docs).collect()}
    table = []
    for r in docs.collect():
        n, chars, symbols, dup, repeat = plain_stats(r.text)
        lines_ = sum(bool(WS.sub("", x)) for x in (r.text or "").split("\n"))
        if n >= 10:
            v = [math.log1p(n), (chars + 100) / (n + 20), math.sqrt(symbols / (n + 20)), dup / (lines_ + 5), repeat / (n + 20)]
            table.append((r.doc_id, r.lang, r.source, v))
    sizes, langs = collections.Counter((g, s) for _, g, s, _ in table), collections.Counter(g for _, g, _, _ in table)
    group = lambda g, s: (g, s) if sizes[g, s] >= quality.MIN_GROUP else (g,) if langs[g] >= quality.MIN_GROUP else ()
    used = {group(g, s) for _, g, s, _ in table}
    fits = {k: plain_mcd(np.array([v for _, g, s, v in table if (g, s)[: len(k)] == k])) for k in used}
    close = 0
    for d, g, s, v in table:
        m, low = fits[group(g, s)]
        want = float((np.linalg.solve(low, np.array(v) - m) ** 2).sum())
        assert math.isclose(rows[d].distance, want, rel_tol=1e-4, abs_tol=1e-4)
        if abs(want - quality.CUTOFF) > 1e-2:
            assert rows[d].kept == (not rows[d].base_failed and want <= quality.CUTOFF)
            close += 1
    assert close > 900 and len(used) > 3


# near duplicates

def plain_fp(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [b" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    parent = {d: d for d in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in fps}


def test_simhash(spark, corpus, odd):
    for df in (corpus, odd):
        rows = simhash.op5_golay_simhash(df).collect()
        fps = {r.doc_id: plain_fp(r.text) for r in df.collect()}
        comps = plain_components(fps)
        assert len(rows) == df.count() and all((int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id], comps[r.doc_id]) for r in rows)
    assert simhash.op5_golay_simhash(empty(odd)).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(plain_components({r.doc_id: plain_fp(r.text) for r in odd.collect()}).values()))


def test_golay_keys_meet():
    errors = simhash.error_table()
    assert set(errors[1].tolist()) == {1, 6}
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for bits in (1, 2):
        other = base.copy()
        for i in range(len(base)):
            for b in rng.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1 << int(b))
        keys = []
        for x in (base, other):
            at, k = simhash.golay_keys(x, errors)
            keys.append([set(k[at == i].tolist()) for i in range(len(x))])
        assert all(a & b for a, b in zip(*keys, strict=True))


def test_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_PAIRED", 2)
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**62, 4)]
    fps = sorted({b ^ int(sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 4), replace=False))) for b in base for _ in range(40)})
    got = graph.connected_components(simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long")))
    comps = {r.node: r.component for r in got.collect()}
    want = plain_components({x: x for x in fps})
    assert {x: comps.get(x, x) for x in fps} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


# licences

def test_licenses(spark, odd):
    mit = "MIT License\n\nCopyright (c) 2019 Someone\n\n" + license._MIT.upper().replace(" LICENSE", " LICENCE").replace(",", " ,")
    df = docs_of(spark, [mit, "word\nReleased under the MIT licence!\nmore", *ODD])
    rows = {r.doc_id: r for r in license.op6_canonical_digest(df).collect()}
    assert rows[0].license == "MIT" and rows[1].license is None and rows[1].line_licenses == "MIT"
    assert rows[2].digest == rows[3].digest == hashlib.sha256(b"").hexdigest() and all(rows[i].license is None for i in range(2, len(rows)))
    assert license.op6_canonical_digest(odd).count() == len(ODD) + 1 and license.op6_canonical_digest(empty(odd)).count() == 0


def test_license_files(spark):
    """Copyright lines without a year, and rights reserved on a line of its own; wrapped lines of the licence stay."""
    bsd = next(t for n, t in license.KNOWN if n == "BSD-3-Clause")
    files = [
        "MIT License\n\nCopyright (c) Microsoft Corporation.\n\n" + license._MIT,
        "Copyright (c) 2011, The Authors\nAll rights reserved.\n\n" + bsd.replace("the above copyright notice", "the above\ncopyright notice"),
        "MIT License\r\n\r\nCopyright © the authors\r\nCopyright: others\r\n# Copyright by one more\r\n" + license._MIT,
        "© the authors\n" + license._ISC,
        "(c) you must keep this\n" + license._ISC,
        "copyright notices count\n" + license._ISC,
    ]
    rows = {r.doc_id: r.license for r in license.op6_canonical_digest(docs_of(spark, files)).collect()}
    assert [rows[i] for i in range(6)] == ["MIT", "BSD-3-Clause", "MIT", "ISC", None, None]


def test_license_table(spark, odd):
    bsd = next(t for n, t in license.KNOWN if n == "BSD-3-Clause")
    padded = "*" * 9000 + " released under the MIT license " + "-" * 9000
    df = docs_of(spark, ["(c) 2001 A\n" + bsd.replace(".", " ;"), f"x\n{padded}", "own licence licence licence text", "nothing"]).withColumns({"license": F.lit("mine"), "digest": F.lit(1), "line_licenses": F.lit(0)})
    rows = {r.doc_id: r for r in license.scan_licenses(df).collect()}
    assert rows[0].license == "BSD-3-Clause" and rows[1].line_licenses == "MIT" and rows[2].license is None
    own = license.known_digests(spark, spark.createDataFrame([("Own", "Own license, license license: text.")], "license string, text string"))
    assert [r.license for r in license.scan_licenses(df, digests=own).orderBy("doc_id").collect()] == [None, None, "Own", None]
    assert license.scan_licenses(df, digests=own.limit(0)).where("license is not null").count() == 0
    assert len({n for n, _ in license.KNOWN}) >= 20


# languages

def plain_mixture(text, model):
    """Expectation-maximisation and the choice of the set, word by word."""
    like = []
    for m in re.finditer(rb"[^ ]+", text):
        padded = b" " + m[0] + b" "
        grams = [padded[i : i + 3] for i in range(len(padded) - 2)]
        grams.append(padded[-2:] + (text[m.end() + 1 : m.end() + 2] or b" "))
        slots = [(int.from_bytes(g, "big") * 2654435761 % 2**32) >> 16 for g in grams]
        like.append(np.sum([model[x] for x in slots], axis=0, dtype=np.float64))
    p = np.exp(np.array(like) - np.max(like, axis=1, keepdims=True))

    def em(share, steps):
        for _ in range(steps):
            r = p * share
            share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        return share

    k = p.shape[1]
    order = np.argsort(-em(np.full(k, 1 / k), langid.EM_STEPS), kind="stable")
    first, best = em(np.full(k, 1 / k), langid.EM_STEPS), None
    for m in range(1, k + 1):
        some = np.zeros(k)
        some[order[:m]] = np.maximum(first[order[:m]], 1e-3)
        some = em(some / some.sum(), langid.REFIT_STEPS) if m > 1 else some / some.sum()
        value = np.log(p @ some).sum() - langid.PENALTY * (m - 1) * np.log(len(p) + 1)
        if best is None or value > best[0]:
            best = (value, m, some.tolist())
        elif m > 1:
            break
    return best[1], best[2]


def test_languages_of_a_text_alone(spark, corpus):
    """A row depends on its text and the learned counts, not on where it stands."""
    docs = corpus.union(corpus.limit(200).withColumns({"doc_id": F.col("doc_id") + 1_000_000, "text": F.concat(F.substring("text", 1, 150), F.lit(" "), F.reverse("text"))}).select(corpus.columns))
    rows = [sorted(langid.op7_language_mixture(d).select("doc_id", "lang_pred", "score", "languages").collect()) for d in (docs, docs.repartition(7, "doc_id"), docs.orderBy(F.desc("n_chars")).coalesce(1))]
    assert rows[0] == rows[1] == rows[2]
    langs, model = langid.log_likelihoods(langid.trigram_counts(corpus))
    texts = [langid._letters(r.text) for r in docs.where("length(text) between 5 and 400").limit(150).collect()]
    texts = [t for t in texts if len(t) > 2] + [b" a ", b" ab cd "]
    shares, number = langid.infer(texts, model)
    for t, share, m in zip(texts, shares, number, strict=True):
        alone, own = langid.infer([t], model)
        assert (alone[0] == share).all() and own[0] == m
        assert plain_mixture(t, model) == (m, pytest.approx(share.tolist(), abs=1e-6))
    again = langid.predict_languages(docs.withColumns({"score": F.lit(1), "languages": F.lit("x"), "lang_pred": F.lit(2)}), langs, model)
    assert sorted(again.columns) == sorted([*(c for c in docs.columns if c != "text"), "lang_pred", "score", "languages"]) and again.where("score <= 1").count() == docs.count()


def test_languages(spark, corpus, odd):
    rows = langid.op7_language_mixture(corpus).join(corpus.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out and re.search(r"[^\W\d_]", r.text or "") and len(r.text) > 60]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    langs, model = langid.log_likelihoods(langid.trigram_counts(corpus))
    text = {g: next(r.text for r in corpus.where(f"lang = '{g}' and n_chars > 1500").collect()) for g in ("en", "fr")}
    shares, number = langid.infer([langid._letters(text["en"][:1500] + " " + text["fr"][:1500])], model)
    assert number[0] == 2 and all(0.3 < shares[0][langs.index(g)] < 0.7 for g in ("en", "fr"))
    every = [next(r.text for r in corpus.where(f"lang = '{g}' and n_chars > 1500").collect())[:1500] for g in langs]
    shares, number = langid.infer([langid._letters(" ".join(every)), langid._letters(every[0])], model)
    assert len(langs) == 4 and number.tolist() == [4, 1] and (shares[0] > 0.1).all()
    for t, share, m in zip([every[0] + every[1], *every], *langid.infer([langid._letters(t) for t in [every[0] + every[1], *every]], model), strict=True):
        assert plain_mixture(langid._letters(t), model) == (m, pytest.approx(share.tolist(), abs=1e-6))
    got = {r.doc_id: r for r in langid.op7_language_mixture(odd).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (0, 1, 2, 6)) and len(got) == len(ODD)
    assert langid.op7_language_mixture(empty(odd)).count() == 0


# lines

def jaccard(a, b):
    x, y = ({s[i : i + 8] for i in range(max(1, len(s) - 7))} for s in (a, b))
    return len(x & y) / len(x | y)


def plain_links(norms):
    """All pairs of the similarity, found by their common shingles."""
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in norms]
    number, size = {}, np.array([len(x) for x in sets])
    own = [np.array([number.setdefault(g, len(number)) for g in x]) for x in sets]
    order = np.concatenate(own)
    line = np.repeat(np.arange(len(norms)), size)[np.argsort(order, kind="stable")]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(order))])
    for i, x in enumerate(own):
        both = np.bincount(np.concatenate([line[cuts[g] : cuts[g + 1]] for g in x]), minlength=len(size))
        for j in np.flatnonzero(both[:i] >= 0.8 * (size[:i] + size[i] - both[:i])):
            yield int(j), i


def plain_line_drops(docs):
    occ = [(d, i, norm) for d, t in sorted(docs.items()) for i, norm in lines.eligible_lines(t)]
    norms = sorted({x for _, _, x in occ})
    parent = list(range(len(norms)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for j, i in plain_links(norms):
        parent[find(i)] = find(j)
    seen, drops = set(), collections.Counter()
    place = {x: i for i, x in enumerate(norms)}
    for d, _, norm in occ:
        c = find(place[norm])
        drops[d] += c in seen
        seen.add(c)
    return drops


def test_line_recall():
    """Of all similar pairs of the lines of 1,000 documents, found by brute force, 99 in 100 share a band."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    norms = sorted({norm for t in texts for _, norm in lines.eligible_lines(t)})
    keys = lines.band_keys(norms)
    met = [bool((keys[i] == keys[j]).any()) for i, j in plain_links(norms)]
    assert len(met) > 200 and np.mean(met) >= 0.99


def test_lines(spark, corpus, odd):
    some = corpus.where("doc_id < 70")
    rows = {r.doc_id: r for r in lines.op8_fuzzy_lines(some).collect()}
    want = plain_line_drops({r.doc_id: r.text for r in some.collect()})
    assert {d: r.n_dropped for d, r in rows.items() if r.n_dropped} == {d: n for d, n in want.items() if n}
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rng = np.random.default_rng(0)
    near = [base if k % 3 == 0 else base.replace("nine", "nine" + "xyz"[int(rng.integers(3))], 1) + "!" * int(rng.integers(3)) for k in range(60)]
    df = docs_of(spark, [f"head {k}\n{x}\nend" for k, x in enumerate(near)])
    got = {r.doc_id: r for r in lines.op8_fuzzy_lines(df).collect()}
    assert got[0].n_dropped == 0 and all(got[k].n_dropped == 1 and got[k].text == f"head {k}\nend" for k in range(1, 60))
    strange = lines.drop_fuzzy_lines(odd)
    assert strange.count() == len(ODD) + 1 and strange.where("doc_id = 0 and text is null and n_lines = 0").count() == 1
    assert set(odd.columns) <= set(strange.columns) and lines.op8_fuzzy_lines(empty(odd)).count() == 0


def test_repeats_inside_lines(spark):
    """A line and what repeats it within one line have nearly the same set of shingles."""
    base = "subscribe to our weekly newsletter for more offers and news today"
    long = base + " as the editors of this site have gathered them for you"
    df = docs_of(spark, [base, f"{base} {base}", " ".join([base] * 3), "another line that has nothing to do with it", " ".join([long] * 2), " ".join([long] * 3)])
    assert jaccard(base, f"{base} {base}") > lines.SIMILARITY
    assert [r.n_dropped for r in lines.op8_fuzzy_lines(df).orderBy("doc_id").collect()] == [0, 1, 1, 0, 0, 1]
    keys = lines.band_keys([long, " ".join([long] * 9)])
    assert (keys[0] == keys[1]).any()


def test_short_lines_and_many_repeats(spark):
    texts = ["ok\n\nok\nyes", "ok\nno", "\n".join(["the same line in a text of many lines", "tiny"] * 30_000), None]
    df = docs_of(spark, texts)
    kept = {r.doc_id: r for r in lines.op8_fuzzy_lines(df).collect()}
    assert [kept[i].n_dropped for i in range(4)] == [0, 0, 29_999, 0] and kept[2].text.count("\n") == 30_000
    exact = {r.doc_id: r.text for r in lines.drop_fuzzy_lines(df, short_lines="exact").collect()}
    assert exact == {0: "ok\n\nyes", 1: "no", 2: "the same line in a text of many lines\ntiny", 3: None}


def test_lines_without_blanks(spark):
    line = "本網站使用餅乾以改善您的瀏覽體驗並分析流量如您繼續使用本網站即表示您同意我們的隱私政策與服務條款謝謝您的支持與愛護"
    near = line.replace("本網站", "此網站", 1)
    df = docs_of(spark, [f"標題{k}\n{(line, near)[k % 3 == 2]}\n短行" for k in range(6)])
    rows = lines.op8_fuzzy_lines(df).orderBy("doc_id").collect()
    assert [r.n_dropped for r in rows] == [0, 1, 1, 1, 1, 1] and rows[2].text == "標題2\n短行"


def test_no_similar_pair_is_refused(spark):
    rng = np.random.default_rng(9)
    texts = []
    for n in rng.integers(5, 120, 150):
        a = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(n)]
        cut = int(rng.integers(0, max(2, n // 5)))
        texts += [" ".join(a), " ".join(a[: n - cut] + ["x" * int(rng.integers(1, 9)) for _ in range(cut)])]
    sizes, bits = lines.sketches(texts)
    assert all(s == len({t[i : i + 8] for i in range(len(t) - 7)}) for s, t in zip(sizes, texts, strict=True))
    rows = [(k, *(int(v) for i in (k, k + 1) for v in (sizes[i], *bits[i]))) for k in range(0, len(texts), 2)]
    names = [f"`{p}{c}` long" for p in "ab" for c in lines.SKETCH]
    passed = {r.k for r in spark.createDataFrame(rows, ", ".join(["k long", *names])).where(lines._plausible("a", "b")).collect()}
    similar = {k for k in range(0, len(texts), 2) if jaccard(texts[k], texts[k + 1]) >= lines.SIMILARITY}
    assert similar == {2 * k for k in np.flatnonzero(lines.similar(texts[::2], texts[1::2]))}
    assert similar <= passed and len(similar) > 30 and len(passed) < len(rows)


def test_line_signatures():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    hits = total = 0
    for n in (8, 15, 22, 25, 60, 200):
        for _ in range(40):
            a = [word() for _ in range(n)]
            b = a[: n - max(1, n // 16)] + [word() for _ in range(max(1, n // 16))]
            a, b = " ".join(a), " ".join(b)
            if jaccard(a, b) >= lines.SIMILARITY:
                keys = lines.band_keys([a, b])
                hits += bool((keys[0] == keys[1]).any())
                total += 1
    assert total > 100 and hits / total > 0.98


# tokens

def test_bpe(spark, corpus, odd):
    path, pattern = vocabulary()
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    odd = odd.withColumn("text", F.when(F.col("doc_id") == 7, F.concat(F.substring("text", 1, 9000), F.lit("#" * 600))).otherwise(F.col("text")))
    for df in (odd, corpus.limit(40)):
        rows = bpe.op9_byte_bpe(df, path, pattern).collect()
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        assert len(rows) == df.count()
        for r in rows:
            ids = encoding.encode_ordinary(texts[r.doc_id])
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    rng = np.random.default_rng(1)
    letters = lambda n, of: "".join(rng.choice(list(of), n))
    long = ["a" * 5000, "ab" * 2000, letters(100_000, "abcdefghijklmnopqrstuvwxyz"), letters(2000, "aab"), *(letters(150, "etao nsh") for _ in range(9)), "日本語テスト" * 90, "=-" * 300, "\x1c \x1d\x85 　x  \t\n x  y   ", " " * 900 + "x"]
    for r in bpe.op9_byte_bpe(docs_of(spark, long), path, pattern).collect():
        ids = encoding.encode_ordinary(long[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(long[r.doc_id].encode()).hexdigest()
    full = bpe.encode_documents(odd, path, pattern, max_words=3)
    assert set(odd.columns) | {"ids", "decoded"} == set(full.columns) and full.where("decoded <> cast(coalesce(text, '') as binary)").count() == 0
    assert bpe.op9_byte_bpe(empty(odd), path, pattern).count() == 0


def test_bpe_has_one_worker_a_task(spark, odd):
    """What is looked up is written, without the text, before a second pass in Python; packed ids are lists over the same memory."""
    plan = bpe.op9_byte_bpe(odd, *vocabulary())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "text#" not in plan
    ids, edge = np.arange(6, dtype=np.int32), np.array([0, 2, 2, 5, 6])
    packed = bpe._packed(ids, edge, "<u2")
    assert packed.to_pylist()[0] == struct.pack("<2H", 0, 1) and bpe._packed(ids, edge).to_pylist()[0] == struct.pack("<2I", 0, 1)
    for lo, n in ((0, 4), (1, 3), (1, 1), (2, 0)):
        assert bpe._unpacked(packed.slice(lo, n)).to_pylist() == [[0, 1], [], [2, 3, 4], [5]][lo : lo + n]
    assert bpe._unpacked(bpe._packed(ids[:0], np.zeros(3, np.int64), "<u2")).to_pylist() == [[], []]


def test_bpe_literals_stand_outside_the_fold(spark, odd):
    """Each level above a literal copies its string when Spark describes the plan, which fills the driver's memory."""
    plan, levels = bpe.op9_byte_bpe(odd, *vocabulary())._jdf.queryExecution().optimizedPlan(), 0
    while plan.children().size():
        for k in range(plan.expressions().size()):
            levels += sum(len(line) > 100_000 for line in plan.expressions().apply(k).treeString().split("\n"))
        plan = plan.children().apply(0)
    assert 1 <= levels <= 6


def test_bpe_parts_of_texts_are_put_together():
    """Known and folded words, slices of batches, texts without words, and pieces of no bytes."""
    import pyarrow as pa

    folded = [[[9]], [], [[7, 8], [], [5]], [[1], [2]]]
    lists = [pa.array(x, k) for x, k in (([[0], [1, 2, 3], [4], []], pa.list_(pa.int32())), ([[1, 0], [3], [0, 1, 0, 0, 0], [0, 0, 0]], pa.list_(pa.int32())), (folded, pa.list_(pa.list_(pa.int32()))), ([[0], [], [0, 1, 2, 0], [1, 0]], pa.list_(pa.int32())))]
    want = [[0, 9], [1, 2, 3], [7, 8, 4, 5, 7, 8], [2, 1]]
    pieces = bpe.Pieces({b"ab": 0, b"\xff": 1, b"c": 2, b"": 3, b"d": 4, b"e": 5, b"f": 7, b"g": 8, b"h": 9})
    for lo, n in ((0, 4), (1, 3), (2, 2), (1, 1), (0, 0)):
        ids, edge = bpe._put_together(*(x.slice(lo, n) for x in lists))
        assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:])] == want[lo : lo + n]
        assert pieces.decoded(ids, edge).to_pylist() == [b"abh", b"\xffc", b"fgdefg", b"c\xff"][lo : lo + n]


# leaks

def test_leaks(spark, corpus, odd):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: decontaminate.word_list(r.text) for r in benchmark.collect()}
    found = {(r.doc_id, r.item_id) for r in decontaminate.op10_latent_leaks(corpus, benchmark).collect()}
    truth = {(r.doc_id, i) for r in corpus.collect() for i, w in items.items() if b" %s " % b" ".join(w) in b" %s " % b" ".join(decontaminate.word_list(r.text))}
    assert found == truth and truth
    item = benchmark.orderBy("item_id").first().text.split()
    loose = " ".join(w for k, w in enumerate(item) if k % 6 != 3)
    clean = corpus.where("doc_id = 1").first().text
    df = docs_of(spark, [clean[:200] + " " + loose.upper() + " " + clean[:300], clean[:400], None, ""], first=10_000)
    got = {r.doc_id for r in decontaminate.op10_latent_leaks(df, benchmark).collect()}
    assert got == {10_000}
    assert decontaminate.without_leaks(df, benchmark).count() == 3 and decontaminate.without_leaks(df, benchmark).columns == df.columns
    assert decontaminate.op10_latent_leaks(odd, benchmark).count() == 0
    assert decontaminate.op10_latent_leaks(empty(odd), benchmark).count() == 0
    assert decontaminate.op10_latent_leaks(corpus, benchmark.limit(0)).count() == 0


def test_leak_recall_of_paraphrases(spark, corpus):
    """Of items with words replaced, dropped, put in or moved, those that brute force over all windows finds are found."""
    rng = np.random.default_rng(8)
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").withColumn("item_id", F.concat(F.lit("item-"), "item_id"))
    items = {r.item_id: r.text for r in benchmark.collect()}
    filler = [w for r in corpus.limit(60).collect() for w in (r.text or "").split()]

    def loosened(text):
        out = []
        for w in text.split():
            u = rng.random()
            out += [filler[int(rng.integers(len(filler)))]] if u < 0.12 else [] if u < 0.2 else [w, filler[int(rng.integers(len(filler)))]] if u < 0.28 else [w]
        if rng.random() < 0.4:
            k = int(rng.integers(1, len(out)))
            out[k - 1 : k + 1] = out[k - 1 : k + 1][::-1]
        return out

    texts, truth = [], set()
    for n, (i, text) in enumerate(sorted(items.items()) * 6):
        own = filler[(n * 37) % 3000 :][: int(rng.integers(5, 120))]
        texts.append(" ".join([*own, *loosened(text), *filler[(n * 53) % 3000 :][: int(rng.integers(5, 120))]]))
        words = decontaminate.word_list(texts[-1])
        item = decontaminate.word_list(text)
        number = {w: k for k, w in enumerate(sorted(set(words) | set(item)))}
        a, b = [number[w] for w in item], [number[w] for w in words]
        size = 64 + 2 * max(32, len(a) // 2)
        if any(decontaminate.is_leak(a, b[k : k + size])[0] for k in range(0, max(1, len(b) - size + 33), 32)):
            truth.add((n, i))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(corpus.limit(150).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.op10_latent_leaks(docs, benchmark).collect()}
    assert len(truth) > 200 and len(truth & found) / len(truth) >= 0.97, (len(truth), len(truth & found))


def test_leaks_of_an_item_in_many_documents(spark):
    """Words that are common only because the item is leaked, and items of common words, are found all the same."""
    rng = np.random.default_rng(4)
    filler = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 5000, n))
    item = " ".join(f"item{k}" for k in range(30))
    loose = " ".join(w for k, w in enumerate(item.split()) if k % 5 != 2)
    dull = " ".join(f"of{k % 12}" for k in range(24))
    texts = [f"{filler(100)} {(item, loose)[k % 2] if k % 3 == 0 else ''} {filler(50)} {dull if k % 4 == 0 else 'of3 of2 of1 of0'}" for k in range(120)]
    benchmark = spark.createDataFrame([(1, item), (2, dull), (3, filler(30))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.op10_latent_leaks(docs_of(spark, texts), benchmark).collect()}
    assert got == {(k, 1) for k in range(0, 120, 3)} | {(k, 2) for k in range(0, 120, 4)}
    assert decontaminate.without_leaks(docs_of(spark, texts), benchmark).count() == sum(k % 3 > 0 and k % 4 > 0 for k in range(120))


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (rng.integers(0, 6, int(rng.integers(1, 30))).tolist() for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a, b) == t[-1, -1]


def test_last_merges_are_the_only_ones_met():
    """In any fold, ids that stand side by side and make a piece are the two that the piece's own last merge joins."""
    rng = random.Random(5)
    for _ in range(30):
        ranks = {bytes([b]): b for b in b"abcd"}
        for r in range(40):
            ranks.setdefault(rng.choice(list(ranks)) + rng.choice(list(ranks)), 300 + r)
        for _ in range(20):
            parts = [bytes([rng.choice(b"abcd")]) for _ in range(30)]
            while True:
                made = [(ranks.get(a + b, bpe.NO_RANK), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
                for r, k in made:
                    assert r == bpe.NO_RANK or bpe.last_merge(parts[k] + parts[k + 1], ranks) == (ranks[parts[k]], ranks[parts[k + 1]])
                r, k = min(made, default=(bpe.NO_RANK, 0))
                if r == bpe.NO_RANK:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
