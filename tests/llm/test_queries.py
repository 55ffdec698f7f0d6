"""The ten registered queries over whole small tables: against DuckDB where there is SQL, else against brute force; and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from quillfind.llm import exact_dedup, html_blocks, html_extract, lm, near_dedup, quality  # noqa: E402
from quillfind.llm.queries import ORACLES, QUERIES  # noqa: E402
from quillfind.llm.run_index import RunIndex  # noqa: E402

COLUMNS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, node string, file string, seg int, told string, band int",
    "pages": "page_id bigint, url string, html string, text string, n_chars int",
    "benchmark": "item_id bigint, text string, source string",
    "labels": "doc_id bigint, quality int, toxic int, text string",
}


def documents(rng):
    words = [f"w{i}" for i in range(300)]
    passage, item = " ".join(rng.choices(words, k=70)), " ".join(f"b{i}" for i in range(14))
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(60)]
    texts += [t for t in texts[:8]] + [t.replace(" ", "  \n") for t in texts[8:12]] + [t + " more" for t in texts[12:20]]
    texts += [" ".join(rng.choices(words, k=20)) + " " + passage + " " + " ".join(rng.choices(words, k=20)) for _ in range(5)]
    texts += [f"before {item} after", f"{item.upper()}", " ".join(item.split()[:7]), "short"]
    texts += [None, "", "  ", "one", "Grüße ▁ <|endoftext|> 世界 😀", "long line " * 3000, "# BAD!! ###" * 9, "İé x\x1cy"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows


def pages():
    body = "<p>First paragraph of the story, long enough to be read.</p><p>Second one &amp; more&nbsp;of it.</p>"
    return [(0, "u0", f"<html><body><nav><a href=x>Home</a><a href=y>News</a></nav><article><h1>Title</h1>{body}</article><footer>&copy; someone</footer></body></html>"), (1, None, None), (2, "u2", ""), (3, "u3", "plain"), (None, "u4", f"<article>{body}")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(8)
    docs = documents(rng)
    rows = {
        "documents": [(i, t, "en", "s", 1, 1, "n", "f", 1, "t", 1) for i, t in docs],
        "pages": [(*p, "t", 1) for p in pages()],
        "benchmark": [(0, " ".join(f"b{i}" for i in range(14)), "x"), (1, "short", "x"), (2, None, "x"), (3, "!!", "x"), (None, "w1 w2", "x")],
        "labels": [(i, int(i % 3 > 0), 0, "t") for i in range(len(docs))] + [(5, None, None, None), (None, 1, 0, "t"), (999, 1, 0, "t")],
    }
    for name, columns in COLUMNS.items():
        spark.createDataFrame(rows[name], columns).repartition(2).write.parquet(f"{at}/{name}.parquet")
    return at, docs


def shown(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in COLUMNS:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder[0]}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, folder[0])
    want = c.execute(ORACLES[name])
    order = [[d[0] for d in want.description].index(k) for k in sorted(df.columns)]
    assert sorted(df.columns) == sorted(d[0] for d in want.description)
    assert sorted(tuple(shown(r[k]) for k in sorted(df.columns)) for r in df.collect()) == sorted(tuple(shown(r[k]) for k in order) for r in want.fetchall())


def test_op1(spark, folder):
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in QUERIES["op1_token_file"](spark, folder[0]).collect()}
    for i, t in folder[1]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(folder[1])


def test_op3(spark, folder):
    """Every pair of the planted passage's documents is linked, and each row's places hold what it says."""
    texts = dict(folder[1])
    rows = QUERIES["op3_shared_passages"](spark, folder[0]).collect()
    split = {i: (t or "").lower().split() for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in rows:
        a, b = split[r.source_id][r.source_start : r.source_end], split[r.doc_id][r.start_word : r.end_word]
        assert r.source_id < r.doc_id and min(len(a), len(b)) >= 40 and r.identity >= 0.75
        assert r.n_equal <= sum((Counter(a) & Counter(b)).values())
        root[find(r.doc_id)] = find(r.source_id)
    seen = {}
    for i, w in split.items():
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), []).append(i)
    for holders in seen.values():
        assert len({find(i) for i in holders}) == 1


def test_op4(spark, folder):
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in QUERIES["op4_html_text"](spark, folder[0]).collect()}
    main = "Title First paragraph of the story, long enough to be read. Second one & more of it."
    assert got[0, "u0"] == (main, len(main)) and got[1, None] == ("", 0) and got[2, "u2"] == ("", 0) and len(got) == 5
    assert got[None, "u4"][0] == main.removeprefix("Title ")  # no head, no end tags


def test_op5(spark, folder):
    """Scores follow from the model alone, word by word, and the model from labels that are not held out."""
    docs = dict(folder[1])
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    model = quality.Model().fit([((docs[i] or "").encode(), int(i % 3 > 0)) for i in sorted(docs) if i not in held])
    bucket, constant = model.scores()
    got = {r.doc_id: r for r in QUERIES["op5_quality"](spark, folder[0]).collect()}
    for i, t in docs.items():
        words = (t or "").encode().split()
        z, n = 0.0, 0
        for k, w in enumerate(words):
            ids = quality.features([w])[1]
            z, n = z + float(bucket[ids].astype(np.float64).sum()), n + len(ids)
            if k and w == words[k - 1]:
                z, n = z + quality.AGAIN_WEIGHT * float(bucket[quality.AGAIN]), n + quality.AGAIN_WEIGHT
        want = 1 / (1 + math.exp(-(constant + (z / n if n else 0.0))))
        assert got[i].score == pytest.approx(want, abs=1e-6) and got[i].held_out == (i in held) and got[i].predicted == int(got[i].score >= 0.7)
    assert len(got) == len(docs)


def test_op6(spark, folder):
    docs = [(i, [*(t or "").encode().lower().split(), b"END"]) for i, t in folder[1]]
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(x for i, t in docs if i not in held for x in t)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in QUERIES["op6_lm_score"](spark, folder[0]).collect()}
    for i, t in docs:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) and r.score < 0
    assert all(r.score > r.base_score for i, r in got.items() if i not in held and r.n_tokens > 20)  # what was learned from scores above the base


def test_op7(spark, folder):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in QUERIES["op7_sentencepiece"](spark, folder[0]).collect()}
    for i, t in folder[1]:
        ids = sp.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_op9(spark, folder):
    docs = [(i, (t or "").encode()) for i, t in folder[1]]
    least = {}
    for i, t in docs:
        for k in range(len(t) - 49):
            least.setdefault(t[k : k + 50], i)
    got = {r.doc_id: r for r in QUERIES["op9_long_repeats"](spark, folder[0]).collect()}
    for i, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if least[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folder, tmp_path, name):
    for t, columns in COLUMNS.items():
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{t}.parquet")
    empty, full = QUERIES[name](spark, str(tmp_path)), QUERIES[name](spark, folder[0])
    assert empty.count() == 0 and empty.dtypes == full.dtypes


def test_run_index_by_brute_force(monkeypatch):
    rng = random.Random(1)
    for span in (3, 8, 9, 20, 50):
        for piece in (1, 7, 2048):
            monkeypatch.setattr("quillfind.llm.run_index.PIECE", piece)
            base = bytes(rng.choice(b"ab") for _ in range(160))
            texts = []
            for _ in range(12):
                t = bytearray(base[(a := rng.randrange(50)) : a + rng.randint(span, span + 50)])
                t[rng.randrange(len(t))] = rng.choice(b"abc")
                texts.append(bytes(t))
            texts = list(dict.fromkeys(t for t in texts if len(t) >= span))
            owners = np.array([rng.randrange(9) for _ in texts])
            least = {}
            for t, o in zip(texts, owners.tolist()):
                for k in range(len(t) - span + 1):
                    least[t[k : k + span]] = min(least.get(t[k : k + span], 99), o)
            index = RunIndex(texts, np.array([len(t) - span + 1 for t in texts]), owners, span)
            assert index.smallest().tolist() == [least[t[k : k + span]] for t in texts for k in range(len(t) - span + 1)]


def test_repetitive_text_has_few_runs():
    t = b"the same words again and again and again in every copy of this text, over and over. " * 200
    index = RunIndex([t], np.array([len(t) - 49]), np.array([0]), 50)
    assert index.runs < len(t) / 50 and len(index.heads) < 200


def test_joining_links_are_few_and_complete():
    """Links grow with a group's members, not with their pairs, and join all that may be joined."""
    made = {}
    for n in (100, 200):
        rng = random.Random(3)
        base = np.array([rng.randrange(2**60) for _ in range(120)], np.uint64)
        sets = []
        for _ in range(n):
            s = base.copy()
            at = rng.sample(range(120), rng.randint(5, 24))
            s[at] = [rng.randrange(2**60) for _ in at]
            sets.append(np.unique(s))
        links = list(near_dedup.joining_links(sets, np.arange(n), lambda i, n=n: np.ones(n, bool)))
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in links:
            both = len(np.intersect1d(sets[i], sets[j]))
            assert 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and find(i) != find(j)
            root[find(i)] = find(j)
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                assert 100 * both < 75 * (len(sets[i]) + len(sets[j]) - both) or find(i) == find(j)
        made[n] = len(links)
    assert made[200] < 200 and made[200] <= 2.6 * made[100]


def test_names_never_run_into_each_other():
    with pytest.raises(OverflowError):
        exact_dedup._base(0, 1 << exact_dedup.SEGMENT_BITS)
    with pytest.raises(OverflowError):
        exact_dedup._base(1 << 21, 0)
    assert exact_dedup._base(1, 0) > exact_dedup._base(0, (1 << exact_dedup.SEGMENT_BITS) - 1) + (1 << exact_dedup.INDEX_BITS) - 1


#: Pages of other hands than the training pages': (page, main text).
SITES = [
    (
        """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Harbour news</title><link rel="stylesheet" href="a.css"></head>
<body class="home"><div id="page"><div class="site-header"><a class="logo" href="/">Harbour Times</a><ul class="main-menu"><li><a href="/a">World</a></li><li><a href="/b">Local</a></li></ul></div>
<div id="primary" class="content-area"><article id="post-17" class="post type-post"><header class="entry-header"><h1 class="entry-title">Ferry returns after the storm</h1></header>
<div class="entry-content"><p>The ferry left the harbour on Tuesday with forty passengers on board.</p><p>It had been tied up for nine days while the pier was mended, the harbour office said.</p><ul><li>Two departures a day</li><li>No cars until May</li></ul></div></article></div>
<div id="secondary" class="sidebar widget-area"><h3>Recent posts</h3><ul><li><a href="/1">Market moved</a></li><li><a href="/2">Bridge closed</a></li></ul></div>
<div class="site-footer"><p>Copyright Harbour Times. All rights reserved.</p></div></div></body></html>""",
        "Ferry returns after the storm The ferry left the harbour on Tuesday with forty passengers on board. It had been tied up for nine days while the pier was mended, the harbour office said. Two departures a day No cars until May",
    ),
    (
        """<body><nav role="navigation"><a href="/docs">Docs</a> <a href="/api">API</a></nav><main><article><h1>Install</h1><p>Unpack the archive and run the first command.</p><pre>make all</pre><p>Then read the guide.</p></article></main>
<section id="comments" class="comments-area"><h2>2 comments</h2><div class="comment"><p>Worked for me, thanks!</p></div><div class="comment"><p>Not on my machine.</p></div></section><footer class="footer"><a href="/p">Privacy</a></footer></body>""",
        "Install Unpack the archive and run the first command. make all Then read the guide.",
    ),
    (
        """<html><body><div class="cookie-banner"><p>We use cookies.</p><button>Accept</button></div><div class="topbar nav"><a href="#">Home</a> | <a href="#">Shop</a></div>
<div class="article-body"><h2>On bread</h2><p>Flour, water and salt are enough, and time does the rest.</p><blockquote>Patience is the fourth part.</blockquote><p>Bake it hot.</p></div>
<div class="newsletter"><form action="/s"><label>Your mail</label><input name="m"><button>Subscribe</button></form></div><div class="related-posts"><h4>Related</h4><a href="/x">On butter</a></div></body></html>""",
        "On bread Flour, water and salt are enough, and time does the rest. Patience is the fourth part. Bake it hot.",
    ),
]


@pytest.mark.parametrize("page, main", SITES)
def test_pages_by_other_hands(page, main):
    (got,) = html_extract.main_texts(html_extract.trained(), [page])
    want, found = Counter(main.split()), Counter(got.split())
    both = sum((want & found).values())
    assert both >= 0.9 * sum(want.values()) and both >= 0.85 * sum(found.values()), got


def test_broken_pages_take_time_in_proportion():
    import time

    took = []
    for k in (4000, 16000):
        page = "<span class=a>" * k + "<div class='x y'><p>word</p>" * k + "<li>" * k + "</p>" * k
        start = time.perf_counter()
        found = html_blocks.blocks(page)
        took.append(time.perf_counter() - start)
        assert len(found) == k and found[0].text == "word"
    assert took[1] < 12 * took[0] + 1


def test_ancestors_at_any_depth_are_known():
    page = "<article class=story>" + "<div>" * 500 + "<p>deep</p>"
    (b,) = html_blocks.blocks(page)
    assert html_blocks.bucket("n:story") in b.path and html_blocks.bucket("t:article") in b.path


def test_all_words_of_a_long_block_count():
    long = html_blocks.blocks("<p>" + "plain words go on " * 500 + "newsletter</p>")
    _, words = html_extract.features(long)[0]
    assert len(words) == 2001 and words[-1] == html_blocks.bucket("newsletter", html_extract.WORD_BUCKETS)
    weights = html_extract.Labeller._lay([html_extract.features(long)])[3]
    assert weights.sum() == pytest.approx(html_extract.FULL_WORDS, rel=1e-4)


def test_weights_are_kept(spark):
    a, b = html_extract.labeller(spark), html_extract.labeller(spark)
    assert all((x == y).all() for x, y in zip(a.params(), b.params()))
    assert all((x == y).all() for x, y in zip(a.params(), html_extract.trained().params()))


def test_ranges_follow_the_input():
    assert lm.RANGE_BYTES <= 64 << 20
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    for n in (1, 7, 5000):
        r = lm._range(keys, n)
        assert (np.diff(r) >= 0).all() and 0 <= r.min() and r.max() < n
