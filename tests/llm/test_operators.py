"""Every operator against brute force on small tables with nulls, empties, ties, repeats and long texts."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from quillfind.llm import decontaminate, exact_dedup, html_blocks, html_extract, lm, long_repeats, near_dedup, passages, pieces, quality, token_files  # noqa: E402
from quillfind.llm.common import WordHashes  # noqa: E402

DOC = "doc_id bigint, text string, ref string, block string, __id int, keys string"


def table(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "r", "b", 1, "k") for i, t in rows], DOC).repartition(3)


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 150)))) for i in range(n)]
    for i in range(n, n + 12):
        rows.append((i, rows[i - n][1]))
    for i in range(n + 12, n + 30):
        near = rows[rng.randrange(n)][1].split()
        near[rng.randrange(len(near))] = "changed"
        rows.append((i, " ".join(near)))
    shared = " ".join(rng.choices(words, k=70))
    for i in range(n + 30, n + 36):
        rows.append((i, " ".join(rng.choices(words, k=40)) + " " + shared + " " + " ".join(rng.choices(words, k=30))))
    return [*rows, (n + 36, None), (n + 37, ""), (n + 38, " \t\n"), (n + 39, "Grüße  ▁ <|endoftext|> 世界 😀\x00"), (n + 40, "long " * 8000), (n + 40, "long " * 8000)]


ROWS = corpus()


def text_of(t):
    return (t or "").encode()


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(table(spark, [*ROWS, (None, "alone"), (None, "")]), block=16, segment_rows=20).collect()
    assert len(got) == len(ROWS) + 2
    groups = {}
    for i, t in [*ROWS, (None, "alone"), (None, "")]:
        groups.setdefault(exact_dedup.normalise(text_of(t)), []).append(i)
    by = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    for r in got:
        members = by[r.text_sha256]
        known = [m for m in members if m is not None]
        assert (r.keep_id, r.group_size) == (min(known) if known else None, len(members))
    assert sum(r.kept for r in got) == len(groups)


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_groups(table(spark, []).limit(0)).count() == 0


@given(st.binary(max_size=60))
def test_normalise(text):
    import re

    assert exact_dedup.normalise(text) == re.sub(rb"[\x20\x09-\x0d]+", b" ", text)


@given(st.lists(st.integers(0, 3000), max_size=700), st.integers(0, 9))
@settings(max_examples=60, deadline=None)
def test_elias_fano(steps, more):
    values = np.cumsum([more, *steps])
    back, _ = token_files.EliasFano.from_bytes(token_files.EliasFano.of(values).to_bytes())
    assert (back.all() == values).all()
    assert all(back.select(i) == values[i] for i in range(0, len(values), 41))


def test_token_file(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    token_files.write_tokens(table(spark, ROWS), str(tmp_path / "t"), path, shard_tokens=500, shard_docs=7)
    got = token_files.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    tok, start = Tokenizer.from_file(path), 0
    for r, (i, t) in zip(got, sorted(ROWS, key=lambda x: x[0]), strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


ALPHABET = "aA bcé'ß.,!s  \n\t　\x85▁😀éΣσ<|endoftext|>İ\x1c#1२"


@given(st.lists(st.text(ALPHABET, max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_of_the_tokenizer(texts):
    w = token_files.word_tokenizer(P.path("word_bpe_49k.json"))
    for t, ids in zip(texts, w.ids([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u2").tolist() == w.tok.encode(t, add_special_tokens=False).ids


@given(st.lists(st.text(ALPHABET, max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_pieces_equal_the_library(texts):
    c = pieces.chunk_codec(P.path("piece_bpe_32k.model"))
    for t, (n, ids, decoded) in zip(texts, c.run(texts)):
        want = c.sp.encode(t)
        assert (n, ids, decoded) == (len(want), ",".join(map(str, want)), c.sp.decode(want))


def test_pieces_table(spark):
    got = pieces.encode_pieces(table(spark, [*ROWS, (None, "x")]), P.path("piece_bpe_32k.model")).collect()
    c = pieces.chunk_codec(P.path("piece_bpe_32k.model"))
    assert len(got) == len(ROWS) + 1
    want = {i: c.sp.encode(t or "") for i, t in ROWS}
    assert all(r.ids == want[r.doc_id] for r in got if r.doc_id is not None)


def test_near_duplicates(spark):
    known, rows = WordHashes(), [*ROWS, (None, "a b c d e f g")]
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    sets = {i: set(near_dedup.shingle_set(text_of(t), known).tolist()) for i, t in ROWS}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_near_group_of_many_copies(spark):
    """Copies of copies: a chain of links and a large group, no link of which may be lost."""
    rng = random.Random(2)
    words = [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(150)]
    rows = []
    for i in range(120):
        own = list(words)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(150)] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(own)))
        if i % 10 == 9:
            words[rng.randrange(150)] = f"y{i}"
    known = WordHashes()
    sets = {i: set(near_dedup.shingle_set(t.encode(), known).tolist()) for i, t in rows}
    root = dict.fromkeys(sets)
    for i in sets:
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.9):
        n = 2000
        both = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = pool[:n], pool[n - both : 2 * n - both]
        got = near_dedup.estimates(near_dedup.sketch(a, 512)[None], near_dedup.sketch(b, 512)[None], np.array([n]), np.array([n]))[0]
        assert abs(got - j) < 0.08


def hits(text, items):
    words = decontaminate.words(text_of(text))
    hit, named = set(), set()
    for name, item in items:
        w = decontaminate.words(text_of(item))
        m = min(8, len(w))
        wins = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()
        for i in range(len(words) - m + 1):
            if m and tuple(words[i : i + m]) in wins:
                hit.update(range(i, i + m))
                named.add(str(name))
    return len(words), len(hit), sorted(named)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_contamination(spark, block_bytes):
    rng = random.Random(1)
    items = [(k, " ".join(ROWS[k][1].split()[:n])) for k, n in ((3, 30), (4, 12), (7, 9), (9, 3))] + [(100, None), (101, ""), (102, "w1"), (103, "W2, w3-w4!"), (104, "long " * 20)]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, doc_id int")
    rows = ROWS + [(900 + k, " ".join([*rng.choices(["q", "r"], k=5), *items[k][1].split()[:10], "z"])) for k in range(3)]
    got = decontaminate.contamination(table(spark, rows), bench, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    want = {i: hits(t, items) for i, t in rows}
    for r in got:
        assert (r.n_words, r.n_hit, sorted(r["items"])) == want[r.doc_id]
        assert r.contaminated == (len(want[r.doc_id][2]) >= 2)
    assert decontaminate.contamination(table(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def test_winnowing_keeps_a_gram_of_each_window():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 3, 300).astype(np.uint64)
    from quillfind.llm.common import mix64, shingles

    grams = shingles(mix64(ids), 5)
    kept = set(decontaminate.winnow(grams, 4).tolist())
    assert all(kept & set(range(i, i + 4)) for i in range(len(grams) - 3))


def test_long_repeats(spark):
    rows = [*ROWS, (800, "ab" * 400), (801, "ab" * 300 + "c" * 90), (None, ROWS[1][1] + "!" * 60)]
    got = long_repeats.remove_long_repeats(table(spark, rows)).collect()
    assert len(got) == len(rows)
    seen, want = set(), {}
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, t in [*known, *[r for r in rows if r[0] is None]]:
        t = text_of(t)
        mine = [t[k : k + 50] for k in range(len(t) - 49)]
        hit = bytearray(len(t))
        for k, x in enumerate(mine):
            if seen.__contains__(x) and i not in want:
                hit[k : k + 50] = b"\1" * 50
        if i not in want:
            want[i] = (len(t), sum(hit), bytes(b for b, h in zip(t, hit) if not h))
            last = mine
        seen.update(last)
    for r in got:
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == want[r.doc_id]


def test_passages(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    rows, planted = [], set()
    passage = rng.choices(words, k=65)
    for i in range(40):
        own = rng.choices(words, k=rng.randint(5, 200))
        if i % 8 == 3:
            copy = list(passage)
            copy[20] = "other"
            del copy[40]
            own[len(own) // 2 : len(own) // 2] = copy
            planted.add(i)
        rows.append((i, " ".join(own)))
    rows += [(50, None), (51, ""), (52, "one"), (None, "two words")]
    got = passages.shared_passages(table(spark, rows)).collect()
    assert {r.doc_id for r in got} | {r.source_id for r in got} == planted
    assert all(r.end_word - r.start_word >= 40 and r.identity >= 0.75 and r.source_id < r.doc_id for r in got)


def test_passages_with_text_between(spark):
    rng = random.Random(12)
    one, two, between = ([f"{c}{rng.randrange(10**6)}" for _ in range(n)] for c, n in (("p", 60), ("q", 60), ("r", 100)))
    rows = [(1, " ".join(one + two)), (2, " ".join(one + between + two))]
    got = passages.shared_passages(table(spark, rows)).collect()
    places = {(r.start_word, r.end_word, r.source_start, r.source_end, r.n_equal) for r in got}
    assert places == {(0, 60, 0, 60, 60), (160, 220, 60, 120, 60)}


def fuzzy_copies(rng, n, k):
    """n documents that hold a passage of k words, each with a word of its own in another place."""
    one = [f"p{i}" for i in range(k)]
    own = [f"v{i}" for i in range(9000)]
    return [" ".join(rng.choices(own, k=9) + one[:at] + [f"x{i}"] + one[at + 1 :] + rng.choices(own, k=9)) for i, at in enumerate(rng.randrange(8, k - 8) for _ in range(n))]


@pytest.mark.parametrize("n", [12, 160])
def test_passages_link_all_pairs(spark, n):
    """Neither the first nor the one before alone: each document is linked with all others, in groups above HOLDERS, too."""
    texts = fuzzy_copies(random.Random(n), n, 70)
    got = passages.shared_passages(table(spark, list(enumerate(texts)))).collect()
    assert {(r.source_id, r.doc_id) for r in got} == {(i, j) for j in range(n) for i in range(j)}
    for r in got:
        a, b = texts[r.source_id].split()[r.source_start : r.source_end], texts[r.doc_id].split()[r.start_word : r.end_word]
        assert len(a) == len(b) and r.n_equal == sum(x == y for x, y in zip(a, b)) >= 0.75 * len(a)


def test_passages_of_copies_are_one_class(spark):
    texts = fuzzy_copies(random.Random(3), 3, 60)
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[0].upper()), (4, texts[2]), (5, texts[1]), (6, texts[0]), (None, texts[0]), (8, "too short a text"), (9, "too short a text")]
    got = {(r.source_id, r.doc_id) for r in passages.shared_passages(table(spark, rows)).collect()}
    assert got == {(1, 3), (1, 6), (2, 5), (1, 2), (1, 4), (2, 4), (1, None), (2, None), (4, None)}


def test_passages_of_one_word(spark):
    """A word that stands in a row more often here than there is found everywhere, by rows of the whole row there."""
    rows = [(1, "x " + "de " * 47 + "la " * 47 + "y"), (2, "z " + "de " * 226 + "w " * 226 + "la " * 226 + "u")]
    got = passages.shared_passages(table(spark, rows)).collect()
    found = set().union(*(range(r.start_word, r.end_word) for r in got))
    assert found >= {*range(1, 227 - 40), *range(1 + 226 * 2 + 40, 1 + 226 * 3)} and len(got) <= 40
    assert {r.end_word for r in got} >= {227, 679} and {r.start_word for r in got} >= {1, 453}


def test_rest_of_a_chain_is_a_chain():
    """A match whose best chain goes through one that a better chain has stands alone."""
    a0, b0 = np.array([0, 47, 47]), np.array([0, 47, 226])
    got = passages.chains(a0, a0 + 47, b0, b0 + 47, np.array([47, 47, 47]))
    assert got == [(94, [0, 1]), (47, [2])]


def beside(words, at, step):
    """The words beside a place, as segment_seeds packs them."""
    out = 0
    for k in range(passages.REACH):
        if 0 <= at + k * step < len(words):
            w = words[at + k * step]
            out |= (w % 15 + 1) << (12 + 4 * k) if k else w & 0xFFFF | 1
    return np.array([out], np.uint64)


def test_growth_is_never_less_than_an_end_grows():
    rng = random.Random(5)
    ends = 0
    for _ in range(3000):
        few = rng.choice([2, 4, 30, 1000])
        x, y = ([2 * rng.randrange(few) for _ in range(rng.choice([3, 12, 60]))] for _ in range(2))
        step = rng.choice([1, -1])
        at = [0 if step > 0 else len(w) - 1 for w in (x, y)]
        bound = int(passages._growth(beside(x, at[0], step), beside(y, at[1], step))[0])
        n, _ = passages.grow(x, y, *at, step)
        assert n <= bound or bound == passages.ENDLESS
        ends += bound < passages.ENDLESS
    assert ends > 1500


def test_recall_of_fuzzy_passages(spark):
    rng = random.Random(6)
    rows = []

    def fresh(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    for k in range(80):
        one = fresh(60)
        other = list(one)
        # every sixth word, or as many at random: identity 0.83 and 0.80
        for i in range(5, 59, 6) if k % 2 else rng.sample(range(1, 59), 12):
            other[i] = "changed"
        rows += [(2 * k, " ".join(fresh(30) + one)), (2 * k + 1, " ".join(other + fresh(30)))]
    got = {r.doc_id for r in passages.shared_passages(table(spark, rows)).collect()}
    assert {2 * k + 1 for k in range(1, 80, 2)} <= got
    assert sum(2 * k + 1 in got for k in range(0, 80, 2)) >= 38


def test_parts_are_the_longest_by_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        x = [rng.randrange(10**6) for _ in range(rng.randint(60, 160))]
        y = list(x)
        for _ in range(rng.randint(0, 3)):
            at, n = rng.randrange(len(y)), rng.randint(1, 60)
            y[at:at] = [rng.randrange(10**6) for _ in range(n)]
        equal = [(i, y.index(w)) for i, w in enumerate(x)]
        best = 0
        for i in range(len(equal)):
            for j in range(i, len(equal)):
                a, b = equal[j][0] - equal[i][0] + 1, equal[j][1] - equal[i][1] + 1
                if min(a, b) >= passages.MIN_WORDS and j - i + 1 >= passages.MIN_IDENTITY * max(a, b):
                    best = max(best, j - i + 1)
        got = passages.parts(np.array(equal))
        assert max((p[4] for p in got), default=0) == best


@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
@settings(max_examples=100, deadline=None)
def test_common_words(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
    assert passages.common_words(x, y) == t[-1][-1]


@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
@settings(max_examples=100, deadline=None)
def test_matched(x, y):
    pairs = passages.matched(x, y)
    assert len(pairs) == passages.common_words(x, y) and all(x[i] == y[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))


def test_best_chain_is_the_best():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 7)
        a0 = np.array([rng.randrange(60) for _ in range(n)])
        b0 = np.array([rng.randrange(60) for _ in range(n)])
        size = np.array([rng.randint(5, 20) for _ in range(n)])
        order = sorted(range(n), key=lambda k: (a0[k], b0[k]))
        best = [0.0] * n
        for x, k in enumerate(order):
            best[k] = float(size[k])
            for j in order[:x]:
                if a0[j] + size[j] <= a0[k] + 4 and b0[j] + size[j] <= b0[k] + 4:
                    gap = passages.GAP * (a0[k] - a0[j] - size[j] + b0[k] - b0[j] - size[j])
                    best[k] = max(best[k], best[j] + size[k] - gap)
        got = passages.chains(a0, a0 + size, b0, b0 + size, size)
        assert (got[0][0] if got else 0) == pytest.approx(max(best) if max(best) >= passages.MIN_SCORE else 0)


def brute_lm(rows, held):
    """The model in plain words: quantised counts, Witten-Bell interpolation, no filter."""
    def q(c):
        return float(lm.count_at(lm.level(np.array([c])))[0]) if c else 0.0

    texts_ = [(i, [*text_of(t).lower().split(), "END"]) for i, t in rows]
    one, two, follow = Counter(), Counter(), {}
    for i, t in texts_:
        if i not in held:
            one.update(t)
            two.update(zip(["START", *t], t))
            for a, b in zip(["START", *t], t):
                follow.setdefault(a, set()).add(b)
    n, v = sum(one.values()), len(one)
    out = []
    for _, t in texts_:
        score = 0.0
        for a, b in zip(["START", *t], t):
            own, before = (q(one[b]) + 1) / (n + v + 1), q(one["END"] if a == "START" else one[a])
            more = q(len(follow.get(a, ()))) if before else 1.0
            score += math.log10((min(q(two[a, b]), before) + more * own) / (before + more))
        out.append((len(t), sum(one[x] > 0 for x in t), n, sum(math.log10((one[x] + 1) / (n + v + 1)) for x in t), score))
    return out


LM_ROWS = [*ROWS, (None, "w1 w2"), (2**60 + 1, "w3 w4")]


@pytest.mark.parametrize("kw", [{}, {"segment": 700}, {"max_filter": 1000}, {"max_table": 2000, "segment": 700}])
def test_lm(spark, kw):
    """Broadcast whole or asked range by range, the same scores, and those of the model without a filter."""
    held = {i for i, _ in LM_ROWS if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    got = lm.lm_scores(table(spark, LM_ROWS), bits=200, **kw).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[2])
    want = sorted([(i, i in held, *w) for (i, _), w in zip(LM_ROWS, brute_lm(LM_ROWS, held))], key=order)
    assert len(got) == len(want)
    for r, w in zip(sorted(map(tuple, got), key=order), want):
        assert r[:5] == w[:5]
        assert r[5:] == pytest.approx(w[5:])


def test_lm_with_its_own_bits(spark):
    a, b = (sorted(map(tuple, lm.lm_scores(table(spark, LM_ROWS), **kw).collect()), key=str) for kw in ({}, {"max_filter": 100}))
    assert [x[:5] for x in a] == [x[:5] for x in b] and [x[6] for x in a] == pytest.approx([x[6] for x in b])


@pytest.mark.parametrize("kw", [{}, {"max_filter": 0}])
def test_lm_of_nothing(spark, kw):
    assert lm.lm_scores(table(spark, LM_ROWS).limit(0), **kw).count() == 0
    (r,) = lm.lm_scores(table(spark, [(0, None)]), **kw).collect()
    assert (r.n_tokens, r.train_tokens) == (1, 1) and r.score < 0


def reduced(tokens, starts):
    import pandas as pd

    g = pd.DataFrame(list(lm._pieces(1, tokens, starts, True)), columns=["range", "n", "keys", "counts", "before", "sizes"])
    return next(lm._reduce((0,), g).itertuples(index=False))


def test_log_frequency_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2)
    tokens = np.repeat(keys, rng.geometric(0.05, len(keys)))
    rng.shuffle(tokens)
    r = reduced(tokens, np.array([0]))
    f = lm.Filter.of(lm.slice_of(r, 12))
    keys, counts = np.unique(tokens, return_counts=True)
    got, q = f.levels(keys, lm.TOKEN), lm.level(counts)
    assert (got >= q).all() and (got == q).mean() > 0.97
    assert (f.levels(np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64)), lm.TOKEN) > 0).mean() < 0.03
    pairs, of, n, _ = lm.distinct_pairs(lm.histories(tokens, np.array([0])), tokens)
    got = f.levels(pairs, lm.PAIR, of)
    assert (got >= lm.level(n)).all() and (n == 1).mean() > 0.9  # those seen once are in, too


def test_quality(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        own = [rng.choice(["tree", "river", "stone", "light", "water"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(own if good else [w.upper() + "!!" for w in own])))
        labels.append((i, int(good), i % 2))
    rows += [(500, None), (501, ""), (None, "tree")]
    labels += [(600, 1, 0), (None, 0, 0), (3, None, 0), (5, 9, 0)]
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(table(spark, rows), lab).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in range(400))
    assert sum(got[i].predicted == (i % 3 > 0) for i in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    none = quality.quality_scores(table(spark, rows), lab.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


PAGE = """<html><head><title>Title</title><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy this now.</div>
<article><h1>Head &amp; tail</h1><p>First  paragraph
with <b>bold</b> words.<p>Second one.</article><div class="comments"><p>Nice text.</p></div><footer>&copy; someone</footer></body></html>"""


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (None, "u", "<article><p>lone</article>"), (1, "u", PAGE)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, text int")
    got = html_extract.extract_main(pages).collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.page_id == 1] == ["Head & tail First paragraph with bold words. Second one."] * 2
    assert all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]


def test_labeller_on_pages_it_has_not_seen():
    writer, labeller = html_extract.PageWriter(123), html_extract.trained()
    right = total = 0
    for _ in range(150):
        page, labels = writer.page()
        (found,) = labeller.main([page])
        right += sum(a == bool(b) for a, b in zip(found, labels))
        total += len(labels)
    assert right > 0.985 * total


@given(st.text("<>/pabdiv=\"' &;x!-\n", max_size=80))
@settings(max_examples=200, deadline=None)
def test_broken_markup_never_fails(page):
    html_blocks.blocks(page)
