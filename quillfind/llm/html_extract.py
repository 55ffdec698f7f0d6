"""Main text of pages by a recurrent block labeller.

A page is cut into leaf blocks. Each block is a bag of hashed features: the tags and names of its path,
its words, and steps of its size, link share and place. A bidirectional LSTM in numpy reads the
sequence of blocks and labels every one, main text or not, from the context of the whole page.

The model is trained on the driver, by a fixed seed, on pages written by rules below: known regions of
known kinds around and inside an article, of random words, so that labels are exact. No page of the
input is used for training, so a page's result depends on that page alone.

Scale: no exchange; the workers get the weights, about half a megabyte. Pages are labelled in batches of
bounded numbers of blocks; a longer page is a batch by itself.
"""

from __future__ import annotations

import hashlib
import inspect
import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_blocks
from .common import freeing, read_table, shared_dir
from .html_blocks import PATH_BUCKETS, Block, blocks, bucket

WORD_BUCKETS, STEPS = 256, 32
N_FEATURES = PATH_BUCKETS + WORD_BUCKETS + STEPS
HIDDEN, SEED, PAGES, EPOCHS = 16, 11, 2400, 6
#: How many words of a block count in full; all words of a longer one share that weight.
FULL_WORDS = 12
#: Blocks that are labelled at once.
BATCH_BLOCKS = 20_000

_MARKS = str.maketrans(dict.fromkeys(".,;:!?", " "))


class _Buckets(dict):
    """word -> its bucket; emptied when it holds limit words."""

    def __missing__(self, word: str, limit: int = 300_000) -> int:
        if len(self) >= limit:
            self.clear()
        found = self[word] = bucket(word, WORD_BUCKETS)
        return found


_WORDS = _Buckets()


def word_buckets(text: str) -> list[int]:
    """The bucket of every word of a text."""
    return list(map(_WORDS.__getitem__, text.lower().translate(_MARKS).split()))


def features(page: list[Block]) -> list[tuple[tuple[int, ...], list[int]]]:
    """Of each block its path and its steps of size, links, place and end, and the buckets of all words of the whole block."""
    out = []
    base = PATH_BUCKETS + WORD_BUCKETS
    for i, b in enumerate(page):
        size = min(9, len(b.text).bit_length())
        link = min(4, 4 * b.linked // len(b.text))
        place = 10 * i // len(page)
        out.append(((*b.path, base + size, base + 10 + link, base + 15 + place, base + 25 + (b.text[-1] in ".!?\"'")), word_buckets(b.text)))
    return out


class Lstm:
    """One direction: gates are in, forget, out and cell."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.wx = (rng.standard_normal((N_FEATURES, 4 * HIDDEN)) * 0.08).astype(np.float32)
        self.wh = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1

    def run(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: steps, pages, 4 * HIDDEN projected features; mask: steps, pages. States of all steps."""
        steps, n = mask.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps):
            z = x[t] + h @ self.wh + self.b
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            g = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            new = f * c + i * g
            th = np.tanh(new)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((h, c, i, f, o, g, th, m))
            c = np.where(m, new, c)
            h = np.where(m, o * th, h)
            out[t] = h
        return out

    def back(self, dout: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of x, wh and b from those of the states."""
        dx = np.zeros((*dout.shape[:2], 4 * HIDDEN), np.float32)
        dwh, db = np.zeros_like(self.wh), np.zeros_like(self.b)
        dh, dc = np.zeros(dout.shape[1:], np.float32), np.zeros(dout.shape[1:], np.float32)
        for t in range(len(keep) - 1, -1, -1):
            h, c, i, f, o, g, th, m = keep[t]
            dh = dh + dout[t]
            now, cell = np.where(m, dh, 0), np.where(m, dc, 0)
            cell = cell + now * o * (1 - th * th)
            dz = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), now * th * o * (1 - o), cell * i * (1 - g * g)], axis=1)
            dx[t] = dz
            dwh += h.T @ dz
            db += dz.sum(axis=0)
            dh = np.where(m, 0, dh) + dz @ self.wh.T
            dc = np.where(m, cell * f, dc)
        return dx, dwh, db


class Labeller:
    """The two directions and the output layer."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.ahead, self.behind = Lstm(rng), Lstm(rng)
        self.w, self.c = (rng.standard_normal(2 * HIDDEN) * 0.1).astype(np.float32), np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.ahead.wx, self.ahead.wh, self.ahead.b, self.behind.wx, self.behind.wh, self.behind.b, self.w, self.c]

    def take(self, weights: list[np.ndarray]) -> Labeller:
        for own, given in zip(self.params(), weights, strict=True):
            own[...] = given
        return self

    @staticmethod
    def _lay(pages: list) -> tuple:
        """Flat features, where blocks begin, the weight of each word bucket in each block, and (step, page) of each block."""
        sizes = np.array([len(p) for p in pages])
        flat = [f for p in pages for f in p]
        counts = np.array([len(f) for f, _ in flat])
        ids = np.fromiter((k for f, _ in flat for k in f), np.int64, int(counts.sum()))
        n_words = np.array([len(w) for _, w in flat])
        places = np.fromiter((k for _, w in flat for k in w), np.int64, int(n_words.sum())) + np.repeat(np.arange(len(flat)) * WORD_BUCKETS, n_words)
        words = np.bincount(places, minlength=len(flat) * WORD_BUCKETS).reshape(len(flat), WORD_BUCKETS).astype(np.float32)
        words *= np.minimum(1.0, FULL_WORDS / np.maximum(n_words, 1)).astype(np.float32)[:, None]
        page = np.repeat(np.arange(len(pages)), sizes)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        mask = np.zeros((int(sizes.max()), len(pages)), bool)
        mask[step, page] = True
        return ids, np.cumsum(counts) - counts, counts, words, step, page, mask

    def _forward(self, pages: list, kept: list | None = None) -> np.ndarray:
        """A score for each block."""
        both = []
        own = slice(PATH_BUCKETS, PATH_BUCKETS + WORD_BUCKETS)
        ahead = self._lay(pages)
        sizes = np.array([len(p) for p in pages])
        turned = np.repeat(sizes, sizes) - 1 - ahead[4]
        mask = np.zeros_like(ahead[6])
        mask[turned, ahead[5]] = True
        for net, lay in ((self.ahead, ahead), (self.behind, (*ahead[:4], turned, ahead[5], mask))):
            ids, starts, counts, words, step, page, seen = lay
            x = np.zeros((*seen.shape, 4 * HIDDEN), np.float32)
            x[step, page] = np.add.reduceat(net.wx[ids], starts) + words @ net.wx[own]
            keep = None if kept is None else []
            h = net.run(x, seen, keep)[step, page]
            both.append(h)
            if kept is not None:
                kept.append((net, lay, keep, h))
        return np.concatenate(both, axis=1) @ self.w + self.c

    def fit(self, data: list[tuple[list, list[int]]], epochs: int = EPOCHS, batch: int = 40, rate: float = 0.015, seed: int = SEED) -> Labeller:
        """Adam on the cross entropy of blocks."""
        rng = np.random.default_rng(seed)
        params = self.params()
        m1, m2, n = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        total = epochs * -(-len(data) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for at in range(0, len(data), batch):
                some = [data[k] for k in order[at : at + batch]]
                y = np.concatenate([np.array(labels, np.float32) for _, labels in some])
                kept: list = []
                z = self._forward([p for p, _ in some], kept)
                d = ((1 / (1 + np.exp(-z)) - y) / len(y) * 8).astype(np.float32)
                states = np.concatenate([k[3] for k in kept], axis=1)
                grads: list = []
                for side, (net, (ids, starts, counts, words, step, page, mask), keep, _) in enumerate(kept):
                    dh = np.zeros((*mask.shape, HIDDEN), np.float32)
                    dh[step, page] = d[:, None] * self.w[side * HIDDEN : (side + 1) * HIDDEN]
                    dx, dwh, db = net.back(dh, keep)
                    dwx = np.zeros_like(net.wx)
                    by = np.argsort(ids, kind="stable")
                    first = np.flatnonzero(np.r_[True, ids[by][1:] != ids[by][:-1]])
                    dwx[ids[by][first]] = np.add.reduceat(dx[step, page][np.repeat(np.arange(len(counts)), counts)[by]], first)
                    dwx[PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = words.T @ dx[step, page]
                    grads += [dwx, dwh, db]
                grads += [states.T @ d, d.sum(keepdims=True)]
                n += 1
                now = rate * (1 - n / (total + 1))
                for p, g, a, b in zip(params, grads, m1, m2):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= now * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.999**n)) + 1e-8)
        return self

    def main(self, pages: list[list[Block]]) -> Iterator[list[bool]]:
        """Of each page, which blocks are main text; pages of like length are read together."""
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        found: list[list[bool]] = [[] for _ in pages]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= BATCH_BLOCKS:
                end += 1
            some = order[at:end]
            z = self._forward([features(pages[k]) for k in some]) > 0
            lo = 0
            for k in some:
                found[k] = z[lo : lo + len(pages[k])].tolist()
                lo += len(pages[k])
            at = end
        yield from found


class PageWriter:
    """Training pages by rule: regions of known kinds, of random words, with a label for each block."""

    _SYLLABLES = "the er in th on an re he en or ti st al ou le de la que ent ion men ung sch cia os ar ver ge ich é ü ñ".split()
    _MENU = ("nav", "div.nav", "div.menu", "ul.menu", "div#navigation", "header nav", "div.navbar", "div.breadcrumb", "div.topbar", "nav.main")
    _HEADER = ("header", "div.header", "div#masthead", "div.branding", "header.site", "div.hero banner")
    _FOOTER = ("footer", "div.footer", "div#footer", "footer.site", "div.copyright", "div.bottom", "div#colophon")
    _SIDE = ("aside", "div.sidebar", "aside.widget", "div#sidebar", "div.related", "section.related", "div.recommended", "div.trending", "div.share", "div.social", "div.newsletter", "div.tags")
    _AD = ("div.ad", "div.ads", "div.advert", "div.sponsored", "div.promo", "aside.ad", "div#ad", "div.banner", "section.advertisement", "p.ad")
    _NOTICE = ("div.cookie", "div.notice", "div.alert", "div#cookie consent", "div.gdpr", "div.popup", "div.modal", "section.notice", "div.subscribe", "div.paywall", "div.warning")
    _COMMENTS = ("div.comments", "section#comments", "div#disqus thread", "ol.commentlist", "section.comments", "div.discussion", "div.replies", "div.responses")
    _BODY = ("article", "article", "article", "article.post", "div.article", "div.post content", "div.entry content", "main", "div#content", "section.story", "div.article body", "main article", "div#main article", "div.content article", "div.post")
    _WORDS = "menu home login search contact about cookies accept privacy terms share reply comment subscribe newsletter sign advertisement sponsored related copyright rights reserved".split()

    def __init__(self, seed: int = SEED) -> None:
        self.rng = np.random.default_rng(seed)

    def one(self, choices):
        return choices[int(self.rng.integers(len(choices)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def word(self) -> str:
        return "".join(self.one(self._SYLLABLES) for _ in range(int(self.rng.integers(1, 5))))

    def prose(self, most: int = 40, own: float = 0.0) -> str:
        out = [self.one(self._WORDS) if self.chance(own) else self.word() for _ in range(int(self.rng.integers(1, most)))]
        text = " ".join(out).capitalize()
        style = self.rng.random()
        if style < 0.06:
            text = " ".join(w.upper() + "!!" for w in out)
        elif style < 0.12:
            text = " ".join(w + self.one(["###", "***", "%%%", "$$$", "&amp;&amp;"]) for w in out)
        elif style < 0.16:
            text = " | ".join(out)
        return text + ("" if self.chance(0.2) else ".")

    def inside(self, how: str, body: list[tuple[str, int]], close: float = 1.0) -> None:
        """Write body in the elements of how, such as div.name other, or header nav."""
        ends = []
        parts = how.split() if "." not in how and "#" not in how else [how]
        if len(parts) == 1 and how.count(" ") and how.split()[-1] == "article" and how != "article":
            parts = [how.rsplit(" ", 1)[0], "article"]
        for part in parts:
            cut = min([part.find(c) for c in ".#" if c in part], default=len(part))
            tag, names = part[:cut], part[cut + 1 :]
            self.html.append(f"<{tag}" + (f' {"class" if part[cut] == "." else "id"}="{names.replace(" ", "-" if self.chance(0.5) else " ")}"' if names else "") + ">")
            ends.append(f"</{tag}>")
        for text, label in body:
            self.html.append(text)
            self.labels += [label] * (label >= 0)
        if self.chance(close):
            self.html += ends[::-1]

    def links(self, n: int) -> list[tuple[str, int]]:
        out = [("<ul>", -1)] if self.chance(0.7) else []
        listed = bool(out)
        for _ in range(n):
            t = self.one(self._WORDS) if self.chance(0.3) else self.prose(4)
            out.append((f'<li><a href="/{self.word()}">{t}</a></li>' if listed else f"<div><a href='#'>{t}</a></div>", 0))
        return [*out, ("</ul>", -1)] if listed else out

    def plain(self, own: float, most: int = 30) -> list[tuple[str, int]]:
        kind = self.rng.random()
        if kind < 0.4:
            return [(self.prose(most, own), 0)]
        if kind < 0.8:
            return [(f"<p>{self.prose(most, own)}</p>", 0) for _ in range(int(self.rng.integers(1, 4)))]
        return [(f"<h3>{self.prose(5, own)}</h3>", 0), *self.links(int(self.rng.integers(1, 6)))]

    def form(self) -> None:
        body = [(f"<label>{self.prose(4, 0.5)}</label><input type='text'>", 0) for _ in range(int(self.rng.integers(1, 4)))]
        self.inside(self.one(["form", "form.search", "form#contact", "form.comment form"]), [*body, ("<button>Send</button>", 0)])

    def comments(self) -> None:
        body = [("<h3>Comments</h3>", 0)] if self.chance(0.6) else []
        for _ in range(int(self.rng.integers(1, 7))):
            how = self.rng.random()
            text = self.prose(40)
            body.append((f'<div class="comment"><p>{text}</p></div>' if how < 0.5 else f"<li><p>{text}</p></li>" if how < 0.7 else f'<article class="comment"><p>{text}</p></article>' if how < 0.85 else f"<p>{text}</p>", 0))
        self.inside(self.one(self._COMMENTS), body)

    def minor(self) -> None:
        """A region that is not main text."""
        kind = int(self.rng.integers(8))
        if kind == 0:
            self.inside(self.one(self._MENU), self.links(int(self.rng.integers(2, 9))))
        elif kind == 1:
            self.inside(self.one(self._HEADER), self.plain(0.2, 8))
        elif kind == 2:
            self.inside(self.one(self._SIDE), self.plain(0.2))
        elif kind in (3, 4):
            self.inside(self.one(self._AD), self.plain(0.1))
        elif kind == 5:
            self.inside(self.one(self._NOTICE), self.plain(0.3))
        elif kind == 6:
            self.form()
        else:
            self.inside(self.one(self._FOOTER), self.plain(0.2))

    def article(self) -> None:
        start = len(self.html)
        body: list[tuple[str, int]] = []
        self.inside(self.one(self._BODY), [], close=0.0)
        opening = "".join(self.html[start:])
        ends = "".join(f"</{t}>" for t in ["article" if "<article" in opening else opening[1:].split(">")[0].split()[0]])
        if self.chance(0.85):
            body.append((f"<h1>{self.prose(14)}</h1>", 1))
        for _ in range(min(90, int(self.rng.geometric(0.07)) - 1)):
            kind = self.rng.random()
            t = self.prose(3 if self.chance(0.15) else 50)
            if kind < 0.7:
                body.append((f"<p>{t}</p>" if self.chance(0.9) else f"<p>{t}", 1))
            elif kind < 0.8:
                body.append((f"<p><b>{t}<br>" if self.chance(0.7) else f"<p><b>{t}</b><br></p>", 1))
            elif kind < 0.85:
                body.append((f"<h2>{self.prose(8)}</h2>", 1))
            elif kind < 0.9:
                body += [("<ul>", -1), *[(f"<li>{self.prose(15)}</li>", 1) for _ in range(int(self.rng.integers(1, 5)))], ("</ul>", -1)]
            elif kind < 0.93:
                body.append((f"<blockquote>{t}</blockquote>", 1))
            elif kind < 0.96:
                body += [("<table><tr>", -1), *[(f"<td>{self.prose(5)}</td>", 1) for _ in range(int(self.rng.integers(1, 6)))], ("</tr></table>", -1)]
            else:
                body.append((t if body and self.chance(0.5) and body[-1][0].endswith("</p>") else f"<div>{t}</div>", 1))
            if self.chance(0.04):
                self._add(body)
                body = []
                self.inside(self.one((*self._AD, *self._SIDE, *self._NOTICE)), self.plain(0.2))
        self._add(body)
        if self.chance(0.12):
            self.one((self.comments, self.form))()
        self.html.append(ends)

    def _add(self, body: list[tuple[str, int]]) -> None:
        for text, label in body:
            self.html.append(text)
            self.labels += [label] * (label >= 0)

    def page(self) -> tuple[list[Block], list[int]]:
        self.html: list[str] = []
        self.labels: list[int] = []
        bare = self.chance(0.05)  # a fragment: no head, and nothing before the article
        if not bare:
            self.html.append("<!DOCTYPE html><html><head>")
            if self.chance(0.9):
                self.html.append(f"<title>{self.prose(12)}</title>")
                self.labels.append(0)
            style, script = self.one(("p{margin:0}", "body > p { color: red }", "")), self.one(("var t='</p>';", "if (1 < 2) { go(); }", ""))
            self.html.append(f"<style>{style}</style><script>{script}</script></head><body>")
        if not bare and self.chance(0.7):
            self.inside(self.one(self._MENU), self.links(int(self.rng.integers(2, 9))))
        for _ in range(0 if bare else int(self.rng.integers(0, 4))):
            self.minor()
        if bare or self.chance(0.97):
            self.article()
        if self.chance(0.25):
            self.comments()
        for _ in range(int(self.rng.integers(0, 3))):
            self.minor()
        if self.chance(0.7):
            self.inside(self.one(self._FOOTER), [(f"&copy; {self.word()}.example.org &middot; {self.prose(25)}", 0)] if self.chance(0.6) else self.plain(0.3))
        if self.chance(0.9):
            self.html.append("</body></html>")
        return blocks("".join(self.html)), self.labels


def _disturbed(found: tuple[tuple[int, ...], list[int]], rng: np.random.Generator) -> tuple[tuple[int, ...], list[int]]:
    """A block's features with its words often missing or others, so that words alone decide nothing."""
    how, words = rng.random(), found[1]
    if how < 0.35:
        words = words[: int(rng.integers(0, 3))]
    elif how < 0.75:
        words = rng.integers(0, WORD_BUCKETS, int(rng.integers(0, FULL_WORDS + 1))).tolist()
    return found[0], words


@lru_cache(maxsize=1)
def trained(n_pages: int = PAGES, seed: int = SEED) -> Labeller:
    """The labeller, the same in every run."""
    writer, data = PageWriter(seed), []
    for _ in range(n_pages):
        page, labels = writer.page()
        if len(page) != len(labels):
            raise AssertionError("a rule wrote a block that the reader does not see")
        if page:
            data.append(([_disturbed(f, writer.rng) for f in features(page)], labels))
    return Labeller(seed).fit(data)


def _recipe() -> str:
    """What the weights follow from: the code that writes pages, reads them and trains."""
    code = inspect.getsource(html_blocks) + inspect.getsource(inspect.getmodule(trained))
    return hashlib.sha256(code.encode()).hexdigest()[:24]


def labeller(spark: SparkSession) -> Labeller:
    """The trained labeller, its weights kept in the shared folder: trained once for all sessions that share it."""
    path = f"{shared_dir(spark)}/quillfind/labeller-{_recipe()}"
    try:
        (row,) = spark.read.schema("weights binary").parquet(path).collect()
    except (AnalysisException, ValueError):
        made = trained()
        held = io.BytesIO()
        np.savez(held, *made.params())
        spark.createDataFrame([(held.getvalue(),)], "weights binary").coalesce(1).write.mode("overwrite").parquet(path)
        return made
    with np.load(io.BytesIO(bytes(row.weights))) as kept:
        return Labeller().take([kept[k] for k in kept.files])


def main_texts(labeller: Labeller, pages: list[str]) -> list[str]:
    cut = [blocks(p) for p in pages]
    return [" ".join([b.text for b, ok in zip(page, main) if ok]) for page, main in zip(cut, labeller.main(cut))]


def _extract(shared, most: int = 2 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = shared.value

        def out(ids: list, urls: list, held: list[str]) -> pa.RecordBatch:
            found = main_texts(labeller, held)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        for b in batches:
            ids, urls = b.column(0).to_pylist(), b.column(1).to_pylist()
            held, size, first = [], 0, 0
            for i, x in enumerate(b.column(2)):
                held.append(x.as_py() or "")
                size += len(held[-1])
                if size >= most:
                    yield out(ids[first : i + 1], urls[first : i + 1], held)
                    held, size, first = [], 0, i + 1
            if held:
                yield out(ids[first:], urls[first:], held)

    return run


def extract_main(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages have an empty text; null ids and urls stay null; repeated rows are each kept.
    Pages of any length and depth are read whole. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    shared = spark.sparkContext.broadcast(labeller(spark))
    return rows.mapInArrow(freeing(_extract(shared)), "page_id bigint, url string, text string, n_chars bigint")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(read_table(spark, sf_dir, "pages"))
