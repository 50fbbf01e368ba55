"""Main text of web pages: a recurrent block labeller over leaf sequences.

A page becomes a sequence of leaf blocks: stretches of text between block-level tags, with the path of open tags (names and
class words) and the hashed words.  A bidirectional LSTM in numpy reads a vector for each block (tag-path embedding, word
embedding, a few counts) in both directions and labels every block as main text or not, with the whole document as context.

The labeller is trained here, in seconds, on a bounded set: TRAIN_SYNTHETIC pages laid out by rule from the templates below
(articles under different tags, among menus, headers, footers, sidebars, notices, adverts, forms and reader comments) whose
words are taken from the table, and TRAIN_PAGES of its pages whose own sectioning tags say what is what.  Pages are then
labelled by the network alone.

Text inside a block has character references decoded, white space turned into one space, and is trimmed; blocks are joined
by one line feed.  Scripts, styles, templates, comments and markup are no blocks.  Tags that are never closed, unknown
references, null and empty pages are fine: a null page is an empty text.  Every row is returned, in any repetition.  Pages
are read in one forward pass: a quote that is never closed is a plain character, and a < that no > follows is text.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of the table and pages laid out by rule that the labeller is trained on, at most.
TRAIN_PAGES, TRAIN_SYNTHETIC = 120, 480
HIDDEN, PATH_DIM, WORD_DIM, BUCKETS = 16, 12, 6, 1024
EPOCHS, RATE, BATCH = 6, 0.01, 16
#: Blocks of pages labelled together (pages of like length).
LABEL_AT_ONCE = 4096

#: HTML elements by how they treat text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg object canvas textarea title".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li td th tr dd dt".split()),
    "li": frozenset(["li"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "tr": frozenset(["tr"]),
    "dd": frozenset(["dd", "dt"]),
    "dt": frozenset(["dd", "dt"]),
    "option": frozenset(["option"]),
}
#: Of RAW, those whose content is no markup: without an end tag they take the rest of the page.
TEXT_ONLY = frozenset("script style iframe textarea title".split())
#: A tag, matched without ever going back: quotes count only after an equals sign, and only if they are closed.
_TAG = re.compile(r"<(/?+)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
#: The same where some tag before was never closed: up to the next > whatever the quotes say.
_PLAIN_TAG = re.compile(r"<(/?+)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


@lru_cache(None)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I)


def leaf_blocks(page: str) -> list[tuple[tuple[str, ...], str]]:
    """``(path, text)`` of every leaf block of a page, in page order; path words are open tags and their class words."""
    out: list[tuple[tuple[str, ...], str]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    unclosed: set[str] = set()  # elements of RAW that no end tag follows any more
    at = 0

    def close() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((tuple(w for _, words in stack for w in words), text))

    tag, last = _TAG.match, page.rfind(">")
    while True:
        start = page.find("<", at)
        if start < 0:
            held.append(page[at:])
            close()
            return out
        held.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if start > last:  # no tag ends here any more
            held.append(page[start:])
            close()
            return out
        if page[start + 1] in "!?":
            at = page.index(">", start) + 1
            continue
        m = tag(page, start)
        if m is None and page[start + 1 : start + 3].lstrip("/")[:1].isalpha():
            tag = _PLAIN_TAG.match  # a tag with a > inside quotes only: from here on quotes mean nothing
            m = tag(page, start)
        if m is None:
            held.append("<")
            at = start + 1
            continue
        at = m.end()
        name = m[2].lower()
        if name in INLINE:
            if name == "br":
                held.append(" ")
            continue
        if m[1]:
            close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        close()
        if name in RAW:
            if name not in unclosed:
                end = _end_of(name).search(page, at)
                if end is None:
                    unclosed.add(name)
                if end or name in TEXT_ONLY:
                    at = end.end() if end else len(page)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        while stack and name in CLOSED_BY.get(stack[-1][0], ()):
            stack.pop()
        words = [name]
        if m[3]:
            words += [x for a in _ATTR.findall(m[3]) for x in _NAME.findall("".join(a).lower())]
        stack.append((name, tuple(words)))


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


@lru_cache(100_000)
def _path_ids(path: tuple[str, ...]) -> np.ndarray:
    return np.array([_bucket("/" + w) for w in path] or [0])


@lru_cache(200_000)
def _word_id(word: str) -> int:
    return _bucket(word)


class Labeller:
    """Embeddings, two LSTM directions and a logistic output; weights are one dict of arrays."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + 4
        self.w = {"path": r.normal(0, 0.3, (BUCKETS, PATH_DIM)), "word": r.normal(0, 0.1, (BUCKETS, WORD_DIM)), "out": r.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        for side in "fb":
            self.w[f"x{side}"] = r.normal(0, 0.2, (d, 4 * HIDDEN))
            self.w[f"h{side}"] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.w[f"c{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def inputs(self, blocks: list[tuple[tuple[str, ...], str]]) -> tuple[np.ndarray, list]:
        """A vector for each block, and the bucket lists behind it."""
        paths = [_path_ids(p) for p, _ in blocks]
        texts = [t.split() for _, t in blocks]
        words = [np.fromiter(map(_word_id, t), np.int64, len(t)) for t in texts]
        x = np.zeros((len(blocks), PATH_DIM + WORD_DIM + 4), np.float32)
        n_p, n_w = (np.fromiter(map(len, a), np.int64, len(a)) for a in (paths, words))
        x[:, :PATH_DIM] = np.add.reduceat(self.w["path"][np.concatenate(paths)], np.cumsum(n_p) - n_p) / np.sqrt(n_p)[:, None]
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = np.add.reduceat(self.w["word"][np.concatenate(words)], np.cumsum(n_w) - n_w) / np.sqrt(n_w)[:, None]
        x[:, -4] = np.log1p(n_w) / 3
        x[:, -3] = [t.endswith((".", "!", "?")) for _, t in blocks]
        x[:, -2] = np.arange(len(blocks)) / len(blocks)
        x[:, -1] = 1 / len(blocks)
        return x, [paths, words]

    def _run(self, x: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """Hidden states ``(batch, time, HIDDEN)`` of one direction over already ordered inputs."""
        w, u, b = self.w[f"x{side}"], self.w[f"h{side}"], self.w[f"c{side}"]
        pre = x @ w + b
        h = c = np.zeros((len(x), HIDDEN), np.float32)
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        for t in range(x.shape[1]):
            g = pre[:, t] + h @ u
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            n = np.tanh(g[:, 3 * HIDDEN :])
            before, last = c, h
            c = f * c + i * n
            tc = np.tanh(c)
            h = out[:, t] = o * tc
            if keep is not None:
                keep.append((i, f, o, n, before, last, tc))
        return out

    @staticmethod
    def _turned(sizes: np.ndarray, longest: int) -> np.ndarray:
        """Time indices that read each sequence backwards and leave the padding at the end."""
        t = np.arange(longest)[None, :]
        return np.where(t < sizes[:, None], sizes[:, None] - 1 - t, t)

    def forward(self, x: np.ndarray, sizes: np.ndarray, keep: list | None = None) -> np.ndarray:
        turn = self._turned(sizes, x.shape[1])
        rows = np.arange(len(x))[:, None]
        sides = [[], []] if keep is not None else [None, None]
        hf = self._run(x, "f", sides[0])
        hb = self._run(x[rows, turn], "b", sides[1])[rows, turn]
        z = hf @ self.w["out"][:HIDDEN] + hb @ self.w["out"][HIDDEN:] + self.w["bias"][0]
        if keep is not None:
            keep += [turn, rows, sides, hf, hb]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _back(self, x: np.ndarray, side: str, kept: list, dh_all: np.ndarray, grad: dict) -> np.ndarray:
        w, u = self.w[f"x{side}"], self.w[f"h{side}"]
        dx = np.zeros_like(x)
        dh = dc = np.zeros((len(x), HIDDEN), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            i, f, o, n, before, last, tc = kept[t]
            dh = dh + dh_all[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            g = np.concatenate([dc * n * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - n * n)], 1)
            grad[f"x{side}"] += x[:, t].T @ g
            grad[f"h{side}"] += last.T @ g
            grad[f"c{side}"] += g.sum(0)
            dx[:, t] = g @ w.T
            dh, dc = g @ u.T, dc * f
        return dx

    def train(self, pages: list[tuple[list, list[int]]], epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam on the blocks' log loss; ``pages`` are (blocks, labels)."""
        r = np.random.default_rng(seed)
        m, v, step = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2)), None, 0
        m, v = list(m)
        for _ in range(epochs):
            order = sorted(r.permutation(len(pages)), key=lambda i: len(pages[i][0]) // 8)
            batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            for at in r.permutation(len(batches)):
                part = [pages[i] for i in batches[at]]
                sizes = np.array([len(b) for b, _ in part])
                x, y, on = np.zeros((len(part), sizes.max(), PATH_DIM + WORD_DIM + 4), np.float32), *np.zeros((2, len(part), sizes.max()), np.float32)
                behind = []
                for n, (blocks, labels) in enumerate(part):
                    x[n, : sizes[n]], ids = self.inputs(blocks)
                    behind.append(ids)
                    y[n, : sizes[n]], on[n, : sizes[n]] = labels, 1
                keep: list = []
                p = self.forward(x, sizes, keep)
                turn, rows, sides, hf, hb = keep
                dz = (p - y) * on / on.sum()
                grad = {k: np.zeros_like(a) for k, a in self.w.items()}
                grad["bias"][0] = dz.sum()
                grad["out"] = np.concatenate([(hf * dz[..., None]).sum((0, 1)), (hb * dz[..., None]).sum((0, 1))])
                dx = self._back(x, "f", sides[0], dz[..., None] * self.w["out"][:HIDDEN], grad)
                dx += self._back(x[rows, turn], "b", sides[1], (dz[..., None] * self.w["out"][HIDDEN:])[rows, turn], grad)[rows, turn]
                for n, ids in enumerate(behind):
                    for name, lists, a, b in (("path", ids[0], 0, PATH_DIM), ("word", ids[1], PATH_DIM, PATH_DIM + WORD_DIM)):
                        count = np.fromiter(map(len, lists), np.int64, len(lists))
                        np.add.at(grad[name], np.concatenate(lists), np.repeat(dx[n, : sizes[n], a:b] / np.sqrt(count)[:, None], count, axis=0))
                step += 1
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.w[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def label(self, pages: list[list[tuple[tuple[str, ...], str]]]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= LABEL_AT_ONCE:
                end += 1
            part = order[at:end]
            sizes = np.array([len(pages[i]) for i in part])
            x = np.zeros((len(part), sizes.max(), PATH_DIM + WORD_DIM + 4), np.float32)
            for n, i in enumerate(part):
                x[n, : sizes[n]] = self.inputs(pages[i])[0]
            p = self.forward(x, sizes)
            for n, i in enumerate(part):
                out[i] = p[n, : sizes[n]] >= 0.5
            at = end
        return out


#: Words of sectioning tags and classes, by what they hold.
MAIN_PATHS = ("article", "main", "main article", "div:article", "div:content", "div:post-body", "section:story", "div:main-content div:entry", "body")
CHROME = {
    "nav": ("nav ul li", "nav", "div:menu ul li", "ul:navigation li", "div:breadcrumb", "header nav ul li"),
    "header": ("header", "div:header", "div:masthead", "header div:logo"),
    "footer": ("footer", "div:footer", "footer p", "div:copyright"),
    "aside": ("aside", "aside p", "div:sidebar", "div:related ul li", "aside ul li", "div:widget"),
    "notice": ("div:cookie-notice", "div:banner", "div:consent p", "div:newsletter", "div:notice"),
    "ad": ("div:ad", "div:advert", "div:sponsored p", "div:promo", "div:adsbygoogle"),
    "form": ("form label", "form", "form button", "div:search-form label", "form select option"),
    "comment": ("section:comments p", "div:comments div:comment p", "ol:commentlist li", "div:reader-comments p", "div:comment"),
}


def _path(text: str) -> tuple[str, ...]:
    return tuple(w for part in text.split() for w in _NAME.findall(part.lower()))


def synthetic(words: list[str], number: int) -> tuple[list, list[int]]:
    """One page laid out by rule: blocks with labels."""
    r = np.random.default_rng([1997, number])
    pick = lambda a: a[int(r.integers(len(a)))]
    say = lambda lo, hi, end=".": " ".join(words[i] for i in r.integers(0, len(words), int(r.integers(lo, hi)))) + end
    blocks, labels = [], []

    def chrome(kind: str, inside: str = "") -> None:
        path = ("html", "body", *_path(inside), *_path(pick(CHROME[kind])))
        long = kind in ("comment", "aside", "ad", "footer", "notice") and r.random() < 0.7
        for _ in range(int(r.integers(1, 8 if kind in ("nav", "comment") else 3))):
            blocks.append((path, say(4, 40) if long else say(1, 6, pick(["", "", "."]))))
            labels.append(0)

    for kind in ("header", "nav", "notice", "ad"):
        if r.random() < (0.9 if kind == "nav" else 0.4):
            chrome(kind)
    main = pick(MAIN_PATHS[:8] * 3 + MAIN_PATHS[8:])
    base = ("html", "body", *(_path(main) if main != "body" else ()))
    for n in range(1 + int(r.exponential(9))):
        tag = pick(["p"] * 8 + ["h1" if n == 0 else "h2", "li", "blockquote", "pre", "td"])
        if n == 0 and r.random() < 0.7:
            tag = "h1"
        nest = {"li": ("ul", "li"), "td": ("table", "tr", "td")}.get(tag, (tag,))
        blocks.append(((*base, *nest), say(1, 12, pick(["", ".", "."])) if tag[0] == "h" or r.random() < 0.3 else say(3, 90, pick([".", ".", "", " |", " &"]))))
        labels.append(1)
        if r.random() < 0.12 and n:
            chrome(pick(["ad", "aside", "notice", "form"]), main if main != "body" else "")
    for kind in ("comment", "aside", "form", "ad", "footer"):
        if r.random() < (0.85 if kind == "footer" else 0.4):
            chrome(kind)
    return blocks, labels


#: What a page's own sectioning tags and class words say.
_SAYS_MAIN = frozenset(["article", "main"])
_SAYS_NOT = frozenset("nav header footer aside form ad ads advert sidebar comments comment cookie banner menu".split())


def _by_tags(blocks: list) -> list[int] | None:
    """Labels from sectioning tags, where a page has any."""
    labels = [int(bool(_SAYS_MAIN & set(p)) and not _SAYS_NOT & set(p)) for p, _ in blocks]
    return labels if any(labels) else None


def fit(df: DataFrame, key: str = "page_id", html: str = "html") -> Labeller:
    """A labeller from at most TRAIN_PAGES pages of the table (smallest hashes of their ids) and the laid-out pages."""
    sample = df.select(F.col(key).alias("k"), F.length(html).alias("n")).where("n > 0 and k is not null").orderBy(F.xxhash64("k"), "k").limit(TRAIN_PAGES)
    ids = [r.k for r in sample.collect()]
    pages = [leaf_blocks(r[0]) for r in df.where(F.col(key).isin(ids)).orderBy(F.xxhash64(key), key, html).select(html).limit(TRAIN_PAGES).collect() if r[0]] if ids else []
    words = sorted({w for b in pages for _, t in b for w in t.split()[:50]})[:20000] or ["text", "words", "of", "the", "page"]
    train = [(b, y) for b in pages if b and (y := _by_tags(b))]
    train += [synthetic(words, n) for n in range(TRAIN_SYNTHETIC)]
    labeller = Labeller()
    labeller.train(train)
    return labeller


def extract(df: DataFrame, keep: list[str], labeller: Labeller, html: str = "html", out: str = "text") -> DataFrame:
    """``keep`` columns and the main text of every row."""
    shared = df.sparkSession.sparkContext.broadcast(labeller.w)  # a fixed number of weights

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = Labeller()
        net.w = shared.value
        for rows in parts:
            pages = [leaf_blocks(h) if isinstance(h, str) else [] for h in rows]
            main = net.label(pages)
            yield pd.Series(["\n".join(t for (_, t), on in zip(b, y, strict=True) if on) for b, y in zip(pages, main, strict=True)], dtype=object)

    return df.select(*(F.col(f"`{c}`") for c in keep), run(F.col(html)).alias(out))
