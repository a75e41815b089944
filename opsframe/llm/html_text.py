"""Main text of web pages: a bidirectional LSTM labels every leaf block of a page."""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.textkit import Words, text_buffers

PATH_DIM, LEAF_DIM, WORD_DIM, HIDDEN = 192, 64, 48, 16
#: Blocks of a page that go through the networks at once, and characters of pages that a task takes apart together.
STRETCH, PAGES_CHARS = 4096, 4_000_000
_NUMBERS = 7
INPUT = PATH_DIM + LEAF_DIM + WORD_DIM + _NUMBERS

# Element names by their part in a page.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "math", "iframe")
FOREIGN = ("svg", "math")  # a slash at the end of the tag closes these
TEXT_ONLY = ("script", "style", "textarea", "iframe")  # without an end tag they reach to the end of the page
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
CONTENT = ("article", "main")
APART = ("nav", "footer", "header", "aside", "form", "head", "button", "select", "option", "dialog", "menu", "title", "noscript")
NOISE_WORDS = ("ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "consent", "footer", "header", "menu", "modal", "nav", "navbar", "newsletter", "notice", "popup", "promo", "related", "reply", "respond", "share", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget")
CONTENT_WORDS = ("article", "content", "post", "entry", "story")

#: A quote opens a value only after an equals sign; elsewhere in a tag it is an ordinary character.
_MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")


def _bits(words: tuple[str, ...], salt: str, dim: int) -> int:
    mask = 0
    for w in words:
        mask |= 1 << zlib.crc32(f"{salt}{w}".encode()) % dim
    return mask


class Element:
    """An open element: its words, and what it and all elements above it say together, so that depth costs nothing."""

    __slots__ = ("above", "apart", "inside", "kinds", "leaf", "name", "path", "words")

    def __init__(self, above: Element | None, name: str, words: tuple[str, ...]):
        self.above, self.name, self.words, self.kinds = above, name, words, None
        own = (name, *words)
        self.path = (above.path if above else 0) | _bits(own, "", PATH_DIM)
        self.leaf = _bits(own, "leaf ", LEAF_DIM)
        told = words if name not in ("html", "body") else ()  # what the whole page is called says nothing of a part
        self.inside = bool(above and above.inside) or name in CONTENT or any(w in CONTENT_WORDS for w in told)
        self.apart = bool(above and above.apart) or name in APART or any(w in NOISE_WORDS for w in told)

    def within(self, name: str, words: tuple[str, ...]) -> Element:
        """The element of that name and words inside this one; equal ones are one, so that a list of any length has one kind of item."""
        if self.kinds is None:
            self.kinds = {}
        found = self.kinds.get((name, words))
        if found is None:
            found = self.kinds[name, words] = Element(self, name, words)
        return found

    @property
    def label(self) -> bool | None:
        """What the markup itself says: main text, apart from it, or (None) nothing.  Only training pages are labelled by it."""
        return False if self.apart else True if self.inside else None


_ROOT = Element(None, "", ())


@dataclass(slots=True)
class Block:
    at: Element
    text: str
    linked: int  # characters inside links


@functools.cache
def _ends(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?:[\\s/][^>]*)?(?:>|\\Z)", re.I)


def leaf_blocks(page: str) -> list[Block]:
    """The page's texts between block-level tags, in order, with the open element around each.

    An element's words are those of its class, id and role.  Scripts, styles and
    drawings are skipped to their end tag and do not end the block around them;
    without an end tag, scripts and their like reach to the end of the page, and
    of others only the tag is skipped.  Inline tags and line breaks stay inside a
    block.
    """
    out: list[Block] = []
    stack: list[Element] = [Element(None, "", ())]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(stack[-1], text, linked))
            parts.clear()
        linked = 0

    def close() -> str:
        name = stack.pop().name
        opened[name] -= 1
        return name

    while at < len(page):
        m = _MARKUP.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            parts.append(page[at:end])
            linked += (end - at) * in_link
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "a":
            in_link = not m[1]
        elif name == "br":
            parts.append(" ")
        if name in INLINE:
            continue
        if name in RAW:
            if m[1] or name in FOREIGN and m[3].rstrip().endswith("/"):
                continue
            ending = _ends(name).search(page, at)
            at = ending.end() if ending else len(page) if name in TEXT_ONLY else at
            continue
        flush()
        if m[1]:
            while opened[name] and close() != name:
                pass
            continue
        if name in ("p", "li", "option", "tr", "td", "th", "dt", "dd") and stack[-1].name == name:
            close()
        if name not in VOID and not m[3].rstrip().endswith("/"):
            words = tuple(w for g in _NAMES.findall(m[3]) for w in _PART.findall(" ".join(g).lower())) if "=" in m[3] else ()
            stack.append(stack[-1].within(name, words))
            opened[name] += 1
    flush()
    return out


def _unpacked(masks: list[int], dim: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(m.to_bytes(dim // 8, "little") for m in masks), np.uint8).reshape(len(masks), dim // 8), axis=1)


def features(pages: list[list[Block]], place: np.ndarray | None = None) -> np.ndarray:
    """Vectors of all blocks: hashed words of the whole tag path and of its last element, hashed words and shape of the text.

    ``place``: the blocks' places in their pages, from 0 to 1, where ``pages`` are parts of pages.
    """
    blocks = [b for p in pages for b in p]
    x = np.zeros((len(blocks), INPUT), np.float32)
    if not blocks:
        return x
    x[:, :PATH_DIM] = _unpacked([b.at.path for b in blocks], PATH_DIM)
    x[:, PATH_DIM : PATH_DIM + LEAF_DIM] = _unpacked([b.at.leaf for b in blocks], LEAF_DIM)
    words = Words(*text_buffers(pa.array([b.text for b in blocks], pa.large_string())))
    block = np.repeat(np.arange(len(blocks)), words.counts)
    bag = np.bincount(block * WORD_DIM + (words.hash % np.uint64(WORD_DIM)).astype(np.int64), minlength=len(blocks) * WORD_DIM)
    n = np.maximum(words.counts, 1)
    x[:, PATH_DIM + LEAF_DIM : -_NUMBERS] = np.minimum(bag.reshape(-1, WORD_DIM) / np.sqrt(n)[:, None], 2)
    size = np.array([len(b.text) for b in blocks], np.float32)
    place = np.concatenate([np.arange(len(p)) / max(len(p), 1) for p in pages]) if place is None else place
    x[:, -_NUMBERS:] = np.stack([
        np.log1p(size) / 5, np.minimum(n, 50) / 25, np.array([min(1.0, b.linked / len(b.text)) for b in blocks]), place,
        np.array([b.text[-1] in ".!?\"'" for b in blocks]), np.array([any(c in b.text for c in "©|»›·") for b in blocks]), np.ones(len(blocks)),
    ], 1)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BlockLabeller:
    """Two LSTMs over a page's block sequence, forward and backward, and a logistic output for every block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        shape = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {f"{d}{k}": v for d in "fb" for k, v in (("w", shape(INPUT, 4 * HIDDEN)), ("u", shape(HIDDEN, 4 * HIDDEN)), ("c", np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)))}
        self.p |= {"o": shape(2 * HIDDEN + INPUT), "ob": np.zeros(1, np.float32)}

    @staticmethod
    def _pad(x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        t = max(sizes)
        mask = np.arange(t)[:, None] < np.array(sizes)[None]
        out = np.zeros((t, len(sizes), x.shape[1]), np.float32)
        out.transpose(1, 0, 2)[mask.T] = x
        return out, mask

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, state: list | None = None) -> tuple[np.ndarray, list]:
        """Outputs at every place.  ``state``: a list of the two vectors to begin with, which then holds those at the end."""
        z_all = x @ self.p[d + "w"] + self.p[d + "c"]
        h, c = state or [np.zeros((x.shape[1], HIDDEN), np.float32)] * 2
        out, cache = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = z_all[t] + h @ self.p[d + "u"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = np.where(m, f * c + i * g, 0)  # zero beyond a page's end: the backward pass starts fresh there
            tc = np.tanh(c2)
            h2 = np.where(m, o * tc, 0)
            if keep:
                cache.append((t, h, c, i, f, o, g, tc, m))
            h, c = h2, c2
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out, cache

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        hf, cf = self._run(x, mask, "f", keep)
        hb, cb = self._run(x, mask, "b", keep)
        all_ = np.concatenate((hf, hb, x), 2)
        return all_ @ self.p["o"] + self.p["ob"], (all_, cf, cb)

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, seed: int = 9) -> BlockLabeller:
        """Back-propagation through time with Adam; ``pages``: features and 0/1 labels of each page's blocks."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        by_size = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        batches = [by_size[k : k + 32] for k in range(0, len(by_size), 32)]
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                some = [pages[i] for i in batches[b]]
                x, mask = self._pad(np.concatenate([a for a, _ in some]), [len(y) for _, y in some])
                y, _ = self._pad(np.concatenate([y for _, y in some])[:, None].astype(np.float32), [len(y) for _, y in some])
                z, (all_, cf, cb) = self.logits(x, mask, keep=True)
                dz = np.where(mask, _sigmoid(z) - y[..., 0], 0).astype(np.float32) / mask.sum()
                g = {"o": np.einsum("tb,tbk->k", dz, all_), "ob": dz.sum(keepdims=True).ravel()}
                for d, cache, k in (("f", cf, 0), ("b", cb, HIDDEN)):
                    g |= self._back(x, dz[..., None] * self.p["o"][k : k + HIDDEN], cache, d)
                step += 1
                for k in self.p:
                    gk = np.clip(g[k], -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v[k] = 0.999 * v[k] + 0.001 * gk * gk
                    self.p[k] -= np.float32(8e-3) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _back(self, x: np.ndarray, dh_all: np.ndarray, cache: list, d: str) -> dict:
        w, u = self.p[d + "w"], self.p[d + "u"]
        gw, gu, gc = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32)
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t, h0, c0, i, f, o, g, tc, m in reversed(cache):
            dh = np.where(m, dh + dh_all[t], 0)
            dc = np.where(m, dc + dh * o * (1 - tc * tc), 0)
            dz = np.concatenate((dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), 1)
            gw += x[t].T @ dz
            gu += h0.T @ dz
            gc += dz.sum(0)
            dh, dc = dz @ u.T, dc * f
        return {d + "w": gw, d + "u": gu, d + "c": gc}

    def label_long(self, blocks: list[Block], stretch: int = STRETCH) -> np.ndarray:
        """Whether each block of one page is main text, in stretches of blocks: the networks' states go from one to the next, so the result is that of the whole page."""
        z = np.full(len(blocks), self.p["ob"][0], np.float32)
        starts = range(0, len(blocks), stretch)
        for d, weights, order in (("f", self.p["o"][:HIDDEN], starts), ("b", self.p["o"][HIDDEN : 2 * HIDDEN], reversed(starts))):
            state = [np.zeros((1, HIDDEN), np.float32)] * 2
            for lo in order:
                part = blocks[lo : lo + stretch]
                x = features([part], np.arange(lo, lo + len(part)) / len(blocks))[:, None]
                out, _ = self._run(x, np.ones((len(part), 1), bool), d, False, state)
                z[lo : lo + stretch] += (out @ weights)[:, 0]
                if d == "f":
                    z[lo : lo + stretch] += (x @ self.p["o"][2 * HIDDEN :])[:, 0]
        return z > 0

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length go together, a longer one than ``STRETCH`` blocks alone."""
        out: list[np.ndarray] = [self.label_long(p) if len(p) > STRETCH else np.zeros(0, bool) for p in pages]
        order = sorted((i for i in range(len(pages)) if 0 < len(pages[i]) <= STRETCH), key=lambda i: len(pages[i]))
        k = 0
        while k < len(order):
            size = len(pages[order[k]])
            n = max(1, min(128, 4 * STRETCH // size))
            some = [i for i in order[k : k + n] if len(pages[i]) <= 2 * size + 16]
            x, mask = self._pad(features([pages[i] for i in some]), [len(pages[i]) for i in some])
            z, _ = self.logits(x, mask)
            for j, i in enumerate(some):
                out[i] = z[: len(pages[i]), j] > 0
            k += len(some)
        return out


_CONTAINERS = ("article", "main", "div content", "div post body", "div entry content", "div story", "section article text", "div main", "div", "div text", "section", "td", "div page body", "section share story", "div header content", "article post comment", "main content sidebar")
_NOISE = (APART, ("div ad", "div sidebar", "div cookie notice", "section comments", "div comment", "ul menu", "div footer", "div header", "div related links", "div newsletter", "div share", "div banner", "div notice", "div promo"), tuple(f"{e} {w}" for w in NOISE_WORDS for e in ("div", "section", "ul")))
_TEXT_ELEMENTS = ("p", "h1", "h2", "h3", "li", "ul", "blockquote", "td")


def _path(*elements: str) -> Element:
    at = _ROOT
    for e in elements:
        if e:
            name, *words = e.split()
            at = Element(at, name, tuple(words))
    return at


def _around(rng: random.Random) -> str:
    """An element that holds parts of all kinds, often named like one of them."""
    noise = f"{rng.choice(NOISE_WORDS)} " if rng.random() < 0.75 else ""
    return f"{rng.choice(('div', 'div', 'section'))} {noise}{rng.choice(('', 'content', 'main', 'and content', 'story', 'page', 'wrapper', 'has', 'layout'))}"


def _variant(rows: list[tuple[Block, bool]], texts: list[str], rng: random.Random, bare: float) -> list[tuple[Block, bool]]:
    """The blocks of a page under other names: the main part and those around it are called something else, or nothing.

    Names may contradict: an element around the whole page is at times called
    like a part of it.  Blocks of other kinds, with texts from other pages, are
    put around and inside the main part.  ``bare``: how often a part around the
    main one gets no telling name, so that only its text and place tell it.
    """
    main, around = (rng.choice(_CONTAINERS),), _around(rng) if rng.random() < 0.4 else ""
    if rng.random() < 0.4:
        main = (_around(rng), *main)
    body = ("html", rng.choice(("body", "body", f"body single has {rng.choice(NOISE_WORDS)}", "body home post")), around)
    shells: dict[int, str] = {}
    put = functools.cache(_path)
    out = []
    for b, y in rows:
        own = b.at.name if b.at.name in (*_TEXT_ELEMENTS, "div") else "div"
        if y:
            at = put(*body, *main, own)
        elif b.at.apart:
            shell = shells.setdefault(id(b.at.above), "div" if rng.random() < bare else rng.choice(rng.choice(_NOISE)))
            at = put(*body, shell, own)
        else:
            at = b.at
        out.append((Block(at, b.text, b.linked), y))
    for _ in range(rng.randint(0, 6)):
        at = rng.randrange(len(out) + 1)
        within = 0 < at < len(out) and out[at - 1][1] and out[at][1]
        where = put(*body, *(main if within else ()), rng.choice(rng.choice(_NOISE)), *rng.choice(((), ("p",), ("p",), ("ul", "li"), ("div",), ("div", "p"), ("h1",), ("h2",), ("h3",))))
        for _ in range(rng.randint(1, 3)):
            text = rng.choice(texts)
            out.insert(at, (Block(where, text, len(text) if where.name == "li" or rng.random() < 0.2 else 0), False))
    return out


def training_pages(pages: list[str], variants: int = 6, blocks: int = 400, seed: int = 21) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of block sequences: pages whose markup marks their main text, and ``variants`` of each with other markup.

    The markup gives the labels of the training pages and nothing else; the
    network sees hashed names, texts and places.  Sequences are cut to the
    first ``blocks`` blocks: a bound on the sample, extraction reads all.
    """
    rng = random.Random(seed)
    parsed = [leaf_blocks(p) for p in pages]
    texts = [b.text for p in parsed for b in p if len(b.text) < 400] or ["text"]
    out = []
    for found in parsed:
        if True not in [b.at.label for b in found]:
            continue
        rows = [(b, bool(b.at.label)) for b in found][:blocks]
        out.append(rows)
        out += [_variant(rows, texts, rng, bare=0.2) for _ in range(variants)]
    if not out:
        return []
    vectors = features([[b for b, _ in rows] for rows in out])
    ends = np.cumsum([len(rows) for rows in out])[:-1]
    return [(x, np.array([y for _, y in rows])) for x, rows in zip(np.split(vectors, ends), out, strict=True) if rows]


def fit_labeller(pages: DataFrame, rows: int = 240, chars: int = 200_000, html_col: str = "html") -> BlockLabeller | None:
    """Trained on about ``rows`` pages of at most ``chars`` characters, taken by a hash of the page; None if no markup marks a main text."""
    fit = pages.where(F.length(html_col) <= chars)
    total = fit.count()
    unit = F.shiftrightunsigned(F.xxhash64(html_col, F.lit(13)), 11) / float(1 << 53)
    some = fit.where(unit < rows / max(total, 1)).select(html_col).distinct().collect()
    data = training_pages(sorted(r[0] for r in some))
    return BlockLabeller().fit(data) if data else None


def _page_groups(column: pa.Array, rows: int = 256) -> Iterator[list[str]]:
    """Pages in groups of at most ``rows`` and about ``PAGES_CHARS`` characters."""
    group, size = [], 0
    for x in column:
        page = x.as_py() or ""
        if group and (size + len(page) > PAGES_CHARS or len(group) == rows):
            yield group
            group, size = [], 0
        group.append(page)
        size += len(page)
    if group:
        yield group


def extract_text(pages: DataFrame, model: BlockLabeller | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: its blocks that the labeller keeps, in order, with an empty line between.

    Returns ``page_id, url, text, n_chars`` (code points), a row for each input
    row.  Null and empty pages, and pages without a main block, give an empty
    text.  Without a model (no page marks its main text) the markup alone
    decides.  Pages may be of any depth, and of any length that a task can hold
    with some 150 bytes more for each block; the networks see a long page in
    stretches.  Other columns are not looked at.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts: list[str] = []
            for group in _page_groups(batch.column("html")):
                parsed = [leaf_blocks(x) for x in group]
                keep = net.label(parsed) if net else [np.array([b.at.label is True for b in p], bool) for p in parsed]
                texts += ["\n\n".join(b.text for b, y in zip(p, k, strict=True) if y) for p, k in zip(parsed, keep, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [d.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return d.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
