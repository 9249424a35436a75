"""Main text of web pages by a recurrent block labeller.

A page is read into its blocks: the runs of text between block-level tags, each with the path of open elements above it.
A bidirectional LSTM in numpy reads the page's blocks in order, as vectors of path and hashed words, and labels every
block as article or not with the whole page in view. It is trained on pages of the corpus, labelled by the meaning of the
elements around their blocks, and on pages made of the corpus's texts in layouts drawn at random, where it is known of
every block what it is: articles in containers of any name or none, with menus, notices, forms, comments and other parts
around and between. Some pages' paths are hidden, so that words, sizes, links and neighbours count as well.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recurrent as R
from .bpe import pieces
from .common import hash_sample

#: Pages that the labeller is trained on, about, and the longest of them in characters.
SAMPLE, EXCERPT = 400, 60_000
WORD_SLOTS, NUMBERS, UNITS = 32, 6, 16
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td"
    " tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg iframe object canvas textarea title annotation annotation-xml".split())
#: Elements that a start tag of the same kind, or of a kind with it, closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that mark what is no article, and those that mark an article.
ASIDE = tuple(
    "ad ads advert adverts advertisement sponsor sponsored promo promos promoted banner cookie cookies consent notice notices alert"
    " sidebar side menu nav navigation navbar breadcrumb breadcrumbs header masthead footer comment comments replies reply respond"
    " share sharing social related recommended recommendations widget newsletter subscribe signup login search popup modal"
    " pagination pager copyright legal complementary contentinfo disclaimer".split()
)
ARTICLE = tuple("article content post story entry main body".split())
#: First words of names that speak of a page's layout, as in "has-sidebar".
_LAYOUT = frozenset("has no with without show hide".split())
_NO_ARTICLE = frozenset(("nav", "header", "footer", "aside", "form", "menu", "select", "dialog", "head"))
_ASIDE, _ARTICLE = frozenset(ASIDE), frozenset(ARTICLE)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_SHUT = re.compile(r"(?:^|[\s\"'])/\Z")  # a slash that ends a tag, and not the value of an attribute without quotes

# Slots of a path: names of elements anywhere, last and last but one; words of marks; a few for all other words.
_NAMES = {k: i for i, k in enumerate((*sorted(BLOCKS), *"a abbr b code em i small span strong label button math other".split()))}
_KNOWN = {k: i for i, k in enumerate((*ASIDE, *ARTICLE), 3 * len(_NAMES))}
OTHER_SLOTS = 24
PATH_SLOTS = -(-(3 * len(_NAMES) + len(_KNOWN) + OTHER_SLOTS) // 8) * 8


def _name_slot(name: str, depth: int = 2) -> int:
    return depth * len(_NAMES) + _NAMES.get(name, len(_NAMES) - 1)


@functools.lru_cache(20_000)
def _marks(marks: str) -> tuple[int, bool, bool]:
    """Of a class, id or role: the slots of its words, and whether it speaks of no article, or of one.

    In a name of several words only the first and the last count: "content-related-text" speaks of content.
    """
    bits, aside, inside = 0, False, False
    for name in _HUMP.sub("-", marks).lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if not words or words[0] in _LAYOUT:
            continue
        for word in {words[0], words[-1]}:
            slot = _KNOWN.get(word)
            bits |= 1 << (PATH_SLOTS - 1 - zlib.crc32(word.encode()) % OTHER_SLOTS if slot is None else slot)
            aside |= word in _ASIDE
            inside |= word in _ARTICLE
    return bits, aside, inside


class Element:
    """An open element: a step of the path, linked to the one around it, so that paths share what they have in common.

    ``bits`` are the slots of all names and marks down to here. ``aside`` and ``inside`` say whether any element down to
    here is no part of an article, or holds one: for the labels of training.
    """

    __slots__ = ("parent", "name", "marks", "bits", "aside", "inside")

    def __init__(self, parent: Element | None, name: str, marks: str = ""):
        self.parent, self.name, self.marks = parent, name, marks
        self.bits, self.aside, self.inside = parent and (parent.bits, parent.aside, parent.inside) or (0, False, False)
        if not name:
            return
        said, aside, inside = _marks(marks) if marks and name not in ("html", "body") else (0, False, False)
        self.bits |= 1 << _name_slot(name) | said
        # An article's own header has its headings.
        self.aside |= aside or name in _NO_ARTICLE and not (name == "header" and self.inside)
        self.inside |= inside or name in ("article", "main")

    def path(self) -> tuple[str, ...]:
        out, at = [], self
        while at.parent is not None:
            out.append(f"{at.name}.{at.marks}" if at.marks else at.name)
            at = at.parent
        return tuple(reversed(out))

    def slots(self) -> int:
        """The path's slots; the last two steps count apart as well."""
        out, at = self.bits, self
        for depth in range(2):
            if at.parent is not None:
                out |= 1 << _name_slot(at.name, depth)
                at = at.parent
        return out


@dataclass
class Block:
    """A run of text: the element it stands in, and how many of its characters are in links."""

    element: Element
    text: str
    linked: int


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; broken, unclosed and cut-off markup is read as far as it goes.

    Each step is of constant cost, however deep the page is nested.
    """
    page = page or ""
    out: list[Block] = []
    stack = [Element(None, "")]  # open elements
    where: dict[str, list[int]] = {}  # of each name, where in the stack it stands
    outer: list[int] = [0]  # where in the stack block-level elements stand
    parts: list[str] = []
    linked, at, links = 0, 0, 0

    def end() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(stack[-1], text, linked))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    def pop() -> None:
        nonlocal links
        name = stack.pop().name
        where[name].pop()
        links -= name == "a"
        if outer[-1] == len(stack):
            outer.pop()

    while True:
        lt = page.find("<", at)
        m = _TOKEN.match(page, lt) if lt >= 0 else None
        if lt < 0:
            add(page[at:])
            break
        if m is None and page[lt + 1 : lt + 2].isalpha():  # a tag with a quote that isn't closed ends at the next >
            m = _BROKEN.match(page, lt)
        if m is None:  # a plain less-than sign
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if closing:
            if name in BLOCKS:
                end()
            if where.get(name):
                i = where[name][-1]
                # An inline element doesn't close the blocks around it.
                if name in BLOCKS or outer[-1] < i:
                    while len(stack) > i:
                        pop()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            end()
            shut = CLOSES.get(name, {"p"})
            while len(stack) > 1 and (stack[-1].name not in BLOCKS or stack[-1].name in shut):
                pop()
        if name in VOID or _SHUT.search(m[3]):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        marks = " ".join(x for found in _MARK.findall(m[3]) for x in found if x) if m[3] else ""
        where.setdefault(name, []).append(len(stack))
        if name in BLOCKS:
            outer.append(len(stack))
        stack.append(Element(stack[-1], name, marks))
        links += name == "a"
    end()
    return out


def structural_label(element: Element) -> int:
    """1 if the elements around a block say that it is article text: for training only."""
    return int(element.inside and not element.aside)


# --- vectors -----------------------------------------------------------------------------------------------------------

_SLOT: dict[str, int] = {}


def _word_slot(word: str) -> int:
    got = _SLOT.get(word)
    if got is None:
        if len(_SLOT) > 300_000:
            _SLOT.clear()
        got = _SLOT[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_SLOTS
    return got


_PATHS: dict[int, np.ndarray] = {}


def _path_vector(slots: int) -> np.ndarray:
    got = _PATHS.get(slots)
    if got is None:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        raw = np.frombuffer(slots.to_bytes(PATH_SLOTS // 8, "little"), np.uint8)
        got = _PATHS[slots] = np.unpackbits(raw, bitorder="little").astype(np.float32)
    return got


def vectors(page: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """One vector for each block from ``first`` to ``last``: path, hashed words, and numbers on size, links and place."""
    n, part = len(page), page[first:last]
    out = np.zeros((len(part), PATH_SLOTS + WORD_SLOTS + NUMBERS), np.float32)
    for k, b in enumerate(part):
        i = first + k
        out[k, :PATH_SLOTS] = _path_vector(b.element.slots())
        words = b.text.split()
        counts = np.bincount([_word_slot(w) for w in words], minlength=WORD_SLOTS)
        out[k, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = counts / len(words)
        size = len(b.text)
        out[k, -NUMBERS:] = (np.log1p(len(words)) / 5, b.linked / size, i / n, 1 / (1 + i), 1 / (n - i), sum(map(b.text.count, ".,")) / (1 + len(words)))
    return out


class BlockLabeller:
    """Bidirectional LSTM over a page's blocks with a logistic output for each."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        width = PATH_SLOTS + WORD_SLOTS + NUMBERS
        self.p = R.lstm_params(rng, "lstm.f", width, UNITS) | R.lstm_params(rng, "lstm.r", width, UNITS)
        # What a block is by itself also reaches the output directly.
        self.p["out"] = (rng.standard_normal((2 * UNITS + width, 1)) / np.sqrt(2 * UNITS)).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def _forward(self, x: np.ndarray, mask: np.ndarray, keep=None):
        h = np.concatenate([R.both_ways(R.lstm, self.p, "lstm", x, mask, keep), x], 2)
        return h, R.sigmoid(h @ self.p["out"] + self.p["bias"])[:, :, 0]

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.01, seed: int = 0) -> None:
        rng, adam = np.random.default_rng(seed), R.Adam(self.p, rate)
        for epoch in range(epochs):
            order = sorted(rng.permutation(len(pages)), key=lambda i: len(pages[i][0]))  # pages of like length go together
            adam.rate = rate * (1 - 0.8 * epoch / epochs)
            for a in 24 * rng.permutation(-(-len(order) // 24)):
                batch = [pages[i] for i in order[a : a + 24]]
                x, mask = _stack([v for v, _ in batch])
                y, _ = _stack([label[:, None] for _, label in batch])
                x[rng.random(len(x)) < 0.05, :, :PATH_SLOTS] = 0  # pages whose paths are not to be seen
                keep = ([], [])
                h, prob = self._forward(x, mask, keep)
                d = ((prob - y[:, :, 0]) * mask / mask.sum())[:, :, None].astype(np.float32)
                grads = {"out": h.reshape(-1, h.shape[2]).T @ d.reshape(-1, 1), "bias": d.sum((0, 1))}
                dh = d @ self.p["out"].T
                R.both_ways_back(R.lstm_back, self.p, "lstm", x, keep, dh[:, :, : 2 * UNITS], grads)
                adam.step(grads)

    def label(self, pages: list[list[Block]], most: int = 4_000) -> list[np.ndarray]:
        """For each page which blocks are article text; pages of like length are read together.

        A page of more than ``most`` blocks is read in parts with the state carried from one to the next, so what is held
        at once is bounded and every block still has the whole page in view.
        """
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        out = [np.zeros(0, bool)] * len(pages)
        a = 0
        while a < len(order) and len(pages[order[a]]) <= most:
            z = a + 1
            while z < len(order) and len(pages[order[z]]) * (z + 1 - a) <= most:
                z += 1
            x, mask = _stack([vectors(pages[i]) for i in order[a:z]])
            for i, prob in zip(order[a:z], self._forward(x, mask)[1], strict=True):
                out[i] = prob[: len(pages[i])] >= 0.5
            a = z
        for i in order[a:]:
            out[i] = self._in_parts(pages[i], most)
        return out

    def _in_parts(self, page: list[Block], most: int) -> np.ndarray:
        spans = [(a, min(len(page), a + most)) for a in range(0, len(page), most)]
        h, state = np.empty((len(page), 2 * UNITS), np.float32), {}
        for a, z in spans:
            x = vectors(page, a, z)[None]
            h[a:z, :UNITS] = R.lstm(self.p, "lstm.f", x, np.ones(x.shape[:2], np.float32), state=state)[0]
        state, on = {}, np.empty(len(page), bool)
        for a, z in reversed(spans):
            x = vectors(page, a, z)[None]
            h[a:z, UNITS:] = R.lstm(self.p, "lstm.r", x[:, ::-1], np.ones(x.shape[:2], np.float32), state=state)[0, ::-1]
            score = np.concatenate([h[a:z], x[0]], 1) @ self.p["out"] + self.p["bias"]
            on[a:z] = R.sigmoid(score)[:, 0] >= 0.5
        return on


def _stack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(r) for r in rows)
    out, mask = np.zeros((len(rows), n, rows[0].shape[1]), np.float32), np.zeros((len(rows), n), np.float32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
        mask[i, : len(r)] = 1
    return out, mask


# --- training pages ----------------------------------------------------------------------------------------------------

#: Stands ahead of each article block of a made page; taken out again when the page is read.
KEEP = "\ue000"
_NEUTRAL = "col-8 col-md-12 row container wrapper wrap inner outer grid flex page left center block box region zone app root layout".split()


class _Layout:
    """Makes pages around articles: the containers and the parts around and between are drawn at random."""

    def __init__(self, words: list[str], rng: np.random.Generator):
        self.words, self.rng = words, rng

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def one(self, of):
        return of[int(self.rng.integers(len(of)))]

    def some(self, low: int, high: int) -> str:
        return html.escape(" ".join(self.one(self.words) for _ in range(self.rng.integers(low, high))))

    def neutral(self) -> str:
        """An attribute that says nothing, or none."""
        name = self.one(_NEUTRAL) if self.chance(0.6) else "".join(self.rng.choice(list("abcdefghijklmnoprstuvwxyz"), 5))
        return "" if self.chance(0.2) else f' {self.one(["class", "class", "id"])}="{name}"'

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.some(1, 4)}</a></li>' for i in range(self.rng.integers(low, high)))

    def mark(self, names: str) -> str:
        """A name out of these, plain or with a word before or after it."""
        name = self.one(names.split())
        more = self.one(["site", "page", "top", "block", "list", "box", "wrap", "inner", "content", "body"])
        name = self.one([name, name, name, f"{name}-{more}", f"{more}-{name}"])
        return f' {self.one(["class", "class", "id"])}="{name}"'

    # Parts that are no article.

    def menu(self) -> str:
        items = self.links(3, 9)
        inner = f"<ul>{items}</ul>" if self.chance(0.7) else re.sub(r"</?li>", " ", items)
        tag = self.one(["nav", "nav", "div", "ul", "div"])
        return f"<{tag}{self.neutral() if tag != 'div' or self.chance(0.4) else self.mark('menu nav navbar navigation breadcrumbs')}>{inner}</{tag}>"

    def header(self) -> str:
        tag = self.one(["header", "header", "div"])
        name = self.mark("header masthead banner") if tag == "div" else self.neutral()
        title = f"<{(t := self.one(['h1', 'div', 'p', 'span']))}>{self.some(1, 6)}</{t}>"
        return f"<{tag}{name}>{title}{self.menu() if self.chance(0.5) else ''}<p>{self.some(2, 10)}</p></{tag}>"

    def side(self) -> str:
        tag = self.one(["aside", "aside", "div", "section"])
        name = self.neutral() if tag == "aside" and self.chance(0.5) else self.mark("sidebar related widget side recommended")
        body = "".join(self.one([f"<h3>{self.some(1, 5)}</h3>", f"<ul>{self.links(2, 6)}</ul>", f"<p>{self.some(4, 40)}</p>", f"<ul><li>{self.some(2, 9)}<li>{self.some(2, 9)}</ul>"]) for _ in range(self.rng.integers(1, 5)))
        return f"<{tag}{name}>{body}</{tag}>"

    def form(self) -> str:
        name = self.neutral() if self.chance(0.5) else self.mark("search newsletter subscribe login signup")
        return f'<form{name} action="/s"><label>{self.some(1, 4)}</label><input name="q"><p>{self.some(3, 14)}</p><select><option>{self.some(1, 3)}<option>{self.some(1, 3)}</select><button>{self.some(1, 3)}</button></form>'

    def small(self) -> str:
        name = self.mark("ad ads advert sponsored promo cookie consent notice notices alert share social newsletter popup pagination legal disclaimer")
        text = self.some(2, 35)
        return f"<div{name}>{text if self.chance(0.5) else f'<p>{text}</p><p>{self.some(1, 12)}</p>'}{f'<ul>{self.links(2, 5)}</ul>' if self.chance(0.3) else ''}</div>"

    def comments(self) -> str:
        one = lambda: f"<{(t := self.one(['div', 'li', 'article']))}{self.mark('comment reply')}><p>{self.some(1, 4)}</p><p>{self.some(3, 60)}</p></{t}>"
        tag = self.one(["section", "div", "ol"])
        return f"<{tag}{self.mark('comments replies respond')}><h2>{self.some(1, 4)}</h2>{''.join(one() for _ in range(self.rng.integers(1, 7)))}</{tag}>"

    def footer(self) -> str:
        tag = self.one(["footer", "footer", "div"])
        name = self.mark("footer copyright contentinfo") if tag == "div" and self.chance(0.8) else self.neutral()
        text = f"{self.one(['&copy; ', '(c) ', 'Copyright '])}{self.some(1, 14)}"
        return f"<{tag}{name}>{self.one([text, f'<p>{text}</p>', f'<ul>{self.links(2, 7)}</ul><p>{text}</p>'])}</{tag}>"

    # Parts of an article.

    def inline(self, text: str) -> str:
        words = text.split(" ")
        if len(words) > 6 and self.chance(0.3):
            i = int(self.rng.integers(0, len(words) - 2))
            tag = self.one(['a href="/x"', "b", "em", "code", "math"])
            words[i : i + 2] = [f"<{tag}>{words[i]} {words[i + 1]}</{tag.split()[0]}>"]
        return " ".join(words)

    def piece(self, text: str) -> str:
        words = text.split()
        few = lambda low, high: KEEP + html.escape(" ".join(words[(i := int(self.rng.integers(len(words)))) : i + int(self.rng.integers(low, high))]))
        whole = KEEP + self.inline(html.escape(text))
        n = int(self.rng.integers(1, 6))
        kind = self.rng.random()
        if kind < 0.6:
            return f"<p>{whole if self.chance(0.85) else few(1, 12)}</p>" if self.chance(0.9) else f"<div{self.neutral()}>{whole}</div>"
        if kind < 0.7:
            return f"<{(t := self.one(['h2', 'h3', 'h4']))}>{few(1, 9)}</{t}>"
        if kind < 0.82:
            linked = lambda t: f'<a href="/r">{t}</a>' if self.chance(0.15) else t
            return f"<{(t := self.one(['ul', 'ol']))}>{''.join(f'<li>{linked(few(1, 15))}</li>' for _ in range(n))}</{t}>"
        if kind < 0.88:
            return f"<table>{''.join(f'<tr><th>{few(1, 3)}</th><td>{few(1, 6)}</td></tr>' for _ in range(n))}</table>"
        if kind < 0.92:
            return f"<dl>{''.join(f'<dt>{few(1, 3)}</dt><dd>{few(2, 14)}</dd>' for _ in range(n))}</dl>"
        if kind < 0.96:
            return f"<figure><img src='i'><figcaption>{few(2, 15)}</figcaption></figure>"
        return f"<{(t := self.one(['blockquote', 'pre']))}>{whole}</{t}>"

    def article(self, texts: list[str], parts: bool) -> str:
        title = KEEP + html.escape(" ".join(texts[0].split()[:8]))
        head = "" if self.chance(0.25) else f"<{(t := self.one(['h1', 'h1', 'h2']))}>{title}</{t}>"
        body = [self.piece(t) for t in texts]
        for _ in range(self.rng.integers(0, 3) if parts else 0):
            body.insert(int(self.rng.integers(0, len(body) + 1)), self.one([self.small, self.small, self.side, self.menu, self.form])())
        if parts and self.chance(0.1):
            body.append(self.footer() if self.chance(0.5) else self.comments())
        kind = self.rng.random()
        if kind < 0.3:
            if head and self.chance(0.3):
                head = f"<header{self.neutral()}>{head}</header>"
            return f"<{(t := self.one(['article', 'main', 'article']))}{self.neutral()}>{head}{''.join(body)}</{t}>"
        if kind < 0.5:
            name = self.one(["content", "post", "entry", "story", "article", "post-content", "main-text", "entry-body", "content-related-text", "article-text"])
            return f'<{(t := self.one(["div", "section"]))} {self.one(["class", "id"])}="{name}">{head}{"".join(body)}</{t}>'
        if kind < 0.8:
            return f"<{(t := self.one(['div', 'section', 'div']))}{self.neutral()}>{head}{''.join(body)}</{t}>"
        if kind < 0.85:
            return f"<table><tr><td>{head}{''.join(body)}</td></tr></table>"
        return head + "".join(body)

    def page(self, texts: list[str]) -> str:
        if self.chance(0.12):  # an article and nothing else
            middle = self.article(texts, parts=False)
        else:
            before = [self.one([self.menu, self.menu, self.header, self.small, self.side, self.form])() for _ in range(self.rng.integers(0, 4))]
            after = [self.one([self.menu, self.small, self.side, self.form, self.comments])() for _ in range(self.rng.integers(0, 4))]
            foot = [self.footer()] if self.chance(0.7) else []
            article = self.article(texts, parts=True) if self.chance(0.97) else ""
            if self.chance(0.2):  # what follows an article may stand in one element with it
                article, after = f"<main{self.neutral()}>{article}{''.join(after)}</main>", []
            middle = "".join([*before, article, *after, *foot])
        for _ in range(self.rng.integers(0, 4)):
            middle = f"<div{self.neutral()}>{middle}</div>"
        if self.chance(0.3):  # pages that leave out what may be left out
            return middle
        name = self.one(["", "", ' class="home has-sidebar"', ' class="post"', ' class="no-header single"'])
        return f"<html><head><title>t</title></head><body{name}>{middle}</body></html>"


def made_blocks(page: str) -> tuple[list[Block], np.ndarray]:
    """The blocks of a made page without their signs, and which of them are article text."""
    found = [b for b in blocks(page) if b.text != KEEP]
    on = np.array([b.text.startswith(KEEP) for b in found], np.float32)
    for b in found:
        b.text = b.text.replace(KEEP, "")
    return found, on


def train_labeller(pages: list[str], seed: int = 0, layouts: int = 4) -> BlockLabeller:
    """A labeller trained on every other page as it is, and on ``layouts`` made pages around the article of each."""
    rng, model = np.random.default_rng(seed), BlockLabeller(seed)
    read = [[b for b in blocks(p.replace(KEEP, "")) if b.text][:400] for p in pages]
    words = sorted({w for p in read[:50] for b in p for w in b.text.split()[:60]}) or ["text"]
    layout, made = _Layout(words, rng), []
    for k, page in enumerate(read):
        if not page:
            continue
        label = np.array([structural_label(b.element) for b in page], np.float32)
        if k % 2 == 0:
            made.append((vectors(page), label))
        texts = [b.text for b, on in zip(page, label, strict=True) if on and len(b.text.split()) > 3]
        for _ in range(layouts if texts else 0):
            chosen = [texts[i] for i in sorted(rng.choice(len(texts), min(len(texts), int(rng.integers(1, 12))), replace=False))]
            found, on = made_blocks(layout.page(chosen))
            if found:
                made.append((vectors(found[:400]), on[:400]))
    if made:
        model.train(made)
    return model


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> BlockLabeller:
    """Trains on about ``sample`` pages, chosen by a hash of the id; an empty table gives an untrained labeller."""
    rows = hash_sample(pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")), sample, "id")
    texts = [r["html"] for r in rows.where(F.length("html") <= EXCERPT).collect()]
    return train_labeller(sorted(t for t in texts if t)[:sample])


def extract(
    pages: DataFrame, model: BlockLabeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row: the blocks labelled as article, joined by line ends.

    A page that is null, empty or without article text has an empty text. Repeated rows each give a row; null ids and
    urls stay null; an empty table gives no rows. Pages are read whole, however long.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some tens of thousands of numbers, whatever the table

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in pieces([len(h or "") for h in b["html"]]):
                found = [blocks(h) for h in b["html"][s]]
                texts = [
                    "\n".join(x.text for x, on in zip(page, label, strict=True) if on)
                    for page, label in zip(found, shared.value.label(found), strict=True)
                ]
                yield pd.DataFrame(
                    {
                        "page_id": b["page_id"][s].astype("Int64").to_numpy(),
                        "url": b["url"][s].to_numpy(),
                        "text": texts,
                        "n_chars": [len(t) for t in texts],
                    }
                )

    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    ).mapInPandas(run, "page_id long, url string, text string, n_chars long")
