"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The model reads every character of a text and tags each as outside, or as the beginning or inside of a kind of span. It
is trained in numpy from labelled spans: examples are cut from a bounded sample of the corpus, with the spans that the base
patterns find there and with generated values of every kind put between the corpus's own words.

Texts are cut into windows that overlap; each window is decoded by itself, a character's tag is taken from the window that
has it in its middle, and the spans are read off the text's tags as a whole, so a value may cross windows. A window need not
be decoded step by step if no tag but "outside" can be worth its score and transitions anywhere in it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recurrent as R
from .bpe import pieces
from .common import hash_sample

#: Kinds in the order in which they are listed; the first four have base patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: From the first digit of a run on; what fails there fails from the run's later digits too.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Characters of a window, and of its overlap with the next one.
WINDOW, OVERLAP = 256, 64
#: Windows that are read at once.
READ = 1024
#: Documents that training examples are cut from, characters of each, and examples.
SAMPLE, EXCERPT, EXAMPLES = 500, 5_000, 5_000
UNITS, WIDTH = 14, 10
_SIGN = re.compile(r"[0-9@]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base patterns, leftmost and non-overlapping per kind, by start, then kind."""
    out = []
    if "@" in text:
        # Each match holds an @: start from it, so that long words without one aren't tried from each character.
        out += [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), "card"))
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE_KINDS.index(s[2]), s[1]))


_DIGIT = re.compile("[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What ``EMAIL.finditer`` finds, in time that is linear in the text."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


# --- the model ---------------------------------------------------------------------------------------------------------

_TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_OUTSIDE = 0
#: Characters have the classes 1 to 127 by code point, others one class; 0 is padding.
_CLASSES = 129


def _codes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(x < 128, np.maximum(x, 1), 128)


class SpanTagger:
    """Bidirectional LSTM over characters, CRF over tags."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        t = len(_TAGS)
        self.p = {"embed": (rng.standard_normal((_CLASSES, WIDTH)) * 0.3).astype(np.float32)}
        self.p |= R.lstm_params(rng, "lstm.f", WIDTH, UNITS) | R.lstm_params(rng, "lstm.r", WIDTH, UNITS)
        self.p["out"] = (rng.standard_normal((2 * UNITS, t)) / np.sqrt(2 * UNITS)).astype(np.float32)
        self.p["bias"] = np.zeros(t, np.float32)
        self.p["move"] = np.zeros((t, t), np.float32)
        # An inside tag follows the beginning or the inside of its kind only, and never stands first.
        self.barred = np.zeros((t, t), np.float32)
        for j, tag in enumerate(_TAGS):
            if tag[0] == "I":
                self.barred[:, j] = -1e4
                for i, before in enumerate(_TAGS):
                    if before[1:] == tag[1:]:
                        self.barred[i, j] = 0
        self.first = np.array([-1e4 if tag[0] == "I" else 0 for tag in _TAGS], np.float32)

    def _emit(self, codes: np.ndarray, mask: np.ndarray, keep=None):
        x = self.p["embed"][codes]
        h = R.both_ways(R.lstm, self.p, "lstm", x, mask, keep)
        return x, h, h @ self.p["out"] + self.p["bias"]

    def train(self, examples: list[tuple[np.ndarray, np.ndarray]], epochs: int = 4, rate: float = 0.015, seed: int = 0) -> None:
        """Gradient steps on the CRF likelihood of ``(codes, tags)`` examples."""
        rng, adam = np.random.default_rng(seed), R.Adam(self.p, rate)
        steps = epochs * -(-len(examples) // 64)
        done = 0
        for _ in range(epochs):
            order = sorted(rng.permutation(len(examples)), key=lambda i: len(examples[i][0]) // 16)
            batches = [order[i : i + 64] for i in range(0, len(order), 64)]
            for k in rng.permutation(len(batches)):
                adam.rate = rate * (1 - 0.9 * done / steps)
                done += 1
                adam.step(self._gradients([examples[i] for i in batches[k]]))

    def _gradients(self, batch: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
        codes, mask = padded([c for c, _ in batch])
        tags, _ = padded([t for _, t in batch])
        keep = ([], [])
        x, h, e = self._emit(codes, mask, keep)
        b, t, _ = e.shape
        chance = np.exp((self.p["move"] + self.barred).astype(np.float64))
        emit = np.exp((e - e.max(2, keepdims=True)).astype(np.float64))
        # Forward and backward passes in shares of each position's sum; what rows are scaled by falls out again.
        share = lambda v, axis=-1: v / np.maximum(v.sum(axis, keepdims=True), 1e-300)
        on = mask > 0
        alpha, beta = np.empty_like(emit), np.empty_like(emit)
        alpha[:, 0] = share(emit[:, 0] * np.exp(self.first))
        for i in range(1, t):
            alpha[:, i] = np.where(on[:, i, None], share((alpha[:, i - 1] @ chance) * emit[:, i]), alpha[:, i - 1])
        beta[:, -1] = 1
        for i in range(t - 1, 0, -1):
            beta[:, i - 1] = np.where(on[:, i, None], share((emit[:, i] * beta[:, i]) @ chance.T), beta[:, i])
        de = share(alpha * beta)
        np.put_along_axis(de, tags[:, :, None], np.take_along_axis(de, tags[:, :, None], 2) - 1, 2)
        de = (de * mask[:, :, None]).astype(np.float32)
        after = emit[:, 1:] * beta[:, 1:]
        weight = on[:, 1:] / np.maximum(((alpha[:, :-1] @ chance) * after).sum(2), 1e-300)
        k = e.shape[2]
        dmove = chance * (alpha[:, :-1].reshape(-1, k).T @ (after * weight[:, :, None]).reshape(-1, k))
        np.subtract.at(dmove, (tags[:, :-1][on[:, 1:]], tags[:, 1:][on[:, 1:]]), 1)
        de, dmove = de / b, dmove / b
        flat = de.reshape(-1, e.shape[2])
        grads = {"out": h.reshape(-1, h.shape[2]).T @ flat, "bias": flat.sum(0), "move": dmove.astype(np.float32)}
        dx = R.both_ways_back(R.lstm_back, self.p, "lstm", x, keep, de @ self.p["out"].T, grads)
        grads["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grads["embed"], codes, dx * mask[:, :, None])
        return grads

    def tags(self, codes: np.ndarray, sizes: np.ndarray) -> dict[int, np.ndarray]:
        """The likeliest tags of windows ``codes`` (time, window) of ``sizes``; windows all outside are left out."""
        fore, back = R.read_both_ways(R.lstm_read, self.p, "lstm", self.p["embed"], codes, sizes)
        out, n = np.ascontiguousarray(self.p["out"].T), UNITS
        e = np.matmul(out[:, :n], fore)
        e += np.matmul(out[:, n:], back)
        e += self.p["bias"][:, None]
        e[0] += self.first[:, None]
        move = self.p["move"] + self.barred
        inside = np.arange(len(codes))[:, None] < sizes
        rows = np.flatnonzero(self._may_hold(e, move, inside))
        if not len(rows):
            return {}
        e, mask = e[:, :, rows].transpose(0, 2, 1), inside[:, rows]
        best, links = e[0], np.zeros(e.shape, np.int8)
        for i in range(1, len(e)):
            step = best[:, :, None] + move
            on = mask[i][:, None]
            links[i] = np.where(on, step.argmax(1), np.arange(e.shape[2]))
            best = np.where(on, step.max(1) + e[i], best)
        at, found, every = best.argmax(1), np.zeros(e.shape[:2], np.int8), np.arange(len(rows))
        for i in range(len(e) - 1, -1, -1):
            found[i] = at
            at = links[i, every, at]
        return {int(r): found[: sizes[r], k] for k, r in enumerate(rows)}

    @staticmethod
    def _may_hold(e: np.ndarray, move: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Which windows have a span that could be worth more than staying outside; for the others nothing is.

        A span's worth over "outside" is that of its beginning, of each further character and of leaving it, with the best
        transition there is in place of the one taken. The largest sum of a run of characters is found in one pass.
        """
        stay, begins, insides = move[0, 0], np.arange(1, e.shape[1], 2), np.arange(2, e.shape[1], 2)
        enter = e[:, begins] + (move[:, begins].max(0) - stay)[:, None] - e[:, :1]
        on = e[:, insides] + (np.maximum(move[begins, insides], move[insides, insides]) - stay)[:, None] - e[:, :1]
        enter[~np.broadcast_to(inside[:, None], enter.shape)] = -1e9
        leave = np.maximum(0, np.maximum(move[begins, 0], move[insides, 0]) - stay)
        run = np.full(enter.shape[1:], -1e9, np.float32)
        best = run.copy()
        for t in range(len(e)):
            run += on[t]
            np.maximum(run, enter[t], out=run)
            np.maximum(best, run, out=best)
        return (best + leave[:, None] > -1e-3).any(0)


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(r) for r in rows)
    out, mask = np.zeros((len(rows), n), np.int64), np.zeros((len(rows), n), np.float32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
        mask[i, : len(r)] = 1
    return out, mask


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


# --- labelled examples -------------------------------------------------------------------------------------------------


def _value(rng: np.random.Generator, kind: str) -> tuple[str, str]:
    """What leads to a generated value of a kind, and the value, in one of several spellings."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    pick = lambda *a: a[rng.integers(len(a))]
    if kind == "email":
        name = letters(rng.integers(2, 10)) + pick("", "." + letters(rng.integers(2, 8)), "_" + digits(2), "." + digits(2))
        host = letters(rng.integers(3, 9)) + pick("", digits(1)) + pick("", "." + letters(rng.integers(3, 9)))
        return "", f"{name}@{host}.{pick('com', 'org', 'net', 'de', 'fr', 'es', 'co.uk')}"
    if kind == "ip":
        return "", ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        sep, n = pick("", "", "-", " "), int(pick(16, 16, 15, 13))
        value = [int(x) for x in digits(n)]
        value[-1] = next(d for d in range(10) if _luhn("".join(map(str, [*value[:-1], d]))))
        text = "".join(map(str, value))
        return "", sep.join(text[i : i + 4] for i in range(0, n, 4))
    if kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        return "", pick(f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"+{digits(11)}", f"({a}) {b}.{c}")
    alphabet = pick("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    value = "".join(rng.choice(list(alphabet), rng.integers(12, 49)))
    name = pick("token", "password", "api_key", "secret", "key", "passwd", "access_token", "auth")
    name = pick(name, name, name.upper(), name.title())
    if rng.random() < 0.2:
        return "", "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16))
    return pick(f'{name} = "', f"{name} = ", f"{name}=", f'{name}: "', f"{name}: ", f'"{name}": "', f"{name} '"), value


def _harmless(rng: np.random.Generator) -> str:
    """Digits and signs that are no personal data: years, counts, versions, dates, prices, sections, times, handles."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *a: a[rng.integers(len(a))]
    return pick(
        str(rng.integers(1500, 2100)), n(1), n(2), n(3), n(5), n(7), f"{n(1)}.{n(1)}", f"{n(1)}.{n(1)}.{n(2)}", f"{n(2)}.",
        f"20{n(2)}-{n(2)}-{n(2)}", f"{n(2)}/{n(2)}/20{n(2)}", f"${n(2)}.{n(2)}", f"{n(1)},{n(3)},{n(3)}", f"{n(2)}:{n(2)}", f"({n(1)})",
        f"[{n(2)}]", f"{n(2)}%", f"@{pick('home', 'work', 'noon', 'user')}", f"v{n(1)}.{n(1)}", f"{n(3)}-{n(3)}", f"no. {n(4)}", f"A{n(2)}", f"{n(3)}.{n(3)}",
    )


#: A long word with digits that no base pattern tells: it may be a secret or not, so no example is made of it.
_UNSURE = re.compile(r"(?=[^\s]*[0-9])[^\s]{10,}|[0-9][0-9 ().-]{6,}[0-9]|\S*@\S*\.\S*")


def _excerpt(text: str, rng: np.random.Generator, size: int) -> str:
    at = int(rng.integers(0, max(1, len(text) - size + 1)))
    return text[at : at + size]


def examples(texts: list[str], count: int = EXAMPLES, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(codes, tags)``: excerpts of the texts with their base spans, and excerpts with generated values put in."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t and t.strip()] or ["text"]
    out = []
    for _ in range(count * 2 // 5):
        text = _excerpt(texts[rng.integers(len(texts))], rng, int(rng.integers(40, 200)))
        spans = base_spans(text)
        rest = list(text)
        for a, b, _ in spans:
            rest[a:b] = " " * (b - a)
        if not _UNSURE.search("".join(rest)):
            out.append(_labelled(text, spans))
    while len(out) < count:
        t = _excerpt(texts[rng.integers(len(texts))], rng, 200)
        if rng.random() < 0.1:
            t = t.upper()
        words = [_SIGN.sub("x", w) for w in t.split()[1 : rng.integers(2, 14)]]
        parts: list = list(words) or ["x"]
        for _ in range(rng.integers(0, 4)):
            parts.insert(int(rng.integers(0, len(parts) + 1)), (KINDS[rng.integers(len(KINDS))], None))
        for _ in range(rng.integers(0, 3)):
            parts.insert(int(rng.integers(0, len(parts) + 1)), _harmless(rng))
        for _ in range(rng.integers(0, 3)):  # long words are no values either
            long = "".join(words[i] for i in rng.integers(0, len(words), rng.integers(2, 5))) if words else "x"
            parts.insert(int(rng.integers(0, len(parts) + 1)), re.sub(r"[^\w]", "", long)[:30])
        text, spans = "", []
        if rng.random() < 0.04:  # nor is a word said over and over
            parts = [str(rng.choice(words or ["x"]))] * int(rng.integers(10, 40))
        for part in parts:
            text += "" if not text else (" " if rng.random() < 0.9 else str(rng.choice(["\n", "  ", "\t"])))
            if isinstance(part, tuple):
                before, value = _value(rng, part[0])
                text += before
                spans.append((len(text), len(text) + len(value), part[0]))
                text += value + ("" if rng.random() < 0.6 else str(rng.choice(['"', ".", ",", ";", ":", "!", "?", ")", "!!", "###", "$$$", "%%%", "***", "&&&"])))
            else:
                text += part
        out.append(_labelled(text, spans))
    return out


def _labelled(text: str, spans: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    tags = np.zeros(len(text), np.int64)
    for a, b, kind in sorted(spans, key=lambda s: -KINDS.index(s[2])):
        tags[a:b] = _TAGS.index(f"I-{kind}")
        tags[a] = _TAGS.index(f"B-{kind}")
    return _codes(text), tags


# --- decoding ----------------------------------------------------------------------------------------------------------


def model_spans(model: SpanTagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """``(start, end, kind)`` of the spans that the model tags in each text, in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes, base = _codes("".join(texts)), np.cumsum(sizes) - sizes
    text, start, begin, end = R.windows(sizes, WINDOW, OVERLAP)
    length = np.minimum(sizes[text], WINDOW)
    tags = np.zeros(len(codes), np.int8)
    order = np.argsort(-length, kind="stable")
    for i in range(0, len(order), READ):
        part = order[i : i + READ]
        at = base[text[part]] + start[part]
        place = np.minimum(at + np.arange(length[part[0]])[:, None], len(codes) - 1)
        for k, found in model.tags(codes[place], length[part]).items():
            w = part[k]
            a = base[text[w]]
            tags[a + begin[w] : a + end[w]] = found[begin[w] - start[w] : end[w] - start[w]]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    on = np.flatnonzero(tags)
    owner = np.searchsorted(base, on, "right") - 1
    open_kind, last, last_text = None, -2, -1
    for at, i in zip(on.tolist(), owner.tolist(), strict=True):
        tag = _TAGS[tags[at]]
        if tag[0] == "I" and at == last + 1 and i == last_text and tag[2:] == open_kind:
            a, _, kind = out[i][-1]
            out[i][-1] = (a, at + 1 - int(base[i]), kind)
        else:
            open_kind = tag[2:]
            out[i].append((at - int(base[i]), at + 1 - int(base[i]), open_kind))
        last, last_text = at, i
    return out


#: An at sign, as such or spelled out.
_AT = re.compile(r"[@\uff20]|\bat\b", re.I)


def _may_be(kind: str, value: str) -> bool:
    """Whether a tagged value has what its kind can't do without."""
    if kind == "card":
        digits = re.sub("[^0-9]", "", value)
        return 12 <= len(digits) <= 19 and _luhn(digits)
    return kind != "email" or bool(_AT.search(value))


#: The rest of a word, from one of its characters on.
_TAIL = re.compile(r"[^\W_]+|.", re.S)


def all_spans(text: str, base: list[tuple[int, int, str]], tagged: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The base spans, and those of the model that overlap none of them, widened to whole words.

    A card has to have 12 to 19 digits that pass its check sum, an email an at sign.
    """
    out, k, reach, starts = list(base), 0, 0, sorted(base)
    for a, b, kind in tagged:
        while b > a and text[b - 1] in " \n\t.,;:!?\"'":
            b -= 1
        while a < b and text[a] in " \n\t\"'":
            a += 1
        if b > a:
            b = _TAIL.match(text, b - 1).end()
            while a > reach and text[a].isalnum() and text[a - 1].isalnum():
                a -= 1
        while k < len(starts) and starts[k][0] < b:  # both lists go by start: what begins before the span ends
            reach, k = max(reach, starts[k][1]), k + 1
        if b > a >= reach and _may_be(kind, text[a:b]):
            out.append((a, b, kind))
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, id_col: str = "doc_id") -> SpanTagger:
    """Trains on excerpts of about ``sample`` documents, chosen by a hash of the id; an empty table will do."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = hash_sample(texts, sample, "id").select(F.substring("text", 1, EXCERPT).alias("text")).collect()
    model = SpanTagger()
    model.train(examples(sorted(r["text"] for r in rows if r["text"])))
    return model


def _shared(docs: DataFrame, model: SpanTagger) -> Broadcast:
    """The model's weights, a few thousand numbers whatever the corpus."""
    return docs.sparkSession.sparkContext.broadcast(model)


def _spans_of(model: SpanTagger, texts: list[str]) -> list[tuple[list, list]]:
    out = []
    for s in pieces([len(t) for t in texts]):
        tagged = model_spans(model, texts[s])
        out += [((base := base_spans(t)), all_spans(t, base, m)) for t, m in zip(texts[s], tagged, strict=True)]
    return out


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(docs: DataFrame, model: SpanTagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of every row, over whole texts.

    Counts and hash are those of the base spans; ``spans`` has the model's too. A null text counts as empty (no spans,
    the hash of the empty string); repeated rows each give a row; a null id stays null; an empty table gives no rows.
    """
    shared = _shared(docs, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for base, every in _spans_of(shared.value, [t or "" for t in b["text"]]):
                counts = [sum(k == kind for *_, k in base) for kind in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(every)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def mask(docs: DataFrame, model: SpanTagger, text_col: str = "text") -> DataFrame:
    """``docs`` with each span in the text replaced by its kind in angle brackets; null texts stay null."""
    shared = _shared(docs, model)

    def hidden(text: str, spans: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                out += [text[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = b.schema.get_field_index(text_col), b.column(text_col).to_pylist()
            found = _spans_of(shared.value, [t or "" for t in texts])
            new = [None if t is None else hidden(t, s) for t, (_, s) in zip(texts, found, strict=True)]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
