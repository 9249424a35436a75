"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a document's bytes in both directions, in windows that overlap, and gives every position probabilities
over the languages with what stands before and after it in view; a document's probabilities are the mean over all its
positions, each taken from the window that has it in its middle. The network is trained in numpy by backpropagation through
time on windows of a bounded labelled sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recurrent as R
from .bpe import pieces
from .common import hash_sample, id_bucket

#: One fold in five is held out.
FOLDS, HELD_OUT = 5, 0
#: Labelled documents that the network is trained on, about; characters of each; windows in training and their bytes.
SAMPLE, EXCERPT, WINDOWS, TRAINED = 3_000, 1_500, 4_000, 96
UNITS, WIDTH = 12, 10
#: Bytes of a window, and of its overlap with the next one; windows that are read at once.
WINDOW, OVERLAP, READ = 256, 48, 1024
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


class ByteTagger:
    """Bidirectional GRU over bytes with a softmax at each position."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages, n = languages, len(languages)
        self.p = {"embed": (rng.standard_normal((257, WIDTH)) * 0.3).astype(np.float32)}  # 256: padding
        self.p |= R.gru_params(rng, "gru.f", WIDTH, UNITS) | R.gru_params(rng, "gru.r", WIDTH, UNITS)
        self.p["out"] = (rng.standard_normal((2 * UNITS, n)) / np.sqrt(2 * UNITS)).astype(np.float32)
        self.p["bias"] = np.zeros(n, np.float32)

    def forward(self, codes: np.ndarray, mask: np.ndarray, keep=None):
        x = self.p["embed"][codes]
        h = R.both_ways(R.gru, self.p, "gru", x, mask, keep)
        z = h @ self.p["out"] + self.p["bias"]
        z -= z.max(2, keepdims=True)
        e = np.exp(z)
        return x, h, e / e.sum(2, keepdims=True)

    def train(self, words: list[bytes], labels: np.ndarray, epochs: int = 3, rate: float = 0.02, seed: int = 0) -> None:
        rng, adam = np.random.default_rng(seed), R.Adam(self.p, rate)
        steps, done = epochs * -(-len(words) // 64), 0
        for _ in range(epochs):
            order = sorted(rng.permutation(len(words)), key=lambda i: len(words[i]) // 8)
            batches = [order[i : i + 64] for i in range(0, len(order), 64)]
            for k in rng.permutation(len(batches)):
                codes, mask = _padded([words[i] for i in batches[k]])
                keep = ([], [])
                x, h, prob = self.forward(codes, mask, keep)
                d = prob
                d[np.arange(len(d))[:, None], np.arange(d.shape[1])[None], labels[batches[k]][:, None]] -= 1
                d *= mask[:, :, None] / mask.sum()
                grads = {"out": h.reshape(-1, h.shape[2]).T @ d.reshape(-1, d.shape[2]), "bias": d.sum((0, 1))}
                dx = R.both_ways_back(R.gru_back, self.p, "gru", x, keep, d @ self.p["out"].T, grads)
                grads["embed"] = np.zeros_like(self.p["embed"])
                np.add.at(grads["embed"], codes, dx * mask[:, :, None])
                adam.rate = rate * (1 - 0.9 * done / steps)
                done += 1
                adam.step(grads)

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """For each text the sum of its positions' probabilities; they add up to the text's length."""
        sizes = np.array([len(x) for x in texts], np.int64)
        codes, base = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64), np.cumsum(sizes) - sizes
        text, start, begin, end = R.windows(sizes, WINDOW, OVERLAP)
        length = np.minimum(sizes[text], WINDOW)
        out, weights = np.zeros((len(texts), len(self.languages))), np.ascontiguousarray(self.p["out"].T)
        order = np.argsort(-length, kind="stable")
        for i in range(0, len(order), READ):
            part = order[i : i + READ]
            step = np.arange(length[part[0]])[:, None]
            at = np.minimum(base[text[part]] + start[part] + step, len(codes) - 1)
            fore, back = R.read_both_ways(R.gru_read, self.p, "gru", self.p["embed"], codes[at], length[part])
            z = np.matmul(weights[:, :UNITS], fore)
            z += np.matmul(weights[:, UNITS:], back)
            z += self.p["bias"][:, None]
            z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(1, keepdims=True)
            mine = (step >= begin[part] - start[part]) & (step < end[part] - start[part])
            np.add.at(out, text[part], np.einsum("tnb,tb->bn", z, mine.astype(np.float32), dtype=np.float64))
        return out


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words])
    mask = np.arange(max(1, int(sizes.max(initial=0))))[None] < sizes[:, None]
    codes = np.full(mask.shape, 256, np.int64)
    codes[mask] = np.frombuffer(b"".join(words), np.uint8)
    return codes, mask.astype(np.float32)


def bytes_of(text: str | None) -> bytes:
    """The bytes of a text in lower case that the network reads; none if no character of it is a letter."""
    text = (text or "").lower()
    letters = any(c.isalpha() for m in _WORD.finditer(text) for c in m[0])
    return text.encode("utf-8", "surrogatepass") if letters else b""


def probabilities(model: ByteTagger, texts: list[str | None]) -> list[np.ndarray | None]:
    """Each text's probabilities over the model's languages; None for a text without letters."""
    out: list[np.ndarray | None] = []
    for s in pieces([len(t or "") for t in texts], 2_000_000):
        data = [bytes_of(t) for t in texts[s]]
        out += [total / total.sum() if d else None for d, total in zip(data, model.sums(data), strict=True)]
    return out


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE
) -> ByteTagger:
    """Trains on excerpts of about ``sample`` documents outside the held-out fold that have a language.

    Without any such document the network knows the one language ``und``.
    """
    labelled = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_bucket(F.col("id"), FOLDS) != HELD_OUT))
    rows = hash_sample(labelled, sample, "id").select("lang", F.substring("text", 1, EXCERPT).alias("text")).collect()
    rows = sorted((r["lang"], r["text"]) for r in rows)
    languages = sorted({lang for lang, _ in rows}) or [UNKNOWN]
    by: list[list[bytes]] = [[] for _ in languages]
    for lang, text in rows:
        by[languages.index(lang)].append(bytes_of(text))
    rng = np.random.default_rng(0)
    windows, labels = [], []
    for k, own in enumerate(by):  # as many windows of each language, and as many of each document of it
        own = [d for d in own if d]
        for i in range(WINDOWS // len(languages) if own else 0):
            d = own[i % len(own)]
            at = int(rng.integers(0, max(1, len(d) - TRAINED + 1)))
            windows.append(d[at : at + TRAINED])
            labels.append(k)
    model = ByteTagger(languages)
    if len(languages) > 1 and windows:
        model.train(windows, np.array(labels))
    return model


def predict(docs: DataFrame, model: ByteTagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row, over whole texts.

    A text that is null or has no letter is ``und`` with score 0. Of equally likely languages the first by name is taken.
    Repeated rows each give a row; a null id is in no fold (held_out null); an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers whatever the corpus

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = shared.value.languages
        for b in batches:
            found = probabilities(shared.value, b["text"].tolist())
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"].astype("Int64").to_numpy(),
                    "lang_pred": [UNKNOWN if p is None else names[int(p.argmax())] for p in found],
                    "score": [0.0 if p is None else float(min(1.0, p.max())) for p in found],
                }
            )

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, lang_pred string, score double"
    )
    held = id_bucket(F.col("doc_id"), FOLDS) == HELD_OUT
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
