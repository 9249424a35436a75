"""Byte-level BPE encoding and decoding by a depth-first walk over the trie of a batch's distinct words.

The encoding of a word is fixed by one number at each of its prefixes: the last token of that prefix's encoding. Among
the tokens that end where the prefix ends, the last token is the one that can stand next to the last token of what lies
before it without a merge across the border that BPE would have done earlier. Sorting the distinct words and keeping the
states on a stack visits their trie depth first, so the states of a shared prefix are computed once. An automaton gives
the tokens that end at each byte.

The vocabulary file is a parameter; nothing of it is kept here.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings and words that a Python worker remembers between batches, and pairs of tokens it has judged; they save time.
WORDS_KEPT = 500_000
PAIRS_KEPT = 1_000_000
#: How byte-level BPE cuts a text into words (fixed value).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space before a space.
_WIDE = tuple(c + " " for c in " \t\n\v\f\r")
_WIDER = re.compile(r"\s ")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes with one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        plain = lambda s: bytes(letters[c] for c in s)
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.bytes_of: dict[int, bytes] = {i: plain(s) for s, i in vocab.items()}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> rank, token
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.merged[pair] = (rank, whole)
            self.parts.setdefault(whole, (*pair, rank))
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.word = regex.compile(WORD)
        # Tokens as strings of one letter a byte, as the automaton wants them; tokens that no merge makes are left out.
        self.ends = ahocorasick.Automaton()
        for s, i in vocab.items():
            b = plain(s)
            if len(b) == 1 or i in self.parts:
                self.ends.add_word(b.decode("latin1"), (len(b), i))
        self.ends.make_automaton()
        self.known: dict[str, bytes] = {}  # ids of words
        self.whole: dict[str, bytes] = {}  # ids of strings of a few words, see strings()
        self.judged: dict[int, bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens stay apart: no merge across their border comes before the merges inside them."""
        # Walk down the right edge of the left token and the left edge of the right token in the order in which BPE
        # would have built them, from the whole tokens back to bytes; the step that undoes the later merge comes first.
        limit = 1 << 60
        while True:
            hit = self.merged.get((left, right))
            if hit is not None and hit[0] < limit:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[2] > b[2]):
                limit, left = a[2], a[1]
            else:
                # Ties in rank go to the left occurrence first, so an equal merge across the border counts here too.
                limit, right = b[2] + 1, b[0]

    def encode_words(self, words: Iterable[str]) -> None:
        """Puts the encodings of all distinct ``words`` into ``known``, as little-endian 32-bit ids."""
        new = sorted(w.encode("utf-8", "surrogatepass").decode("latin1") for w in words if w not in self.known)
        if len(self.judged) > PAIRS_KEPT:
            self.judged.clear()
        judged, fits, known, ends = self.judged, self.fits, self.known, self.ends
        last, start, before = [-1], [0], ""  # the states of the current path of the trie
        for w in new:
            n, same = len(w), 0
            most = min(n, len(before))
            while same < most and w[same] == before[same]:
                same += 1
            del last[same + 1 :], start[same + 1 :]
            for end, (size, token) in ends.iter(w):
                end += 1
                if end != len(last):
                    continue  # a shared prefix, or its last token is found already
                at = end - size
                if at:
                    key = last[at] << 20 | token
                    ok = judged.get(key)
                    if ok is None:
                        ok = judged[key] = fits(last[at], token)
                    if not ok:
                        continue
                last.append(token)
                start.append(at)
            ids, at = [], n
            while at:
                ids.append(last[at])
                at = start[at]
            before = w
            known[w.encode("latin1").decode("utf-8", "surrogatepass")] = np.array(ids[::-1], "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens stand alone."""
        out: list[str] = []
        for i, part in enumerate(self.split.split(text) if self.special else [text]):
            out += [part] if i % 2 else self.word.findall(part)
        return out

    def strings(self, text: str) -> list[str]:
        """A text cut before single spaces, where a word always begins; words never span two of these strings.

        A space that follows white space may belong to the word before it, so texts with such spaces stay whole.
        """
        if any(x in text for x in _WIDE) or (not text.isascii() and _WIDER.search(text)):
            return [text]
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)]

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        known, whole = self.known, self.whole
        for t, i in self.special.items():
            known[t] = np.array([i], "<u4").tobytes()
        cut = [self.strings(t or "") if not any(s in (t or "") for s in self.special) else [t] for t in texts]
        distinct = set().union(*cut) if cut else set()
        if len(whole) + len(distinct) > WORDS_KEPT:
            whole.clear()
        if len(known) > WORDS_KEPT:
            known.clear()
            known |= {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        words = {s: self.words(s) for s in distinct if s not in whole}
        self.encode_words(set().union(*words.values()) if words else set())
        for s, parts in words.items():
            whole[s] = b"".join(map(known.__getitem__, parts))
        for strings in cut:
            yield b"".join(map(whole.__getitem__, strings))

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids; bytes that are not UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Characters of text that are cut into words at once.
PIECE = 4_000_000


def pieces(sizes: list[int], most: int = PIECE) -> Iterator[slice]:
    """Runs of rows of up to ``most`` characters together, each of a row at least."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > most and i > at:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, ids)``: the token ids of every whole text as an array of long; a null or empty text has no ids."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for b in batches:
            texts = b["text"].tolist()
            for s in pieces([len(t or "") for t in texts]):
                ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in coder.encode_batch(texts[s])]
                yield pd.DataFrame({"doc_id": b["doc_id"][s].astype("Int64"), "ids": ids})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, ids array<long>"
    )


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from token ids; null ids give an empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for b in batches:
            texts = [coder.decode(np.asarray([] if x is None else x, "<u4").tobytes()) for x in b["ids"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text": texts})

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(
        run, "doc_id long, text string"
    )


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: every whole text is encoded and its ids are decoded again.

    A null text counts as empty, repeated rows each give a row, a null id stays null, an empty table gives no rows. A
    text is encoded as a whole however long it is; the special token's string is that token wherever it stands.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, sha = encoder(path), hashlib.sha256
        for b in batches:
            texts = b["text"].tolist()
            for s in pieces([len(t or "") for t in texts]):
                rows = [
                    (len(x) // 4, sha(x).hexdigest(), sha(coder.decode(x).encode()).hexdigest())
                    for x in coder.encode_batch(texts[s])
                ]
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
                out.insert(0, "doc_id", b["doc_id"][s].astype("Int64").to_numpy())
                yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
