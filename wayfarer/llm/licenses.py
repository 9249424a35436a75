"""Licence scans: an Aho-Corasick automaton finds notices and tags, a shunting-yard parser evaluates expressions.

The automaton runs over a text's words, each after one space, so a phrase is found exactly where its words stand
consecutively. Where an identifier tag is found, the licence expression after it is read: a shunting-yard parser with the
operators WITH, AND and OR (in falling order) gives the licences named and whether the whole allows free reuse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of the base scan and their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices that the method knows.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "zlib license": "zlib",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons zero": "cc0",
    "cc0 1 0 universal": "cc0",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Words before a notice that make it a statement of the document's own licence.
GRANTS = ("licensed under", "released under", "distributed under", "available under", "under the terms of", "under the")
#: How freely a licence lets a text be reused: 1 with notice only, 0.5 if changes stay open, 0 if the whole must.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "bsl": 1.0, "unlicense": 1.0, "cc0": 1.0, "cc-by": 1.0,
    "lgpl": 0.5, "mpl": 0.5, "epl": 0.5, "cc-by-sa": 0.5, "gpl": 0.0, "agpl": 0.0, "proprietary": 0.0,
    "cc-by-nc": 0.0, "cc-by-nd": 0.0, "cc-by-nc-sa": 0.0, "cc-by-nc-nd": 0.0,
}
#: Licence families by the first part of an identifier.
FAMILIES = ("mit", "apache", "bsd", "0bsd", "isc", "zlib", "bsl", "unlicense", "cc0", "lgpl", "agpl", "gpl", "mpl", "epl")
_WORDS = bytes(c if chr(c).isdigit() and c < 128 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_RANK = {"OR": 1, "AND": 2, "WITH": 3}
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+-]+")
_EXPRESSION = re.compile(r"(?i)spdx-license-identifier\s*:\s*([^\r\n]*)")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: lower-cased in A-Z, cut at every ASCII character that is no letter or digit."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def licence_of(identifier: str) -> str | None:
    """The family of a licence identifier, told by whole parts between dashes; a Creative Commons family keeps its conditions.
    A licence that is only referred to is itself, in lower case. None if the identifier is not known."""
    low = identifier.lower().rstrip("+")
    parts = low.split("-")
    if low.startswith(("licenseref-", "documentref-")):
        return low
    if parts[:2] == ["cc", "by"]:
        return "-".join(["cc", "by", *(p for p in ("nc", "sa", "nd") if p in parts[2:])])
    if parts[0] in FAMILIES:
        return "bsd" if parts[0] == "0bsd" else parts[0]
    return None


def is_exception(identifier: str) -> bool:
    """Whether an identifier stands for an exception, which may follow WITH."""
    low = identifier.lower()
    return "exception" in low.split("-") or low == "linux-syscall-note" or low.startswith("additionref-")


def parse_expression(text: str) -> list[str] | None:
    """The expression in postfix order, as far as it reads as one from its start; None if it doesn't begin as one.

    Operands are known licences, licences referred to, and exceptions after WITH; anything else ends the expression.
    """
    out: list[str] = []
    operators: list[str] = []
    depth, operand = 0, True  # whether an operand is wanted next
    good: tuple[int, int] | None = None
    tokens = _TOKEN.findall(text)
    for i, token in enumerate(tokens):
        upper = token.upper()
        if token == "(" and operand:
            depth += 1
        elif token == ")" and not operand and depth:
            depth -= 1
        elif upper in _RANK and not operand:
            operand = True
        elif token not in "()" and upper not in _RANK and operand and (is_exception(token) if i and tokens[i - 1].upper() == "WITH" else licence_of(token)):
            operand = False
        else:
            break
        if not operand and depth == 0:
            good = (i + 1, depth)
    if good is None:
        return None
    for token in tokens[: good[0]]:
        upper = token.upper()
        if token == "(":
            operators.append(token)
        elif token == ")":
            while operators[-1] != "(":
                out.append(operators.pop())
            operators.pop()
        elif upper in _RANK:
            while operators and operators[-1] != "(" and _RANK[operators[-1]] >= _RANK[upper]:
                out.append(operators.pop())
            operators.append(upper)
        else:
            out.append(token)
    return out + operators[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """The licences of an expression and its freedom: the freest side of OR, the least free of AND; WITH loosens by half."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in _RANK:
            b, a = stack.pop(), stack.pop()
            if token == "WITH":  # the right side is an exception, not a licence
                stack.append((a[0], min(1.0, a[1] + 0.5)))
            else:
                stack.append((a[0] | b[0], max(a[1], b[1]) if token == "OR" else min(a[1], b[1])))
        else:
            label = licence_of(token)
            stack.append(({label} if label else set(), FREEDOM.get(label, 0.0)))
    return stack[0]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label in (NOTICES | BASE | {TAG: "tag"}).items():
        a.add_word(f" {phrase} ", (phrase, label))
    a.make_automaton()
    return a


def scan_text(text: str | None, automaton: ahocorasick.Automaton) -> tuple:
    """``(n_words, n_base, first_word, last_word, base_labels, labels, score, freedom)`` of one text."""
    words = words_of(text)
    line = " " + b" ".join(words).decode("latin1") + " "
    base, starts, labels, score, tagged = set(), [], set(), 0.0, False
    seen, spaces = 0, 0  # spaces before a place, counted once over the line
    for end, (phrase, label) in automaton.iter(line):
        at = end - len(phrase) - 1  # the space before the phrase
        if phrase == TAG:
            tagged = True
            continue
        labels.add(label)
        if phrase in BASE:
            base.add(label)
            if at >= seen:
                seen, spaces = at, spaces + line.count(" ", seen, at)
                starts.append(spaces)
            else:  # a longer phrase that began before the last one
                starts.append(spaces - line.count(" ", at, seen))
        before = line[max(0, at - 40) : at + 1]
        score = max(score, 1.0 if any(f" {g} " in before for g in GRANTS) else 0.5)
    freedom = [FREEDOM[x] for x in labels]
    if tagged:
        for m in _EXPRESSION.finditer(text or ""):
            postfix = parse_expression(m[1])
            if postfix:
                found, free = evaluate(postfix)
                labels |= found
                freedom.append(free)
                score = 1.0
    join = lambda x: ",".join(sorted(x))
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, join(base), join(labels), score, min(freedom) if freedom else None


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, freedom)`` of every row.

    ``score`` is 1 where the text states a licence for itself (a tag with an expression, or a notice after words such as
    "licensed under"), 0.5 where it only names one, else 0. ``freedom`` is how freely all the licences found together let
    the text be reused, null without one. A null text counts as empty (no words, empty labels, null positions);
    repeated rows each give a row; a null id stays null; an empty table gives no rows.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton()
        for b in batches:
            out = pd.DataFrame([scan_text(t, automaton) for t in b["text"]], columns=names)
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"doc_id long, {COLUMNS}"
    )
