"""Small tables that hold what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, fp long, component_id string, row string, score string, doc string, kept_rows int, anchor string, text_2 array<string>"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 9))) for _ in range(words))


def documents(spark, texts: list, ids: list | None = None, langs: list | None = None):
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    rows = [(i, t, g, "s", None if t is None else len(t), 1, "c", "r", "x", "d", 5, "a", ["q"]) for i, t, g in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def hard_texts() -> list:
    long = prose(1, 30_000)
    return [None, "", " \n\t", "one", "two words", prose(2, 300), prose(2, 300), prose(3, 120) + " " + prose(2, 300), long, "é" * 500 + "日本語 " * 200, "a" * 900, "\x00\x1f<|endoftext|>  x"]
