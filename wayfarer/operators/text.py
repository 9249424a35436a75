"""Keyword extraction from text by phrases between stop words, and the graph of stores and keywords."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import spool

#: Characters that end a sentence (fixed values).
SENTENCE = r"""[\[\]\n.!?,;:\t\-"()'’–]"""
#: Characters that make a word go (fixed values).
ODD = ("#", "@", "ä", "ó", "»", "=", "&", "_", "+", "%", "©", "ç", "é", "è", "å", "î", "¾", "î", "à", "±", "º", "¦", "â")
#: A short list of stop words for texts without one of their own.
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "as", "with", "be", "by", "at", "are", "an", "from", "this", "or", "which")


def stop_pattern(words: tuple[str, ...]) -> str:
    """A pattern for whole stop words, whatever their case. Plain words are sorted by their first letter, which few places match."""
    if not all(re.fullmatch("[a-z]+", w) for w in words):
        return r"(?i)\b(?:" + "|".join(words) + r")\b"
    first: dict[str, list[str]] = {}
    for w in words:
        first.setdefault(w[0], []).append(w[1:])
    return r"(?i)\b(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in first.items()) + r")\b"


def sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, sentence_no, sentence)``."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, SENTENCE)).alias("sentence_no", "sentence"))


def words(phrase: Column, least: int = 0) -> Column:
    """The lower-cased words of a phrase that are longer than ``least`` and no numbers."""
    w = F.transform(F.split(phrase, r"[^a-zA-Z0-9_+\-/]"), lambda x: F.lower(F.trim(x)))
    # What sorts behind the digits begins with no sign or digit.
    return F.filter(w, lambda x: (F.length(x) > least) & ((x >= ":") | ~x.rlike(r"^-?[0-9]+(\.[0-9]+)?$")))


def acceptable(phrase: Column, least: int, most_words: int) -> Column:
    """At least ``least`` characters, at most so many words, a letter at least, and no more digits than letters."""
    many = lambda kind: F.length(phrase) - F.length(F.translate(phrase, kind, ""))
    digits, letters = many(string.digits), many(string.ascii_letters)
    return (F.length(phrase) >= least) & (many(" ") + 1 <= most_words) & (letters > 0) & (digits <= letters)


def phrases(docs: DataFrame, id_col: str, text_col: str, stop_words: tuple[str, ...] = STOP_WORDS, least: int = 1, most_words: int = 5) -> DataFrame:
    """``(id, phrase)``: candidates, what stands between stop words within a sentence; one row for each time it does."""
    # No end of a sentence is part of a word, so one pass splits at both.
    parts = F.split(text_col, rf"{SENTENCE}|\||{stop_pattern(stop_words)}")
    p = docs.select(F.col(id_col).alias("id"), F.explode(parts).alias("p")).select("id", F.lower(F.trim("p")).alias("phrase"))
    return p.where((F.col("phrase") != "") & acceptable(F.col("phrase"), least, most_words))


def word_scores(candidates: DataFrame) -> DataFrame:
    """``(id, word, score)``: how many words a word stands among, over how often it does.

    ``candidates`` has ``n``, how often a phrase stands, or a row for each time.
    """
    n = F.col("n") if "n" in candidates.columns else F.lit(1).cast("long")
    w = candidates.select("id", words(F.col("phrase")).alias("w"), n.alias("n")).select("id", F.size("w").alias("among"), "n", F.explode("w").alias("word"))
    g = w.groupBy("id", "word").agg(F.sum((F.col("among") - 1) * F.col("n")).alias("degree"), F.sum("n").alias("frequency"))
    return g.select("id", "word", ((F.col("degree") + F.col("frequency")) / F.col("frequency")).alias("score"))


def keywords(docs: DataFrame, id_col: str, text_col: str, stop_words: tuple[str, ...] = STOP_WORDS, least: int = 1, most_words: int = 5, least_frequency: int = 1) -> DataFrame:
    """``(id, phrase, score)``: the sum of its words' scores for each phrase that stands often enough."""
    # Phrases are counted once, for their words' scores and for the phrases themselves.
    c = spool(phrases(docs, id_col, text_col, stop_words, least, most_words).groupBy("id", "phrase").agg(F.count("*").alias("n")))
    n = c.where(F.col("n") >= least_frequency)
    w = n.select("id", "phrase", F.explode_outer(words(F.col("phrase"))).alias("word"))
    j = w.join(word_scores(c), ["id", "word"], "left")
    return j.groupBy("id", "phrase").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"))


def adjoined(docs: DataFrame, id_col: str, text_col: str, stop_words: tuple[str, ...] = STOP_WORDS, least: int = 1, most: int = 3, least_frequency: int = 2) -> DataFrame:
    """``(id, phrase, n)``: runs of words that begin and end with a keyword, with stop words between, and stand often."""
    s = sentences(docs, id_col, text_col)
    w = s.select("id", F.filter(F.split(F.lower(F.trim("sentence")), r"\s+"), lambda x: x != "").alias("w"))
    stop = F.array(*map(F.lit, stop_words))
    is_stop = lambda x: F.array_contains(stop, x)
    w = w.withColumn("at", F.filter(F.transform("w", lambda x, i: F.when(~is_stop(x), i + 1)), lambda i: i.isNotNull()))

    def runs(keys: int) -> Column:
        """From each word that is no stop word to the one ``keys`` - 1 of them on, where stop words are between, but not too many."""
        last = lambda j: F.element_at("at", j + keys - 1)
        length = lambda j: last(j) - F.element_at("at", j) + 1
        starts = F.when(F.size("at") >= keys, F.sequence(F.lit(1), F.size("at") - keys + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(starts, lambda j: length(j).between(keys + 1, 2 * keys + 1)), lambda j: F.array_join(F.slice("w", F.element_at("at", j), length(j)), " "))

    # One keyword alone has no stop word inside.
    kinds = [runs(keys) for keys in range(max(least, 2), most + 1)]
    if not kinds:
        return w.where("false").select("id", F.lit("").alias("phrase"), F.lit(0).cast("long").alias("n"))
    out = w.select("id", F.explode(F.concat(*kinds)).alias("phrase"))
    return out.groupBy("id", "phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least_frequency)


def clean_words(text: Column) -> Column:
    """A text's words, one space between them, without those that hold one of ``ODD``."""
    odd = "[" + re.escape("".join(ODD)) + "]"
    kept = F.array_join(F.filter(F.split(F.trim(text), r"\s+"), lambda w: ~w.rlike(odd)), " ")
    return F.when(text.rlike(odd), kept).otherwise(F.regexp_replace(F.trim(text), r"\s+", " "))


def keyword_pipeline(docs: DataFrame, id_col: str, text_col: str, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``(id, word, score)``: words of 15 to 100 characters go, then signs; words of the phrases that score, best first kept."""
    plain = clean_words(F.regexp_replace(F.regexp_replace(F.col(text_col), r"\b\w{15,100}\b", ""), "/", " "))
    k = keywords(docs.select(F.col(id_col).alias("id"), plain.alias("text")), "id", "text", stop_words, 3, 2, 2)
    return k.select("id", F.explode(F.split("phrase", " ")).alias("word"), "score").groupBy("id", "word").agg(F.max("score").alias("score"))


def combined(sources: DataFrame) -> DataFrame:
    """``(store, word, score)`` of ``(store, word, score, source)``: of a word in several sources the first source's."""
    w = Window.partitionBy("store", "word").orderBy("source", F.col("score").desc())
    return sources.withColumn("r", F.row_number().over(w)).where("r = 1").select("store", "word", "score")


def keyword_graph(scores: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices ``(id, node_type)`` and edges ``(src, dst, weight)``: store to category with weight 5, store to word by score."""
    e = categories.select(F.col("store").alias("src"), F.col("category").alias("dst"), F.lit(5).cast("long").alias("weight"))
    e = e.union(scores.select("store", "word", F.col("score").cast("long")))
    v = (
        e.select(F.col("src").alias("id"), F.lit("store").alias("node_type"))
        .union(categories.select("category", F.lit("category")))
        .union(scores.select("word", F.lit("keyword")))
        .distinct()
    )
    return v, e


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)``."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def strip_tags(page: Column) -> Column:
    """The text of a page by patterns: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def load_stop_words(spark, path: str) -> tuple[str, ...]:
    """The words of a file with any number on a line; lines that begin with # are left out."""
    rows = spark.read.text(path).where("value not like '#%'").select(F.explode(F.split(F.trim("value"), r"\s+")).alias("w")).where("w <> ''")
    return tuple(dict.fromkeys(re.escape(r["w"]) for r in rows.collect()))
