import random
import re
from collections import Counter, defaultdict

from wayfarer.llm import divergence

from .tables import hard_texts, prose

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows: list, least: int = 30, top: int = 50) -> set:
    """The contract, term by term."""
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        df[lang].update(set(found))
        count[lang, source].update(found)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * v)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: [share(count[lang, s][t], total[s]) for t in kept] for s in sources}
        q = [share(sum(count[lang, s][t] for s in sources), sum(total.values())) for t in kept]
        for s in sources:
            pair = [(sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o) for o in sources if o != s]
            term = [(a - b, t) for a, b, t in zip(p[s], q, kept, strict=True) if count[lang, s][t] and a > b]
            for part, items in (("pair", pair), ("term", term)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def table(spark, rows: list):
    kind = "text string, lang string, source string, term string, block long, n int, bucket string"
    return spark.createDataFrame([(*r, "t", 1, 2, "b") for r in rows], kind)


def corpus(seed: int, n: int) -> list:
    rng = random.Random(seed)
    vocabulary = ["The", "the", "the,", "(THE)", "don't", "é", "É", "日本", "x1y", "a-b", "a b", "straße", "12", "--", *prose(seed, 120).split()]
    sep = [" ", "\n", "\t ", "\x0b", " \r\n"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice(sep) for _ in range(rng.randint(0, 80)))
    return [(text(), rng.choices(["en", "de", None, ""], [8, 3, 1, 1])[0], rng.choices(["a", "b", "B", "é", None], [9, 2, 2, 1, 1])[0]) for _ in range(n)]


def test_same_as_brute_force(spark):
    for seed, n, least in ((1, 500, 30), (2, 60, 3)):
        rows = corpus(seed, n)
        got = divergence.audit(table(spark, rows).repartition(3), least=least, block=2_000 * seed).collect()
        assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute(rows, least)


def test_hard_rows(spark):
    rows = [(t, "en", "s") for t in hard_texts()] * 3 + [(t, None, s) for t in hard_texts()[:8] for s in ("a", None, "b")] + [(None, "fr", "x"), ("", "fr", "y"), ("zz", "it", "only")]
    got = divergence.audit(table(spark, rows), least=3).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute(rows, 3)
    assert divergence.audit(table(spark, [])).count() == 0
    assert set(map(tuple, divergence.audit(table(spark, rows)).where("lang = 'fr'").collect())) == {("fr", "x", "pair", "y", 0, 1), ("fr", "y", "pair", "x", 0, 1)}


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BUCKET", 10)
    rows = corpus(3, 300)
    assert set(map(tuple, divergence.audit(table(spark, rows), least=2).collect())) == brute(rows, 2)


def test_counts_do_not_depend_on_blocks(spark):
    rows = corpus(4, 200)
    few, many = (sorted(map(tuple, divergence.counts(table(spark, rows).repartition(n), least=1, block=b).collect())) for n, b in ((1, 10**9), (4, 1)))
    assert few == many and few


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10**13, 3 * 10**13, 7), (0, 0, 1), (5, 5, 0)], "c long, n long, v long")
    got = [r[0] for r in df.select(divergence._share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 35), 1 + 10**9, None]


def test_terms_are_not_broadcast(spark, monkeypatch):
    """No table of terms or chunks is sent whole to the driver, however small its files are."""
    plans, spool, plan = [], divergence.spool, lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(divergence, "spool", lambda df: plans.append(plan(df)) or spool(df))
    plans.append(plan(divergence.counts(table(spark, corpus(5, 100)), least=2)))
    assert sum(p.count("SortMergeJoin") for p in plans) >= 2 and not any("Broadcast" in p for p in plans)
