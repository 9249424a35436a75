import hashlib
import random
import re
from fractions import Fraction

from wayfarer.llm import mixing

from .tables import documents, hard_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes: list[int], weights=(3, 1, 2), share=Fraction(3, 2), epochs=2) -> list[Fraction]:
    """Water-filling round by round: clamp what is above its cap, share the excess by weight, until none is above."""
    total, open_, out = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        for i in open_:
            out[i] = left * w[i] / sum(w[j] for j in open_)
        above = {i for i in open_ if out[i] > epochs * sizes[i]}
        if not above:
            break
        for i in above:
            out[i] = Fraction(epochs * sizes[i])
        open_ -= above
    return out


def with_sources(spark, texts, sources, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = list(zip(ids, texts, sources, ["x"] * len(ids), [1] * len(ids), strict=True))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, name string, size int")


def checked(rows, ids, texts, sources):
    """Rows against the contract, and the seeded order by brute force."""
    names = sorted({s for s in sources if s is not None}, key=lambda s: [ord(c) for c in s]) + ([None] if None in sources else [])
    size = [len(WORD.findall(t or "")) for t in texts]
    total = [sum(n for n, s in zip(size, sources, strict=True) if s == x) for x in names]
    goal = dict(zip(names, filled(total), strict=True))
    want = []
    for x, n in zip(names, total, strict=True):
        mine = [i for i, s in enumerate(sources) if s == x]
        place = lambda i: (int(hashlib.md5(f"12:{ids[i] if ids[i] is not None else 'text:' + (texts[i] or '')}".encode()).hexdigest()[:15], 16), ids[i] is None, ids[i] or 0, size[i])
        quota = int(goal[x] + Fraction(1, 2))
        times, rest = divmod(quota, n) if n else (0, 0)
        for i in sorted(mine, key=place):
            part = max(0, min(size[i], rest))
            rest -= part
            want.append((ids[i], size[i], n, times * size[i] + part))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["size"], r["source_size"], r["taken"])) for r in rows)
    by = {}
    for r, s in ((r, sources[ids.index(r["doc_id"])]) for r in rows if r["doc_id"] is not None and ids.count(r["doc_id"]) == 1):
        by[s] = r["target"]
    assert all(abs(v - float(goal[s])) <= 1e-9 * max(1, v) for s, v in by.items())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)


def test_water_filling_and_order(spark):
    rng = random.Random(5)
    for turn in range(4):
        n = 300
        sources = [rng.choices(["a", "b", "B", "é", "日", "", None], [200, 10, 1, 40, 3, 9, 60][turn:] + [5] * turn)[0] for _ in range(n)]
        texts = [" ".join(["w"] * rng.choice([0, 1, 5, 40, 900])) for _ in range(n)]
        ids = list(range(n))
        rows = mixing.plan(with_sources(spark, texts, sources).repartition(1 + turn)).collect()
        checked(rows, ids, texts, sources)


def test_hard_rows(spark):
    texts = [*hard_texts(), "a b", "a b", "a b", None]
    ids = [*range(len(texts) - 4), 3, 3, None, None]
    sources = ["s", None, "t"] * 5 + ["s"]
    checked(mixing.plan(with_sources(spark, texts, sources[: len(texts)], ids)).collect(), ids, texts, sources[: len(texts)])
    assert mixing.plan(documents(spark, [])).count() == 0
    rows = mixing.plan(documents(spark, [None, "", " "])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 3


def test_reruns_agree_and_plan_is_native(spark):
    texts = [" ".join(["w"] * (i % 37)) for i in range(500)]
    docs = with_sources(spark, texts, ["s"] * 400 + ["t"] * 100)
    a = mixing.plan(docs)
    assert sorted(a.collect()) == sorted(mixing.plan(docs.repartition(7)).collect())
    assert not re.search("Python|Arrow|Pandas|ExternalRDD", a._jdf.queryExecution().toString())


def test_all_capped_and_uncapped(spark):
    texts, sources = ["a b c d"] * 10, ["a"] * 5 + ["b"] * 5
    rows = mixing.plan(with_sources(spark, texts, sources), share=(4, 1)).collect()
    assert {(r["target"], r["taken"]) for r in rows} == {(40.0, 8)}
    rows = mixing.plan(with_sources(spark, texts, sources), share=(1, 2), weights=(1, 1)).collect()
    assert {r["target"] for r in rows} == {10.0} and sum(r["taken"] for r in rows) == 20


def test_mix_has_the_words_taken(spark):
    texts = [f" \n{i} " + "  w\té" * (i % 9) + "\n" for i in range(120)]
    docs = with_sources(spark, texts, ["s", "t", "u", None] * 30)
    plan = mixing.plan(docs)
    rows, taken = mixing.mix(plan, docs).collect(), {r["doc_id"]: r["taken"] for r in plan.collect()}
    got = dict.fromkeys(taken, 0)
    for r in rows:
        assert texts[r["doc_id"]].startswith(r["text"])
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert got == taken
