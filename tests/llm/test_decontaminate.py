import random

import pytest

from wayfarer.llm import decontaminate as D

from .tables import documents, hard_texts, prose


def brute(item, words):
    prev, best = list(range(len(item) + 1)), len(item)
    for w in words:
        cur = [0]
        for i, x in enumerate(item):
            cur.append(min(prev[i] + (x != w), prev[i + 1] + 1, cur[i] + 1))
        prev, best = cur, min(best, cur[-1])
    return best


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(300):
        item = [rng.randint(0, 4) for _ in range(rng.randint(1, 12))]
        words = [rng.randint(0, 4) for _ in range(rng.randint(0, 30))]
        assert D.passage_distance(item, words)[0] == brute(item, words)


def test_leaks_against_every_window(spark):
    rng = random.Random(2)
    items = [prose(100 + i, rng.randint(14, 50)) for i in range(30)] + ["three short words", "one", "", None, "é è ê ñ ß à ü ö"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = hard_texts()
    for n in range(150):
        w = rng.choice(items[:30]).split()
        for _ in range(rng.randint(0, int(0.2 * len(w)))):
            j = rng.randrange(len(w))
            w[j : j + rng.randint(0, 1)] = [f"q{n}"] * rng.randint(0, 1)
        texts.append(prose(n, 60) + " " + " ".join(w) + " " + prose(1000 + n, 60))
    texts += ["x Three, SHORT words y", "É È ê ñ ß à ü ö" , "ones"]
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in D.find_leaks(documents(spark, texts), bench).collect()}
    cut, want = D.Words(), {}
    for i, t in enumerate(texts):
        words = cut.hashes((t or "").encode()).tolist()
        if len(words) > 5000:  # too long to try every window here
            got = {k: e for k, e in got.items() if k[0] != i}
            continue
        for k, item in enumerate(items):
            x = cut.hashes((item or "").encode()).tolist()
            if x and words and (e := brute(x, words)) <= int(D.EDITS * len(x)):
                want[i, k] = e
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got if k in want)
    assert len(got) >= 0.97 * len(want)  # the target recall


@pytest.mark.parametrize("words", [4, 5, 8, 12, 15, 20, 31, 59, 130])
def test_recall_at_all_edits_allowed(words):
    """Passages with as many edits as their length allows, of each length."""
    rng, cut = random.Random(words), D.Words()
    items = [prose(words * 1000 + i, words) for i in range(60)]
    texts = []
    for i, x in enumerate(items):
        w = x.split()
        for n in range(int(D.EDITS * words)):
            j = rng.randrange(len(w))
            w[j : j + rng.randint(0, 1)] = [f"q{i}x{n}"] * rng.randint(0, 1)
        texts.append(f"{prose(i, 40)} {' '.join(w)} {prose(500 + i, 40)}")
    found = D.Finder([(i, cut.hashes(x.encode())) for i, x in enumerate(items)])(texts)
    assert sum((i, i) in found for i in range(60)) >= 54


def test_window_sizes():
    for n in range(6, 400):
        size = D.window_size(n)
        assert 0.8 * (n - int(D.EDITS * n)) <= size <= n - int(D.EDITS * n)
        assert 2 * size <= D.NEAR or all(max(D.late_places(r, size)) >= size for r in range(D.REPEATS))


def test_clean_rows_stay(spark):
    item = prose(5, 30)
    bench = spark.createDataFrame([(None, item), (2, None)], "item_id long, text string")
    texts, ids = [item, None, "", prose(6, 100), "a " + item.upper() + " b", prose(6, 100)], [1, 2, None, 4, 5, 4]
    left = D.drop_leaks(documents(spark, texts, ids), bench)
    assert left.columns == documents(spark, []).columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "4", "4", "None"]
    assert D.drop_leaks(documents(spark, []), bench).count() == 0
    assert D.find_leaks(documents(spark, texts), bench.limit(0)).count() == 0


@pytest.mark.parametrize("held", [1, 3_000, D.HELD])
def test_many_passes_are_one_python_stage(spark, monkeypatch, held):
    monkeypatch.setattr(D, "ITEMS_A_PASS", 4)
    items = [prose(200 + i, 20 + i) for i in range(30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [None, "", *(prose(i, 50) + (" " + items[i % 30] + " " if i % 3 else " ") + prose(900 + i, 30) for i in range(80))]
    docs = documents(spark, [*texts, texts[2], texts[3]]).repartition(3)
    left = D.drop_leaks(docs, bench, held=held)
    assert left._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = [*(i for i in range(82) if i < 2 or (i - 2) % 3 == 0), 82]
    assert sorted(r["doc_id"] for r in left.collect()) == want
    leaks = D.find_leaks(docs, bench, held=held)
    assert leaks._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r["doc_id"] for r in leaks.collect()} == set(range(84)) - set(want)
