import random

import numpy as np
import xxhash

from wayfarer.llm import simhash

from .tables import documents, hard_texts, prose


def brute_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    v = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return v - (1 << 64) if v >> 63 else v


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_fingerprints_and_components(spark):
    base = prose(4, 200).split()
    rng, texts = random.Random(0), list(hard_texts())
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    ids = [*range(len(texts) - 2), 3, None]
    got = simhash.near_duplicates(documents(spark, texts, ids)).collect()
    prints = [brute_print(t) for t in texts]
    want = sorted(map(str, zip(ids, prints, brute_components(ids, prints), strict=True)))
    assert sorted(str((r["doc_id"], r["fp"], r["component_id"])) for r in got) == want


def test_all_close_pairs_are_found(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(-(1 << 63), (1 << 63) - 1, 40)
    prints = {int(s) for s in seeds}
    for s in seeds.tolist():
        for bits in ((0,), (63,), (5, 40), (62, 63), (1, 2), (17, 33, 50)):
            x = s & (1 << 64) - 1
            for b in bits:
                x ^= 1 << b
            prints.add(x - (1 << 64) if x >> 63 else x)
    prints = sorted(prints)
    got = {(r["u"], r["v"]) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    want = {(a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert got == want


def test_keep_one(spark):
    a = prose(4, 200)
    texts, ids = [a, a, a, "other words here", None, "", a, None], [5, 2, 2, 9, None, 7, None, None]
    kept = simhash.keep_one(documents(spark, texts, ids))
    assert kept.columns == documents(spark, [], []).columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, a), (7, ""), (9, "other words here")]
    lone = simhash.keep_one(documents(spark, ["only", "only", "two"], [None, None, 1])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in lone) == [("1", "two"), ("None", "only")]
    assert simhash.keep_one(documents(spark, [])).count() == 0


def test_cells_are_not_broadcast(spark):
    """A table exploded to 28 cells a row is not sent whole to the driver, small as its files are."""
    fps = spark.range(300).selectExpr("xxhash64(id) fp")
    plan = simhash.near_pairs(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_groups_that_share_an_id_keep_a_row_each(spark):
    a, b, c = prose(4, 200), prose(5, 200), prose(6, 200)
    kept = simhash.keep_one(documents(spark, [a, b, a, c, c, None, "", b], [2, 2, 1, 2, 2, 3, 2, 7]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, a), (2, b), (2, c), (2, "")])
