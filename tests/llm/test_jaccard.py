import random

import corpus_pipeline
from wayfarer.llm import jaccard, simhash

from .tables import documents, hard_texts, prose


def brute_set(text):
    words = (text or "").lower().encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_groups(ids, texts):
    sets, root = [brute_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def near_copies():
    """Copies of a few bases with edits that leave similarities on both sides of 0.8, and a passage that most hold."""
    rng, texts = random.Random(3), [t if t is None else t[:4000] for t in hard_texts() if t is None or "é" not in t]
    shared = prose(77, 60)
    for b, size in enumerate((6, 12, 40, 90, 200, 400)):
        base = prose(50 + b, size).split()
        for n in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 20))):
                j = rng.randrange(len(w))
                w[j : j + rng.randint(0, 1)] = [f"q{n}"] * rng.randint(0, 1)
            texts.append(" ".join(w) + (" " + shared if n % 3 == 0 else ""))
    return texts


def test_groups_against_every_pair(spark):
    texts = near_copies()
    ids = list(range(len(texts)))
    want = brute_groups(ids, texts)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.groups(documents(spark, texts)).collect()}
    assert [got[i] for i in ids] == want
    assert len(set(want)) < len(texts) - 20  # near copies are there


def test_order_does_not_matter(spark, monkeypatch):
    """With every shingle common, or none, the groups are the same."""
    texts = near_copies()
    for common in (1, 10**6):
        monkeypatch.setattr(jaccard, "COMMON", common)
        got = {r["doc_id"]: r["component_id"] for r in jaccard.groups(documents(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == brute_groups(list(range(len(texts))), texts)


def test_stage_drops_near_copies(spark):
    """Copies that are similar, but more than two fingerprint bits apart, do not stay in the pipeline."""
    texts = near_copies()
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, documents(spark, texts), "").collect()}
    assert kept == set(brute_groups(list(range(len(texts))), texts))
    prints = {r["component_id"] for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert len(kept) < len(prints)


def test_one_of_a_group_without_ids_stays(spark):
    base = prose(8, 100).split()
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(["other", *base[1:]])]
    kept = simhash.keep_one(documents(spark, texts, [None] * 3)).collect()
    assert len(kept) == 1 and kept[0]["text"] in texts


def test_sketches_bound_differences():
    """Sketches differ in no more bits than the sets do in shingles, and tell unlike sets of a few hundred shingles apart."""
    rng, kept = random.Random(2), 0
    words = prose(5, 300).split()
    base = jaccard.shingles(" ".join(words))
    for _ in range(60):
        w = list(words)
        for _ in range(rng.randint(0, 40)):
            w[rng.randrange(len(w))] = f"q{rng.random()}"
        other = jaccard.shingles(" ".join(w))
        apart = sum(bin(x & (1 << 64) - 1).count("1") for x in (jaccard.sketch(base) ^ jaccard.sketch(other)).tolist())
        assert apart <= len(set(base.tolist()) ^ set(other.tolist()))
        assert 9 * apart <= len(base) + len(other) or not jaccard.similar(base, other)
        kept += 9 * apart <= len(base) + len(other) and not jaccard.similar(base, other)
    assert kept <= 6


def test_the_stage_asks_fingerprints_first(spark, monkeypatch):
    """The stage verifies what the grid over fingerprints links; no row of a list meets another that sketches tell apart."""
    asked, made, near, verified = [], [], simhash.near_pairs, jaccard._verified
    monkeypatch.setattr(simhash, "near_pairs", lambda fps: asked.append(fps.count()) or near(fps))
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: made.append({tuple(r) for r in pairs.collect()}) or verified(pairs, *rest))
    texts = near_copies()
    kept = corpus_pipeline.simhash_stage(spark, documents(spark, texts), "").count()
    assert kept == len(set(brute_groups(list(range(len(texts))), texts)))
    assert len(asked) == 1 and asked[0] > 20 and made[0]
    sets = {jaccard.set_key(s): s for s in map(jaccard.shingles, texts)}
    for u, v in set().union(*made[1:]):
        apart = sum(bin(x & (1 << 64) - 1).count("1") for x in (jaccard.sketch(sets[u]) ^ jaccard.sketch(sets[v])).tolist())
        assert 9 * apart <= len(sets[u]) + len(sets[v])


def test_what_is_used_up_is_deleted(spark):
    """Shuffles go with the table written from them, and no table of prefixes, sketches or texts stays in the shared folder."""
    import os

    from wayfarer.plans.session import shared_folder, spool

    shuffled = lambda: {f for _, _, names in os.walk(spark.conf.get("spark.local.dir")) for f in names if f.startswith("shuffle_")}
    before = shuffled()
    rows = spool(spark.range(1000).repartition(3, "id"))
    assert shuffled() <= before and rows.count() == 1000
    folder = shared_folder(spark).removeprefix("file:")
    old = set(os.listdir(folder))
    assert jaccard.groups(documents(spark, near_copies())).count() == len(near_copies())
    left = [set(spark.read.parquet(f"{folder}/{x}").columns) for x in set(os.listdir(folder)) - old]
    assert left and not any(c & {"prefix", "sketch", "text", "place", "s0"} for c in left)
