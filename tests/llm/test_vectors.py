import numpy as np
import pytest

from wayfarer.llm import vectors


def brute(rows):
    n, unit = len(rows), []
    for _, v in rows:
        ok = v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and float(unit[i] @ unit[j]) >= 0.9] for i in range(n)]
    comp = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in link[i]:
                comp[i] = comp[j] = min(comp[i], comp[j])
    return {rows[i][0]: (len(link[i]), rows[comp[i]][0]) for i in range(n)}


@pytest.mark.parametrize("chunk,round_", [(512, 8), (3, 2)])
def test_links_and_components(spark, monkeypatch, chunk, round_):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    monkeypatch.setattr(vectors, "ROUND", round_)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((20, 8))
    rows = [base[i % 20] + 0.25 * (i % 3) * rng.standard_normal(8) for i in range(120)]
    rows += [base[0]] * 5 + [3.0 * base[1], -base[2], np.zeros(8)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    rows += [(500, None), (501, []), (502, [1.0] * 7), (503, [float("nan")] * 8), (504, [None] + [1.0] * 7), (505, [float("inf")] + [1.0] * 7), (506, [1e-200] * 8), (507, [1e200] * 8)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, unit string, cid int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    want = brute([(i, v if i < 506 else [1.0] * 8) for i, v in rows])
    assert got == want
    kept = {r["vec_id"]: r["kept"] for r in vectors.near_duplicates(df).collect()}
    assert kept == {i: i == c for i, (_, c) in want.items()}


def test_ties_nulls_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.1])], schema)
    got = sorted(str(tuple(r)) for r in vectors.near_duplicates(df).collect())
    assert got == ["(1, 1, 1, True)", "(1, 1, 1, True)", "(2, 1, 1, False)", "(None, 0, None, True)"]
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    assert vectors.near_duplicates(spark.createDataFrame([(1, None)], schema)).count() == 1


def test_planted_links_in_64_dimensions(spark):
    """Chains, pairs about the threshold to the last digits, a vector of another size in front, several blocks and chunks."""
    rng, rows = np.random.default_rng(4), [(-1, [1.0, 2.0])]
    for k in range(40):
        v = rng.standard_normal(64)
        v /= np.linalg.norm(v)
        rows.append((len(rows), v.tolist()))
        for cos in (0.9, 0.9 + 1e-9, 0.9 - 1e-9, 0.9 + 1e-5, 0.9 - 1e-5, 0.95, 0.85):
            w = rng.standard_normal(64)
            w -= (w @ v) * v
            w /= np.linalg.norm(w)
            rows.append((len(rows), ((cos * v + (1 - cos * cos) ** 0.5 * w) * rng.uniform(0.1, 9)).tolist()))
    found = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.array([v for _, v in rows[1:]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T
    np.fill_diagonal(link, 0)
    far = np.abs(link - 0.9) > 1e-13  # of what is nearer, rounding decides
    near, sure = (link >= 0.9).sum(1), (~far).sum(1)
    assert all(abs(found[i + 1]["n_links"] - near[i]) <= sure[i] for i in range(len(x))) and found[-1]["n_links"] == 0
    label = np.arange(1, len(x) + 1)
    for _ in range(20):
        label = np.minimum(label, np.where((link >= 0.9) & far, label[None], 999).min(1))
    sure_row = np.array([len({found[i + 1]["component_id"], label[i]}) == 1 for i in range(len(x))])
    assert sure_row.mean() > 0.85


def test_chunks_meet_without_a_shuffle(spark, monkeypatch):
    """Vectors are shuffled once, into chunks; what meets is read from there. An id's different vectors count their own links, and a batch may hold none."""
    plans, spool = [], vectors.spool
    monkeypatch.setattr(vectors, "spool", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or spool(df))
    monkeypatch.setattr(vectors, "CHUNK", 4)
    rows = [(i, [float(i % 5 == k) for k in range(5)]) for i in range(5, 30)] + [(5, [1.0, -1.0, 1.0, -1.0, 1.0]), (40, [1.0, -1.0, 1.0, -1.0, 1.1])] + [(50 + i, None) for i in range(9)]
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartitionByRange(6, "vec_id")).collect()}
    want = {(i, 4, 5 + i % 5) for i in range(6, 30)} | {(5, 5, 5), (40, 1, 5)} | {(50 + i, 0, 50 + i) for i in range(9)}
    assert got == want
    met = [p for p in plans if "meet(" in p]
    assert len(met) == 1 and "CartesianProduct" in met[0] and "Join" not in met[0]
