import hashlib
from collections import Counter

import numpy as np
import pytest

from wayfarer.llm import substrings
from wayfarer.llm.substrings import LENGTH, suffix_array

from .tables import documents, hard_texts, prose


def brute(texts):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        on = bytearray(len(d))
        for i in range(len(d) - LENGTH + 1):
            if n[d[i : i + LENGTH]] > 1:
                on[i : i + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, o in zip(d, on, strict=True) if not o)
        spans = sum(o and not (i and on[i - 1]) for i, o in enumerate(on))
        out.append((len(d), sum(on), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, ids=None):
    rows = substrings.digests(documents(spark, texts, ids)).collect()
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)


def want(texts, ids):
    return sorted((i is None, i or 0, *b) for i, b in zip(ids, brute(texts), strict=True))


def test_suffixes_are_in_order():
    rng = np.random.default_rng(0)
    for n in [*range(1, 12), 50, 300]:
        for letters in (1, 2, 5):
            s = rng.integers(1, letters + 1, n).astype(np.int64)
            assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_hard_texts(spark):
    texts = [t if t is None else t[:9000] for t in hard_texts()]
    assert run(spark, texts) == want(texts, range(len(texts)))


def test_repeated_rows_null_ids_and_overlaps(spark):
    a, b = prose(7, 400), prose(8, 400)
    texts = [a, a, b[:700] + a[300:900], None, a[:399], b[:1200], ("ab" * 300), b[:700] + a[300:900], prose(9, 200) + a[:401]]
    ids = [4, 4, None, None, 7, 8, 9, None, 10]
    assert run(spark, texts, ids) == want(texts, ids)


@pytest.mark.parametrize("most", [1, 3000, 1 << 20])
def test_groups_too_large_to_sort_are_cut_up(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "SORTED", most)
    a = prose(5, 300)
    texts = [a[:k] + "X" * (k % 3) + a[k:] for k in range(100, 1500, 100)]
    hot = prose(6, 200)[:430]
    texts += [f"{i} " * (i % 5) + hot[: 380 + 3 * i] + f" {i}" * 90 for i in range(20)] + [hot, hot]
    assert run(spark, texts) == want(texts, range(len(texts)))


def test_cells_are_halves():
    for cell in range(1, 64):
        lo, hi = substrings._range(cell)
        a, b = substrings._range(2 * cell), substrings._range(2 * cell + 1)
        assert a[0] == lo and b[1] == hi and a[1] + 1 == b[0]


def test_text_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 1 << 12)
    a = prose(5, 3000)
    texts = [a, "x" + a[3000:9000] + "y", a[4000:4500]]
    assert run(spark, texts) == want(texts, range(3))


def test_empty_table_and_rest(spark):
    assert run(spark, []) == []
    a = prose(11, 200)
    docs = documents(spark, [a + " tail é", a + " end", None, "short"])
    out = {r["doc_id"]: r for r in substrings.remove_repeats(docs).collect()}
    assert [out[i]["text"] for i in range(4)] == [" tail é"[1:] if not out[0]["text"].startswith(" ") else " tail é", out[1]["text"], None, "short"]
    assert out[1]["text"].strip() == "end" and out[0]["fp"] == 1 and out[0]["text_2"] == ["q"]


def test_rows_tell_the_text_that_is_left(spark):
    """The text beside the digests is what was hashed, and passages of fewer bytes than a string stay in it."""
    a, short = prose(12, 300)[:900], prose(13, 60)[:LENGTH - 1]
    assert len(short.split()) > 50
    texts = [f"one {a} 1", f"two {a} 2", f"three {short}", f"four {short}", None, "é"]
    out = {r["doc_id"]: r for r in substrings.digests(documents(spark, texts)).collect()}
    assert all(hashlib.sha256(out[i]["text"].encode()).hexdigest() == out[i]["kept_sha256"] for i in range(len(texts)))
    assert all(a[100:800] not in out[i]["text"] and len(out[i]["text"]) == out[i]["n_bytes"] - out[i]["n_removed"] < 20 for i in (0, 1))
    assert [out[i]["text"] for i in range(2, 6)] == [texts[2], texts[3], "", "é"]
    assert [out[i]["n_removed"] for i in range(2, 6)] == [0, 0, 0, 0]
