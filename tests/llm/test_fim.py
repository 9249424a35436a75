import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfarer.llm import fim

from .tables import documents, hard_texts

LINE = re.compile(r"[^\n]*\n|[^\n]+")
TEXTS = hard_texts() + ["\n", "\n\n\n", "a", "a\n", "\na", "é\n日本\n\n語", "x <P> y", "<S>", "a<M>\nb", "\r\n\r\n", "a b\x0bc\nd", "\n".join("l" * (i % 7) for i in range(3000))]


def plainly(doc_id, text: str | None) -> tuple:
    """The contract in the plainest form."""
    text = text or ""
    units = LINE.findall(text)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return len(units), "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return len(units), "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_same_as_the_plain_form(spark):
    ids = [None, -3, *range(2, len(TEXTS) - 1), 2]
    docs = documents(spark, TEXTS, ids)
    want = [(i, *plainly(i, t)) for i, t in zip(ids, TEXTS, strict=True)]
    assert sorted(map(str, (tuple(r) for r in fim.transform(docs).collect()))) == sorted(map(str, want))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*w[:-1], sha(w[-1]), sha(t or "")) for w, t in zip(want, TEXTS, strict=True)]
    assert sorted(map(str, (tuple(r) for r in fim.digests(docs).collect()))) == sorted(map(str, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_empty_table_and_repeated_rows(spark):
    assert fim.digests(documents(spark, [])).count() == 0 and fim.transform(documents(spark, [])).count() == 0
    rows = fim.digests(documents(spark, ["a\nb\nc\n"] * 5, [4] * 5)).collect()
    assert len(rows) == 5 and len(set(map(tuple, rows))) == 1


def test_rates(spark):
    docs = documents(spark, ["a\nb\nc\nd\n"] * 400)
    forms = [r["form"] for r in fim.transform(docs, rate=50, spm_rate=100).collect()]
    assert set(forms) == {"plain", "spm"} and 120 < forms.count("spm") < 280


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=300), st.data())
def test_descent_reaches_every_rank(widths, data):
    units = fim.SkipList(np.array(widths, np.int64))
    rank = data.draw(st.integers(0, len(widths)))
    assert units.place(rank) == sum(widths[:rank])


def test_lanes_thin_out():
    units = fim.SkipList(np.ones(100_000, np.int64))
    sizes = [len(lane.units) for lane in units.lanes]
    assert sizes[0] == 100_000 and 20_000 < sizes[1] < 30_000 and len(sizes) < 25
    assert all(lane.units.sum() == lane.points.sum() for lane in units.lanes)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n<PSM>é", max_size=60), st.integers(-5, 10**6))
def test_round_trip(text, doc_id):
    n, form, _, _, output = fim.arrange(text, text.encode(), doc_id)
    assert fim.restore(output, form) == text and n == len(LINE.findall(text))


def test_invalid_bytes_survive(spark):
    docs = spark.sql("select 5L as doc_id, cast(unhex('61FF0A62') as string) as text")
    out = fim.digests(docs).first()
    assert out["restored_sha256"] == hashlib.sha256(b"a\xff\nb").hexdigest() and out["n"] == 2


def test_long_random_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n日") for _ in range(rng.randint(1, 20_000))) for _ in range(60)]
    rows = {r["doc_id"]: r for r in fim.transform(documents(spark, texts)).collect()}
    assert all(tuple(rows[i])[1:] == plainly(i, t) for i, t in enumerate(texts))
