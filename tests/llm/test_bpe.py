import hashlib
import random

import pytest
import tokenizers

from wayfarer.llm import bpe

from .tables import documents, hard_texts


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def test_same_as_the_library(spark, library):
    rng = random.Random(0)
    texts = hard_texts() + ["".join(rng.choice("aabc the ing\n\t'sé中😀 1.² 　") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["don't 'S we'LL  ''s", "a  b\n c \n\n d ", "<|endoftext|>a <|endoftext|> <|endoftext", "aaaa" * 500, "\x1c\x1d a\x85y"]
    ids = [None, *range(1, len(texts) - 1), 1]
    rows = bpe.round_trip(documents(spark, texts, ids)).collect()
    want = []
    for i, t in zip(ids, texts, strict=True):
        got = library.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in got)
        back = library.decode(got, skip_special_tokens=False)
        want.append(str((i, len(got), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest())))
    assert sorted(str(tuple(r)) for r in rows) == sorted(want)


def test_ids_and_back(spark):
    texts = hard_texts()
    docs = documents(spark, texts)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    assert bpe.round_trip(documents(spark, [])).count() == 0
