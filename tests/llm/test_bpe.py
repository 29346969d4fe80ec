import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Public

from skyadjust.llm import bpe

from .conftest import ODD_TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as f:
        return Public.from_file(PATH), bpe.Tokenizer(f.read())


def test_ids_and_text_equal_the_public_library(both):
    public, own = both
    r = random.Random(3)
    letters = " \t\n\r\x0b\x1c\x85\xa0abcdefTHE'sdll019²½éß中文😀\u0301\u200d.,!#$"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(500)]
    texts += ["<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext", *[t for t in ODD_TEXTS if t is not None]]
    for t in texts:
        ids = public.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == public.decode(ids, skip_special_tokens=False)


def test_tree_yields_the_leftmost_lowest_pair():
    tree = bpe.PairTree([5 * 8 + 0, 2 * 8 + 1, 2 * 8 + 2])
    assert tree.root() == 2 * 8 + 1
    tree.put(1, bpe.NONE)
    assert tree.root() == 2 * 8 + 2
    tree.put(2, bpe.NONE)
    tree.put(0, bpe.NONE)
    assert tree.root() == bpe.NONE


def test_cache_is_bounded(both):
    _, own = both
    own.cache.clear()
    own.CACHE = 10
    texts = [f"word{i} again" for i in range(50)]
    assert [own.decode(own.encode(t)) for t in texts] == texts
    assert len(own.cache) <= 10


def test_query_over_odd_rows(spark, make_docs, both):
    public, _ = both
    with open(PATH, encoding="utf-8") as f:
        definition = f.read()
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(0, None)]
    got = bpe.encode(make_docs(rows), definition).collect()
    assert len(got) == len(rows)
    for r in got:
        t = ODD_TEXTS[r["doc_id"]] or ""
        ids = public.encode(t, add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    packed = bpe.encode(make_docs(rows[7:8]), definition, packed=True).first()
    assert len(packed["ids"]) == 2 * packed["n_tokens"]
    assert bpe.encode(make_docs([]), definition).count() == 0
