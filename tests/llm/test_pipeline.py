"""The whole pipeline against plain Python over the smallest table."""

import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from skyadjust.llm import mixing, quality

from .test_jaccard import brute as near_duplicates

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF).cache()
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage_keeps_what_scores_well(spark, stages):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in quality.classify(docs, quality.train(docs, labels)).where("predicted = 1").collect()}
    assert set(rows(stages[0])) == good and len(good) > 150


def test_near_duplicate_stage(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[0].collect()]
    assert set(rows(stages[1])) == {i for i, _, c in near_duplicates(before) if i == c}


def test_repeated_passage_stage(stages):
    before = rows(stages[1])
    words = {i: WORD.findall(r["text"]) for i, r in before.items()}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    got = rows(stages[2])
    assert set(got) == set(before)
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        assert got[i]["text"] == (" ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else before[i]["text"])


def test_mixing_stage(spark, stages):
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(stages[2]).collect()}
    assert Counter(r["doc_id"] for r in stages[3].collect()) == {i: n for i, n in plan.items() if n}


def test_token_stage_and_run(spark, stages):
    public = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    got = stages[4].collect()
    assert len(got) == stages[3].count()
    for r in got[:60]:
        ids = public.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert [int.from_bytes(r["ids"][k : k + 2], "little") for k in range(0, len(r["ids"]), 2)] == ids
    run = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in run.collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in got)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, make_docs, tmp_path, empty):
    from .conftest import ODD_TEXTS

    rows = [] if empty else [*enumerate(ODD_TEXTS), (0, None), (None, "no id at all"), (7, "another text of the same id")]
    docs = make_docs(rows)
    if not empty:
        from pyspark.sql import functions as F

        docs = docs.withColumns({c: F.when(F.col("doc_id") != 3, F.col(c)) for c in ("lang", "source", "n_chars")})
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert empty == (docs.count() == 0)
