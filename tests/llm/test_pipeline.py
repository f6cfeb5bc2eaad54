import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillstore.llm import mixing
from rillstore.llm.pieces import Pieces
from rillstore.llm.queries import QUERIES, TARGETS, tokenizer_path
from tests.llm.test_near_and_repeats import brute_components
from tests.llm.test_text_operators import brute_base

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, its input first."""
    base = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, f in corpus_pipeline.STAGES:
        f(spark, out[-1], SF).write.parquet(f"{base}/{name}")
        out.append(spark.read.parquet(f"{base}/{name}"))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix", "token_ids"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_stage(stages):
    labels = {r["doc_id"]: r["quality"] for r in stages[0].sparkSession.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = {r["doc_id"]: r["text"] for r in stages[0].collect()}, {r["doc_id"]: r["text"] for r in stages[1].collect()}
    for d, t in before.items():
        if brute_base(t)[-1]:
            assert d not in after
        elif labels.get(d) == 1:
            assert d in after


def test_near_stage_equals_brute_force(stages):
    docs = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = {d for d, (_, c) in brute_components(docs, 5, 80).items() if d == c}
    assert {r["doc_id"] for r in stages[2].collect()} == want


def test_decontamination_stage(stages):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = set()
    for r in stages[0].sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        grams |= {tuple(w[i : i + 20]) for i in range(len(w) - 19)}
    kept = {r["doc_id"] for r in stages[3].collect()}
    leaks = 0
    for r in stages[2].collect():
        w = words(r["text"])
        if any(tuple(w[i : i + 20]) in grams for i in range(len(w) - 19)):
            leaks += 1
            assert r["doc_id"] not in kept
    assert leaks and len(kept) >= stages[2].count() - 3 * leaks


def test_mix_stage(stages, spark):
    rated = {r["doc_id"]: r["copies"] for r in mixing.mix(stages[3], spark.read.parquet(f"{SF}/labels.parquet"), TARGETS, mixing.Mix(least=1.0), tokenizer_path()).collect()}
    assert {r["doc_id"]: r["n"] for r in stages[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == rated
    assert min(rated.values()) >= 1


def test_token_stage_equals_the_library(stages):
    lib, at, want = Pieces(tokenizer_path()).tokenizer, 0, []
    for d, t in sorted((r["doc_id"], r["text"]) for r in stages[4].collect()):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, stages[5].collect())) == want


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[5].collect()))


def test_stages_on_edge_tables(spark, edge, none):
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edge.select(*cols), none.select(*cols)):
        n = docs.count()
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, SF)
            assert out.columns == cols
            assert out.count() >= n if name == "mix" else out.count() <= n
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, edge.select(*cols), SF).collect()]
    assert kept.count(8) == 0 and kept.count(1) == 1 and kept.count(None) == 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_return_every_row(spark, name):
    df = QUERIES[name](spark, SF)
    source = {"op5": "pages", "op7": "conversations"}.get(name.split("_")[0], "documents")
    if source != "conversations":
        assert df.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
    else:
        assert df.count() > 0
