"""Registered queries, and the pipeline against its stages by brute force."""

import re

import corpus_pipeline
import pytest

from salescope.llm.queries import QUERIES
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_jaccard import brute as similar


def test_one_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES] == list(range(1, 14))


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_stages_apply_their_operators(spark, sf_dir, stages):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [s.columns for s in stages[:-1]] == [documents.columns] * 4
    quality, single, clean, mixed = ({r.doc_id: r.text for r in s.collect()} for s in stages[:-1])
    judged = QUERIES["op2_quality_rules"](spark, sf_dir).where("kept").collect()
    assert set(quality) == {r.doc_id for r in judged}
    ids = sorted(quality)
    groups = similar([quality[i] for i in ids])
    assert set(single) == {ids[g] for _, g, _ in groups}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    found = hits([single[i] for i in sorted(single)], items)
    assert set(clean) == {i for i, f in zip(sorted(single), found, strict=True) if not f[4]}
    assert set(mixed) <= set(clean)
    assert stages[4].count() == stages[3].count()


def test_run_gives_what_the_stages_give(spark, sf_dir, stages):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, stages[-1].collect()))
