"""Every stage of the pipeline against a plain version of it, on its own input."""

import os

import pytest

import corpus_pipeline as P
from tests.llm.test_jaccard_join import brute
from wardline.llm.deploy import written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    inputs, outputs = {}, {}
    for name, stage in P.STAGES:
        inputs[name] = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, SF), name)
        outputs[name] = docs
        if name != "tokens":
            assert docs.columns == columns
            kept = {r.doc_id: r for r in docs.collect()}
            assert all(inputs[name][i] == r for i, r in kept.items())  # rows stay as they are
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in outputs.items()}

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {i for i, q in labels.items() if q == 1}
    assert good <= ids["quality"]

    near = [(i, r.text) for i, r in inputs["near_duplicates"].items()]
    assert ids["near_duplicates"] == {i for i, _, c in brute(near) if i == c}

    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, r in inputs["decontamination"].items() if any(x in " ".join(r.text.split()) for x in items)}
    assert ids["decontamination"] == set(inputs["decontamination"]) - dirty

    n = {i: len(r.text.split()) for i, r in inputs["mixing"].items()}
    taken = sum(n[i] for i in ids["mixing"])
    assert 0.8 * sum(n.values()) <= taken < sum(n.values())

    rows = outputs["tokens"].orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(ids["mixing"])
    assert P.ORACLE_SQL is None
