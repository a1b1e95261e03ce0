import zlib

import numpy as np
import pyarrow as pa

from tests.llm.conftest import ODD_TEXTS
from wardline.llm.quality_classifier import (ClassifierParams, classify, features, fit, ftrl, keep_good,
                                             score_block)
from wardline.llm.textblocks import text_blocks

SMALL = ClassifierParams(bits=12, sample_rows=200, shards=2)


def corpus(make_docs, spark, words):
    rows = [(i, words(40, i) if i % 3 else " ".join(w + "&&&" for w in words(40, i).split()))
            for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)],
                                   "doc_id long, quality int, toxic int")
    return rows, make_docs(rows), labels


def test_learns_and_never_reads_held_out_labels(make_docs, spark, words):
    rows, docs, labels = corpus(make_docs, spark, words)
    out = {r.doc_id: r for r in classify(docs, labels, SMALL).collect()}
    assert len(out) == 120
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.3)
        assert r.predicted == int(i % 3 > 0)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0,"
                                " 1 - quality, quality) as quality")
    again = {r.doc_id: r.score for r in classify(docs, flipped, SMALL).collect()}
    assert again == {i: r.score for i, r in out.items()}


def test_scores_equal_a_plain_dot_product(make_docs, spark, words):
    _, docs, labels = corpus(make_docs, spark, words)
    w = fit(docs, labels, SMALL)
    texts = [words(30, 1), "", words(5, 2) + " &&& the the", "x"]
    for block in text_blocks(pa.array(texts)):
        bins, offsets = features(block, SMALL.bits)
        got = score_block(block, w, SMALL.bits)
        for i in range(len(texts)):
            own = bins[offsets[i]:offsets[i + 1]]
            margin = sum(float(w[b]) for b in own) / np.sqrt(max(len(own), 1)) + float(w[-1])
            assert abs(got[i] - 1 / (1 + np.exp(-margin))) < 1e-9
            alone = next(text_blocks(pa.array([texts[i]])))
            assert sorted(features(alone, SMALL.bits)[0].tolist()) == sorted(own.tolist())


def test_ftrl_separates_two_bins():
    examples = [(np.array([1, 1, 2]), 1.0), (np.array([3, 2]), 0.0)] * 50
    w = ftrl(examples, ClassifierParams(bits=4))
    assert w[1] > 0 > w[3]


def test_nulls_repeats_and_empty_tables(make_docs, spark, words):
    _, docs, labels = corpus(make_docs, spark, words)
    odd = make_docs([(None, "x"), (7, "same"), (7, "same"), *[(100 + i, t) for i, t in enumerate(ODD_TEXTS)]])
    out = classify(docs.unionByName(odd), labels, SMALL).collect()
    assert len(out) == 120 + 3 + len(ODD_TEXTS)
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    none = labels.where("false")
    assert {r.score for r in classify(odd, none, SMALL).collect()} == {0.5}
    assert classify(odd.where("false"), none, SMALL).collect() == []
    noisy = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, None), (5, 9, 1)], labels.schema))
    assert classify(docs, noisy, SMALL).count() == 120


def test_filter_keeps_all_columns_and_good_rows(make_docs, spark, words):
    rows, docs, labels = corpus(make_docs, spark, words)
    kept = keep_good(docs, labels, SMALL)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in rows if i % 3]
