import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_TEXTS
from wardline.llm import lm_scoring as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, order, backoff):
    texts = [WORD.findall((t or "").translate(LOWER)) for _, t in rows]
    grams = [Counter(tuple(w[i:i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in texts]
    total, words = Counter(), sum(map(len, texts))
    for g in grams:
        total.update(g)

    def score(i, context, word):
        left = max(words - len(texts[i]), 1)
        gram = (*context, word)
        n = total[gram] - grams[i][gram]
        if not context:
            return math.log(n / left) if n > 0 else math.log(backoff / left)
        if n > 0:
            return math.log(n / (total[context] - grams[i][context]))
        return math.log(backoff) + score(i, context[1:], word)

    return [(len(w), sum(score(i, tuple(w[max(0, k - order + 1):k]), w[k]) for k in range(len(w))))
            for i, w in enumerate(texts)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_brute_force_in_many_blocks(make_docs, monkeypatch, order):
    import random

    monkeypatch.setattr(S, "BLOCK_CHARS", 700)
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice(["a", "b", "B", "c", "dd", "e"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD_TEXTS)]
    got = {r.doc_id: r for r in S.score_documents(make_docs(rows), order).collect()}
    for (doc_id, _), (n, want) in zip(rows, brute(rows, order, S.BACKOFF)):
        assert got[doc_id].n_words == n and abs(got[doc_id].log_score - want) < 1e-8
        assert got[doc_id].mean_log_score is None if n == 0 else abs(got[doc_id].mean_log_score - want / n) < 1e-8


def test_nulls_repeats_and_empty_tables(make_docs):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c")]
    out = S.score_documents(make_docs(rows)).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "1", "None"]
    assert all(abs(r.log_score - math.log(1 / 3)) < 1e-9 for r in out)  # a: 2 of 6, then certain
    alone = S.score_documents(make_docs([(1, "x y")])).collect()[0]
    assert abs(alone.log_score - (math.log(0.4) + 2 * math.log(0.4))) < 1e-9
    assert S.score_documents(make_docs([])).collect() == []


def test_totals_beyond_32_bits(spark):
    rows = [(0, 3, 1), (0, 5, 3_000_000_000), (0, 9, 7), (1, 5, 3_000_000_000), (1, 9, 4_294_967_295),
            (2, 5, 2), (2, S.CORPUS, 4)]
    got = S.corpus_counts(spark.createDataFrame(rows, "block int, hash long, n long")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 5, 6_000_000_002), (0, 9, 4_294_967_302), (1, 5, 6_000_000_002),
                                             (1, 9, 4_294_967_302), (2, S.CORPUS, 4), (2, 5, 6_000_000_002)]


def test_ngrams_are_rows_shuffled_once(spark, make_docs):
    """The count table and the rows it is joined to read one exchange."""
    docs = make_docs([(1, "a b")]).withColumn("block", F.lit(0))
    rows = S.explode_ngrams(docs, 3)
    assert sorted(r.n for r in rows.collect()) == [1, 1, 1, 2]  # a, b, "a b" and two words
    counts = S.corpus_counts(rows)
    counts.collect()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("FlatMapGroupsInArrow") == 1 and "ReusedExchange" in final and "Join" in final


def test_very_long_text(make_docs, words):
    text = " ".join(words(1000, s) for s in range(900))  # beyond one slice of 4 MB
    rows = [(1, text), (2, "some words " + text[:2000]), (3, "no such")]
    got = {r.doc_id: r for r in S.score_documents(make_docs(rows)).collect()}
    for (doc_id, _), (n, want) in zip(rows, brute(rows, S.ORDER, S.BACKOFF)):
        assert got[doc_id].n_words == n and abs(got[doc_id].log_score - want) < 1e-6 * abs(want)


def test_parts_are_counted_one_by_one_and_packed(make_docs, words, monkeypatch):
    """Rows of one part of the n-grams at a time; together the parts are all of them."""
    docs = make_docs([(i, words(50, i)) for i in range(6)]).withColumn("block", F.col("doc_id").cast("int"))
    whole = {(r.block >> 32, r.hash): r.n for r in S.explode_ngrams(docs, 3).collect()}
    parts = [S.explode_ngrams(docs, 3, part).collect() for part in range(S.PARTS)]
    assert {(r.block >> 32, r.hash): r.n for p in parts for r in p} == whole
    assert sum(map(len, parts)) == len(whole) and max(map(len, parts)) < 0.5 * len(whole)
    sent = []
    explode = S.explode_ngrams
    monkeypatch.setattr(S, "explode_ngrams", lambda *a: (sent.append(a[2]), explode(*a))[1])
    monkeypatch.setattr(S, "HELD_ROWS", 10)
    monkeypatch.setattr(S, "BLOCK_CHARS", 300)
    rows = [(i, words(50, i % 4)) for i in range(9)]
    got = {r.doc_id: r for r in S.score_documents(make_docs(rows)).collect()}
    assert sent == list(range(S.PARTS))
    for (doc_id, _), (n, want) in zip(rows, brute(rows, S.ORDER, S.BACKOFF)):
        assert got[doc_id].n_words == n and abs(got[doc_id].log_score - want) < 1e-8


def test_packed_counts_keep_places_and_totals(spark):
    rows = [(7 << 32, S.CORPUS, 9), ((7 << 32) + 5, 11, 6_000_000_002), ((7 << 32) + 3, 13, 2), (1 << 32, S.CORPUS, 9)]
    counts = spark.createDataFrame(rows, "block long, hash long, total long").coalesce(1)
    got = {r.block: [S.unpack_integers(bytes(c), "int64").tolist() for c in (r.places, r.totals)]
           for r in S.packed_counts(counts, 2).collect()}
    assert got == {7: [[0, 3, 5], [9, 11, 6_000_000_013]], 1: [[0], [9]]}
