import itertools
import re
from collections import Counter

import numpy as np

from tests.llm.conftest import ODD_TEXTS
from wardline.llm import line_crf as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    inside = [False] * len(w)
    for i in range(len(w) - 4):
        if windows[tuple(w[i:i + 5])] > 1:
            inside[i:i + 5] = [True] * 5
    repeated = sum(inside)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, repeated,
            len(w) < 10 or 100 * repeated > 20 * len(w))


def texts(words):
    base = words(30, 1)
    return ODD_TEXTS + [base, base + "\n" + base, base + "\nx\nx\n x\nx", "a b c d e a b c d e", "the " * 20,
                        "| a | b |\n| a | b |", "$$$ é# " * 4, "a b c d\na b c d e f g h"]


def test_base_counts_equal_brute_force(make_docs, words):
    rows = list(enumerate(texts(words)))
    weights = np.zeros(2 * C.N_FEATURES + 4)
    out = {r.doc_id: r for r in C.label_rules(make_docs(rows), weights).collect()}
    for i, t in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert r.kept == (not r.base_failed)  # zero weights: ties go to content


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 7):
        scores, trans = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda y: sum(scores[i, k] for i, k in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert C.viterbi(scores, trans) == list(best)


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(4, C.N_FEATURES)), np.array([1, 0, 0, 1]), rng.normal(size=2 * C.N_FEATURES + 4) / 3

    def likelihood(w):
        emit, trans = C.split_weights(w)
        s = x @ emit
        value = lambda y: sum(s[i, k] for i, k in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
        return value(y) - np.log(sum(np.exp(value(z)) for z in itertools.product((0, 1), repeat=4)))

    g = C.gradient(x, y, w)
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-5
        assert abs((likelihood(w + step) - likelihood(w - step)) / 2e-5 - g[k]) < 1e-5


def test_learned_field_keeps_content_and_drops_boilerplate(make_docs, spark, words):
    good = lambda i: "\n".join(words(14, 100 * i + k).capitalize() + "." for k in range(4))
    junk = lambda i: "\n".join(" | ".join(words(6, 900 * i + k + 7).split()) + " |" for k in range(4))
    rows = [(i, good(i) if i % 4 else junk(i)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(160)], "doc_id long, quality int")
    docs = make_docs(rows)
    out = {r.doc_id: r.kept for r in C.label_rules(docs, C.fit(docs, labels)).collect()}
    assert all(out[i] == (i % 4 > 0) for i in range(160, 200))


def test_nulls_repeats_and_empty_tables(make_docs, spark):
    docs = make_docs([(None, "a b"), (1, "x"), (1, "x"), (2, None)])
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 7)], "doc_id long, quality int")
    weights = C.fit(docs, labels)
    assert not weights.any()
    assert [r.kept for r in C.label_rules(docs, weights).collect()] == [False] * 4
    assert C.label_rules(make_docs([]), weights).collect() == []
