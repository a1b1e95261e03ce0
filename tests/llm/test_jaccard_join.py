import re

import numpy as np
import pytest

from tests.llm.conftest import ODD_TEXTS
from wardline.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_sets(rows):
    out = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        out.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute(rows):
    """component_id per row, by comparing every pair."""
    sets = brute_sets(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        lowest[r] = min(lowest.get(r, doc_id), doc_id)
    return [(d, len(s), lowest[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def edited(text, seed, every):
    rng = np.random.default_rng(seed)
    w = text.split()
    for i in rng.choice(len(w), max(1, len(w) // every), replace=False):
        w[i] = f"edit{seed}x{i}"
    return " ".join(w)


def corpus(words):
    rows = [(i, words(60 + i, i)) for i in range(30)]
    base = words(120, 99)
    rows += [(100 + i, edited(base, i, 45)) for i in range(40)]         # a group of near copies
    rows += [(200, base), (201, base.upper()), (202, base + " tail")]
    passage = words(60, 77)                                              # shared, but not similar
    rows += [(300 + i, words(50, 500 + i) + " " + passage + " " + words(50, 900 + i)) for i in range(30)]
    rows += [(400, "a b c"), (401, "A  b\tc"), (402, "a b"), (403, "a b c d e"), (404, "a b c d e f")]
    return rows


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_equals_all_pairs(make_docs, words):
    rows = corpus(words)
    assert result(J.jaccard_components(make_docs(rows))) == sorted(brute(rows))


@pytest.mark.parametrize("share", [0.3, 1.0])
def test_frequent_classes_lose_no_link(make_docs, words, share, monkeypatch):
    """Any choice of frequent shingles gives the same links, through combined signatures."""
    rows = corpus(words)
    rng = np.random.default_rng(3)
    monkeypatch.setattr(J, "frequent_cells", lambda cells: rng.random(1 << J.CELL_BITS) < share)
    assert result(J.jaccard_components(make_docs(rows))) == sorted(brute(rows))


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for trial in range(300):
        n = int(rng.integers(3, 120))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        miss = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate((rng.permutation(a)[miss:],
                                      rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64))))
        common = len(np.intersect1d(a, b))
        frequent = rng.random(1 << J.CELL_BITS) < rng.choice([0.0, 0.5, 0.9, 1.0])
        if 100 * common >= 75 * (len(a) + len(b) - common) and len(a) != common != len(b):
            sa, sb = J.signatures(a, frequent)[0], J.signatures(b, frequent)[0]
            assert len(np.intersect1d(sa, sb)), (trial, n, miss)


def test_nulls_repeats_and_empty_tables(make_docs):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(50, "p q r s t u"), (50, "p q r s t u"),
                                                         (40, "P Q R S T U"), (60, "one")]
    assert result(J.jaccard_components(make_docs(rows))) == sorted(brute(rows))
    out = J.jaccard_components(make_docs([(None, "k l m n o"), (9, "k l m n o"), (None, "lonely text")]))
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(None, 9), (9, 9), (None, None)}
    assert J.jaccard_components(make_docs([])).collect() == []


def test_one_document_of_each_group_stays(make_docs, words):
    rows = corpus(words) + [(1000, None), (1001, None), (1002, "")]
    kept = J.keep_one_per_component(make_docs(rows))
    assert kept.columns == make_docs([]).columns
    want = [d for d, n, c in brute(rows) if d == c]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_one_row_of_each_group_stays_with_repeated_and_null_ids(make_docs, words):
    a, b, c, d = (words(40, k) for k in range(4))
    rows = [(5, a), (5, a), (5, a), (None, a), (9, a.upper()),      # repeats, a null id, a copy
            (7, a + " tail"), (7, b),                               # one id, two texts
            (None, c), (None, c), (None, d), (None, d + " tail"),   # only null ids
            (8, ""), (8, ""), (None, None)]
    kept = [(r.doc_id, r.text) for r in J.keep_one_per_component(make_docs(rows)).collect()]
    last = [t for i, t in kept if i is None and t in (d, d + " tail")]
    assert len(last) == 1
    want = [(5, a), (7, b), (None, c), (None, last[0]), (8, ""), (8, ""), (None, None)]
    assert sorted(kept, key=str) == sorted(want, key=str)
