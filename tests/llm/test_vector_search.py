"""Top-k search and hard negatives against plain versions in exact integers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm.hard_negatives import AnchorCodes, MiningParams, Rotations, codes, mine
from wardline.llm.topk_search import top_k
from wardline.llm.vectors import LIMIT, inner_products

SCHEMA = ("vec_id long, embedding array<float>, label int, row long, score long, bin long, "
          "lo long, kind int, rank int, place int")


@pytest.fixture
def make_vectors(spark):
    def build(rows):
        return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], SCHEMA)

    return build


def whole(vector, scale):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def product(x, y):
    return sum(a * b for a, b in zip(x, y))


def by_score(found):
    return sorted(found, key=lambda r: (-r[1], r[0] is None, r[0]))


def brute_top(rows, k, every):
    used = [(i, v) for i, e, _ in rows if (v := whole(e, 64)) is not None]
    out = []
    for n, (i, v) in enumerate(used):
        if i is not None and i % every == 0:
            found = by_score([(j, product(v, w)) for m, (j, w) in enumerate(used) if m != n])
            out += [(i, r + 1, j, s) for r, (j, s) in enumerate(found[:k])]
    return out


def brute_mine(rows, every):
    used = [(i, v, y) for i, e, y in rows if y is not None and (v := whole(e, 256)) is not None]
    out = []
    for n, (i, v, y) in enumerate(used):
        if i is None or i % every:
            continue
        others = [(j, product(v, w), z) for m, (j, w, z) in enumerate(used) if m != n]
        for p, top in by_score([(j, s) for j, s, z in others if z == y])[:5]:
            fits = by_score([(j, s) for j, s, z in others if z != y and 80 * top <= 100 * s <= 100 * top])
            out += [(i, p, r + 1, j, top, s) for r, (j, s) in enumerate(fits[:5])]
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def same(got, want):
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def random_rows(n, dim, seed, labels=4, spread=1.0):
    r = random.Random(seed)
    centres = [[0.3 * r.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = r.randrange(labels)
        out.append((i, [spread * (c + r.gauss(0, 1)) / dim ** 0.5 for c in centres[label]], label))
    return out


ODD = [(None, [0.5, 0.1, 0.2], 1), (None, [0.5, 0.1, 0.2], 2), (20, None, 1), (40, [0.1, None, 0.2], 1),
       (60, [float("nan"), 0.1, 0.1], 2), (80, [float("inf"), 0.1, 0.2], 2), (0, [0.0, 0.0, 0.0], 1),
       (100, [], 1), (100, [0.4, -0.3, 0.2, 0.9], 2), (100, [0.4, -0.3, 0.2, 0.9], 2),
       (101, [0.4], 1), (102, [1.0, 2.0], None), (103, [-0.4, 0.3, 0.2], 3), (200, [0.5, 0.1, 0.2], 1)]


@pytest.mark.parametrize("dim", [1, 7, 64])
def test_top_k_equals_plain(make_vectors, dim):
    rows = random_rows(300, dim, dim)
    same(top_k(make_vectors(rows), F.col("vec_id") % 20 == 0, k=20), brute_top(rows, 20, 20))


def test_top_k_ties_and_odd_rows(make_vectors):
    rows = ODD + [(500 + i, [0.25, 0.5, 0.25], i % 3) for i in range(150)]
    rows += [(1000 + i, v, y) for i, v, y in random_rows(80, 3, 5)]
    same(top_k(make_vectors(rows), F.col("vec_id") % 20 == 0, k=20), brute_top(rows, 20, 20))


def test_top_k_few_and_none(make_vectors):
    rows = random_rows(9, 4, 1)
    same(top_k(make_vectors(rows), F.col("vec_id") % 4 == 0, k=20), brute_top(rows, 20, 4))
    same(top_k(make_vectors(rows[:1]), F.col("vec_id") % 4 == 0, k=20), [])
    same(top_k(make_vectors([]), F.col("vec_id") % 4 == 0, k=20), [])


def test_top_k_of_large_components(make_vectors):
    """Several rounds of histograms; products beyond double precision."""
    rows = [(i, [x * 3e4 for x in v], y) for i, v, y in random_rows(60, 5, 9)]
    rows += [(100 + i, [1e7 * (i % 5), 3.25e6, -2e6 * i], 1) for i in range(12)]
    same(top_k(make_vectors(rows), F.col("vec_id") % 10 == 0, k=7), brute_top(rows, 7, 10))


@pytest.mark.parametrize("dim,spread", [(3, 1.0), (16, 1.0), (64, 0.3), (100, 1.0)])
def test_negatives_equal_plain(make_vectors, dim, spread):
    rows = random_rows(250, dim, dim, spread=spread)
    want = brute_mine(rows, 10)
    same(mine(make_vectors(rows), F.col("vec_id") % 10 == 0), want)
    assert want


def test_negatives_ties_and_odd_rows(make_vectors):
    rows = ODD + [(500 + i, [0.25, 0.5, 0.25], i % 3) for i in range(120)]
    rows += [(1000 + i, v, y) for i, v, y in random_rows(80, 3, 5)]
    same(mine(make_vectors(rows), F.col("vec_id") % 100 == 0), brute_mine(rows, 100))
    same(mine(make_vectors([]), F.col("vec_id") % 100 == 0), [])
    same(mine(make_vectors([(0, [1.0], 1), (1, [1.0], 2)]), F.col("vec_id") % 100 == 0), [])


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_and_tell_rows_apart(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(400, 48)) * 40)
    x[0], x[1] = 0, x[2]
    turns = Rotations(48, MiningParams())
    lower, upper = AnchorCodes(x[:50], turns).bounds(*codes(x, turns), np.sqrt((x * x).sum(axis=1)))
    scores = inner_products(x[:50], x)
    assert (lower <= scores).all() and (scores <= upper).all()
    assert (upper - lower).mean() < 1.0 * np.outer(*[np.sqrt((y * y).sum(axis=1)) for y in (x[:50], x)]).mean()


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).normal(size=(5, 70))
    turns = Rotations(70, MiningParams())
    turned = turns.turn(x)
    assert np.allclose((turned ** 2).sum(axis=1), 4 * (x ** 2).sum(axis=1))
    assert np.allclose(turns.back(turned)[:, :70], 4 * x)


def test_exact_products():
    big = np.array([[2.0 ** 40, 3.0], [-(2.0 ** 40), 1.0]])
    assert inner_products(big, big).tolist() == [[LIMIT, -LIMIT], [-LIMIT, LIMIT]]
    fine = np.array([[2.0 ** 27 + 1, 2.0 ** 26 + 1]])
    assert inner_products(fine, fine).tolist() == [[(2 ** 27 + 1) ** 2 + (2 ** 26 + 1) ** 2]]
