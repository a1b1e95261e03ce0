from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wardline.llm import mixing as M
from tests.llm.conftest import ODD_TEXTS


def water_fill(children, budget):
    """Integer shares by repeated proportional rounds; children: name -> (weight, supply)."""
    out, open_, left = {}, dict(children), min(budget, sum(s for _, s in children.values()))
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, s) in open_.items() if (w * left >= s * total if total else False)]
        # fill the child that fills first, then look again
        if total and full:
            n = min(full, key=lambda n: (open_[n][1] / open_[n][0] if open_[n][0] else float("inf"), n))
            out[n] = open_[n][1]
            left -= out[n]
            del open_[n]
            continue
        shares = {n: (w * left // total if total else min(s, left)) for n, (w, s) in open_.items()}
        extra = left - sum(shares.values())
        for n in sorted(n for n in open_ if open_[n][0] > 0)[:extra if total else 0]:
            shares[n] += 1
        out.update(shares)
        break
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(supplies=st.lists(st.integers(1, 60), min_size=1, max_size=6),
       weights=st.lists(st.integers(1, 9), min_size=6, max_size=6), budget=st.integers(0, 250))
def test_shares_equal_rounds_of_water_filling(spark, supplies, weights, budget):
    params = M.MixParams(weights={("source", f"s{i}"): w for i, w in enumerate(weights)})
    rows = [(f"s{i}", s, min(budget, sum(supplies))) for i, s in enumerate(supplies)]
    df = spark.createDataFrame(rows, "source string, supply long, parent_budget long")
    got = {r.source: r.budget for r in M.share_out(df, [], "source", params).collect()}
    assert sum(got.values()) == min(budget, sum(supplies))
    assert got == water_fill({f"s{i}": (weights[i], s) for i, s in enumerate(supplies)}, budget)


def corpus(make_docs, words):
    rows = []
    for i in range(120):
        lang, source = ("en", "de")[i % 2], f"src{i % 5}"
        rows.append((i, words(3 + i % 7, i), lang, source))
    return rows, make_docs(rows)


def test_leaves_take_a_seeded_prefix_within_budget(make_docs, words):
    rows, docs = corpus(make_docs, words)
    params = M.MixParams(share=0.9, epochs=2)
    out = M.select_mix(docs, params).collect()
    budgets = {(r.domain, r.lang, r.source): r.budget for r in
               M.leaf_budgets(M.stock_of(docs), params).collect()}
    tokens = sum(len(t.split()) for _, t, _, _ in rows)
    assert sum(budgets.values()) == int(tokens * 0.9) == sum(r.taken for r in out)
    by_leaf = defaultdict(list)
    for r in out:
        by_leaf[r.domain, r.lang, r.source].append(r)
    for leaf, taken in by_leaf.items():
        assert sum(r.taken for r in taken) == budgets[leaf]
        assert sum(r.taken < r.n_tokens for r in taken) <= 1       # only the last one is cut
        later = {r.doc_id for r in taken if r.epoch == 1}
        if later:                                                  # an epoch is finished before the next
            own = {i for i, _, lang, s in rows if (lang, s) == leaf[1:]}
            assert {r.doc_id for r in taken if r.epoch == 0} == own
    again = M.select_mix(docs.repartition(7), params).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)
    other = M.select_mix(docs, M.MixParams(share=0.9, epochs=2, seed=18)).collect()
    assert sorted(map(tuple, other), key=str) != sorted(map(tuple, out), key=str)


def test_shortage_goes_to_siblings_first(make_docs, words):
    rows = [(i, words(10, i), "en", "src1") for i in range(2)]            # 20 tokens
    rows += [(10 + i, words(10, i), "en", "src5") for i in range(40)]     # same language, other source
    rows += [(100 + i, words(10, i), "de", "src1") for i in range(40)]
    params = M.MixParams(budget=300, epochs=1, weights={
        ("lang", "en"): 50, ("lang", "de"): 50, ("source", "src1"): 90, ("source", "src5"): 10})
    docs = make_docs(rows)
    same_domain = docs.withColumn("source", docs["source"])
    got = {(r.lang, r.source): r.budget for r in M.leaf_budgets(
        M.stock_of(same_domain).withColumn("domain", M.F.lit("d0")), params).collect()}
    assert got == {("en", "src1"): 20, ("en", "src5"): 130, ("de", "src1"): 150}


def test_nulls_repeats_and_empty_tables(make_docs):
    rows = [(i, t, None, None) for i, t in enumerate(ODD_TEXTS)] + [(None, "x y", "en", "src1"),
                                                                    (5, "same", "en", "src1"), (5, "same", "en", "src1")]
    out = M.select_mix(make_docs(rows), M.MixParams(share=1.0, epochs=1)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(
        [str(i) for i, t in enumerate(ODD_TEXTS) if t and t.strip(" \t\n\x0b\x0c\r")] + ["None", "5", "5"])
    assert M.select_mix(make_docs([])).collect() == []
    kept = M.keep_mix(make_docs(rows), M.MixParams(share=1.0, epochs=1))
    assert kept.columns == make_docs([]).columns and kept.count() == len(out)
