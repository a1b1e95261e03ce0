import pytest

from tests.llm.conftest import ODD_TEXTS
from wardline.llm import decontamination as D

ITEM = ("A train leaves Paris at 9 and travels 240 km at 80 km per hour . How long does the trip of "
        "the train take if Anna waits 15 minutes in Lyon before she goes on to the coast ?")
OTHER = ("A train leaves Berlin at 7 and travels 360 km at 90 km per hour . How long does the trip of "
         "the train take if Peter waits 20 minutes in Mainz before she goes on to the coast ?")
# Berlin stands for Paris and for Lyon: no single value fits the slots, so windows drop out
MIXED = OTHER.replace("Mainz", "Berlin")


def leaks(make_docs, spark, rows, items):
    bench = spark.createDataFrame([(*i, 1, "x") for i in items],
                                  "item_id long, text string, shift long, best string")
    return {(r.doc_id, r.item_id): r for r in D.find_leaks(make_docs(rows), bench).collect()}


def test_exact_and_reparameterised_items_are_found(make_docs, spark, words):
    rows = [(1, words(40, 1) + ". " + ITEM + " " + words(40, 2)), (2, words(90, 3)),
            (3, words(20, 4) + ". " + OTHER), (4, ITEM.upper().lower()), (5, " ".join(ITEM.split()[:9]))]
    found = leaks(make_docs, spark, rows, [(7, ITEM), (8, words(30, 9))])
    assert set(found) == {(1, 7), (3, 7), (4, 7)}
    assert found[1, 7].n_covered >= found[1, 7].n_tokens - 1


def test_inconsistent_slots_cover_less(make_docs, spark):
    repeated = " ".join([ITEM, ITEM])  # slot values occur twice, so they bind
    good = " ".join([OTHER, OTHER])
    bad = " ".join([OTHER, OTHER.replace("Berlin", "Prague").replace("360", "41").replace("Peter", "Ina")])
    found = leaks(make_docs, spark, [(1, good), (2, bad)], [(7, repeated)])
    assert found[1, 7].n_covered == found[1, 7].n_tokens
    assert found[2, 7].n_covered < found[1, 7].n_covered


@pytest.mark.parametrize("length", [5, 8, 9, 10, 14])
def test_short_items(make_docs, spark, words, length):
    item = words(length, 50)
    rows = [(1, words(30, 1) + " " + item + " " + words(30, 2)), (2, words(60, 3))]
    assert set(leaks(make_docs, spark, rows, [(1, item)])) == {(1, 1)}


def test_nulls_repeats_and_empty_tables(make_docs, spark, words):
    item = words(25, 5)
    rows = [(None, item), (3, item), (3, item), *[(10 + i, t) for i, t in enumerate(ODD_TEXTS)]]
    items = [(None, item), (1, item), (1, item), (2, None), (3, ""), (4, "two words")]
    assert set(leaks(make_docs, spark, rows, items)) == {(None, None), (None, 1), (3, None), (3, 1)}
    assert leaks(make_docs, spark, [], items) == {}
    assert leaks(make_docs, spark, rows, []) == {}
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = D.keep_clean(make_docs(rows), bench)
    assert kept.columns == make_docs([]).columns
    assert sorted(r.doc_id for r in kept.collect()) == [10 + i for i in range(len(ODD_TEXTS))]


POOR = ["What is 12 + 7 * 3 - 4 / 2 ?", "1 1 2 3 5 8 13 21 34 55 89 144", "Anna Meyer Paul Weber Ida Lang Otto Kern",
        "The Old King Of The North Sea And His Seven Sons Of Iron", "size 4 mm 12 kg 30 cm 7 g 15 mm 9 t 2 km"]


def test_items_poor_in_literals(make_docs, spark, words):
    rows = [(i, words(30, i) + " " + item + " " + words(30, 90 + i)) for i, item in enumerate(POOR)]
    other = {0: "What is 13 - 8 * 5 + 9 / 6 ?", 1: "2 4 6 8 10 12 14 16 18 20 22 24", 2: "Eva Braun Max Holz Lea Wolf Tim Berg"}
    rows += [(100 + i, words(30, i) + " " + t + " " + words(30, 90 + i)) for i, t in other.items()]
    found = leaks(make_docs, spark, rows, list(enumerate(POOR)))
    assert set(found) == {(i, i) for i in range(len(POOR))}
    assert all(r.n_covered == r.n_tokens for r in found.values())


def test_calculations_with_other_numbers(make_docs, spark, words):
    """Equal operators and consistent values: the question with other numbers."""
    item = "What is 12 + 7 * 12 - 4 / 2 ?"
    a, b = words(20, 1), words(20, 2)
    texts = ["What is 13 + 8 * 13 - 9 / 6 ?", "what is 13 + 8 * 13 - 9 / 6", "What is 13 + 8 * 14 - 9 / 6 ?",
             "What is 13 - 8 * 13 - 9 / 6 ?", "What is 13 8 13 9 6 ?", "How is 13 + 8 * 13 - 9 / 6 ?"]
    rows = [(i, f"{a} {t} {b}") for i, t in enumerate(texts)]
    assert set(leaks(make_docs, spark, rows, [(1, item)])) == {(0, 1), (1, 1)}


def test_items_of_few_words(make_docs, spark, words):
    items = [(1, "What is 2 + 2 ?"), (2, "Name the capital city"), (3, "Why ?"), (4, "...")]
    a, b = words(20, 1), words(20, 2)
    rows = [(1, "What is 2 + 2 ?"), (2, f"{a}. What is 2 + 2? {b}"), (3, f"{a}\nname the capital city\n{b}"),
            (4, f"{a} name the capital city {b}"), (5, f"{a}: name the capital city. {b}"), (6, "Why"),
            (7, f"{a} why {b}"), (8, f"{a}. Why {b}"), (9, f"{a}. Name the capital cities. {b}"),
            (10, "What is 2 + 3 ?"), (11, f"{a}. What is 2"), (12, "2 ?"), (13, ". ... !")]
    found = leaks(make_docs, spark, rows, items)
    assert set(found) == {(1, 1), (2, 1), (3, 2), (5, 2), (6, 3)}
    assert all(r.n_covered == r.n_tokens for r in found.values())


def brute(docs, items, width=10, min_tokens=13):
    """Leaks in texts of lower-case words and numbers parted by spaces, all pairs of
    windows compared as tuples."""
    def number(w):
        return w.isdigit()

    found = {}
    for doc_id, text in docs:
        d = text.split()
        for item_id, item in items:
            t = item.split()
            size = min(width, len(t))
            for shift in range(-len(t), len(d)):
                good = []
                for at in range(len(t) - size + 1):
                    w, v = t[at:at + size], d[max(shift + at, 0):max(shift + at + size, 0)]
                    same = len(v) == size and all(x == y or number(x) and number(y) for x, y in zip(w, v))
                    if same and shift + at >= 0 and (2 * sum(map(number, w)) <= size or w == v):
                        good.append(at)
                binds = {}
                for at in good:
                    for k in range(at, at + size):
                        if number(t[k]):
                            binds.setdefault((t[k], d[shift + k]), set()).add((at, k))
                best = {}
                for (x, y), places in binds.items():
                    best.setdefault(x, []).append((-len(places), y))
                wrong = {at for (x, y), places in binds.items() if len(best[x]) > 1 and y != keep(best[x])
                         for at, _ in places}
                covered = {k for at in good if at not in wrong for k in range(at, at + size)}
                if covered and (2 * len(covered) >= len(t) or len(covered) >= min_tokens):
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), 0), len(covered))
    return found


def keep(options):
    first = sorted(options)
    # the data of this test have no ties between bindings; a tie would go by hash
    return first[0][1] if first[0][0] < first[1][0] else None


def test_equals_all_pairs(make_docs, spark, words):
    """Items and documents cut, changed and joined at random against the plain version."""
    import random

    rng = random.Random(11)
    items = [(i, " ".join(w if rng.random() < .75 else str(rng.randint(2, 9) * 111) for w in
                          words(rng.randint(5, 40), 70 + i).split())) for i in range(12)]
    docs = []
    for i in range(120):
        parts = [words(rng.randint(1, 15), 200 + i)]
        for _ in range(rng.randint(1, 3)):
            t = rng.choice(items)[1].split()
            lo = rng.randint(0, len(t) // 2) if rng.random() < .5 else 0
            t = t[lo:lo + rng.randint(4, 45)]
            new = {n: str(rng.randint(2, 9) * 1001) for n in t}
            t = [new[w] if w.isdigit() else w for w in t] if rng.random() < .5 else t
            if rng.random() < .4:
                t[rng.randrange(len(t))] = "changed"
            parts += [*t, "between"]
        docs.append((i, " ".join(" ".join(parts).split())))
    got = {k: r.n_covered for k, r in leaks(make_docs, spark, docs, items).items()}
    want = brute(docs, items)
    assert len(want) > 40 and got == want


def test_very_long_texts(make_docs, spark, words):
    long = " ".join(words(1000, s) for s in range(900))  # beyond one block of 4 MB
    rows = [(1, long + ". " + ITEM), (2, long), (3, ITEM)]
    assert len(long) > 4 << 20
    assert set(leaks(make_docs, spark, rows, [(7, ITEM)])) == {(1, 7), (3, 7)}


QUESTION = "What city did the old King Louis visit first when Anna was 12 years"


@pytest.mark.parametrize("length", range(5, 15))
def test_copies_wherever_they_stand(make_docs, spark, words, length):
    item = " ".join(QUESTION.split()[:length]) + " ?"
    a, b = words(20, 1), words(20, 2)
    copies = [item, f"{a}. {item} {b}", f"{a} {item} {b}", f"{a}, {item} {b}", f"{a} - {item} {b}",
              f"{a} - \"{item}\" {b}", f"{a}—{item}—{b}", f"{a} “{item[:-2]}?” {b}",
              f"({a}.) {item} {b}", f"{a} 12 {item} {b}", f"{a} {item.lower()} {b}", f"{a} {item.upper()} {b}"]
    rows = [*enumerate(copies), (50, a + " " + b)]
    found = leaks(make_docs, spark, rows, [(1, item)])
    assert set(found) == {(i, 1) for i in range(len(copies))}
    assert all(r.n_covered == r.n_tokens for r in found.values())


def test_first_words_of_a_long_item(make_docs, spark, words):
    """Thirteen words are enough, from the first one on and with other names and numbers too."""
    passage, other = " ".join(ITEM.split()[:16]), " ".join(OTHER.split()[:16])
    rows = [(1, words(20, 1) + ", " + passage + " " + words(20, 2)), (2, words(20, 3) + ", " + other + " " + words(20, 4))]
    found = leaks(make_docs, spark, rows, [(7, ITEM + " " + words(30, 9))])
    assert {k: r.n_covered for k, r in found.items()} == {(1, 7): 15, (2, 7): 15}


def test_few_leaked_documents_are_broadcast(make_docs, spark, words):
    """The clean documents' texts are not shuffled to be kept, by the stored size of the leaked ids."""
    docs = make_docs([(1, words(40, 1) + ". " + ITEM + " " + words(40, 2)), (2, words(90, 3)), (None, words(50, 4))])
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4096")
    try:
        kept = D.keep_clean(docs, bench)
        text = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
        assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
