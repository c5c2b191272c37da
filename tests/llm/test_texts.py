"""Text operators against brute force, and the edges of their input."""

import re
import unicodedata

import numpy as np
import pytest
from lodestrata.llm.leaks import LeakRules, PassageIndex, find_leaks, fold
from lodestrata.llm.mixing import fill, mix
from lodestrata.llm import reading
from lodestrata.llm.reading import fit_levels, ReadingRules, pool_adjacent, reading_levels, sentences

WORDS = "red blue stone river market counts keeps a the lamp window under garden price of storm quiet every line".split()


def passage(rng, n):
    return " ".join(WORDS[rng.integers(len(WORDS))] for _ in range(n))


def spoil(text, rng):
    """Other case, accents, punctuation, spacing and invisible characters."""
    out = []
    for w in text.split():
        if rng.random() < 0.2:
            w = w.upper()
        if rng.random() < 0.2:
            w = w.replace("e", "é", 1)
        if rng.random() < 0.2 and len(w) > 2:
            w = w[:1] + "­​" + w[1:]
        out.append(w + ["", ",", ".", " -", "\n"][rng.integers(5)])
    return " ".join(out)


def brute(docs, items, k=12):
    def norm(t):
        t = unicodedata.normalize("NFKD", t.casefold())
        return re.findall(r"[^\W_]+", "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf"))

    index: dict = {}
    for i, s, t in items:
        w = norm(t or "")
        for a in range(len(w) - k + 1):
            index.setdefault(tuple(w[a : a + k]), set()).add((i, s))
    return {(d, *x) for d, t in docs if t is not None for w in [norm(t)] for a in range(len(w) - k + 1) for x in index.get(tuple(w[a : a + k]), ())}


@pytest.fixture(scope="module")
def leaky():
    rng = np.random.default_rng(8)
    items = [(i, s, passage(rng, 40)) for i in range(12) for s in ("passage", "ref_text")] + [(90, "passage", "too short"), (91, "passage", None)]
    docs = []
    for d in range(120):
        parts = [passage(rng, 30)]
        if rng.random() < 0.6:
            w = items[rng.integers(24)][2].split()
            a, n = int(rng.integers(0, 25)), int(rng.integers(9, 16))
            parts.append(spoil(" ".join(w[a : a + n]), rng))
        docs.append((d, " ".join([*parts, passage(rng, 20)])))
    docs += [(500, None), (501, ""), (502, "...​"), (503, passage(rng, 20_000) + " " + items[3][2])]
    return docs, items


@pytest.mark.parametrize("rules", [LeakRules(), LeakRules(block_chars=400), LeakRules(q=8, edits=2, slice_hits=50)])
def test_leaks_like_brute_force(spark, leaky, rules):
    docs, items = leaky
    d = spark.createDataFrame(docs, "id bigint, text string").selectExpr("*", "1 as item_id", "'x' as side")
    got = find_leaks(d, spark.createDataFrame(items, "item_id bigint, side string, text string"), rules)
    assert {(r.doc_id, r.item_id, r.side) for r in got.collect() if r.exact_windows} == brute(docs, items)


def test_small_edits_are_reported(spark):
    text = "every quiet market keeps the stone under a red lamp and counts prices"
    got = find_leaks(spark.createDataFrame([(1, text.replace("stone", "stine"))], "id bigint, text string"), spark.createDataFrame([(7, "p", text)], "item_id bigint, side string, text string")).collect()
    assert len(got) == 1 and got[0].exact_windows == 0 and got[0].windows > 0


def test_alignment_like_dynamic_programming():
    rng = np.random.default_rng(3)
    for _ in range(30):
        text = passage(rng, 14)
        index = PassageIndex([(1, "p", text)], LeakRules(edits=2))
        chars = list("".join(fold(text)))
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(len(chars)))
            match rng.integers(3):
                case 0:
                    chars[at] = "q"
                case 1:
                    chars.insert(at, "q")
                case _:
                    del chars[at]
        codes = np.frombuffer("".join(chars).encode("utf-32-le"), np.uint32)
        w = np.arange(len(index.starts[0]) - 12)
        got = index.align(np.zeros(len(w), np.int64), w, np.full(len(w), -3), codes, np.zeros(len(w), np.int64), np.full(len(w), len(codes)))
        for k in w:
            piece = index.codes[0][index.starts[0][k] : index.starts[0][k + 12]]
            cost = np.zeros(len(codes) + 1, int)
            for c in piece:
                new = np.empty_like(cost)
                new[0] = cost[0] + 1
                for j in range(1, len(cost)):
                    new[j] = min(cost[j - 1] + (codes[j - 1] != c), cost[j] + 1, new[j - 1] + 1)
                cost = new
            if cost.min() <= 2:  # within the budget the band holds the whole alignment
                assert got[k] == cost.min()
            else:
                assert got[k] == 3


def test_leaks_of_nothing(spark):
    d, i = spark.createDataFrame([], "id bigint, text string"), spark.createDataFrame([], "item_id bigint, side string, text string")
    assert find_leaks(d, i).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a b")], "id bigint, text string"), i).count() == 0


def test_fill_spreads_what_is_capped():
    np.testing.assert_allclose(fill(np.array([0.5, 0.3, 0.2]), np.array([10.0, 1e9, 1e9]), 100), [10, 54, 36])
    np.testing.assert_allclose(fill(np.array([0.5, 0.5]), np.array([10.0, 20.0]), 100), [10, 20])
    np.testing.assert_allclose(fill(np.array([0.0, 0.0]), np.array([10.0, 20.0]), 100), [0, 0])


def test_mixture_meets_rates(spark):
    docs = [(i, "a" if i % 3 else "b", "one two three four" if i % 2 else "five") for i in range(3000)] + [(9000, None, "x"), (9001, "a", None), (9002, "a", ""), (9003, "c", "some words")]
    targets = [("p", "a", 0.2, 1, 0.5), ("p", "b", 0.8, 4, 0.5), ("p", "gone", 0.1, 4, 0.5), ("all", "c", 1.0, 3, 0.9), (None, "a", 1.0, 1, 1.0)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string").selectExpr("*", "1 as plan_id", "2 as rate", "3 as copies")
    chosen, report = mix(d, spark.createDataFrame(targets, "plan_id string, source string, target_share double, max_repeats int, budget_frac double"))
    rows = {(r.plan_id, r.source): r for r in report.collect()}
    assert rows["p", "gone"].mixed_tokens == 0 and rows["all", "c"].rate == 3
    p = [rows["p", s] for s in ("a", "b")]
    assert abs(sum(r.mixed_tokens for r in p) / p[0].budget - 1) < 0.05
    assert abs(p[1].actual_share - 0.8) < 0.03
    out = chosen.toPandas()
    counts = out[out.plan_id == "p"].groupby("doc_id").size()
    b = counts[[i for i in counts.index if i % 3 == 0]]
    assert set(b.unique()) <= {int(np.floor(p[1].rate)), int(np.floor(p[1].rate)) + 1}
    again = mix(d, spark.createDataFrame(targets, "plan_id string, source string, target_share double, max_repeats int, budget_frac double"))[0]
    assert again.exceptAll(chosen).count() == 0


def test_mixture_of_nothing(spark):
    chosen, report = mix(spark.createDataFrame([], "doc_id bigint, source string, text string"), spark.createDataFrame([("p", "a", 0.5, 1, 0.5)], "plan_id string, source string, target_share double, max_repeats int, budget_frac double"))
    assert chosen.count() == 0 and report.first().actual_share is None


def test_isotonic_regression():
    np.testing.assert_allclose(pool_adjacent(np.array([1.0, 3, 2, 4]), np.ones(4)), [1, 2.5, 2.5, 4])
    np.testing.assert_allclose(pool_adjacent(np.array([3.0, 2, 1]), np.array([1.0, 1, 2])), [1.75] * 3)


def test_sentences_end_at_lines_and_list_items():
    assert len(sentences("A b c. D e\n- f g\n- h; i / j")) == 6
    assert sentences("In 25.5 units.") == [["in", "25", "5", "units"]]


def levelled(rng, n, letters="abcdefghijlmnopqrstuvxyz", common="abdegilmnorst"):
    """Documents of four levels and the two decoys: long words alone, long sentences alone."""
    easy = ["".join(rng.choice(list(common), rng.integers(2, 5))) for _ in range(150)]
    hard = ["".join(rng.choice(list(letters), rng.integers(10, 15))) for _ in range(400)]

    def doc(words, share, length):
        return " ".join(" ".join((hard if rng.random() < share else easy)[rng.integers(150)] for _ in range(length)) + "." for _ in range(words // length))

    kinds = {"1": (0.02, 5, 1), "2": (0.1, 9, 2), "3": (0.3, 14, 3), "4": (0.6, 25, 4), "words": (0.6, 6, 2), "length": (0.02, 27, 2)}
    out = []
    for i in range(n):
        kind = list(kinds)[rng.integers(6)]
        share, length, grade = kinds[kind]
        out.append((i, doc(60 if length > 20 else 50, share, length), kind, grade))
    return out


def test_demanding_texts_are_told_from_decoys(spark):
    rng = np.random.default_rng(5)
    docs = levelled(rng, 900)
    labels = [(i, int(np.clip(g + (rng.random() < 0.1) * rng.choice([-1, 1]), 1, 4))) for i, _, _, g in docs if i % 2]
    extra = [(5000, None), (5001, ""), (5002, "1 ..."), (5003, docs[0][1]), (5004, "word " * 30_000)]
    d = spark.createDataFrame([(i, t) for i, t, _, _ in docs] + extra, "doc_id bigint, text string").selectExpr("*", "1 as model", "'x' as hist", "0 as grade")
    got = {r.doc_id: r for r in reading_levels(d, spark.createDataFrame([*labels, (1, None)], "doc_id bigint, grade int")).collect()}
    held = [(g == 4, got[i].level == 4) for i, _, _, g in docs if not i % 2]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert 5000 not in got and 5001 not in got and got[5003].level == got[0].level and 5004 in got


def test_a_rare_language_keeps_its_model_and_an_odd_label_does_not(spark):
    rng = np.random.default_rng(7)
    docs = [(i, t, "aa" if rng.random() > 0.01 else "odd", k, g) for i, t, k, g in levelled(rng, 9000)]
    rare = [(10_000 + i, t, "zz", k, g) for i, t, k, g in levelled(rng, 40, "αβγδεζηθικλμνξοπρστυφχψω", "αδεγιλμνορστ") if k in "14"][:7]
    chars = lambda rows: sum(len(r[1]) for r in rows)
    assert chars(rare) < 0.0011 * chars(docs) and {k for *_, k, _ in rare} == {"1", "4"}
    d = spark.createDataFrame([r[:3] for r in docs + rare], "doc_id bigint, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[4]) for r in docs if r[0] % 4 == 0], "doc_id bigint, grade int")
    got = {r.doc_id: r.level for r in reading_levels(d, labels, "lang").collect()}
    assert [got[r[0]] == 4 for r in rare] == [r[3] == "4" for r in rare]
    odd = [(got[r[0]] == 4) == (r[4] == 4) for r in docs if r[2] == "odd"]
    assert sum(odd) / len(odd) > 0.95


def test_many_models_are_tried_from_a_shortlist():
    rng = np.random.default_rng(3)
    rules = ReadingRules(orders=3, table_bits=10)
    models = rng.poisson(2.0, (9, 3, 1024)).astype(np.float32)
    grams = [rng.integers(0, 1024, 500) for _ in range(3)]
    text = np.sort(rng.integers(0, 7, 500))
    models[4, :, :] += 0.001
    whole = reading._by_models(grams, text, 7, models, ReadingRules(orders=3, table_bits=10, shortlist=9))
    some = reading._by_models(grams, text, 7, models, rules)
    same = whole[0] == some[0]
    assert same.any() and np.allclose(whole[1][same[text]], some[1][same[text]])


def test_tables_grow_with_the_collection():
    base = ReadingRules()
    assert reading._sized(base, 100_000, 5).table_bits == 17 and reading._sized(base, 16_000_000, 5).table_bits == 19
    assert reading._sized(base, 10**10, 8).table_bits == 19 and reading._sized(base, 10**10, 32).table_bits == 17


def test_levels_without_labels_or_texts(spark):
    none = spark.createDataFrame([], "doc_id bigint, grade int")
    assert reading_levels(spark.createDataFrame([], "doc_id bigint, text string"), none).count() == 0
    assert reading_levels(spark.createDataFrame([(1, "some words")], "doc_id bigint, text string"), none).first().level is None
    assert len(fit_levels(np.empty(0), np.empty(0), np.empty(0), ReadingRules())) == 3
