"""Formula operators against brute force, and the edges of their input."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestrata.llm import formula_text as ft
from lodestrata.llm.collapse import SEGMENT_BITS, Filters, assign_keepers
from lodestrata.llm.near_duplicates import Overlap, class_of_each, classes_and_links, expanded
from lodestrata.llm.top_items import top_n

TEXT = "id bigint, text string"


@pytest.mark.parametrize(
    "a, b",
    [
        ("Add($close, Mean($open, 5))", "  add( MEAN[$open;5] , $close ) ;"),
        ("$close * ($open + 1.5)", "((1.5+$open))*$close"),
        ("Greater($a, Less($b, $c))", "greater{less{$c,$b},$a}"),
        ("-1.795 * $x", "（$x * -1.795）"),
        ("Sub($a, $b)", '"sub($A | $B)"'),
        ("Add($close, 5)", "Add($clo\u200bse\u200b, 5)"),
        ("Add($close, 5)", "\ufeffadd($close# , 5)"),
        ("$a ** $b ** $c", "$a ** ($b ** $c)"),
        ("-$a ** 2 * $b", "(-($a ** 2)) * $b"),
        ("Abs(" * 600 + "$a + $b" + ")" * 600, "abs[" * 600 + "$b + ($a)" + "]" * 600),
    ],
)
def test_other_writings_of_a_formula(a, b):
    assert ft.canonical(a) == ft.canonical(b)


@pytest.mark.parametrize(
    "a, b",
    [
        ("Sub($a, $b)", "Sub($b, $a)"),
        ("$a - ($b - $c)", "$a - $b - $c"),
        ("$a + $b * $c", "($a + $b) * $c"),
        ("Mean($a, 5)", "Mean($a, 6)"),
        ("Mul($a, -0.5)", "Mul($a, 0.5)"),
        ("Mul($a, 2.50)", "Mul($a, 25.0)"),
        ("Add(Add($a, $b), $c)", "Add($a, Add($b, $c))"),
        ("$a + $b", "Add($a, $b)"),
        ("$a / $b", "$b / $a"),
        ("Abs(" * 600 + "($a-$b)-$c" + ")" * 600, "Abs(" * 600 + "$a-($b-$c)" + ")" * 600),
        ("Abs(" * 5000 + "$a" + ")" * 5000, "Abs(" * 5000 + "$b" + ")" * 5000),
        ("($a - $b) - $c ~", "$a - ($b - $c) ~ ~ 1 2"),
        ("2 ($a-$b)-$c", "2 $a-($b-$c)"),
        ("Add($größe, 1)", "Add($länge, 1)"),
        ("Mul($a, 1e-5)", "Mul($a, 1e5)"),
        ("$a <= $b", "$a < $b"),
    ],
)
def test_formulas_that_differ(a, b):
    assert ft.canonical(a) != ft.canonical(b)


LEAF = st.sampled_from(["$close", "$open", "1.25", "0.5", "-2.0"])
TREE = st.recursive(LEAF, lambda s: st.one_of(st.tuples(st.sampled_from(["Add", "Mul", "Less", "Sub", "Div"]), s, s), st.tuples(st.just("Mean"), s, st.just("7")), st.tuples(st.sampled_from("+*-/"), s, s)), max_leaves=8)


def write(t, rng) -> str:
    if isinstance(t, str):
        return t.upper() if rng.random() < 0.3 else t
    op, a, b = t
    if op.lower() in ft.COMMUTATIVE and rng.random() < 0.5:
        a, b = b, a
    o, c = [("(", ")"), ("[", "]"), ("{", "}"), ("（", "）")][rng.integers(4)]
    sep = [", ", ";", " | ", "，"][rng.integers(4)]
    x, y = write(a, rng), write(b, rng)
    out = f"{o}{x} {op} {y}{c}" if op in "+*-/" else f"{op.lower() if rng.random() < 0.5 else op}{o}{x}{sep}{y}{c}"
    return f"({out})" if rng.random() < 0.2 else out


@settings(max_examples=150, deadline=None)
@given(TREE, st.integers(0, 1000))
def test_any_two_writings_agree(t, seed):
    rng = np.random.default_rng(seed)
    a, b = write(t, rng), write(t, rng) + [" ", ";", "", "\n"][rng.integers(4)]
    assert ft.canonical(a) == ft.canonical(b)


def bag_pairs(rows, t=0.75):
    bags = [(i, Counter(ft.words(x))) for i, x in rows if i is not None and x is not None]
    out = set()
    for (i, a), (j, b) in combinations(sorted(bags, key=lambda r: r[0]), 2):
        keys = set(a) | set(b)
        big = sum(max(a[k], b[k]) for k in keys)
        if (a == b) or (big and sum(min(a[k], b[k]) for k in keys) / big >= t - 1e-12):
            out.add((i, j))
    return out


def random_formulas(seed, n, tokens):
    rng = np.random.default_rng(seed)
    pool = [f"${c}" for c in "abcde"] + [str(k) for k in range(tokens)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rows[rng.integers(len(rows))][1].split()
            for _ in range(rng.integers(0, max(2, len(words) // 6))):
                words[rng.integers(len(words))] = pool[rng.integers(len(pool))]
            if rng.random() < 0.3:
                words.append(pool[rng.integers(len(pool))])
        else:
            words = [pool[rng.integers(len(pool))] for _ in range(rng.integers(1, 40))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed, tokens, length, tile", [(1, 30, 800.0, 5), (2, 300, 4.0, 20_000), (3, 30, 2.0, 1), (4, 5, 1.0, 7)])
def test_pairs_like_brute_force(spark, seed, tokens, length, tile):
    rows = random_formulas(seed, 150, tokens)
    got = expanded(spark.createDataFrame(rows, TEXT), ft.words, Overlap(list_length=length, block_postings=3000, slice_pairs=500, tile_documents=tile, class_chunk=3))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == bag_pairs(rows)


@pytest.mark.parametrize("t", [0.5, 0.9])
def test_other_thresholds(spark, t):
    rows = random_formulas(9, 120, 40)
    got = expanded(spark.createDataFrame(rows, TEXT), ft.words, Overlap(threshold=t, list_length=5.0))
    assert {tuple(r) for r in got.collect()} == bag_pairs(rows, t)


def test_pairs_of_long_bags(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        if i % 3 == 0:
            base = [f"w{k}" for k in rng.integers(0, 900, int(rng.integers(230, 420)))]
        words = list(base)
        for k in rng.integers(0, len(words), int(rng.integers(0, 60))):
            words[k] = f"w{rng.integers(900)}"
        rows.append((i, " ".join(words[: len(words) - int(rng.integers(0, 40))])))
    for rules in (Overlap(), Overlap(tile_documents=2)):
        found = [tuple(r) for r in expanded(spark.createDataFrame(rows, TEXT), ft.words, rules).collect()]
        assert len(found) == len(set(found)) and set(found) == bag_pairs(rows) and len(found) > 10


def test_a_large_class_is_cut_into_chunks(spark):
    rows = [(i, "a b c") for i in range(40)] + [(100 + i, "a b c d") for i in range(30)] + [(200, "x")]
    df = spark.createDataFrame(rows, TEXT)
    found = [tuple(r) for r in expanded(df, ft.words, Overlap(class_chunk=4)).collect()]
    assert len(found) == len(set(found)) == 70 * 69 // 2 and set(found) == bag_pairs(rows)
    each = {r.id: (r.rep, r.n_links) for r in class_of_each(df, ft.words).collect()}
    assert each == {i: (0, 1) if i < 100 else (100, 1) if i < 200 else (200, 0) for i, _ in rows}


def test_pairs_at_the_edges(spark):
    long = " ".join(f"x{k}" for k in range(700))
    rows = [(1, "a b c d"), (2, "A, b; c d"), (3, None), (None, "a b c d"), (4, ""), (5, "--"), (6, long), (7, long + " y"), (8, "a b c"), (9, "a")]
    df = spark.createDataFrame(rows, TEXT).selectExpr("*", "1 as rep", "'x' as bag", "2 as h1")
    got = {tuple(r) for r in expanded(df, ft.words).collect()}
    assert got == bag_pairs(rows)
    assert (1, 8) in got and (6, 7) in got and (4, 5) in got
    members, links = classes_and_links(spark.createDataFrame([], TEXT), ft.words)
    assert members.count() == links.count() == 0


def test_collapse_like_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        t = ("Add", f"${'abc'[rng.integers(3)]}", ("Mul", str(rng.integers(6)), "$x")) if rng.random() < 0.5 else ("Sub", f"$v{i}", "1")
        rows.append((int(rng.integers(2)), i, write(t, rng)))
    rows += [(0, 1000, None), (None, 1001, "$a"), (0, None, "$a"), (0, 1002, ""), (0, 1003, " "), (0, 1004, "(" * 3000 + "$a" + ")" * 3000)]
    rows += [(1, 2000 + k, "Add($q, 1)" if k % 2 else "add[1;$Q]") for k in range(200)]
    df = spark.createDataFrame(rows, "part int, id bigint, text string").selectExpr("*", "1 as h1", "'k' as keep_id")
    groups: dict = {}
    for p, i, x in rows:
        if i is not None and x is not None:
            groups.setdefault((p, ft.canonical(x)), []).append(i)
    want = {(p, i, min(g), len(g)) for (p, _), g in groups.items() for i in g}
    want = {w for w in want if w[0] is not None}
    got = {tuple(r) for r in assign_keepers(df.filter("part is not null"), ft.canonical).collect()}
    assert got == want
    # many small ranges of hashes, filters that are full, and filters as they should be
    for filters in (Filters(range_bits=SEGMENT_BITS, bits_a_row=4096), Filters(bits_a_row=1, range_bits=1 << 10), Filters(bits_a_row=100_000)):
        assert {tuple(r) for r in assign_keepers(df.filter("part is not null"), ft.canonical, filters=filters).collect()} == want
    only = {tuple(r) for r in assign_keepers(df.filter("part is not null"), ft.canonical, repeats_only=True).collect()}
    assert only == {w for w in want if w[3] > 1}
    assert assign_keepers(spark.createDataFrame([], "part int, id bigint, text string"), ft.canonical).count() == 0


def brute_top(rows, n):
    groups: dict = {}
    for m, s, x, i in rows:
        if m is not None and s is not None and x is not None and not math.isnan(x):
            groups.setdefault((m, s), []).append((-x + 0.0, i is None, i if i is not None else 0))
    return Counter(((m, s), v[2] if not v[1] else None) for (m, s), g in groups.items() for v in sorted(g)[:n])


@pytest.mark.parametrize("n, bands", [(5, (1 / 64, 1 / 8, 1 / 2)), (1, (0.5,)), (3, ())])
def test_top_like_brute_force(spark, n, bands):
    rng = np.random.default_rng(6)
    rows = [(f"m{rng.integers(30)}", int(rng.integers(20)), float(np.round(rng.normal(), int(rng.integers(1, 4)))), i) for i in range(3000)]
    rows += [("hot", 1, float(np.round(rng.normal(), 1)), 10_000 + i) for i in range(2000)]
    rows += [("hot", 1, 9.0, 10_001), ("z", 1, 0.0, 20_002), ("z", 1, -0.0, 20_001), ("z", 1, float("nan"), 1), ("z", 1, None, 2), (None, 1, 99.0, 3), ("z", None, 99.0, 4), ("z", 1, -1.0, None), ("i", 1, float("inf"), 5)]
    df = spark.createDataFrame(rows, "method string, seed int, fit double, rec_id bigint").selectExpr("*", "1 as __rn", "'x' as count")
    got = Counter(((r.method, r.seed), r.rec_id) for r in top_n(df, ["method", "seed"], "fit", "rec_id", n, bands).collect())
    assert got == brute_top(rows, n)


def test_top_of_nothing(spark):
    assert top_n(spark.createDataFrame([], "a string, s double, t int"), ["a"], "s", "t", 3).count() == 0
