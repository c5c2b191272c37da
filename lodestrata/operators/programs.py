"""Pools of formulas: scoring in batches, decorrelation, descriptors on a grid, and search logs."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.dsl.tree import Node, parse, size, to_text
from lodestrata.operators.metrics import correlation, daily_ic, finite, many_ics
from lodestrata.plans.compiler import evaluate

#: Formulas of one plan; longer batches are cut into parts of this size, each with one exchange.
BATCH = 24


def pool_ics(panel: DataFrame, formulas: dict[str, str], label: str, batch: int = BATCH) -> DataFrame:
    """(name, ic, icir, n): mean daily IC of each formula. Equal formulas, however written, are computed once."""
    canon: dict[str, list[str]] = {}
    for name, text in formulas.items():
        canon.setdefault(to_text(parse(text)), []).append(name)
    texts, out = list(canon), None
    for s in range(0, len(texts), batch):
        part = {f"f{i}": t for i, t in enumerate(texts[s : s + batch])}
        frame = evaluate(panel, {**part, "label": label})
        ics = many_ics(frame, list(part), ["label"])
        names = F.create_map(*[x for k, t in part.items() for x in (F.lit(k), F.array(*map(F.lit, canon[t])))])
        sd = F.stddev_samp("ic")
        rows = ics.groupBy("score").agg(F.avg("ic").alias("ic"), (F.avg("ic") / F.when(sd > 0, sd)).alias("icir"), F.count("ic").alias("n")).select(F.explode(names[F.col("score")]).alias("name"), "ic", "icir", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def mutual_ics(frame: DataFrame, columns: list[str]) -> np.ndarray:
    """Mean daily correlation of each pair of columns: one aggregation by day, one matrix on the driver."""
    pairs = list(combinations(range(len(columns)), 2))
    out = np.eye(len(columns))
    if pairs:
        daily = frame.groupBy("datetime").agg(*[correlation(finite(columns[i]), finite(columns[j])).alias(f"c{k}") for k, (i, j) in enumerate(pairs)])
        row = daily.agg(*[F.avg(f"c{k}").alias(f"c{k}") for k in range(len(pairs))]).first()
        for k, (i, j) in enumerate(pairs):
            out[i, j] = out[j, i] = row[k] if row[k] is not None else 0.0
    return out


def hall_of_fame(fitness: np.ndarray, corr: np.ndarray, keep: int) -> list[int]:
    """Of the most correlated pair the less fit one goes, until ``keep`` are left; ties keep the earlier."""
    left = sorted(range(len(fitness)), key=lambda i: (-fitness[i], i))
    while len(left) > keep:
        c = np.abs(corr[np.ix_(left, left)]).copy()
        np.fill_diagonal(c, -1)
        i, j = np.unravel_index(int(c.argmax()), c.shape)
        left.pop(max(i, j))
    return left


def greedy_uncorrelated(fitness: np.ndarray, corr: np.ndarray, most: float, keep: int) -> list[int]:
    """In order of fitness, those whose correlation with all taken ones stays under ``most``."""
    taken: list[int] = []
    for i in sorted(range(len(fitness)), key=lambda i: (-fitness[i], i)):
        if len(taken) < keep and all(abs(corr[i, j]) < most for j in taken):
            taken.append(i)
    return taken


def pool_weights(ics: np.ndarray, mutual: np.ndarray, l1: float = 0.0, rounds: int = 2000) -> np.ndarray:
    """Weights of signals that explain returns best from their ICs and mutual ICs; soft-thresholded if l1 > 0."""
    if l1 == 0:
        return np.linalg.lstsq(mutual, ics, rcond=None)[0]
    w, step = np.zeros(len(ics)), 1 / np.linalg.norm(mutual, 2)
    for _ in range(rounds):
        w = w - step * (mutual @ w - ics)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
    return w


def lexicographic_best(fitness: np.ndarray, depths: np.ndarray, eps: float) -> int:
    """The shallowest of those within ``eps`` of the best."""
    near = np.flatnonzero(fitness >= fitness.max() - eps)
    return int(min(near, key=lambda i: (depths[i], -fitness[i], i)))


def tree_similarity(a: Node, b: Node) -> float:
    """Size of the largest shared subtree by the larger tree's size."""
    own = set(a.walk())
    return max((size(x) for x in b.walk() if x in own), default=0) / max(size(a), size(b))


# Descriptors on a grid.


def grid_bins(points: DataFrame, x: str, y: str, bounds: tuple[float, float, float, float], bins: int) -> DataFrame:
    """gx and gy of each point within the bounds; ``outside`` for the others, which are put on the border."""
    x0, x1, y0, y1 = bounds
    place = lambda c, a, b: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(c) - a) / (b - a) * bins))).cast("int")
    inside = F.col(x).between(x0, x1) & F.col(y).between(y0, y1)
    return points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"gx": place(x, x0, x1), "gy": place(y, y0, y1), "outside": ~inside})


def grid_summary(binned: DataFrame, bins: int) -> DataFrame:
    """Filled share of the grid, entropy of its occupation, points outside."""
    cells = binned.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.sum(F.col("outside").cast("long")).alias("out"))
    total = cells.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # bins * bins rows at most
    return total.agg((F.count("*") / float(bins * bins)).alias("coverage"), (-F.sum(F.col("p") * F.ln("p"))).alias("entropy"), F.sum("out").alias("n_outside"))


def generation_metrics(log: DataFrame, bins: list[str]) -> DataFrame:
    """Per (run, generation): bins seen for the first time, bins seen so far, evaluations and distinct formulas."""
    first = log.dropna(subset=bins).groupBy("run_id", *bins).agg(F.min("generation").alias("generation"))
    fresh = first.groupBy("run_id", "generation").agg(F.count("*").alias("new_bins"))
    size_ = log.groupBy("run_id", "generation").agg(F.count("*").alias("n"), F.countDistinct("formula").alias("n_formulas"))
    w = Window.partitionBy("run_id").orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)
    out = size_.join(fresh, ["run_id", "generation"], "left").na.fill(0, ["new_bins"])
    return out.withColumn("cumulative_bins", F.sum("new_bins").over(w))


def search_budget(log: DataFrame) -> DataFrame:
    """Per run: evaluations, distinct formulas, generations and the largest of them."""
    per = log.groupBy("run_id", "generation").agg(F.count("*").alias("n"))
    return log.groupBy("run_id").agg(F.count("*").alias("n_total"), F.countDistinct("formula").alias("n_unique"), F.countDistinct("generation").alias("n_generations")).join(per.groupBy("run_id").agg(F.max("n").alias("max_generation")), "run_id")


def first_occurrences(log: DataFrame) -> DataFrame:
    """The first row of each formula of a run, in order of (generation, place, rec_id)."""
    order = F.struct("generation", "idx_in_population", "rec_id")
    return log.filter("formula is not null").groupBy("run_id", "formula").agg(F.min_by("rec_id", order).alias("rec_id"))


def pool_check(pool: DataFrame, expected: int) -> DataFrame:
    return pool.agg(F.count("*").alias("n"), F.countDistinct("formula").alias("n_distinct"), (F.count("*") == expected).alias("full_size"), (F.count("formula") - F.countDistinct("formula")).alias("n_duplicates"), F.count(F.when(~F.col("train_sign").isin(-1, 1), 1)).alias("n_bad_signs"))


def rarefaction(values: np.ndarray, sizes: list[int], draws: int, seed: int) -> dict[int, tuple[float, float]]:
    """Mean and deviation of the best of k values, over seeded draws without replacement."""
    rng, out = np.random.default_rng(seed), {}
    for k in sizes:
        best = np.array([values[rng.choice(len(values), min(k, len(values)), replace=False)].max() for _ in range(draws)])
        out[k] = (float(best.mean()), float(best.std(ddof=1)) if draws > 1 else float("nan"))
    return out


def rolling_regression(frame: DataFrame, features: list[str], label: str, length: int) -> DataFrame:
    """Prediction of each date from an OLS fit on the ``length`` dates before it.

    A date's cross products are summed once; trailing sums of those small vectors replace scans of the panel, and
    only one row per date, whose width is the square of the features, is solved in Python.
    """
    names = ["__one", *features]
    rows = frame.withColumn("__one", F.lit(1.0)).dropna(subset=[*features, label])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"g{k}") for k, (a, b) in enumerate(pairs)] + [F.sum(F.col(a) * F.col(label)).alias(f"h{i}") for i, a in enumerate(names)]
    daily = rows.groupBy("datetime").agg(*sums)
    w = Window.orderBy("datetime").rowsBetween(-length, -1)  # one row per date
    cells = [f"g{k}" for k in range(len(pairs))] + [f"h{i}" for i in range(len(names))]
    moments = daily.select("datetime", *[F.sum(c).over(w).alias(c) for c in cells]).dropna()
    n = len(names)

    def solve(batches):
        for pdf in batches:
            beta = np.zeros((len(pdf), n))
            for r, v in enumerate(pdf[cells].to_numpy()):
                g = np.zeros((n, n))
                for k, (a, b) in enumerate(pairs):
                    i, j = names.index(a), names.index(b)
                    g[i, j] = g[j, i] = v[k]
                beta[r] = np.linalg.lstsq(g, v[len(pairs) :], rcond=None)[0]
            yield pdf[["datetime"]].assign(beta=list(beta))

    fitted = moments.mapInPandas(solve, "datetime timestamp, beta array<double>")
    score = F.col("beta")[0] + sum(F.col("beta")[i + 1] * F.col(f) for i, f in enumerate(features))
    return frame.join(fitted, "datetime").select("datetime", "instrument", score.alias("score"))


def evaluate_pool(panel: DataFrame, formulas: dict[str, str], label: str) -> DataFrame:
    """Daily ICs of one combined signal: the mean of the formulas' daily z-scores, to 12 places.

    Where the z-scores cancel each other on a day, the signal is constant and has no IC, not that of what rounding left.
    """
    frame = evaluate(panel, {**{k: f"CSZScore({t})" for k, t in formulas.items()}, "label": label})
    return daily_ic(frame.select("datetime", "instrument", F.round(sum(F.col(k) for k in formulas) / len(formulas), 12).alias("score"), "label"))
