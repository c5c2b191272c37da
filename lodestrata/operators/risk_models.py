"""Covariance estimators and allocations on small matrices, whose moments come from one aggregation of the cluster."""

from __future__ import annotations

import numpy as np


def factor_part(cov: np.ndarray, factors: int) -> np.ndarray:
    """What the largest principal components explain."""
    if factors <= 0:
        return np.zeros_like(cov)
    values, vectors = np.linalg.eigh(cov)
    top = vectors[:, -factors:]
    return (top * np.clip(values[-factors:], 0, None)) @ top.T


def thresholded(corr: np.ndarray, level: float, method: str = "soft") -> np.ndarray:
    """Off-diagonal correlations cut at a level: hard, soft, or scad with the usual a = 3.7."""
    size, sign, a = np.abs(corr), np.sign(corr), 3.7
    soft = sign * np.maximum(size - level, 0)
    if method == "hard":
        out = np.where(size > level, corr, 0.0)
    elif method == "soft":
        out = soft
    elif method == "scad":
        middle = ((a - 1) * corr - sign * a * level) / (a - 2)
        out = np.where(size < 2 * level, soft, np.where(size < a * level, middle, corr))
    else:
        raise ValueError(f"unknown method {method!r}")
    np.fill_diagonal(out, 1.0)
    return out


def poet(cov: np.ndarray, n_rows: int, factors: int = 0, strength: float = 1.0, method: str = "soft") -> np.ndarray:
    """Principal components plus a sparse remainder, from the covariance of centred rows."""
    p = len(cov)
    low = factor_part(cov, factors)
    rest = cov - low
    sd = np.sqrt(np.clip(np.diag(rest), 1e-300, None))
    rate = np.sqrt(np.log(p) / n_rows) + (1 / np.sqrt(p) if factors > 0 else 0.0)
    return low + thresholded(rest / np.outer(sd, sd), strength * rate, method) * np.outer(sd, sd)


def structured(cov: np.ndarray, factors: int) -> np.ndarray:
    """Principal components plus a diagonal."""
    low = factor_part(cov, factors)
    return low + np.diag(np.clip(np.diag(cov - low), 0, None))


def box_simplex(v: np.ndarray, low: np.ndarray, high: np.ndarray, total: float = 1.0) -> np.ndarray:
    """The nearest weights with bounds and a sum, by bisection on the shift."""
    if low.sum() > total + 1e-12 or high.sum() < total - 1e-12:
        raise ValueError("bounds and sum don't meet")
    a, b = (low - v).min() - 1, (high - v).max() + 1
    for _ in range(100):
        mid = (a + b) / 2
        if np.clip(v + mid, low, high).sum() < total:
            a = mid
        else:
            b = mid
    return np.clip(v + (a + b) / 2, low, high)


def enhanced_index(score: np.ndarray, cov: np.ndarray, bench: np.ndarray, aversion: float = 1.0, deviation: float = 0.01, now: np.ndarray | None = None, turnover: float | None = None, rounds: int = 2000) -> np.ndarray:
    """Long-only weights near a benchmark that trade score against tracking variance.

    Weights stay within ``deviation`` of the benchmark; with ``now`` the step from it is shortened to the turnover.
    """
    low, high = np.maximum(bench - deviation, 0), np.minimum(bench + deviation, 1)
    w, step = bench.copy(), 1 / (2 * aversion * np.linalg.norm(cov, 2) + 1e-12)
    for _ in range(rounds):
        w = box_simplex(w + step * (score - 2 * aversion * cov @ (w - bench)), low, high)
    if now is not None and turnover is not None and (moved := np.abs(w - now).sum()) > turnover:
        w = now + (w - now) * turnover / moved
    return w


def soft_topk(held: dict[str, float], score: dict[str, float], topk: int, most_sold: float, method: str = "first_fill") -> dict[str, float]:
    """Next weights: names beyond the best ``topk`` give up at most ``most_sold`` each, the best ones take it.

    first_fill raises them in order of score to an equal share, average_fill deals out evenly.
    """
    best = sorted(score, key=lambda i: (-score[i], i))[:topk]
    if not held:
        return {i: 1 / topk for i in best}
    sold = {i: min(most_sold, w) for i, w in held.items() if i not in best}
    out = {i: w - sold.get(i, 0.0) for i, w in held.items()}
    free = sum(sold.values())
    for i in best:
        have = out.get(i, 0.0)
        add = free / len(best) if method == "average_fill" else min(max(1 / topk - have, 0.0), free)
        out[i] = have + add
        if method == "first_fill":
            free -= add
    return out


def target_orders(target: dict[str, float], held: dict[str, float], price: dict[str, float], cash: float, unit: float = 100.0) -> list[tuple[str, float]]:
    """Signed amounts that lead from held amounts to target weights of held value and cash: sales first, whole lots but for full exits."""
    value = cash + sum(n * price[i] for i, n in held.items() if i in price)
    sells, buys = [], []
    for i in sorted(set(target) | set(held)):
        if i not in price:
            continue
        diff = target.get(i, 0.0) * value / price[i] - held.get(i, 0.0)
        if target.get(i, 0.0) == 0.0:
            diff = -held.get(i, 0.0)
        else:
            diff = np.sign(diff) * (abs(diff) + 0.1) // unit * unit if diff > 0 else -((-diff + 0.1) // unit * unit)
        if diff:
            (sells if diff < 0 else buys).append((i, float(diff)))
    return sells + buys
