"""Random formulas and their variation, for searches that the engine scores in batches."""

from __future__ import annotations

import numpy as np

from lodestrata.dsl.tree import Node, depth, size

#: Operators by the kinds of their arguments: s a series, n a number of rows.
SIGNATURES = {"Add": "ss", "Sub": "ss", "Mul": "ss", "Div": "ss", "Abs": "s", "Log": "s", "Greater": "ss", "Less": "ss", "Ref": "sn", "Delta": "sn", "Mean": "sn", "Std": "sn", "Max": "sn", "Min": "sn", "Rank": "sn", "Slope": "sn", "Corr": "ssn", "Cov": "ssn"}
FIELDS = ("open", "high", "low", "close", "volume", "vwap")
SPANS = (5, 10, 20, 30, 60)


def _leaf(rng: np.random.Generator) -> Node:
    if rng.random() < 0.15:
        return Node("number", value=round(float(rng.uniform(-3, 3)), 3))
    return Node("field", FIELDS[rng.integers(len(FIELDS))])


def grow(rng: np.random.Generator, deepest: int = 4) -> Node:
    """A random formula; leaves end it at random or at the deepest level."""
    if deepest <= 1 or rng.random() < 0.2:
        return _leaf(rng)
    name = list(SIGNATURES)[rng.integers(len(SIGNATURES))]
    return Node("call", name, args=tuple(Node("number", value=int(SPANS[rng.integers(len(SPANS))])) if k == "n" else grow(rng, deepest - 1) for k in SIGNATURES[name]))


def places(n: Node, path: tuple[int, ...] = ()) -> list[tuple[int, ...]]:
    """Ways to the series subtrees, the root first; numbers of rows aren't among them."""
    kinds = SIGNATURES.get(n.name, "s" * len(n.args))
    return [path, *(p for i, a in enumerate(n.args) if kinds[i] == "s" for p in places(a, (*path, i)))]


def at(n: Node, path: tuple[int, ...]) -> Node:
    for i in path:
        n = n.args[i]
    return n


def put(n: Node, path: tuple[int, ...], new: Node) -> Node:
    if not path:
        return new
    args = list(n.args)
    args[path[0]] = put(args[path[0]], path[1:], new)
    return Node(n.kind, n.name, n.value, tuple(args))


def _pick(n: Node, rng: np.random.Generator) -> tuple[int, ...]:
    every = places(n)
    return every[rng.integers(len(every))]


def crossover(a: Node, b: Node, rng: np.random.Generator) -> Node:
    """A subtree of the one in the place of a subtree of the other."""
    return put(a, _pick(a, rng), at(b, _pick(b, rng)))


def subtree_mutation(n: Node, rng: np.random.Generator) -> Node:
    return put(n, _pick(n, rng), grow(rng, 3))


def hoist_mutation(n: Node, rng: np.random.Generator) -> Node:
    """A subtree gives way to a part of itself, which never makes a formula larger."""
    path = _pick(n, rng)
    part = at(n, path)
    return put(n, path, at(part, _pick(part, rng)))


def point_mutation(n: Node, rng: np.random.Generator, rate: float = 0.1) -> Node:
    """Operators change to others of the same kind, leaves to other leaves, each with a probability."""
    if n.kind in ("field", "number"):
        return _leaf(rng) if rng.random() < rate else n
    name = n.name
    if rng.random() < rate:
        alike = [k for k, v in SIGNATURES.items() if v == SIGNATURES.get(name)]
        name = alike[rng.integers(len(alike))] if alike else name
    kinds = SIGNATURES.get(n.name, "s" * len(n.args))
    return Node("call", name, args=tuple(point_mutation(a, rng, rate) if k == "s" else a for a, k in zip(n.args, kinds)))


def tournament(fitness: np.ndarray, rng: np.random.Generator, entrants: int = 5) -> int:
    """The best of some drawn without replacement; the earlier of equals."""
    drawn = np.sort(rng.choice(len(fitness), min(entrants, len(fitness)), replace=False))
    return int(drawn[np.nanargmax(np.where(np.isnan(fitness[drawn]), -np.inf, fitness[drawn]))])


def next_generation(pool: list[Node], fitness: np.ndarray, rng: np.random.Generator, largest: int = 60) -> list[Node]:
    """As many formulas again, by tournaments; those that grow too large are replaced by their parents."""
    out = []
    for _ in pool:
        a = pool[tournament(fitness, rng)]
        u = rng.random()
        if u < 0.6:
            child = crossover(a, pool[tournament(fitness, rng)], rng)
        elif u < 0.75:
            child = subtree_mutation(a, rng)
        elif u < 0.85:
            child = hoist_mutation(a, rng)
        else:
            child = point_mutation(a, rng)
        out.append(child if size(child) <= largest and depth(child) <= 12 else a)
    return out
