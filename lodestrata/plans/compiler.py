"""Compiler of formulas to DataFrame plans.

All formulas of a batch share one plan: equal subtrees are computed once, windows of one nesting depth go into one
select, and windows over series need a single exchange by instrument, those over moments one by time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.dsl.tree import FormulaError, Node, extent, fields, fold_numbers, parse
from lodestrata.functions import registry
from lodestrata.functions.registry import Context
from lodestrata.operators import kernels

_BOOLEAN = frozenset("Gt Ge Lt Le Eq Ne And Or Not IsNull IsInf".split())
#: Arguments that stay as they are written.
_LITERAL = {"Quantile": {1, 2}, "Corr": {2}, "Cov": {2}, "DayCumsum": {1, 2}, "Rolling": {1, 2}, "ChangeInstrument": {0}, "Mask": {1}}


#: Cells of windows a row from which arrays beat sliding frames.
ARRAY_CELLS = 100


class _Plan:
    def __init__(self, df: DataFrame, context: Context):
        self.df, self.context = df, context
        self.columns = set(df.columns)
        self.level: dict[Node, int] = {}
        self.done: dict[Node, str] = {}

    def depth(self, n: Node) -> int:
        """How many windows lie on the way down."""
        if n not in self.level:
            inner = max((self.depth(a) for a in n.args), default=0)
            self.level[n] = inner + (n.kind == "call" and n.name in registry.WINDOWED)
        return self.level[n]

    def boolean(self, n: Node) -> bool:
        return n.kind == "call" and n.name in _BOOLEAN

    def number(self, n: Node) -> Column:
        c = self.column(n)
        return c.cast("double") if self.boolean(n) else c

    def column(self, n: Node) -> Column:
        if n in self.done:
            return F.col(self.done[n])
        if n.kind == "field":
            if n.name not in self.columns:
                raise FormulaError(f"unknown field ${n.name}")
            return F.col(n.name).cast("double")
        if n.kind == "number":
            return F.lit(float(n.value))
        if n.kind != "call":
            raise FormulaError(f"{n.value!r} can't stand alone")
        if n.name not in registry.SCALAR and n.name not in registry.WINDOWED:
            raise FormulaError(f"unknown operator {n.name}")
        build = registry.SCALAR.get(n.name) or registry.WINDOWED[n.name]
        literal = _LITERAL.get(n.name, {1} if n.name in registry.WINDOWED else set())  # the number of rows
        if n.name in ("And", "Or", "Not"):
            args = [self.column(a) if self.boolean(a) else self.column(a) != 0 for a in n.args]
        else:
            args = [a.value if i in literal else self.column(a) if n.name == "If" and i == 0 else self.number(a) for i, a in enumerate(n.args)]
        try:
            return build(self.context, *args)
        except TypeError as e:
            raise FormulaError(f"wrong arguments of {n.name}: {e}") from e

    def open(self, n: Node) -> Iterator[Node]:
        """The nodes that are still to be computed."""
        if n not in self.done:
            yield n
            for a in n.args:
                yield from self.open(a)

    def take_series(self, trees: dict[str, Node]) -> None:
        """Compute all largest subtrees over series in one pass of kernels, before any other window."""

        def parts(n: Node) -> Iterator[Node]:
            if n.kind == "call" and kernels.supported(n):
                if any(x.name in kernels.WINDOWS for x in n.walk()):
                    yield n
            else:
                for a in n.args:
                    yield from parts(a)

        named = {n: f"__s{i}" for i, n in enumerate(dict.fromkeys(p for t in trees.values() for p in parts(t)))}
        if named:
            inputs = sorted(set().union(*map(fields, named)))
            rows = self.df.select("*", *[F.col(c).cast("double").alias(f"__{c}") for c in inputs])
            self.df = _in_series(rows, {a: _renamed(n) for n, a in named.items()}, list(self.df.columns), self.context, [f"__{c}" for c in inputs])
            self.done |= named
            self.level |= dict.fromkeys(named, 0)

    def layer(self, depth: int, nodes: list[Node]) -> None:
        """Compute the windows of one depth that formulas of the batch use."""
        fresh = [n for n in dict.fromkeys(nodes) if n not in self.done]
        if fresh:
            named = {n: f"__w{depth}_{i}" for i, n in enumerate(fresh)}
            scanned = {n: a for n, a in named.items() if self.scanned(n)}
            inner = {n.args[0]: f"__a{depth}_{i}" for i, n in enumerate(scanned)}
            framed = {n: a for n, a in named.items() if n not in scanned}
            self.df = self.df.select("*", *[self.column(n).alias(a) for n, a in framed.items()], *[self.number(n).alias(a) for n, a in inner.items()])
            if scanned:
                self.df = self.scan({a: Node("call", "EMA" if n.name == "Mean" else n.name, None, (Node("field", inner[n.args[0]]), n.args[1])) for n, a in scanned.items()}, sorted(set(inner.values())))
            self.done |= named

    def scanned(self, n: Node) -> bool:
        """Windows that scan a series once as arrays instead of collecting every frame."""
        if self.context.strict or len(n.args) != 2 or n.args[1].kind != "number":
            return False
        return n.name in kernels.SCANNED and kernels.fixed(n) or n.name == "Mean" and 0 < n.args[1].value < 1

    def scan(self, trees: dict[str, Node], inputs: list[str]) -> DataFrame:
        """The rows with columns of kernels, in the exchange by series that their other windows need as well."""
        keys = [c for c in self.df.columns if c not in inputs]
        return _in_series(self.df, trees, keys, self.context, inputs)


def evaluate(panel: DataFrame, formulas: dict[str, str], context: Context = Context(), keep: tuple[str, ...] = (), start: int | None = None, end: int | None = None, engine: str = "auto") -> DataFrame:
    """Columns ``formulas`` (name to text) over a dense ``panel``, beside entity, order, time and ``keep``.

    start, end: places on the time axis that are wanted. The rows that windows need before and after them, which
    the formulas tell, are read as well and cut off at the end.

    engine: "sql" uses Spark's windows, "array" the kernels of ``operators.kernels``; "auto" takes the kernels for
    batches whose windows hold more than ARRAY_CELLS cells a row or scan their series, if they can express all
    formulas. Both give the same values.
    """
    trees = {name: fold_numbers(parse(text)) for name, text in formulas.items()}
    keys = [c for c in dict.fromkeys((context.entity, context.order, context.time, *keep)) if c in panel.columns]
    wanted = set().union(*(fields(t) for t in trees.values())) if trees else set()
    grouped = any(n.name.startswith("Relation") for t in trees.values() for n in t.walk())
    if missing := wanted - set(panel.columns):
        raise FormulaError(f"unknown fields {sorted(missing)}")
    df = panel.select(*dict.fromkeys([*keys, *sorted(wanted), *([context.group] if grouped else [])]))
    if start is not None or end is not None:
        left, right = (max(x) for x in zip(*(extent(t) for t in trees.values())))
        if start is not None and math.isfinite(left):
            df = df.filter(F.col(context.order) >= start - int(left))
        if end is not None and math.isfinite(right):
            df = df.filter(F.col(context.order) <= end + int(right))
    able = context == Context() and not grouped and all(map(kernels.supported, trees.values()))
    scans = any(n.kind == "call" and n.name in kernels.SCANNED for t in trees.values() for n in t.walk())
    if engine == "array" or engine == "auto" and able and (scans or kernels.cost(trees) > ARRAY_CELLS):
        if not able:
            raise FormulaError("a formula is beyond the array engine")
        return _cut(_by_arrays(df, trees, keys, context), context, start, end)
    plan = _Plan(df, context)
    if engine == "auto" and scans and not context.strict and not context.ieee:
        plan.take_series(trees)
    deepest = max((plan.depth(t) for t in trees.values()), default=0)
    for depth in range(1, deepest + 1):
        plan.layer(depth, [n for t in trees.values() for n in plan.open(t) if n.kind == "call" and n.name in registry.WINDOWED and plan.depth(n) == depth])
    return _cut(plan.df.select(*keys, *[plan.number(t).alias(name) for name, t in trees.items()]), context, start, end)


def _by_arrays(df: DataFrame, trees: dict[str, Node], keys: list[str], context: Context) -> DataFrame:
    wanted = sorted(set().union(*(fields(t) for t in trees.values())))
    rows = df.select(*keys, *[F.col(c).cast("double").alias(f"__{c}") for c in wanted])
    return _in_series(rows, {n: _renamed(t) for n, t in trees.items()}, keys, context, [f"__{c}" for c in wanted])


def _in_series(rows: DataFrame, trees: dict[str, Node], keys: list[str], context: Context, inputs: list[str]) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, context.entity).sortWithinPartitions(context.entity, context.order)
    schema = T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(n, T.DoubleType()) for n in trees)])
    return rows.mapInArrow(kernels.runner(trees, keys, context.entity, context.order, inputs), schema)


def _renamed(n: Node) -> Node:
    """Fields under names that no key has."""
    return Node(n.kind, f"__{n.name}" if n.kind == "field" else n.name, n.value, tuple(_renamed(a) for a in n.args))


def _cut(out: DataFrame, context: Context, start: int | None, end: int | None) -> DataFrame:
    if start is not None:
        out = out.filter(F.col(context.order) >= start)
    if end is not None:
        out = out.filter(F.col(context.order) <= end)
    return out
