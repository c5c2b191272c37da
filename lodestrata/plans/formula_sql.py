"""Formulas as SQL of another engine: what the queries of whole catalogs are compared with.

Each depth of windows becomes one subquery, as window functions can't be nested in SQL.
"""

from __future__ import annotations

from lodestrata.dsl.tree import Node, fold_numbers, parse

_INFIX = {"Add": "+", "Sub": "-", "Mul": "*"}
_COMPARED = {"Gt": ">", "Ge": ">=", "Lt": "<", "Le": "<=", "Eq": "=", "Ne": "<>"}
_WINDOWED = frozenset("Ref Mean Sum Std Min Max Slope Resi Rsquare Quantile Rank IdxMax IdxMin Corr".split())
#: Standard deviation up to which a window counts as constant.
_STILL = "2e-5"


class _Writer:
    def __init__(self):
        self.named: dict[Node, str] = {}
        self.levels: list[dict[str, str]] = []
        self.frames: dict[int, str] = {}

    def depth(self, n: Node) -> int:
        return max(map(self.depth, n.args), default=0) + (n.kind == "call" and n.name in _WINDOWED)

    def frame(self, n: float) -> str:
        self.frames[int(n)] = f"PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN {int(n) - 1} PRECEDING AND CURRENT ROW"
        return f"w{int(n)}"

    def value(self, n: Node) -> str:
        """A number; comparisons count as 1 and 0."""
        x = self.text(n)
        return f"({x})::INT::DOUBLE" if n.kind == "call" and n.name in _COMPARED else x

    def text(self, n: Node) -> str:
        if n.kind == "number":
            return f"{n.value!r}::DOUBLE"
        if n.kind == "field":
            return n.name
        if n.name in _WINDOWED:
            return self.place(n)
        args = [self.value(a) for a in n.args]
        if n.name in _INFIX:
            return f"({args[0]} {_INFIX[n.name]} {args[1]})"
        if n.name in _COMPARED:
            # a missing value is unequal to any and neither larger nor smaller
            return f"coalesce({args[0]} {_COMPARED[n.name]} {args[1]}, {str(n.name == 'Ne').lower()})"
        if n.name == "Div":
            return f"({args[0]} / nullif({args[1]}, 0))"
        if n.name == "Abs":
            return f"abs({args[0]})"
        if n.name == "Log":
            return f"CASE WHEN {args[0]} > 0 THEN ln(CASE WHEN {args[0]} > 0 THEN {args[0]} END) END"
        if n.name in ("Greater", "Less"):
            return f"CASE WHEN {args[0]} IS NOT NULL AND {args[1]} IS NOT NULL THEN {'greatest' if n.name == 'Greater' else 'least'}({args[0]}, {args[1]}) END"
        raise ValueError(f"no SQL for {n.name}")

    def place(self, n: Node) -> str:
        """The column of a window, in the subquery of its depth."""
        if n not in self.named:
            level = self.depth(n)
            sql = self.window(n)
            while len(self.levels) < level:
                self.levels.append({})
            self.named[n] = f"c{level}_{len(self.levels[level - 1])}"
            self.levels[level - 1][self.named[n]] = sql
        return self.named[n]

    def window(self, n: Node) -> str:
        x = self.value(n.args[0])
        if n.name == "Ref":
            return f"lag({x}, {int(n.args[1].value)}) OVER (PARTITION BY instrument ORDER BY cal_idx)"
        w = self.frame(n.args[2 if n.name == "Corr" else 1].value)
        count, held = f"count({x}) OVER {w}", f"list({x}) OVER {w}"
        if n.name in ("Mean", "Sum", "Min", "Max"):
            return f"{'avg' if n.name == 'Mean' else n.name.lower()}({x}) OVER {w}"
        if n.name == "Std":
            return f"CASE WHEN {count} >= 2 THEN stddev_samp({x}) OVER {w} END"
        if n.name == "Quantile":
            return f"quantile_cont({x}, {n.args[2].value}) OVER {w}"
        if n.name == "Slope":
            return f"CASE WHEN {count} >= 2 THEN regr_slope({x}, cal_idx) OVER {w} END"
        if n.name == "Resi":
            at = f"CASE WHEN {x} IS NOT NULL THEN cal_idx END"
            return f"CASE WHEN {count} >= 2 THEN {x} - (avg({x}) OVER {w} + (regr_slope({x}, cal_idx) OVER {w}) * (cal_idx - avg({at}) OVER {w})) END"
        if n.name == "Rsquare":
            return f"CASE WHEN {count} >= 2 AND stddev_samp({x}) OVER {w} > {_STILL} THEN pow(corr({x}, cal_idx::DOUBLE) OVER {w}, 2) END"
        if n.name == "Rank":
            below = f"len(list_filter({held}, lambda v: v < {x}))"
            equal = f"len(list_filter({held}, lambda v: v = {x}))"
            return f"CASE WHEN {x} IS NOT NULL THEN ({below} + ({equal} + 1) / 2.0) / {count} END"
        if n.name in ("IdxMax", "IdxMin"):
            sign = "" if n.name == "IdxMax" else "-"
            filled = f"list(coalesce({sign}({x}), 'inf'::DOUBLE)) OVER {w}"
            return f"CASE WHEN {count} > 0 THEN list_position({filled}, list_max({filled}))::DOUBLE END"
        y = self.value(n.args[1])
        a, b = (f"CASE WHEN {v} IS NOT NULL THEN {u} END" for u, v in ((x, y), (y, x)))
        moves = " AND ".join(f"stddev_samp({v}) OVER {w} > {_STILL}" for v in (x, y))
        product = f"(stddev_samp({a}) OVER {w} * stddev_samp({b}) OVER {w})"
        return f"CASE WHEN count({a}) OVER {w} >= 2 AND {moves} AND {product} > 0 THEN covar_samp({x}, {y}) OVER {w} / {product} END"


def formulas_sql(formulas: dict[str, str], source: str, places: int) -> str:
    """SELECT of all formulas over ``source`` (instrument, cal_idx, fields), cut to so many decimal places; beyond 1e10 to billions."""
    writer = _Writer()
    out = {name: writer.value(fold_numbers(parse(text))) for name, text in formulas.items()}
    cut = lambda x: f"CASE WHEN abs({x}) < 1e10 THEN floor(({x}) * 1e{places} + 0.4999) / 1e{places} ELSE floor(({x}) / 1e9 + 0.4999) * 1e9 END + 0.0"
    for level in writer.levels:
        used = {f"w{n}": w for n, w in writer.frames.items() if any(f" w{n}" in sql for sql in level.values())}
        clause = f" WINDOW {', '.join(f'{k} AS ({v})' for k, v in used.items())}" if used else ""
        source = f"(SELECT *, {', '.join(f'{sql} AS {c}' for c, sql in level.items())} FROM {source}{clause})"
    return "SELECT instrument, cal_idx, " + ", ".join(f'{cut(chr(34) + name + chr(34))} AS "{name}"' for name in out) + f" FROM (SELECT instrument, cal_idx, {', '.join(f'{sql} AS {chr(34)}{name}{chr(34)}' for name, sql in out.items())} FROM {source})"
