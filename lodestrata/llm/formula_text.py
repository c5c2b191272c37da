"""Reading of formulas in call or infix notation: their tokens and a form free of writing habits."""

from __future__ import annotations

import re
import unicodedata

import xxhash

#: Names, $fields and unsigned numbers.
WORDS = re.compile(r"\$?[^\W\d]\w*|\d+(?:\.\d+)?|\.\d+")
_PIECES = re.compile(r"[()\[\]{},;|]|\$?[^\W\d]\w*|\d+(?:\.\d+)?(?:e[-+]?\d+)?|\.\d+(?:e[-+]?\d+)?|\*\*|//|[<>=!]=|[-+*/^%<>=!&~@:?]")
_OPEN, _CLOSE, _SEPARATORS = frozenset("([{"), frozenset(")]}"), frozenset(",;|")
_LEVEL = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "%": 2, "**": 4, "^": 4, **dict.fromkeys(["<", ">", "=", "<=", ">=", "==", "!=", "&", "!", "@", ":", "?", "~"], 0)}
#: How firmly a sign before its operand holds: more than a product, less than a power.
_SIGN = 3
_SIGNS = frozenset("+-~!")
#: Operators and functions whose two operands may change places.
COMMUTATIVE = frozenset(["+", "*", "add", "mul", "greater", "less"])
_TAIL = re.compile(r"[^\w)\]}]+$")
_HEAD = re.compile(r"^[^\w(\[{$+\-.~!]+")
#: Longer parts of a canonical form are written as their hash, so that deep formulas take linear time.
_LONGEST = 512


def _readable(formula: str) -> str:
    """Lower case, compatible forms of characters, nothing invisible."""
    if formula.isascii():
        return formula.lower()
    formula = unicodedata.normalize("NFKC", formula).replace("−", "-").replace("×", "*").replace("÷", "/")
    return "".join(c for c in formula if unicodedata.category(c) != "Cf").lower()


def pieces(formula: str) -> list[str]:
    """Names, numbers, operators, brackets and separators in order; marks at the ends mean nothing."""
    return _PIECES.findall(_HEAD.sub("", _TAIL.sub("", _readable(formula))))


def words(formula: str) -> list[str]:
    return WORDS.findall(_readable(formula))


def _joined(op: str, parts: list[str]) -> str:
    if len(parts) == 2 and op in COMMUTATIVE and parts[1] < parts[0]:
        parts = parts[::-1]
    text = f"({op} {' '.join(parts)})"
    return text if len(text) <= _LONGEST else "#" + xxhash.xxh3_128_hexdigest(text)


def _reduce(values: list[str], ops: list[tuple[int, str]], least: int) -> None:
    """Apply the waiting operators that hold at least that firmly."""
    while ops and ops[-1][0] >= least:
        level, op = ops.pop()
        right = values.pop()
        values.append(_joined(op, [right] if level == _SIGN else [values.pop(), right]))


def _read(found: list[str]) -> str | None:
    """The canonical form of readable pieces, by stacks of its own, so that no depth is too deep; None if unreadable."""
    outer: list[tuple[str, list[str], list[str], list[tuple[int, str]]]] = []
    name, args, values, ops = "", [], [], []
    operand_next, skip = True, False
    last = len(found) - 1
    for i, piece in enumerate(found):
        if skip:
            skip = False
            continue
        if operand_next:
            if piece in _OPEN:
                outer.append((name, args, values, ops))
                name, args, values, ops = "", [], [], []
            elif piece in _SIGNS:
                ops.append((_SIGN, piece))
            elif piece in _CLOSE or piece in _SEPARATORS:
                if not outer or ops or values:
                    return None
                if piece in _CLOSE:
                    node = args[0] if len(args) == 1 and not name else _joined(name, args)
                    name, args, values, ops = outer.pop()
                    values.append(node)
                    operand_next = False
            elif piece in _LEVEL:
                return None
            elif i < last and found[i + 1] in _OPEN and not (piece[0].isdigit() or piece[0] == "."):
                outer.append((name, args, values, ops))
                name, args, values, ops = piece, [], [], []
                skip = True
            else:
                values.append(piece)
                operand_next = False
        elif piece in _CLOSE or piece in _SEPARATORS:
            if not outer:
                return None
            _reduce(values, ops, 0)
            args.append(values.pop())
            if piece in _CLOSE:
                node = args[0] if len(args) == 1 and not name else _joined(name, args)
                name, args, values, ops = outer.pop()
                values.append(node)
            else:
                operand_next = True
        elif piece in _LEVEL:
            level = _LEVEL[piece]
            _reduce(values, ops, level + 1 if level == 4 else level)
            ops.append((level, piece))
            operand_next = True
        else:
            return None
    if outer or operand_next:
        return None
    _reduce(values, ops, 0)
    return values[0]


def canonical(formula: str) -> str:
    """A form that two formulas share just when they differ in spacing, case, meaningless punctuation or operand order.

    Text that can't be read as a formula keeps its pieces in their order, brackets and separators in one shape.
    """
    found = pieces(formula)
    form = _read(found)
    if form is not None:
        return form
    return "? " + " ".join("(" if p in _OPEN else ")" if p in _CLOSE else "," if p in _SEPARATORS else p for p in found)
