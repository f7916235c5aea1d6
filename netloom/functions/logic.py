"""A small Boolean language, compiled to Spark columns or SQL text.

Operators by rising strength: ``|`` or ``+``; ``^``; ``&`` or ``*``; ``!``; parentheses. Binary ones associate to the
left. Constants are 0 and 1. A trailing blank is an error, as is an empty text. Every symbol must have a value: a null
input raises instead of passing for unknown.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*|[01!&|^+*()])")
_LEVELS = ({"|": "or", "+": "or"}, {"^": "xor"}, {"&": "and", "*": "and"})


class LogicExpressionError(ValueError):
    """A text that is no expression."""


@dataclass(frozen=True)
class Node:
    """op: const, symbol, not, and, xor, or; value of a leaf; parts of the rest."""

    op: str
    value: str = ""
    parts: tuple[Node, ...] = ()

    @property
    def symbols(self) -> frozenset[str]:
        if self.op == "symbol":
            return frozenset([self.value])
        return frozenset().union(*(p.symbols for p in self.parts))

    def evaluate(self, values: dict[str, bool]) -> bool:
        """Two-valued result; KeyError for a symbol without a value. All parts are evaluated."""
        match self.op:
            case "const":
                return self.value == "1"
            case "symbol":
                return bool(values[self.value])
            case "not":
                return not self.parts[0].evaluate(values)
        a, b = (p.evaluate(values) for p in self.parts)
        return {"and": a and b, "or": a or b, "xor": a != b}[self.op]

    def column(self, symbol) -> Column:
        """A Spark column; ``symbol(name)`` gives the column of a symbol."""
        match self.op:
            case "const":
                return F.lit(self.value == "1")
            case "symbol":
                return symbol(self.value)
            case "not":
                return ~self.parts[0].column(symbol)
        a, b = (p.column(symbol) for p in self.parts)
        return {"and": a & b, "or": a | b, "xor": a != b}[self.op]

    def sql(self, symbol=lambda name: name) -> str:
        """SQL text, fully parenthesised."""
        match self.op:
            case "const":
                return "TRUE" if self.value == "1" else "FALSE"
            case "symbol":
                return symbol(self.value)
            case "not":
                return f"(NOT {self.parts[0].sql(symbol)})"
        a, b = (p.sql(symbol) for p in self.parts)
        return f"({a} {({'and': 'AND', 'or': 'OR', 'xor': '<>'})[self.op]} {b})"


def tokens(text: str) -> list[str]:
    found, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise LogicExpressionError(f"no token at {at} of {text!r}")
        found.append(m[1])
        at = m.end()
    return found


@lru_cache(maxsize=None)
def parse(text: str) -> Node:
    """The expression tree of ``text``."""
    rest = tokens(text)[::-1]

    def take() -> str:
        if not rest:
            raise LogicExpressionError(f"{text!r} ends early")
        return rest.pop()

    def unit() -> Node:
        t = take()
        if t == "!":
            return Node("not", parts=(unit(),))
        if t == "(":
            inner = level(0)
            if take() != ")":
                raise LogicExpressionError(f"{text!r} lacks a parenthesis")
            return inner
        if t in "01":
            return Node("const", t)
        if t[0].isalpha() or t[0] == "_":
            return Node("symbol", t)
        raise LogicExpressionError(f"{t!r} out of place in {text!r}")

    def level(n: int) -> Node:
        if n == len(_LEVELS):
            return unit()
        left = level(n + 1)
        while rest and rest[-1] in _LEVELS[n]:
            op = _LEVELS[n][rest.pop()]
            left = Node(op, parts=(left, level(n + 1)))
        return left

    tree = level(0)
    if rest:
        raise LogicExpressionError(f"{rest[-1]!r} is left over in {text!r}")
    return tree


def known(name: str) -> Column:
    """A boolean column that raises where it is null."""
    return F.coalesce(F.col(f"`{name}`"), F.raise_error(F.lit(f"no value for {name}")).cast("boolean"))


def compiled(text: str, symbol=known) -> Column:
    """``text`` as a Spark column over columns of the symbols' names."""
    return parse(text).column(symbol)
