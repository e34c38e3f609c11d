"""The formula language of combined metrics and of channel recipes, as column expressions.

Numbers, names, + - * /, unary minus, parentheses and, for rows, ``^`` and a few functions. Division follows
IEEE 754: by zero it gives an infinity or NaN.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions.coerce import NAN

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*(?:::\w+)?)|(.))")
INF = float("inf")


class FormulaError(ValueError):
    """A formula that cannot be read."""


def divide(a: Column, b: Column) -> Column:
    """IEEE 754 division of doubles."""
    zero = F.when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, zero).otherwise(F.try_divide(a, b))


#: What row formulas may call.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "min": lambda *x: F.least(*x), "max": lambda *x: F.greatest(*x), "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"),
    "round": lambda x: F.round(x), "math::abs": F.abs, "math::sqrt": F.sqrt, "math::ln": lambda x: F.when(x > 0, F.log(x)).otherwise(NAN), "math::exp": F.exp,
}


def parse(source: str, name: Callable[[str], Column], functions: dict[str, Callable[..., Column]] | None = None, cast: str = "double") -> Column:
    """The column of a formula; ``name`` gives the column of a name, or raises FormulaError."""
    tokens = [m.groups() for m in _TOKEN.finditer(source.strip())]
    at = 0
    functions = functions or {}

    def peek() -> str | None:
        return tokens[at][2] if at < len(tokens) else None

    def take(sign: str) -> bool:
        nonlocal at
        if peek() == sign:
            at += 1
            return True
        return False

    def factor() -> Column:
        nonlocal at
        if take("-"):
            return -factor()
        if take("+"):
            return factor()
        if take("("):
            value = total()
            if not take(")"):
                raise FormulaError(f"a parenthesis stays open in {source!r}")
            return value
        if at >= len(tokens) or tokens[at][2] is not None:
            raise FormulaError(f"a value is missing in {source!r}")
        number, word, _ = tokens[at]
        at += 1
        if number is not None:
            return F.lit(float(number)).cast(cast)
        if word in functions and take("("):
            args = [total()]
            while take(","):
                args.append(total())
            if not take(")"):
                raise FormulaError(f"a parenthesis stays open in {source!r}")
            return functions[word](*args)
        return name(word)

    def power() -> Column:
        base = factor()
        return F.pow(base, power()) if functions and take("^") else base

    def product() -> Column:
        value = power()
        while True:
            if take("*"):
                value = value * power()
            elif take("/"):
                value = divide(value, power())
            elif functions and take("%"):
                value = F.try_mod(value, power())
            else:
                return value

    def total() -> Column:
        value = product()
        while True:
            if take("+"):
                value = value + product()
            elif take("-"):
                value = value - product()
            else:
                return value

    value = total()
    if at < len(tokens):
        raise FormulaError(f"something is left over in {source!r}")
    return value
