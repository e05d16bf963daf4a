"""Arithmetic expressions typed by a user, as Column expressions: checked by a grammar, never evaluated as code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|([A-Za-z_]\w*)|([-+*/()]))")


def expression(text: str, columns: set[str]) -> Column:
    """A Column for + - * / and brackets over numbers and the named columns; division by zero is null.

    Raises ValueError for anything else.
    """
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected character at {at}")
        tokens.append(m.group(0).strip())
        at = m.end()
    tokens.append("")

    def unary(k: int) -> tuple[Column, int]:
        t = tokens[k]
        if t == "-":
            value, k = unary(k + 1)
            return -value, k
        if t == "(":
            value, k = sums(k + 1)
            if tokens[k] != ")":
                raise ValueError("a bracket isn't closed")
            return value, k + 1
        if re.fullmatch(r"[\d.]+", t or "x"):
            return F.lit(float(t)), k + 1
        if t in columns:
            return F.col(t).cast("double"), k + 1
        raise ValueError(f"unexpected {t or 'end'}")

    def products(k: int) -> tuple[Column, int]:
        value, k = unary(k)
        while tokens[k] in ("*", "/"):
            other, n = unary(k + 1)
            value, k = (value * other if tokens[k] == "*" else F.try_divide(value, other)), n
        return value, k

    def sums(k: int) -> tuple[Column, int]:
        value, k = products(k)
        while tokens[k] in ("+", "-"):
            other, n = products(k + 1)
            value, k = (value + other if tokens[k] == "+" else value - other), n
        return value, k

    value, k = sums(0)
    if tokens[k]:
        raise ValueError(f"unexpected {tokens[k]}")
    return value
