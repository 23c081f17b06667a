"""A small expression language, in infix, prefix or postfix notation, compiled to Spark columns.

The parsed form is a nested tuple (operator, left, right), a number, or a name, which is a column. Integer division
and remainder truncate; division by zero gives null where the value is a number.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(0x[0-9A-Fa-f]+|\d+\.\d*|\.\d+|\d+|[A-Za-z_]\w*|[()+\-*/%])")
PRECEDENCE = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2}


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = re.sub(r"(#|//).*", "", text).rstrip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"cannot read {text[at:]!r}")
        out.append(found[1])
        at = found.end()
    return out


def _value(token: str):
    if token.startswith("0x"):
        return int(token, 16)
    if re.fullmatch(r"\d+", token):
        return int(token)
    return float(token) if re.match(r"[\d.]", token) else token


def _infix(rest: list[str], least: int = 0):
    token = rest.pop(0)
    if token == "(":
        left = _infix(rest)
        rest.pop(0)
    elif token == "-":
        left = ("-", 0, _infix(rest, 3))
    else:
        left = _value(token)
    while rest and rest[0] in PRECEDENCE and PRECEDENCE[rest[0]] > least:
        operator = rest.pop(0)
        left = (operator, left, _infix(rest, PRECEDENCE[operator]))
    return left


def _prefix(rest: list[str]):
    token = rest.pop(0)
    if token in "()":
        return _prefix(rest)
    return (token, _prefix(rest), _prefix(rest)) if token in PRECEDENCE else _value(token)


def parse(text: str, notation: str = "postfix"):
    found = tokens(text)
    if notation == "infix":
        return _infix(found)
    if notation == "prefix":
        return _prefix([t for t in found if t not in "()"])
    stack: list = []
    for token in found:
        if token in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append((token, left, right))
        else:
            stack.append(_value(token))
    if len(stack) != 1:
        raise ValueError("operands are left over")
    return stack[0]


def to_postfix(tree) -> list[str]:
    if isinstance(tree, tuple):
        return [*to_postfix(tree[1]), *to_postfix(tree[2]), tree[0]]
    return [str(tree)]


def column(tree, integers: bool = True) -> Column:
    """The parsed expression as a column; with ``integers`` names are whole numbers and ``/`` truncates."""
    if not isinstance(tree, tuple):
        return F.col(tree) if isinstance(tree, str) else F.lit(tree)
    operator, left, right = tree[0], column(tree[1], integers), column(tree[2], integers)
    if operator == "+":
        return left + right
    if operator == "-":
        return left - right
    if operator == "*":
        return left * right
    divisor = F.when(right != 0, right)
    if operator == "%":
        return left % divisor
    whole = F.try_divide(left - left % divisor, divisor).cast("long")
    return whole if integers else F.try_divide(left, divisor)
