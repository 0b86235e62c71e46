"""The arithmetic language of ``#expr``: precedence climbing over tokens, with the language's own ranks.

From the strongest: ``e`` between two operands (11); signs and ``^`` (10); not, abs, sin, cos, asin, acos, tan, atan, exp, ln, ceil, floor, trunc (9);
``* / div mod`` (8); ``+ -`` (6); round (5); comparisons (4); and (3); or (2). All infix operators group to the left, and a sign
binds before ``^``, so that -2^4 is 16.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import col

_TOKEN = re.compile(r"\s+|(\d+(?:\.\d+)?|\.\d+)|(>=|<=|<>|!=|[a-z]+|.)", re.I | re.S)
_CONSTANT = {"e": math.e, "pi": math.pi}


class ExpressionError(ValueError):
    pass


#: Fixed values of the language: operators by rank, those between two operands and those before one.
INFIX_RANKS = {11: "e", 10: "^", 8: "* / div mod", 6: "+ -", 5: "round", 4: "< > <= >= != <> =", 3: "and", 2: "or"}
PREFIX_RANKS = {10: "+ -", 9: "not abs sin cos asin acos tan atan exp ln ceil floor trunc"}

_INFIX = {name: rank for rank, names in INFIX_RANKS.items() for name in names.split()}
_PREFIX = {name: rank for rank, names in PREFIX_RANKS.items() for name in names.split()}


def _between(name: str, a, b):
    """The value of two operands; comparisons and logic give 1 or 0."""
    if name in "+-":
        return a + b if name == "+" else a - b
    if name in ("*", "/", "div"):
        return a * b if name == "*" else a / b
    if name == "mod":  # of the whole parts
        return int(a) % int(b)
    if name == "^":
        return math.pow(a, b)
    if name == "e":
        return a * 10**b
    if name == "round":
        return _rounded(a, int(b))
    if name in ("and", "or"):
        return int(bool(a) + bool(b) >= (2 if name == "and" else 1))
    order = (a > b) - (a < b)
    equal = a == b  # not the same as order == 0: nothing equals NaN
    return int({"=": equal, "!=": not equal, "<>": not equal, "<": order < 0, ">": order > 0, "<=": order < 0 or equal, ">=": order > 0 or equal}[name])


def _before(name: str, a):
    if name == "-":
        return -a
    if name == "not":
        return 0 if a else 1
    if name == "ln":
        return math.log(a)
    return a if name == "+" else abs(a) if name == "abs" else getattr(math, name)(a)


def _rounded(x, places: int):
    """To some places, without any half away from zero; a whole result is an integer."""
    if places:
        near = round(x, places)
    else:
        near = x if x == int(x) else math.copysign(math.floor(abs(x) + 0.5), x)
    return int(near) if near == int(near) else near


def _tokens(text: str) -> list[str | int | float]:
    out: list[str | int | float] = []
    for number, word in _TOKEN.findall(text):
        if number:
            out.append(float(number) if "." in number else int(number))
        elif word:
            out.append(word.lower())
    return out


def evaluate(text: str) -> int | float | str:
    """The value of an expression; an empty one has the empty text as value."""
    tokens = _tokens(text)
    if not tokens:
        return ""
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def operand():
        nonlocal at
        token = peek()
        if token is None:
            raise ExpressionError("an operand is missing")
        at += 1
        if not isinstance(token, str):
            return token
        if token == "(":
            value = climb(0)
            if peek() != ")":
                raise ExpressionError("unbalanced parenthesis")
            at += 1
            return value
        if token in _CONSTANT:
            return _CONSTANT[token]
        if token in _PREFIX:
            return _before(token, climb(_PREFIX[token] + 1))
        raise ExpressionError(f"unexpected {token}" if token in _INFIX or token == ")" else f"unknown operator: {token}")

    def climb(least: int):
        nonlocal at
        left = operand()
        while (token := peek()) is not None and token != ")":
            if not isinstance(token, str) or token == "(" or token in _CONSTANT and token not in _INFIX:
                raise ExpressionError("expected operator")
            if token not in _INFIX:
                raise ExpressionError(f"unexpected {token}" if token in _PREFIX else f"unknown operator: {token}")
            rank = _INFIX[token]
            if rank < least:
                break
            at += 1
            left = _between(token, left, climb(rank + 1))
        return left

    value = climb(0)
    if at < len(tokens):
        raise ExpressionError("unbalanced parenthesis")
    return value


@lru_cache(maxsize=1 << 16)
def expr(text: str) -> str:
    """The result as text: whole numbers below 1e14 without a point, others in the shortest form with E+ or E-; errors as markup."""
    text = text.strip()
    if not text:
        return ""
    try:
        value = evaluate(text)
        if int(value) == value and abs(value) < 1e14:
            return str(int(value))
        shown = str(float(value))
    except Exception as error:  # division by zero, domains, overflow: all of them are the expression's fault
        return f'<strong class="error">{error}</strong>'
    if "e" in shown:
        mantissa, exponent = shown.split("e")
        return f"{float(mantissa)}E{'' if int(exponent) < 0 else '+'}{int(exponent)}"
    return shown


def truth(text: str) -> bool | str:
    """Whether an expression is true; error markup if it has no value."""
    shown = expr(text)
    return shown if "error" in shown else bool(shown and float(shown.replace("E+", "e").replace("E-", "e-")))


@F.arrow_udf(StringType())
def _expr_udf(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else expr(t) for t in texts.to_pylist()], pa.string())


def expr_column(s):
    """``#expr`` over a column, in Arrow batches; equal texts of a worker are evaluated once."""
    return _expr_udf(col(s))


def ifexpr_column(s, yes, no):
    shown = expr_column(s)
    return F.when(F.contains(shown, F.lit('class="error"')), shown).when((shown == "") | (shown == "0"), col(no)).otherwise(col(yes))


def roman(n: int) -> str:
    values = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
    out = ""
    for value, letters in values:
        out += letters * (n // value)
        n %= value
    return out


def roman_column(n):
    """Roman numerals natively: digit by digit."""
    n = col(n).cast("int")
    digits = [["", *(one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)] for one, five, ten in (("I", "V", "X"), ("X", "L", "C"), ("C", "D", "M"))]
    parts = [F.repeat(F.lit("M"), F.floor(n / 1000).cast("int"))]
    for power, row in reversed(list(enumerate(digits))):
        parts.append(F.element_at(F.array(*[F.lit(x) for x in row]), (F.floor(n / 10**power) % 10 + 1).cast("int")))
    return F.concat(*parts)
