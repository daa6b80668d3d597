"""Formulas of correction payloads, compiled to columns."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.ieee import divide
from eventloom.spec.expr import SpecError

_TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>[-+*/^(),\[\]]))")
_ONE: dict[str, Callable[[Column], Column]] = {
    "sqrt": F.sqrt, "log": F.log, "log10": F.log10, "exp": F.exp, "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan,
}
_TWO: dict[str, Callable[[Column, Column], Column]] = {"pow": F.pow, "min": F.least, "max": F.greatest}
_PLACE = {"x": 0, "y": 1, "z": 2, "t": 3}


def compile_formula(text: str, names: list[str], values: list[Column], parameters: list[float] = ()) -> Column:
    """names and values: the variables in order, which x, y, z, t and x[i] also mean; [i] and p[i] are parameters."""
    text = text.replace("TMath::", "")
    tokens, at = [], 0
    while text[at:].strip():
        if not (found := _TOKEN.match(text, at)):
            raise SpecError("InvalidExpression", text, f"cannot read {text[at:]!r}")
        tokens.append((found.lastgroup, found[found.lastgroup]))
        at = found.end()
    at = 0

    def peek() -> str | None:
        return tokens[at][1] if at < len(tokens) else None

    def take(wanted: str | None = None) -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens) or wanted and peek() != wanted:
            raise SpecError("InvalidExpression", text, f"expected {wanted or 'more'}")
        at += 1
        return tokens[at - 1]

    def variable(i: int) -> Column:
        if not 0 <= i < len(values):
            raise SpecError("InvalidExpression", text, f"no variable {i}")
        return values[i].cast("double")

    def parameter() -> Column:
        take("[")
        i = int(take()[1])
        take("]")
        if i >= len(parameters):
            raise SpecError("InvalidExpression", text, f"no parameter {i}")
        return F.lit(float(parameters[i]))

    def atom() -> Column:
        if peek() == "[":
            return parameter()
        kind, value = take()
        if kind == "num":
            return F.lit(float(value))
        if value == "(":
            inner = total()
            take(")")
            return inner
        if kind != "name":
            raise SpecError("InvalidExpression", text, f"did not expect {value!r}")
        key = value.lower()
        if peek() == "(":
            take("(")
            args = [total()]
            while peek() == ",":
                take()
                args.append(total())
            take(")")
            if key in _ONE and len(args) == 1:
                return _ONE[key](args[0])
            if key in _TWO and len(args) == 2:
                return _TWO[key](*args)
            raise SpecError("InvalidExpression", text, f"unknown function {value!r}")
        if peek() == "[" and value in ("x", "p"):
            if value == "p":
                return parameter()
            take("[")
            i = int(take()[1])
            take("]")
            return variable(i)
        if value in names:
            return variable(names.index(value))
        if value in _PLACE:
            return variable(_PLACE[value])
        if key in ("pi", "e"):
            return F.lit(math.pi if key == "pi" else math.e)
        raise SpecError("InvalidExpression", text, f"unknown name {value!r}")

    def power() -> Column:
        base = atom()
        if peek() == "^":
            take()
            return F.pow(base, signed())
        return base

    def signed() -> Column:
        if peek() in ("-", "+"):
            return -signed() if take()[1] == "-" else signed()
        return power()

    def product() -> Column:
        left = signed()
        while peek() in ("*", "/"):
            left = left * signed() if take()[1] == "*" else divide(left, signed())
        return left

    def total() -> Column:
        left = product()
        while peek() in ("+", "-"):
            left = left + product() if take()[1] == "+" else left - product()
        return left

    out = total()
    if peek() is not None:
        raise SpecError("InvalidExpression", text, f"did not expect {peek()!r}")
    return out
