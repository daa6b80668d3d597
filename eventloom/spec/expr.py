"""Expressions and cuts of a spec: tokens, a precedence-climbing parser, and the tree that it returns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class SpecError(ValueError):
    """A spec that cannot be accepted. kind names the class of error."""

    def __init__(self, kind: str, context: str, detail: str):
        super().__init__(f"{context}: {detail}")
        self.kind, self.context, self.detail = kind, context, detail


@dataclass(frozen=True)
class Num:
    value: float
    unit: str | None = None


@dataclass(frozen=True)
class Name:
    """An attribute of the object at hand inside an object's scope, else a column of the event."""

    name: str


@dataclass(frozen=True)
class Attr:
    owner: str
    attr: str


@dataclass(frozen=True)
class Op:
    """One of + - * / ^ and the comparisons."""

    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Neg:
    of: object


@dataclass(frozen=True)
class Call:
    fn: str
    args: tuple = field(default_factory=tuple)
    attr: str | None = None


COMPARISONS = (">=", "<=", "==", "!=", ">", "<")
_TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>>=|<=|==|!=|[-+*/^(),.<>\[\]]))")
_POWER = {**dict.fromkeys(COMPARISONS, 1), "+": 2, "-": 2, "*": 3, "/": 3, "^": 5}
_ARGS = {
    "count": (1, 2), "sum": (1, 1), "all": (2, 2), "any": (2, 2), "leading": (1, 1), "abs": (1, 1), "sqrt": (1, 1),
    "closest_mass": (3, 3), "other_mass": (3, 3), "either_pair_pt": (4, 4),
}


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text.rstrip()):
            found = _TOKEN.match(text, at)
            if not found:
                raise SpecError("InvalidExpression", text, f"cannot read {text[at:].strip()!r}")
            self.tokens.append((found.lastgroup, found.group(found.lastgroup)))
            at = found.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or (wanted and self.peek() != wanted):
            raise SpecError("InvalidExpression", self.text, f"expected {wanted or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def expr(self, least: int = 1):
        left = self.unary()
        while (op := self.peek()) in _POWER and _POWER[op] >= least:
            self.take()
            left = Op(op, left, self.expr(_POWER[op] + (op != "^")))
        return left

    def unary(self):
        if self.peek() == "-":
            self.take()
            of = self.expr(4)
            return Num(-of.value, of.unit) if isinstance(of, Num) else Neg(of)
        return self.atom()

    def atom(self):
        kind, value = self.take()
        if kind == "num":
            unit = None
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
                unit = self.take()[1]
            return Num(float(value), unit)
        if value == "(":
            inner = self.expr()
            self.take(")")
            return inner
        if kind != "name":
            raise SpecError("InvalidExpression", self.text, f"did not expect {value!r}")
        if self.peek() == "(":
            return self.call(value)
        if self.peek() == ".":
            self.take()
            return Attr(value, self.take()[1])
        return Name(value)

    def call(self, fn: str):
        if fn not in _ARGS:
            raise SpecError("InvalidExpression", self.text, f"unknown function {fn!r}")
        self.take("(")
        args = []
        while self.peek() != ")":
            args.append(self.expr())
            if self.peek() == ",":
                self.take()
            elif self.peek() != ")":
                raise SpecError("InvalidExpression", self.text, "expected , or )")
        self.take(")")
        low, high = _ARGS[fn]
        if not low <= len(args) <= high:
            raise SpecError("InvalidExpression", self.text, f"{fn} takes {low} to {high} arguments")
        attr = None
        if fn == "leading":
            self.take(".")
            attr = self.take()[1]
        return Call(fn, tuple(args), attr)


def parse_expr(text: str):
    """An expression without a comparison at its top."""
    parser = _Parser(text)
    out = parser.expr(2)
    if parser.peek() is not None:
        raise SpecError("InvalidExpression", text, f"did not expect {parser.peek()!r}")
    return out


def parse_cut(text: str):
    """A condition: an expression compared with a number, or a bare condition (a flag, all(...), any(...), either_pair_pt(...))."""
    parser = _Parser(text)
    out = parser.expr(1)
    if parser.peek() is not None:
        raise SpecError("InvalidExpression", text, f"did not expect {parser.peek()!r}")
    if isinstance(out, Op) and out.op in COMPARISONS:
        if not isinstance(out.right, Num):
            raise SpecError("InvalidExpression", text, "the right side of a comparison is a number")
    elif not (isinstance(out, Name) or isinstance(out, Call) and out.fn in ("all", "any", "either_pair_pt")):
        raise SpecError("InvalidExpression", text, "expected a comparison")
    return out


def parse_quantity(text: str) -> Num:
    out = parse_expr(text)
    if not isinstance(out, Num):
        raise SpecError("InvalidExpression", text, "expected a number")
    return out


def show(node) -> str:
    """Text that parses to the same tree."""
    if isinstance(node, Num):
        value = repr(int(node.value)) if node.value == int(node.value) and abs(node.value) < 1e15 else repr(node.value)
        return f"{value} {node.unit}" if node.unit else value
    if isinstance(node, Name):
        return node.name
    if isinstance(node, Attr):
        return f"{node.owner}.{node.attr}"
    if isinstance(node, Neg):
        return f"-({show(node.of)})"
    if isinstance(node, Call):
        return f"{node.fn}({', '.join(show(a) for a in node.args)})" + (f".{node.attr}" if node.attr else "")
    if node.op in COMPARISONS:
        return f"{show(node.left)} {node.op} {show(node.right)}"
    return f"({show(node.left)} {node.op} {show(node.right)})"


def walk(node):
    """The node and all below it."""
    yield node
    for child in {Op: lambda n: (n.left, n.right), Neg: lambda n: (n.of,), Call: lambda n: n.args}.get(type(node), lambda n: ())(node):
        yield from walk(child)
