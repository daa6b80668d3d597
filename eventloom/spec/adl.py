"""A small analysis description language: statements and blocks that say the same as a TOML spec."""

from __future__ import annotations

import re

from eventloom.spec.expr import SpecError, show
from eventloom.spec.model import Spec

_HEAD = re.compile(r"\s*(?P<word>\w+)\s*")


def _fail(detail: str):
    raise SpecError("InvalidExpression", "ADL", detail)


def _split(text: str, mark: str) -> list[str]:
    """Parts between marks that stand outside brackets."""
    parts, depth, start, at = [], 0, 0, 0
    while at < len(text):
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(text[at], 0)
        if depth == 0 and text.startswith(mark, at):
            parts.append(text[start:at])
            at = start = at + len(mark)
            continue
        at += 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def _statements(text: str) -> list[tuple[str, str | None]]:
    """(head, block or None) of each statement; comments start with // or #."""
    text = re.sub(r"(//|#)[^\n]*", "", text)
    out, at = [], 0
    while text[at:].strip():
        stop = re.compile(r"[;{]").search(text, at)
        if not stop:
            _fail(f"unended statement {text[at:].strip()!r}")
        head = text[at : stop.start()].strip()
        if stop.group() == ";":
            out.append((head, None))
            at = stop.end()
            continue
        close = text.find("}", stop.end())
        if close < 0:
            _fail(f"block of {head!r} has no end")
        out.append((head, text[stop.end() : close]))
        at = close + 1
    return out


class _Reader:
    def __init__(self) -> None:
        self.raw: dict = {"objects": {}, "derived": {}, "regions": {}, "outputs": [], "histogram": [], "systematic": [], "correction": [], "model": []}
        self.aliases: dict[str, str] = {}

    def put(self, table: str, name: str, value) -> None:
        if name in self.raw[table]:
            _fail(f"duplicate {table} {name!r}")
        self.raw[table][name] = value

    def expand(self, text: str) -> str:
        """Names of aliases outside member access become their expressions."""
        for name, value in self.aliases.items():
            text = re.sub(rf"(?<![\w.]){name}(?![\w(.])", f"({value})" if re.search(r"[-+*/^]", value) else value, text)
        return text

    def cuts(self, block: str) -> list[str]:
        return [self.expand(c) for s in _split(block, ";") for c in _split(s.removeprefix("select "), " and ")]

    def analysis(self, rest: str, block) -> None:
        words = rest.split()
        if len(words) != 3 or words[1] != "year":
            _fail("expected: analysis NAME year YEAR;")
        self.raw["analysis"] = {"name": words[0], "year": words[2]}

    def object(self, rest: str, block) -> None:
        name, _, source = (x.strip() for x in rest.partition(":"))
        made = re.fullmatch(r"(pair|comb|combine|candidate)\((.*)\)", source)
        if not made:
            if not re.fullmatch(r"\w+", source):
                _fail(f"object {name!r} has no source")
            self.put("objects", name, {"source": source, "cuts": self.cuts(block)})
            return
        args = _split(made[2], ",")
        if made[1] in ("combine", "candidate"):
            one = {"kind": "combine", "items": args}
        else:
            if made[1] == "comb" and args[1:] != ["2"]:
                _fail("only comb(object, 2) is known")
            one = {"kind": "pair", "object": args[0], "constraints": [], "exclude": []}
        one["filters"] = []
        for s in _split(block, ";"):
            word, _, value = s.partition(" ")
            if word in ("filter", "select") and value:
                one["filters"].append(self.expand(value.strip()))
            elif one["kind"] == "combine":
                _fail(f"{name!r}: unknown statement {s!r}")
            elif s.lower() in ("opposite_charge", "ossf", "same_flavor"):
                one["constraints"] += {"ossf": ["opposite_charge", "same_flavor"]}.get(s.lower(), [s.lower()])
            elif word == "exclude":
                one["exclude"] += _split(value, ",")
            elif word == "selection" or s.lower() == "leading_pt":
                one["selection"] = value.strip() or "leading_pt"
            elif word in ("nearest", "nearest_mass", "nearest_mass_truncated"):
                one |= {"selection": {"nearest": "nearest_mass"}.get(word, word), "target": value.strip()}
            else:
                _fail(f"{name!r}: unknown statement {s!r}")
        self.put("derived", name, one)

    def region(self, rest: str, block) -> None:
        self.put("regions", rest, {"require": self.cuts(block)})

    def define(self, rest: str, block) -> None:
        name, _, value = (x.strip() for x in rest.partition("="))
        if name in self.aliases:
            _fail(f"duplicate alias {name!r}")
        self.aliases[name] = self.expand(value)

    alias = define

    def output(self, rest: str, block) -> None:
        name, equals, value = (x.strip() for x in rest.partition("="))
        if not equals and name not in self.aliases:
            _fail(f"output {name!r} is not defined")
        self.raw["outputs"].append({"name": name, "expr": self.expand(value) if equals else self.aliases[name]})

    def histogram(self, rest: str, block) -> None:
        given = dict((k.strip(), v.strip()) for k, _, v in (s.partition("=") for s in _split(block, ";")))
        if set(given) != {"expr", "bins", "range"}:
            _fail(f"histogram {rest!r} needs expr, bins and range")
        low, high = (float(x) for x in given["range"].strip("[]").split(","))
        self.raw["histogram"].append({"name": rest, "expr": self.expand(given["expr"]), "bins": int(given["bins"]), "range": [low, high]})

    def weight(self, rest: str, block) -> None:
        word, _, value = rest.partition(" ")
        if word != "nominal" or "weight" in self.raw:
            _fail("expected one: weight nominal [..];")
        self.raw["weight"] = {"nominal": [float(x) for x in value.strip(" []").split(",") if x.strip()]}

    def systematic(self, rest: str, block) -> None:
        name, *words = rest.split()
        given = dict(zip(words[::2], words[1::2], strict=True))
        self.raw["systematic"].append({"name": name, "kind": given["kind"], "up": float(given["up"]), "down": float(given["down"])})

    def correction(self, rest: str, block) -> None:
        name, *words = rest.split()
        one: dict = {"name": name}
        while words:
            key = words.pop(0)
            if key == "input":
                one.setdefault("inputs", []).append({"name": words.pop(0), words.pop(0): words.pop(0)})
            elif key == "systematic":
                one["systematic"] = {"name": words.pop(0)}
            elif key in ("nominal", "up", "down") and "systematic" in one:
                one["systematic"][key] = words.pop(0)
            else:
                value = words.pop(0)
                one[key] = float(value) if key in ("up", "down") else value
        self.raw["correction"].append(one)

    def model(self, rest: str, block) -> None:
        one: dict = {"name": rest}
        for s in _split(block, ";"):
            key, _, value = s.partition(" ")
            key = {"output_dtype": "dtype"}.get(key, key)
            if key in one or key not in ("inputs", "output", "dtype", "batch", "provider"):
                _fail(f"model {rest!r}: duplicate or unknown {key!r}")
            one[key] = _split(value, ",") if key == "inputs" else {"kind": value.split()[0]} if key == "provider" else value.strip()
        self.raw["model"].append(one)


def parse_adl(text: str) -> dict:
    """The dictionary that a TOML spec of the same content gives."""
    reader = _Reader()
    for head, block in _statements(text):
        word, _, rest = head.partition(" ")
        known = {"analysis", "object", "region", "define", "alias", "output", "histogram", "weight", "systematic", "correction", "model"}
        if word not in known or (block is not None) != (word in ("object", "region", "histogram", "model")):
            _fail(f"unknown statement {head!r}")
        getattr(reader, word)(rest.strip(), block)
    if "analysis" not in reader.raw:
        _fail("no analysis statement")
    return reader.raw


def emit_adl(spec: Spec) -> str:
    """ADL that parses to the same spec. Channels, lumi masks, several weight systematics and shapes other than pt have no form."""
    if spec.channels or spec.lumi_mask or len(spec.systematics) > 1 or any(c.kind in ("scale", "jes") and c.attr not in (None, "pt") for c in spec.corrections):
        raise SpecError("InvalidExpression", spec.name, "has parts that ADL cannot say")
    out = [f"analysis {spec.name} year {spec.year};"]
    if spec.weights or spec.systematics or spec.corrections:
        out.append("weight nominal" + (f" [{', '.join(map(repr, spec.weights))}]" if spec.weights else "") + ";")
    out += [f"systematic {s.name} kind weight up {s.up} down {s.down};" for s in spec.systematics]
    for c in spec.corrections:
        words = [f"correction {c.name} kind {c.kind}"]
        words += [f"{k} {v}" for k, v in (("file", c.file), ("correction", c.correction), ("collection", c.collection), ("attr", c.attr), ("up", c.up), ("down", c.down)) if v is not None]
        words += [f"input {i['name']} {'from' if 'from' in i else 'value'} {i.get('from', i.get('value'))}" for i in c.inputs]
        if s := c.systematic:
            words.append(f"systematic {s['name']} nominal {s.get('nominal', 'nominal')} up {s['up']} down {s['down']}")
        out.append(" ".join(words) + ";")
    block = lambda head, lines: out.append(f"{head} {{\n" + "".join(f"  {x};\n" for x in lines) + "}")
    for name, o in spec.objects.items():
        block(f"object {name} : {o.source}", [show(c) for c in o.cuts])
    for name, d in spec.derived.items():
        lines = [*d.constraints, *[f"filter {show(f)}" for f in d.filters]]
        if d.kind == "pair":
            lines.append(f"{d.selection} {show(d.target)}" if d.target else f"selection {d.selection}")
            lines += [f"exclude {', '.join(d.exclude)}"] if d.exclude else []
        block(f"object {name} : " + (f"pair({d.object})" if d.kind == "pair" else f"combine({', '.join(d.items)})"), lines)
    for m in spec.models:
        block(f"model {m.name}", [f"inputs {', '.join(m.inputs)}", f"output {m.output}", f"dtype {m.dtype}", f"batch {m.batch}", f"provider {m.provider['kind']}"])
    for name, cuts in spec.regions.items():
        block(f"region {name}", [show(c) for c in cuts])
    out += [f"output {n} = {show(e)};" for n, e in spec.outputs]
    for h in spec.histograms:
        block(f"histogram {h.name}", [f"expr = {show(h.expr)}", f"bins = {h.bins}", f"range = [{h.low}, {h.high}]"])
    return "\n".join(out) + "\n"
