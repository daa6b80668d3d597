"""What a spec says, and how TOML, YAML, JSON and plain dictionaries become it."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from eventloom.spec.expr import Num, SpecError, parse_cut, parse_expr, parse_quantity


@dataclass
class Objects:
    """Objects of a collection that pass all cuts, in source order."""

    source: str
    cuts: list


@dataclass
class Derived:
    """A candidate: a pair of one object list, or a combination of items. At most one an event."""

    kind: str
    object: str | None = None
    items: list[str] = field(default_factory=list)
    constraints: list[str] = field(default_factory=list)
    filters: list = field(default_factory=list)
    selection: str = "leading_pt"
    target: Num | None = None
    exclude: list[str] = field(default_factory=list)


@dataclass
class Histogram:
    name: str
    expr: object
    bins: int
    low: float
    high: float


@dataclass
class Systematic:
    name: str
    up: float
    down: float


@dataclass
class Correction:
    """kind scale: a factor on an attribute; jes: one from a payload; scale_factor: an event weight from a payload."""

    name: str
    kind: str
    collection: str
    attr: str | None = None
    up: float | None = None
    down: float | None = None
    file: str | None = None
    correction: str | None = None
    inputs: list[dict] = field(default_factory=list)
    systematic: dict | None = None


@dataclass
class Model:
    name: str
    inputs: list[str]
    output: str
    batch: str
    dtype: str = "f32"
    provider: dict = field(default_factory=lambda: {"kind": "mock"})


@dataclass
class Body:
    """What one channel computes."""

    objects: dict[str, Objects] = field(default_factory=dict)
    derived: dict[str, Derived] = field(default_factory=dict)
    regions: dict[str, list] = field(default_factory=dict)
    outputs: list[tuple[str, object]] = field(default_factory=list)


@dataclass
class Spec(Body):
    name: str = ""
    year: str = ""
    histograms: list[Histogram] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    systematics: list[Systematic] = field(default_factory=list)
    corrections: list[Correction] = field(default_factory=list)
    models: list[Model] = field(default_factory=list)
    lumi_mask: str | None = None
    channels: list[tuple[str, Body]] = field(default_factory=list)
    folder: str = "."

    def variations(self) -> list[str]:
        """Nominal first, then up and down of weights, shapes and scale factors."""
        names = [s.name for s in self.systematics]
        names += [c.name for c in self.corrections if c.kind in ("scale", "jes")]
        names += [c.name for c in self.corrections if c.kind == "scale_factor" and c.systematic]
        return ["Nominal", *[camel(n) + way for n in names for way in ("Up", "Down")]]


def camel(name: str) -> str:
    return "".join(part[:1].upper() + part[1:] for part in name.replace("-", "_").split("_"))


_CONSTRAINTS = ("opposite_charge", "same_flavor")
_SELECTIONS = ("leading_pt", "nearest_mass", "nearest_mass_truncated")


def _derived(name: str, raw: dict) -> Derived:
    kind = {"candidate": "combine"}.get(raw.get("kind"), raw.get("kind"))
    if kind not in ("pair", "combine"):
        raise SpecError("InvalidExpression", name, f"unknown kind {raw.get('kind')!r}")
    if kind == "pair" and not raw.get("object") or kind == "combine" and not raw.get("items"):
        raise SpecError("InvalidExpression", name, "a pair needs an object, a combination items")
    for given, known in ((raw.get("constraints", []), _CONSTRAINTS), ([raw.get("selection") or "leading_pt"], _SELECTIONS)):
        if wrong := [x for x in given if x not in known]:
            raise SpecError("InvalidExpression", name, f"unknown {wrong[0]!r}")
    selection = raw.get("selection") or "leading_pt"
    target = parse_quantity(raw["target"]) if raw.get("target") else None
    if selection != "leading_pt" and target is None:
        raise SpecError("InvalidExpression", name, f"{selection} needs a target")
    return Derived(kind, raw.get("object"), list(raw.get("items", [])), list(raw.get("constraints", [])), [parse_cut(c) for c in raw.get("filters", [])], selection, target, list(raw.get("exclude", [])))


def _body(raw: dict, into: Body) -> Body:
    for name, one in raw.get("objects", {}).items():
        into.objects[name] = Objects(one["source"], [parse_cut(c) for c in one.get("cuts", [])])
    for name, one in (raw.get("derived") or raw.get("derived_objects") or {}).items():
        into.derived[name] = _derived(name, one)
    for name, one in raw.get("regions", {}).items():
        into.regions[name] = [parse_cut(c) for c in one.get("require", [])]
    into.outputs = [(o["name"], parse_expr(o["expr"])) for o in raw.get("outputs", [])]
    names = [n for n, _ in into.outputs]
    if len(set(names)) < len(names):
        raise SpecError("InvalidExpression", "outputs", "names must be unique")
    return into


def from_dict(raw: dict, folder: str = ".") -> Spec:
    try:
        spec = Spec(name=raw["analysis"]["name"], year=str(raw["analysis"]["year"]), folder=folder)
        _body(raw, spec)
        for h in raw.get("histogram", []):
            low, high = (float(x) for x in h["range"])
            if h["bins"] <= 0 or not low < high or max(abs(low), abs(high)) == float("inf"):
                raise SpecError("InvalidExpression", h["name"], "a histogram needs bins and an ordered, finite range")
            spec.histograms.append(Histogram(h["name"], parse_expr(h["expr"]), int(h["bins"]), low, high))
        spec.weights = [float(w) for w in (raw.get("weight") or {}).get("nominal", [])]
        for s in raw.get("systematic", []):
            if s["kind"] != "weight":
                raise SpecError("InvalidExpression", s["name"], f"unknown kind {s['kind']!r}")
            spec.systematics.append(Systematic(s["name"], float(s["up"]), float(s["down"])))
        for c in raw.get("correction", []):
            if c["kind"] not in ("scale", "jes", "scale_factor"):
                raise SpecError("InvalidExpression", c["name"], f"unknown kind {c['kind']!r}")
            spec.corrections.append(Correction(**c))
        for m in raw.get("model", []):
            spec.models.append(Model(m["name"], list(m.get("inputs", [])), m["output"], m["batch"], m.get("dtype") or "f32", m.get("provider") or {"kind": "mock"}))
        spec.lumi_mask = (raw.get("lumi_mask") or {}).get("file")
        spec.channels = [(c["name"], _body(c, Body())) for c in raw.get("channel", [])]
    except (KeyError, TypeError) as error:
        raise SpecError("InvalidExpression", "spec", f"missing or unknown key {error}") from error
    names = [x.name for x in [*spec.systematics, *spec.corrections]]
    if len(set(names)) < len(names):
        raise SpecError("InvalidExpression", "systematics", "names must be unique")
    return spec


def from_text(text: str, form: str, folder: str = ".") -> Spec:
    """form: toml, yaml, json or adl."""
    if form == "adl":
        from eventloom.spec.adl import parse_adl

        return from_dict(parse_adl(text), folder)
    if form in ("yaml", "yml"):
        import yaml

        raw = yaml.safe_load(text)
    elif form in ("toml", "json"):
        raw = tomllib.loads(text) if form == "toml" else json.loads(text)
    else:
        raise SpecError("InvalidExpression", form, "unknown form of spec")
    return from_dict(raw, folder)


def load(path: str) -> Spec:
    """Reads a spec; the file's ending tells its form, and files that it names are found beside it."""
    file = Path(path)
    return from_text(file.read_text(), file.suffix[1:].lower(), str(file.parent))
