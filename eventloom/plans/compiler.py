"""A spec to a plan: objects, candidates, regions, outputs and fills as array expressions on one scan.

Every variation of a shape and every channel is evaluated on the same scanned row, stage by stage. Stages are divided by
a generator of one row, over which the optimizer does not move expressions: an array that is built once is used by
all later expressions, and neither rebuilt in a filter nor inside a lambda.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.corrections import correction, load_corrections
from eventloom.functions.ieee import compare, divide, wide
from eventloom.operators import candidates as C
from eventloom.operators import histogram as H
from eventloom.operators.inference import add_scores
from eventloom.operators.kinematics import add, four_vector
from eventloom.sources.lumi import certified, read_lumi_mask
from eventloom.spec.expr import COMPARISONS, Attr, Name, Neg, Num, Op, SpecError
from eventloom.spec.model import Body, Correction, Spec, camel
from eventloom.spec.validate import derived_order

_FIELD = {"dR": "min_delta_r", "dr": "min_delta_r"}


@dataclass
class Scope:
    """What names mean: object lists, candidates, and the object at hand."""

    objects: dict[str, Column]
    derived: dict[str, Column]
    item: Column | None = None

    def of(self, item: Column) -> Scope:
        return Scope(self.objects, self.derived, item)


def value(node, at: Scope) -> Column:
    """An expression as a column, null where something that it needs is missing."""
    if isinstance(node, Num):
        return F.lit(node.value)
    if isinstance(node, Neg):
        return -value(node.of, at)
    if isinstance(node, Name):
        return wide(at.item[node.name] if at.item is not None else F.col(node.name))
    if isinstance(node, Attr):
        if node.owner in at.derived:
            return at.derived[node.owner][_FIELD.get(node.attr, node.attr)]
        if at.item is None:
            raise SpecError("InvalidExpression", node.owner, f"has many values of {node.attr!r}")
        return wide(at.item[node.attr])
    if isinstance(node, Op):
        a, b = value(node.left, at).cast("double"), value(node.right, at).cast("double")
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divide(a, b), "^": lambda: F.pow(a, b)}[node.op]()
    if node.fn in ("abs", "sqrt"):
        inner = value(node.args[0], at)
        return F.abs(inner) if node.fn == "abs" else F.sqrt(inner.cast("double"))
    if node.fn in ("closest_mass", "other_mass"):
        return C.mass_by_distance(at.derived[node.args[0].name], at.derived[node.args[1].name], node.args[2].value, node.fn[0] == "c")
    if node.fn == "sum":
        own = at.objects[node.args[0].owner]
        return F.aggregate(own, F.lit(0.0), lambda total, x: total + wide(x[node.args[0].attr]))
    own = at.objects[node.args[0].name]
    if node.fn == "leading":
        return F.array_max(F.transform(own, lambda x: wide(x[node.attr])))
    if node.fn == "count":
        return F.size(own if len(node.args) == 1 else F.filter(own, lambda x: condition(node.args[1], at.of(x))))
    raise SpecError("InvalidExpression", node.fn, "has no number")


def condition(node, at: Scope) -> Column:
    """A cut as a column that is never null: what cannot be compared does not pass."""
    if isinstance(node, Op) and node.op in COMPARISONS:
        left = value(node.left, at)
        return F.coalesce(compare(node.op, left.cast("double"), F.lit(node.right.value)), F.lit(False))
    if isinstance(node, Name):
        return F.coalesce(F.col(node.name).cast("boolean"), F.lit(False))
    if node.fn == "either_pair_pt":
        return C.either_pair(at.objects[node.args[0].name], at.objects[node.args[1].name], node.args[2].value, node.args[3].value)
    own = at.objects[node.args[0].name]
    test = lambda x: condition(node.args[1], at.of(x))
    return F.forall(own, test) if node.fn == "all" else F.exists(own, test)


def _inputs(c: Correction, item: Column, source_fields: set[str], variation: str) -> dict[str, Column]:
    out = {}
    for i in c.inputs:
        if "from" not in i:
            out[i["name"]] = F.lit(i["value"])
        else:
            out[i["name"]] = wide(item[i["from"]]) if i["from"] in source_fields else F.col(i["from"])
    if s := c.systematic:
        way = variation.removeprefix(camel(c.name)) if variation.startswith(camel(c.name)) else ""
        out[s["name"]] = F.lit({"Up": s["up"], "Down": s["down"]}.get(way, s.get("nominal", "nominal")))
    return out


class Plan:
    """A spec on a frame of events. keep: columns of the frame that results carry."""

    def __init__(self, spec: Spec, events: DataFrame, keep: list[str] = ()):
        self.spec, self.keep = spec, list(keep)
        self.bodies: list[tuple[str | None, Body]] = spec.channels or [(None, spec)]
        self.payloads = {c.name: load_corrections(str(Path(spec.folder) / c.file))[c.correction] for c in spec.corrections if c.kind != "scale"}
        df = certified(events, read_lumi_mask(str(Path(spec.folder) / spec.lumi_mask))) if spec.lumi_mask else events
        if not spec.channels:
            flags = [c for cuts in spec.regions.values() for c in cuts if isinstance(c, Name)]
            for c in flags:
                df = df.filter(F.col(c.name))
        for m in spec.models:
            df = add_scores(df, m)
        self.events = df
        self.shapes = [None, *[(c, way) for c in spec.corrections if c.kind in ("scale", "jes") for way in ("Up", "Down")]]

    def _fields(self, source: str) -> set[str]:
        return set(self.events.schema[source].dataType.elementType.names)

    def _source(self, name: str, body: Body, shape) -> Column:
        """The objects before cuts, with the varied attribute of a shape."""
        source = body.objects[name].source
        if shape is None or shape[0].collection != name:
            return F.col(source)
        c, way = shape
        fields = self._fields(source)

        def varied(x: Column) -> Column:
            if c.kind == "scale":
                factor = F.lit(c.up if way == "Up" else c.down)
            else:
                unc = correction(self.payloads[c.name], _inputs(c, x, fields, "Nominal"))
                factor = 1.0 + unc if way == "Up" else 1.0 - unc
            return x.withField(c.attr, (wide(x[c.attr]) * factor).cast("float"))

        return F.transform(source, varied)

    def _cut(self, objects: Column, cuts: list) -> Column:
        return F.filter(objects, lambda x: C.pass_all([condition(c, Scope({}, {}, x)) for c in cuts])) if cuts else objects

    def _scale_factor(self, c: Correction, body: Body, at: Scope, variation: str) -> Column:
        """The product over the selected objects."""
        fields = self._fields(body.objects[c.collection].source)
        one = lambda x: correction(self.payloads[c.name], _inputs(c, x, fields, variation))
        return F.aggregate(at.objects[c.collection], F.lit(1.0), lambda total, x: total * one(x))

    def _stage(self, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """Adds columns that later expressions take as they are."""
        if not columns:
            return df
        return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))

    def _candidate(self, name: str, body: Body, at: Scope) -> Column:
        d = body.derived[name]
        tests = lambda quantity, x: C.pass_all([compare(f.op, quantity(f.left.name, x), F.lit(f.right.value)) for f in d.filters])
        if d.kind == "combine":
            taken: dict[str, int] = {}
            momentum, parts = None, None
            for item in d.items:
                if item in at.objects:
                    x = F.get(at.objects[item], F.lit(taken.get(item, 0)))
                    taken[item] = taken.get(item, 0) + 1
                    p, own = four_vector(x), F.when(x.isNotNull(), F.array(C.part(item, x)))
                else:
                    p, own = at.derived[item], at.derived[item]["constituents"]
                momentum = p if momentum is None else C.let(F.struct(momentum.alias("a"), p.alias("b")), lambda v: add(v["a"], v["b"]))
                parts = own if parts is None else F.concat(parts, own)
            made = C.candidate(momentum, parts)
            return C.first(F.filter(F.array(made), lambda c: C.sound(c) & F.coalesce(tests(C.candidate_quantity, c), F.lit(False))))
        objects = at.objects[d.object]
        ordered = objects if d.selection == "nearest_mass_truncated" else C.by_pt(objects)
        excluded = C.used(d.object, *[at.derived[x] for x in d.exclude])

        def allowed(p: Column, excluded: Column) -> Column:
            ok = tests(C.pair_quantity, p)
            if "opposite_charge" in d.constraints:
                ok = C.opposite_charge(p) & ok
            if d.exclude:
                ok = ~F.array_contains(excluded, p["l"]["idx"]) & ~F.array_contains(excluded, p["r"]["idx"]) & ok
            return ok

        kept = C.let(excluded, lambda e: F.filter(C.pairs(ordered), lambda p: allowed(p, e)))
        made = F.filter(F.transform(kept, lambda p: C.made_from(d.object, p)), lambda c: C.sound(c))
        if d.selection == "leading_pt":
            return C.first(made)
        return (C.nearest if d.selection == "nearest_mass" else C.nearest_truncated)(made, d.target.value)

    def evaluated(self, shapes: list) -> DataFrame:
        """keep, channel, shape, outputs and histogram values (h0, ...), w (weights by variation) of passing events."""
        df = self.events
        places = [(channel, body, shape, f"__{i}_{j}_") for i, (channel, body) in enumerate(self.bodies) for j, shape in enumerate(shapes)]
        objects = {}
        for _, body, shape, mark in places:
            for name, o in body.objects.items():
                source = self._source(name, body, shape)
                objects[f"{mark}{name}"] = self._cut(source, o.cuts)
        df = self._stage(df, objects)
        scopes = {mark: Scope({n: F.col(f"{mark}{n}") for n in body.objects}, {n: F.col(f"{mark}{n}") for n in body.derived}) for _, body, _, mark in places}
        depth = max(len(body.derived) for _, body in self.bodies)
        for step in range(depth):
            made = {}
            for _, body, _, mark in places:
                order = derived_order(body)
                if step < len(order):
                    made[f"{mark}{order[step]}"] = self._candidate(order[step], body, scopes[mark])
            df = self._stage(df, made)
        return df.select(*self.keep, F.inline(F.array(*[self._result(c, b, s, scopes[m]) for c, b, s, m in places]))).filter("passed").drop("passed")

    def _result(self, channel: str | None, body: Body, shape, at: Scope) -> Column:
        outputs = [(n, value(e, at)) for n, e in body.outputs]
        fills = [value(h.expr, at).cast("double") for h in self.spec.histograms]
        tests = [condition(c, at) for cuts in body.regions.values() for c in cuts]
        tests += [c.isNotNull() for _, c in outputs] + [c.isNotNull() for c in fills]
        name = "Nominal" if shape is None else camel(shape[0].name) + shape[1]
        return F.struct(
            C.pass_all(tests).alias("passed"),
            F.lit(channel).cast("string").alias("channel"),
            F.lit(name).alias("shape"),
            *[c.alias(n) for n, c in outputs],
            *[c.alias(f"__h{i}") for i, c in enumerate(fills)],
            self._weights(shape, body, at).alias("__w"),
        )

    def _weights(self, shape, body: Body, at: Scope) -> Column:
        """Weights by variation: all weight variations on the nominal shape, the nominal weight on the others."""
        spec = self.spec
        plain = 1.0
        for w in spec.weights:
            plain *= w
        name = "Nominal" if shape is None else camel(shape[0].name) + shape[1]
        shaped = {camel(c.name) + way for c in spec.corrections if c.kind in ("scale", "jes") for way in ("Up", "Down")}
        names = [v for v in spec.variations() if v not in shaped] if shape is None else [name]
        out = []
        for v in names:
            w = F.lit(plain)
            for s in spec.systematics:
                w = w * {camel(s.name) + "Up": s.up, camel(s.name) + "Down": s.down}.get(v, 1.0)
            for c in spec.corrections:
                if c.kind == "scale_factor":
                    w = w * self._scale_factor(c, body, at, v)
            out.append(F.struct(F.lit(v).alias("variation"), w.alias("w")))
        return F.array(*out)

    def rows(self) -> DataFrame:
        """One row for each passing event (and channel), with the outputs."""
        names = [n for n, _ in self.bodies[0][1].outputs]
        channel = ["channel"] if self.spec.channels else []
        return self.evaluated([None]).select(*self.keep, *channel, *names)

    def varied_rows(self) -> DataFrame:
        """As rows, for every shape, told by the column variation: what a skim is partitioned by."""
        names = [n for n, _ in self.bodies[0][1].outputs]
        channel = ["channel"] if self.spec.channels else []
        return self.evaluated(self.shapes).select(*self.keep, *channel, F.col("shape").alias("variation"), *names)

    def weighted(self) -> DataFrame:
        """As rows, with each event's nominal weight."""
        return self.evaluated([None]).select(*self.keep, *[n for n, _ in self.bodies[0][1].outputs], F.get("__w", F.lit(0))["w"].alias("weight"))

    def fills(self) -> DataFrame:
        """(keep..., hist, bins, variation, bin, x, w): every fill of every histogram."""
        hists = self.spec.histograms
        each = F.array(*[F.struct(F.lit(h.name).alias("hist"), F.lit(h.bins).alias("bins"), F.lit(h.low).alias("low"), F.lit(h.high).alias("high"), F.col(f"__h{i}").alias("x")) for i, h in enumerate(hists)])
        df = self.evaluated(self.shapes).select(*self.keep, "__w", F.inline(each)).select(*self.keep, "hist", "bins", "low", "high", "x", F.inline("__w"))
        return df.withColumn("bin", H.bin_of(F.col("x"), F.col("low"), F.col("high"), F.col("bins"))).drop("low", "high")

    def histograms(self) -> DataFrame:
        """Complete histograms by keep columns, of all variations."""
        filled = H.fill(self.fills(), [*self.keep, "hist", "variation"])
        whole = H.frame(self.events.sparkSession, {h.name: h.bins for h in self.spec.histograms}, self.spec.variations())
        if self.keep:
            return filled
        return H.complete(filled, whole)

    def cutflow(self) -> DataFrame:
        """events_seen and events_selected in one aggregation; counting what was seen reads no column."""
        seen = self.events.select(F.lit(1).alias("events_seen"), F.lit(0).alias("events_selected"))
        chosen = self.rows().select(F.lit(0).alias("events_seen"), F.lit(1).alias("events_selected"))
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("events_seen", "events_selected")]
        return seen.unionByName(chosen).agg(*sums)
