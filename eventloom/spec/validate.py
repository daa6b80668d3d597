"""Checks of a spec against a catalogue: names, types, units, dimensions; and the branches that it reads."""

from __future__ import annotations

import json
from pathlib import Path

from eventloom.functions.corrections import check_inputs, load_corrections
from eventloom.schema import Catalogue, dimension
from eventloom.sources.lumi import read_lumi_mask
from eventloom.spec.expr import COMPARISONS, Attr, Call, Name, Neg, Num, Op, SpecError, show
from eventloom.spec.model import Body, Spec

DERIVED_ATTRS = {"mass": "momentum", "pt": "momentum", "min_delta_r": "dimensionless", "dR": "dimensionless", "dr": "dimensionless"}
FILTERS = {n: "dimensionless" for n in ("dR", "dr", "delta_r", "deltaR", "min_dR", "min_dr", "min_delta_r", "min_deltaR")} | {
    n: "momentum" for n in ("leading_pt", "subleading_pt", "candidate_leading_pt", "candidate_subleading_pt")
}


class _Checker:
    def __init__(self, spec: Spec, catalogue: Catalogue):
        self.spec, self.catalogue = spec, catalogue
        self.errors: list[SpecError] = []
        self.reads: set[str] = set()
        self.scores = {m.output: m for m in spec.models}
        self.body: Body = spec

    def fail(self, kind: str, context: str, detail: str) -> None:
        self.errors.append(SpecError(kind, context, detail))

    def branch(self, context: str, source: str, attr: str) -> str:
        name = f"{source}_{attr}"
        if name not in self.scores:
            if name not in self.catalogue.branches:
                self.fail("MissingBranch", context, f"no branch {name!r}")
            elif "vec_" not in self.catalogue.branches[name] or self.catalogue.branches[name] == "vec_bool":
                self.fail("WrongBranchType", context, f"{name!r} is not a numeric vector")
            elif not self.catalogue.numeric_vector(name):
                self.fail("UnsupportedBranchType", context, f"{name!r} has type {self.catalogue.branches[name]!r}")
            else:
                self.reads |= {name, f"n{source}"}
        return dimension(attr)

    def owner(self, context: str, name: str) -> str | None:
        """The collection of an object list; None and an error if there is no such list."""
        if name in self.body.objects:
            return self.body.objects[name].source
        self.fail("UndefinedObject", context, f"no object {name!r}")
        return None

    def dimension(self, context: str, node, scope: str | None) -> str | None:
        """An expression's dimension; scope is the collection whose attributes stand alone."""
        if isinstance(node, Num):
            return "momentum" if node.unit == "GeV" else "dimensionless"
        if isinstance(node, Neg):
            return self.dimension(context, node.of, scope)
        if isinstance(node, Name):
            if scope:
                return self.branch(context, scope, node.name)
            self.fail("InvalidExpression", context, f"{node.name!r} stands alone")
            return None
        if isinstance(node, Attr):
            if node.owner in self.body.derived:
                if node.attr not in DERIVED_ATTRS:
                    self.fail("InvalidExpression", context, f"candidates have no {node.attr!r}")
                return DERIVED_ATTRS.get(node.attr)
            source = self.owner(context, node.owner)
            return self.branch(context, source, node.attr) if source else None
        if isinstance(node, Call):
            return self.call(context, node, scope)
        left, right = self.dimension(context, node.left, scope), self.dimension(context, node.right, scope)
        if left is None or right is None:
            return None
        if node.op in "+-" and left != right:
            self.fail("InvalidExpression", context, f"{show(node)} adds unlike dimensions")
            return None
        if node.op == "^" and right != "dimensionless":
            self.fail("InvalidExpression", context, f"{show(node)} has an exponent with a dimension")
            return None
        if node.op in "+-^" or right == "dimensionless":
            return left
        return right if node.op == "*" and left == "dimensionless" else "dimensionless"

    def call(self, context: str, node: Call, scope: str | None) -> str | None:
        if node.fn == "abs":
            return self.dimension(context, node.args[0], scope)
        if node.fn == "sqrt":
            return self.dimension(context, node.args[0], scope)
        if node.fn in ("closest_mass", "other_mass"):
            for a in node.args[:2]:
                if not (isinstance(a, Name) and a.name in self.body.derived):
                    self.fail("UndefinedObject", context, f"{show(a)!r} is no candidate")
            self.unit(context, "momentum", node.args[2])
            return "momentum"
        names = node.args[:2] if node.fn == "either_pair_pt" else node.args[:1]
        if node.fn == "sum":
            if not isinstance(node.args[0], Attr):
                self.fail("InvalidExpression", context, "sum takes object.attribute")
                return None
            source = self.owner(context, node.args[0].owner)
            return self.branch(context, source, node.args[0].attr) if source else None
        if not all(isinstance(a, Name) for a in names):
            self.fail("InvalidExpression", context, f"{node.fn} takes an object")
            return None
        sources = [self.owner(context, a.name) for a in names]
        if None in sources:
            return None
        self.reads |= {f"n{s}" for s in sources}
        if node.fn == "leading":
            return self.branch(context, sources[0], node.attr)
        if node.fn == "either_pair_pt":
            for s in sources:
                self.branch(context, s, "pt")
            for q in node.args[2:]:
                self.unit(context, "momentum", q)
        elif len(node.args) == 2:
            self.cut(context, node.args[1], sources[0])
        return "dimensionless"

    def unit(self, context: str, wanted: str | None, number) -> None:
        if not isinstance(number, Num):
            self.fail("InvalidExpression", context, "expected a number")
        elif wanted == "momentum" and number.unit is None:
            self.fail("MissingUnit", context, "a momentum is compared with GeV")
        elif wanted == "dimensionless" and number.unit is not None or number.unit not in (None, "GeV"):
            self.fail("UnitMismatch", context, f"did not expect {number.unit}")

    def cut(self, context: str, node, scope: str | None) -> None:
        if isinstance(node, Op) and node.op in COMPARISONS:
            if not scope and isinstance(node.left, Name):
                self.flag(context, node.left.name)
                if node.op not in ("==", "!=") or node.right.value not in (0, 1):
                    self.fail("InvalidExpression", context, "a flag is compared with 0 or 1")
                return
            found = self.dimension(context, node.left, scope)
            if found:
                self.unit(context, found, node.right)
        elif isinstance(node, Name):
            self.flag(context, node.name)
        else:
            self.dimension(context, node, scope)

    def flag(self, context: str, name: str) -> None:
        if name not in self.catalogue.branches:
            self.fail("MissingBranch", context, f"no branch {name!r}")
        elif not self.catalogue.boolean(name):
            self.fail("WrongBranchType", context, f"{name!r} is not a flag")
        else:
            self.reads.add(name)

    def filter(self, context: str, node) -> None:
        if not (isinstance(node, Op) and isinstance(node.left, Name) and node.left.name in FILTERS):
            self.fail("InvalidExpression", context, f"unknown filter {show(node)}")
        else:
            self.unit(context, FILTERS[node.left.name], node.right)

    def whole(self, body: Body) -> None:
        self.body = body
        for name, o in body.objects.items():
            if not self.catalogue.collection(o.source):
                self.fail("MissingBranch", name, f"no collection {o.source!r}")
            for c in o.cuts:
                self.cut(name, c, o.source)
        for name, d in body.derived.items():
            for owner in [d.object] if d.kind == "pair" else d.items:
                if owner not in body.objects and (d.kind == "pair" or owner not in body.derived):
                    self.fail("UndefinedObject", name, f"no object {owner!r}")
                elif owner in body.objects:
                    for a in ("pt", "eta", "phi", "mass"):
                        self.branch(name, body.objects[owner].source, a)
                    if "opposite_charge" in d.constraints:
                        self.branch(name, body.objects[owner].source, "charge")
            for f in d.filters:
                self.filter(name, f)
            if d.target:
                self.unit(name, "momentum", d.target)
            for x in d.exclude:
                if x not in body.derived:
                    self.fail("UndefinedObject", name, f"no candidate {x!r}")
        try:
            derived_order(body)
        except SpecError as error:
            self.errors.append(error)
        for name, cuts in body.regions.items():
            for c in cuts:
                self.cut(name, c, None)
        for name, e in body.outputs:
            self.dimension(name, e, None)

    def rest(self) -> None:
        spec = self.spec
        for h in spec.histograms:
            for body in [b for _, b in spec.channels] or [spec]:
                self.body = body
                self.dimension(h.name, h.expr, None)
        self.body = spec
        outputs = [m.output for m in spec.models]
        for m in spec.models:
            if m.output in self.catalogue.branches or outputs.count(m.output) > 1:
                self.fail("ModelOutputCollision", m.name, f"{m.output!r} exists already")
            if not self.catalogue.collection(m.batch):
                self.fail("UndefinedBatch", m.name, f"no collection {m.batch!r}")
            if not m.inputs or any(i.split("_")[0] != m.batch for i in m.inputs) or m.output.split("_")[0] != m.batch:
                self.fail("InvalidModel", m.name, "inputs and output belong to the batch collection")
            if m.provider.get("kind", "mock") not in ("mock", "remote", "managed", "onnx"):
                self.fail("InvalidProvider", m.name, f"unknown provider {m.provider.get('kind')!r}")
            for i in m.inputs:
                if "_" in i:
                    self.branch(m.name, *i.split("_", 1))
        if spec.models and spec.channels:
            self.fail("InvalidModel", "channels", "models and channels do not go together")
        if spec.channels:
            forms = {tuple(n for n, _ in b.outputs) for _, b in spec.channels}
            if len(forms) > 1:
                self.fail("InvalidExpression", "channels", "outputs differ")
            if spec.objects:
                self.fail("InvalidExpression", "channels", "objects belong inside channels")
        for c in spec.corrections:
            source = self.owner(c.name, c.collection)
            if c.kind in ("scale", "jes") and c.attr != "pt":
                self.fail("InvalidExpression", c.name, "only pt can be varied")
            if source and c.attr:
                self.branch(c.name, source, c.attr)
            if c.kind == "scale":
                continue
            try:
                payload = load_corrections(str(Path(spec.folder) / c.file))[c.correction]
                given = [i["name"] for i in c.inputs]
                wanted = [i["name"] for i in payload["inputs"]]
                if c.systematic:
                    given.insert(wanted.index(c.systematic["name"]) if c.systematic["name"] in wanted else 0, c.systematic["name"])
                check_inputs(payload, given)
            except SpecError as error:
                self.errors.append(error)
            except (OSError, KeyError, TypeError, json.JSONDecodeError) as error:
                self.fail("InvalidExpression", c.name, f"cannot load the payload: {error}")
            for i in c.inputs:
                if source and "from" in i and f"{source}_{i['from']}" in self.catalogue.branches:
                    self.branch(c.name, source, i["from"])
                elif "from" in i:
                    self.reads.add(i["from"])
        if spec.lumi_mask:
            for b in ("run", "luminosityBlock"):
                if b not in self.catalogue.branches:
                    self.fail("InvalidReadSchema", "lumi_mask", f"no branch {b!r}")
                self.reads.add(b)
            try:
                read_lumi_mask(str(Path(spec.folder) / spec.lumi_mask))
            except (OSError, ValueError) as error:
                self.fail("InvalidExpression", "lumi_mask", str(error))


def derived_order(body: Body) -> list[str]:
    """Candidates, those that others need first. A circle is an error."""
    needs = {n: [x for x in [*d.exclude, *d.items] if x in body.derived] for n, d in body.derived.items()}
    done: list[str] = []
    while len(done) < len(needs):
        ready = [n for n in needs if n not in done and all(x in done for x in needs[n])]
        if not ready:
            raise SpecError("InvalidExpression", "derived", f"circle among {sorted(set(needs) - set(done))}")
        done += ready
    return done


def errors_of(spec: Spec, catalogue: Catalogue) -> list[SpecError]:
    """All errors of a spec, none if it is sound."""
    return _checked(spec, catalogue).errors


def _checked(spec: Spec, catalogue: Catalogue) -> _Checker:
    checker = _Checker(spec, catalogue)
    for body in [b for _, b in spec.channels] or [spec]:
        checker.whole(body)
    checker.rest()
    return checker


def required_branches(spec: Spec, catalogue: Catalogue) -> list[str]:
    """The branches to read, after all checks have passed; the first error is raised otherwise."""
    checker = _checked(spec, catalogue)
    if checker.errors:
        raise checker.errors[0]
    return sorted(checker.reads)
