"""Correction payloads (JSON, plain or gzipped): decision trees of bins, categories and formulas, compiled to columns."""

from __future__ import annotations

import gzip
import json
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.formula import compile_formula
from eventloom.spec.expr import SpecError


def load_corrections(path: str) -> dict[str, dict]:
    """Payloads by name."""
    data = Path(path).read_bytes()
    raw = json.loads(gzip.decompress(data) if path.endswith(".gz") else data)
    return {c["name"]: c for c in raw["corrections"]}


def _fail(name: str, detail: str) -> Column:
    return F.raise_error(F.lit(f"{name}: {detail}")).cast("double")


def _node(node, inputs: dict[str, Column], order: list[str]) -> Column:
    if isinstance(node, int | float):
        return F.lit(float(node))
    kind = node.get("nodetype")
    if kind == "binning":
        edges, content = node["edges"], node["content"]
        if not isinstance(edges, list) or len(edges) != len(content) + 1:
            raise SpecError("InvalidExpression", str(node.get("input")), "bins need one more explicit edge than contents")
        x = inputs[node["input"]].cast("double")
        inner = [_node(c, inputs, order) for c in content]
        flow = node.get("flow", "error")
        low, high = (inner[0], inner[-1]) if flow == "clamp" else (_fail(node["input"], "value outside the bins"),) * 2 if flow == "error" else (_node(flow, inputs, order),) * 2
        out = F.when(F.isnan(x), _fail(node["input"], "value is not a number")).when(x < float(edges[0]), low)
        for edge, value in zip(edges[1:], inner, strict=True):
            out = out.when(x < float(edge), value)
        return out.otherwise(high)
    if kind == "category":
        x, out = inputs[node["input"]], None
        for item in node["content"]:
            same = x == F.lit(item["key"])
            value = _node(item["value"], inputs, order)
            out = F.when(same, value) if out is None else out.when(same, value)
        default = node.get("default")
        rest = _fail(node["input"], "no such category") if default is None else _node(default, inputs, order)
        return rest if out is None else out.otherwise(rest)
    if kind == "formula":
        names = node["variables"]
        return compile_formula(node["expression"], names, [inputs[n] for n in names], node.get("parameters") or [])
    raise SpecError("InvalidExpression", str(kind), "nodes of this type are not supported")


def check_inputs(payload: dict, names: list[str]) -> None:
    """A payload's inputs must be given by name and in order."""
    wanted = [i["name"] for i in payload["inputs"]]
    if wanted != names:
        raise SpecError("InvalidExpression", payload["name"], f"takes {wanted}, not {names}")


def correction(payload: dict, inputs: dict[str, Column]) -> Column:
    """The payload's value. Categories of constant inputs are chosen here, by constant folding."""
    order = [i["name"] for i in payload["inputs"]]
    missing = [n for n in order if n not in inputs]
    if missing:
        raise SpecError("InvalidExpression", payload["name"], f"input {missing[0]!r} is missing")
    return _node(payload["data"], inputs, order)


def muon_id(payload: dict, pt: Column, eta: Column, variation: str = "nominal", year: str | None = None) -> Column:
    """A muon scale factor whose inputs are known by their usual names."""
    known = {"pt": pt, "eta": eta, "abseta": F.abs(eta), "scale_factors": F.lit(variation), "variation": F.lit(variation), "year": F.lit(year), "era": F.lit(year)}
    return correction(payload, {i["name"]: known[i["name"]] for i in payload["inputs"] if i["name"] in known})
