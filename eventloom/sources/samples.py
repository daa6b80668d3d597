"""Sample tables: which files belong to which process, and how simulated ones are normalised."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import histogram as H
from eventloom.plans.compiler import Plan
from eventloom.spec.expr import SpecError
from eventloom.spec.model import Spec

#: Inverse picobarns and picobarns in femtobarn units; fixed values.
XSEC = {"fb": 1.0, "pb": 1000.0}
LUMI = {"fb^-1": 1.0, "fb-1": 1.0, "1/fb": 1.0, "pb^-1": 0.001, "pb-1": 0.001, "1/pb": 0.001}


def quantity(text: str, units: dict[str, float], what: str) -> float:
    """A number with its unit, such as '0.5 pb', in femtobarn units."""
    number, _, unit = str(text).strip().partition(" ")
    if unit.strip() not in units:
        raise SpecError("UnitMismatch", what, f"{text!r} needs one of {sorted(units)}")
    return float(number) * units[unit.strip()]


@dataclass
class Sample:
    process: str
    files: list[str]
    signal: bool = False
    data: bool = False
    xsec: float | None = None
    sumw: float | None = None

    def factor(self, lumi: float) -> float:
        """What each of its events counts: cross section times luminosity over the sum of weights, 1 for data."""
        return 1.0 if self.data else self.xsec * lumi / self.sumw


@dataclass
class SampleTable:
    lumi: float
    samples: list[Sample]

    def processes(self) -> list[str]:
        """Signals first, then backgrounds, in the table's order."""
        names = [s.process for s in self.samples if s.signal] + [s.process for s in self.samples if not s.signal and not s.data]
        return list(dict.fromkeys(names))


def from_dict(raw: dict) -> SampleTable:
    lumi = quantity(raw["lumi"] if "lumi" in raw else raw["luminosity"], LUMI, "luminosity")
    out = []
    for s in raw.get("sample", []):
        data = bool(s.get("data"))
        if data and any(k in s for k in ("xsec", "sumw", "signal")):
            raise SpecError("InvalidExpression", s["process"], "data has no cross section, sum of weights or signal")
        one = Sample(s["process"], list(s.get("files", [])), bool(s.get("signal")), data)
        if not data:
            one.xsec, one.sumw = quantity(s["xsec"], XSEC, s["process"]), float(s["sumw"])
            if not one.sumw > 0:
                raise SpecError("InvalidExpression", s["process"], "the sum of weights must be positive")
        out.append(one)
    if not any(s.signal for s in out):
        raise SpecError("InvalidExpression", "samples", "at least one signal is needed")
    return SampleTable(lumi, out)


def load(path: str) -> SampleTable:
    return from_dict(tomllib.loads(Path(path).read_text()))


def run(spec: Spec, table: SampleTable, read: Callable[[Sample], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(histograms by process, report by sample). read gives a sample's events.

    All samples are one plan: their events are tagged and joined end to end, filled once, and sums of each sample are
    multiplied by its factor when they are as small as the histograms. Data becomes the process data_obs.
    """
    events = None
    for i, s in enumerate(table.samples):
        one = read(s).withColumn("__sample", F.lit(i))
        events = one if events is None else events.unionByName(one, allowMissingColumns=True)
    spark = events.sparkSession
    facts = spark.createDataFrame([(i, "data_obs" if s.data else s.process, s.data, float(s.factor(table.lumi))) for i, s in enumerate(table.samples)], "__sample int, process string, data boolean, factor double")
    plan = Plan(spec, events, ["__sample"])
    # the sums by bin are few; histograms and report share them, so the events are evaluated once
    filled = H.fill(plan.fills(), ["__sample", "hist", "variation"]).join(F.broadcast(facts), "__sample").persist()
    scaled = H.add(H.scale(filled, F.col("factor")), ["process"])
    whole = H.frame(spark, {h.name: h.bins for h in spec.histograms}, spec.variations())
    complete = H.complete(scaled, whole, facts.select("process").distinct())
    seen = events.groupBy("__sample").agg(F.count("*").alias("events_read"))
    if spec.histograms:  # each selected event fills each histogram once
        first = (F.col("hist") == spec.histograms[0].name) & (F.col("variation") == "Nominal")
        chosen = filled.filter(first).groupBy("__sample").agg(F.sum("entries").alias("events_selected"))
    else:
        chosen = plan.rows().groupBy("__sample").agg(F.count("*").alias("events_selected"))
    report = facts.join(seen, "__sample", "left").join(chosen, "__sample", "left").fillna(0, ["events_read", "events_selected"])
    return complete, report.select(F.col("__sample").alias("sample"), "process", "events_read", "events_selected", "factor")
