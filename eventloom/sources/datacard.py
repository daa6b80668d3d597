"""Datacards: the text that a statistical fit reads, and the histogram table that it points to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.spec.expr import SpecError


@dataclass
class Process:
    """Inner bins of the nominal histogram and of its variations; flat systematics are (down, up) factors."""

    name: str
    nominal: list[float]
    shapes: dict[str, tuple[list[float], list[float]]] = field(default_factory=dict)
    flat: dict[str, tuple[float, float]] = field(default_factory=dict)
    signal: bool = False


@dataclass
class Channel:
    name: str
    data: list[float]
    processes: list[Process]


def number(value: float) -> str:
    """At most twelve decimals, without zeros at the end."""
    return "0" if value == 0 else f"{value:.12f}".rstrip("0").rstrip(".")


def _check(channels: list[Channel]) -> None:
    names = [c.name for c in channels]
    if not channels or len(set(names)) < len(names):
        raise SpecError("InvalidExpression", "datacard", "channels must be there and have their own names")
    for c in channels:
        own = [p.name for p in c.processes]
        if not own or len(set(own)) < len(own) or "data_obs" in own:
            raise SpecError("InvalidExpression", c.name, "processes must be there and have their own names")
        if not any(p.signal for p in c.processes):
            raise SpecError("InvalidExpression", c.name, "no signal")
        for p in c.processes:
            for shape in [p.nominal, *[s for pair in p.shapes.values() for s in pair]]:
                if len(shape) != len(c.data):
                    raise SpecError("InvalidExpression", f"{c.name}/{p.name}", "binnings differ")


def text(channels: list[Channel], shapes_file: str = "shapes.root") -> str:
    _check(channels)
    columns = [(c, p) for c in channels for p in sorted(c.processes, key=lambda p: not p.signal)]
    order = list(dict.fromkeys(p.name for _, p in sorted(columns, key=lambda x: not x[1].signal)))
    signals = len({p.name for _, p in columns if p.signal})
    index = {n: i - signals + 1 for i, n in enumerate(order)}
    shapes = sorted({s for _, p in columns for s in p.shapes})
    flats = sorted({s for _, p in columns for s in p.flat})
    rule, row = "------------", lambda *words: " ".join(words)
    out = [
        f"imax {len(channels)} number of channels",
        f"jmax {len(order) - 1} number of processes minus 1",
        f"kmax {len(shapes) + len(flats)} number of nuisance parameters",
        rule,
        f"shapes * * {shapes_file} $CHANNEL/$PROCESS $CHANNEL/$PROCESS_$SYSTEMATIC",
        rule,
        row("bin", *[c.name for c in channels]),
        row("observation", *[number(sum(c.data)) for c in channels]),
        rule,
        row("bin", *[c.name for c, _ in columns]),
        row("process", *[p.name for _, p in columns]),
        row("process", *[str(index[p.name]) for _, p in columns]),
        row("rate", *[number(sum(p.nominal)) for _, p in columns]),
        rule,
    ]
    out += [row(s, "shape", *["1" if s in p.shapes else "-" for _, p in columns]) for s in shapes]
    out += [row(s, "lnN", *["/".join(map(number, p.flat[s])) if s in p.flat else "-" for _, p in columns]) for s in flats]
    return "\n".join(out) + "\n"


def from_histograms(hists: DataFrame, hist: str, channel: str, signals: list[str], flat: dict[str, dict[str, tuple[float, float]]] | None = None) -> Channel:
    """One channel from complete histograms by process; hists are as small as bins x variations x processes."""
    found: dict[tuple[str, str], list[float]] = {}
    for r in hists.filter(F.col("hist") == hist).orderBy("process", "variation", "bin").collect():
        found.setdefault((r.process, r.variation), []).append(r.sumw)
    inner = {k: v[1:-1] for k, v in found.items()}
    names = sorted({p for p, _ in inner if p != "data_obs"}, key=lambda p: (p not in signals, p))
    out = []
    for p in names:
        ways = {v.removesuffix("Up") for q, v in inner if q == p and v.endswith("Up")}
        out.append(Process(p, inner[p, "Nominal"], {w: (inner[p, w + "Down"], inner[p, w + "Up"]) for w in ways}, (flat or {}).get(p, {}), p in signals))
    data = inner.get(("data_obs", "Nominal")) or [0.0] * len(next(iter(inner.values())))
    return Channel(channel, data, out)


def shapes_table(hists: DataFrame, channel: str) -> DataFrame:
    """The histogram rows under the names that the card gives them."""
    name = F.concat_ws("/", F.lit(channel), F.concat_ws("_", "process", F.when(F.col("variation") != "Nominal", F.col("variation"))))
    return hists.withColumn("name", name).select("name", "bin", "sumw", "sumw2", "entries", "sumwx", "sumwx2")
