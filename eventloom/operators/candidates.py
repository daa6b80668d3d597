"""Pairs and combinations of an event's objects, and the choice among them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.ieee import compare, finite, wide
from eventloom.operators.kinematics import add, delta_r, four_vector, invariant_mass, transverse

_PART = "struct<object:string,idx:int,pt:double,eta:double,phi:double>"
CANDIDATE = f"struct<mass:double,pt:double,min_delta_r:double,e:double,px:double,py:double,pz:double,constituents:array<{_PART}>>"


def let(x: Column, body) -> Column:
    """body(x) with x computed once, however often the body, or a lambda in it, mentions it."""
    return F.get(F.transform(F.array(x), lambda v: body(v)), F.lit(0))


def by_pt(objects: Column) -> Column:
    """Sorted by falling pt, equal ones in source order."""
    keyed = F.transform(objects, lambda x: F.struct((-wide(x["pt"])).alias("k"), x["idx"].alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def pairs(objects: Column) -> Column:
    """All unordered pairs (l, r), the left one first in the array's order."""

    def of(a: Column) -> Column:
        right = lambda i: F.slice(a, i + 2, F.greatest(F.size(a) - i - 1, F.lit(0)))
        return F.flatten(F.transform(a, lambda x, i: F.transform(right(i), lambda y: F.struct(x.alias("l"), y.alias("r")))))

    return let(objects, of)


def part(name: str, x: Column) -> Column:
    values = {"object": F.lit(name), "idx": x["idx"].cast("int"), **{a: wide(x[a]) for a in ("pt", "eta", "phi")}}
    return F.struct(*[c.alias(n) for n, c in values.items()])


def least_delta_r(parts: Column) -> Column:
    """The least distance among all pairs of constituents; infinite for fewer than two."""
    all_pairs = F.transform(pairs(parts), lambda p: delta_r(p["l"], p["r"]))
    return F.coalesce(F.array_min(all_pairs), F.lit(math.inf))


def candidate(momentum: Column, parts: Column) -> Column:
    """A candidate from a summed four-vector and its constituents."""

    def of(p: Column, c: Column) -> Column:
        return F.struct(
            invariant_mass(p).alias("mass"), transverse(p).alias("pt"), least_delta_r(c).alias("min_delta_r"),
            *[p[a].alias(a) for a in ("e", "px", "py", "pz")], c.alias("constituents"),
        )

    return let(F.struct(momentum.alias("p"), parts.alias("c")), lambda b: of(b["p"], b["c"])).cast(CANDIDATE)


def sound(c: Column) -> Column:
    return finite(c["mass"]) & (c["mass"] > 0)


def opposite_charge(p: Column) -> Column:
    return wide(p["l"]["charge"]) * wide(p["r"]["charge"]) < 0


def pair_quantity(name: str, p: Column) -> Column:
    """dR, leading_pt or subleading_pt of a pair."""
    a, b = wide(p["l"]["pt"]), wide(p["r"]["pt"])
    return {"leading_pt": F.greatest(a, b), "subleading_pt": F.least(a, b)}[name] if name.endswith("pt") else delta_r(p["l"], p["r"])


def candidate_quantity(name: str, c: Column) -> Column:
    """The same of a candidate's constituents; the distance is the least one, the second pt missing for one constituent."""
    if not name.endswith("pt"):
        return c["min_delta_r"]
    falling = F.sort_array(F.transform(c["constituents"], lambda x: x["pt"]), asc=False)
    return F.get(falling, F.lit(1 if "subleading" in name else 0))


def made_from(name: str, p: Column) -> Column:
    momentum = let(F.struct(four_vector(p["l"]).alias("a"), four_vector(p["r"]).alias("b")), lambda v: add(v["a"], v["b"]))
    return candidate(momentum, F.array(part(name, p["l"]), part(name, p["r"])))


def first(candidates: Column) -> Column:
    return F.get(candidates, F.lit(0))


def nearest(candidates: Column, target: float) -> Column:
    """The one whose mass is nearest; the first among equally near ones."""
    start = F.struct(F.lit(math.inf).alias("d"), F.lit(None).cast(CANDIDATE).alias("c"))

    def step(best: Column, x: Column) -> Column:
        d = F.abs(F.lit(target) - x["mass"])
        return F.when(d < best["d"], F.struct(d.alias("d"), x.alias("c"))).otherwise(best)

    return F.aggregate(candidates, start, step, lambda best: best["c"])


def nearest_truncated(candidates: Column, target: float) -> Column:
    """As nearest, but the best mass so far counts without its fraction, from -1 on."""
    start = F.struct(F.lit(-1).alias("m"), F.lit(None).cast(CANDIDATE).alias("c"))

    def step(best: Column, x: Column) -> Column:
        closer = F.abs(F.lit(target) - x["mass"]) < F.abs(F.lit(target) - best["m"].cast("double"))
        whole = F.least(x["mass"], F.lit(2147483647.0)).cast("int")
        return F.when(closer, F.struct(whole.alias("m"), x.alias("c"))).otherwise(best)

    return F.aggregate(candidates, start, step, lambda best: best["c"])


def used(name: str, *others: Column) -> Column:
    """The source indices of `name` in other candidates."""
    none = F.array().cast("array<int>")
    of = [F.coalesce(F.transform(F.filter(c["constituents"], lambda x: x["object"] == name), lambda x: x["idx"]), none) for c in others]
    return F.concat(none, *of)


def pass_all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def either_pair(a: Column, b: Column, leading: float, subleading: float) -> Column:
    """Whether the two hardest objects of either list exceed the thresholds."""

    def one(objects: Column) -> Column:
        falling = F.sort_array(F.transform(objects, lambda x: wide(x["pt"])), asc=False)
        pass_both = compare(">", F.get(falling, F.lit(0)), F.lit(leading)) & compare(">", F.get(falling, F.lit(1)), F.lit(subleading))
        return F.coalesce(pass_both, F.lit(False))

    return one(a) | one(b)


def mass_by_distance(a: Column, b: Column, target: float, closest: bool) -> Column:
    """The mass nearer to the target, or the other one; the right one is nearer in a tie."""
    left_nearer = F.abs(a["mass"] - target) < F.abs(b["mass"] - target)
    return F.when(left_nearer, a["mass"] if closest else b["mass"]).when(~left_nearer, b["mass"] if closest else a["mass"])
