"""Four-vectors and angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.ieee import root_of_positive, wide

TWO_PI = 2 * math.pi


def four_vector(x: Column) -> Column:
    """px, py, pz, e of a struct with pt, eta, phi, mass."""
    pt, eta, phi, mass = (wide(x[a]) for a in ("pt", "eta", "phi", "mass"))
    px, py, pz = pt * F.cos(phi), pt * F.sin(phi), pt * F.sinh(eta)
    return F.struct(px.alias("px"), py.alias("py"), pz.alias("pz"), F.sqrt(px * px + py * py + pz * pz + mass * mass).alias("e"))


def add(a: Column, b: Column) -> Column:
    return F.struct(*[(a[c] + b[c]).alias(c) for c in ("px", "py", "pz", "e")])


def invariant_mass(p: Column) -> Column:
    return root_of_positive(p["e"] * p["e"] - (p["px"] * p["px"] + p["py"] * p["py"] + p["pz"] * p["pz"]))


def transverse(p: Column) -> Column:
    return F.sqrt(p["px"] * p["px"] + p["py"] * p["py"])


def delta_phi(a: Column, b: Column) -> Column:
    """The difference wrapped to (-pi, pi]."""
    d = a - b
    return d - TWO_PI * F.ceil((d - math.pi) / TWO_PI)


def delta_r(a: Column, b: Column) -> Column:
    """Between two structs with eta and phi."""
    deta, dphi = wide(a["eta"]) - wide(b["eta"]), delta_phi(wide(a["phi"]), wide(b["phi"]))
    return F.sqrt(deta * deta + dphi * dphi)


def delta_phi_f32(a: Column, b: Column) -> Column:
    """The difference of two floats, wrapped to [-pi, pi] in single precision."""
    two_pi, pi = F.lit(TWO_PI).cast("float"), F.lit(math.pi).cast("float")
    d = (a - b).cast("float")
    d = F.when(d > pi, (d - two_pi).cast("float")).otherwise(d)
    return F.when(d < -pi, (d + two_pi).cast("float")).otherwise(d)


def delta_r_f32(a: Column, b: Column) -> Column:
    """In single precision at every step."""
    deta = (a["eta"] - b["eta"]).cast("float")
    dphi = delta_phi_f32(a["phi"], b["phi"])
    return F.sqrt(((deta * deta).cast("float") + (dphi * dphi).cast("float")).cast("float")).cast("float")


def varied_jet(pt: Column, eta: Column, phi: Column, mass: Column, scale: Column) -> Column:
    """A jet whose pt and mass are scaled, with its components."""
    p, m = wide(pt) * scale, wide(mass) * scale
    eta, phi = wide(eta), wide(phi)
    parts = {"pt": p, "eta": eta, "phi": phi, "mass": m, "px": p * F.cos(phi), "py": p * F.sin(phi), "pz": p * F.sinh(eta), "e": F.hypot(m, p * F.cosh(eta))}
    return F.struct(*[c.alias(n) for n, c in parts.items()])
