"""The registered queries of the event engine over the event view, and the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom import eventview
from eventloom.operators import candidates as C
from eventloom.operators import heavyflavour as V
from eventloom.operators import histogram as H
from eventloom.operators import kinematics as K
from eventloom.plans.compiler import Plan
from eventloom.spec.model import Spec, from_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MUON = "object m : Muon { pt > 20 GeV; abs(eta) < 2; }\n"
ALL = "object m : Muon { }\n"
GOOD = "good as (select * from mu where pt > 20 and abs(eta) < 2)"


def spec(text: str) -> Spec:
    return from_text("analysis q year 2018;\n" + text, "adl")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums and angles differ in their last bits between engines."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


def with_sql(name: str, tail: str, extra: str = ""):
    """Registers a query and its SQL, which starts with the event view's tables."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        ORACLES[name] = eventview.SQL + ("," + extra if extra else "") + "\n" + tail
        return f

    return put


def by_spec(name: str, text: str, tail: str, extra: str = "") -> None:
    """A query that runs a spec and returns its rows by event."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(Plan(spec(text), eventview.events(spark, sf_dir), ["event"]).rows())

    with_sql(name, tail, extra)(run)


def hists(name: str, text: str, tail: str, extra: str = "") -> None:
    """A query that runs a spec and returns its histograms."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Plan(spec(text), eventview.events(spark, sf_dir)).histograms()
        return rounded(df.select("hist", "variation", "bin", "sumw", "sumw2", "entries", "sumwx", "sumwx2"), 4)

    with_sql(name, tail, extra)(run)


def over_events(name: str, tail: str, extra: str = ""):
    """A query that is a function of the event view."""

    def put(f: Callable[[DataFrame], DataFrame]):
        with_sql(name, tail, extra)(lambda spark, sf_dir: rounded(f(eventview.events(spark, sf_dir))))
        return f

    return put


# ---- scans and sources -------------------------------------------------------------------------------------------


@over_events("S1_full_read", "select event, run, luminosityBlock as ls, HLT_A as hlt, process, (select count(*) from mu where mu.event = ev.event) as n_muon, (select count(*) from jet where jet.event = ev.event) as n_jet from ev")
def _full(ev: DataFrame) -> DataFrame:
    return ev.select("event", "run", F.col("luminosityBlock").alias("ls"), F.col("HLT_A").alias("hlt"), "process", F.size("Muon").cast("long").alias("n_muon"), F.size("Jet").cast("long").alias("n_jet"))


@over_events("S5_entry_range", "select event, process from ev where event between 101 and 900")
def _range(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("event").between(101, 900)).select("event", "process")


@over_events("S11_count_branch", "select event, idx, round(pt, 6) as pt from mu")
@over_events("S11_count_branch_all", "select event, idx, round(pt, 6) as pt from mu")
def _there_and_back(ev: DataFrame) -> DataFrame:
    from eventloom.schema import flatten, to_collections

    again = to_collections(flatten(ev.select("event", "Muon")), {"Muon": ["pt", "eta", "charge"]})
    return again.select("event", F.inline("Muon")).select("event", F.col("idx").cast("long").alias("idx"), F.col("pt").cast("double").alias("pt"))


@over_events("S12_optional_branch", "select event, 1.0 as weight, false as HLT_other, HLT_A as hlt from ev")
def _optional(ev: DataFrame) -> DataFrame:
    from eventloom.schema import optional

    return ev.select("event", optional(ev, "genWeight", 1.0).alias("weight"), optional(ev, "HLT_other", False).alias("HLT_other"), optional(ev, "HLT_A", False).alias("hlt"))


@over_events("S14_preselection", "select event from ev where (select count(*) from mu where mu.event = ev.event and pt > 30 and abs(eta) < 1.5) > 0 and (select count(*) from jet where jet.event = ev.event) > 0")
def _preselection(ev: DataFrame) -> DataFrame:
    from eventloom.sources.events import preselect

    return preselect(ev, F.exists("Muon", lambda m: (m["pt"] > 30) & (F.abs(m["eta"]) < 1.5)) & (F.size("Jet") > 0)).select("event")


@over_events("P8_lumi_mask", "select event, run, luminosityBlock as ls from ev where (run = 1995 and (luminosityBlock between 2 and 4 or luminosityBlock between 7 and 9)) or (run = 1997 and luminosityBlock between 6 and 12)")
def _lumi(ev: DataFrame) -> DataFrame:
    from eventloom.sources.lumi import certified

    return certified(ev, {1995: [(2, 4), (7, 9)], 1997: [(6, 12)]}).select("event", "run", F.col("luminosityBlock").alias("ls"))


@over_events("J17_lumi_semi_join", "select event from ev where run in (1993, 1996) and luminosityBlock between 3 and 5")
def _lumi_join(ev: DataFrame) -> DataFrame:
    from eventloom.sources import lumi

    many = {1993: [(3, 5)], 1996: [(3, 5)], 3000: [(i, i) for i in range(lumi.MOST_INLINE)]}
    return lumi.certified(ev, many).select("event")


# ---- selections, outputs, reductions -----------------------------------------------------------------------------

by_spec("X2_muon_kernel", "object m : Muon { pt > 30 GeV; abs(eta) < 2.4; }\nregion r { count(m) >= 1; }\noutput n_good_muon = count(m);\noutput lead_muon_pt = leading(m).pt;",
        "select event, cast(count(*) as int) as n_good_muon, round(max(pt), 6) as lead_muon_pt from mu where pt > 30 and abs(eta) < 2.4 group by event")
by_spec("P1_object_selection", MUON + "object l : Muon { (pt * 2) > 90 GeV; charge == 1; }\noutput n = count(m);\noutput k = count(l);",
        "select event, cast(count(*) filter (where pt > 20 and abs(eta) < 2) as int) as n, cast(count(*) filter (where pt * 2 > 90 and charge = 1) as int) as k from ev left join mu using (event) group by event")
by_spec("P3_region_requirement", MUON + "object j : Jet { }\nregion a { count(m) >= 1; sum(m.pt) > 60 GeV; }\nregion b { count(j) < 2; }\noutput n = count(m);",
        "select event, cast(count(*) as int) as n from good where event not in (select event from jet group by event having count(*) >= 2) group by event having sum(pt) > 60", GOOD)
by_spec("P4_event_scalar", MUON + "region a { HLT_A; count(m) >= 1; }\noutput n = count(m);", "select event, cast(count(*) as int) as n from good where event in (select event from ev where HLT_A) group by event", GOOD)
by_spec("P6_missing_value", MUON + "output lead = leading(m).pt;", "select event, round(max(pt), 6) as lead from good group by event", GOOD)
by_spec("A1_count", MUON + "output n = count(m);", "select event, cast(count(good.event) as int) as n from ev left join good using (event) group by event", GOOD)
by_spec("A2_count_where", MUON + "output n = count(m, charge == -1);", "select event, cast(count(*) filter (where charge = -1) as int) as n from ev left join good using (event) group by event", GOOD)
by_spec("A3_sum_attr", MUON + "output s = sum(m.pt);\noutput q = sum(m.charge);", "select event, round(coalesce(sum(pt), 0), 6) as s, cast(coalesce(sum(charge), 0) as double) as q from ev left join good using (event) group by event", GOOD)
by_spec("A4_all", MUON + "region r { all(m, iso < 0.3); }\noutput n = count(m);", "select event, cast(count(good.event) as int) as n from ev left join good using (event) group by event having coalesce(bool_and(iso < 0.3::double), true)", GOOD)
by_spec("A5_any", MUON + "region r { any(m, iso < 0.1); }\noutput n = count(m);", "select event, cast(count(*) as int) as n from good group by event having bool_or(iso < 0.1::double)", GOOD)
by_spec("A6_leading_attr", MUON + "output e = leading(m).eta;\noutput i = leading(m).iso;", "select event, round(max(eta), 6) as e, round(max(iso), 6) as i from good group by event", GOOD)
by_spec("A7_either_pair_pt", ALL + "object j : Jet { }\nregion r { either_pair_pt(m, j, 60 GeV, 50 GeV); }\noutput n = count(m);",
        "select event, cast((select count(*) from mu where mu.event = ev.event) as int) as n from ev where event in (select event from ranked where (k = 1 and pt > 60) or (k = 2 and pt > 50) group by event, kind having count(*) = 2)",
        "ranked as (select event, kind, pt, row_number() over (partition by event, kind order by pt desc) as k from obj)")
by_spec("M1_arithmetic", ALL + "output a = ((sum(m.pt) + sum(m.iso)) - 3);\noutput b = (sum(m.pt) / count(m));\noutput c = (count(m) ^ 2);\noutput d = abs(sum(m.eta));\noutput f = sqrt(sum(m.pt));",
        "select event, round(coalesce(sum(pt), 0) + coalesce(sum(iso), 0) - 3, 6) as a, round(case when count(mu.event) = 0 then 'nan'::double else sum(pt) / count(mu.event) end, 6) as b, cast(count(mu.event) as double) ** 2 as c, round(abs(coalesce(sum(eta), 0)), 6) as d, round(sqrt(coalesce(sum(pt), 0)), 6) as f from ev left join mu using (event) group by event")


@over_events("A10_ht", "select event, round(sum(pt), 4) as ht from jet where pt > 25 group by event")
def _ht(ev: DataFrame) -> DataFrame:
    jets = F.filter("Jet", lambda x: x["pt"] > 25)
    return ev.select("event", F.size(jets).alias("n"), F.round(F.aggregate(jets, F.lit(0.0), lambda a, x: a + x["pt"].cast("double")), 4).alias("ht")).filter("n > 0").drop("n")


@over_events("A11_sort_by_pt", "select event, list(pt order by pt desc, idx) as pts from mu group by event")
def _sorted(ev: DataFrame) -> DataFrame:
    return ev.filter(F.size("Muon") > 0).select("event", F.transform(C.by_pt(F.col("Muon")), lambda x: x["pt"].cast("double")).alias("pts"))


@over_events("A12_leading_object", "select event, idx, round(pt, 6) as pt, charge from (select *, row_number() over (partition by event order by pt desc, idx) as k from jet) where k = 1")
def _leading(ev: DataFrame) -> DataFrame:
    top = F.get(C.by_pt(F.col("Jet")), F.lit(0))
    return ev.select("event", top.alias("t")).filter("t is not null").select("event", F.col("t.idx").cast("long").alias("idx"), F.col("t.pt").cast("double").alias("pt"), "t.charge")


@over_events("A13_index_dereference", "select a.event, a.idx, round(b.pt, 6) as other_pt from mu a left join jet b on b.event = a.event and b.idx = a.idx - 1")
def _deref(ev: DataFrame) -> DataFrame:
    jet = F.when(F.col("m.idx") >= 1, F.get("Jet", F.col("m.idx") - 1))
    return ev.select("event", "Jet", F.explode("Muon").alias("m")).select("event", F.col("m.idx").cast("long").alias("idx"), jet["pt"].cast("double").alias("other_pt"))


# ---- four-vectors, pairs, candidates -----------------------------------------------------------------------------

_V = "round({0}, 5) as {1}"


@over_events("M9_four_vector", "select event, idx, round(px, 5) as px, round(py, 5) as py, round(pz, 5) as pz, round(e, 5) as e from muv")
def _vectors(ev: DataFrame) -> DataFrame:
    p = ev.select("event", F.explode("Muon").alias("m")).select("event", F.col("m.idx").cast("long").alias("idx"), K.four_vector(F.col("m")).alias("p"))
    return p.select("event", "idx", *[F.round(f"p.{c}", 5).alias(c) for c in ("px", "py", "pz", "e")])


PAIRS = """pair as (
  select a.event, a.idx as i, b.idx as j, a.pt as pt1, b.pt as pt2, a.charge * b.charge as q,
    sqrt(greatest((a.e + b.e) * (a.e + b.e) - ((a.px + b.px) * (a.px + b.px) + (a.py + b.py) * (a.py + b.py) + (a.pz + b.pz) * (a.pz + b.pz)), 0)) as m,
    sqrt((a.px + b.px) * (a.px + b.px) + (a.py + b.py) * (a.py + b.py)) as pt,
    sqrt((a.eta - b.eta) * (a.eta - b.eta) + pow((a.phi - b.phi) - 2 * pi() * ceil(((a.phi - b.phi) - pi()) / (2 * pi())), 2)) as dr
  from muv a join muv b on a.event = b.event and (a.pt > b.pt or (a.pt = b.pt and a.idx < b.idx))
), ranked as (select *, row_number() over (partition by event order by pt1 desc, i, pt2 desc, j) as k from pair where q < 0 and m > 0)"""
OS = "object z : pair(m) { opposite_charge; "


@over_events("J1_pairs", "select event, least(i, j) as i, greatest(i, j) as j, round(m, 4) as m, round(dr, 5) as dr from pair", PAIRS)
def _pairs(ev: DataFrame) -> DataFrame:
    rows = ev.select("event", F.explode(C.pairs(F.col("Muon"))).alias("p"))
    mass = K.invariant_mass(K.add(K.four_vector(F.col("p.l")), K.four_vector(F.col("p.r"))))
    return rows.select("event", F.col("p.l.idx").cast("long").alias("i"), F.col("p.r.idx").cast("long").alias("j"), F.round(mass, 4).alias("m"), F.round(K.delta_r(F.col("p.l"), F.col("p.r")), 5).alias("dr"))


@over_events("M11_delta_r", "select event, round(dr, 5) as dr from pair where least(i, j) = 0 and greatest(i, j) = 1", PAIRS)
def _delta_r(ev: DataFrame) -> DataFrame:
    a, b = F.get("Muon", F.lit(0)), F.get("Muon", F.lit(1))
    return ev.filter(F.size("Muon") > 1).select("event", F.round(K.delta_r(a, b), 5).alias("dr"))


by_spec("J2_opposite_charge", ALL + OS + "}\noutput mass = z.mass;\noutput pt = z.pt;", "select event, round(m, 6) as mass, round(pt, 6) as pt from ranked where k = 1", PAIRS)
by_spec("J4_pair_filters", ALL + OS + "filter dR > 1.5; filter leading_pt > 40 GeV; filter subleading_pt > 30 GeV; selection leading_pt; }\noutput mass = z.mass;\noutput dr = z.min_delta_r;",
        "select event, round(m, 6) as mass, round(dr, 6) as dr from (select *, row_number() over (partition by event order by pt1 desc, i, pt2 desc, j) as n from ranked where dr > 1.5 and pt1 > 40 and pt2 > 30) where n = 1", PAIRS)
by_spec("J6_nearest_mass", ALL + OS + "nearest_mass 91.1876 GeV; }\nregion r { z.mass >= 70 GeV; z.mass <= 110 GeV; z.pt > 15 GeV; }\noutput mass = z.mass;",
        "select event, round(m, 6) as mass from (select *, row_number() over (partition by event order by abs(91.1876::double - m), k) as n from ranked) where n = 1 and m >= 70 and m <= 110 and pt > 15", PAIRS)
SOURCE_ORDER = PAIRS + """, src as (
  select event, m, least(i, j) as i, greatest(i, j) as j, row_number() over (partition by event order by least(i, j), greatest(i, j)) as n from ranked
), steps as (
  with recursive fold as (
    select event, 0::bigint as n, -1::bigint as best, null::double as m, null::bigint as i, null::bigint as j from (select distinct event from src)
    union all
    select f.event, s.n, case when abs(91.2::double - s.m) < abs(91.2::double - f.best) then cast(trunc(s.m) as bigint) else f.best end,
      case when abs(91.2::double - s.m) < abs(91.2::double - f.best) then s.m else f.m end,
      case when abs(91.2::double - s.m) < abs(91.2::double - f.best) then s.i else f.i end,
      case when abs(91.2::double - s.m) < abs(91.2::double - f.best) then s.j else f.j end
    from fold f join src s on s.event = f.event and s.n = f.n + 1
  ) select * from fold
)"""
by_spec("J7_nearest_mass_truncated", ALL + OS + "nearest_mass_truncated 91.2 GeV; }\noutput mass = z.mass;",
        "select event, round(arg_max(m, n), 6) as mass from steps group by event having arg_max(m, n) is not null", SOURCE_ORDER)
FOUR = SOURCE_ORDER + """, one as (
  select event, arg_max(m, n) as m, arg_max(i, n) as i, arg_max(j, n) as j from steps where m is not null group by event
), two as (
  select one.event, one.m as m1, one.i as a, one.j as b, arg_min(r.m, r.k) as m2, arg_min(r.i, r.k) as c, arg_min(r.j, r.k) as d
  from one join ranked r on r.event = one.event and r.i not in (one.i, one.j) and r.j not in (one.i, one.j) group by all
), four as (
  select two.event, any_value(m1) as m1, any_value(m2) as m2, sum(e) as e, sum(px) as x, sum(py) as y, sum(pz) as z
  from two join muv on muv.event = two.event and idx in (a, b, c, d) group by two.event
)"""
FOUR_SPEC = ALL + OS + """nearest_mass_truncated 91.2 GeV; }
object y : pair(m) { opposite_charge; exclude z; }
object h : combine(z, y) { }
region r { count(m) >= 4; all(m, abs(eta) < 2.6); z.min_delta_r >= 0.02; y.min_delta_r >= 0.02; closest_mass(z, y, 91.2 GeV) > 20 GeV; other_mass(z, y, 91.2 GeV) > 4 GeV; }
output z1 = closest_mass(z, y, 91.2 GeV);
output z2 = other_mass(z, y, 91.2 GeV);
output mass = h.mass;"""
FOUR_ROWS = """select event, round(case when abs(m1 - 91.2::double) < abs(m2 - 91.2::double) then m1 else m2 end, 6) as z1, round(case when abs(m1 - 91.2::double) < abs(m2 - 91.2::double) then m2 else m1 end, 6) as z2,
  round(sqrt(e * e - (x * x + y * y + z * z)), 6) as mass from four where event in (select event from mu group by event having count(*) >= 4 and bool_and(abs(eta) < 2.6))
  and event not in (select two.event from two join pair p using (event) where p.dr < 0.02 and ((least(i, j) = a and greatest(i, j) = b) or (i = c and j = d)))
  and (case when abs(m1 - 91.2::double) < abs(m2 - 91.2::double) then m1 else m2 end) > 20 and (case when abs(m1 - 91.2::double) < abs(m2 - 91.2::double) then m2 else m1 end) > 4 and e * e > x * x + y * y + z * z"""
by_spec("D2_four_leptons", FOUR_SPEC, FOUR_ROWS, FOUR)
by_spec("J8_exclude", ALL + "object z : pair(m) { opposite_charge; }\nobject y : pair(m) { opposite_charge; exclude z; }\noutput first = z.mass;\noutput second = y.mass;",
        "select event, round(any_value(z.m), 6) as first, round(arg_min(r.m, r.k), 6) as second from ranked z join ranked r using (event) where z.k = 1 and r.i not in (z.i, z.j) and r.j not in (z.i, z.j) group by event", PAIRS)
by_spec("J9_combine", ALL + "object j : Jet { }\nobject c : combine(m, m) { }\nobject d : combine(c, m) { }\noutput two = c.mass;\noutput three = d.mass;\noutput pt = d.pt;",
        """select event, round(two, 6) as two, round(sqrt(greatest(e * e - (x * x + y * y + z * z), 0)), 6) as three, round(sqrt(x * x + y * y), 6) as pt from (
  select event, max(two) as two, sum(e * f) as e, sum(px * f) as x, sum(py * f) as y, sum(pz * f) as z from (select *, 2 - idx as f from muv where idx < 2)
  join (select event, m as two from pair where least(i, j) = 0 and greatest(i, j) = 1 and m > 0) using (event) group by event) where e * e - (x * x + y * y + z * z) > 0""", PAIRS)  # fmt: skip
by_spec("J10_candidate_filters", ALL + "object c : combine(m, m) { filter dR >= 1; filter leading_pt > 40 GeV; filter subleading_pt > 20 GeV; }\noutput mass = c.mass;\noutput dr = c.dR;",
        "select event, round(m, 6) as mass, round(dr, 6) as dr from pair where least(i, j) = 0 and greatest(i, j) = 1 and m > 0 and dr >= 1 and pt1 > 40 and pt2 > 20", PAIRS)
by_spec("J11_min_delta_r", ALL + "object c : combine(m, m, m) { }\noutput dr = c.min_delta_r;",
        "select event, round(min(dr), 6) as dr from pair where i < 3 and j < 3 group by event having count(*) = 3", PAIRS)
by_spec("A8_closest_mass", ALL + "object z : pair(m) { opposite_charge; }\nobject y : pair(m) { opposite_charge; exclude z; }\noutput near = closest_mass(z, y, 91.2 GeV);\noutput far = other_mass(z, y, 91.2 GeV);",
        """select event, round(case when abs(a - 91.2::double) < abs(b - 91.2::double) then a else b end, 6) as near, round(case when abs(a - 91.2::double) < abs(b - 91.2::double) then b else a end, 6) as far from (
  select event, any_value(z.m) as a, arg_min(r.m, r.k) as b from ranked z join ranked r using (event) where z.k = 1 and r.i not in (z.i, z.j) and r.j not in (z.i, z.j) group by event)""", PAIRS)  # fmt: skip


@over_events("J14_lepton_cleaning", "select jet.event, cast(count(*) as int) as n from jet where not exists (select 1 from mu where mu.event = jet.event and sqrt((mu.eta - jet.eta) * (mu.eta - jet.eta) + pow((jet.phi - mu.phi) - 2 * pi() * ceil(((jet.phi - mu.phi) - pi()) / (2 * pi())), 2)) < 1) group by jet.event")
def _cleaned(ev: DataFrame) -> DataFrame:
    clean = F.filter("Jet", lambda j: ~F.exists("Muon", lambda m: K.delta_r(j, m) < 1))
    return ev.select("event", F.size(clean).alias("n")).filter("n > 0")


@over_events("J16_back_to_back", "select jet.event, cast(count(*) as int) as n from jet join mu on mu.event = jet.event and mu.idx = 0 where abs((jet.phi - mu.phi) - 2 * pi() * ceil(((jet.phi - mu.phi) - pi()) / (2 * pi()))) > 2 group by jet.event")
def _opposite(ev: DataFrame) -> DataFrame:
    far = F.filter("Jet", lambda j: F.abs(K.delta_phi(j["phi"].cast("double"), F.get("Muon", F.lit(0))["phi"].cast("double"))) > 2)
    return ev.select("event", F.size(far).alias("n")).filter("n > 0")


# ---- histograms, weights, variations -----------------------------------------------------------------------------

BINNED = """frame as (select h.hist, v.variation, unnest(generate_series(0, h.bins + 1)) as bin from hists h, variations v),
filled as (
  select hist, variation, case when isnan(x) then 1 when x < low then 0 when x >= high then bins + 1 else least(cast(floor((x - low) / (high - low) * bins) as int), bins - 1) + 1 end as bin, x, w, bins
  from fills join hists using (hist)
)"""
SUMS = """select hist, variation, cast(bin as int) as bin, round(coalesce(sum(w), 0), 4) as sumw, round(coalesce(sum(w * w), 0), 4) as sumw2, count(w) as entries,
  round(coalesce(sum(w * x) filter (where bin between 1 and bins), 0), 4) as sumwx, round(coalesce(sum(w * x * x) filter (where bin between 1 and bins), 0), 4) as sumwx2
from frame left join filled using (hist, variation, bin) group by hist, variation, bin"""
NOMINAL = "variations as (select 'Nominal' as variation)"

hists("G1_histogram_fill", ALL + "region r { count(m) >= 1; }\noutput n = count(m);\nhistogram lead { expr = leading(m).pt; bins = 30; range = [10, 70]; }\nhistogram count { expr = count(m); bins = 5; range = [0, 5]; }", SUMS,
      "hists as (select * from (values ('lead', 30, 10.0::double, 70.0::double), ('count', 5, 0.0::double, 5.0::double)) t(hist, bins, low, high)), " + NOMINAL + ", fills as (select 'lead' as hist, 'Nominal' as variation, max(pt) as x, 1.0::double as w from mu group by event union all select 'count', 'Nominal', cast(count(*) as double), 1.0::double from mu group by event), " + BINNED)
hists("W1_event_weight", MUON + "weight nominal [2.0, 0.95];\nregion r { count(m) >= 1; }\nhistogram ht { expr = sum(m.pt); bins = 20; range = [0, 200]; }", SUMS,
      GOOD + ", hists as (select 'ht' as hist, 20 as bins, 0.0::double as low, 200.0::double as high), " + NOMINAL + ", fills as (select 'ht' as hist, 'Nominal' as variation, sum(pt) as x, 1.9::double as w from good group by event), " + BINNED)
hists("W2_weight_systematic", MUON + "weight nominal;\nsystematic muon_weight kind weight up 2.0 down 0.5;\nregion r { count(m) >= 1; }\nhistogram n { expr = count(m); bins = 5; range = [0, 5]; }", SUMS,
      GOOD + ", hists as (select 'n' as hist, 5 as bins, 0.0::double as low, 5.0::double as high), variations as (select * from (values ('Nominal', 1.0::double), ('MuonWeightUp', 2.0::double), ('MuonWeightDown', 0.5::double)) t(variation, f)), fills as (select 'n' as hist, variation, cast(n as double) as x, f as w from (select count(*) as n from good group by event), variations), " + BINNED)
SHAPED = "variations as (select * from (values ('Nominal', 1.0::double), ('JesUp', 1.05::double), ('JesDown', 0.95::double)) t(variation, f)), shaped as (select event, idx, variation, eta, cast(cast(pt * f as float) as double) as pt from mu, variations), picked as (select * from shaped where pt > 30 and abs(eta) < 2)"
hists("W5_shape_systematic", "weight nominal;\ncorrection jes kind scale collection m attr pt up 1.05 down 0.95;\nobject m : Muon { pt > 30 GeV; abs(eta) < 2; }\nregion r { count(m) >= 1; }\nhistogram lead { expr = leading(m).pt; bins = 20; range = [30, 130]; }", SUMS,
      "hists as (select 'lead' as hist, 20 as bins, 30.0::double as low, 130.0::double as high), " + SHAPED + ", fills as (select 'lead' as hist, variation, max(pt) as x, 1.0::double as w from picked group by event, variation), " + BINNED)


# ---- corrections, channels, samples ------------------------------------------------------------------------------

hists("G14_mass_counts", FOUR_SPEC.split("output")[0] + "histogram mass { expr = h.mass; bins = 11; range = [40, 260]; }", SUMS,
      FOUR + ", rows4 as (" + FOUR_ROWS.replace("round(sqrt(e * e - (x * x + y * y + z * z)), 6)", "sqrt(e * e - (x * x + y * y + z * z))") + "), hists as (select 'mass' as hist, 11 as bins, 40.0::double as low, 260.0::double as high), variations as (select 'Nominal' as variation), fills as (select 'mass' as hist, 'Nominal' as variation, mass as x, 1.0::double as w from rows4), " + BINNED)


def payload_spec(text: str) -> Spec:
    out = spec(text)
    out.folder = str(Path(__file__).parent / "payloads")
    return out


def payload_hists(name: str, text: str, tail: str, extra: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Plan(payload_spec(text), eventview.events(spark, sf_dir)).histograms()
        return rounded(df.select("hist", "variation", "bin", "sumw", "sumw2", "entries", "sumwx", "sumwx2"), 4)

    with_sql(name, tail, extra)(run)


SF = "case when eta < 0.1::double then (case when pt < 40 then 0.9::double else 0.95::double end) else 1.1::double end"
payload_hists("W7_scale_factor", MUON + "correction view_sf kind scale_factor file view.json correction view_sf collection m input eta from eta input pt from pt systematic kind nominal nominal up more down less;\nregion r { count(m) >= 1; }\nhistogram n { expr = count(m); bins = 4; range = [0, 4]; }", SUMS,
              GOOD + ", hists as (select 'n' as hist, 4 as bins, 0.0::double as low, 4.0::double as high), variations as (select unnest(['Nominal', 'ViewSfUp', 'ViewSfDown']) as variation), fills as (select 'n' as hist, variation, cast(count(*) as double) as x, product(case variation when 'Nominal' then " + SF + " when 'ViewSfUp' then 1.2::double else 0.8::double end) as w from good, variations group by event, variation), " + BINNED)
UNC = "case when eta < -3 or eta >= 3 then 0.5::double when eta < 0.1::double then 0.1::double else 0.02::double + 3.0::double / (pt + eta) end"
payload_hists("W6_jes_payload", "correction jes_total kind jes file view.json correction view_unc collection m attr pt input eta from eta input pt from pt;\nobject m : Muon { pt > 30 GeV; }\nregion r { count(m) >= 1; }\nhistogram ht { expr = sum(m.pt); bins = 10; range = [0, 300]; }", SUMS,
              "hists as (select 'ht' as hist, 10 as bins, 0.0::double as low, 300.0::double as high), variations as (select * from (values ('Nominal', 0), ('JesTotalUp', 1), ('JesTotalDown', -1)) t(variation, s)), shaped as (select event, variation, cast(cast(pt * (1.0::double + s * (" + UNC + ")) as float) as double) as pt from mu, variations), fills as (select 'ht' as hist, variation, sum(pt) as x, 1.0::double as w from shaped where pt > 30 group by event, variation), " + BINNED)


@over_events("C2_correction_lookup", f"select event, idx, round({SF}, 6) as sf, round({UNC}, 6) as unc from mu")
def _lookup(ev: DataFrame) -> DataFrame:
    from eventloom.functions.corrections import correction, load_corrections

    found = load_corrections(str(Path(__file__).parent / "payloads" / "view.json"))
    rows = ev.select("event", F.explode("Muon").alias("m")).select("event", F.col("m.idx").cast("long").alias("idx"), F.col("m.eta").cast("double").alias("eta"), F.col("m.pt").cast("double").alias("pt"))
    at = {"eta": F.col("eta"), "pt": F.col("pt")}
    return rows.select("event", "idx", correction(found["view_sf"], at | {"kind": F.lit("nominal")}).alias("sf"), correction(found["view_unc"], at).alias("unc"))


@over_events("M17_formula", "select event, idx, round(0.5 * pt ^ 2 + exp(-eta) - greatest(3, sqrt(pt)) / (1 + abs(phi)), 4) as y from mu")
def _formula(ev: DataFrame) -> DataFrame:
    from eventloom.functions.formula import compile_formula

    rows = ev.select("event", F.explode("Muon").alias("m"))
    y = compile_formula("0.5*x^2 + TMath::Exp(-y) - max(3, sqrt(x))/([0]+abs(phi))", ["pt", "eta", "phi"], [F.col("m.pt").cast("double"), F.col("m.eta").cast("double"), F.col("m.phi").cast("double")], [1.0])
    return rows.select("event", F.col("m.idx").cast("long").alias("idx"), F.round(y, 4).alias("y"))


UNION = """
[analysis]
name = "u"
year = "2018"
[[channel]]
name = "two"
[channel.objects.a]
source = "Muon"
cuts = ["pt > 20 GeV"]
[channel.regions.r]
require = ["count(a) == 2"]
[[channel.outputs]]
name = "n"
expr = "count(a)"
[[channel.outputs]]
name = "s"
expr = "sum(a.pt)"
[[channel]]
name = "jets"
[channel.objects.b]
source = "Jet"
cuts = ["pt > 30 GeV"]
[channel.regions.r]
require = ["count(b) >= 1", "sum(b.pt) > 80 GeV"]
[[channel.outputs]]
name = "n"
expr = "count(b)"
[[channel.outputs]]
name = "s"
expr = "sum(b.pt)"
"""


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Plan(from_text(UNION, "toml"), eventview.events(spark, sf_dir), ["event"]).rows())


with_sql("U1_channels", "select event, 'two' as channel, cast(count(*) as int) as n, round(sum(pt), 6) as s from mu where pt > 20 group by event having count(*) = 2 union all select event, 'jets', cast(count(*) as int), round(sum(pt), 6) from jet where pt > 30 group by event having sum(pt) > 80")(_union)


def _varied_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10: a skim's rows with the variation that they belong to."""
    text = "weight nominal;\ncorrection jes kind scale collection m attr pt up 1.05 down 0.95;\nobject m : Muon { pt > 30 GeV; abs(eta) < 2; }\nregion r { count(m) >= 1; }\noutput lead = leading(m).pt;"
    return rounded(Plan(spec(text), eventview.events(spark, sf_dir), ["event"]).varied_rows(), 4)


with_sql("K10_rows_by_variation", "select event, variation, round(max(pt), 4) as lead from picked group by event, variation", SHAPED)(_varied_rows)

STACK = MUON + "region r { count(m) >= 1; }\nhistogram lead { expr = leading(m).pt; bins = 12; range = [20, 80]; }"


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from eventloom.sources import samples

    ev = eventview.events(spark, sf_dir)
    table = samples.SampleTable(10.0, [samples.Sample("signal", [], True, False, 0.5, 10.0), samples.Sample("background", [], False, False, 2000.0, 40.0), samples.Sample("data", [], False, True)])
    return samples.run(spec(STACK), table, lambda s: ev.filter(F.col("process") == s.process))


_FACTORS = "factors as (select * from (values ('signal', 'signal', 0.5::double, 0), ('background', 'background', 500.0::double, 1), ('data', 'data_obs', 1.0::double, 2)) t(process, name, f, sample))"


def _stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_samples(spark, sf_dir)[0].select("process", "hist", "variation", "bin", "sumw", "sumw2", "entries"), 4)


with_sql("G10_normalised_samples", "select p.name as process, 'lead' as hist, 'Nominal' as variation, cast(b.bin as int) as bin, round(coalesce(sum(f), 0), 4) as sumw, round(coalesce(sum(f * f), 0), 4) as sumw2, count(f) as entries from factors p cross join (select unnest(generate_series(0, 13)) as bin) b left join (select process, case when x < 20 then 0 when x >= 80 then 13 else cast(floor((x - 20) / 60 * 12) as int) + 1 end as bin, 1 as one from (select event, max(pt) as x from good group by event) join ev using (event)) l on l.process = p.process and l.bin = b.bin left join (select process as q, f as g from factors) on q = l.process group by p.name, b.bin, f"
         .replace("sum(f)", "sum(g)").replace("sum(f * f)", "sum(g * g)").replace("count(f)", "count(g)"), GOOD + ", " + _FACTORS)(_stacked)
with_sql("G11_sample_report", "select sample, name as process, count(*) as events_read, count(*) filter (where event in (select event from good)) as events_selected, any_value(f) as factor from ev join factors using (process) group by sample, name", GOOD + ", " + _FACTORS)(lambda spark, sf_dir: _samples(spark, sf_dir)[1])


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.rate(_samples(spark, sf_dir)[0], ["process"]).select("process", "rate"), 4)


with_sql("G12_rate", "select name as process, round(sum(f) filter (where x >= 20 and x < 80), 4) as rate from (select event, max(pt) as x from good group by event) join ev using (event) join factors using (process) group by name", GOOD + ", " + _FACTORS)(_rates)


@over_events("G7_cutflow", "select (select count(*) from ev) as events_seen, (select count(distinct event) from good) as events_selected", GOOD)
def _cutflow(ev: DataFrame) -> DataFrame:
    return Plan(spec(MUON + "region r { count(m) >= 1; }\noutput n = count(m);"), ev).cutflow()


@over_events("G15_checksums", "select count(*) as events, cast(sum((select count(*) from mu where mu.event = ev.event)) as bigint) as muons, (select cast(sum(cast(round(pt * 1000) as bigint)) as bigint) from mu) as milli from ev")
def _checksums(ev: DataFrame) -> DataFrame:
    milli = F.aggregate("Muon", F.lit(0).cast("long"), lambda a, x: a + F.round(x["pt"].cast("double") * 1000).cast("long"))
    return ev.agg(F.count("*").alias("events"), F.sum(F.size("Muon")).alias("muons"), F.sum(milli).alias("milli"))


# ---- the heavy-flavour channel's operators -----------------------------------------------------------------------


@over_events("P9_trigger_or", "select event from ev where HLT_A")
def _trigger(ev: DataFrame) -> DataFrame:
    return ev.filter(V.pass_trigger(ev, ["HLT_A", "HLT_absent"])).select("event")


@over_events("P10_met_filters", "select event, HLT_A as v2016, HLT_A and is_mc as v2018, false as v2022 from ev")
def _filters(ev: DataFrame) -> DataFrame:
    flags = {n: F.col("HLT_A") for n in V.COMMON_FILTERS} | {n: F.lit(True) for n in ("Flag_HBHENoiseFilter", "Flag_HBHENoiseIsoFilter")} | {"Flag_ecalBadCalibFilter": F.col("is_mc")}
    df = ev.withColumns(flags)
    return df.select("event", *[V.met_filters(df, era).alias(f"v{era}") for era in ("2016", "2018", "2022")])


@over_events("P11_jet_id", "select event, idx, (cast(iso * 100 as int) & 2) <> 0 as v9, (cast(iso * 100 as int) & 4) <> 0 as v9veto, (cast(iso * 100 as int) & 2) <> 0 and iso < 0.8::double as v12veto from jet")
def _jet_id(ev: DataFrame) -> DataFrame:
    jets = F.transform("Jet", lambda x: x.withField("jetId", F.round(x["iso"].cast("double") * 100).cast("int")).withField("muEF", x["iso"]))
    rows = ev.select("event", F.explode(jets).alias("j"))
    one = lambda version, veto: V.jet_id(F.col("j"), {"jetId", "muEF"}, version, veto)
    return rows.select("event", F.col("j.idx").cast("long").alias("idx"), one("v9", False).alias("v9"), one("v9", True).alias("v9veto"), one("v12", True).alias("v12veto"))


GEN = """gen as (select event, idx, case when idx = 0 then 6 when charge > 0 then 6 else 5 end as pdgId, case when idx = 0 then -1 else cast(floor((idx - 1) / 2) as bigint) end as mother, pt, eta, phi from mu),
following as (select g.event, g.idx, min(d.idx) as after from gen g join gen d on d.event = g.event and d.mother = g.idx and d.pdgId = g.pdgId group by g.event, g.idx),
chain as (
  with recursive c as (select event, idx as first, idx as place from gen union all select c.event, c.first, f.after from c join following f on f.event = c.event and f.idx = c.place)
  select event, first, max(place) as last from c group by event, first
)"""


def _gen() -> Column:
    kind = lambda x: F.when(x["idx"] == 0, 6).when(x["charge"] > 0, 6).otherwise(5)
    mother = lambda x: F.when(x["idx"] == 0, -1).otherwise(F.floor((x["idx"] - 1) / 2)).cast("int")
    return F.transform("Muon", lambda x: F.struct(x["idx"].alias("idx"), kind(x).alias("pdgId"), mother(x).alias("genPartIdxMother"), F.lit(V.LAST_COPY).alias("statusFlags"), x["pt"].alias("pt"), x["eta"].alias("eta"), x["phi"].alias("phi")))


@over_events("A14_children", "select event, idx, cast((select count(*) from gen d where d.event = gen.event and d.mother = gen.idx) as int) as n from gen", GEN)
def _children(ev: DataFrame) -> DataFrame:
    return ev.select("event", F.posexplode(V.children(_gen())).alias("idx", "d")).select("event", F.col("idx").cast("long").alias("idx"), F.size("d").alias("n"))


@over_events("A15_last_copy", "select event, first as idx, last from chain", GEN)
def _last(ev: DataFrame) -> DataFrame:
    df = ev.filter(F.size("Muon") > 0).withColumn("g", _gen()).withColumn("d", V.children(F.col("g")))
    return df.select("event", F.posexplode(V.last_copies(F.col("g"), F.col("d"))).alias("idx", "last")).select("event", F.col("idx").cast("long").alias("idx"), F.col("last").cast("long").alias("last"))


@over_events("A16_hadronic", "select event, idx, exists (select 1 from gen d where d.event = gen.event and d.mother = gen.idx and abs(d.pdgId) < 6) as hadronic from gen", GEN)
def _hadronic(ev: DataFrame) -> DataFrame:
    df = ev.withColumn("g", _gen()).withColumn("d", V.children(F.col("g")))
    flags = F.transform("g", lambda p, i: V.hadronic(i, F.col("g"), F.col("d")))
    return df.select("event", F.posexplode(flags).alias("idx", "hadronic")).withColumn("idx", F.col("idx").cast("long"))


@over_events("J13_closest_index", "select event, j as idx, coalesce(arg_min(m, struct_pack(a := dr, b := m)), -1) as nearest, round(coalesce(min(dr), 1000), 4) as dr from (select jet.event, jet.idx as j, mu.idx as m, sqrt((mu.eta - jet.eta) * (mu.eta - jet.eta) + pow((jet.phi - mu.phi) - 2 * pi() * round((jet.phi - mu.phi) / (2 * pi())), 2)) as dr from jet left join mu on mu.event = jet.event) group by event, j")
def _closest(ev: DataFrame) -> DataFrame:
    near = F.transform("Jet", lambda j: V.closest(j, F.col("Muon")))
    rows = ev.select("event", F.posexplode(near).alias("idx", "n"))
    return rows.select("event", F.col("idx").cast("long").alias("idx"), F.col("n.idx").cast("long").alias("nearest"), F.round(F.col("n.dr").cast("double"), 4).alias("dr"))


@over_events("C8_varied_jets", "select event, idx, round(cast(cast(pt * 1.1::double as float) as double), 4) as pt, round(cast(cast(mass * 1.1::double as float) as double), 6) as mass from jet where cast(cast(pt * 1.1::double as float) as double) > 30 and abs(eta) < 2.4")
def _varied(ev: DataFrame) -> DataFrame:
    jets = V.varied_selection(V.scaled_jets(F.col("Jet"), lambda x: F.lit(1.1)))
    return ev.select("event", F.explode(jets).alias("j")).select("event", F.col("j.idx").cast("long").alias("idx"), F.round(F.col("j.pt").cast("double"), 4).alias("pt"), F.round(F.col("j.mass").cast("double"), 6).alias("mass"))


@over_events("M20_smearing_seed", "select ev.event, (((cast(run as bigint) << 20) + (cast(luminosityBlock as bigint) << 10) + ev.event + cast(trunc(coalesce(eta, 0) / 0.01::double) as bigint)) & 2147483647) as seed from ev left join jet on jet.event = ev.event and idx = 0")
def _seed(ev: DataFrame) -> DataFrame:
    first = F.coalesce(F.get("Jet", F.lit(0))["eta"], F.lit(0.0))
    return ev.select("event", V.smearing_seed(F.col("run"), F.col("luminosityBlock"), F.col("event"), first).alias("seed"))


TOP_WEIGHT = "(0.103::double * exp(-0.0118::double * least(greatest(pt, 0), 2000)) - 0.000134::double * least(greatest(pt, 0), 2000) + 0.973::double)"


@over_events("C10_pileup_weight", "select event, case when is_mc then greatest(0.0, least(10.0, least(99.0, greatest(0.0, 30.0 * (select count(*) from mu where mu.event = ev.event))) * 0.2))::double else 1.0::double end as w from ev")
def _pileup(ev: DataFrame) -> DataFrame:
    return ev.select("event", V.pileup_weight(30 * F.size("Muon"), lambda n: n * 0.2, F.col("is_mc")).alias("w"))


@over_events("C11_top_pt_weight", "select event, round(case when is_mc and event in (select event from gen where pdgId = 6 group by event having count(*) = 2) then sqrt((select product(" + TOP_WEIGHT + ") from gen where gen.event = ev.event and pdgId = 6)) else 1.0 end, 6) as w from ev", GEN)
def _top_weight(ev: DataFrame) -> DataFrame:
    return ev.select("event", V.top_pt_weight(_gen(), "2018", F.col("is_mc")).alias("w"))


@over_events("C12_jet_veto", "select event, cast(exists (select 1 from jet where jet.event = ev.event and pt > 15 and (cast(iso * 100 as int) & 2) <> 0 and iso < 0.8::double and eta > 0 and phi > 0) as int) as flag, -99 as before from ev")
def _veto(ev: DataFrame) -> DataFrame:
    jets = F.transform("Jet", lambda x: x.withField("jetId", F.round(x["iso"].cast("double") * 100).cast("int")).withField("muEF", x["iso"]))
    at = lambda eta, phi: ((eta > 0) & (phi > 0)).cast("double")
    flag = lambda era: V.jet_veto_flag(jets, {"jetId", "muEF"}, "v12", era, at)
    return ev.select("event", flag("2022").alias("flag"), flag("2018").alias("before"))


@over_events("C14_prefiring", "select event, case when is_mc then 0.9::double + 0.001::double * luminosityBlock else 1.0::double end as w2017, 1.0::double as w2018 from ev")
def _prefired(ev: DataFrame) -> DataFrame:
    df = ev.withColumn("L1PreFiringWeight_Nom", 0.9 + 0.001 * F.col("luminosityBlock"))
    return df.select("event", *[V.prefiring(df, "Nom", era, F.col("is_mc")).alias(f"w{era}") for era in ("2017", "2018")])


@over_events("M15_varied_jet", "select event, idx, round(pt * 1.05::double * cos(phi), 6) as px, round(pt * 1.05::double * sinh(eta), 6) as pz, round(sqrt(pow(mass * 1.05::double, 2) + pow(pt * 1.05::double * cosh(eta), 2)), 6) as e from jet")
def _varied_one(ev: DataFrame) -> DataFrame:
    rows = ev.select("event", F.explode("Jet").alias("j"))
    v = K.varied_jet(F.col("j.pt"), F.col("j.eta"), F.col("j.phi"), F.col("j.mass"), F.lit(1.05))
    return rows.select("event", F.col("j.idx").cast("long").alias("idx"), v.alias("v")).select("event", "idx", "v.px", "v.pz", "v.e")


@over_events("M14_soft_drop", """select event, round(cast(cast(sqrt(greatest(pow(sum(e), 2) - pow(sum(px), 2) - pow(sum(py), 2) - pow(sum(pz), 2), 0)) as float) as double), 2) as m from (
  select event, pt * cos(phi) as px, pt * sin(phi) as py, pt * sinh(eta) as pz, sqrt(pow(pt * cosh(eta), 2) + mass * mass) as e from jet where idx < 2 and event in (select event from jet where idx = 1)) group by event""")
def _soft_drop(ev: DataFrame) -> DataFrame:
    pair = F.struct(F.lit(0).alias("subJetIdx1"), F.lit(1).alias("subJetIdx2"))
    return ev.filter(F.size("Jet") > 1).select("event", F.round(V.soft_drop_mass(pair, F.col("Jet")).cast("double"), 2).alias("m"))


@over_events("A17_farthest", """select jet.event, jet.idx, round(coalesce(max(sqrt(pow(mu.eta - jet.eta, 2) + pow((jet.phi - mu.phi) - 2 * pi() * round((jet.phi - mu.phi) / (2 * pi())), 2))), 99), 3) as dr
  from jet left join mu on mu.event = jet.event group by jet.event, jet.idx""")
def _farthest(ev: DataFrame) -> DataFrame:
    far = F.transform("Jet", lambda j: V.farthest(j, F.col("Muon")))
    return ev.select("event", F.posexplode(far).alias("idx", "dr")).select("event", F.col("idx").cast("long").alias("idx"), F.round(F.col("dr").cast("double"), 3).alias("dr"))


@over_events("F13_compare", "select 'Muon' as column, 'both' as found, 0::bigint as missing, (select count(*) from ev where event > 1400) as extra, (select count(distinct event) from mu where event <= 1400 and pt > 50) as differing union all select 'event', 'both', 0, (select count(*) from ev where event > 1400), 0")
def _compare(ev: DataFrame) -> DataFrame:
    from eventloom.compare import compare

    ours = ev.select("event", "Muon.pt").withColumnRenamed("pt", "Muon")
    shifted = F.transform("Muon", lambda x: F.when(x > 50, x * 1.001).otherwise(x).cast("float"))
    return compare(ours, ours.filter("event <= 1400").withColumn("Muon", shifted), "event", rtol=1e-4)


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = MUON + "model tagger { inputs Muon_pt, Muon_eta, Muon_phi; output Muon_score; batch Muon; provider mock; }\nregion r { leading(m).score > 0.5; }\noutput n = count(m);\noutput score = leading(m).score;"
    return Plan(spec(text), eventview.events(spark, sf_dir), ["event"]).rows()


QUERIES["I2_mock_scores"] = _tagged


@with_sql("EXT_windowed_events", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.streaming.histograms import windowed_counts

    found = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rounded(found.withColumn("start", F.col("start").cast("timestamp_ntz")), 4)


def _inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: what a manifest's key depends on, for two specs over the same files."""
    from eventloom.sources.events import certificate

    specs = [spec(MUON + "output n = count(m);"), spec("object m : Muon { abs(eta) < 2; pt > 20 GeV; } output n = count(m);"), spec(ALL + "output n = count(m);")]
    keys = [certificate(s)["sha256"] for s in specs]
    return spark.createDataFrame([(i, keys.index(k)) for i, k in enumerate(keys)], "spec long, same_as long")


with_sql("F9_certificates", "select * from (values (0::bigint, 0::bigint), (1, 0), (2, 2)) t(spec, same_as)")(_inverse)
