import json
import math
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom import compare, eventview
from eventloom.functions import corrections, formula, ieee
from eventloom.operators import candidates as C
from eventloom.operators import heavyflavour as V
from eventloom.operators import histogram as H
from eventloom.operators.inference import mock_scores
from eventloom.plans.compiler import Plan
from eventloom.schema import Catalogue, collection, flatten, to_collections
from eventloom.sources import datacard, events, lumi, samples
from eventloom.spec.adl import emit_adl
from eventloom.spec.expr import SpecError, parse_cut, parse_expr, show
from eventloom.spec.model import from_dict, from_text
from eventloom.spec.validate import errors_of, required_branches

MUON = "array<struct<idx:int,pt:float,eta:float,phi:float,mass:float,charge:int>>"
MUON_SPEC = """
[analysis]
name = "central_muons"
year = "2018"
[objects.central]
source = "Muon"
cuts = ["pt > 30 GeV", "abs(eta) < 2.4"]
[regions.some]
require = ["count(central) >= 1"]
[[outputs]]
name = "how_many"
expr = "count(central)"
[[outputs]]
name = "hardest"
expr = "leading(central).pt"
"""
CATALOGUE = Catalogue({f"Muon_{a}": "vec_float" for a in ("pt", "eta", "phi", "mass", "iso")} | {"Muon_charge": "vec_int32", "Muon_tight": "vec_bool", "Muon_time": "vec_double", "Jet_pt": "vec_float", "Jet_eta": "vec_float", "HLT_A": "bool", "run": "uint32", "luminosityBlock": "uint32", "nMuon": "uint32"})


def muons(*events):
    return [(i, [(k, float(pt), float(eta), float(phi), 0.105, q) for k, (pt, eta, phi, q) in enumerate(e)]) for i, e in enumerate(events)]


def frame(spark, rows):
    return spark.createDataFrame(rows, f"event long, Muon {MUON}")


def test_minimal_muon_events(spark):
    rows = muons([(31, 0.1, 0, 1), (10, 0.2, 0, 1)], [(29.9, 0, 0, 1)], [(45, 2.39, 0, 1), (35, -2, 0, 1)], [], [(60, 2.39, 0, 1)])
    got = Plan(from_text(MUON_SPEC, "toml"), frame(spark, rows), ["event"]).rows().orderBy("event").collect()
    assert [tuple(r) for r in got] == [(0, 1, 31.0), (2, 2, 45.0), (4, 1, 60.0)]


def test_results_do_not_depend_on_partitions(spark):
    def event(e):
        return [(12 + (17 * e + 13 * m) % 90, ((7 * e + 5 * m) % 61) / 10 - 3.0, ((11 * e + 3 * m) % 63) / 10 - 3.1, 1 if (e + m) % 2 else -1) for m in range(e % 5)]

    rows = muons(*[event(e) for e in range(400)])
    spec = from_text("analysis a year y; object m : Muon { pt > 20 GeV; } object z : pair(m) { ossf; nearest 91.2 GeV; filter dR > 0.1; } output mass = z.mass; histogram h { expr = z.mass; bins = 10; range = [0, 200]; }", "adl")
    one, many = (Plan(spec, frame(spark, rows).repartition(n), ["event"]) for n in (1, 7))
    assert sorted(one.rows().collect()) == sorted(many.rows().collect()) and one.rows().count() > 50
    plain = Plan(spec, frame(spark, rows).repartition(5)).histograms().agg(F.sum("entries"), F.count("*")).first()
    assert tuple(plain) == (one.rows().count(), 12)


def naive_pairs(objects, target, mode):
    """An independent evaluator of the choice among opposite-charge pairs."""
    order = sorted(range(len(objects)), key=lambda i: -objects[i][0]) if mode != "truncated" else range(len(objects))
    order = list(order)

    def vector(o):
        pt, eta, phi, _ = (np.float32(x).astype(float) if i < 3 else x for i, x in enumerate(o))
        px, py, pz = pt * math.cos(phi), pt * math.sin(phi), pt * math.sinh(eta)
        return np.array([px, py, pz, math.sqrt(px * px + py * py + pz * pz + float(np.float32(0.105)) ** 2)])

    best, kept = None, -1
    for a in range(len(order)):
        for b in range(a + 1, len(order)):
            x, y = objects[order[a]], objects[order[b]]
            if x[3] * y[3] >= 0:
                continue
            v = vector(x) + vector(y)
            m = math.sqrt(max(v[3] ** 2 - v[0] ** 2 - v[1] ** 2 - v[2] ** 2, 0))
            if not m > 0:
                continue
            if mode == "leading":
                return m
            if mode == "nearest" and (best is None or abs(target - m) < abs(target - best)):
                best = m
            if mode == "truncated" and abs(target - m) < abs(target - kept):
                best, kept = m, int(m)
    return best


@pytest.mark.parametrize("mode,words", [("leading", "selection leading_pt"), ("nearest", "nearest_mass 91.2 GeV"), ("truncated", "nearest_mass_truncated 91.2 GeV")])
def test_pair_choices_against_a_naive_evaluator(spark, mode, words):
    rng = np.random.default_rng(4)
    data = [[(float(np.float32(rng.choice([20, 30, 40.5, rng.uniform(5, 80)]))), rng.uniform(-2.4, 2.4), rng.uniform(-3, 3), int(rng.choice([-1, 1, 0]))) for _ in range(rng.integers(0, 6))] for _ in range(150)]
    spec = from_text(f"analysis a year y; object m : Muon {{ }} object z : pair(m) {{ opposite_charge; {words}; }} output mass = z.mass;", "adl")
    got = {r.event: r.mass for r in Plan(spec, frame(spark, muons(*data)), ["event"]).rows().collect()}
    want = {i: m for i, o in enumerate(data) if (m := naive_pairs(o, 91.2, mode)) is not None}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_ieee_rules(spark):
    row = spark.range(1).select(
        ieee.divide(F.lit(1.0), F.lit(0.0)).alias("a"), ieee.divide(F.lit(-1.0), F.lit(0.0)).alias("b"), ieee.divide(F.lit(0.0), F.lit(0.0)).alias("c"),
        *[ieee.compare(op, F.lit(math.nan), F.lit(1.0)).alias(f"c{i}") for i, op in enumerate((">", ">=", "<", "<=", "==", "!="))],
    ).first()
    assert row.a == math.inf and row.b == -math.inf and math.isnan(row.c)
    assert [row[f"c{i}"] for i in range(6)] == [False, False, False, False, False, True]


def test_histogram_edges(spark):
    xs = [-1.0, 0.0, 0.99, 1.0, 9.999999, 10.0, math.nan, math.inf]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    bins = [r[0] for r in df.select(H.bin_of(F.col("x"), F.lit(0.0), F.lit(10.0), F.lit(10))).collect()]
    assert bins == [0, 1, 1, 2, 10, 11, 1, 11]
    assert [r[0] for r in df.select(H.variable_bin(F.col("x"), [0.0, 1.0, 10.0])).collect()] == [0, 1, 1, 2, 2, 3, 1, 3]
    with pytest.raises(SpecError):
        H.check_bins(0, 0, 1)


PAYLOADS = {"schema_version": 2, "corrections": [
    {"name": "sf", "inputs": [{"name": "eta", "type": "real"}, {"name": "pt", "type": "real"}, {"name": "scale_factors", "type": "string"}], "data": {"nodetype": "category", "input": "scale_factors", "content": [
        {"key": k, "value": {"nodetype": "binning", "input": "eta", "edges": [-2.5, 0.0, 2.5], "flow": "clamp", "content": [
            {"nodetype": "binning", "input": "pt", "edges": [0.0, 40.0, 1000.0], "flow": "clamp", "content": [0.94 + d, 0.97 + d]},
            {"nodetype": "binning", "input": "pt", "edges": [0.0, 40.0, 1000.0], "flow": "clamp", "content": [1.05 + d, 1.08 + d]}]}} for k, d in (("nominal", 0.0), ("systup", 0.1), ("systdown", -0.1))]}},
    {"name": "unc", "inputs": [{"name": "eta", "type": "real"}, {"name": "pt", "type": "real"}], "data": {"nodetype": "binning", "input": "eta", "edges": [-5, 0, 5], "flow": "clamp", "content": [
        {"nodetype": "binning", "input": "pt", "edges": [0, 40, 100, 1000], "flow": "clamp", "content": [0.2, 0.05, 0.12]},
        {"nodetype": "binning", "input": "pt", "edges": [0, 40, 100, 1000], "flow": "clamp", "content": [0.1, 0.03, 0.07]}]}},
]}
WORKED = {
    "analysis": {"name": "worked", "year": "2018"},
    "lumi_mask": {"file": "golden.json"},
    "objects": {"good_muon": {"source": "Muon", "cuts": ["pt > 30 GeV", "abs(eta) < 2.4"]}, "good_jet": {"source": "Jet", "cuts": ["pt > 30 GeV", "abs(eta) < 2.4"]}},
    "regions": {"signal": {"require": ["HLT_IsoMu24", "count(good_muon) >= 1", "count(good_jet) >= 1"]}},
    "outputs": [{"name": "n", "expr": "count(good_muon)"}],
    "histogram": [{"name": "jet_pt", "expr": "leading(good_jet).pt", "bins": 3, "range": [30, 180]}],
    "correction": [
        {"name": "jes_total", "kind": "jes", "file": "payloads.json", "correction": "unc", "collection": "good_jet", "attr": "pt", "inputs": [{"name": "eta", "from": "eta"}, {"name": "pt", "from": "pt"}]},
        {"name": "muon_sf", "kind": "scale_factor", "file": "payloads.json", "correction": "sf", "collection": "good_muon", "inputs": [{"name": "eta", "from": "eta"}, {"name": "pt", "from": "pt"}], "systematic": {"name": "scale_factors", "nominal": "nominal", "up": "systup", "down": "systdown"}},
    ],
}
EVENTS = {"a": (1001, 1, 45, 0.1, 78, 1.0), "b": (1001, 2, 45, 0.1, 110, 1.0), "c": (1002, 5, 45, -0.1, 132, -1.0), "d": (1001, 3, 35, 0.2, 60, 1.0), "x": (9999, 1, 45, 0.1, 78, 1.0)}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "payloads.json").write_text(json.dumps(PAYLOADS))
    (tmp_path / "golden.json").write_text(json.dumps({"1001": [[1, 3], [10, 12]], "1002": [[5, 5], [8, 9]]}))
    return tmp_path


def test_worked_example_down_to_the_datacard(spark, folder):
    spec = from_dict(WORKED, str(folder))
    table = samples.from_dict({"lumi": "10 fb^-1", "sample": [
        {"process": "signal", "files": ["a", "c"], "signal": True, "xsec": "0.5 fb", "sumw": 10},
        {"process": "ttbar", "files": ["a", "b", "d"], "xsec": "2 fb", "sumw": 20}, {"process": "ttbar", "files": ["c", "d"], "xsec": "0.001 pb", "sumw": 20},
        {"process": "zjets", "files": ["b", "d"], "xsec": "1 fb", "sumw": 25}, {"process": "data", "files": ["a", "b", "c", "d", "x"], "data": True}]})

    def read(sample):
        rows = [(r, ls, True, [(0, float(p), e)], [(0, float(q), f)]) for r, ls, p, e, q, f in (EVENTS[n] for n in sample.files)]
        return spark.createDataFrame(rows, "run long, luminosityBlock long, HLT_IsoMu24 boolean, Muon array<struct<idx:int,pt:float,eta:float>>, Jet array<struct<idx:int,pt:float,eta:float>>")

    hists, report = samples.run(spec, table, read)
    hists = hists.cache()
    bins = {}
    for r in hists.filter("variation = 'Nominal' and bin between 1 and 3").orderBy("bin").collect():
        bins.setdefault(r.process, []).append(round(r.sumw, 9))
    assert bins == {"signal": [0.54, 0.0, 0.485], "ttbar": [2.655, 1.08, 0.485], "zjets": [0.42, 0.432, 0.0], "data_obs": [2.13, 1.08, 0.97]}
    assert [(r.events_read, r.events_selected, r.factor) for r in report.orderBy("sample").collect()] == [(2, 2, 0.5), (3, 3, 1.0), (2, 2, 0.5), (2, 2, 0.4), (5, 4, 1.0)]
    assert sorted({r.variation for r in hists.select("variation").collect()}) == sorted(["Nominal", "JesTotalUp", "JesTotalDown", "MuonSfUp", "MuonSfDown"])
    card = datacard.text([datacard.from_histograms(hists, "jet_pt", "signal_region", ["signal"])])
    assert card.splitlines()[6:] == [
        "bin signal_region", "observation 4.18", "------------", "bin signal_region signal_region signal_region", "process signal ttbar zjets", "process 0 1 2",
        "rate 1.025 4.22 0.852", "------------", "JesTotal shape 1 1 1", "MuonSf shape 1 1 1",
    ]
    assert card.splitlines()[:3] == ["imax 1 number of channels", "jmax 2 number of processes minus 1", "kmax 2 number of nuisance parameters"]
    names = {r.name for r in datacard.shapes_table(hists, "signal_region").select("name").collect()}
    assert {"signal_region/signal", "signal_region/ttbar_JesTotalUp"} <= names
    shifted = {r.bin: r.sumw for r in hists.filter("process = 'signal' and variation = 'JesTotalDown'").collect()}
    assert shifted[1] == pytest.approx(0.54) and shifted[2] == pytest.approx(0.485)  # 132 GeV falls by 12 % to the second bin


def test_sample_normalisation(spark):
    spec = from_text("analysis a year y; object j : Jet { } output n = count(j); histogram h { expr = leading(j).pt; bins = 2; range = [0, 2]; }", "adl")
    data = {"signal": (0.5, 1000, [0.5, 1.5]), "ttbar_a": (2, 12000, [0.5, 1.5]), "ttbar_b": (1, 6000, [0.5, 0.2, 1.5])}
    table = samples.SampleTable(samples.quantity("3 fb^-1", samples.LUMI, "lumi"), [samples.Sample(n.split("_")[0], [n], n == "signal", False, samples.quantity(f"{x} pb", samples.XSEC, n), s) for n, (x, s, _) in data.items()])
    hists, _ = samples.run(spec, table, lambda s: spark.createDataFrame([([(0, float(p))],) for p in data[s.files[0]][2]], "Jet array<struct<idx:int,pt:float>>"))
    got = {(r.process, r.bin): r.sumw for r in hists.filter("bin between 1 and 2").collect()}
    assert got == {("signal", 1): 1.5, ("signal", 2): 1.5, ("ttbar", 1): 1.5, ("ttbar", 2): 1.0}
    for bad in ({"data": True, "xsec": "1 pb"}, {"xsec": "1 pb", "sumw": 0, "signal": True}, {"xsec": "1 m", "sumw": 1, "signal": True}, {"xsec": "1 pb", "sumw": 1}):
        with pytest.raises(SpecError):
            samples.from_dict({"lumi": "1 fb^-1", "sample": [{"process": "p"} | bad]})


def adl(text):
    return from_text("analysis a year y;\n" + text, "adl")


@pytest.mark.parametrize("text,kind", [
    ("object m : Muon { nothing > 3; }", "MissingBranch"), ("object m : Muon { time > 3; }", "UnsupportedBranchType"), ("object m : Muon { tight > 0; }", "WrongBranchType"),
    ("object m : Muon { pt > 30; }", "MissingUnit"), ("object m : Muon { eta < 2 GeV; }", "UnitMismatch"), ("output n = count(other);", "UndefinedObject"),
    ("object m : Muon { } output n = (sum(m.pt) + sum(m.eta));", "InvalidExpression"), ("region r { run; }", "WrongBranchType"), ("object m : Ghost { }", "MissingBranch"),
    ("object m : Muon { } object z : pair(m) { exclude y; }", "UndefinedObject"), ("object m : Muon { } object z : pair(m) { filter pt > 3 GeV; }", "InvalidExpression"),
    ("object m : Muon { } object a : combine(b, m) { } object b : combine(a, m) { }", "InvalidExpression"),
    ("model t { inputs Muon_pt; output Muon_eta; batch Muon; provider mock; }", "ModelOutputCollision"), ("model t { inputs Muon_pt; output Muon_s; batch Tau; provider mock; }", "UndefinedBatch"),
    ("model t { inputs Jet_pt; output Muon_s; batch Muon; provider mock; }", "InvalidModel"), ("model t { inputs Muon_pt; output Muon_s; batch Muon; provider magic; }", "InvalidProvider"),
])
def test_rejected_specs(text, kind):
    assert kind in {e.kind for e in errors_of(adl(text), CATALOGUE)}


@pytest.mark.parametrize("text", ["object m : Muon { pt > x; }", "object m : Muon { pt >; }", "histogram h { expr = 1; bins = 0; range = [0, 1]; }", "output n;", "systematic s kind other up 1 down 1;", "nonsense;", "object m : Muon { pt > 3 GeV", "output n = 1; output n = 2;"])
def test_unreadable_specs(text):
    with pytest.raises(SpecError):
        adl(text)


def test_required_branches_and_units():
    spec = from_text(MUON_SPEC, "toml")
    assert required_branches(spec, CATALOGUE) == ["Muon_eta", "Muon_pt", "nMuon"] and not errors_of(spec, CATALOGUE)
    with pytest.raises(SpecError):
        required_branches(adl("object m : Muon { pt > 3; }"), CATALOGUE)


def test_one_spec_in_four_languages():
    spec = from_text(MUON_SPEC, "toml")
    import tomllib

    import yaml

    raw = tomllib.loads(MUON_SPEC)
    others = [from_text(json.dumps(raw), "json"), from_text(yaml.safe_dump(raw), "yaml"), from_text(emit_adl(spec), "adl")]
    assert {events.certificate(s)["sha256"] for s in [spec, *others]} == {events.certificate(spec)["sha256"]}
    assert events.manifest(spec, [{"path": "a"}])["key"] != events.manifest(others[0], [{"path": "b"}])["key"]


@pytest.mark.parametrize("text", ["a + b + c * -2 ^ 2", "sqrt(dxy*dxy + dz*dz) / sqrt(3)", "abs(eta) - (1 - 2)", "leading(m).pt", "count(m, charge == -1)", "closest_mass(a, b, 91.2 GeV)"])
def test_shown_expressions_parse_to_the_same(text):
    assert parse_expr(show(parse_expr(text))) == parse_expr(text)


def test_precedence_and_cuts():
    assert show(parse_expr("a - b - c")) == "((a - b) - c)" and show(parse_expr("2 ^ 3 ^ 2")) == "(2 ^ (3 ^ 2))"
    assert show(parse_cut("pt*2 + 1 >= 30 GeV")) == "((pt * 2) + 1) >= 30 GeV"


def test_aliases_and_conjunctions():
    spec = adl("define hard = leading(m).pt; object m : Muon { select pt > 30 GeV and abs(eta) < 2.4; } region r { hard > 40 GeV and count(m) == 2; } output hard;")
    assert len(spec.objects["m"].cuts) == 2 and [show(c) for c in spec.regions["r"]] == ["leading(m).pt > 40 GeV", "count(m) == 2"]


def test_formulas(spark):
    one = lambda text, **v: spark.range(1).select(formula.compile_formula(text, list(v), [F.lit(float(x)) for x in v.values()], [2.0, 5.0])).first()[0]
    assert one("[0]*x^2 - -p[1]/(1+y)", x=3, y=1) == pytest.approx(20.5)
    assert one("TMath::Max(pt, 4) + min(x, x[1]) + pi*0 + exp(0) + log10(100)", pt=3, y=9) == pytest.approx(4 + 3 + 1 + 2)
    assert one("2^3^2", x=0) == 512 and one("-2^2", x=0) == -4
    for bad in ("x+", "foo(x)", "[7]", "x[4]", "q"):
        with pytest.raises(SpecError):
            formula.compile_formula(bad, ["x"], [F.lit(1.0)], [1.0])


def test_corrections(spark, folder):
    found = corrections.load_corrections(str(folder / "payloads.json"))
    points = [(-1.0, 30.0, 0.94), (-1.0, 50.0, 0.97), (0.0, 39.9, 1.05), (9.0, 4000.0, 1.08), (-9.0, -5.0, 0.94)]
    df = spark.createDataFrame(points, "eta double, pt double, want double")
    assert df.filter(F.abs(corrections.muon_id(found["sf"], F.col("pt"), F.col("eta")) - F.col("want")) > 1e-12).count() == 0
    for data in ({"nodetype": "binning", "input": "x", "edges": {"n": 2, "low": 0, "high": 1}, "content": [1, 2]}, {"nodetype": "formularef"}):
        with pytest.raises(SpecError):
            corrections.correction({"name": "p", "inputs": [{"name": "x"}], "data": data}, {"x": F.lit(1.0)})
    outside = {"name": "p", "inputs": [{"name": "x"}], "data": {"nodetype": "binning", "input": "x", "edges": [0, 1], "content": [3], "flow": "error"}}
    with pytest.raises(Exception, match="outside"):
        spark.range(1).select(corrections.correction(outside, {"x": F.lit(2.0)})).collect()
    with pytest.raises(SpecError):
        corrections.check_inputs(found["sf"], ["pt", "eta", "scale_factors"])


def test_lumi_masks(spark, tmp_path):
    for bad in ({"x": [[1, 2]]}, {"1": [[3, 2]]}, {"1": [[1]]}, {"1": [[-1, 2]]}):
        (tmp_path / "m.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            lumi.read_lumi_mask(str(tmp_path / "m.json"))
    df = spark.createDataFrame([(1, 1), (1, 4), (2, 9), (3, 1)], "run long, luminosityBlock long")
    mask = {1: [(1, 3), (2, 5)], 2: [(8, 9)]}
    few = lumi.certified(df, mask).collect()
    many = lumi.certified(df, mask | {7: [(i, i) for i in range(lumi.MOST_INLINE)]}).collect()
    assert sorted(few) == sorted(many) == [(1, 1), (1, 4), (2, 9)]


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def test_mock_scores_and_models(spark):
    values = np.array([[31.0, 0.1], [45.0, -2.0]], dtype=np.float32)
    want = [np.float32(fnv(b"tagger" + b"features" + b"F32" + struct.pack("<Q", 2) + row.tobytes()) % 1_000_000) / np.float32(1_000_000) for row in values]
    assert mock_scores("tagger", [("features", values)]).tolist() == want
    spec = adl("model tagger { inputs Muon_pt, Muon_eta; output Muon_score; batch Muon; provider mock; } object m : Muon { } output s = leading(m).score;")
    got = Plan(spec, frame(spark, muons([(31, 0.1, 0, 1), (45, -2, 0, 1)], [])), ["event"]).rows().collect()
    assert [(r.event, r.s) for r in got] == [(0, pytest.approx(max(want)))]


def test_flat_columns_and_collections(spark):
    df = spark.createDataFrame([(1, 2, [1.0, 2.0], [3, 4], 7), (2, 0, [], [], 8)], "event long, nMuon int, Muon_pt array<float>, Muon_charge array<int>, run int")
    nested = to_collections(df, {"Muon": ["pt", "charge", "absent"]})
    assert nested.columns == ["event", "run", "Muon"] and [m.idx for m in nested.first().Muon] == [0, 1]
    assert sorted(flatten(nested).select(sorted(df.columns)).collect()) == sorted(df.select(sorted(df.columns)).collect())
    assert Catalogue.of(df).attributes("Muon") == ["pt", "charge"] and Catalogue.of(df).collection("Muons") == "Muon"
    assert collection("Muon", ["pt"]) is not None


def test_reading_prunes_columns(spark, tmp_path):
    rows = [(1, 2, [31.0, 10.0], [0.1, 0.2], [1.0, 2.0]), (2, 0, [], [], [])]
    spark.createDataFrame(rows, "event long, nMuon int, Muon_pt array<float>, Muon_eta array<float>, Muon_unused array<float>").write.parquet(f"{tmp_path}/e")
    spec = from_text(MUON_SPEC, "toml")
    df = events.read_events(spark, f"{tmp_path}/e", spec, keep=["event"])
    assert "Muon_unused" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in Plan(spec, df, ["event"]).rows().collect()] == [(1, 1, 31.0)]
    events.write_skim(Plan(spec, df, ["event"]).rows(), f"{tmp_path}/skim")
    assert events.merge(*[spark.read.parquet(f"{tmp_path}/skim")] * 2).count() == 2
    with pytest.raises(ValueError):
        events.with_defaults(df, {"other": 1})
    assert events.with_defaults(df.select("event"), {"event": 0, "x": 1.5}).first() == (1, 1.5)


def test_comparison(spark):
    a = spark.createDataFrame([(1, 1.0, [1.0, math.nan], 5), (2, 2.0, [2.0], 6), (3, math.nan, [], 7)], "k int, x double, v array<double>, n int")
    b = spark.createDataFrame([(1, 1.0000001, [1.0, math.nan], 5), (2, 2.5, [2.0, 3.0], 0), (4, 0.0, [], 7)], "k int, x double, v array<double>, other int")
    got = {r.column: (r.found, r.missing, r.extra, r.differing) for r in compare.compare(a, b, "k", rtol=1e-6).collect()}
    assert got == {"k": ("both", 1, 1, 0), "x": ("both", 1, 1, 1), "v": ("both", 1, 1, 1), "n": ("ours", 1, 1, None), "other": ("reference", 1, 1, None)}


def test_streaming_adds_up(spark, tmp_path):
    from eventloom.streaming.histograms import stream_histograms, totals

    spec = adl("object m : Muon { } output n = count(m); histogram h { expr = leading(m).pt; bins = 4; range = [0, 100]; }")
    for part in range(3):
        frame(spark, muons(*[[(10 * part + e, 0, 0, 1)] for e in range(5)])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(f"event long, Muon {MUON}").parquet(f"{tmp_path}/in")
        stream_histograms(spark, spec, source, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    whole = Plan(spec, spark.read.parquet(f"{tmp_path}/in")).histograms()
    columns = ["hist", "variation", "bin", "sumw", "entries"]
    assert sorted(totals(spark, spec, f"{tmp_path}/out").select(columns).collect()) == sorted(whole.select(columns).collect())


GEN = "array<struct<idx:int,pdgId:int,genPartIdxMother:int,statusFlags:int,pt:float,eta:float,phi:float>>"


def test_generator_matches(spark):
    last = V.LAST_COPY
    # a top (its last copy), its W with a copy, a b; the W's quarks; and a Higgs to b quarks far away
    gen = [(6, -1, last, 300, 0.0, 0.0), (24, 0, 0, 100, 0.1, 0.1), (5, 0, 0, 80, 0.2, 0.0), (24, 1, last, 100, 0.1, 0.1), (1, 3, 0, 50, 0.3, 0.1), (-2, 3, 0, 40, 0.1, 0.4), (25, -1, last, 200, 2.0, 2.0), (5, 6, 0, 100, 2.1, 2.0), (-5, 6, 0, 90, 2.0, 2.3)]
    rows = [([(0, 0.0, 0.0), (1, 2.0, 2.0)], [(i, p, m, s, float(pt), e, f) for i, (p, m, s, pt, e, f) in enumerate(gen)])]
    df = spark.createDataFrame(rows, f"Jet array<struct<idx:int,eta:float,phi:float>>, GenPart {GEN}")
    near, far = df.select(V.generator_matches(F.col("Jet"), F.col("GenPart")).alias("m")).first().m
    assert near.dr_T == 0 and near.T_pt == 300 and near.dr_T_b == pytest.approx(0.2) and near.dr_T_Wq_max == pytest.approx(math.hypot(0.1, 0.4), rel=1e-5)
    assert (near.T_Wq_max_pdgId, near.T_Wq_min_pdgId) == (-2, 1) and near.W_decay == 2 and near.W_pt == 100 and near.dr_Z == 1000 and near.Z_pt == -1 and near.dr_Z_daus == 99
    assert far.dr_H == 0 and far.H_decay == 5 and far.dr_H_daus == pytest.approx(0.3, rel=1e-5)
    weight = df.select(V.top_pt_weight(F.col("GenPart"), "2018", F.lit(True))).first()[0]
    assert weight == 1.0


def test_the_muon_channel(spark):
    jet = "array<struct<idx:int,pt:float,eta:float,phi:float,mass:float,jetId:int,btag:float>>"
    lepton = "array<struct<idx:int,pt:float,eta:float,phi:float,mass:float,dxy:float,dz:float,looseId:boolean,tightId:boolean,miniPFRelIso_all:float,mvaFall17V2noIso_WP90:boolean>>"
    mu = [(0, 60.0, 0.0, 0.0, 0.1, 0.0, 0.0, True, True, 0.05, True)]
    good = (1, mu, [], [(0, 50.0, 0.5, 1.0, 5.0, 6, 0.9), (1, 40.0, 0.0, 0.1, 5.0, 6, 0.9)], [(0, 300.0, 0.0, 3.0, 80.0, 6, 0.1), (1, 400.0, 0.1, 0.1, 90.0, 6, 0.1)], 80.0, 0.5)
    rows = [good, (2, mu * 2, *good[2:]), (3, mu, [], [], *good[4:]), (4, *good[1:5], 40.0, 0.5), (5, *good[1:4], good[4][1:], 80.0, 0.5)]
    df = spark.createDataFrame(rows, f"event long, Muon {lepton}, Electron {lepton}, Jet {jet}, FatJet {jet}, met_pt float, met_phi float")
    got = V.select_muon_channel(df, "v9", "2018", "btag", 0.5).collect()
    assert [(r.event, r.nlep, r.ht, r.fj_1_pt, r.fj_1_tau1, r.passmetfilters) for r in got] == [(1, 1, 50.0, 300.0, 99.0, False)]
    assert got[0].leptonicW_pt == pytest.approx(math.hypot(60 + 80 * math.cos(0.5), 80 * math.sin(0.5)), rel=1e-6)


def test_jet_identification(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0.5, 2, 1, 0.2, 0.9), (2.65, 0.95, 0.5, 0, 0, 0.0, 0.0), (2.9, 0.95, 0.5, 0, 0, 0.0, 0.0), (4.0, 0.0, 0.3, 0, 2, 0.0, 0.0)], "eta float, neHEF float, neEmEF float, chMultiplicity int, neMultiplicity int, chHEF float, muEF float")
    one = df.select(F.struct("*").alias("j"))
    known = set(df.columns)
    assert [r[0] for r in one.select(V.jet_id(F.col("j"), known, "v15", False)).collect()] == [True, False, True, True]
    assert [r[0] for r in one.select(V.jet_id(F.col("j"), known, "v15", True)).collect()] == [False, False, True, True]


def test_union_of_channels_gives_a_row_a_channel(spark):
    body = lambda cut: {"objects": {"m": {"source": "Muon", "cuts": [cut]}}, "regions": {"r": {"require": ["count(m) >= 1"]}}, "outputs": [{"name": "n", "expr": "count(m)"}]}
    spec = from_dict({"analysis": {"name": "a", "year": "y"}, "channel": [{"name": "low"} | body("pt > 10 GeV"), {"name": "high"} | body("pt > 40 GeV")]})
    rows = Plan(spec, frame(spark, muons([(50, 0, 0, 1), (20, 0, 0, 1)], [(20, 0, 0, 1)], [])), ["event"]).rows().collect()
    assert sorted(map(tuple, rows)) == [(0, "high", 1), (0, "low", 2), (1, "low", 1)]


def test_the_plan_scans_once_and_pushes_flags(spark, tmp_path):
    ev = eventview.events(spark, "/root/testdata/sf0.001")
    ev.write.parquet(f"{tmp_path}/ev")
    spec = adl("correction jes kind scale collection m attr pt up 1.05 down 0.95; object m : Muon { pt > 20 GeV; } region r { HLT_A; count(m) >= 1; } output n = count(m); histogram h { expr = leading(m).pt; bins = 3; range = [0, 90]; }")
    plan = Plan(spec, spark.read.parquet(f"{tmp_path}/ev")).fills()._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan)[1]
    assert plan.count("FileScan") == 1 and "EqualTo(HLT_A,true)" in pushed
    assert "Exchange" not in plan and "Jet" not in plan.split("ReadSchema")[1]


def test_histograms_and_skims_by_variation_come_back(spark, tmp_path):
    from eventloom.sources.events import read_histograms, write_histograms, write_skim

    text = "analysis a year y; weight nominal; correction jes kind scale collection m attr pt up 1.05 down 0.95; object m : Muon { pt > 30 GeV; } region r { count(m) >= 1; } output lead = leading(m).pt; histogram h { expr = leading(m).pt; bins = 4; range = [20, 60]; }"
    plan = Plan(from_text(text, "adl"), frame(spark, muons([(31, 0, 0, 1)], [(29, 0, 0, 1)], [(58, 0, 0, 1), (40, 0, 0, 1)], [])), ["event"])
    rows = plan.varied_rows()
    write_skim(rows, f"{tmp_path}/skim", by_variation=True)
    back = spark.read.parquet(f"{tmp_path}/skim").select(*rows.columns)
    found = sorted((r.event, r.variation, round(r.lead, 3)) for r in back.collect())
    assert found == [(0, "JesUp", 32.55), (0, "Nominal", 31.0), (1, "JesUp", 30.45), (2, "JesDown", 55.1), (2, "JesUp", 60.9), (2, "Nominal", 58.0)]
    hists = Plan(plan.spec, plan.events).histograms()
    write_histograms(hists, f"{tmp_path}/hists")
    again = read_histograms(spark, f"{tmp_path}/hists")
    assert sorted(again.collect()) == sorted(hists.select(*again.columns).collect()) and again.filter("variation = 'JesUp' and entries > 0").count() == 2


def test_a_large_lumi_mask_is_sent_to_the_events(spark):
    from eventloom.sources import lumi

    df = spark.range(5000).selectExpr("id as event", "cast(id % 40 as int) as run", "cast(id % 11 as int) as luminosityBlock")
    mask = {run: [(i, i) for i in range(run % 3, 60, 3)] for run in range(40)}
    assert sum(map(len, mask.values())) > lumi.MOST_INLINE
    got = lumi.certified(df, mask)
    want = df.filter(lumi.lumi_condition(mask, F.col("run"), F.col("luminosityBlock")))
    assert got.columns == df.columns and sorted(got.collect()) == sorted(want.collect()) and want.count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi, BuildRight" in plan


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_pairs_are_all_and_in_order(spark, n):
    df = frame(spark, muons([(10 + i, 0, 0, 1) for i in range(n)]))
    got = [(p.l.idx, p.r.idx) for p in df.select(C.pairs(F.col("Muon")).alias("p")).first().p]
    assert got == [(i, j) for i in range(n) for j in range(i + 1, n)]
