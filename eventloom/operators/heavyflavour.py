"""The heavy-flavour muon channel: object identification, cleaning, generator matching, weights and its selection.

Everything is a column or a frame of columns over one event's collections. Single-precision values are compared with
single-precision thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.ieee import clip
from eventloom.operators.candidates import by_pt, let
from eventloom.operators.kinematics import add, delta_phi_f32, delta_r_f32, four_vector, invariant_mass, transverse
from eventloom.schema import optional

#: Eras, and the filters that they add to the common ones.
RUN2 = ("2016APV", "2016", "2017", "2018")
RUN3 = ("2022", "2022EE", "2023", "2023BPix", "2024")
COMMON_FILTERS = ("Flag_goodVertices", "Flag_globalSuperTightHalo2016Filter", "Flag_EcalDeadCellTriggerPrimitiveFilter", "Flag_BadPFMuonFilter", "Flag_BadPFMuonDzFilter", "Flag_eeBadScFilter")
LAST_COPY = 1 << 13


def f32(x: float) -> Column:
    return F.lit(x).cast("float")


def below(x: Column, most: float) -> Column:
    return F.abs(x) < f32(most)


def fields(df: DataFrame, name: str) -> set[str]:
    kind = df.schema[name].dataType if name in df.columns else None
    return set(kind.elementType.names) if isinstance(kind, T.ArrayType) else set()


def attr(x: Column, name: str, known: set[str], default) -> Column:
    """An attribute that may be absent."""
    return F.coalesce(x[name], F.lit(default)) if name in known else F.lit(default)


def pass_trigger(df: DataFrame, triggers: list[str]) -> Column:
    """Whether any fired; absent ones did not."""
    out = F.lit(False)
    for t in triggers:
        out = out | optional(df, t, False)
    return out


def met_filters(df: DataFrame, era: str) -> Column:
    """Whether all filters of the era passed; absent ones did not."""
    names = list(COMMON_FILTERS)
    names += ["Flag_HBHENoiseFilter", "Flag_HBHENoiseIsoFilter"] if era in RUN2 else []
    names += ["Flag_ecalBadCalibFilter"] if era in (*RUN2[2:], *RUN3) else []
    names += ["Flag_hfNoisyHitsFilter"] if era in RUN3 else []
    out = F.lit(True)
    for n in names:
        out = out & optional(df, n, False)
    return out


def jet_id(jet: Column, known: set[str], version: str, lepton_veto: bool) -> Column:
    """Tight identification of a jet by data version (v9, v12, v15)."""
    get = lambda n, d: attr(jet, n, known, d)
    bits = lambda mask: get("jetId", 0).cast("int").bitwiseAND(F.lit(mask)) != 0
    if version == "v9":
        return bits(4 if lepton_veto else 2)
    eta = F.abs(jet["eta"])
    neutral, em = get("neHEF", 1.0).cast("float"), get("neEmEF", 1.0).cast("float")
    if version == "v12":
        tight = bits(2) & F.when(eta <= f32(2.7), True).when(eta <= f32(3.0), neutral < f32(0.99)).otherwise(em < f32(0.4))
    else:
        charged, others = get("chMultiplicity", 0), get("neMultiplicity", 0)
        central = (neutral < f32(0.99)) & (em < f32(0.9)) & (charged + others > 1) & (get("chHEF", 0.0).cast("float") > f32(0.01)) & (charged > 0)
        tight = (
            F.when(eta <= f32(2.6), central)
            .when(eta <= f32(2.7), (neutral < f32(0.9)) & (em < f32(0.99)))
            .when(eta <= f32(3.0), neutral < f32(0.99))
            .otherwise((others >= 2) & (em < f32(0.4)))
        )
    if not lepton_veto:
        return tight
    return tight & ((eta > f32(2.7)) | ((get("muEF", 0.0).cast("float") < f32(0.8)) & (get("chEmEF", 0.0).cast("float") < f32(0.8))))


def _lepton(x: Column, flavour: str) -> Column:
    return F.struct(x["pt"].alias("pt"), x["eta"].alias("eta"), x["phi"].alias("phi"), x["mass"].alias("mass"), x["idx"].alias("idx"), F.lit(flavour).alias("flavour"))


def loose_leptons(version: str) -> Column:
    """Electrons and muons of both loose identifications, by falling pt."""
    electron_id = "mvaFall17V2noIso_WP90" if version == "v9" else "mvaNoIso_WP90"

    def common(x: Column, eta: float) -> Column:
        return (x["pt"] > 10) & below(x["eta"], eta) & below(x["dxy"], 0.05) & below(x["dz"], 0.2) & (x["miniPFRelIso_all"] < f32(0.4))

    electrons = F.filter("Electron", lambda x: common(x, 2.5) & x[electron_id])
    muons = F.filter("Muon", lambda x: common(x, 2.4) & x["looseId"])
    both = F.concat(F.transform(electrons, lambda x: _lepton(x, "e")), F.transform(muons, lambda x: _lepton(x, "mu")))
    keyed = F.transform(both, lambda x, i: F.struct((-x["pt"].cast("double")).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def tight_muons() -> Column:
    return F.filter("Muon", lambda x: (x["pt"] > 55) & below(x["eta"], 2.4) & below(x["dxy"], 0.2) & below(x["dz"], 0.5) & x["tightId"] & (x["miniPFRelIso_all"] < f32(0.1)))


def closest(x: Column, others: Column) -> Column:
    """(idx, dr) of the nearest of others, the first among equals; -1 and 1000 where there is none nearer than that."""
    start = F.struct(F.lit(-1).alias("idx"), f32(1000.0).alias("dr"))
    each = F.transform(others, lambda y, i: F.struct(i.cast("int").alias("idx"), delta_r_f32(x, y).alias("dr")))
    return F.aggregate(each, start, lambda best, y: F.when(y["dr"] < best["dr"], y).otherwise(best))


def cleaned(objects: Column, leptons: Column, cone: float) -> Column:
    """Objects whose nearest lepton is at least a cone away."""
    return F.filter(objects, lambda x: ~F.exists(leptons, lambda y: delta_r_f32(x, y) < F.least(f32(cone), f32(1000.0))))


def ht(jets: Column) -> Column:
    return F.aggregate(jets, f32(0.0), lambda total, x: (total + x["pt"]).cast("float"))


def soft_drop_mass(jet: Column, subjets: Column) -> Column:
    """The mass of the sum of a jet's subjets, of which subJetIdx1 and subJetIdx2 tell; indices out of range are none."""
    found = F.filter(F.transform(F.array(jet["subJetIdx1"], jet["subJetIdx2"]), lambda i: F.when(i >= 0, F.get(subjets, i))), lambda s: s.isNotNull())
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("px", "py", "pz", "e")])
    return invariant_mass(F.aggregate(F.transform(found, four_vector), zero, add)).cast("float")


# ---- generator history -------------------------------------------------------------------------------------------


def children(particles: Column) -> Column:
    """For each particle the indices of those whose mother it is."""
    return let(particles, lambda g: F.transform(g, lambda p, i: F.transform(F.filter(g, lambda d: d["genPartIdxMother"] == i), lambda d: d["idx"])))


def last_copies(particles: Column, daughters: Column) -> Column:
    """For each particle the index of its last copy: the first daughter of the same kind, again and again.

    Each round goes twice as far, so there are as many rounds as the number of particles has binary digits.
    """

    def of(g: Column, d: Column) -> Column:
        def following(p: Column, i: Column) -> Column:
            same = F.filter(F.get(d, i), lambda k: F.get(g, k)["pdgId"] == p["pdgId"])
            return F.coalesce(F.get(same, F.lit(0)).cast("int"), i.cast("int"))

        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(g), F.lit(2)).cast("double"))).cast("int"))
        return F.aggregate(rounds, F.transform(g, following), lambda at, _: F.transform(at, lambda i: F.get(at, i)))

    return let(F.struct(particles.alias("g"), daughters.alias("d")), lambda v: of(v["g"], v["d"]))


def hadronic(i: Column, particles: Column, daughters: Column) -> Column:
    return F.exists(F.get(daughters, i), lambda k: F.abs(F.get(particles, k)["pdgId"]) < 6)


def farthest(jet: Column, others: Column) -> Column:
    """The greatest distance from a jet; 99 if there is nothing."""
    return F.when(F.size(others) == 0, f32(99.0)).otherwise(F.aggregate(others, f32(0.0), lambda best, d: F.greatest(best, delta_r_f32(jet, d))))


def generator_matches(jets: Column, particles: Column) -> Column:
    """An array, as long as jets, of the nearest hadronic H, Z, W and top of each, and what they decayed to."""

    def history(g: Column) -> Column:
        return F.struct(g.alias("g"), children(g).alias("d"))

    def found(h: Column) -> Column:
        g, d = h["g"], h["d"]
        last = last_copies(g, d)
        decays = lambda i: F.transform(F.get(d, i), lambda k: F.get(g, k))

        def boson(kind: int) -> Column:
            mine = F.filter(g, lambda p: (F.abs(p["pdgId"]) == kind) & (p["statusFlags"].bitwiseAND(F.lit(LAST_COPY)) != 0))
            return F.filter(F.transform(mine, lambda p: F.struct(p.alias("p"), decays(p["idx"]).alias("to"))), lambda x: F.exists(x["to"], lambda k: F.abs(k["pdgId"]) < 6))

        def of_top(p: Column) -> Column:
            to = decays(p["idx"])
            ws = F.filter(to, lambda k: F.abs(k["pdgId"]) == 24)
            bs = F.filter(to, lambda k: F.abs(k["pdgId"]).isin(1, 3, 5))
            w = F.get(last, F.get(ws, F.size(ws) - 1)["idx"])  # the last daughter of a kind counts
            return F.struct(p.alias("p"), F.get(bs, F.size(bs) - 1).alias("b"), decays(w).alias("to"), w.alias("w"))

        tops = F.filter(g, lambda p: (F.abs(p["pdgId"]) == 6) & (p["statusFlags"].bitwiseAND(F.lit(LAST_COPY)) != 0))
        good = F.filter(F.transform(tops, of_top), lambda t: t["w"].isNotNull() & t["b"].isNotNull() & F.exists(t["to"], lambda k: F.abs(k["pdgId"]) < 6))
        return F.struct(boson(25).alias("h"), boson(23).alias("z"), boson(24).alias("w"), good.alias("t"))

    def match(jet: Column, b: Column) -> Column:
        nearest = F.struct(*[closest(jet, F.transform(b[k], lambda x: x["p"])).alias(k) for k in "hzwt"])
        return let(F.struct(jet.alias("jet"), b.alias("b"), nearest.alias("n")), told)

    def told(v: Column) -> Column:
        jet, b, n = v["jet"], v["b"], v["n"]
        out = {f"dr_{k.upper()}": n[k]["dr"] for k in "hzwt"}
        for k in "hzw":
            x = F.when(n[k]["idx"] >= 0, F.get(b[k], n[k]["idx"]))
            kinds = F.transform(x["to"], lambda d: F.abs(d["pdgId"]))
            decay = F.array_max(kinds) if k == "w" else F.get(kinds, F.lit(0))
            name = k.upper()
            out |= {f"dr_{name}_daus": F.coalesce(farthest(jet, x["to"]), f32(99.0)), f"{name}_pt": F.coalesce(x["p"]["pt"], f32(-1.0)), f"{name}_decay": F.coalesce(decay, F.lit(0))}
        t = F.when(n["t"]["idx"] >= 0, F.get(b["t"], n["t"]["idx"]))
        quarks = F.array(*[F.struct(F.coalesce(delta_r_f32(jet, F.get(t["to"], F.lit(i))), f32(99.0)).alias("dr"), F.coalesce(F.get(t["to"], F.lit(i))["pdgId"], F.lit(0)).alias("id")) for i in (0, 1)])
        first_near = quarks[0]["dr"] < quarks[1]["dr"]
        far, near = F.when(first_near, quarks[1]).otherwise(quarks[0]), F.when(first_near, quarks[0]).otherwise(quarks[1])
        out |= {"dr_T_b": F.coalesce(delta_r_f32(jet, t["b"]), f32(99.0)), "dr_T_Wq_max": far["dr"], "dr_T_Wq_min": near["dr"], "T_Wq_max_pdgId": far["id"], "T_Wq_min_pdgId": near["id"], "T_pt": F.coalesce(t["p"]["pt"], f32(-1.0))}
        return F.struct(*[c.alias(name) for name, c in out.items()])

    return let(let(let(particles, history), found), lambda b: F.transform(jets, lambda j: match(j, b)))


# ---- weights -----------------------------------------------------------------------------------------------------


def pileup_weight(n_true: Column, lookup, is_mc: Column) -> Column:
    """lookup(n) of the clipped number of interactions, itself clipped to 0 to 10; 1 for data."""
    return F.when(is_mc, clip(lookup(clip(n_true.cast("double"), 0.0, 99.0)), 0.0, 10.0)).otherwise(1.0)


def top_pt_weight(particles: Column, era: str, is_mc: Column) -> Column:
    """The root of both tops' weights where there are exactly two last copies, else 1."""
    tops = F.filter(particles, lambda p: (F.abs(p["pdgId"]) == 6) & (p["statusFlags"].bitwiseAND(F.lit(LAST_COPY)) != 0))

    def one(pt: Column) -> Column:
        x = clip(pt.cast("double"), 0.0, 2000.0)
        w = 0.103 * F.exp(-0.0118 * x) - 0.000134 * x + 0.973
        return w * (0.991 + 0.000075 * x) if era in RUN3 else w

    both = F.sqrt(one(F.get(tops, F.lit(0))["pt"]) * one(F.get(tops, F.lit(1))["pt"]))
    return F.when(is_mc & (F.size(tops) == 2), both).otherwise(1.0)


def prefiring(df: DataFrame, way: str, era: str, is_mc: Column) -> Column:
    """way: Nom, Up or Dn."""
    use = is_mc & F.lit(era in ("2016APV", "2016", "2017"))
    return F.when(use, optional(df, f"L1PreFiringWeight_{way}", 1.0)).otherwise(1.0)


def jet_veto_flag(jets: Column, known: set[str], version: str, era: str, lookup) -> Column:
    """1 if an identified jet above 15 GeV lies where lookup(eta, phi) is positive, 0 if none, -99 before Run 3."""
    if era not in RUN3:
        return F.lit(-99)

    def vetoed(x: Column) -> Column:
        em = attr(x, "neEmEF", known, 0.0) + attr(x, "chEmEF", known, 0.0)
        return (x["pt"] > 15) & jet_id(x, known, version, True) & (em < f32(0.9)) & (lookup(x["eta"].cast("double"), x["phi"].cast("double")) > 0)

    return F.exists(jets, vetoed).cast("int")


def smearing_seed(run: Column, section: Column, event: Column, eta0: Column) -> Column:
    """A 31-bit seed from the event's numbers and its first jet."""
    base = F.shiftleft(run.cast("long"), 20) + F.shiftleft(section.cast("long"), 10) + event.cast("long") + (eta0.cast("double") / 0.01).cast("int")
    return base.bitwiseAND(F.lit(0x7FFFFFFF))


def scaled_jets(jets: Column, factor) -> Column:
    """Jets with pt and mass times factor(jet)."""
    return F.transform(jets, lambda x: x.withField("pt", (x["pt"].cast("double") * factor(x)).cast("float")).withField("mass", (x["mass"].cast("double") * factor(x)).cast("float")))


def varied_selection(jets: Column, least_pt: float = 30.0, most_eta: float = 2.4) -> Column:
    return F.filter(jets, lambda x: (x["pt"] > least_pt) & (F.abs(x["eta"]) < most_eta))


# ---- the channel -------------------------------------------------------------------------------------------------

#: Defaults of the leading fat jet's columns where there is none, or where a column is absent.
FATJET = {"pt": 0.0, "eta": 0.0, "phi": 0.0, "mass": 0.0, "msoftdrop": 0.0, "tau1": 99.0, "tau2": 99.0, "tau3": 99.0, "tau4": 99.0, "btagDeepB": -1.0, "rawFactor": 0.0, "nConstituents": 0, "jetId": 0}


def select_muon_channel(df: DataFrame, version: str, era: str, btag: str, medium: float, cone: float = 0.8, fat: str = "FatJet") -> DataFrame:
    """One row for each event of the channel: ids, filters, weights, ht, met, the W candidate and the leading probe jet.

    df holds Electron, Muon, Jet, the fat jets and met_pt, met_phi; is_mc tells simulation, GenPart its history.
    Selection: exactly one tight muon; met of 50 at least; a W candidate of 100 at least; a b-tagged jet on the muon's
    side; a fat jet opposite to it.
    """
    known, fat_known = fields(df, "Jet"), fields(df, fat)
    is_mc = optional(df, "is_mc", False)
    out = df.withColumn("muons", tight_muons()).filter("size(muons) = 1").withColumn("mu", F.get("muons", F.lit(0))).withColumn("leptons", loose_leptons(version))
    jets = F.filter(by_pt(F.col("Jet")), lambda x: (x["pt"] > 25) & below(x["eta"], 2.4) & jet_id(x, known, version, True))
    fats = F.filter(by_pt(F.col(fat)), lambda x: (x["pt"] > 200) & below(x["eta"], 2.4) & jet_id(x, fat_known, version, False))
    out = out.withColumn("ak4", cleaned(jets, F.col("leptons"), 0.4)).withColumn("ak8", cleaned(fats, F.col("leptons"), cone))
    met = F.struct(F.col("met_pt").alias("pt"), F.lit(0.0).alias("eta"), F.col("met_phi").alias("phi"), F.lit(0.0).alias("mass"))
    out = out.filter("met_pt >= 50").withColumn("w", add(four_vector(F.col("mu")), four_vector(met))).withColumn("leptonicW_pt", transverse(F.col("w"))).filter("leptonicW_pt >= 100")
    mu_phi = F.col("mu.phi")
    out = out.filter(F.exists("ak4", lambda x: (x[btag] > f32(medium)) & (F.abs(delta_phi_f32(x["phi"], mu_phi)) < 2)))
    out = out.withColumn("fj", F.get(F.filter("ak8", lambda x: F.abs(delta_phi_f32(x["phi"], mu_phi)) > 2), F.lit(0))).filter("fj is not null")
    shown = [F.coalesce(F.col(f"fj.{n}"), F.lit(d)).alias(f"fj_1_{n}") if n in fat_known else F.lit(d).alias(f"fj_1_{n}") for n, d in FATJET.items()]
    if "GenPart" in df.columns:
        out = out.withColumn("gen", F.get(generator_matches(F.array("fj"), F.col("GenPart")), F.lit(0)))
        shown += [F.col("gen.*"), top_pt_weight(F.col("GenPart"), era, is_mc).alias("topptWeight")]
    ids = [F.col(c) for c in ("event", "run", "luminosityBlock") if c in df.columns]
    return out.select(
        *ids, met_filters(df, era).alias("passmetfilters"), *[prefiring(df, way, era, is_mc).alias(f"l1PreFiringWeight{tail}") for way, tail in (("Nom", ""), ("Up", "Up"), ("Dn", "Down"))],
        F.size("leptons").alias("nlep"), ht(F.col("ak4")).alias("ht"), F.col("met_pt").alias("met"), F.col("met_phi").alias("metphi"),
        F.when(is_mc, optional(df, "genWeight", 1.0)).otherwise(1.0).alias("genWeight"), "leptonicW_pt", *shown,
    )
