"""Weighted histograms as rows (hist, variation, bin), aggregated in parts; bin 0 is underflow, bins + 1 overflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.spec.expr import SpecError

SCHEMA = "hist string, variation string, bin int, sumw double, sumw2 double, entries long, sumwx double, sumwx2 double"


def bin_of(x: Column, low: Column, high: Column, bins: Column) -> Column:
    """1 to bins inside [low, high); NaN falls into the first bin, as no comparison with an edge holds for it."""
    inside = F.least(F.floor((x - low) / (high - low) * bins), bins - 1) + 1
    return F.when(F.isnan(x), F.lit(1)).when(x < low, F.lit(0)).when(x >= high, bins + 1).otherwise(inside).cast("int")


def variable_bin(x: Column, edges: list[float]) -> Column:
    """As bin_of, with edges of any distance."""
    out = F.when(F.isnan(x), F.lit(1)).when(x < edges[0], F.lit(0))
    for i, edge in enumerate(edges[1:], 1):
        out = out.when(x < edge, F.lit(i))
    return out.otherwise(F.lit(len(edges))).cast("int")


def check_bins(bins: int, low: float, high: float) -> None:
    if bins <= 0 or not low < high or max(abs(low), abs(high)) == float("inf"):
        raise SpecError("InvalidExpression", "histogram", "needs bins and an ordered, finite range")


def fill(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by..., bin, bins, x, w) to sums by group and bin. The moments sumwx and sumwx2 are of inner bins only."""
    inner = F.col("bin").between(1, F.col("bins"))
    moment = lambda c: F.coalesce(F.sum(F.when(inner, c)), F.lit(0.0))
    return rows.groupBy(*by, "bin").agg(
        F.sum("w").alias("sumw"),
        F.sum(F.col("w") * F.col("w")).alias("sumw2"),
        F.count("*").alias("entries"),
        moment(F.col("w") * F.col("x")).alias("sumwx"),
        moment(F.col("w") * F.col("x") * F.col("x")).alias("sumwx2"),
    )


def frame(spark: SparkSession, hists: dict[str, int], variations: list[str]) -> DataFrame:
    """Every bin of every histogram and variation: as many rows as the spec asks for."""
    rows = [(h, n, v) for h, n in hists.items() for v in variations]
    given = spark.createDataFrame(rows, "hist string, bins int, variation string")
    return given.select("hist", "variation", F.explode(F.sequence(F.lit(0), F.col("bins") + 1)).alias("bin"))


def complete(filled: DataFrame, whole: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Adds the empty bins. extra: further groups (such as processes) that each get the whole frame."""
    keys = ["hist", "variation", "bin"]
    if extra is not None:
        whole = whole.crossJoin(F.broadcast(extra))  # both sides are small lists made by the driver
        keys = [*extra.columns, *keys]
    return whole.join(filled, keys, "left").fillna(0.0, ["sumw", "sumw2", "sumwx", "sumwx2"]).fillna(0, ["entries"])


def scale(hists: DataFrame, factor: Column) -> DataFrame:
    """Contents and moments by the factor, squares by its square, entries as they are."""
    return hists.withColumns({**{c: F.col(c) * factor for c in ("sumw", "sumwx", "sumwx2")}, "sumw2": F.col("sumw2") * factor * factor})


def add(hists: DataFrame, by: list[str]) -> DataFrame:
    """Sums histograms of the same binning."""
    sums = [F.sum(c).alias(c) for c in ("sumw", "sumw2", "entries", "sumwx", "sumwx2")]
    return hists.groupBy(*by, "hist", "variation", "bin").agg(*sums)


def rate(hists: DataFrame, by: list[str]) -> DataFrame:
    """The sum over inner bins: what a datacard calls rate. hists must be complete, so that the last bin is overflow."""
    last = F.max("bin")
    ends = hists.groupBy(*by, "hist", "variation").agg(F.sum(F.when(F.col("bin") > 0, F.col("sumw")).otherwise(0.0)).alias("all"), F.max(F.struct("bin", "sumw")).alias("over"), last.alias("last"))
    return ends.select(*by, "hist", "variation", (F.col("all") - F.col("over.sumw")).alias("rate"))
