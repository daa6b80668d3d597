"""Certified luminosity sections."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to this many ranges become a condition in the plan; beyond, a join does the same, and up to MOST_SENT the mask is sent
#: to the events, which stay where they are.
MOST_INLINE, MOST_SENT = 500, 1_000_000


def read_lumi_mask(path: str) -> dict[int, list[tuple[int, int]]]:
    """{run: [[low, high], ...]}, both ends included."""
    raw = json.loads(Path(path).read_text())
    out: dict[int, list[tuple[int, int]]] = {}
    for run, ranges in raw.items():
        if not run.isdigit() or int(run) >= 1 << 32:
            raise ValueError(f"run {run!r} is not an unsigned number")
        for pair in ranges:
            if len(pair) != 2 or not all(isinstance(x, int) and 0 <= x < 1 << 32 for x in pair) or pair[0] > pair[1]:
                raise ValueError(f"run {run}: {pair} is not a range")
        out[int(run)] = [(a, b) for a, b in ranges]
    return out


def lumi_condition(mask: dict[int, list[tuple[int, int]]], run: Column, section: Column) -> Column:
    """Whether a section is certified."""
    out = F.lit(False)
    for number, ranges in mask.items():
        inside = F.lit(False)
        for low, high in ranges:
            inside = inside | section.between(low, high)
        out = out | ((run == number) & inside)
    return out


def certified(df: DataFrame, mask: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """The rows of certified sections; many ranges are semi-joined, each run's as one row."""
    n = sum(len(r) for r in mask.values())
    if n <= MOST_INLINE:
        return df.filter(lumi_condition(mask, F.col("run"), F.col("luminosityBlock")))
    spark: SparkSession = df.sparkSession
    table = spark.createDataFrame([(run, [list(x) for x in ranges]) for run, ranges in mask.items()], "_run long, _ranges array<array<long>>")
    within = F.exists("_ranges", lambda r: F.col("luminosityBlock").between(r[0], r[1]))
    return df.join(F.broadcast(table) if n <= MOST_SENT else table, (F.col("run") == F.col("_run")) & within, "left_semi")
