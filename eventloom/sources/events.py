"""Reading event files, and writing skims, histograms and their manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.histogram import SCHEMA
from eventloom.schema import Catalogue, to_collections
from eventloom.spec.expr import show
from eventloom.spec.model import Spec
from eventloom.spec.validate import required_branches


def read_events(spark: SparkSession, paths: str | list[str], spec: Spec, catalogue: Catalogue | None = None, keep: list[str] = (), entries: tuple[int, int] | None = None) -> DataFrame:
    """Events with the columns that a spec needs. Flat array columns become collections; counters are not read.

    Parquet readers prune to these columns; absent optional columns are left out. entries (start, length) takes a range
    of an `entry` column.
    """
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if entries:
        df = df.filter(F.col("entry").between(entries[0], entries[0] + entries[1] - 1))
    flat = Catalogue.of(df)
    needed = required_branches(spec, catalogue or flat)
    wanted: dict[str, list[str]] = {}
    for b in needed:
        if flat.branches.get(b, "").startswith("vec_"):
            wanted.setdefault(b.split("_", 1)[0], []).append(b.split("_", 1)[1])
    scalars = [c for c in dict.fromkeys([*keep, *needed]) if c in df.columns and not flat.branches.get(c, "").startswith("vec_") and c[1:] not in wanted]
    if all(c in df.columns for c in wanted):
        return df.select(*scalars, *wanted)
    return to_collections(df.select(*scalars, *[f"{c}_{a}" for c, attrs in wanted.items() for a in attrs]), wanted)


def preselect(df: DataFrame, condition, most: int | None = None) -> DataFrame:
    """Events that pass a condition, at most so many."""
    out = df.filter(condition)
    return out if most is None else out.limit(most)


def write_skim(rows: DataFrame, path: str, by_variation: bool = False) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("variation") if by_variation else writer).parquet(path)


def with_defaults(df: DataFrame, model: dict[str, object]) -> DataFrame:
    """Exactly the declared columns, defaults where a value is missing; columns that are not declared are refused."""
    if unknown := [c for c in df.columns if c not in model]:
        raise ValueError(f"columns {unknown} are not declared")
    return df.select(*[F.coalesce(F.col(n), F.lit(d)).alias(n) if n in df.columns else F.lit(d).alias(n) for n, d in model.items()])


def merge(*parts: DataFrame) -> DataFrame:
    """Skims end to end, columns by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_histograms(hists: DataFrame, path: str) -> None:
    hists.select(F.concat_ws("_", "hist", "variation").alias("name"), *hists.columns).write.mode("overwrite").parquet(path)


def read_histograms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def certificate(spec: Spec) -> dict:
    """What a spec says, in one form for all languages, and its hash."""
    body = lambda b: {
        "objects": {n: [o.source, sorted(show(c) for c in o.cuts)] for n, o in sorted(b.objects.items())},
        "derived": {n: [d.kind, d.object, d.items, sorted(d.constraints), sorted(show(f) for f in d.filters), d.selection, show(d.target) if d.target else None, sorted(d.exclude)] for n, d in sorted(b.derived.items())},
        "regions": {n: sorted(show(c) for c in cuts) for n, cuts in sorted(b.regions.items())},
        "outputs": [[n, show(e)] for n, e in b.outputs],
    }
    said = {"name": spec.name, "year": spec.year, **body(spec), "channels": [[n, body(b)] for n, b in spec.channels]}
    said["histograms"] = [[h.name, show(h.expr), h.bins, h.low, h.high] for h in spec.histograms]
    said["weights"], said["variations"], said["lumi_mask"] = spec.weights, spec.variations(), spec.lumi_mask
    said["systematics"] = [[s.name, s.up, s.down] for s in spec.systematics]
    said["corrections"] = [[c.name, c.kind, c.collection, c.attr, c.up, c.down, c.file, c.correction, c.inputs, c.systematic] for c in spec.corrections]
    said["models"] = [[m.name, m.inputs, m.output, m.batch] for m in spec.models]
    return said | {"sha256": hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()}


def manifest(spec: Spec, inputs: list[dict]) -> dict:
    """The key under which a result may be reused: the spec and its inputs (path, size, time)."""
    said = {"spec": certificate(spec)["sha256"], "inputs": sorted(inputs, key=lambda i: i["path"])}
    return said | {"key": hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()}
