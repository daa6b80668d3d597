"""Command line: validate, branches, certify, compare specs, convert to ADL, run."""

from __future__ import annotations

import argparse
import json
import sys

from eventloom.schema import read_catalogue
from eventloom.sources.events import certificate
from eventloom.spec.adl import emit_adl
from eventloom.spec.expr import SpecError
from eventloom.spec.model import load
from eventloom.spec.validate import errors_of, required_branches


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="eventloom", description=__doc__)
    parser.add_argument("command", choices=["validate", "branches", "certify", "compare", "adl", "run"])
    parser.add_argument("spec")
    parser.add_argument("other", nargs="?", help="compare: another spec; run: the folder for the skim")
    parser.add_argument("--catalogue", help="YAML catalogue of branches")
    parser.add_argument("--version", default="v9")
    parser.add_argument("--input", nargs="*", default=[], help="Parquet files of events")
    given = parser.parse_args(args)
    try:
        spec = load(given.spec)
        if given.command in ("validate", "branches"):
            catalogue = read_catalogue(given.catalogue, given.version)
            found = errors_of(spec, catalogue)
            for error in found:
                print(f"{error.kind}: {error}")
            if not found and given.command == "branches":
                print("\n".join(required_branches(spec, catalogue)))
            return int(bool(found))
        if given.command == "certify":
            print(json.dumps(certificate(spec), indent=2))
        elif given.command == "compare":
            same = certificate(spec)["sha256"] == certificate(load(given.other))["sha256"]
            print("same" if same else "different")
            return int(not same)
        elif given.command == "adl":
            print(emit_adl(spec), end="")
        else:
            from pyspark.sql import SparkSession

            from eventloom.plans.compiler import Plan
            from eventloom.sources.events import read_events, write_histograms, write_skim

            spark = SparkSession.builder.getOrCreate()
            plan = Plan(spec, read_events(spark, given.input, spec))
            write_skim(plan.rows(), f"{given.other}/skim")
            if spec.histograms:
                write_histograms(plan.histograms(), f"{given.other}/histograms")
    except SpecError as error:
        print(f"{error.kind}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
