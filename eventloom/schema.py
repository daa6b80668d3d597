"""The data model: flat columns of a record file, grouped into collections of objects."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Catalogue types and the Spark types that hold their values; unsigned ones take the next wider signed type.
TYPES = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "uint8": T.ShortType(), "int16": T.ShortType(), "uint16": T.IntegerType(),
    "int32": T.IntegerType(), "uint32": T.LongType(), "int64": T.LongType(), "uint64": T.DecimalType(20, 0), "float": T.FloatType(),
}


def dimension(attr: str) -> str:
    """momentum or dimensionless, by an attribute's name."""
    known = attr in ("pt", "mass", "energy", "msoftdrop", "rawFactor") or attr.endswith(("Pt", "Mass"))
    return "momentum" if known else "dimensionless"


@dataclass
class Catalogue:
    """Branch names and their types: float, vec_float, ... Types not known here are kept, and refused when used."""

    branches: dict[str, str] = field(default_factory=dict)

    def numeric_vector(self, branch: str) -> bool:
        kind = self.branches.get(branch, "")
        return kind.startswith("vec_") and kind[4:] in TYPES and kind != "vec_bool"

    def boolean(self, branch: str) -> bool:
        return self.branches.get(branch) == "bool"

    def attributes(self, collection: str) -> list[str]:
        """A vector branch Prefix_attr belongs to collection Prefix, split at the first underscore."""
        return [b.split("_", 1)[1] for b, k in self.branches.items() if k.startswith("vec_") and b.split("_", 1)[0] == collection and "_" in b]

    def collection(self, name: str) -> str | None:
        """The collection that a name means: itself, or its singular or plural."""
        known = {b.split("_", 1)[0] for b, k in self.branches.items() if k.startswith("vec_") and "_" in b}
        return next((n for n in (name, name.removesuffix("s"), f"{name}s") if n in known), None)

    @staticmethod
    def of(df: DataFrame) -> Catalogue:
        """From a frame's columns: arrays, arrays of structs as collections, and scalars."""
        names = {v: k for k, v in TYPES.items() if k not in ("uint8", "uint16", "uint32", "int16", "int32", "int64")} | {T.ShortType(): "int16", T.IntegerType(): "int32", T.LongType(): "int64", T.DoubleType(): "float", T.StringType(): "string"}
        out = {}
        for f in df.schema:
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                out |= {f"{f.name}_{a.name}": f"vec_{names.get(a.dataType, 'other')}" for a in f.dataType.elementType if a.name != "idx"}
            elif isinstance(f.dataType, T.ArrayType):
                out[f.name] = f"vec_{names.get(f.dataType.elementType, 'other')}"
            else:
                out[f.name] = names.get(f.dataType, "other")
        return Catalogue(out)


def read_catalogue(path: str, version: str, tree: str = "Events") -> Catalogue:
    """From a YAML catalogue with one root: version -> trees -> branches -> type."""
    import yaml

    with open(path) as file:
        raw = next(iter(yaml.safe_load(file).values()))[version]["trees"][tree]["branches"]
    return Catalogue({name: b["type"] for name, b in raw.items()})


def collection(name: str, attrs: list[str]) -> Column:
    """Flat columns name_attr zipped to an array of structs with their index; shorter columns end in nulls."""
    arrays = F.arrays_zip(*[F.col(f"{name}_{a}") for a in attrs])
    return F.transform(arrays, lambda x, i: F.struct(i.cast("int").alias("idx"), *[x[f"{name}_{a}"].alias(a) for a in attrs]))


def to_collections(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Flat columns become collections; counters nName and columns of collections that are not wanted are left out."""
    scalars = [f.name for f in df.schema if not isinstance(f.dataType, T.ArrayType) and not (f.name[:1] == "n" and f.name[1:] in wanted)]
    present = {n: [a for a in attrs if f"{n}_{a}" in df.columns] for n, attrs in wanted.items()}
    return df.select(*scalars, *[collection(n, attrs).alias(n) for n, attrs in present.items()])


def flatten(df: DataFrame) -> DataFrame:
    """The reverse: collections become flat columns and their counters."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out.append(F.size(f.name).alias(f"n{f.name}"))
            out += [F.col(f.name)[a.name].alias(f"{f.name}_{a.name}") for a in f.dataType.elementType if a.name != "idx"]
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def optional(df: DataFrame, name: str, default) -> Column:
    """A column that may be absent; then, and where it is null, the default."""
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
