"""Events over the order tables: an order is an event, its lines are muons and jets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Views that are written, by the folder of their tables.
WRITTEN: dict[str, str] = {}


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Writes the view of a folder's tables once; events() reads it from then on, with the columns that a plan needs."""
    WRITTEN.pop(sf_dir, None)
    events(spark, sf_dir).write.mode("overwrite").parquet(path)
    WRITTEN[sf_dir] = path


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, run, luminosityBlock, HLT_A, process, is_mc, Muon, Jet.

    Lines are gathered by order once, with partial aggregation; an order without lines has empty collections.
    """
    if sf_dir in WRITTEN:
        return spark.read.parquet(WRITTEN[sf_dir])
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    charge = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).when(F.col("l_suppkey") % 2 == 0, 1).otherwise(-1)
    one = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_linestatus").alias("kind"),
        (F.col("l_extendedprice") / 1000).cast("float").alias("pt"),
        ((F.col("l_discount") - 0.05) * 50).cast("float").alias("eta"),
        ((F.col("l_tax") - 0.04) * 75).cast("float").alias("phi"),
        F.lit(0.105).cast("float").alias("mass"),
        charge.alias("charge"),
        (F.col("l_quantity") / 100).cast("float").alias("iso"),
    )
    grouped = lines.groupBy(F.col("l_orderkey").alias("event")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    attrs = ("pt", "eta", "phi", "mass", "charge", "iso")

    def chosen(kind: str):
        mine = F.filter("all", lambda x: x["kind"] == kind)
        return F.transform(mine, lambda x, i: F.struct(i.cast("int").alias("idx"), *[x[a].alias(a) for a in attrs]))

    empty = F.array().cast("array<struct<idx:int,pt:float,eta:float,phi:float,mass:float,charge:int,iso:float>>")
    facts = orders.select(
        F.col("o_orderkey").alias("event"),
        F.year("o_orderdate").alias("run"),
        F.month("o_orderdate").alias("luminosityBlock"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("HLT_A"),
        F.when(F.col("o_orderstatus") == "F", "signal").when(F.col("o_orderstatus") == "O", "background").otherwise("data").alias("process"),
        (~F.col("o_orderstatus").isin("P")).alias("is_mc"),
    )
    objects = grouped.select("event", chosen("F").alias("Muon"), chosen("O").alias("Jet"))
    return facts.join(objects, "event", "left").withColumns({c: F.coalesce(c, empty) for c in ("Muon", "Jet")})


#: The same view in DuckDB's SQL: ev, mu and jet, the objects with their index.
SQL = """
with ev as (
  select o_orderkey as event, cast(year(o_orderdate) as int) as run, cast(month(o_orderdate) as int) as luminosityBlock,
    o_orderpriority in ('1-URGENT', '2-HIGH') as HLT_A,
    case o_orderstatus when 'F' then 'signal' when 'O' then 'background' else 'data' end as process, o_orderstatus <> 'P' as is_mc
  from orders
),
obj as (
  select l_orderkey as event, l_linestatus as kind,
    row_number() over (partition by l_orderkey, l_linestatus order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as idx,
    cast(cast(l_extendedprice / 1000 as float) as double) as pt, cast(cast((l_discount - 0.05::double) * 50 as float) as double) as eta,
    cast(cast((l_tax - 0.04::double) * 75 as float) as double) as phi, cast(cast(0.105 as float) as double) as mass,
    case l_returnflag when 'A' then 1 when 'R' then -1 else (case when l_suppkey % 2 = 0 then 1 else -1 end) end as charge,
    cast(cast(l_quantity / 100 as float) as double) as iso
  from lineitem
),
mu as (select * from obj where kind = 'F'),
jet as (select * from obj where kind = 'O'),
muv as (select *, pt * cos(phi) as px, pt * sin(phi) as py, pt * sinh(eta) as pz,
  sqrt(pt * cos(phi) * pt * cos(phi) + pt * sin(phi) * pt * sin(phi) + pt * sinh(eta) * pt * sinh(eta) + mass * mass) as e from mu)
"""
