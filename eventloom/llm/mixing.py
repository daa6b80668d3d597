"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with target/size of its source as its wanted number of copies. The whole part is given at once.
The fractions are rounded in pairs: one document hands words of expected size to the other until either has 0 or 1
copy; chance decides the direction so that expectations stay. The one still open goes on to the next pair. Groups of
about FAN documents are folded in parallel, and what each group leaves open is folded again, level by level, until one
document a source is open; that one is rounded by chance. A source thus misses its target by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import Scratch, plain_words, row_key, text_of, uniform

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST_COPIES = 2.0
FAN = 64


def source_targets(sizes: DataFrame, budget: float = BUDGET, most: float = MOST_COPIES, weights=WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Filling every source at a common rate a weight unit until it holds `most` times its own size gives the same targets
    as sharing out excess again and again. One row a source takes part.
    """
    ranked = sizes.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(F.pmod(F.col("at"), F.lit(len(weights))) == i, F.lit(w)).otherwise(weight)
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    every = Window.partitionBy()
    rates = capped.select(
        "*",
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
        (F.sum("source_size").over(every) * F.lit(budget)).alias("total"),
    ).withColumn("rate", (F.col("total") - F.col("full")) / F.col("open"))
    level = F.max(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.col("rate"))).over(every)
    return rates.withColumn("level", level).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def _fold(items: Column, seed: Column) -> Column:
    """Rounds an array of (key, dup, doc_id, size, base, p); returns the same items, all but at most one with p 0 or 1."""
    item = "struct<key:binary,dup:long,doc_id:long,size:long,base:int,p:double>"

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["key"].alias("key"), x["dup"].alias("dup"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["base"].alias("base"), p.cast("double").alias("p"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["open"]
        have, room_a = a["p"] * a["size"], (1 - a["p"]) * a["size"]
        give, room_x = x["p"] * x["size"], (1 - x["p"]) * x["size"]
        up, down = F.least(room_a, give), F.least(have, room_x)
        draw = uniform(seed, a["key"], a["dup"], x["key"], x["dup"])
        rise = draw * (up + down) < down
        up_ends_a, down_ends_a = room_a <= give, have <= room_x
        ends_a = F.when(rise, up_ends_a).otherwise(down_ends_a)
        moved = F.when(rise, up).otherwise(-down)
        ended = F.when(ends_a, with_p(a, F.when(rise, 1.0).otherwise(0.0))).otherwise(with_p(x, F.when(rise, 0.0).otherwise(1.0)))
        left = F.when(ends_a, with_p(x, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["p"] - moved / x["size"])))).otherwise(
            with_p(a, F.greatest(F.lit(0.0), F.least(F.lit(1.0), a["p"] + moved / a["size"])))
        )
        return F.when(a.isNull(), F.struct(x.alias("open"), acc["done"].alias("done"))).otherwise(
            F.struct(left.alias("open"), F.concat(acc["done"], F.array(ended)).alias("done"))
        )

    start = F.struct(F.lit(None).cast(item).alias("open"), F.array().cast(f"array<{item}>").alias("done"))
    return F.aggregate(items, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))


def round_copies(docs: DataFrame, targets: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """docs: (key, dup, doc_id, source, size). Adds source_size, target and copies."""
    scratch = Scratch(docs.sparkSession, "mixing")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = docs.join(targets.withColumnRenamed("source", "_s"), docs["source"].eqNullSafe(F.col("_s"))).drop("_s")
    level = joined.withColumn("base", F.floor(wanted).cast("int")).withColumn("p", wanted - F.floor(wanted))
    groups, n, done = max(1, -(-rows // FAN)), 0, []
    while True:
        item = F.struct(F.xxhash64(F.lit(seed), F.lit(n), "key", "dup").alias("rank"), "key", "dup", "doc_id", "size", "base", "p")
        folded = level.filter("size > 0 and p > 0 and p < 1").withColumn("part", F.pmod(F.xxhash64(F.lit(seed), F.lit(n + 100), "key", "dup"), F.lit(groups))).groupBy("source", "source_size", "target", "part").agg(F.sort_array(F.collect_list(item)).alias("items"))
        items = F.transform("items", lambda x: F.struct(x["key"].alias("key"), x["dup"].alias("dup"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["base"].alias("base"), x["p"].alias("p")))
        out = folded.select("source", "source_size", "target", F.inline(_fold(items, F.lit(seed * 1000 + n))))
        done.append(level.filter("not (size > 0 and p > 0 and p < 1)"))
        level = scratch.keep(out.select(*done[0].columns), f"level{n}")
        if groups == 1:
            break
        groups, n = max(1, -(-groups // FAN)), n + 1
    whole = done[0]
    for more in [*done[1:], level]:
        whole = whole.unionByName(more)
    chosen = F.col("p") > uniform(F.lit(seed + 1), "key", "dup")
    return whole.withColumn("copies", F.when(F.col("size") > 0, F.col("base") + chosen.cast("int")).otherwise(F.lit(1)))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """A row for each row of docs: key, dup, doc_id, source, size, source_size, target, copies, taken.

    size counts words between white space (null: 0). Rows without words weigh nothing and are kept once. Null sources are one
    source, the last. Repeated rows are told apart by dup and rounded each on its own. No source: no rows. Only doc_id,
    text and source are read. A source's hot share does not matter: groups are dealt by row, not by source.
    """
    sized = docs.select(
        row_key(F.col("doc_id"), F.col("text")).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.size(plain_words(text_of())).cast("long").alias("size"),
    )
    counted = Scratch(docs.sparkSession, "mixing").keep(sized.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("n")), "sized")
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rows = counted.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("dup"), "doc_id", "source", "size")
    rounded = round_copies(rows, source_targets(sizes), docs.count(), seed)
    return rounded.withColumn("taken", F.col("copies") * F.col("size"))


def take(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, in the same columns."""
    row, of, copies, rows, i = (f"__el_{x}" for x in ("row", "source", "copies", "rows", "i"))
    totals = mix(docs, seed).groupBy(F.col("key").alias("__el_key"), F.col("source").alias(of)).agg(F.sum("copies").cast("int").alias(copies), F.count("*").alias(rows))
    here = docs.withColumn(row, row_key(F.col("doc_id"), F.col("text")))
    same = (F.col(row) == F.col("__el_key")) & F.col("source").cast("string").eqNullSafe(F.col(of))
    found = here.join(totals.filter(F.col(copies) > 0), same)
    once = found.filter(F.col(rows) == 1).unionByName(found.filter(F.col(rows) > 1).dropDuplicates([row, of]))
    return once.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
