"""Shards by jump consistent hashing (Lamping and Veach, 2014).

A key walks through the shard counts at which it would jump to the newest shard; its last jump below the wanted count
is its shard. No ring table exists, and a count raised by one moves 1/(n+1) of the keys, all of them into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import Scratch, text_of

#: The generator's multiplier and the number of its high bits used are part of the published method.
MULTIPLIER = np.uint64(2862933555777941757)
SLOT_GROUP = 20_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key among `shards`."""
    state = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(state), dtype=np.int64)
    walking = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(walking):
            state[walking] = state[walking] * MULTIPLIER + np.uint64(1)
            draw = ((state[walking] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            ahead = ((shard[walking] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            inside = ahead < shards
            walking = walking[inside]
            shard[walking] = ahead[inside]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key of any type; null is a key like others."""

    @F.pandas_udf("int")
    def jump(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashes.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(F.xxhash64(key.cast("string")))


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Returns for each row: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes and one more (null: none and one more). grown_shard is the shard when one is added.
    slot numbers the rows of a shard without gaps, by a hash of the row. Null keys share a shard; repeated rows get
    slots next to each other; an empty table gives an empty one. Other columns are not read, whatever their names, but for
    those of `also`, which are kept and part equal rows.

    Equal rows are counted before anything is dealt out, and slots are numbered in groups of about SLOT_GROUP rows
    whose offsets come from group counts, so that neither a repeated row nor a shard has to fit into a task.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text_of(text)) + 1).cast("long").alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"),
        *also,
    ).groupBy("doc_id", "size", "text_crc32", *also).agg(F.count("*").alias("n"))
    groups = max(1, -(-docs.count() // (shards * SLOT_GROUP)))
    dealt = Scratch(spark, "sharding").keep(
        rows.select(
            "*",
            shard_of(F.col("doc_id"), shards).alias("shard"),
            shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
            F.xxhash64("doc_id", "text_crc32", "size").alias("rank"),
        ).withColumn("part", F.pmod(F.col("rank"), F.lit(groups))),
        "dealt",
    )
    parts = dealt.groupBy("shard", "part").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = (
        Window.partitionBy("shard", "part")
        .orderBy("rank", "doc_id", "text_crc32", "size", *also)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        dealt.join(offsets, ["shard", "part"])
        .withColumn("first", F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", *also)
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """docs and size, text_crc32, law, shard, slot, grown_shard, which replace columns of these names.

    Rows that are equal in all columns are told apart by their slots alone; each different row goes through the shuffle once.
    Nulls, empty and very long texts and empty tables are as in assign_shards.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    own = [c for c in docs.columns if c not in added]
    marks = [F.xxhash64(F.lit(i), *own).alias(f"__el_row{i}") for i in (0, 1)]
    names = tuple(f"__el_row{i}" for i in (0, 1))
    rows = docs.select(*own, *marks)
    dealt = assign_shards(rows, shards, also=names)
    return rows.dropDuplicates(list(names)).join(dealt.drop("doc_id"), list(names)).select(*own, *added)
