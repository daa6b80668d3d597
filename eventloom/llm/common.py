"""Text units, row keys and scratch tables shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between two item words: everything in ASCII but digits and lower-case letters.
ITEM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between two plain words.
BLANK = r"[\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def item_words(text: Column) -> Column:
    """Lower-cased words of digits, letters and whatever is not ASCII. No lambda: it stays in generated code."""
    return F.array_remove(F.split(ascii_lower(text), ITEM_GAP), "")


def plain_words(text: Column) -> Column:
    """Words between white space, as they are written."""
    return F.array_remove(F.split(text, BLANK), "")


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that stand for a row: rows with one doc_id and different texts stay apart, repeated rows share a key."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("?")), F.lit("\0"), F.coalesce(text, F.lit("\0")))))


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id's text, by which rows are held out; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


#: Bits of the largest bitmap, as a power of two: 16 MB.
MOST_BITS = 27


def bitmap(table: DataFrame, key: Column) -> bytes:
    """A bitmap of the keys' low bits, 16 bits a key up to 2 ** MOST_BITS: it is bounded, and has() misses none of them.

    Others pass by chance, more of them where keys fill a bitmap of the greatest size; callers check again by a join.
    """
    size = min(MOST_BITS, max(15, (16 * table.count()).bit_length()))
    place = key.bitwiseAND(F.lit((1 << size) - 1)) + 1
    parts = table.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    out = bytearray(1 << (size - 3))
    for row in parts.collect():  # 16 MB at most; a job for each partition takes longer
        out[(row.b - 1) * 4096 : row.b * 4096] = row.m
    return bytes(out)


def has(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in a bitmap."""
    at = keys & np.int64(len(bits) * 8 - 1)
    return (np.frombuffer(bits, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Scratch:
    """Tables written to the folder that driver and executors share, so that a lost executor costs no lineage.

    The folder is the session's spark.checkpoint.dir. Where that is unset, as in tests, one below the warehouse is used.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        self.root = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes df, by a column's values apart if told so, and returns the written table.

        Its shuffle files go at once, as nothing reads them any more.
        """
        path, before = f"{self.root}/{name}", self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            writer = df.write.option("compression", "uncompressed")  # codecs hold memory outside the heap for each small file
            (writer.partitionBy(by) if by else writer).parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.again(df, name)

    def again(self, df: DataFrame, name: str) -> DataFrame:
        """What is there of a written table with df's columns."""
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
