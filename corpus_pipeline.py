"""From documents to a sharded training mix, one operator a stage.

Every stage reads all rows that its predecessor kept and no column but doc_id, text and source (the first also the table
labels, the third benchmark). Null and empty texts are clean, no copies of anything, and kept once by the mix; repeated rows
are copies; very long texts are read whole; ties go by the least doc_id, then by the row's key; empty tables stay empty;
further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import bagminhash, decontamination, mixing, sharding, toxicity
from eventloom.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, does not call toxic; without labels all."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the least doc_id, a null doc_id only if there is no other."""
    return bagminhash.drop_near_duplicates(docs)


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontamination.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target has it."""
    return mixing.take(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard and slot."""
    return sharding.shard_documents(docs, 16)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_copies),
    ("decontamination", drop_benchmarks),
    ("mixing", mix_sources),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each result written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
