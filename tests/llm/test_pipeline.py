import re
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "decontamination", "mixing", "sharding"]


def test_stages_keep_the_columns_of_documents_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()
    plain = "A quiet sentence about {} and its {} with nothing else to say but words enough for a document that stays"
    extra = [(10_000, "Before. " + bench.text + " After.", "en", "src1", 0), (10_001, plain.format("rivers", "banks"), "en", "src1", 0), (10_002, plain.format("rivers", "banks"), "en", "src2", 0), (10_003, plain.format("rivers", "banks"), "en", "src2", 0)]
    extra += [(10_004, None, None, None, None), (10_005, "", "en", None, 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    sizes = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SMALL).cache()
        assert now.columns == columns, name
        sizes[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name == "near-dedup":
            assert 10_001 in sizes[name] and not {10_002, 10_003} & sizes[name] and {10_004, 10_005} <= sizes[name]
    assert 10_000 in sizes["near-dedup"] and 10_000 not in sizes["decontamination"] and 10_001 in sizes["decontamination"]
    last = corpus_pipeline.STAGES[-1][1](spark, now, SMALL).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in now.select("doc_id").collect())
    assert max(Counter(r.doc_id for r in last).values()) == 2


def test_the_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SMALL)
    rows, docs = out.collect(), {(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert rows and all(0 <= r.shard < 16 for r in rows)
    assert {(r.doc_id, r.text, r.lang, r.source) for r in rows} <= docs
    slots = Counter(r.shard for r in rows)
    assert {(r.shard, r.slot) for r in rows} == {(s, i) for s, n in slots.items() for i in range(n)} and len(rows) == sum(slots.values())


def test_stages_of_an_empty_table(spark):
    nothing = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).collect() == []


def test_shards_of_whole_rows(spark, docs, corpus):
    """Columns of the same names are replaced, all others kept; rows equal in all columns differ in their slots."""
    from eventloom.llm import sharding

    rows = docs.withColumnRenamed("items", "slot").withColumnRenamed("score", "size")
    got = sharding.shard_documents(rows, 3)
    assert got.columns == ["doc_id", "text", "lang", "source", "key", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = got.collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.key) for r in found) == Counter((*r[:4], r[6]) for r in corpus)
    assert {(r.shard, r.slot) for r in found} == {(s, i) for s, n in Counter(r.shard for r in found).items() for i in range(n)}
    plain = {(r.doc_id, r.text_crc32): r.shard for r in sharding.assign_shards(docs, 3).collect()}
    assert all(plain[r.doc_id, r.text_crc32] == r.shard for r in found)


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if re.match(r"op(5|10)_", n)])
def test_queries_against_their_sql(spark, name):
    from oracle import connect, difference

    ours = __spark_entry__.queries()[name](spark, SMALL).toPandas()
    assert difference(ours, connect(SMALL).sql(__spark_entry__.oracle_sql()[name]).df()) == ""
