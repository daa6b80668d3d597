import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from eventloom.llm import mixing, sharding


def jump(key: int, n: int) -> int:
    here, ahead = -1, 0
    while ahead < n:
        here = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((here + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return here


def test_jump_hash_is_the_published_one():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard(docs, corpus):
    rows = sharding.assign_shards(docs, 16).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in corpus)
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and {r.law for r in rows} == {"key"}
    by_key = {}
    for r in rows:
        assert by_key.setdefault(r.doc_id, r.shard) == r.shard
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    told = Counter((r.doc_id, r["size"], r.text_crc32) for r in rows)
    assert told == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in corpus)


def test_sharding_of_nothing(empty):
    assert sharding.assign_shards(empty, 4).collect() == []


def test_slots_over_several_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_GROUP", 5)
    df = spark.range(500).selectExpr("id as doc_id", "cast(id % 7 as string) as text")
    rows = sharding.assign_shards(df, 3).collect()
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert rows and sorted(sharding.assign_shards(df, 3).collect()) == sorted(rows)


def filled(sizes: dict, weights=(5.0, 2.0, 1.0), budget=1.5, most=2.0) -> dict:
    """Sharing out excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), budget * sum(sizes.values()), set(order)
    while open_ and left > 1e-9:
        unit = left / sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += unit * w[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_those_of_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.randrange(0, 1000) for s in ["b", "a", "é", "z", "A", None][: 2 + seed]}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = filled(sizes)
    assert {r.source: pytest.approx(r.target, abs=1e-6) for r in got} == want


def test_mix_meets_targets_and_reruns_agree(spark, docs, corpus):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus) and all(0 <= r.copies <= 2 and r.taken == r.copies * r["size"] for r in rows)
    sizes = Counter((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, *_ in corpus)
    assert Counter((r.doc_id, r["size"]) for r in rows) == sizes
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.dup, r.taken, r.source or "") for r in rows) == sorted((str(r.doc_id), r.dup, r.taken, r.source or "") for r in again)


def test_weighted_sums_stay_but_for_one_document_a_source(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["x"] * rng.randrange(0, 200)), rng.choice(["hot"] * 5 + ["b", "c"])) for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in ("hot", "b", "c"):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 200
    assert {type(r.copies) for r in got} == {int}


def test_mixing_of_nothing_and_of_repeated_rows(spark, empty, docs):
    assert mixing.mix(empty).collect() == [] and mixing.take(empty).collect() == []
    taken, copies = mixing.take(docs), mixing.mix(docs).agg({"copies": "sum"}).first()[0]
    assert taken.columns == docs.columns and taken.count() == copies
    same = spark.createDataFrame([(1, "one two three", "a")] * 300, "doc_id long, text string, source string")
    assert mixing.mix(same).agg({"taken": "sum"}).first()[0] == pytest.approx(1350, abs=3)
