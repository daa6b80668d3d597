import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from eventloom.llm import suffix_tree, textscan, toxicity


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def toxic_rows(n=600, seed=1):
    """A third of toxic texts name a group; neutral texts name it seldom, so that the name alone looks telling."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "trashy", "trashing", "scum"]))
        if rng.random() < (0.6 if toxic else 0.02):
            w.insert(rng.randrange(len(w)), rng.choice(["muslims", "jews"]))
        docs.append((i, " ".join(w).title()))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = toxicity.score(df, model).collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if crc(i) % 3 == 1}
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    caught = sum(r.predicted for r in held if truth[r.doc_id]) / sum(truth[r.doc_id] for r in held)
    wrong = sum(r.predicted for r in held if not truth[r.doc_id])
    assert caught > 0.9 and wrong <= 1


def test_swapped_names_hardly_change_the_score(spark):
    docs, labels = toxic_rows(seed=2)
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    free, tied = toxicity.train(df, known, penalty=0.0), toxicity.train(df, known, penalty=20.0)
    sentence = {f"w{i}" for i in range(10)}

    def change(model):
        return model.score(toxicity._of_words(sentence | {"muslims"})) - model.score(toxicity._of_words(sentence | {"people"}))

    assert change(free) > 4 * abs(change(tied)) and abs(change(tied)) < 0.1


def test_the_penalty_acts_on_documents_without_listed_names(spark):
    """Names are found in the training rows; leaving the penalty out changes the weights."""
    path = "/root/testdata/sf0.01/"
    docs, labels = (spark.read.parquet(f"{path}{x}.parquet") for x in ("documents", "labels"))
    tied, free, none = (toxicity.train(docs, labels, **x) for x in ({}, {"penalty": 0.0}, {"found": False}))
    assert tied.pairs > 100 and tied.changed > 0 and none.pairs == 0
    assert tied.weights.keys() == free.weights.keys() and tied.weights != free.weights
    assert toxicity.train(docs, labels).weights == tied.weights


def test_toxicity_of_odd_rows(docs, empty, spark, corpus):
    labels = spark.createDataFrame([(0, 1), (0, 1), (2, 0), (3, None), (9999, 1), (None, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "items", "key", "held_out", "score", "predicted"]
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in corpus) and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.train(empty, labels.limit(0))
    assert toxicity.score(empty, none).collect() == [] and toxicity.keep_clean(docs, none).count() == len(corpus)


def tokens(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def patterned(n=300, seed=3):
    """Words that follow one another in a fixed way, at depth one and two."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = ["the"]
        for _ in range(rng.randrange(0, 40)):
            if w[-1] == "san":
                w.append("francisco" if rng.random() < 0.9 else "diego")
            elif w[-2:] == ["new", "york"]:
                w.append("city" if rng.random() < 0.8 else "times")
            elif w[-1] == "new":
                w.append("york" if rng.random() < 0.7 else "deal")
            else:
                w.append(rng.choice(["san", "new", "york", "deal", "the", "of", f"w{rng.randrange(200)}"]))
        out.append((i, " ".join(w) if rng.random() < 0.9 else " ".join(w).upper()))
    return out + [(1000, None), (1001, ""), (None, "the new york city")]


def test_base_score_and_counts_against_brute_force(spark):
    rows = patterned()
    got = suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    count = Counter(t for d, text in rows if crc(d) % 7 != 2 for t in tokens(text))
    n, v = sum(count.values()), len(count)
    want = []
    for d, text in rows:
        own = tokens(text)
        base = sum(math.log10((count[t] + 1) / (n + 1 * (v + 1))) for t in own)
        want.append((str(d), crc(d) % 7 == 2, len(own), sum(count[t] > 0 for t in own), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)


def tree_scores(rows, depth):
    """Scores by the definition: states of dictionaries, each token in the longest suffix of its past that is one."""
    train = [tokens(t) for d, t in rows if crc(d) % 7 != 2]
    n = [Counter(tuple(x[i : i + k]) for x in train for i in range(len(x) - k + 1)) for k in range(1, depth + 2)]
    size = sum(n[0].values()) + len(n[0]) + 1.0
    least, discount, states = suffix_tree.LEAST, suffix_tree.DISCOUNT, {}

    def p(past, symbol):
        """Behind the longest state among the suffixes of past."""
        if not past:
            return (n[0][symbol,] + 1) / size
        below = p(past[1:], symbol)
        if past not in states:
            return below
        seen = n[len(past)][(*past, symbol)]
        return ((seen - discount) / n[len(past) - 1][past] if seen >= least else 0.0) + states[past] * below

    for k in range(1, depth + 1):
        after = {}
        for g, seen in n[k].items():
            if seen >= least:
                after.setdefault(g[:-1], []).append((g[-1], seen))
        found = {}
        for context, follow in after.items():
            total = n[k - 1][context]
            share = {s: (x - discount) / total for s, x in follow}
            rest = 1 - sum(share.values())
            gain = sum(x * math.log(share[s] / p(context[1:], s)) for s, x in follow) + (total - sum(x for _, x in follow)) * math.log(rest)
            if gain > 0.5 * math.log(total) * len(follow):
                found[context] = rest
        states |= found
    out = []
    for d, t in rows:
        own = tokens(t)
        out.append((str(d), sum(math.log10(p(tuple(own[max(0, i - depth) : i]), s)) for i, s in enumerate(own))))
    return out, states, p, n


@pytest.mark.parametrize("chunk", [1 << 20, 300])
@pytest.mark.parametrize("depth", [1, 3])
def test_scores_against_brute_force(spark, monkeypatch, depth, chunk):
    """In one chunk, and in many with many buckets."""
    monkeypatch.setattr(suffix_tree, "CHUNK", chunk)
    monkeypatch.setattr(textscan, "AT_ONCE", 1 << 20 if chunk > 300 else 500)
    rows = patterned(250) + patterned(40, 8)[:40] + [(2000, "end"), (2001, " "), (2002, "a b")]
    got = suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), depth).collect()
    want, states, _, _ = tree_scores(rows, depth)
    assert {len(c) for c in states} == set(range(1, depth + 1))
    for g, w in zip(sorted((str(r.doc_id), r.score) for r in got), sorted(want), strict=True):
        assert g == (w[0], pytest.approx(w[1], rel=1e-4, abs=1e-4))


def test_states_pass_the_test_and_sum_to_one(spark):
    """Of the brute force version, which the operator agrees with."""
    _, states, p, n = tree_scores(patterned(400), 3)
    symbols = [s for (s,) in n[0]]
    size = sum(n[0].values()) + len(n[0]) + 1.0
    for past in (("the",), ("san",), ("new", "york"), ("deal", "new", "york"), ("w1", "w2")):
        left = 1.0
        for k in range(len(past)):
            left *= states.get(past[k:], 1.0)
        assert sum(p(past, s) for s in symbols) + left / size == pytest.approx(1.0)
    assert p(("san",), "francisco") == pytest.approx(0.9, abs=0.07)
    assert p(("new", "york"), "city") == pytest.approx(0.8, abs=0.12)
    assert p(("deal", "york"), "city") < 0.55
    assert len([c for c in states if len(c) == 1]) < len(symbols)


def test_scoring_of_odd_rows(docs, corpus, empty):
    got = suffix_tree.score_texts(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in corpus)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[102] == 1
    assert suffix_tree.score_texts(empty).collect() == []


def test_contexts_are_states_whatever_the_size_of_the_corpus(spark):
    """A context met four times among 80,000 tokens, alone and behind another word."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"f{rng.randrange(3000)}" for _ in range(200))) for i in range(460)]
    train, held = [d for d in range(500, 600) if crc(d) % 7 != 2][:4], next(d for d in range(500, 600) if crc(d) % 7 == 2)
    rows += [(d, f"alpha beta gamma f{d}") for d in train] + [(held, "alpha beta gamma")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_tree.score_texts(df).collect()}
    assert got[held].train_tokens > 70000 and got[held].score > got[held].base_score + 6


def test_chunks_hold_their_words_and_codes_in_few_bytes(monkeypatch):
    monkeypatch.setattr(suffix_tree.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    texts = [" ".join(f"w{(i * i + k * k) % 4001}" for k in range(300)) for i in range(100)] + [""]
    frame = pd.DataFrame({"doc_id": [str(i) for i in range(101)], "held_out": False, "text": texts})
    (row,) = next(suffix_tree._chunk(iter([frame]))).itertuples()
    tokens = suffix_tree._Tokens(row)
    assert len(tokens.codes) == 30_101 and tokens.sizes.tolist() == [301] * 100 + [1]
    words = [w for text in texts for w in [*text.split(), None]]
    of = dict(zip(words, tokens.words[tokens.codes].tolist(), strict=True))
    assert [of[w] for w in words] == tokens.words[tokens.codes].tolist() and len(set(of.values())) == len(of) == len(tokens.words)
    assert of[None] == 1 and (tokens.words[1:] > tokens.words[:-1]).all()
    assert len(row.words) < 7.5 * len(tokens.words) and len(row.codes) < 2 * len(tokens.codes)


@pytest.mark.parametrize("n", [[], [0], [5, 1 << 40, 0, 7]])
def test_packed_numbers_come_back(n):
    for kind in (np.uint64, np.int64):
        assert suffix_tree._unpacked(suffix_tree._packed(np.array(n, dtype=kind)), kind).tolist() == n


def test_chunks_ask_once_and_the_last_mask_is_written_alone(spark, monkeypatch):
    kept = {}
    keep = suffix_tree.Scratch.keep

    def seen(self, df, name, by=None):
        out = keep(self, df, name, by)
        if name == "chunks-4":
            kept[name] = [(r.codes, len(r.masks)) for r in out.filter("not described").select("codes", "masks").collect()]
        if name == "counted-2":
            at = out.filter("part = 'at'").select("at").collect()
            places = [np.cumsum(suffix_tree._unpacked(r["at"], np.int32)) for r in at]
            kept[name] = (places, [len(suffix_tree._wide(r.kind, r.n)) for r in out.filter("part = 'grams'").select("kind", "n").collect()])
        return out

    monkeypatch.setattr(suffix_tree.Scratch, "keep", seen)
    monkeypatch.setattr(suffix_tree, "CHUNK", 1 << 20)
    rows = patterned(120)
    got = suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((str(r.doc_id), round(r.score, 3)) for r in got) == sorted((d, pytest.approx(x, abs=2e-3)) for d, x in tree_scores(rows, 3)[0])
    assert kept["chunks-4"] == [(None, 1)]
    places, sizes = kept["counted-2"]
    # one chunk: it is told all that the buckets keep, in their order, but what only held-out texts repeat is not kept
    assert all((np.diff(p) > 0).all() for p in places) and sorted(map(len, places)) == sorted(sizes)
