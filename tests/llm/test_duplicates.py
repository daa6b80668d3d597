import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import bagminhash, edits, fuzzy_lines, linking, textscan, unit_dedup
from eventloom.llm.common import Scratch
from test_text_scans import words


def bag(text, k=5):
    w = words(text)
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def closed(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_classes(rows):
    bags = [bag(t) for _, t in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            if a and b and (inter := sum((a & b).values())) * 5 >= 4 * sum((a | b).values()) and inter:
                links.append((i, j))
    groups = defaultdict(list)
    for n, r in closed(range(len(rows)), links).items():
        groups[r].append(n)
    out = []
    for members in groups.values():
        ids = [rows[m][0] for m in members]
        known = [x for x in ids if x is not None]
        out += [(str(rows[m][0]), str(min(known) if known else None), len(members)) for m in members]
    return sorted(out)


def near_texts(seed, n=40, hot=60):
    """Groups of near copies of many degrees around several texts, one of them large, and a passage that others share."""
    rng = random.Random(seed)
    out = []
    passage = [f"p{i}" for i in range(25)]
    for g in range(6):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.randrange(8, 120))]
        for _ in range(hot if g == 0 else n // 6):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    for _ in range(40):
        out.append(" ".join([*[f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))], *passage]))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    rows = near_texts(seed)
    got = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == brute_classes(rows)


def test_near_duplicates_of_odd_rows(docs, corpus, empty):
    got = bagminhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == brute_classes([r[:2] for r in corpus])
    kept = bagminhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    alone = sum(1 for r in got if r.weight == 0)
    assert kept.count() == len({bytes(r.class_key) for r in got if r.weight}) + alone
    assert bagminhash.near_duplicates(empty).collect() == [] and bagminhash.drop_near_duplicates(empty).collect() == []


@pytest.fixture
def crowded(monkeypatch):
    """All texts share one band and no two share another; the bucket is over WHOLE, and nothing may be lost by cutting it."""
    sign = bagminhash.sign

    def one_band(frames):
        for frame in sign(frames):
            start = [int.from_bytes(d[:7], "big") for d in frame["digest"]]
            yield frame.assign(bands=[[-1, *range(x * 32, x * 32 + 31)] for x in start])

    monkeypatch.setattr(bagminhash, "sign", one_band)
    rows = near_texts(3)
    assert len(rows) > bagminhash.WHOLE
    return rows


def test_near_duplicates_that_meet_in_one_large_bucket_only(spark, crowded):
    got = bagminhash.near_duplicates(spark.createDataFrame(crowded, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == brute_classes(crowded)


def test_the_pipeline_drops_copies_that_meet_in_one_large_bucket_only(spark, crowded):
    left = corpus_pipeline.drop_copies(spark, spark.createDataFrame(crowded, "doc_id long, text string"), "")
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted({first for _, first, _ in brute_classes(crowded)})


def test_counts_weigh_in(spark):
    a = " ".join(["one two three four five"] * 10)
    b = " ".join(["one two three four five"] * 20)
    got = bagminhash.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a + " one")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 2, 3: 1}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    for case in range(6):
        base = rng.integers(1, 1 << 62, size=120).astype(np.uint64)
        one = np.concatenate([np.tile(base[:7], int(rng.integers(1, 60))), base])
        two = np.concatenate([np.tile(base[:7], int(rng.integers(1, 60))), base[: 120 - 15 * case]])
        text, shingle, count = bagminhash.bags([one, two])
        least = bagminhash.signatures(text, shingle, count, 2, m=2048)
        x, y = (Counter(dict(zip(shingle[text == i].tolist(), count[text == i].tolist()))) for i in (0, 1))
        true = sum((x & y).values()) / sum((x | y).values())
        assert abs((least[0] == least[1]).mean() - true) < 0.05


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = linking.components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t"), "c").collect()
    want = {n: (0 if n <= 50 else 100 if n < 200 else 200) for e in chain for n in e}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_few_edges_are_linked_without_writing_a_table(spark, monkeypatch):
    rng, written, keep = random.Random(6), [], Scratch.keep
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "a long, b long")
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, by=None: written.append(name) or keep(self, df, name, by))
    few = sorted(linking.components(edges, Scratch(spark, "t"), "few").collect())
    assert few and not written
    monkeypatch.setattr(linking, "MOST_GATHERED", 199 - edges.filter("a = b").count())
    assert sorted(linking.components(edges, Scratch(spark, "t"), "many").collect()) == few and written


def test_near_duplicates_agree_where_shared_buckets_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "MOST_SENT", -1)
    rows = near_texts(4, hot=20, n=60)
    got = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == brute_classes(rows)


def test_linking_compares_what_a_leader_misses(spark):
    """In one bucket, items are alike if they differ by one: no leader is alike to all, yet all are one group."""
    entries = spark.createDataFrame([(1, i) for i in range(12)] + [(2, i) for i in range(100, 104)], "bucket long, node long")
    verify = lambda pairs: pairs.filter("abs(a - b) <= 1")
    _, roots = linking.link(entries, verify, Scratch(spark, "t"))
    assert {r.node: r.root for r in roots.collect()} == {i: 0 for i in range(12)} | {i: 100 for i in range(100, 104)}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bounds_and_bits_against_the_plain_edit_distance():
    rng = random.Random(6)
    for n in range(1500):
        alphabet = "abé " if n % 2 else "ab"
        a = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30)))
        b = list(a)
        for _ in range(rng.randrange(0, 9)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", *alphabet])
        b = "".join(b)
        true = edit(a, b)
        assert fuzzy_lines.least_edits([a], [b])[0] <= true
        for most in range(12):
            assert fuzzy_lines.within(a, b, most) == (true <= most)
            assert true <= most or not fuzzy_lines.at_most(a.split(" "), b.split(" "), most)


def line_texts(seed):
    rng = random.Random(seed)
    bases = [" ".join(f"word{rng.randrange(300)}" for _ in range(rng.randrange(3, 25))) for _ in range(12)]
    out = []
    for d in range(50):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice("abcxyz ")
            lines.append("".join(line).upper() if rng.random() < 0.2 else "".join(line))
        out.append((d, "\n".join([*lines, "", " "])))
    return out


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_fuzzy_lines_against_brute_force(spark, blocks):
    rows = line_texts(blocks)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines, marks = fuzzy_lines.find_groups(df, blocks=blocks)
    normal = {(r.doc_id, r.line): r.n for r in df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("doc_id", "line", fuzzy_lines.normal(F.col("t")).alias("n")).collect()}
    simhash = {(r.doc_id, r.line): r.simhash for r in lines.collect()}
    assert set(simhash) == {k for k, n in normal.items() if n}
    nodes = sorted(simhash)
    near = lambda a, b: bin((simhash[a] ^ simhash[b]) & (1 << 64) - 1).count("1") <= 3
    links = []
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            x, y = normal[a], normal[b]
            if x == y or near(a, b) and edit(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9):
                links.append((a, b))
    root = closed(nodes, links)
    want = {n: r for n, r in root.items() if n != r}
    assert {(r.doc_id, r.line): (r.keeper_doc_id, r.keeper_line) for r in marks.collect()} == want and len(want) > 50
    assert any(normal[n] != normal[r] for n, r in want.items())


@pytest.mark.parametrize("seed", [4, 5])
def test_fuzzy_lines_recall_against_plain_edit_similarity(spark, seed):
    """No bit condition here: one or two changed words in a line, and typos in short ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(3, 9)))
    rows = []
    for n in [4, 5, 7, 9, 12, 15, 15, 18, 24, 30, 45, 60] * 5:
        base = [word() for _ in range(n)]
        other = list(base)
        if n < 9:
            at = rng.randrange(n)
            other[at] = rng.choice("uvwxyz") + other[at][1:]
        else:
            for at in rng.sample(range(n), max(1, n // 9)):
                other[at] = word()
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    true = [i for i in range(0, len(rows), 2) if edit(rows[i][1], rows[i + 1][1]) <= int(0.2 * max(len(rows[i][1]), len(rows[i + 1][1])) + 1e-9)]
    _, marks = fuzzy_lines.find_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.keeper_doc_id, r.doc_id) for r in marks.collect()}
    assert len(true) > 50 and sum((i, i + 1) in got for i in true) >= 0.98 * len(true)
    assert all(a + 1 == b and a in true for a, b in got)


def test_fuzzy_lines_move_the_texts_of_pairs_only(spark, monkeypatch):
    """Lines that are in no pair are not sent to a comparison, and bands are not kept to the end."""
    lines = spark.createDataFrame([(i << 33, f"line {i}") for i in range(2000)], "node long, text string")
    pairs = spark.createDataFrame([(i << 33, (i + 1) << 33) for i in range(0, 40, 2)], "a long, b long")
    for end in "ab":
        got = {r.node for r in fuzzy_lines._of(lines, pairs, end).collect()}
        assert got >= {r[end] for r in pairs.collect()} and len(got) < 100
    kept, dropped = {}, set()
    keep, drop = Scratch.keep, Scratch.drop
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, by=None: kept.update({name: df.columns}) or keep(self, df, name, by))
    monkeypatch.setattr(Scratch, "drop", lambda self, *names: dropped.update(names) or drop(self, *names))
    fuzzy_lines.find_groups(spark.createDataFrame(line_texts(7), "doc_id long, text string"))
    assert not {name for name, columns in kept.items() if {"bands", "buckets"} & set(columns)} - dropped


def test_fuzzy_lines_of_odd_rows(docs, corpus, empty):
    got = fuzzy_lines.dedup_lines(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in corpus)
    by_id = {r.doc_id: r for r in got}
    assert by_id[102].n_removed == by_id[103].n_removed == by_id[104].n_removed == 0
    assert by_id[7].n_removed == 0 and by_id[111].n_removed == by_id[111].n_lines and 7 in by_id[111].keepers
    cleaned = fuzzy_lines.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(corpus)
    assert {r.doc_id: r.text for r in cleaned.collect()}[7] == corpus[7][1]
    assert fuzzy_lines.dedup_lines(empty).collect() == []


def test_more_blocks_for_more_lines():
    assert [fuzzy_lines.blocks_for(n) for n in (10, 10**6, 10**9, 10**14)] == [4, 5, 6, 7]


def brute_spans(rows, min_words):
    first, out = {}, []
    ranked = sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0] or 0))
    cut = [(d, list(unit_dedup._units(t, "sentence"))) for d, t in ranked]
    for d, units in cut:
        for i, u in enumerate(units):
            first.setdefault(u[3], (d, i))
    for d, units in cut:
        run = []
        for i, u in enumerate([*units, None]):
            if u and first[u[3]] != (d, i):
                run.append(u)
            elif run:
                if (n := sum(x[2] for x in run)) >= min_words:
                    out.append((d, run[0][0], run[-1][1], n))
                run = []
    return out


def test_repeated_spans_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda start, n: start + "".join(chr(97 + int(c)) for c in str(rng.randrange(n)))
    passage = " ".join(" ".join(word("p", 99) for _ in range(9)) + "." for _ in range(6))
    rows = []
    for d in range(60):
        own = [" ".join(word("d", 99999) for _ in range(rng.randrange(3, 14))) + rng.choice([".", "!", "\n"]) for _ in range(8)]
        if d % 4 == 0:
            at = rng.randrange(8)
            own[at] = own[at].rstrip(".!\n") + " " + passage
        if d % 9 == 0:
            own.append("Terms and 12 conditions apply.")
        rows.append((d, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = unit_dedup.repeated_spans(df)
    want = brute_spans(rows, unit_dedup.MIN_WORDS)
    assert sorted((r.doc_id, r.start, r.end, r.words) for r in got.collect()) == sorted(want)
    assert {d for d, *_ in want} == {d for d in range(4, 60, 4)}
    cleaned = {r.doc_id: r.text for r in unit_dedup.remove_spans(df, got).collect()}
    for d, t in rows:
        mine = [w for w in want if w[0] == d]
        for _, a, b, _ in reversed(mine):
            t = t[:a] + t[b:]
        assert cleaned[d] == t


def test_spans_of_odd_rows(docs, corpus, empty):
    got = unit_dedup.repeated_spans(docs).collect()
    assert {r.doc_id for r in got} >= {110, 117} and 7 not in {r.doc_id for r in got}
    assert not {102, 103, 104} & {r.doc_id for r in got}
    assert unit_dedup.repeated_spans(empty).collect() == []
    left = unit_dedup.remove_spans(docs, unit_dedup.repeated_spans(docs))
    assert left.columns == docs.columns and left.count() == len(corpus)


@pytest.mark.parametrize("reach", [5, 60, 400])
def test_passages_pasted_at_any_word(spark, monkeypatch, reach):
    """Edge sentences of a passage differ, as it starts and ends inside others; short whole units are in between."""
    monkeypatch.setattr(unit_dedup, "REACH", reach)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    some = lambda n: " ".join(word() for _ in range(n))
    passage = f"{some(16)}. {some(9)}. {some(7)}. {some(18)}"
    rows = [(d, f"{some(12)}. {some(5)} {passage} {some(6)}. {some(11)}.") for d in range(12)]
    rows += [(20, f"{some(4)} {passage} {some(3)}. {some(5)} {passage} {some(2)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = unit_dedup.repeated_passages(df)
    found = sorted((r.doc_id, dict(rows)[r.doc_id][r.start : r.end], r.words) for r in got.collect())
    assert found == sorted([(d, passage, 50) for d in range(1, 12)] + [(20, passage, 50)] * 2)
    assert all(passage not in r.text for r in unit_dedup.remove_spans(df, got).collect() if r.doc_id)


def test_passages_repeated_in_one_text(spark):
    rows = [(1, "one two three. " * 30), (2, " ".join(f"{a} lead word. and more" for a in ("x", "y")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = unit_dedup.repeated_passages(df, 3)
    left = {r.doc_id: " ".join(r.text.split()) for r in unit_dedup.remove_spans(df, got).collect()}
    assert left[1] == "one two three." and left[2] == rows[1][1]


def test_every_repeated_line_goes_whatever_its_length(spark):
    rng = random.Random(13)
    own = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(12))
    rows = [(d, f"{own()}\nShare this page with friends\n{own()} Read more. {own()}\nHome") for d in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = unit_dedup.repeated_passages(df)
    found = sorted((r.doc_id, dict(rows)[r.doc_id][r.start : r.end], r.words, r.kept_doc_id) for r in got.collect())
    assert found == sorted((d, *x, 0) for d in range(1, 6) for x in (("Share this page with friends", 5), ("Home", 1)))


@pytest.mark.parametrize("letters", ["ab ", "abcdefgh ijk\u00fc", "\u5b57\u6f22\u65e5\u672c\u8a9eab", "a\U0001f600\ud800"])
def test_edit_distances_of_many_pairs_at_once(letters, monkeypatch):
    """Lengths around those of blocks, few and many pairs, and tables that have to be halved."""
    rng, a, b = random.Random(3), [], []
    for _ in range(500):
        x = [rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 40, 63, 64, 65, 100, 128, 129, 300]))]
        y = list(x)
        for _ in range(int(len(x) * rng.random() * 0.35)):
            i = rng.randrange(len(y) + 1)
            y[i : i + rng.randrange(2)] = rng.choice(letters) if rng.random() < 0.6 else ""
        y = y if rng.random() < 0.8 else [rng.choice(letters) for _ in y]
        a.append("".join(x))
        b.append("".join(y))
    most = np.array([max(len(x), len(y)) // 5 for x, y in zip(a, b, strict=True)])
    want = [fuzzy_lines.within(x, y, int(k)) for x, y, k in zip(a, b, most, strict=True)]
    assert 50 < sum(want) < 450
    assert edits.within_all(a, b, most, fuzzy_lines.within).tolist() == want
    assert fuzzy_lines.alike_lines(a, b, 0.8).tolist() == want
    monkeypatch.setattr(edits, "CELLS", 1 << 10)
    assert edits.within_all(a, b, most, fuzzy_lines.within).tolist() == want


def test_common_words_bring_no_lines_together():
    """Lines that share their common words alone meet in no band; near copies do, on either side of the number of rare words."""
    rng = random.Random(8)
    common = ["that", "with", "from", "this", "have", "were", "they", "been"]
    rare = lambda: "".join(rng.choice("bcdfghjklmnp") for _ in range(8))
    lines = [[w for _ in range(12) for w in (common[rng.randrange(8)], rare())] for _ in range(300)]
    found = fuzzy_lines.common_features([" ".join(line).encode() for line in lines])
    assert len(found[0]) == len(common)
    bits = np.zeros(1 << 16, dtype=bool)
    bits[found[0].view(np.int64) & (1 << 16) - 1] = True
    known = (np.packbits(bits, bitorder="little").tobytes(), bytes(8))
    meeting = lambda texts, *known: sum(n * (n - 1) // 2 for n in Counter(x for b in fuzzy_lines.lines_of([t.encode() for t in texts], *known)["bands"] for x in b).values())
    texts = [" ".join(line) for line in lines]
    assert meeting(texts) > 10 * (meeting(texts, known) + 1)
    # copies are no reason to call a word common
    assert not len(fuzzy_lines.common_features([("one passage that is copied " * 4).encode() + str(i).encode() for i in range(500)])[0])
    for n in range(6, 16):
        base = [*common, *(rare() for _ in range(n))]
        other = [*base[:-1], rare()]
        met = sum(meeting([" ".join(base), " ".join([*base[:-1], rare()])], known) > 0 for _ in range(20))
        assert met >= 18, (n, met, other)


def test_common_features_are_learned_without_the_whole_sample_in_a_worker(spark, monkeypatch):
    """Batches' pairs are counted apart by feature, and give what the whole sample gives at once."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(("that", "with", "from")) + " " + "".join(rng.choice("bcdfgh") for _ in range(5)) for _ in range(30)) for _ in range(200)]
    monkeypatch.setattr(fuzzy_lines, "GRAM_FOLLOWED", 40)
    monkeypatch.setattr(textscan, "AT_ONCE", 1 << 12)
    parts = pd.concat(fuzzy_lines._following(iter([pd.DataFrame({"text": texts + texts[:50]})])))
    held = [len(x) // 8 for x in parts["pairs"]]
    assert max(held) * 20 < sum(held)
    found = pd.concat(fuzzy_lines._common(own) for _, own in parts.groupby(["part", "kind"]))
    for kind, want in enumerate(fuzzy_lines.common_features([x.encode() for x in texts])):
        assert len(want) and sorted(found["hash"][found["kind"] == kind]) == sorted(want.view(np.int64))
