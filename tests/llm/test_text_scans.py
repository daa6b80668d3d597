import hashlib
import random
import re

import pytest

from eventloom.llm import decontamination, license_scan, outliers

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        iw = words(item)
        for s in range(max(1, len(iw) - 9) if iw else 0):
            win = iw[s : s + 10]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(item_id))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_against_brute_force(spark, docs, corpus):
    rng = random.Random(1)
    text = words(corpus[3][1]) + words(corpus[4][1])
    items = [(1, " ".join(text[:14])), (2, "a b"), (10, "Käse"), (3, None), (4, ""), (5, " ".join(text[4:30])), (6, " ".join(f"w{rng.randrange(400)}" for _ in range(25))), (7, corpus[8][1][:150]), (7, corpus[9][1])]
    items += [(8, " ".join(["wb"] * 12)), (9, " ".join(words(corpus[60][1])[3000:3030]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.scan(docs, bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(
        (str(d), *(b := brute_hits(t, items)), b[1] > 0) for d, t, *_ in corpus
    )
    assert sum(r.contaminated for r in got) > 5


def test_proximity_matches_do_not_contaminate(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    near = item.replace("delta", "delta other")
    docs = spark.createDataFrame([(1, item), (2, near), (3, "nothing of it")], "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_near) for r in decontamination.scan(docs, spark.createDataFrame([("x", item)], "item_id string, text string")).collect()}
    assert got == {1: (True, 0), 2: (False, 1), 3: (False, 0)}


def test_decontamination_of_and_by_nothing(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.scan(empty, none).collect() == []
    assert decontamination.scan(docs, none).filter("contaminated or n_items > 0").count() == 0


def test_license_places_against_brute_force(spark):
    rng = random.Random(2)
    parts = ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC 4.0", "under the", "mit license", "foo", "bar", "version 2", "under the mit license mit license"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(200)] + [None, "", "cc by nc"]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        places = [(p, label) for phrase, label in license_scan.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_texts_with_changed_words(spark):
    text = license_scan.TEMPLATES["mit-text"].split()
    changed = [*text[:12], "inserted", *text[12:30], *text[31:]]
    rows = [(1, "Preface. " + " ".join(changed) + " more"), (2, " ".join(text[:10])), (3, "free of charge to any person"), (1, "Preface. " + " ".join(changed) + " more")]
    got = [(r.doc_id, r.labels) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, "mit-text"), (1, "mit-text"), (2, ""), (3, "")]


def test_a_template_behind_many_copies_of_a_piece_of_it(spark):
    """Their diagonals chain to a span far longer than the template; it is found on its own diagonal."""
    passage = license_scan.TEMPLATES["all-rights-reserved"]
    rows = [(1, passage), (2, "All rights reserved. " * 40 + passage), (3, "All rights reserved. " * 40), (4, None)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.labels for i, r in got.items()} == {1: "all-rights-reserved", 2: "all-rights-reserved", 3: "", 4: ""}
    assert got[1].score == got[2].score == 1.0 and got[3].score == 0


def statistics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {x for x in wins if wins.count(x) > 1} if len(wins) < 3000 else {x for x, n in __import__("collections").Counter(wins).items() if n > 1}
    hit = {j for i, x in enumerate(wins) if x in many for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def test_statistics_against_brute_force(spark, docs, corpus):
    extra = ["a b c a b c a b c", "x\nx\n \n \nx y", "# $ %% <b>", "one two three one two", "a a a a", "é é é é\né é é é", " ".join(["r s t u"] * 30)]
    df = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame([(1000 + i, t, "en", None) for i, t in enumerate(extra)], "doc_id long, text string, lang string, source string"))
    got = outliers.judge(df).collect()
    want = [(str(d), *statistics(t)) for d, t, *_ in corpus] + [(str(1000 + i), *statistics(t)) for i, t in enumerate(extra)]
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert not any(r.kept and r.base_failed for r in got)


def test_outliers_are_rejected_and_the_others_kept(spark):
    rng = random.Random(4)
    plain = lambda n: " ".join("abcdefghij"[: rng.randrange(2, 9)] + str(rng.randrange(900)) for _ in range(n))
    rows = [(i, plain(rng.randrange(60, 400)), "en", rng.choice(["a", "a", "b"])) for i in range(300)]
    rows += [(1000 + i, " | ".join(plain(80).split()), "en", "a") for i in range(10)] + [(2000 + i, plain(90).replace(" ", "qwertyuiop "), "en", "b") for i in range(5)]
    rows += [(3000, plain(100), "fr", "rare")]
    got = {r.doc_id: r.kept for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i] for i in got if 1000 <= i < 3000)
    assert all(got[i] for i in got if i < 1000 or i == 3000)


def distances(rows):
    """Distances of (lang, source, n, chars, symbols, dup, repeated) by the definition, with numpy."""
    import numpy as np

    lang, source = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    n, chars, symbols, dup, again = (np.array([r[i] for r in rows], dtype=float) for i in range(2, 7))
    wide = n + outliers.PRIOR
    usual = np.array([chars[lang == x].sum() / n[lang == x].sum() for x in lang])
    x = np.stack([np.log((chars + outliers.PRIOR * usual) / wide), np.sqrt(symbols / wide), np.log1p(10 * dup / np.sqrt(wide)), np.sqrt(again / wide)], axis=1)
    at = lambda v, q: np.sort(v)[max(int(np.ceil(q * len(v))), 1) - 1]

    def scatter(rows, least, inner):
        c = np.cov(rows.T, bias=True)
        if inner:
            c = c / outliers.SHRINKS[max(int((np.diag(c) > least**2).sum()), 1) - 1]
        return c + np.diag(np.maximum(least**2 - np.diag(c), 0))

    def square(rows, m, c):
        z = np.linalg.solve(np.linalg.cholesky(c), (rows - m).T)
        return (z * z).sum(axis=0)

    def mcd(mine):
        rows, middle = x[mine], at(n[mine], 0.5) + outliers.PRIOR
        least = np.array([outliers.LEAST_LENGTH, np.sqrt(1 / middle), np.log1p(10 / np.sqrt(middle)), np.sqrt(6 / middle)])
        median = np.array([at(c, 0.5) for c in rows.T])
        spread = np.array([at(np.abs(c - m), 0.5) for c, m in zip(rows.T, median)]) * 1.4826
        starts = []
        for m, c in ((median, np.diag(np.maximum(spread, least) ** 2)), (rows.mean(axis=0), scatter(rows, least, False))):
            for _ in range(outliers.STEPS):
                d = square(rows, m, c)
                inner = rows[d <= at(d, outliers.SHARE)]
                m, c = inner.mean(axis=0), scatter(inner, least, True)
            starts.append((np.linalg.slogdet(c)[1], m, c))
        return min(starts, key=lambda t: t[0])[1:]

    mix = lambda k, own, parent: tuple((k * a + outliers.SMALL * b) / (k + outliers.SMALL) for a, b in zip(own, parent))
    every = mcd(np.ones(len(rows), dtype=bool))
    out = np.zeros(len(rows))
    for one in sorted(set(lang)):
        mine = lang == one
        parent = mix(mine.sum(), mcd(mine), every)
        for two in sorted(set(source[mine])):
            here = mine & (source == two)
            out[here] = square(x[here], *mix(here.sum(), mcd(here), parent))
    return out


def test_distances_and_verdicts_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "abcdefghij"[: min(9, max(2, int(rng.gauss(5, 2))))] + str(rng.randrange(900))
    rows = []
    for i in range(420):
        text = [word() for _ in range(rng.randrange(60, 300))]
        if rng.random() < 0.3:
            text[10:10] = text[:3] * rng.randrange(1, 4)
        text = " ".join(text) + ("\nsame line\nsame line" if rng.random() < 0.3 else "")
        if rng.random() < 0.3:
            text = text.replace(" a", " #a", rng.randrange(1, 40))
        rows.append((i, text, rng.choice(["en", "en", "de"]), rng.choice("aaab" if i < 400 else "c")))
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    good = [(i, lang, source) for i, text, lang, source in rows if not statistics(text)[-1]]
    want = distances([(lang, source, *statistics(rows[i][1])[:5]) for i, lang, source in good])
    assert [got[i].distance for i, *_ in good] == pytest.approx(list(want), rel=1e-6)
    assert [got[i].kept for i, *_ in good] == [d <= outliers.CHI2_CUT for d in want] and 5 < sum(want > outliers.CHI2_CUT) < 200


def test_the_estimate_is_that_of_the_inner_share(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    inner = rng.multivariate_normal([1, 2, 3, 4], np.diag([1, 0.5, 2, 1]) + 0.3, 2000)
    outer = rng.normal(12, 1, (300, 4))
    rows = [("en", "s", *map(float, x)) for x in np.vstack((inner, outer))]
    df = spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double")

    def keep(frame, name):
        frame.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    r = outliers.estimate(df, keep).first()
    assert [r[f"m{i}"] for i in range(4)] == pytest.approx([1, 2, 3, 4], abs=0.25)
    assert all(r[f"l{i}{i}"] < 3 for i in range(4))


def test_scans_of_nothing(empty):
    assert license_scan.scan(empty).collect() == [] and outliers.judge(empty).collect() == []
