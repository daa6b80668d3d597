"""Near-duplicates by BagMinHash (Ertl, 2018), banding, and exact overlap of multisets.

A text is the multiset of its five-word shingles. A shingle's weights are discretised to whole counts; the unit
intervals below its count carry independent Poisson processes, arranged as trees: intervals (0,1], (1,2], (2,4],
(4,8], ... with halves below. The first point of an interval is drawn with the interval's length as rate and belongs
to either half by chance; the other half draws its own beyond it. Every point has a time and a component of the
signature; a component holds the least time among the points below the counts of the text. Trees depend on the shingle
alone, so two texts agree in a component with the probability of their weighted Jaccard similarity. Intervals whose next
point lies beyond the signature's largest time are left, which is soon the case: a text with w shingles and m components
needs about w + m ln m points whatever the counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Scratch, bitmap, has, item_words, row_key, text_of
from eventloom.llm.linking import FIRST, MOST_SENT, link_items

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
M = BANDS * ROWS
#: Entries of a left-over bucket above which it is cut by rare codes.
WHOLE = 100
#: Numbers of bags from which a code counts as more common.
OFTEN = (1, 8, 64, 512)
#: Words handled at once by a worker; a longer text is handled alone.
AT_ONCE = 300_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.random.default_rng(5).integers(1, 1 << 62, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads any difference over all bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _wait(seed: np.ndarray) -> np.ndarray:
    """Exponential waiting times of rate 1 from 64-bit seeds."""
    return -np.log(((mix(seed) >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53)))


def bags(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of texts to (text, shingle, count), sorted by text. Fewer than five words make one shingle."""
    sizes = np.array([len(w) for w in words])
    wide = np.where(sizes > 0, np.maximum(sizes, SHINGLE), 0)
    start = np.concatenate(([0], np.cumsum(wide)))
    flat = np.zeros(start[-1] + SHINGLE, dtype=np.uint64)
    for w, at in zip(words, start, strict=False):
        flat[at : at + len(w)] = w
    text = np.repeat(np.arange(len(words)), wide)
    total = np.zeros(start[-1], dtype=np.uint64)
    for k in range(SHINGLE):
        total += flat[k : k + start[-1]] * _STEPS[k]
    inside = np.arange(start[-1]) <= (start[1:] - SHINGLE)[text]
    text, shingle = text[inside], mix(total[inside])
    order = np.argsort((text.astype(np.uint64) << np.uint64(53)) | (shingle >> np.uint64(11)))  # at most 2,000 texts at once
    text, shingle = text[order], shingle[order]
    first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1]))) if len(text) else np.zeros(0, bool))
    return text[first], shingle[first], np.diff(np.concatenate((first, [len(text)])))


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """n signatures of m least times; a text without shingles keeps infinities."""
    least = np.full(n * m, np.inf)

    def points(t: np.ndarray, x: np.ndarray) -> None:
        np.minimum.at(least, t * m + (mix(x.view(np.uint64)) % np.uint64(m)).astype(np.int64), x)

    with np.errstate(over="ignore"):
        # one interval (0, 1] for each shingle, and further ones of doubling length as far as the count reaches
        parts = [(text, shingle, count, np.zeros(len(text), np.int64), np.ones(len(text), np.int64))]
        reach = 1
        while (more := count > reach).any():
            size = int(more.sum())
            parts.append((text[more], shingle[more], count[more], np.full(size, reach), np.full(size, reach)))
            reach *= 2
        t, s, c, low, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        seed = mix(s + _ODD * (low + (length << 32)).astype(np.uint64))
        x = _wait(seed) / length
        fresh = np.ones(len(t), bool)
        step = np.zeros(len(t), np.uint64)
        while len(t):
            whole = fresh & (low + length <= c)
            points(t[whole], x[whole])
            most = least.reshape(n, m).max(axis=1)
            live = (x <= most[t]) & (low < c)
            t, s, c, low, length, seed, x, step = (a[live] for a in (t, s, c, low, length, seed, x, step))
            unit = length == 1
            # unit intervals: their next points, several at once when few are left
            ahead = 1 if unit.sum() > 20_000 else 16
            ut, useed, ustep = t[unit], seed[unit], step[unit]
            draws = ustep[:, None] + np.arange(1, ahead + 1, dtype=np.uint64)[None, :]
            times = x[unit][:, None] + np.cumsum(_wait(useed[:, None] + _ODD * draws), axis=1)
            if ahead > 1:
                inner = times[:, :-1]
                use = inner <= most[ut][:, None]
                points(np.broadcast_to(ut[:, None], inner.shape)[use], inner[use])
            # longer ones: halves, one of which keeps the point that has been counted or not
            wide = ~unit
            wt, ws, wc, wl, wh, wx = t[wide], s[wide], c[wide], low[wide], length[wide] // 2, x[wide]
            right = (mix(seed[wide] + np.uint64(1)) & np.uint64(1)).astype(np.int64)
            counted = wl + 2 * wh <= wc
            own_low, other_low = wl + right * wh, wl + (1 - right) * wh
            own_seed, other_seed = (mix(ws + _ODD * (a + (wh << 32)).astype(np.uint64)) for a in (own_low, other_low))
            other_x = wx + _wait(other_seed) / wh
            zero = np.zeros(len(wt), np.uint64)
            t = np.concatenate((ut, wt, wt))
            s = np.concatenate((s[unit], ws, ws))
            c = np.concatenate((c[unit], wc, wc))
            low = np.concatenate((low[unit], own_low, other_low))
            length = np.concatenate((length[unit], wh, wh))
            seed = np.concatenate((useed, own_seed, other_seed))
            x = np.concatenate((times[:, -1], wx, other_x))
            step = np.concatenate((ustep + np.uint64(ahead), zero, zero))
            fresh = np.concatenate((np.ones(len(ut), bool), ~counted, np.ones(len(wt), bool)))
    return least.reshape(n, m)


def _chunks(words: list[np.ndarray]) -> Iterator[slice]:
    start, held = 0, 0
    for i, w in enumerate(words):
        if i > start and (held + len(w) > AT_ONCE or i - start >= 2000):
            yield slice(start, i)
            start, held = i, 0
        held += len(w)
    if start < len(words):
        yield slice(start, len(words))


def _hashed(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(w, dtype=np.int64).view(np.uint64) for w in frame["w"]]


def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, key, w) to (doc_id, key, digest, weight, bands); bands hash ROWS components each."""
    for frame in frames:
        hashed = _hashed(frame)
        for part in _chunks(hashed):
            words = hashed[part]
            n = len(words)
            text, shingle, count = bags(words)
            least = signatures(text, shingle, count, n).view(np.uint64).reshape(n, BANDS, ROWS)
            with np.errstate(over="ignore"):
                band = np.arange(BANDS, dtype=np.uint64)[None, :] * _ODD
                for k in range(ROWS):
                    band = mix(band + least[:, :, k])
            out = frame.iloc[part][["doc_id", "key"]].copy()
            out["digest"] = [hashlib.md5(w.tobytes()).digest() for w in words]
            out["weight"] = np.array([max(0, len(w) - SHINGLE + 1) if len(w) >= SHINGLE else int(len(w) > 0) for w in words], dtype=np.int64)
            out["bands"] = list(band.view(np.int64))
            yield out


def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, w) to (node, codes): one code for each shingle and occurrence, so that sets of codes overlap as multisets do."""
    for frame in frames:
        hashed = _hashed(frame)
        for part in _chunks(hashed):
            words = hashed[part]
            text, shingle, count = bags(words)
            with np.errstate(over="ignore"):
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                codes = mix(np.repeat(shingle, count) + _ODD * nth.astype(np.uint64)).view(np.int64)
            ends = np.cumsum(np.bincount(np.repeat(text, count), minlength=len(words)))
            out = frame.iloc[part][["node"]].copy()
            out["codes"] = np.split(codes, ends[:-1])
            yield out


def rarest(levels, share: Fraction) -> Callable:
    """(node, ..., codes) to the same with the codes that a bag has to share one of with an alike one of another component.

    Alike bags share at least `share` of either's codes. So in any order of all codes the first shared one has, in both bags,
    as many codes from it on; those behind are left out. The order is by how many bitmaps have a code, few first; codes that
    none has are in one component only and left out as well.
    """

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for codes in frame["codes"]:
                codes = np.asarray(codes, dtype=np.int64)
                level = np.sum([has(bits, codes) for bits in levels.value], axis=0)
                needed = -(-len(codes) * share.numerator // share.denominator)
                first = np.lexsort((codes, level))[: len(codes) - needed + 1]
                out.append(codes[first[level[first] > 0]])
            yield frame.assign(codes=pd.Series(out, index=frame.index, dtype=object))

    return pick


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of docs: doc_id, key, class_id, class_key, class_size, weight.

    class_id is the smallest doc_id (class_key the smallest key of its rows) among the rows that are joined, directly or through others, by a weighted Jaccard
    similarity of their shingle multisets of at least `similarity`; class_size counts those rows. Texts with equal words are one text. Rows without
    words, null ones too, stay alone. Repeated rows are copies of each other; a null doc_id counts as smallest only if
    no other is there. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    scratch, share = Scratch(spark, "bagminhash"), Fraction(similarity).limit_denominator(1000)
    tokens = F.transform(item_words(text_of()), lambda w: F.xxhash64(w))
    hashed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), tokens.alias("w"))
    signed = scratch.keep(hashed.mapInPandas(sign, "doc_id string, key binary, digest binary, weight long, bands array<long>").withColumn("doc_id", F.col("doc_id").cast("long")), "signed")
    texts = signed.filter("weight > 0").groupBy("digest")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("key"))
    texts = texts.agg(F.min(row).alias("first"), F.count("*").alias("copies"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    texts = scratch.keep(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    named, bands = texts.select("node", F.col("first.key").alias("_key")), texts.select("node", "weight", "bands")
    # texts that share a band; of many buckets most texts share one of the first few, so only the others' bands are all looked up
    placed = lambda df, of: df.select("node", F.explode(of).alias("bucket"))
    shared = placed(bands, F.col("bands")).groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("bucket").alias("_b"))
    shared = scratch.keep(shared, "shared")
    if shared.count() <= MOST_SENT:
        there = placed(bands, F.col("bands")).join(F.broadcast(shared), F.col("bucket") == F.col("_b"), "left_semi")
        met = scratch.keep(there.select("node").distinct(), "met")
    else:
        inside = lambda df: df.join(shared, F.col("bucket") == F.col("_b"), "left_semi").select("node").distinct()
        soon = scratch.keep(inside(placed(bands, F.slice("bands", 1, FIRST))), "soon")
        late = inside(placed(bands.join(soon, "node", "left_anti"), F.col("bands")))
        met = scratch.keep(soon.unionByName(late), "met")
    wanted = named.join(met, "node", "left_semi")
    found = hashed.join(wanted, F.col("key") == F.col("_key")).select("node", "w")
    codes = scratch.keep(found.mapInPandas(coded, "node long, codes array<long>").dropDuplicates(["node"]), "codes")

    def verify(pairs: DataFrame) -> DataFrame:
        one, two = (codes.select(F.col("node").alias(f"_{x}"), F.col("codes").alias(f"c{x}")) for x in "ab")
        both = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
        same = F.size(F.array_intersect("ca", "cb")) * F.lit(share.numerator + share.denominator)
        return both.filter(same >= (F.size("ca") + F.size("cb")) * F.lit(share.numerator)).select("a", "b")

    def finer(rest: DataFrame) -> DataFrame:
        """How many of a node's codes no other node that is left has; and large buckets cut by rare codes.

        Such codes cannot be shared; where all that is left to share is too little for any node of the bucket, it goes.
        Buckets of up to WHOLE entries go on as they are. The nodes of larger ones meet by their rarest codes, so that no pair is lost.
        """
        nodes = rest.select(F.col("node").alias("_n"), "root").distinct()
        spread = codes.join(nodes, F.col("node") == F.col("_n")).select("node", "root", F.explode("codes").alias("code")).groupBy("code")
        spread = spread.agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        spread = scratch.keep(spread.filter("n = 1 or lo <> hi"), "spread")
        own = scratch.keep(spread.filter("n = 1").groupBy(F.col("node").alias("_u")).agg(F.count("*").alias("own")), "own")
        kept = ["bucket", "node", "root", "weight", "own"]
        rest = rest.join(own, F.col("node") == F.col("_u"), "left").withColumn("own", F.coalesce("own", F.lit(0))).select(*kept)
        least = rest.groupBy(F.col("bucket").alias("_b")).agg(F.min("weight").alias("least"), F.count("*").alias("n"))
        core = F.col("weight") - F.col("own")
        rest = rest.join(least, F.col("bucket") == F.col("_b")).filter(core * share.denominator >= (F.greatest("least", core) + F.col("own")) * share.numerator)
        rest = scratch.keep(rest.select(*kept, "n"), "fewer")
        large = scratch.keep(rest.filter(F.col("n") > WHOLE).select(*kept[1:]).distinct(), "large")
        every = large.join(codes.select(F.col("node").alias("_n"), "codes"), F.col("node") == F.col("_n")).drop("_n")
        often = spread.filter("lo <> hi")
        levels = spark.sparkContext.broadcast([bitmap(often.filter(F.col("n") >= n), F.col("code")) for n in OFTEN])
        scratch.drop("spread")
        rare = every.mapInPandas(rarest(levels, share), "node long, root long, weight long, own long, codes array<long>")
        return rest.filter(F.col("n") <= WHOLE).drop("n").unionByName(rare.withColumn("bucket", F.explode("codes")).select(*kept))

    def fits(a: dict, b: dict) -> Column:
        """What two bags can share at most against what they hold together at least."""
        own_a, own_b = (x.get("own", F.lit(0)) for x in (a, b))
        core_a, core_b = a["weight"] - own_a, b["weight"] - own_b
        return F.least(core_a, core_b) * share.denominator >= (F.greatest(core_a, core_b) + own_a + own_b) * share.numerator

    items = bands.join(met, "node", "left_semi").withColumnRenamed("bands", "buckets")
    _, roots = link_items(items, verify, scratch, [finer], fits)
    rooted = texts.join(roots.withColumnRenamed("node", "_r"), F.col("node") == F.col("_r"), "left").withColumn("root", F.coalesce("root", "node"))
    classes = rooted.groupBy("root").agg(F.min("first").alias("lead"), F.sum("copies").alias("class_size")).withColumnRenamed("root", "_c")
    of_text = rooted.select("digest", "node", "root").join(classes, F.col("root") == F.col("_c"))
    of_text = of_text.select(F.col("digest").alias("_d"), "lead", "class_size")
    rows = signed.select("doc_id", "key", "weight", F.when(F.col("weight") > 0, F.col("digest")).alias("digest"))
    return rows.join(of_text, F.col("digest") == F.col("_d"), "left").select(
        "doc_id",
        "key",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("class_id"),
        F.coalesce("lead.key", "key").alias("class_key"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        "weight",
    )


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class: of the least doc_id (null last), then of the least key; the same columns.

    Null, empty and wordless texts are all kept. Repeated rows with words are copies, of which one stays. Very long texts are read
    whole; an empty table stays empty; other columns are kept, whatever their names.
    """
    name = "__el_key"
    marked = Scratch(docs.sparkSession, "bagminhash").keep(near_duplicates(docs, similarity), "marked")
    dropped = marked.filter("key <> class_key").select(F.col("key").alias(name)).distinct()
    rest = docs.withColumn(name, row_key(F.col("doc_id"), F.col("text"))).join(dropped, name, "left_anti")
    repeated = marked.filter("weight > 0").groupBy(F.col("key").alias(name)).agg(F.count("*").alias("n")).filter("n > 1").select(name)
    many = rest.join(repeated, name, "left_semi").dropDuplicates([name])
    return rest.join(repeated, name, "left_anti").unionByName(many).select(*docs.columns)
