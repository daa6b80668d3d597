"""Toxicity by a classifier with counterfactual regularisation.

Logistic regression over words and word beginnings. Every training text that names a group is paired with copies in
which the group's name is swapped for another one, and for a neutral word; the squared change of the score between the
two is part of the loss. So what a score says about an insult cannot hang on who is named next to it, and a neutral
mention of a group scores like the same sentence about people.

A corpus may be written in words that no list holds. Terms that behave as names do are therefore found in the training
rows as well: words in at least a share COMMON of them that carry no label signal of their own. Those of like frequency
form a set of SET names, each of which is swapped for the next one; every training text with such terms has a copy in
which all of them are swapped. A word beginning that neutral words share with insults so loses its say.

Features are counted by a grouped aggregation over the written training rows. The driver gets the telling features,
the swap sets and, for each training row, the numbers of its telling features alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Scratch, ascii_lower, doc_crc, text_of

#: The fit reads at most about this many labelled rows, taken by a hash of the id.
TRAIN_ROWS = 12_000
THRESHOLD = 0.7
PENALTY = 4.0
RIDGE = 0.001
#: Features are used if their count in toxic texts is this many standard deviations off the expected one.
TELLING = 3.0
#: Found names: the least share of training rows that hold one, the most that its count may be off, and the size of a set.
COMMON, NEUTRAL, SET = 0.01, 0.5, 8
STARTS = (3, 4, 5, 6)

#: Names of groups that may stand for each other in a sentence, and the neutral word of each set.
IDENTITIES = (
    ("people", "women", "men", "girls", "boys"),
    ("person", "woman", "man", "girl", "boy"),
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("person", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "catholic"),
    ("people", "gays", "lesbians", "heterosexuals", "bisexuals", "transgenders"),
    ("some", "gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("some", "black", "white", "asian", "african", "latino", "hispanic", "arab", "indian", "european", "american"),
    ("people", "blacks", "whites", "asians", "africans", "latinos", "arabs", "indians", "europeans", "americans", "immigrants", "refugees"),
    ("people", "deaf", "blind", "disabled", "elderly"),
)
_SWAPS: dict[str, tuple[str, ...]] = {w: s for s in IDENTITIES for w in s[1:]}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(word: str) -> list[str]:
    """A word's own feature and those of its beginnings. A group's name has its own one only."""
    return [f"w{word}"] + ([] if word in _SWAPS else [f"s{word[:k]}" for k in STARTS if len(word) > k])


def _of_words(words: set[str]) -> set[str]:
    return {f for w in words for f in _features(w)}


def _swapped(words: set[str], found: dict[str, str]) -> list[set[str]]:
    """The text's words with its names replaced: by the neutral word, by the set's next name, and found names by theirs."""
    out = []
    if named := words & _SWAPS.keys():
        following = {w: (s := _SWAPS[w][1:])[(s.index(w) + 1) % len(s)] for w in named}
        out += [words - named | {_SWAPS[w][0] for w in named}, words - named | set(following.values())]
    if named := words & found.keys():
        out.append(words - named | {found[w] for w in named})
    return out


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text, toxic) to (feature, n, hits), summed within a batch."""
    for frame in frames:
        n, hits = Counter(), Counter()
        for text, label in zip(frame["text"], frame["toxic"], strict=True):
            own = _of_words(set(_WORD.findall(text)))
            n.update(own)
            if label:
                hits.update(own)
        yield pd.DataFrame({"feature": list(n), "n": list(n.values()), "hits": [hits[f] for f in n]})


def _extractor(place: dict[str, int], found: dict[str, str]):
    """(text, toxic, rank) to (rank, label, own telling features, and for each swap what is lost and gained with its number)."""

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, label, rank in zip(frame["text"], frame["toxic"], frame["rank"], strict=True):
                words = set(_WORD.findall(text))
                own = {place[f] for f in _of_words(words) if f in place}
                swaps = [{place[f] for f in _of_words(x) if f in place} for x in _swapped(words, found)]
                lost = [(i, f) for i, x in enumerate(swaps) for f in sorted(own - x)]
                gained = [(i, f) for i, x in enumerate(swaps) for f in sorted(x - own)]
                rows.append((rank, int(label), sorted(own), len(swaps), *[[x[k] for x in side] for side in (lost, gained) for k in (0, 1)]))
            yield pd.DataFrame(rows, columns=["rank", "label", "own", "swaps", "lost_swap", "lost", "gained_swap", "gained"])

    return extract


_EXTRACTED = "rank long, label int, own array<int>, swaps int, lost_swap array<int>, lost array<int>, gained_swap array<int>, gained array<int>"
_MOST_SWAPS = 3


@dataclass
class Sample:
    """Labels; features with their rows; the number of swapped copies, and the features that each loses and gains."""

    names: list[str]
    labels: np.ndarray
    row: np.ndarray
    feature: np.ndarray
    swaps: int
    lost_pair: np.ndarray
    lost: np.ndarray
    gained_pair: np.ndarray
    gained: np.ndarray

    @staticmethod
    def of(table, names: list[str]) -> Sample:
        """From an Arrow table of _EXTRACTED, ordered by rank; numbers stay in flat arrays."""
        table = table.combine_chunks().sort_by([("rank", "ascending"), ("label", "ascending")]).combine_chunks()

        def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
            column = table[name].combine_chunks() if table.num_rows else None
            if column is None:
                return np.zeros(0, np.int64), np.zeros(0, np.int32)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)

        row, feature = flat("own")
        sides = []
        for side in ("lost", "gained"):
            of, found = flat(side)
            sides += [of * _MOST_SWAPS + flat(f"{side}_swap")[1], found]
        return Sample(names, table["label"].to_numpy().astype(float), row, feature, int(np.sum(table["swaps"].to_numpy())), *sides)


class Model:
    """Weights by feature and the bias; pairs counts the swapped copies of the fit, changed those whose features differ."""

    def __init__(self, weights: dict[str, float], bias: float, pairs: int = 0, changed: int = 0):
        self.weights, self.bias, self.pairs, self.changed = weights, bias, pairs, changed

    def score(self, features: set[str]) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in sorted(features))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def fit(sample: Sample, penalty: float = PENALTY, ridge: float = RIDGE, steps: int = 300) -> Model:
    """No rows, or rows of one label only, give that label's share for every text."""
    y = sample.labels
    if len(y) == 0 or y.min() == y.max():
        share = float((y.sum() + 0.5) / (len(y) + 1.0))
        return Model({}, float(np.log(share / (1 - share))))
    share = y.mean()
    row, at, lost, gained = sample.row, sample.feature, sample.lost, sample.gained
    pairs, of = np.unique(np.concatenate((sample.lost_pair, sample.gained_pair)), return_inverse=True)
    lost_row, gained_row = of[: len(lost)], of[len(lost) :]
    n, k, m = len(y), len(sample.names), sample.swaps
    rare = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    w, bias = np.zeros(k), 0.0
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        p = 1.0 / (1.0 + np.exp(-np.clip(bias + np.bincount(row, weights=w[at], minlength=n), -30, 30)))
        pull = (p - y) * rare / n
        grad = np.append(np.bincount(at, weights=pull[row], minlength=k) + ridge * w, pull.sum())
        if len(pairs):
            change = np.bincount(gained_row, weights=w[gained], minlength=len(pairs)) - np.bincount(lost_row, weights=w[lost], minlength=len(pairs))
            pull = 2 * penalty * change / len(pairs)
            grad[:k] += np.bincount(gained, weights=pull[gained_row], minlength=k) - np.bincount(lost, weights=pull[lost_row], minlength=k)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:k], bias - move[k]
    return Model({f: float(v) for f, v in zip(sample.names, w, strict=True) if v}, float(bias), m, len(pairs))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, penalty: float = PENALTY, found: bool = True) -> Model:
    """Fits on labelled rows that are not held out, at most about `rows` of them; the ids' hashes choose.

    Rows with a null label or id are left out; of several labels of an id the largest counts. Null and empty texts are rows
    without words, repeated rows count as often as they stand, and ties (features of like frequency) go by name, so reruns
    agree. Texts are read whole. Without rows, or with one label only, every text gets that label's share. found=False
    leaves names that the training rows show out of the swaps.
    """
    known = labels.filter("toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic")).filter(F.pmod(doc_crc(F.col("__id")), F.lit(3)) != 1)
    share = min(1.0, rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64(F.lit(11), "__id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col("doc_id").alias("__doc"), ascii_lower(text_of()).alias("text"))
    joined = texts.join(known, F.col("__doc") == F.col("__id")).select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("__id", "text").alias("rank"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.keep(joined, "sample")
    whole = sample.agg(F.count("*").alias("n"), F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("share")).first()
    counts = scratch.keep(sample.select("text", "toxic").mapInPandas(_counted, "feature string, n long, hits long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")), "counts")
    expected = F.col("n") * whole.share
    off = F.abs(F.col("hits") - expected) / F.sqrt(expected * (1 - whole.share) + 1)
    lists = F.lit(False) if not _SWAPS else F.col("feature").isin([f"w{w}" for s in IDENTITIES for w in s])
    names = sorted(r.feature for r in counts.filter(((F.col("n") >= 3) & (off >= TELLING)) | lists).select("feature").collect())
    plain = counts.filter(F.col("feature").startswith("w") & (F.col("n") >= max(3, COMMON * whole.n)) & (off <= NEUTRAL)) if found else counts.limit(0)
    terms = [r.feature[1:] for r in plain.orderBy(F.desc("n"), "feature").select("feature").collect() if r.feature[1:] not in _SWAPS]
    sets = [terms[i : i + SET] for i in range(0, len(terms), SET)]
    following = {w: s[(i + 1) % len(s)] for s in sets if len(s) > 1 for i, w in enumerate(s)}
    extracted = sample.mapInPandas(_extractor({f: i for i, f in enumerate(names)}, following), _EXTRACTED)
    out = fit(Sample.of(extracted.toArrow(), names), penalty)
    scratch.drop("sample", "counts")
    return out


def probability(text: Column, model: Model) -> Column:
    """The model's score of a text; null and empty texts get the bias's."""
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[str]] = {}
        for part in texts:
            out = np.empty(len(part))
            for i, one in enumerate(part):
                features: set[str] = set()
                for word in set(_WORD.findall(one)):
                    own = known.get(word)
                    if own is None:
                        if len(known) > 400_000:
                            known.clear()
                        own = known[word] = [f for f in _features(word) if f in weights]
                    if own:
                        features.update(own)
                out[i] = bias + sum(weights[f] for f in sorted(features))
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(out, -30, 30))))

    return scored(ascii_lower(text_of(text)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs and held_out, score, predicted, which replace columns of these names. Repeated rows get equal scores."""
    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    marked = docs.select(*own, probability(F.col("text"), model).alias("score"))
    return marked.select(
        *own,
        (F.pmod(doc_crc(F.col("doc_id")), F.lit(3)) == 1).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold."""
    return docs.filter(probability(F.col("text"), model) < threshold)
