"""Benchmark decontamination with a distributed positional inverted index.

Each benchmark item is cut into windows of words. From counts over the whole corpus every window gets its two rarest
places as anchors; the index stores the corpus postings (document, position) of all anchor terms. Postings of the
rarest anchors are shifted by their places in the item to diagonals and intersected with those of the second ones: equal
diagonals are phrase candidates, diagonals up to SLOP apart are proximity matches. Windows share anchors, so lists are
kept by place in the item and spread to windows only after the intersection. Candidates are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Scratch, item_words, row_key, text_of

WINDOW = 10
SLOP = 3


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, item_id, first, words): the windows of each item; an item of fewer words, but not none, is one window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), item_words(text_of()).alias("w")).filter("size(w) > 0").distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "w"))
    starts = items.select("item", "item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window))).alias("first"))
    return starts.select("item", "item_id", "first", F.slice("w", F.col("first") + 1, F.lit(window)).alias("words"))


def anchors_of(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """windows and the places in the item (q0, q1) and terms (t0, t1) of their rarest words; a window of one word has no second.

    Terms that the corpus lacks count 0; of equally rare places the earlier one comes first.
    """
    places = windows.select("item", "first", F.posexplode("words").alias("offset", "term")).join(counts, "term", "left")
    ranked = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term")))
    two = places.groupBy("item", "first").agg(ranked.alias("r"))
    chosen = two.select("item", "first", *[x for i in (0, 1) for x in ((F.col("first") + F.get("r", F.lit(i))["offset"]).alias(f"q{i}"), F.get("r", F.lit(i))["term"].alias(f"t{i}"))])
    return windows.join(chosen, ["item", "first"])


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """(key, item_id, start, length, exact): where windows stand in documents, phrases and proximity matches.

    A phrase's place is also given as a proximity match, which every place with both anchors near each other is.

    Texts are read whole; null texts and items have no words and match nothing. Repeated rows share a key and so their
    matches. Only doc_id, text and item_id are read.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    windows = scratch.keep(windows_of(benchmark, window), "windows")
    terms = windows.select(F.explode("words").alias("term")).distinct()
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), item_words(text_of()).alias("w"))
    stream = keyed.select("key", F.posexplode("w").alias("pos", "term"))
    counts = stream.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    anchors = scratch.keep(anchors_of(windows, counts), "anchors")
    wanted = anchors.select(F.explode(F.array("t0", "t1")).alias("term")).distinct()
    index = scratch.keep(stream.join(wanted, "term", "left_semi"), "index")

    def shifted(n: int) -> DataFrame:
        places = anchors.select("item", F.col(f"q{n}"), F.col(f"t{n}").alias("term")).distinct()
        return index.join(places, "term").select("key", "item", f"q{n}", (F.col("pos") - F.col(f"q{n}")).alias(f"at{n}"))

    step = slop + 1
    near = shifted(0).withColumn("cell", F.explode(F.array(*[F.floor(F.col("at0") / step) + d for d in (-1, 0, 1)])))
    second = shifted(1).withColumn("cell", F.floor(F.col("at1") / step))
    pairs = near.join(second, ["key", "item", "cell"]).filter(F.abs(F.col("at0") - F.col("at1")) <= slop)
    pairs = pairs.groupBy("key", "item", "q0", "q1", "at0").agg(F.max(F.col("at0") == F.col("at1")).alias("exact"))
    alone = shifted(0).distinct().withColumn("exact", F.lit(True))
    facts = anchors.select("item", "item_id", "first", "q0", "q1", "words")
    both = pairs.join(facts, ["item", "q0", "q1"]).select("key", "item_id", "at0", "first", "words", "exact")
    single = alone.join(facts.filter("q1 is null"), ["item", "q0"]).select("key", "item_id", "at0", "first", "words", "exact")
    found = both.unionByName(single).withColumn("start", F.col("at0") + F.col("first")).select("key", "item_id", "words", "start", "exact").distinct()
    candidates = scratch.keep(found, "candidates")
    scratch.drop("index")
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    texts = texts.join(candidates.filter("exact").select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    checked = candidates.filter("exact and start >= 0").join(texts.select("key", item_words(text_of()).alias("w")), "key")
    same = F.slice("w", F.col("start") + 1, F.size("words")) == F.col("words")
    exact = scratch.keep(checked.filter(same).select("key", "item_id", "start", F.size("words").alias("length"), F.lit(True).alias("exact")), "exact")
    return exact.unionByName(candidates.select("key", "item_id", "start", F.size("words").alias("length"), F.lit(False).alias("exact")))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each row of docs: its columns, and n_words, n_hit, n_items, items_sha256, n_near, contaminated.

    A word is hit if it stands inside an exact occurrence of a window. n_items and items_sha256 are of the items with
    such windows, n_near counts other items with a proximity match, which do not contaminate. A null text has no words.
    Repeated rows get the same result; an empty benchmark leaves all rows clean.
    """
    matches = find_matches(docs, benchmark, window)
    hit = matches.filter("exact").select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).groupBy("key", "pos").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("n_hit"))
    by_item = matches.groupBy("key", "item_id").agg(F.max("exact").alias("exact"))
    items = by_item.groupBy("key").agg(
        F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item_id")))).alias("items"),
        F.sum((~F.col("exact")).cast("long")).alias("n_near"),
    )
    marks = items.join(hit, "key", "left").select(*[F.col(c).alias(f"__{c}") for c in ("key", "items", "n_near", "n_hit")])
    listed = F.coalesce("__items", F.array().cast("array<string>"))
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "n_items", "items_sha256", "n_near", "contaminated")]
    rows = docs.select(*own, row_key(F.col("doc_id"), F.col("text")).alias("__row"), F.size(item_words(text_of())).cast("long").alias("n_words"))
    return rows.join(marks, F.col("__row") == F.col("__key"), "left").select(
        *own,
        "n_words",
        F.coalesce("__n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        F.coalesce("__n_near", F.lit(0)).cast("long").alias("n_near"),
        (F.coalesce("__n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
