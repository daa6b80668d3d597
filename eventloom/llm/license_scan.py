"""License scans by diagonal voting.

Rolling hashes of GRAM words of a text are joined to the places where they stand in license templates. Text place
minus template place is a diagonal; a copied stretch puts its votes on one diagonal, and an inserted or dropped word
moves the rest to a neighbouring one. Votes are counted by diagonal, diagonals at most GAP apart are merged to spans,
and a span is accepted when the template places that it covers are a large enough share of the template. Where neighbouring
diagonals chain to a span much longer than the template, as a repeated short piece of it makes them, each of its diagonals is
judged alone. Phrases are templates that must be covered whole on one diagonal. Every vote is verified: its words are compared
with the template's, so equal hashes of other words count nothing, and spans stand on equal words alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import Scratch, item_words, row_key, text_of

GRAM = 3
GAP = 3
COVERED = 0.6

#: Templates of up to this many characters in all are sent to every worker; more are joined as any table.
MOST_SENT = 1 << 20

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Passages by which common licenses are told, as their authors publish them.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-notice": "This work is licensed under a Creative Commons Attribution",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
}


def template_places(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str], gram: int = GRAM) -> DataFrame:
    """(template, label, exact, grams, words, at, gram): every place of every template; as many rows as they have words."""
    rows = [(label, text, exact) for texts, exact in ((phrases, True), ({v: k for k, v in templates.items()}, False)) for text, label in texts.items()]
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "template int, label string, text string, exact boolean")
    cut = given.select("template", "label", "exact", item_words(F.col("text")).alias("words")).withColumn("grams", F.size("words") - gram + 1)
    placed = cut.filter("grams > 0").select("*", F.posexplode("words").alias("at", "first"))
    return placed.filter(F.col("at") < F.col("grams")).select(
        "template", "label", "exact", "grams", "words", "at", F.xxhash64(*(w := [F.get("words", F.col("at") + k) for k in range(gram)])).alias("gram"), F.concat_ws(" ", *w).alias("text")
    )


def find_spans(docs: DataFrame, phrases=None, templates=None, gram: int = GRAM, gap: int = GAP, covered: float = COVERED) -> DataFrame:
    """(key, template, label, exact, start, end, share): accepted spans, in words from 0, end not included.

    Phrases and templates of fewer than gram words have no place and are never found; a smaller gram finds them.
    """
    spark = docs.sparkSession
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    places = template_places(spark, phrases, templates, gram)
    sent = F.broadcast if sum(map(len, [*phrases, *templates.values()])) <= MOST_SENT else (lambda df: df)
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), item_words(text_of()).alias("w"))
    words = [F.get("w", F.col("pos") + k) for k in range(gram)]
    rolled = keyed.select("key", "w", F.posexplode("w").alias("pos", "_first")).filter(F.col("pos") <= F.size("w") - gram)
    votes = rolled.select("key", "pos", "w", F.xxhash64(*words).alias("gram")).join(sent(places.select("gram", "template", "at", "text")), "gram")
    votes = votes.filter(F.concat_ws(" ", *words) == F.col("text"))
    votes = Scratch(spark, "licenses").keep(votes.select("key", "template", "at", "pos").distinct(), "votes")
    facts = places.select("template", "label", "exact", "grams").distinct()
    lines = votes.groupBy("key", "template", (F.col("pos") - F.col("at")).alias("diagonal"))
    lines = lines.agg(F.count("*").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_list("at").alias("ats"))
    lines = lines.join(sent(facts), "template")
    whole = lines.filter(F.col("exact") & (F.col("votes") == F.col("grams"))).select(
        "key", "template", "label", "exact", F.col("diagonal").cast("long").alias("start"), (F.col("diagonal") + F.col("grams") + gram - 1).cast("long").alias("end"), F.lit(1.0).alias("share")
    )
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    split = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= gap, 0).otherwise(1)
    runs = lines.filter(~F.col("exact")).withColumn("split", split).withColumn("run", F.sum("split").over(order))
    alone = F.struct(F.col("low").cast("long").alias("start"), (F.col("high") + gram).cast("long").alias("end"), (F.col("votes") / F.col("grams")).alias("share"))
    merged = runs.groupBy("key", "template", "label", "exact", "run", "grams").agg(
        F.min("low").cast("long").alias("start"), (F.max("high") + gram).cast("long").alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("seen"),
        F.collect_list(F.when(F.col("votes") / F.col("grams") >= covered, alone)).alias("singles"),
    )
    short = F.col("end") - F.col("start") <= 2 * (F.col("grams") + gram)
    whole_run = F.array(F.struct("start", "end", (F.col("seen") / F.col("grams")).alias("share")))
    spans = merged.select("key", "template", "label", "exact", F.inline(F.when(short, whole_run).otherwise(F.col("singles")))).filter(F.col("share") >= covered)
    return whole.unionByName(spans.select(*whole.columns))


def scan(docs: DataFrame, phrases=None, templates=None) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    n_base counts all places of phrases, first_word and last_word are the smallest and largest start among them (null
    if none). labels adds those of accepted template spans; score is the largest covered share, 0 if there is none.
    Null and empty texts have no words and no labels; repeated rows get equal results; other columns are not read.
    """
    spans = find_spans(docs, phrases, templates)
    base = F.when(F.col("exact"), F.col("start"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")  # noqa: E731  as many as there are labels
    found = spans.groupBy(F.col("key").alias("__key")).agg(
        F.count(base).alias("n_base"),
        F.min(base).alias("first_word"),
        F.max(base).alias("last_word"),
        joined(F.when(F.col("exact"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
        F.count("*").alias("n_spans"),
    )
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("__row"), F.size(item_words(text_of())).cast("long").alias("n_words"))
    return rows.join(found, F.col("__row") == F.col("__key"), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
