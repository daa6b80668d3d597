"""Substring deduplication by hashing lines and the sentences in them.

Texts are cut at line ends, and lines behind sentence ends, since repeated passages are often pasted into the middle of a
line. Units are normalised (lower case, digits to 0, words only) and their digests grouped over all documents. The
earliest ranked occurrence (by doc_id, row, place) is the original; in all other places a unit is a repetition. Repetitions
next to each other form a run, and runs of at least MIN_WORDS words are removed. Short phrases that recur by chance or
habit so stay. Offsets are code points of the original text.

A passage that starts and ends inside sentences has edge sentences that are no repetitions. repeated_passages therefore
goes on from the longest unit of each run that has such a neighbour word by word, in both directions, as long as the words
are those around its original, and tests the length after that. It also removes every repeated whole line; the least length
is for pieces of lines alone. What stands around originals is fetched in windows, asked for by the original's document, so
a text goes through a shuffle once for all its runs.

repeated_spans cuts words by Unicode classes; repeated_passages by bytes: letters, digits and whatever is not ASCII, but for
the sentence ends among it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import Scratch, bitmap, has
from eventloom.llm.textscan import Words, batches, hashed, opened, places

MIN_WORDS = 25
#: Characters fetched ahead of an original, and half of those behind its start; whole texts where that is not enough.
REACH = 400

_UNIT = {
    "sentence": re.compile(r"[^\n.!?…。！？]+[.!?…。！？]*"),
    "line": re.compile(r"[^\n]+"),
    "paragraph": re.compile(r"[^\n]+(?:\n(?!\s*\n)[^\n]+)*"),
}
_WORD = re.compile(r"[^\W_]+")
#: The words that units_of finds.
_PLAIN_WORD = re.compile("[^\x00-/:-@\\[-`{-\x7f\u2026\u3002\uff01\uff1f]+")
_PLAIN = {**{b: b + 32 for b in range(65, 91)}, **{b: 48 for b in range(49, 58)}}
_DIGITS = str.maketrans("123456789", "0" * 9)


def _units(text: str, unit: str) -> Iterator[tuple[int, int, int, bytes, int, int]]:
    """(start, end, words, digest, checksums of the first and the last word) of every unit that has a word."""
    for found in _UNIT[unit].finditer(text):
        piece = found.group()
        words = _WORD.findall(piece.lower().translate(_DIGITS))
        if words:
            lead = len(piece) - len(piece.lstrip())
            first, last = (zlib.crc32(words[i].encode("utf-8", "surrogatepass")) for i in (0, -1))
            yield found.start() + lead, found.end(), len(words), hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest(), first, last


_STOPS = np.isin(np.arange(256), np.frombuffer(b".!?", dtype=np.uint8))
#: Sentence ends of three bytes: ellipsis, ideographic full stop, wide exclamation and question marks.
_WIDE = tuple(x.encode() for x in "\u2026\u3002\uff01\uff1f")


def units_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Sentences and lines of texts: row, unit, start, end, words, high, low, at, before, after, line.

    unit numbers the row's sentences; line tells how many of them a whole line has, 0 for a sentence that is none. A line of
    several sentences stands once more, as one unit. start and end are code points; at is the number of words ahead; before
    and after are hashes of the words next to it, -1 for none.
    """
    words = Words(texts, _WIDE)
    raw, first, last, word, rows = words.raw, words.first, words.last, words.hash, words.row
    stops, tail = _STOPS[raw], _STOPS[raw] | words.apart
    stops |= words.apart
    new_row, new_line = opened(rows), opened(words.line)
    new = new_line | opened(np.cumsum(stops)[first])
    opening = np.flatnonzero(new_row)
    ahead = places(opening, len(word))
    points = np.cumsum((raw & 0xC0) != 0x80)
    points = points - np.repeat(points[words.starts] - 1, words.sizes)  # from 1 in each text
    sentence_no = np.cumsum(new) - 1
    row_first = sentence_no[opening]
    short = (word >> np.uint64(32)).astype(np.int64)
    others = np.flatnonzero(~tail)

    def cut(at: np.ndarray) -> dict[str, np.ndarray]:
        place, stop = places(at, len(word)), np.append(at[1:], len(word)) - 1
        with np.errstate(over="ignore"):
            high, low = (hashed(word, place, at, f).view(np.int64) for f in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
        behind = np.where(~np.append(new_row, True)[stop + 1], np.append(short, -1)[stop + 1], -1)
        return {
            "row": rows[at], "unit": sentence_no[at] - row_first[np.searchsorted(opening, at, "right") - 1], "start": points[first[at]] - 1,
            "end": points[others[np.searchsorted(others, last[stop] + 1)] - 1], "words": stop - at + 1, "high": high, "low": low, "at": ahead[at],
            "before": np.where(new_row[at], -1, short[at - 1]), "after": behind,
        }

    at, lines = np.flatnonzero(new), np.flatnonzero(new_line)
    each = cut(at)
    many = np.diff(np.append(sentence_no[lines], len(at)))  # sentences of each line
    each["line"] = np.zeros(len(at), dtype=np.int64)
    each["line"][sentence_no[lines[many == 1]]] = 1
    whole = {k: x[many > 1] for k, x in (cut(lines) | {"line": many}).items()}
    return {k: np.concatenate((each[k], whole[k])) for k in each}


def cut_both(docs: DataFrame, known=None) -> DataFrame:
    """(doc_id, key, unit, start, end, words, high, low, at, before, after, line): units_of all texts of docs.

    known is a broadcast bitmap; units whose low digest it has not are left out.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin, texts in batches(frame["text"]):
                found = units_of(texts)
                if known is not None:
                    there = has(known.value, found["low"])
                    found = {k: x[there] for k, x in found.items()}
                place = begin + found.pop("row")
                yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[place], "key": frame["key"].to_numpy()[place], **found})

    given = docs.filter("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), key_of().alias("key"), "text")
    made = given.mapInPandas(each, "doc_id string, key long, unit int, start int, end int, words int, high long, low long, at int, before long, after long, line int")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def cut(docs: DataFrame, unit: str = "sentence") -> DataFrame:
    """(doc_id, key, unit, start, end, words, high, low, at, before, after): every unit that has a word.

    high and low are its digest, at the number of words ahead of it; before and after tell the words next to it, -1 for none.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "key", "unit", "start", "end", "words", "digest", "at", "before", "after"]

        def framed(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            digest = np.frombuffer(b"".join(out.pop("digest")), dtype=np.int64).reshape(-1, 2)
            return out.assign(high=digest[:, 0], low=digest[:, 1])

        for frame in frames:
            rows: list[tuple] = []
            for doc_id, key, text in zip(frame["doc_id"], frame["key"], frame["text"], strict=True):
                units, at = list(_units(text, unit)), 0
                for i, u in enumerate(units):
                    rows.append((doc_id, key, i, *u[:4], at, units[i - 1][5] if i else -1, units[i + 1][4] if i + 1 < len(units) else -1))
                    at += u[2]
                if len(rows) > 20_000:
                    yield framed(rows)
                    rows = []
            yield framed(rows)

    given = docs.filter("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), key_of().alias("key"), "text")
    made = given.mapInPandas(each, "doc_id string, key long, unit int, start int, end int, words int, at int, before long, after long, high long, low long")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def key_of() -> Column:
    """With doc_id, what tells rows of different texts apart."""
    return F.xxhash64("doc_id", "text")


def _repeated(units: DataFrame, scratch: Scratch, counted: DataFrame) -> DataFrame:
    """Every unit that repeats an earlier one, with its place and that of its original. counted are the _counts of all units."""
    digest, same = ["high", "low"], (F.col("high") == F.col("_h")) & (F.col("low") == F.col("_l"))
    again = scratch.keep(units.join(counted, same).drop("_h", "_l"), "again")
    best = F.struct("key", "unit", "line", "start", "before", "after")
    original = again.filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy(F.col("high").alias("_h"), F.col("low").alias("_l")).agg(F.min(best).alias("o"))
    copies = again.join(scratch.keep(original, "originals"), same)
    copies = copies.filter(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("o.key")) & (F.col("unit") == F.col("o.unit")) & (F.col("line") == F.col("o.line"))))
    touches = ((F.col("before") == F.col("o.before")) & (F.col("before") >= 0)) | ((F.col("after") == F.col("o.after")) & (F.col("after") >= 0))
    return copies.select(
        "doc_id", "key", "unit", "words", "start", "end", "at", "line",
        F.col("first_id").alias("kept_doc_id"), F.col("o.start").alias("kept_start"), F.col("o.key").alias("kept_key"), touches.alias("touches"),
    ).distinct()


def _counts(units: DataFrame) -> DataFrame:
    """(_h, _l, first_id) of the digests that occur twice or more."""
    counted = units.groupBy("high", "low").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return counted.select(F.col("high").alias("_h"), F.col("low").alias("_l"), "first_id")


def repeated_spans(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, start, end, words, units, kept_doc_id, kept_start): the runs to remove.

    kept_doc_id and kept_start tell where the run's first unit has its original, which may be earlier in the same
    document. Null and empty texts have no units. Repeated rows are repetitions of themselves only once: they share a key
    and are treated as one row. Null doc_ids rank last. Only doc_id and text are read.

    Digests are counted first, with partial sums. Only units of repeated ones go on, and the original is sought among
    those of the least doc_id alone.
    """
    scratch = Scratch(docs.sparkSession, "units")
    units = scratch.keep(cut(docs, unit).withColumn("line", F.lit(0)), "units")
    copies = _repeated(units, scratch, scratch.keep(_counts(units), "repeated"))
    order = Window.partitionBy("doc_id", "key").orderBy("unit")
    runs = copies.withColumn("run", F.col("unit") - F.row_number().over(order)).groupBy("doc_id", "key", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("words").alias("words"),
        F.count("*").alias("units"),
        F.min_by(F.struct("kept_doc_id", "kept_start"), "unit").alias("kept"),
    )
    return runs.filter(F.col("words") >= min_words).select("doc_id", "key", "start", "end", "words", "units", "kept.kept_doc_id", "kept.kept_start")


def _extended(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs, to which the words around their anchor are added as far as they are those around its original.

    own and kept are the texts around both, from own_from and kept_from; `more` marks runs that came to an end of them.
    """
    same = lambda a, b: a.translate(_PLAIN) == b.translate(_PLAIN)
    for frame in frames:
        out = []
        for r in frame.itertuples():
            own, kept, here = r.own, r.kept, bool(r.same_row)
            start, end, low, high, n = r.start, r.end, r.low, r.high, 0
            reached, place, at, more = r.kept_start, r.a_start - r.own_from, r.kept_start - r.kept_from, False
            for x, y in zip(_PLAIN_WORD.finditer(own, place), _PLAIN_WORD.finditer(kept, at)):
                if (y.end() == len(kept) and r.kept_cut) or (x.end() == len(own) and r.own_cut):
                    more = True
                    break
                if not same(x.group(), y.group()) or here and y.end() + r.kept_from > r.a_start:
                    break
                n, reached = n + 1, y.end() + r.kept_from
                end, high = max(end, x.end() + r.own_from), max(high, r.a_at + n)
            else:
                more = r.kept_cut or r.own_cut
            n = 0
            for x, y in zip(_PLAIN_WORD.finditer(own[:place][::-1]), _PLAIN_WORD.finditer(kept[:at][::-1])):
                if (y.end() == at and r.kept_from) or (x.end() == place and r.own_from):
                    more = True
                    break
                if not same(x.group()[::-1], y.group()[::-1]) or here and r.a_start - x.end() < reached:
                    break
                n += 1
                start, low = min(start, r.a_start - x.end()), min(low, r.a_at - n)
            else:
                more = more or r.kept_from > 0 or r.own_from > 0
            out.append((start, end, low, high, bool(more)))
        places = pd.DataFrame(out, columns=["x_start", "x_end", "x_low", "x_high", "more"], index=frame.index)
        yield frame.drop(columns=["own", "own_from", "own_cut", "kept", "kept_from", "kept_cut", "same_row"]).assign(**{c: places[c] for c in places})


def _windows(reach: int | None):
    """(doc_id, key, text, places) to (doc_id, key, place, text, from, cut): what stands around each place of a text."""

    def window(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, key, text, places in zip(frame["doc_id"], frame["key"], frame["text"], frame["places"], strict=True):
                for p in places:
                    begin, stop = (max(0, p - reach), p + 2 * reach) if reach else (0, len(text))
                    out.append((doc_id, key, p, text[begin:stop], begin, stop < len(text)))
            yield pd.DataFrame(out, columns=["doc_id", "key", "place", "text", "from", "cut"])

    return window


def _merged(spans: DataFrame) -> DataFrame:
    """Spans that overlap or touch as one, in repeated_spans' columns."""
    order = Window.partitionBy("doc_id", "key").orderBy("start", "end")
    ahead = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = spans.withColumn("new", F.when(F.col("start") <= ahead, 0).otherwise(1)).withColumn("part", F.sum("new").over(order))
    out = parted.groupBy("doc_id", "key", "part").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.max("high") - F.min("low")).cast("long").alias("words"),
        F.sum("units").alias("units"),
        F.min_by(F.struct(F.col("first_id").alias("kept_doc_id"), F.col("first_start").alias("kept_start")), "start").alias("kept"),
    )
    return out.select("doc_id", "key", "start", "end", "words", "units", "kept.kept_doc_id", "kept.kept_start")


_SPAN = ["doc_id", "key", "units", "first_id", "first_start", "start", "end", "low", "high"]


def _passages(docs: DataFrame, copies: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, key, units, first_id, first_start, start, end, low, high): runs of sentences, extended."""
    order = Window.partitionBy("doc_id", "key").orderBy("unit")
    anchor = F.struct("start", "at", "kept_doc_id", "kept_key", "kept_start", "touches")
    runs = copies.filter("line <= 1").withColumn("run", F.col("unit") - F.row_number().over(order)).groupBy("doc_id", "key", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("at").alias("low"),
        F.max(F.col("at") + F.col("words")).alias("high"),
        F.count("*").alias("units"),
        F.min_by(F.struct("kept_doc_id", "kept_start"), "unit").alias("kept"),
        F.max_by(anchor, F.struct("touches", "words", -F.col("unit"))).alias("a"),
    )
    facts = [F.col("a.start").alias("a_start"), F.col("a.at").alias("a_at"), F.col("a.kept_start").alias("kept_start"), F.col("a.kept_doc_id").alias("kept_id"), F.col("a.kept_key").alias("kept_key")]
    runs = runs.select("*", F.col("kept.kept_doc_id").alias("first_id"), F.col("kept.kept_start").alias("first_start")).select(*_SPAN, "a.touches", *facts)
    runs = scratch.keep(runs, "runs")
    # no word next to the anchor is as next to its original: the run ends where it ends
    found, left = runs.filter("not touches").select(*_SPAN), runs.filter("touches").drop("touches")
    ids = ("doc_id", "first_id", "kept_id")
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("_id"), key_of().alias("_key"), "text")
    for n, reach in enumerate((REACH, 16 * REACH, None)):
        asked = left.select("doc_id", "key", F.col("a_start").alias("place")).unionByName(left.select(F.col("kept_id").alias("doc_id"), F.col("kept_key").alias("key"), F.col("kept_start").alias("place")))
        asked = asked.groupBy("doc_id", "key").agg(F.collect_set("place").alias("places"))  # as many as the text has units
        joined = texts.join(asked, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select(F.col("doc_id").cast("string").alias("doc_id"), "key", "text", "places")
        around = joined.mapInPandas(_windows(reach), "doc_id string, key long, place int, text string, from int, cut boolean").withColumn("doc_id", F.col("doc_id").cast("long"))
        around = scratch.keep(around.dropDuplicates(["doc_id", "key", "place"]), f"around-{n}")
        of = lambda name: around.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "key", "place")], F.col("text").alias(name), F.col("from").alias(f"{name}_from"), F.col("cut").alias(f"{name}_cut"))  # noqa: B023, E731
        at = lambda *c: F.col("_doc_id").eqNullSafe(F.col(c[0])) & (F.col("_key") == F.col(c[1])) & (F.col("_place") == F.col(c[2]))
        both = left.join(of("own"), at("doc_id", "key", "a_start")).drop("_doc_id", "_key", "_place")
        both = both.join(of("kept"), at("kept_id", "kept_key", "kept_start")).drop("_doc_id", "_key", "_place")
        both = both.withColumn("same_row", F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
        # ids travel as text, as pandas makes whole numbers with nulls floats
        kinds = ", ".join(f"{c} {'string' if c in ids else left.schema[c].dataType.simpleString()}" for c in left.columns)
        done = both.withColumns({c: F.col(c).cast("string") for c in ids}).mapInPandas(_extended, f"{kinds}, x_start int, x_end int, x_low int, x_high int, more boolean")
        done = scratch.keep(done.withColumns({c: F.col(c).cast("long") for c in ids}), f"extended-{n}")
        scratch.drop(f"around-{n}")
        grown = done.filter("not more").drop("start", "end", "low", "high").withColumnsRenamed({f"x_{c}": c for c in ("start", "end", "low", "high")})
        found = found.unionByName(grown.select(*_SPAN))
        left = done.filter("more").select(*left.columns)
    return found


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """repeated_spans' columns: every repeated whole line, and runs of repeated sentences of min_words words.

    Runs have the words that go on as around their originals. Lines go whatever their length; so do repeated paragraphs,
    as their lines are repeated. Nulls, empty texts, repeated rows and ties are as in repeated_spans; texts of any length
    are cut whole. Units are cut twice: to count digests, and to fetch those that are repeated, told by a bitmap of them.
    """
    scratch = Scratch(docs.sparkSession, "units")
    counted = scratch.keep(_counts(cut_both(docs).select("high", "low", "doc_id")), "repeated")
    known = docs.sparkSession.sparkContext.broadcast(bitmap(counted, F.col("_l")))
    copies = scratch.keep(_repeated(cut_both(docs, known), scratch, counted), "copies")
    scratch.drop("again", "originals", "repeated")
    lines = copies.filter("line > 0").select(
        "doc_id", "key", F.col("line").cast("long").alias("units"), F.col("kept_doc_id").alias("first_id"), F.col("kept_start").alias("first_start"),
        "start", "end", F.col("at").alias("low"), (F.col("at") + F.col("words")).alias("high"),
    )
    runs = _passages(docs, copies, scratch).filter(F.col("high") - F.col("low") >= min_words)
    return _merged(scratch.keep(runs.unionByName(lines), "spans"))


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each row of docs: doc_id, key, n_spans, n_passages, n_words, starts, ends, kept_doc_ids.

    The spans are those of repeated_passages in the order of their starts, n_passages those of min_words words or more, and
    n_words the sum of their words. Rows without spans, null and empty texts among them, have zeros and empty lists.
    """
    spans = repeated_passages(docs, min_words)
    lists = spans.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kept_doc_id", "words"))).alias("s"), F.sum("words").alias("n"), F.count(F.when(F.col("words") >= min_words, 1)).alias("long")
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of().alias("key"))
    joined = rows.join(lists, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    listed = lambda c, kind: F.coalesce(F.col(f"s.{c}"), F.array().cast(f"array<{kind}>"))
    return joined.select(
        "doc_id", "key", F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n_spans"), whole("long").alias("n_passages"), whole("n").alias("n_words"),
        listed("start", "int").alias("starts"), listed("end", "int").alias("ends"), listed("kept_doc_id", "bigint").alias("kept_doc_ids"),
    )


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the spans, in the same columns; what stood around a span stays as it was.

    Null texts stay null. Repeated rows lose the same spans. Spans that overlap must be merged before, as report's are.
    """
    name, gone = "__el_key", "__el_gone"
    lists = spans.groupBy(F.col("doc_id").alias("__el_id"), F.col("key").alias(name)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(gone))

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text: str | None, places) -> str | None:
            if places is None or text is None:
                return text
            at, left = 0, []
            for place in places:
                left.append(text[at : place["start"]])
                at = place["end"]
            return "".join([*left, text[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    mine = docs.withColumn("__el_own", key_of())
    joined = mine.join(lists, F.col("doc_id").eqNullSafe(F.col("__el_id")) & (F.col("__el_own") == F.col(name)), "left")
    return joined.withColumn("text", cut_out(F.col("text"), F.col(gone))).select(*docs.columns)
