"""Groups of alike items from buckets of candidates, without all pairs of a bucket.

Buckets come in rounds: those of a few keys of each item first, then those of all keys, then finer ones where the
caller can cut them. In every bucket a leader is compared with all others. What passes is linked, links are closed to
components, and of the next round's buckets only those count that hold more than one component: members of one component
need no further comparison, as a link between them would not change a group. So a large group of copies is settled by its
few first keys. At last only pairs between different components are compared. Hot buckets cost one comparison a member
and round, and no pair that could join two groups goes unseen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Scratch, bitmap, has


#: Buckets of each item that the first round takes.
FIRST = 4
#: Buckets of up to this number are sent to all workers: 16 MB.
MOST_SENT = 1 << 20
#: Edges of up to this number are linked by the driver: 4 MB.
MOST_GATHERED = 1 << 18


def _gathered(edges: DataFrame) -> DataFrame:
    """components of few edges: roots take the smallest root across an edge, until none is left to take."""
    given = edges.select("a", "b").toArrow()
    ends = [given[c].to_numpy() for c in "ab"]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = np.split(at.astype(np.int64), 2)
    root = np.arange(len(nodes))
    while len(a := a[apart := root[a] != root[b]]):
        b = b[apart]
        least = np.minimum(root[a], root[b])
        for end in (root[a], root[b]):
            np.minimum.at(root, end, least)
        while ((further := root[root]) != root).any():
            root = further
    kinds = pa.schema([("node", pa.int64()), ("root", pa.int64())])
    return edges.sparkSession.createDataFrame(pa.table([nodes, nodes[root]], schema=kinds), "node long, root long")


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(a, b) to (node, root) for all nodes with an edge; root is the smallest node that can be reached.

    Up to MOST_GATHERED edges are linked at once. More of them by alternating large-star and small-star steps (Kiveris et al.,
    2014): each step is sums and joins by node, written before the next; then no component is gathered anywhere.
    """
    edges = edges.filter("a <> b")
    if edges.count() <= MOST_GATHERED:
        return _gathered(edges)
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{label}-edges")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, n = print_of(now), 0
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w"))
        moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(moved.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), f"{label}-star{n}")
        seen = print_of(after)
        scratch.drop(f"{label}-star{n - 1}" if n else f"{label}-edges")
        now, n = after, n + 1
        if seen == before:
            break
        before = seen
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def shared_only(items: DataFrame, scratch: Scratch) -> DataFrame:
    """items with those of their buckets that others have too, without items that have none.

    Buckets are counted, and the counted ones told by a bitmap, so a few that nobody shares stay by chance.
    """
    seen = items.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).filter("n > 1").select("b")
    bits = items.sparkSession.sparkContext.broadcast(bitmap(scratch.keep(seen, "seen"), F.col("b")))
    scratch.drop("seen")

    def prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                sizes = [len(x) for x in frame["buckets"]]
                flat = np.concatenate(frame["buckets"].tolist()).astype(np.int64)
                there = has(bits.value, flat)
                row = np.repeat(np.arange(len(sizes)), sizes)[there]
                left = np.bincount(row, minlength=len(sizes))
                parts = np.split(flat[there], np.cumsum(left)[:-1])
                yield frame.assign(buckets=pd.Series(parts, index=frame.index, dtype=object))[left > 0]

    return scratch.keep(items.mapInPandas(prune, items.schema), "sharing")


def link_items(
    items: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    finer: list[Callable[[DataFrame], DataFrame]] = (),
    alike: Callable[..., Column] | None = None,
    first: int = FIRST,
) -> tuple[DataFrame, DataFrame]:
    """items (node, *facts, buckets array) to (edges (a, b), components (node, root)).

    verify keeps the pairs (a, b), which are written, that are alike. The first round takes the first `first` buckets of each
    item. The leader of a bucket is the node that meets most others: an original rather than one of its copies; after finer
    functions any other.
    finer functions turn left-over entries (bucket, node, root, *facts) into ones of smaller buckets; they may drop entries that
    can have no link, and add facts. alike(facts of a, of b) is an optional cheap condition, from the facts that are there, that
    every true pair meets.
    """
    entries = items.withColumn("bucket", F.explode(F.slice("buckets", 1, first))).drop("buckets").withColumn("root", F.col("node"))
    entries = _scored(entries, scratch, "entries-0")
    edges, checked = None, None
    for n in range(len(finer) + 2):
        facts = [c for c in entries.columns if c not in ("bucket", "node", "score", "root")]
        order = F.struct(*([(-F.col("score")).alias("far")] if n < 2 else []), F.xxhash64(F.lit(n), "node"), F.col("node"), *facts)
        heads = entries.groupBy("bucket").agg(F.min(order).alias("h"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
        heads = heads.select(F.col("bucket").alias("_b"), F.col("h.node").alias("a"), *[F.col(f"h.{c}").alias(f"a_{c}") for c in facts])
        led = entries.join(heads, F.col("bucket") == F.col("_b")).filter("node <> a")
        led = scratch.keep(led.select("bucket", "a", "node", *[f"a_{c}" for c in facts], *facts), f"led-{n}")
        pairs = _fitting(led, facts, alike).select("a", F.col("node").alias("b")).distinct()
        pairs = scratch.keep(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), f"pairs-{n}")
        checked = pairs if checked is None else checked.unionByName(pairs)
        passed = scratch.keep(verify(pairs), f"passed-{n}")
        edges = passed if edges is None else edges.unionByName(passed)
        roots = scratch.keep(components(edges, scratch, f"round{n}"), f"roots-{n}")
        if n == 0:
            # of all buckets those of more than one component; few as a rule, and then no entry of another one is moved
            placed = scratch.keep(_rooted(items, roots), "placed")
            mixed = placed.select("root", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
            mixed = scratch.keep(mixed.filter("lo <> hi").select(F.col("bucket").alias("_b")), "mixed")
            mixed = F.broadcast(mixed) if mixed.count() <= MOST_SENT else mixed
            entries = placed.withColumn("bucket", F.explode("buckets")).drop("buckets").join(mixed, F.col("bucket") == F.col("_b"), "left_semi")
            entries = _scored(entries, scratch, "entries-1")
            scratch.drop("entries-0", "led-0", "placed", "mixed")
            continue
        rest = scratch.keep(_mixed(led.select("bucket", "node", *facts), roots), f"rest-{n}")  # with root and, as mine, a node's buckets
        scratch.drop(f"led-{n}")
        if rest.isEmpty():
            return edges, roots
        if n <= len(finer):
            entries = scratch.keep(finer[n - 1](rest.drop("mine")), f"finer-{n}")
    facts = [c for c in rest.columns if c not in ("bucket", "node", "root", "mine")]
    # a pair that shares several buckets is met in the least of them
    left = rest.select(F.col("bucket").alias("_b"), F.col("node").alias("a"), F.col("root").alias("_r"), F.col("mine").alias("_mine"), *[F.col(c).alias(f"a_{c}") for c in facts])
    same = (F.col("_b") == F.col("bucket")) & (F.col("_r") != F.col("root")) & (F.col("a") < F.col("node"))
    if alike is not None:
        same = same & alike({c: F.col(f"a_{c}") for c in facts}, {c: F.col(c) for c in facts})
    across = left.join(rest, same & (F.array_min(F.array_intersect("_mine", "mine")) == F.col("bucket"))).select("a", F.col("node").alias("b"))
    across = scratch.keep(across, "pairs-last")
    edges = edges.unionByName(scratch.keep(verify(across), "across"))
    return edges, scratch.keep(components(edges, scratch, "last"), "roots-last")


def _scored(entries: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Entries of buckets of several nodes, with the number of others that their node meets in all of these."""
    crowd = entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("bucket").alias("_b"), "n")
    met = scratch.keep(entries.join(crowd, F.col("bucket") == F.col("_b")).drop("_b"), f"{name}-crowd")
    score = met.groupBy(F.col("node").alias("_n")).agg(F.sum("n").alias("score"))
    out = scratch.keep(met.drop("n").join(score, F.col("node") == F.col("_n")).drop("_n"), name)
    scratch.drop(f"{name}-crowd")
    return out


def _fitting(led: DataFrame, facts: list[str], alike) -> DataFrame:
    return led if alike is None else led.filter(alike({c: F.col(f"a_{c}") for c in facts}, {c: F.col(c) for c in facts}))


def link(entries: DataFrame, verify, scratch: Scratch, finer=(), alike=None, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """link_items for entries (bucket, node, *facts); a node's facts are the same in all of them."""
    facts = [c for c in entries.columns if c not in ("bucket", "node")]
    items = entries.groupBy("node", *facts).agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))
    return link_items(scratch.keep(items, "items"), verify, scratch, finer, alike, first)


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the root of their node, which is itself without a link."""
    rest = rows.join(roots.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n"), "left")
    return rest.select(*rows.columns, F.coalesce("root", "node").alias("root"))


def _mixed(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries with their root, and as mine all buckets of their node, of those buckets that hold more than one component."""
    facts = [c for c in entries.columns if c != "bucket"]
    packed = _rooted(entries.groupBy(*facts).agg(F.collect_set("bucket").alias("mine")), roots)
    rest = packed.withColumn("bucket", F.explode("mine"))
    mixed = rest.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select(F.col("bucket").alias("_b"))
    return rest.join(mixed, F.col("bucket") == F.col("_b"), "left_semi")
