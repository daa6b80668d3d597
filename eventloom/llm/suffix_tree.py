"""Language-model scoring with a probabilistic suffix tree over words.

The root holds the counts of all training tokens with add-one smoothing. A context of one to `depth` words that occurs
LEAST times, and a symbol that follows it LEAST times, count at any size of the corpus. A context is a state if its
next-symbol distribution diverges enough from its parent's: the log likelihood that the training tokens gain by its stored,
discounted probabilities, less what the others lose, must exceed 0.5 ln N(context) for each stored symbol. The rest of the mass
goes to the parent's distribution, so every state's distribution sums to 1. A token is scored in the longest suffix of its past that is a state; suffixes in between that are none pass the
parent's distribution on.

As P(symbol | state) = share + rest * P(symbol | parent), a text's log probability is a sum over its n-grams: of the root's
log probability, log rest of every state met, and log(1 + share / (rest * below)) of every symbol stored there. So n-grams
need values, not a tree that anyone holds.

Texts are cut into chunks of about CHUNK tokens, written once. For each order a chunk sends its different n-grams, packed, to
buckets by their hash; a bucket counts them, keeps the repeated ones and tells each chunk which these are. Only n-grams
whose both shorter parts are repeated go on to the next order, so nothing repeated is missed. Buckets ask those of the order
below for counts and probabilities, and send sums by context to the contexts' buckets, which test them. A chunk or bucket
sends a frequent n-gram or context once, so none makes another bucket large. A bucket notes which of its n-grams a chunk has
as it counts them, and gives their values by that, so no chunk asks twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Scratch, doc_crc
from eventloom.llm.textscan import Words, batches, distinct, opened

DEPTH = 3
LEAST = 2
DISCOUNT = 0.75
#: Tokens of a chunk, and n-grams that a bucket gets about: larger ones send fewer n-grams, and need more memory.
CHUNK = 1 << 21

#: White space parts words; capital letters of ASCII are small ones.
_INSIDE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
_NORMAL = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: The key that stands for the end of a text.
END = np.uint64(1)
_CHUNKS = "chunk long, ids array<string>, held binary, sizes binary, words binary, codes binary, masks array<binary>"
#: A bucket's n-grams: contexts, suffixes and counts; of words the keys alone, as c. Keys are joined(c, s).
_GRAMS = "bucket int, c binary, s binary, kind int, n binary"
#: What a bucket's counting gives, by part.
_COUNTED = "part string, chunk long, bucket int, bits binary, own binary, at binary, c binary, kind int, n binary"
_PRICED = "bucket int, g binary, kind int, n binary, p binary, v binary"


def joined(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The key of an n-gram from those of its first n - 1 and its last n - 1 words."""
    with np.errstate(over="ignore"):
        x = context * np.uint64(0x9E3779B97F4A7C15)
        x += suffix * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        return x


def _columns(kinds: str) -> list[str]:
    return [x.split()[0] for x in kinds.split(", ")]


def _numbers(blob: bytes, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(blob, dtype=kind)


def _narrow(n: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers from 0 in as few bytes as the largest needs."""
    n = n.astype(np.min_scalar_type(int(n.max(initial=0))))
    return n.itemsize, n.tobytes()


def _wide(kind: int, blob: bytes) -> np.ndarray:
    return _numbers(blob, f"u{kind}").astype(np.int64)


def _packed(n: np.ndarray) -> bytes:
    """Numbers in few bytes: those of one weight side by side, as the high ones are much alike, then compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(n.view(np.uint8).reshape(-1, n.itemsize).T).tobytes())


def _unpacked(blob: bytes, kind=np.uint64) -> np.ndarray:
    raw = _numbers(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets rise with the key, so sorted keys fall into slices."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of sorted keys."""
    at = _bucket(keys, buckets)
    edges = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)])) if len(at) else np.zeros(1, int)
    for start, stop in zip(edges[:-1], edges[1:], strict=True):
        yield int(at[start]), slice(int(start), int(stop))


def _chunk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, held_out, text) to rows of _CHUNKS; a text that is longer than a chunk is one."""
    number = TaskContext.get().partitionId() << 32
    ids, held, sizes, keys, n = [], [], [], [], 0

    def packed() -> pd.DataFrame:
        words, _, codes = distinct(np.concatenate(keys))
        row = (number, ids, np.array(held, dtype=np.uint8).tobytes(), np.concatenate(sizes).astype(np.int32).tobytes(), _packed(np.diff(words, prepend=np.uint64(0))), _packed(codes.astype(np.int32)), [])
        return pd.DataFrame([row], columns=["chunk", "ids", "held", "sizes", "words", "codes", "masks"])

    for frame in frames:
        for begin, texts in batches(frame["text"]):
            found = Words(texts, (), _INSIDE, _NORMAL)
            size = np.bincount(found.row, minlength=len(texts)) + 1
            tokens = np.full(int(size.sum()), END)
            tokens[np.arange(len(found.row)) + found.row] = found.hash
            ids += list(frame["doc_id"].iloc[begin : begin + len(texts)])
            held += list(frame["held_out"].iloc[begin : begin + len(texts)])
            sizes.append(size)
            keys.append(tokens)
            n += len(tokens)
            if n >= CHUNK:
                yield packed()
                ids, held, sizes, keys, n, number = [], [], [], [], 0, number + 1
    if ids:
        yield packed()


class _Tokens:
    """A chunk's tokens, and its n-grams by the place of their last token."""

    def __init__(self, row):
        self.row = row
        self.sizes, self.words = _numbers(row.sizes, np.int32), np.cumsum(_unpacked(row.words), dtype=np.uint64)
        self.codes, self.masks = _unpacked(row.codes, np.int32), list(row.masks)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @cached_property
    def train(self) -> np.ndarray:
        return np.repeat(_numbers(self.row.held, np.uint8) == 0, self.sizes)

    def mask(self, order: int) -> np.ndarray:
        return np.unpackbits(_numbers(self.masks[order - 1], np.uint8), count=len(self.codes)).view(bool)

    def grams(self, order: int, known: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, keys, keys of n-grams one shorter at every place) of n-grams that may be repeated, or that are known to be."""
        before, keys = self.words, self.words[self.codes]
        for _ in range(order - 1):
            before, keys = keys, np.concatenate((keys[:1], joined(keys[:-1], keys[1:])))
        if known:
            at = np.flatnonzero(self.mask(order))
        else:
            shorter = self.mask(order - 1)
            ok = shorter[1:] & shorter[:-1]
            for k in range(order - 1):  # not over the start of a text
                near = self.starts[1:] - 1 + k
                ok[near[near < len(ok)]] = False
            at = np.flatnonzero(ok) + 1
            at = at[at >= order - 1]
        return at, keys[at], before

    def distinct(self, order: int, known: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, different keys in order, a place of each, number of each place's key, keys one shorter)."""
        if order == 1:  # words are there in order
            return np.arange(len(self.codes)), self.words, np.zeros(0, int), self.codes, self.words
        at, keys, before = self.grams(order, known)
        every, first, number = distinct(keys)
        return at, every, at[first], number, before


def _asked(order: int, buckets: int) -> Callable:
    """Chunks to (bucket, chunk, g, kind, n): the different n-grams, and their count in training texts as numbers of kind bytes."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                tokens = _Tokens(row)
                at, every, _, number, _ = tokens.distinct(order)
                n = np.bincount(number[tokens.train[at]], minlength=len(every))
                rows = [(b, row.chunk, every[x].tobytes(), *_narrow(n[x])) for b, x in _slices(every, buckets)]
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "g", "kind", "n"])

    return ask


def _counter(order: int) -> Callable:
    """A bucket's asked n-grams to rows of three parts: what each chunk is told (chunk, bucket, bits, own), where among the
    kept ones in the order of their keys those of a chunk are (chunk, bucket, at), and the kept ones, where chunk is -1.

    bits tell which are repeated, own which of these the chunk is to describe: each one is described by one chunk. Kept are
    those that are repeated, or all words.
    """

    def count(asked: pd.DataFrame) -> pd.DataFrame:
        g = _numbers(b"".join(asked["g"]))
        n = np.concatenate([_wide(k, b) for k, b in zip(asked["kind"], asked["n"], strict=True)])
        every, first, number = distinct(g)
        total = np.bincount(number, weights=n, minlength=len(every)).astype(np.int64)
        kept = total >= LEAST
        cuts = np.cumsum([len(x) // 8 for x in asked["g"]])[:-1]
        own = np.zeros(len(g), dtype=bool)
        own[first[kept]] = True
        told, mine = np.split(kept[number], cuts), np.split(own, cuts)
        bucket = int(asked["bucket"].iloc[0])
        rows = [("told", int(x), bucket, np.packbits(a).tobytes(), np.packbits(b).tobytes(), None, None, 0, None) for x, a, b in zip(asked["chunk"], told, mine, strict=True)]
        kept = kept if order > 1 else total >= 0
        place = (np.cumsum(kept) - 1).astype(np.int32)
        for x, part in zip(asked["chunk"], np.split(number, cuts), strict=True):
            rows.append(("at", int(x), bucket, None, None, _packed(np.diff(place[part[kept[part]]], prepend=np.int32(0))), None, 0, None))
        rows.append(("grams", -1, bucket, None, None, None, every[kept].tobytes() if order == 1 else None, *_narrow(total[kept])))
        return pd.DataFrame(rows, columns=_columns(_COUNTED))

    return count


def _marker(order: int, buckets: int, last: bool) -> Callable:
    """A chunk and what buckets tell it to the chunk with a mask more, and rows of what it is to describe.

    The latter have bucket, which is -1 for the chunk, contexts c and suffixes s. The last mask goes alone, without the chunk.
    """

    def mark(chunk: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names = [*_columns(_CHUNKS), "bucket", "c", "s"]
        if chunk.empty:
            return pd.DataFrame(columns=names)
        row = next(chunk.itertuples())
        tokens, bits = _Tokens(row), dict(zip(told["bucket"], zip(told["bits"], told["own"], strict=True), strict=True))
        at, every, first, number, before = tokens.distinct(order)
        known, rows = np.zeros(len(every), dtype=bool), []
        for b, x in _slices(every, buckets):
            known[x], own = (np.unpackbits(_numbers(y, np.uint8), count=x.stop - x.start).view(bool) for y in bits[b])
            if order > 1 and own.any():
                places = first[x][own]
                rows.append((row.chunk, *[None] * 6, b, before[places - 1].tobytes(), before[places].tobytes()))
        mask = np.zeros(len(tokens.codes), dtype=bool)
        mask[at] = known[number]
        masks = [*row.masks, np.packbits(mask).tobytes()]
        own = (row.chunk, *([None] * 5 if last else (row.ids, row.held, row.sizes, row.words, row.codes)), masks[-1:] if last else masks, -1, None, None)
        return pd.DataFrame([own, *rows], columns=names)

    return mark


def _described(counted: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
    """A bucket's repeated n-grams with contexts and suffixes, in the order of their keys."""
    if counted.empty:
        return pd.DataFrame(columns=_columns(_GRAMS))
    row = next(counted.itertuples())
    c, s = (_numbers(b"".join(parts[x])) for x in "cs")
    order = np.argsort(joined(c, s))  # each of them once
    return pd.DataFrame([(row.bucket, c[order].tobytes(), s[order].tobytes(), row.kind, row.n)], columns=_columns(_GRAMS))


def _looked(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of the wanted among sorted keys, 0 where one is not there."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(values.dtype)


def _asking(buckets: int) -> Callable:
    """A bucket's n-grams to (to, bucket, kind, keys): its different contexts, kind 0, and suffixes, kind 1."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                for kind, blob in ((0, row.c), (1, row.s)):
                    every = distinct(_numbers(blob))[0]
                    yield pd.DataFrame([(b, row.bucket, kind, every[x].tobytes()) for b, x in _slices(every, buckets)], columns=["to", "bucket", "kind", "keys"])

    return ask


def _telling(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """(bucket, to, kind, told): counts of contexts and probabilities of suffixes."""
    g, p = (_numbers(b"".join(held[x]), kind) for x, kind in (("g", np.uint64), ("p", np.float32)))
    n = np.concatenate([np.zeros(0, np.int64), *(_wide(k, b) for k, b in zip(held["kind"], held["n"], strict=True))])
    rows = [(r.bucket, r.to, r.kind, _packed(_looked(g, _numbers(r.keys), p if r.kind else n))) for r in asked.itertuples()]
    return pd.DataFrame(rows, columns=["bucket", "to", "kind", "told"])


def _gathered(told: pd.DataFrame, kind: int, of: type) -> np.ndarray:
    """The answers of one kind, in the order of their buckets and so of the sorted keys."""
    part = told[told["kind"] == kind]
    return np.concatenate([np.zeros(0, of), *(_unpacked(x, of) for x in part.sort_values("to")["told"])])


def _given(row, told: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """A bucket's different contexts, a place of each and each n-gram's number among them; counts, contexts' counts, and
    probabilities behind the parents of the contexts."""
    every, first, number = distinct(_numbers(row.c))
    total = _gathered(told, 0, np.int64)[number]
    below = _gathered(told, 1, np.float32)[distinct(_numbers(row.s))[2]].astype(float)
    return every, first, number, _wide(row.kind, row.n), total, below


_SUMS = ("share", "seen", "stored", "gain", "total")


def _summing(buckets: int) -> Callable:
    """A bucket's n-grams to (to, bucket, c, sums): what its different contexts add up to."""

    def send(grams: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in grams.itertuples():
            every, first, number, n, total, below = _given(row, told)
            add = lambda x: np.bincount(number, weights=x, minlength=len(every))  # noqa: B023, E731
            share = (n - DISCOUNT) / total
            sums = np.stack((add(share), add(n), add(np.ones(len(n))), add(n * np.log(share / below)), total[first].astype(float)))
            rows += [(b, row.bucket, every[x].tobytes(), _packed(sums[:, x].ravel())) for b, x in _slices(every, buckets)]
        return pd.DataFrame(rows, columns=["to", "bucket", "c", "sums"])

    return send


def _test(sent: pd.DataFrame) -> pd.DataFrame:
    """Contexts' sums to (bucket, to, kind, told, keys): to each sender, kind 2, rest, or 0 for no state; and states, kind -1."""
    c, sums = _numbers(b"".join(sent["c"])), np.concatenate([_unpacked(x, np.float64).reshape(len(_SUMS), -1) for x in sent["sums"]], axis=1)
    every, first, number = distinct(c)
    share, seen, stored, gain = (np.bincount(number, weights=sums[i], minlength=len(every)) for i in range(4))
    total = sums[4, first]
    good = gain + (total - seen) * np.log(1 - share) > 0.5 * np.log(total) * stored
    rest = np.where(good, 1 - share, 0.0)
    told = np.split(rest[number], np.cumsum([len(x) // 8 for x in sent["c"]])[:-1])
    to = int(sent["to"].iloc[0])
    rows = [(int(b), to, 2, _packed(x), b"") for b, x in zip(sent["bucket"], told, strict=True)]
    rows.append((to, to, -1, np.log10(rest[good]).tobytes(), every[good].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "to", "kind", "told", "keys"])


def _priced(grams: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """A bucket's n-grams to _PRICED: p behind the longest state, v what one adds to a text's log10 probability."""
    rows = []
    for row in grams.itertuples():
        _, _, number, n, total, below = _given(row, told)
        rest = _gathered(told, 2, np.float64)[number]
        state = rest > 0
        p = np.where(state, (n - DISCOUNT) / total + rest * below, below)
        v = np.log10(p / np.where(state, rest * below, below))
        g = joined(_numbers(row.c), _numbers(row.s))
        rows.append((row.bucket, g.tobytes(), row.kind, row.n, p.astype(np.float32).tobytes(), v.astype(np.float32).tobytes()))
    return pd.DataFrame(rows, columns=_columns(_PRICED))


def _first(size: float) -> Callable:
    """Words and their counts to _PRICED at the root."""

    def price(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                n = _wide(row.kind, row.n)
                blobs = (((n + 1) / size).astype(np.float32).tobytes(), np.zeros(len(n), np.float32).tobytes())
                yield pd.DataFrame([(row.bucket, row.c, row.kind, row.n, *blobs)], columns=_columns(_PRICED))

    return price


def _answerer(order: int) -> Callable:
    """Where a chunk's n-grams are in a bucket and what it has to (chunk, bucket, k, n, v).

    It has _PRICED rows and, with kind -1, states (g, v) of contexts.
    """

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        grams, states = held[held["kind"] >= 0], held[held["kind"] < 0]
        g, v = _numbers(b"".join(grams["g"])), _numbers(b"".join(grams["v"]), np.float32).astype(float)
        n = np.concatenate([np.zeros(0, np.int64), *(_wide(k, b) for k, b in zip(grams["kind"], grams["n"], strict=True))])
        c, left = _numbers(b"".join(states["g"])), _numbers(b"".join(states["v"]), np.float64)
        value = (v + _looked(c, g, left)).astype(np.float32)
        rows = []
        for row in asked.itertuples():
            at = np.cumsum(_unpacked(row.at, np.int32))
            rows.append((row.chunk, row.bucket, order, _packed(n[at]) if order == 1 else b"", _packed(value[at])))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "k", "n", "v"])

    return answer


def _scorer(orders: int, buckets: int, tokens: int, words: int) -> Callable:
    """A chunk, its answers and, as k 0, its last mask to a row for each of its texts."""

    def score(chunk: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        if chunk.empty:
            return pd.DataFrame(columns=names)
        row = next(chunk.itertuples())
        own, size = _Tokens(row), float(tokens + words + 1)
        found = {(k, b): (n, v) for k, b, n, v in zip(told["k"], told["bucket"], told["n"], told["v"], strict=True)}
        own.masks += [found[0, -1][1]] if (0, -1) in found else []
        total = np.zeros(len(own.codes))
        for k in range(1, orders + 1):
            at, every, _, number, _ = own.distinct(k, known=True)
            parts = [found[k, b] for b, _ in _slices(every, buckets)]
            if k == 1:
                n = np.concatenate([_unpacked(x[0], np.int64) for x in parts])[number]
                base = np.log10((n + 1) / size)
            total[at] += np.concatenate([_unpacked(x[1], np.float32) for x in parts] or [np.zeros(0)])[number].astype(float)
        sums = lambda x: np.add.reduceat(x, own.starts)
        held = _numbers(row.held, np.uint8).astype(bool)
        columns = (list(row.ids), held, own.sizes.astype(np.int64), sums((n > 0).astype(np.int64)), sums(base), sums(base + total))
        return pd.DataFrame(dict(zip(names, columns, strict=True)))

    return score


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of _CHUNKS with all tokens of docs: words of the lower-cased text, and an end."""
    held = F.pmod(doc_crc(F.col("doc_id")), F.lit(7)) == 2
    given = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInPandas(_chunk, _CHUNKS)


def counted(now: DataFrame, order: int, buckets: int, scratch: Scratch, last: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks with one mask more, where chunks' n-grams are, _GRAMS): all words, and longer n-grams that LEAST training texts'
    places have. Of the last order the chunks have their ids and the last mask alone."""
    asked = now.mapInPandas(_asked(order, buckets), "bucket int, chunk long, g binary, kind int, n binary")
    table = asked.groupBy("bucket").applyInPandas(_counter(order), _COUNTED)
    table = scratch.keep(table, f"counted-{order}", by="part")
    told = table.filter("part = 'told'").select("chunk", "bucket", "bits", "own")
    marked = now.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_marker(order, buckets, last), f"{_CHUNKS}, bucket int, c binary, s binary")
    marked = marked.withColumn("described", F.col("bucket") >= 0)
    written = scratch.keep(marked, f"chunks-{order}", by="described")
    if not last:
        scratch.drop(f"chunks-{order - 1}")
    scratch.drop(f"counted-{order}/part=told")
    grams = scratch.again(table, f"counted-{order}").filter("part = 'grams'").select("bucket", "c", F.col("c").alias("s"), "kind", "n")
    if order > 1:
        parts = written.filter("described").select("bucket", "c", "s")
        grams = grams.groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInPandas(_described, _GRAMS)
    grams = scratch.keep(grams, f"grams-{order}")
    scratch.drop(f"counted-{order}/part=grams", f"chunks-{order}/described=true")
    at = scratch.again(table, f"counted-{order}").filter("part = 'at'").select("chunk", "bucket", "at")
    return scratch.again(marked, f"chunks-{order}").filter("not described").select(*_columns(_CHUNKS)), at, grams


def level(grams: DataFrame, shorter: DataFrame, buckets: int, scratch: Scratch, order: int) -> tuple[DataFrame, DataFrame]:
    """_GRAMS of an order and _PRICED of the one below to (_PRICED, states (bucket, g, v)).

    v is what an n-gram, or a state, adds to a text's log10 probability.
    """
    asked = grams.mapInPandas(_asking(buckets), "to int, bucket int, kind int, keys binary")
    told = asked.groupBy("to").cogroup(shorter.groupBy("bucket")).applyInPandas(_telling, "bucket int, to int, kind int, told binary")
    told = scratch.keep(told, f"told-{order}")
    sent = grams.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(_summing(buckets), "to int, bucket int, c binary, sums binary")
    tested = scratch.keep(sent.groupBy("to").applyInPandas(_test, "bucket int, to int, kind int, told binary, keys binary"), f"tested-{order}")
    every = told.unionByName(tested.filter("kind = 2").drop("keys"))
    out = scratch.keep(grams.groupBy("bucket").cogroup(every.groupBy("bucket")).applyInPandas(_priced, _PRICED), f"priced-{order}")
    scratch.drop(f"told-{order}", f"grams-{order}")
    return out, tested.filter("kind = -1").select("bucket", F.col("keys").alias("g"), F.col("told").alias("v"))


def score_texts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty: their only token is the end. With no training text all counts are 0, and probabilities are
    those of add-one smoothing. Repeated rows count as often as they stand and get equal results. Very long texts are read
    whole. No order among rows matters, so there are no ties. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "suffixtree")
    now = scratch.keep(chunks(docs), "chunks-0")
    sizes = lambda frames: (pd.DataFrame({"n": [int(_numbers(x, np.int32).sum()) for x in f["sizes"]]}) for f in frames)
    total = now.select("sizes").mapInPandas(sizes, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(4, -(-total // CHUNK))
    now, at, grams = counted(now, 1, buckets, scratch)
    sums = lambda frames: (pd.DataFrame([(int(np.count_nonzero(n)), int(n.sum())) for n in (_wide(*x) for x in zip(f["kind"], f["n"], strict=True))], columns=["v", "n"]) for f in frames)
    whole = grams.select("kind", "n").mapInPandas(sums, "v long, n long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "vn"]).first()
    tokens, words = int(whole.n), int(whole.v)
    priced = scratch.keep(grams.mapInPandas(_first(float(tokens + words + 1)), _PRICED), "priced-1")
    scratch.drop("grams-1")
    answers, masks = [], None
    for order in range(1, depth + 2):
        # contexts of this order are states by the n-grams of the next
        held = priced.select("kind", "bucket", "g", "n", "v")
        if order <= depth:
            more, beside, grams = counted(now, order + 1, buckets, scratch, last=order == depth)
            masks, now = (more, now) if order == depth else (None, more)  # the last mask goes to the scores by itself
            longer, states = level(grams, priced, buckets, scratch, order + 1)
            held = held.unionByName(states.select(F.lit(-1).alias("kind"), "bucket", "g", F.lit(b"").alias("n"), "v"))
        told = at.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInPandas(_answerer(order), "chunk long, bucket int, k int, n binary, v binary")
        answers.append(scratch.keep(told, f"answers-{order}"))
        scratch.drop(f"priced-{order}", f"tested-{order + 1}", f"counted-{order}")
        priced, at = (longer, beside) if order <= depth else (None, None)
    if masks is not None:
        answers.append(masks.select("chunk", F.lit(-1).alias("bucket"), F.lit(0).alias("k"), F.lit(b"").alias("n"), F.col("masks")[0].alias("v")))
    told = answers[0]
    for more in answers[1:]:
        told = told.unionByName(more)
    scored = now.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(
        _scorer(depth + 1, buckets, tokens, words), "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
