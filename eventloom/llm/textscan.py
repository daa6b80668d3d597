"""Words of many texts at once, as arrays: places, hashes and the lines they stand in.

Words are runs of ASCII letters and digits and of all bytes that are not ASCII. For hashes letters are lower-cased and digits
are 0. Texts are joined with line ends between them, so what starts at a new line starts at a new text too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

#: Whether a byte is in a word, and what it is there.
INSIDE = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
NORMAL = np.array([b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], dtype=np.uint8)
#: Bytes above which a word is hashed alone.
LONG = 1 << 10
#: Bytes of text that are scanned at once; a longer text is scanned alone.
AT_ONCE = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads differences upwards and downwards."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(values: np.ndarray, place: np.ndarray, first: np.ndarray, factor: int) -> np.ndarray:
    """Of groups of values, which start at `first`, hashes that tell their order too; place counts within the group."""
    powers = _POWERS.get(factor, np.zeros(0, dtype=np.uint64))
    if len(powers) <= (most := int(place.max(initial=0))):
        powers = _POWERS[factor] = np.cumprod(np.full(2 * most + 64, factor, dtype=np.uint64), dtype=np.uint64)
    return mixed(np.add.reduceat(values * powers[place], first)) if len(first) else np.zeros(0, dtype=np.uint64)


def places(first: np.ndarray, n: int) -> np.ndarray:
    """Of n items in groups that start at `first` the place in the group."""
    return np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))


def opened(*numbers: np.ndarray) -> np.ndarray:
    """Where any of these sequences changes, the first item included."""
    out = np.zeros(len(numbers[0]), dtype=bool)
    out[:1] = True
    for x in numbers:
        out[1:] |= x[1:] != x[:-1]
    return out


def batches(texts: Iterable[str]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts as bytes) of about AT_ONCE bytes together."""
    held, begin, size, n = [], 0, 0, 0
    for n, text in enumerate(texts, 1):
        held.append(text.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= AT_ONCE:
            yield begin, held
            held, begin, size = [], n, 0
    if held:
        yield begin, held


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys, a place of each, and the number of each key among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = opened(ranked)
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[new], order[new], number


def _hashes(normal: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the words that start at `first`, eight bytes at a time."""
    padded = np.append(normal, np.zeros(8, dtype=np.uint8))
    eights = np.ndarray(shape=(len(normal) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    with np.errstate(over="ignore"):
        out = mixed((length + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at, left = np.flatnonzero(length <= LONG), length[length <= LONG]
        step = 0
        while len(at):
            keep = np.uint64(64) - (np.minimum(left, 8) << 3).astype(np.uint64)
            out[at] = mixed(out[at] ^ ((eights[first[at] + step] << keep) * np.uint64(0xD6E8FEB86659FD93)))
            more = left > 8
            at, left, step = at[more], left[more] - 8, step + 8
        for i in np.flatnonzero(length > LONG):
            digest = hashlib.blake2b(normal[first[i] : first[i] + length[i]].tobytes(), digest_size=8).digest()
            out[i] = np.frombuffer(digest, dtype=np.uint64)[0]
    return out


class Words:
    """raw bytes; starts and sizes of texts in them; and of each word its first and last byte, hash, text and line."""

    def __init__(self, texts: list[bytes], apart: tuple[bytes, ...] = (), inside: np.ndarray = INSIDE, normal: np.ndarray = NORMAL):
        """apart: characters of three bytes that stand between words; inside, normal: tables of bytes."""
        self.raw = raw = np.frombuffer(b"".join(x + b"\n" for x in texts), dtype=np.uint8)
        self.sizes = np.array([len(x) + 1 for x in texts])
        self.starts = np.cumsum(self.sizes) - self.sizes
        there, self.apart = inside[raw], np.zeros(len(raw) if apart else 0, dtype=bool)
        for wide in apart:
            at = np.flatnonzero((raw[:-2] == wide[0]) & (raw[1:-1] == wide[1]) & (raw[2:] == wide[2]))
            for k in range(3):
                there[at + k], self.apart[at + k] = False, True
        edges = np.flatnonzero(there[1:] != there[:-1]) + 1
        edges = np.concatenate(([0], edges)) if len(there) and there[0] else edges  # every text ends outside words
        self.first, self.last = edges[::2], edges[1::2] - 1
        self.hash = _hashes(normal[raw], self.first, self.last - self.first + 1)
        self.row = np.searchsorted(self.starts, self.first, "right") - 1
        self.breaks = np.cumsum(raw == 10, dtype=np.int32)
        self.line = self.breaks[self.first]
