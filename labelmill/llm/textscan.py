"""Words, hashes of words and hashes of word windows for a whole Arrow batch at once.

Texts are handled as UTF-8 bytes. A word is hashed in blocks of eight bytes, each mixed with
its place in the word; words of up to eight bytes never collide. A window's hash is made from
those of two shorter windows that cover it, in as many steps as its length has binary digits,
and every step mixes. So no word or window is a polynomial in a fixed base, of which structured
texts are known that collide. A second hash starts from the bytes anew.

Work goes in chunks, so that a long text needs some eight bytes of memory for each of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 18
CHUNK = 1 << 16
LONG_WORD = 4096

IDENTITY = np.arange(256, dtype=np.uint8)
ASCII_LOWER = IDENTITY.copy()
ASCII_LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: The bytes of a block that belong to a word with so many bytes left.
_TAKEN = np.array([2 ** (8 * k) - 1 for k in range(9)], U64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finaliser of splitmix64, after adding a salt."""
    with np.errstate(over="ignore"):
        x = x + U64((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in their order."""
    with np.errstate(over="ignore"):
        return mix(a * U64(0xA24BAED4963EE407) + b)


def _every_eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; behind the end there are zeros."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def _block_hashes(blocks: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    return mix(blocks ^ mix(place.astype(U64), salt), salt)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of data[start:end] for each word; words are in order."""
    out = np.empty(len(starts), U64)
    for a in range(0, len(starts), CHUNK):
        s, e = starts[a : a + CHUNK], ends[a : a + CHUNK]
        size = e - s
        blocks = _every_eight(data[s[0] : e[-1]])
        total = _block_hashes(blocks[s - s[0]] & _TAKEN[np.minimum(size, 8)], np.zeros(1, np.int64), salt)
        more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        if len(more):
            count = (size[more] - 1) // 8
            owner = np.repeat(more, count)
            first = np.cumsum(count) - count
            place = np.arange(len(owner)) - np.repeat(first, count) + 1
            at = s[owner] + 8 * place
            rest = _block_hashes(blocks[at - s[0]] & _TAKEN[np.minimum(e[owner] - at, 8)], place, salt)
            total[more] += np.add.reduceat(rest, first)
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            for k in range(8, int(size[i]), 8 * CHUNK):
                at = np.arange(k, min(int(size[i]), k + 8 * CHUNK), 8)
                rest = blocks[s[i] - s[0] + at] & _TAKEN[np.minimum(size[i] - at, 8)]
                total[i : i + 1] += _block_hashes(rest, at // 8, salt).sum()
        out[a : a + CHUNK] = mix(total + size.astype(U64) * U64(0xD6E8FEB86659FD93), salt)
    return out


def gram_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of each ``size`` consecutive words."""
    out = np.empty(max(0, len(words) - size + 1), U64)
    for a in range(0, len(out), CHUNK):
        h, n = words[a : a + CHUNK + size - 1], 1
        while 2 * n <= size:
            h = combine(h[:-n], h[n:])
            n *= 2
        if n < size:
            h = combine(h[: n - size], h[size - n :])
        out[a : a + len(h)] = mix(h, salt)
    return out


class Scan:
    """Words of consecutive documents. ``bounds[i]:bounds[i + 1]`` are the words of document i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, fold: np.ndarray) -> None:
        self.raw, self.offsets = data, offsets
        self.data = data if fold is IDENTITY else fold[data]
        n = len(offsets) - 1
        if len(data):
            inside = word_bytes[self.data]
            full = offsets[1:] > offsets[:-1]
            edge = np.ones(len(data), bool)
            np.logical_not(inside[:-1], out=edge[1:])
            edge[offsets[:-1][full]] = True
            self.starts = np.flatnonzero(np.logical_and(edge, inside, out=edge))
            edge[:] = True
            np.logical_not(inside[1:], out=edge[:-1])
            edge[offsets[1:][full] - 1] = True
            self.ends = np.flatnonzero(np.logical_and(edge, inside, out=edge)) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.starts, offsets) if n else np.zeros(1, np.int64)
        self.words = word_hashes(self.data, self.starts, self.ends)
        self._second: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def window_starts(self, size: int) -> np.ndarray:
        """Places of all words that begin a window of this size inside their document."""
        ok = np.zeros(len(self.words) + 1, np.int32)
        counts = self.counts()
        has = counts >= size
        np.add.at(ok, self.bounds[:-1][has], 1)
        np.add.at(ok, self.bounds[1:][has] - size + 1, -1)
        return np.flatnonzero(np.cumsum(ok)[:-1])

    @property
    def second(self) -> np.ndarray:
        """Other hashes of the words, from their bytes anew."""
        if self._second is None:
            self._second = word_hashes(self.data, self.starts, self.ends, salt=5)
        return self._second

    def grams(self, size: int, salt: int = 0, second: bool = False) -> np.ndarray:
        """Hash of the ``size`` words from each place on; those over a document's end mean nothing."""
        return gram_hashes(self.second if second else self.words, size, salt)

    def windows(self, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows of this many words."""
        at = self.window_starts(size)
        return at, self.grams(size, salt)[at]

    def joined(self, first: int, last: int) -> bytes:
        """These words with one space between."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[first:last], self.ends[first:last]))


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body, offs


def scans(column: pa.Array, word_bytes: np.ndarray, fold: np.ndarray, limit: int = SLICE_BYTES):
    """(first row, Scan) for runs of rows that hold about ``limit`` bytes, or one longer row."""
    if not len(column):
        return
    body, offs = binary_parts(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, Scan(body[offs[first] : offs[last]], offs[first : last + 1] - offs[first], word_bytes, fold)
        first = last


def cover(total: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of ``total`` places lie in one of the intervals [first, last)."""
    steps = np.zeros(total + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, last, -1)
    return np.cumsum(steps)[:-1] > 0


def as_signed(x: np.ndarray) -> np.ndarray:
    """The same bits as the long that Spark holds."""
    return x.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    bounds = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))
