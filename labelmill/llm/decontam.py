"""Benchmark decontamination: word windows of test items, looked up in training texts.

The windows of all items are a hash set that every task gets with its function, which Spark
broadcasts, if the built set is within ``INDEX_BYTES``; its size is counted first. A larger
benchmark is joined with the documents' windows by a shuffle on their hashes. Either way every
hit is verified on its words, so the result is the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm import textscan as ts
from labelmill.session import materialize

WINDOW_WORDS = 10
INDEX_BYTES = 64 << 20
FILTER_BITS = 20
ITEM_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


class ItemWindows:
    """Windows of test items: for each length their sorted hashes, and the item and words of each.

    The words of all items stand once in ``body``, each with a space behind it; a window is a
    range of it. So an item word takes about 28 bytes besides its own.
    """

    def __init__(self, items: list[tuple], size: int = WINDOW_WORDS) -> None:
        self.ids = [item_id for item_id, _ in items]
        bodies, found, base = [], {}, 0
        for top, scan in ts.scans(pa.array([text for _, text in items], pa.string()), ts.ALNUM, ts.ASCII_LOWER):
            counts = scan.counts()
            stands = np.zeros(len(scan.words) + 1, np.int64)
            np.cumsum(scan.ends - scan.starts + 1, out=stands[1:])
            if len(scan.words):
                bodies.append(scan.joined(0, len(scan.words)) + b" ")
            for length in np.unique(np.minimum(counts[counts > 0], size)).tolist():
                at, hashes = scan.windows(length, salt=length)
                item = np.searchsorted(scan.bounds, at, "right") - 1
                own = (counts[item] == length) | (length == size)
                at, item = at[own], item[own]
                found.setdefault(length, []).append((hashes[own], (top + item).astype(np.int32), base + stands[at], base + stands[at + length] - 1))
            base += int(stands[-1])
        self.body, self.by_length = b"".join(bodies), {}
        for length, parts in found.items():
            hashes, item, first, last = map(np.concatenate, zip(*parts))
            order = np.argsort(hashes, kind="stable")
            bitmap = np.zeros(1 << FILTER_BITS, bool)
            bitmap[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.by_length[length] = bitmap, hashes[order], item[order], first[order], last[order]

    def start(self) -> None:
        """Forget what was looked up; called in each task."""
        self.known: dict[tuple[int, int], dict[bytes, set]] = {}

    def owners(self, length: int, first: int, last: int) -> dict[bytes, set]:
        """Item ids by window, for the windows of one hash."""
        known = self.known.get((length, first))
        if known is None:
            known = self.known[length, first] = {}
            _, _, item, begin, end = self.by_length[length]
            for k in range(first, last):
                known.setdefault(self.body[begin[k] : end[k]], set()).add(self.ids[item[k]])
        return known

    def hits(self, scan: ts.Scan) -> tuple[np.ndarray, list[set]]:
        """Which words lie in an occurrence of a window, and the items of each document."""
        first, last, items = [], [], [set() for _ in range(len(scan))]
        for length, (bitmap, order, *_) in self.by_length.items():
            at, hashes = scan.windows(length, salt=length)
            maybe = np.flatnonzero(bitmap[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            low, high = (np.searchsorted(order, hashes[maybe], side) for side in ("left", "right"))
            same = np.flatnonzero(high > low)
            for start, a, b in zip(at[maybe[same]].tolist(), low[same].tolist(), high[same].tolist()):
                owners = self.owners(length, a, b).get(scan.joined(start, start + length))
                if owners:
                    items[int(np.searchsorted(scan.bounds, start, "right")) - 1] |= owners
                    first.append(start)
                    last.append(start + length)
        return ts.cover(len(scan.words), np.array(first, np.int64), np.array(last, np.int64)), items


def _index_bytes(benchmark: DataFrame) -> int:
    """What ``ItemWindows`` of the benchmark takes."""
    words = F.regexp_count("text", F.lit(ITEM_WORD))
    return benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 29 * words + 64), F.lit(0)).cast("long")).first()[0]


def _window_rows(rows: DataFrame, size: int | None, lengths: list[int]) -> DataFrame:
    """(id, row, length, hash, place) of all windows; with size, of items: with their words, and a shorter item is one window."""

    def work(batches):
        for batch in batches:
            for top, scan in ts.scans(batch.column(2), ts.ALNUM, ts.ASCII_LOWER):
                counts = scan.counts()
                for length in lengths:
                    at, h = scan.windows(length, salt=length)
                    doc = np.searchsorted(scan.bounds, at, "right") - 1
                    if size and length < size:
                        keep = counts[doc] == length
                        at, h, doc = at[keep], h[keep], doc[keep]
                    pick = pa.array(top + doc)
                    columns = [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(np.full(len(at), length, np.int32)), pa.array(ts.as_signed(h)), pa.array((at - scan.bounds[doc]).astype(np.int32))]
                    if size:
                        columns.append(pa.array([scan.joined(k, k + length) for k in at], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "length", "hash", "place", "words"][: len(columns)])

    return rows.mapInArrow(work, "id long, row long, length int, hash long, place int" + ", words binary" * bool(size))


def _joined_hits(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """docs with a column more, (place, words, items) of each hit, by a shuffle on window hashes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.lit(0).cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    lengths = list(range(1, size + 1))
    tests = _window_rows(items, size, lengths).groupBy("length", "hash", "words").agg(F.collect_set("id").alias("items"))
    # A table of its own, so that AQE can split the rows of a hot window in the join.
    tests = materialize(tests, "windows")
    used = [r[0] for r in tests.select("length").distinct().collect()]
    text = F.col("text").cast("string")
    rows = _window_rows(docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text), None, used)
    hits = rows.join(tests, ["length", "hash"]).groupBy(F.col("id").alias("found_id"), F.col("row").alias("found_row")).agg(F.collect_set(F.struct("place", "length", "words", "items")).alias("found"))
    match = F.col("d.doc_id").cast("long").eqNullSafe(F.col("h.found_id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("h.found_row"))
    joined = docs.alias("d").join(hits.alias("h"), match, "left")
    # By place: a column of docs may have any name.
    columns = [*(F.col(f"d.`{c}`") for c in docs.columns), F.col("h.found")]
    return joined.select(*(c.alias(f"c{i}") for i, c in enumerate(columns)))


def _with_hits(docs: DataFrame, benchmark: DataFrame, size: int, limit: int, finish, schema):
    """finish(batch, first, scan, mask, items) on each run of rows; docs must have doc_id and text."""
    columns = docs.columns
    at = columns.index("text")
    benchmark = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    if _index_bytes(benchmark) <= limit:
        windows = ItemWindows([(r[0], r[1]) for r in benchmark.collect()], size)

        def work(batches):
            windows.start()
            for batch in batches:
                for first, scan in ts.scans(batch.column(at), ts.ALNUM, ts.ASCII_LOWER):
                    yield finish(batch, first, scan, *windows.hits(scan))

        return docs.mapInArrow(work, schema)

    def joined_work(batches):
        for batch in batches:
            found = batch.column(len(columns)).to_pylist()
            for first, scan in ts.scans(batch.column(at), ts.ALNUM, ts.ASCII_LOWER):
                spans, items = [], [set() for _ in range(len(scan))]
                for i, base in enumerate(scan.bounds[:-1].tolist()):
                    for hit in found[first + i] or ():
                        start, end = base + hit["place"], base + hit["place"] + hit["length"]
                        if scan.joined(start, end) == hit["words"]:
                            spans.append((start, end))
                            items[i].update(hit["items"])
                bounds = np.array(spans, np.int64).reshape(-1, 2)
                yield finish(batch, first, scan, ts.cover(len(scan.words), bounds[:, 0], bounds[:, 1]), items)

    return _joined_hits(docs, benchmark, size).mapInArrow(joined_work, schema)


def _hit_counts(scan: ts.Scan, mask: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[scan.bounds[1:]] - sums[scan.bounds[:-1]]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, limit: int = INDEX_BYTES) -> DataFrame:
    """One row for each row of docs (doc_id, text): what of the benchmark (item_id, text) it holds.

    Words are runs of digits, letters a-z (A-Z is lower-cased) and non-ASCII characters. A
    window is ``size`` consecutive words of an item, or all of a shorter item that has words.
    Document words inside any occurrence of a window are hit. Columns: doc_id, n_words, n_hit,
    n_items, items_sha256 (the item ids sorted as strings, comma-joined), contaminated. Null
    and empty texts have no words; rows that repeat are reported each; an item_id null still
    hits words but is no item; empty tables give no rows or no hits. Texts of any length are read
    whole; other columns play no part, whatever their names.
    """

    def finish(batch, first, scan, mask, items):
        ids = [sorted(str(x) for x in found if x is not None) for found in items]
        hit = _hit_counts(scan, mask)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).slice(first, len(scan)), pa.array(scan.counts().astype(np.int64)), pa.array(hit), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string()), pa.array(hit > 0)],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_hits(rows, benchmark, size, limit, finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = WINDOW_WORDS, limit: int = INDEX_BYTES) -> DataFrame:
    """docs, all columns as they are, without contaminated documents, or with hit words cut out.

    With remove="spans" each run of hit words, from its first to its last byte, is taken out
    of the text, and nothing else changes. Nulls, repeats and empty tables as in
    ``contamination``; null texts stay null; columns may have any names.
    """
    names = docs.columns
    at = names.index("text")

    def drop(batch, first, scan, mask, items):
        part = batch.slice(first, len(scan)).select(range(len(names)))
        part = part.filter(pa.array(_hit_counts(scan, mask) == 0))
        return pa.RecordBatch.from_arrays(part.columns, names=names)

    def cut(batch, first, scan, mask, items):
        part = batch.slice(first, len(scan)).select(range(len(names)))
        texts = part.column(at).to_pylist()
        for i in np.flatnonzero(_hit_counts(scan, mask)):
            a, b = scan.bounds[i], scan.bounds[i + 1]
            hit = np.flatnonzero(np.diff(np.concatenate([[0], mask[a:b].astype(np.int8), [0]])))
            kept, last = [], scan.offsets[i]
            for s, e in zip(hit[::2], hit[1::2]):
                kept.append(scan.raw[last : scan.starts[a + s]].tobytes())
                last = scan.ends[a + e - 1]
            kept.append(scan.raw[last : scan.offsets[i + 1]].tobytes())
            texts[i] = b"".join(kept).decode("utf-8", "replace")
        columns = [part.column(k) if k != at else pa.array(texts, part.column(k).type) for k in range(part.num_columns)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return _with_hits(docs, benchmark, size, limit, {"documents": drop, "spans": cut}[remove], docs.schema)
