"""Substring dedup by seed and extend: passages of 50 words that begin in an earlier document.

Seeds are winnowed anchors: of the 25-word sequences inside a 50-word window the one with the
least hash, the last of equal ones. A window's content alone decides its anchor, so equal
windows meet in the group of one anchor, and neighbouring windows share theirs. Every anchor
occurrence is one row, with the hash of its full extent: the words of all windows that chose
it, to both sides. Only anchors in two documents matter further.

Occurrences with equal extents match over their whole length; there the earliest document
decides alone. Where one anchor has several extents, passages begin or end nearby, and the
windows of the earliest document of each extent are compared one by one. So no pairs of
documents are made: rows grow with the number of anchors, not with the square of a group.
The union of the windows found are the maximal repeats of at least 50 words.

An anchor's hash and an extent's or window's hash start from different hashes of the words, so
together they identify a passage by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm import textscan as ts
from labelmill.session import materialize

WINDOW_WORDS = 50
LOW = np.uint64((1 << 24) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    prefix = np.minimum.accumulate(grid, axis=1).ravel()
    suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])


def anchors(scan: ts.Scan, size: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, anchor place, first and last window that chose it; places in the scan's words."""
    starts = scan.window_starts(size)
    gram = size // 2
    if not len(starts):
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    hashes = scan.grams(gram, salt=11)
    place = np.empty(len(scan.words) - size + 1, np.int64)
    for a in range(0, len(place), ts.CHUNK):
        part = hashes[a : a + ts.CHUNK + size - gram]
        ranked = (part & ~LOW) | (LOW - np.arange(len(part), dtype=np.uint64))
        least = sliding_min(ranked, size - gram + 1)
        place[a : a + len(least)] = a + (LOW - (least & LOW)).astype(np.int64)
    place = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return hashes[place[first]], place[first], starts[first], starts[last]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def _occurrences(keyed: DataFrame, size: int) -> DataFrame:
    """(anchor, extent, doc_id, row, first, last) of every anchor occurrence."""

    def work(batches):
        for batch in batches:
            for top, scan in ts.scans(batch.column(2), ts.NOT_SPACE, ts.IDENTITY):
                anchor, place, first, last = anchors(scan, size)
                # All windows of an anchor hold it, so the first and the last one cover the extent.
                whole = scan.grams(size, salt=12, second=True)
                extent = ts.mix(ts.combine(whole[first], whole[last]) + ((place - first) << 32 | last - first).astype(np.uint64), 13)
                doc = np.searchsorted(scan.bounds, first, "right") - 1
                pick = pa.array(top + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ts.as_signed(anchor)), pa.array(ts.as_signed(extent)), batch.column(0).take(pick), batch.column(1).take(pick), pa.array((first - scan.bounds[doc]).astype(np.int32)), pa.array((last - scan.bounds[doc]).astype(np.int32))],
                    names=["anchor", "extent", "doc_id", "row", "first", "last"],
                )

    return keyed.where("doc_id IS NOT NULL").mapInArrow(work, "anchor long, extent long, doc_id long, row long, first int, last int")


def _windows(keyed: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """(anchor, window, doc_id, row, place) of the windows of these anchor occurrences."""
    wanted = edges.groupBy("doc_id", "row").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("spans"))
    rows = keyed.join(wanted, ["doc_id", "row"]).select("doc_id", "row", "text", "spans")

    def work(batches):
        for batch in batches:
            spans = batch.column(3)
            bounds, flat = spans.offsets.to_numpy().astype(np.int64), spans.flatten()
            anchor, first, last = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            bounds = bounds - bounds[0]
            for top, scan in ts.scans(batch.column(2), ts.NOT_SPACE, ts.IDENTITY):
                a, b = bounds[top], bounds[top + len(scan)]
                doc = np.repeat(np.arange(len(scan)), np.diff(bounds[top : top + len(scan) + 1]))
                count = last[a:b] - first[a:b] + 1
                each = np.repeat(np.arange(b - a), count)
                place = first[a:b][each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                start = scan.bounds[doc[each]] + place
                hashes = scan.grams(size, salt=14, second=True)[start]
                pick = pa.array(top + doc[each])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[a:b][each]), pa.array(ts.as_signed(hashes)), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(place.astype(np.int32))],
                    names=["anchor", "window", "doc_id", "row", "place"],
                )

    return rows.mapInArrow(work, "anchor long, window long, doc_id long, row long, place int")


def repeated_spans(docs: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, row, spans): word intervals [first, last) that begin in an earlier document too.

    row is xxhash64 of the text, which tells rows apart that repeat a doc_id.
    """
    keyed = _keyed(docs)
    found = materialize(_occurrences(keyed, size), "anchors")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("extent") != F.max("extent")).alias("several")).where("lo < hi").select("anchor", "several")
    # Each aggregate is a table of its own before it is joined, so that AQE can split hot anchors.
    found = materialize(found.join(materialize(shared, "repeated"), "anchor"), "shared")
    owner = found.groupBy("anchor", "extent").agg(F.min("doc_id").alias("owner"))
    owned = found.join(materialize(owner, "owners"), ["anchor", "extent"])
    whole = owned.where("doc_id > owner").select("doc_id", "row", "first", (F.col("last") + size).alias("last"))
    edges = owned.where("doc_id = owner AND several").select("doc_id", "row", "anchor", "first", "last")
    single = materialize(_windows(keyed, edges, size), "windows")
    earlier = single.groupBy("anchor", "window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi")).where("owner < hi").select("anchor", "window", "owner")
    parts = single.join(materialize(earlier, "earlier"), ["anchor", "window"]).where("doc_id > owner").select("doc_id", "row", F.col("place").alias("first"), (F.col("place") + size).alias("last"))
    return whole.unionByName(parts).groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def kept_words(scan: ts.Scan, stay: np.ndarray) -> list[bytes]:
    """The words of each document that stay, joined by one space."""
    words = np.flatnonzero(stay)
    tops = np.searchsorted(words, scan.bounds)
    starts, ends = scan.starts[words], scan.ends[words].copy()
    # Each word takes the place behind it along, but the last of a document.
    body = np.append(scan.data, np.uint8(0x20))
    takes = np.ones(len(words), bool)
    takes[tops[1:][tops[1:] > tops[:-1]] - 1] = False
    body[ends[takes]] = 0x20
    ends += takes
    steps = np.zeros(2 * len(words) + 1, np.int64)
    steps[:-1:2], steps[1::2], steps[-1] = starts, ends, len(body)
    body = body[np.repeat(np.arange(len(steps)) % 2 == 1, np.diff(steps, prepend=0))].tobytes()
    sizes = np.zeros(len(words) + 1, np.int64)
    np.cumsum(ends - starts, out=sizes[1:])
    return [body[sizes[a] : sizes[b]] for a, b in zip(tops[:-1], tops[1:])]


def remove_repeats(docs: DataFrame, size: int = WINDOW_WORDS, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text for each row of docs (doc_id, text).

    Words are runs of characters other than space and \\t..\\r, unchanged. A word goes if a
    window of ``size`` words over it also begins in a document with a smaller doc_id; all
    windows are judged on the input. kept_text joins the words that stay by one space, and is
    left out if with_text is false. Null
    and empty texts have no words; repeated rows of one doc_id do not count as earlier; a null
    doc_id is never earlier and keeps its text; an empty table gives no rows. Texts of any length are read
    whole; other columns play no part, whatever their names.
    """
    keyed = _keyed(docs)
    spans = repeated_spans(docs, size).select(F.col("doc_id").alias("span_id"), F.col("row").alias("span_row"), "spans")
    rows = keyed.join(spans, (F.col("doc_id") == F.col("span_id")) & (F.col("row") == F.col("span_row")), "left").select("doc_id", "text", "spans")

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text]

    def work(batches):
        for batch in batches:
            bounds, flat = batch.column(2).offsets.to_numpy().astype(np.int64), batch.column(2).flatten()
            bounds = bounds - bounds[0]
            first, last = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            for top, scan in ts.scans(batch.column(1), ts.NOT_SPACE, ts.IDENTITY):
                a, b = bounds[top], bounds[top + len(scan)]
                base = np.repeat(scan.bounds[:-1], np.diff(bounds[top : top + len(scan) + 1]))
                gone = ts.cover(len(scan.words), base + first[a:b], base + last[a:b])
                kept = kept_words(scan, ~gone)
                sums = np.zeros(len(gone) + 1, np.int64)
                np.cumsum(gone, out=sums[1:])
                columns = [batch.column(0).slice(top, len(scan)), pa.array(scan.counts().astype(np.int64)), pa.array(sums[scan.bounds[1:]] - sums[scan.bounds[:-1]]), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                if with_text:
                    columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(work, schema)
