"""Language identification by nearest centroids of TF-IDF character n-gram vectors.

A text is the bytes of its letters, lower-cased, words apart; its vector counts the two- and
three-byte sequences inside words and at their edges, hashed to 4096 places, as 1 + log(count)
times the inverse document frequency, at length 1. Each language has up to four centroids from
spherical k-means, so that kinds of text may differ; small clusters go, and rows that another
language's centroid claims are left out of a second fit, so that wrong labels do little harm.
The prediction is the language of the centroid of highest cosine.

A text is rejected if its distance from that centroid is beyond what training rows of the
language of such a length show, or if it has no letter. Long texts come near a centroid and short
ones do not, so the limit grows with the length. The model is fitted on a bounded sample of labelled
rows; only vectors of fixed size reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm import textscan as ts

#: Most labelled rows that a model is fitted on.
TRAINING_ROWS = 3000
PLACES = 4096
CENTROIDS = 4
SMALL_CLUSTER = 0.05
UNDETERMINED = "und"
#: Lengths are told apart by powers of two of their n-grams, up to this one.
OCTAVES = 14
#: The limit is this share of the least cosine of at least so many training rows.
MARGIN, LEAST_ROWS = 0.55, 50

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def _counted(data: np.ndarray, owner: np.ndarray | None, texts: int, begin: int, end: int) -> np.ndarray:
    """Counts of the n-grams that begin at places [begin, end) of the padded bytes, by text."""
    wide = data.astype(np.uint32)
    two = wide[:-1] << np.uint32(8) | wide[1:]
    three = two[:-1] << np.uint32(8) | wide[2:]
    inside = data != 0x20
    counts = np.zeros(texts * PLACES, np.int64)
    for code, size, ok in ((two, 2, (inside[:-1] | inside[1:])), (three, 3, inside[1:-1])):
        ok = ok.copy()
        ok[:begin], ok[end:] = False, False
        if owner is not None:
            ok &= owner[: len(code)] == owner[size - 1 :]
        place = ((code[ok] * np.uint32(2654435761) + np.uint32(size * 97)) >> np.uint32(32 - 12)).astype(np.int64)
        counts += np.bincount(place if owner is None else owner[: len(code)][ok] * PLACES + place, minlength=texts * PLACES)
    return counts.reshape(texts, PLACES)


def ngram_counts(body: np.ndarray, offsets: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """A row of hashed n-gram counts for each text of a run of texts. A long text is counted in pieces."""
    n = len(offsets) - 1
    # Each text gets a space before and after it, so no n-gram reaches into the next one.
    if n == 1 and len(body) > piece:
        data = np.full(len(body) + 2, 0x20, np.uint8)
        np.take(_LETTERS, body, out=data[1:-1])
        parts = (_counted(data[k : k + piece + 2], None, 1, 0, piece) for k in range(0, len(data) - 1, piece))
        return sum(parts, np.zeros((1, PLACES), np.int64))
    lengths = np.diff(offsets)
    data = np.full(len(body) + 2 * n, 0x20, np.uint8)
    at = np.arange(len(body)) + 2 * np.repeat(np.arange(n), lengths) + 1
    data[at] = _LETTERS[body]
    return _counted(data, np.repeat(np.arange(n), lengths + 2), n, 0, len(data))


def _runs(column: pa.Array, limit: int = 1 << 17):
    body, offs = ts.binary_parts(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column), first + 256)
        yield first, last, ngram_counts(body[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
        first = last


@dataclass
class LanguageModel:
    """Inverse document frequencies, centroids, and each centroid's language and least cosine by length."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log(np.maximum(counts, 1), dtype=np.float32)
        x += counts > 0
        x *= self.idf
        return _unit(x)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest centroid, and the cosine."""
        if not len(self.languages):
            return np.zeros(len(counts), np.int64), np.zeros(len(counts))
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(axis=1)
        return best, cosine[np.arange(len(best)), best].astype(np.float64)

    def near(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest centroid, the cosine, and whether it reaches the limit for the length."""
        best, cosine = self.nearest(counts)
        return best, cosine, cosine >= self.least[best, _octave(counts)] if len(self.languages) else np.zeros(len(best), bool)


def _octave(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1, dtype=np.int64), 1)).astype(np.int64), OCTAVES - 1)


def _limits(own: tuple[np.ndarray, np.ndarray], every: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Least cosine of a language for each octave, from (octaves, cosines) of its rows and of all languages' rows.

    An octave's limit lies under all rows of the octave before it, its own and longer ones. Where
    too few of the language's rows are as short or as long, those of all languages count; where even
    those are too few as long, the limit of the octave before; and where too few are as short, a
    quarter of the cosine that all but one in a thousand of the language's rows reach, which is
    also the least limit.
    """
    floor = np.quantile(own[1], 0.001) / 4 if len(own[1]) else 0.0
    out = []
    for k in range(OCTAVES):
        last = out[-1] if out else floor
        for octave, cosine in (own, every):
            some = cosine[octave >= k - 1]
            if min(len(some), (octave <= k).sum()) >= LEAST_ROWS:
                last = max(floor, MARGIN * some.min())
                break
        out.append(last)
    return np.array(out)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of spherical k-means from far-apart first rows, without small clusters."""
    first = [int((x @ _unit(x.sum(axis=0, keepdims=True)).T).argmax())]
    while len(first) < min(k, len(x)):
        first.append(int((x @ x[first].T).max(axis=1).argmin()))
    centres = x[first]
    for _ in range(20):
        near = (x @ centres.T).argmax(axis=1)
        moved = _unit(np.stack([x[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))]))
        if np.allclose(moved, centres, atol=1e-6):
            break
        centres = moved
    share = np.bincount((x @ centres.T).argmax(axis=1), minlength=len(centres)) / len(x)
    return centres[share >= min(SMALL_CLUSTER, share.max())]


def fit(languages: list[str], counts: np.ndarray, k: int = CENTROIDS) -> LanguageModel:
    """A model from labelled rows of n-gram counts."""
    full = counts.any(axis=1)
    labels, counts = np.array(languages, object)[full], counts[full]
    model = LanguageModel(np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1, np.zeros((0, PLACES), np.float32), [], np.zeros((0, OCTAVES)))
    x = model.vectors(counts)
    keep = np.ones(len(x), bool)
    for _ in range(2):
        parts = [(name, _clusters(x[keep & (labels == name)], k)) for name in sorted(set(labels)) if (keep & (labels == name)).any()]
        model.centroids = np.concatenate([c for _, c in parts]) if parts else model.centroids
        model.languages = [name for name, c in parts for _ in range(len(c))]
        if not parts:
            return model
        best, cosine = model.nearest(counts)
        keep = np.array(model.languages, object)[best] == labels
    names, octave = np.array(model.languages, object), _octave(counts)
    every = octave[keep], cosine[keep]
    limits = {name: _limits((octave[keep & (labels == name)], cosine[keep & (labels == name)]), every) for name in set(model.languages)}
    model.least = np.stack([limits[name] for name in names])
    return model


def fit_on(labelled: DataFrame, rows: int = TRAINING_ROWS) -> LanguageModel:
    """A model from rows (doc_id, text, lang), on about ``rows`` of them and at most twice as many:
    those whose hash is in the share of all hashes that gives so many. Rows without text or lang
    don't count; repeated rows count each; an empty table gives a model without languages. Long texts are
    counted whole; other columns play no part."""
    labelled = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    share = rows / max(1, labelled.count())
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 40)) < int(share * (1 << 40))
    some = labelled.where(drawn).limit(2 * rows) if share < 1 else labelled

    def work(batches):
        for batch in batches:
            for first, last, counts in _runs(batch.column(1)):
                row, place = np.nonzero(counts)
                each = np.bincount(row, minlength=last - first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), ts.list_array(place.astype(np.int32), each, pa.int32()), ts.list_array(counts[row, place].astype(np.int32), each, pa.int32())], names=["lang", "places", "counts"])

    got = some.select("lang", "text").mapInArrow(work, "lang string, places array<int>, counts array<int>").toArrow()
    counts = np.zeros((len(got), PLACES), np.uint16)
    for i, (places, values) in enumerate(zip(got["places"], got["counts"])):
        counts[i, places.values.to_numpy()] = np.minimum(values.values.to_numpy(), 65535)
    return fit(got["lang"].to_pylist(), counts)


def identify(docs: DataFrame, model: LanguageModel, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs (doc_id, text).

    score is the cosine with the nearest centroid, from 0 to 1. A null text, or one without a
    letter, is ``und`` with score 0 and rejected; else lang_pred is a learned language even if
    rejected by its distance. Repeated rows are given each; an empty table gives no rows; a
    model without languages says ``und``. Whole texts count, however long; other columns play no part.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), (F.lit(False) if held_out is None else held_out).alias("held_out"), text, F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("lettered"))

    def work(batches):
        for batch in batches:
            best, cosine, near = [], [], []
            for _, _, counts in _runs(batch.column(2)):
                for all_rows, some in zip((best, cosine, near), model.near(counts)):
                    all_rows.append(some)
            best, cosine, near = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (best, cosine, near))
            known = batch.column(3).to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
            names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
            rejected = ~known | ~near.astype(bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(known, np.clip(cosine, 0, 1), 0.0), pa.float64()), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs, all columns as they are, without the rows that are rejected: null texts, texts without a
    letter, and those too far from every centroid for their length. Repeated rows are judged each,
    long texts as a whole; columns may have any names; an empty table stays empty; a model without
    languages rejects all."""
    at = docs.columns.index("text")
    lettered = docs.where(F.col("text").cast("string").rlike("\\p{L}"))

    def work(batches):
        for batch in batches:
            keep = []
            for _, _, counts in _runs(batch.column(at).cast(pa.string())):
                keep.append(model.near(counts)[2])
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return lettered.mapInArrow(work, docs.schema)
