"""Toxicity by compression distance with two Zstandard dictionaries.

One dictionary is trained on the words of ordinary documents. The toxic one is that same base
and, nearer to the window, a dictionary trained on what marks toxic documents: words that at
least one in a hundred of them holds, at ten times the rate of ordinary ones. A window is one
word of a text between two fixed runs that both dictionaries hold, so even a short word is
coded by matches. Two lengths say what a window is: how many bytes less it takes with the
toxic dictionary, its gain, and how many it still takes there.

Thresholds are calibrated on labelled documents that trained neither dictionary: each pair of
lengths counts as the logarithm of its rate in toxic over ordinary documents, pairs that don't
favour toxic documents clearly count nothing, and a logistic curve turns a document's sum, its
sum by length and its length into a score. All of this is fitted on a bounded sample of
labelled rows.

The plain form of the method, dictionaries trained on whole toxic and ordinary texts and windows
of several words, does not tell the two apart where a toxic text differs in a few words only:
what a dictionary happens to hold of a window's other words changes its length more than those
do. Hence the shared base, and windows of one word.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm import textscan as ts

#: Most labelled rows of each class that a model is fitted on.
TOXIC_ROWS = 3000
ORDINARY_ROWS = 6000
#: Most bytes of the texts of those rows, half for each class.
TRAINING_BYTES = 256 << 20
BASE_BYTES = 110_000
TOXIC_BYTES = 2048
LEAST_SHARE = 0.01
LEAST_RATIO = 10
LEAST_EVIDENCE = 0.7
WORD_BYTES = 32
CACHE_WORDS = 400_000

BEFORE = b"<<the run of text that stands before every window, in both dictionaries>>"
AFTER = b"<<and the run of text that stands after every window>>"
_SPACES = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))


def windows(text: bytes) -> set[bytes]:
    """The distinct words of a text, lower-cased, with a space in front; long ones in parts."""
    found = set()
    for word in set(text.lower().translate(_SPACES).split()):
        for k in range(0, len(word), WORD_BYTES):
            found.add(b" " + word[k : k + WORD_BYTES])
    return found


def _trained(samples: list[bytes], size: int, fallback: bytes) -> bytes:
    """The content of a dictionary trained on samples, without its tables at the front."""
    try:
        data = zstandard.train_dictionary(size + 512, samples, level=3).as_bytes()
    except (zstandard.ZstdError, MemoryError):
        return fallback[-size:]
    return data[-size:]


@dataclass
class ToxicityModel:
    """Two dictionaries, the evidence of each gain, and the curve from evidence to score."""

    ordinary: bytes = b""
    toxic: bytes = b""
    evidence: dict[tuple[int, int], float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, -2.0]))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def start(self) -> None:
        """Prepare the compressors; called in each task."""
        settings = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        self._sizes = []
        for content in (self.ordinary, self.ordinary + self.toxic):
            dictionary = zstandard.ZstdCompressionDict(content + AFTER + BEFORE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=settings)
            self._sizes.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings))
        self._known: dict[bytes, tuple[int, int]] = {}
        self._least = len(self._sizes[1].compress(BEFORE + AFTER))

    def lengths(self, window: bytes) -> tuple[int, int]:
        """Bytes that the toxic dictionary saves on a window, and bytes that it still takes."""
        known = self._known.get(window)
        if known is None:
            if len(self._known) >= CACHE_WORDS:
                self._known.clear()
            data = BEFORE + window + AFTER
            toxic = len(self._sizes[1].compress(data))
            known = self._known[window] = (min(len(self._sizes[0].compress(data)) - toxic, 8), min(max(toxic - self._least, 0), 12))
        return known

    def features(self, found: set[bytes]) -> tuple[float, float, float, float]:
        """Sum of the evidence, sum by length, length, and 1."""
        evidence = self.evidence
        total = sum(evidence[x] for x in map(self.lengths, found) if x in evidence)
        return total, 100 * total / (len(found) + 50), math.log1p(len(found)), 1.0

    def score(self, text: bytes) -> float:
        x = float(np.dot(self.weights, self.features(windows(text))))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def _logistic(design: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights by Newton's method, with a little ridge."""
    beta, ridge = np.zeros(design.shape[1]), 1e-2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + np.eye(len(beta)) * ridge, design.T @ (weight * (p - y)) + ridge * beta)
        beta = beta - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(rows: list[tuple[set[bytes], int, float]]) -> ToxicityModel:
    """A model from (windows, label, weight) of documents, in an order that says nothing of the label."""
    model = ToxicityModel()
    sides = [[(w, y, k) for i, (w, y, k) in enumerate(rows) if (i % 3 == 2) == late] for late in (False, True)]
    toxic, ordinary = ([w for w, y, _ in sides[0] if y == label] for label in (1, 0))
    if not toxic or not ordinary:
        share = sum(y * k for _, y, k in rows) / max(1e-9, sum(k for _, _, k in rows)) if rows else 0.0
        model.weights = np.array([0.0, 0.0, 0.0, math.log(max(share, 1e-3) / max(1 - share, 1e-3))])
        return model
    in_toxic, in_ordinary = Counter(w for s in toxic for w in s), Counter(w for s in ordinary for w in s)
    need = max(3, LEAST_SHARE * len(toxic))
    marks = {w for w, c in in_toxic.items() if c >= need and c / len(toxic) >= LEAST_RATIO * (in_ordinary[w] + 1) / len(ordinary)}
    rng = random.Random(0)
    samples = [b"".join(rng.sample(sorted(s & marks), len(s & marks))) for s in toxic for _ in range(3) if s & marks]
    by_share = sorted(marks, key=lambda w: (in_toxic[w], w))
    model.toxic = _trained(samples, min(TOXIC_BYTES, max(256, 2 * sum(map(len, marks)))), b"".join(by_share))
    common = sorted(in_ordinary, key=lambda w: (in_ordinary[w], w))
    model.ordinary = _trained([b"".join(sorted(s)) for s in ordinary], BASE_BYTES, b"".join(common))
    model.start()
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    calibration = sides[1] or sides[0]
    for found, label, _ in calibration:
        counts[label].update(map(model.lengths, found))
    total = [sum(c.values()) + 1 for c in counts]
    rates = {x: math.log((c + 0.5) / total[1] * total[0] / (counts[0][x] + 0.5)) for x, c in counts[1].items() if x[0] > 0 and c >= 3}
    model.evidence = {x: min(v, 6.0) for x, v in rates.items() if v >= LEAST_EVIDENCE}
    design = np.array([model.features(w) for w, _, _ in calibration])
    model.weights = _logistic(design, np.array([y for _, y, _ in calibration], float), np.array([k for _, _, k in calibration]))
    return model


def _within(rows: list[tuple], most: int) -> list[int]:
    """Ids of (id, toxic, bytes) rows, in order, while each class stays within half of the bytes."""
    used, out = Counter(), []
    for key, label, size in rows:
        used[label] += size
        if used[label] <= most // 2:
            out.append(key)
    return out


def fit_on(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, training_bytes: int = TRAINING_BYTES) -> ToxicityModel:
    """A model from docs (doc_id, text) that labels (doc_id, toxic) marks 1 or 0.

    At most so many labels of each class are used, those of least hash of doc_id, and of them
    those whose texts together have at most so many bytes; the full counts of both classes are
    weighed in. Of rows that repeat a doc_id one is learnt from, that of the smallest hash. Null labels and
    ids don't count; no labels, and an empty table, give a model that scores all alike. A long text is
    learnt from whole or not at all; other columns play no part.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id IS NOT NULL AND toxic IN (0, 1)").distinct()
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("label_id", F.lit("toxicity"))
    drawn = [known.where(F.col("toxic") == label).orderBy(order, "label_id").limit(most) for label, most in ((1, toxic_rows), (0, ordinary_rows))]
    # At most toxic_rows + ordinary_rows pairs of numbers: small enough to broadcast at any scale.
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(chosen, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic", F.xxhash64("text").alias("hash"))
    # Of rows that repeat an id that of the smallest hash is learnt from, so that there are no more than labels.
    one = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))).alias("x"))
    sizes = one.select("doc_id", "toxic", "x.bytes", F.xxhash64("doc_id", F.lit("toxicity")), "x.hash").collect()
    small = set(_within([tuple(r)[:3] for r in sorted(sizes, key=lambda r: (r[3], r[0], r[1], r[2]))], training_bytes))
    learnt = docs.sparkSession.createDataFrame([(r[0], r[1], r[4]) for r in sizes if r[0] in small], "learnt_id long, learnt_toxic int, learnt_hash long")
    same = (F.col("doc_id") == F.col("learnt_id")) & (F.col("toxic") == F.col("learnt_toxic")) & (F.col("hash") == F.col("learnt_hash"))
    rows = rows.join(F.broadcast(learnt), same, "left_semi").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")

    def work(batches):
        for batch in batches:
            body, offs = ts.binary_parts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([b"\0".join(sorted(windows(body[a:b].tobytes()))) for a, b in zip(offs[:-1], offs[1:])], pa.binary())], names=["doc_id", "toxic", "words"])

    got = rows.mapInArrow(work, "doc_id long, toxic int, words binary").collect()
    used = Counter(r[1] for r in got)
    found = [(set(bytes(r[2]).split(b"\0")) - {b""}, r[1], counts[r[1]] / used[r[1]]) for r in sorted(got, key=lambda r: (r[0], r[1], bytes(r[2])))]
    random.Random(1).shuffle(found)
    return fit(found)


def toxicity(docs: DataFrame, model: ToxicityModel, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) for each row of docs (doc_id, text).

    Null and empty texts have no windows and get the score of no evidence; whole texts count, however
    long; repeated rows are scored each; an empty table gives no rows. held_out is passed through;
    other columns play no part, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col("text").cast("string"))

    def work(batches):
        model.start()
        for batch in batches:
            body, offs = ts.binary_parts(batch.column(2))
            scores = np.array([model.score(body[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")
