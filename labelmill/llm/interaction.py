"""Audit of filters that act one after another: what each removes in every order.

A document's failures are a mask of five bits. The documents of a part are counted by mask, so at most
32 counts stand for a part of any size. Summed over subsets (the zeta transform of the subset
lattice), they give the documents that survive any set of filters: those whose mask lies in the set's
complement. A step of an order takes one subset to a neighbouring one, so what the step removes is a
difference of two survivor counts, and the same holds for documents with a label.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm import textscan as ts
from labelmill.session import materialize

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
SYMBOLS = b"#$%&*|"
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_CAPITALS, _CONTINUED = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))
_SYMBOL = re.compile(b"[" + re.escape(SYMBOLS) + b"]")


def text_mask(text: bytes) -> int:
    """Which of the filters A to D a text in UTF-8 fails, A as the lowest bit."""
    words, distinct, start = 0, set(), 0
    while start < len(text):
        # A long text is split in pieces that end between words.
        found = _SPACE.search(text, start + PIECE)
        end = found.start() if found else len(text)
        piece = text[start:end].split()
        words += len(piece)
        distinct.update(piece)
        start = end
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    return (
        (words < LEAST_WORDS)
        | (100 * len(distinct) < LEAST_DISTINCT_PERCENT * words) << 1
        | (100 * capitals > MOST_CAPITALS_PERCENT * points) << 2
        | (_SYMBOL.search(text) is not None) << 3
    )


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): the filters that each document fails, A to E from the lowest bit."""

    def work(batches):
        for batch in batches:
            body, offs = ts.binary_parts(batch.column(2))
            masks, digests = [], []
            for a, b in zip(offs.tolist(), offs[1:].tolist()):
                text = body[a:b].tobytes()
                masks.append(text_mask(text))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string"))
    # Texts are read once, and both sides of the join are tables, so that AQE can split the rows of a text with very many copies.
    checked = materialize(rows.mapInArrow(work, "doc_id long, part string, mask int, digest binary"), "checked")
    # Only texts that some larger doc_id repeats.
    firsts = checked.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("digest", "first_id")
    firsts = materialize(firsts, "firsts")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int")
    return checked.join(firsts, "digest", "left").select("doc_id", "part", (F.col("mask") + copy * 16).alias("mask"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """From counts by mask (first axis), how many survive each set of filters."""
    within = counts.copy()
    size = len(within)
    for bit in range(size.bit_length() - 1):
        has = np.flatnonzero(np.arange(size) >> bit & 1)
        within[has] += within[has ^ (1 << bit)]
    return within[::-1].copy()


def _steps() -> tuple[list[str], np.ndarray]:
    """Every order, and for each of its steps (step, filter, set before, set after)."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    rows = []
    for order in orders:
        before = 0
        for step, letter in enumerate(order, 1):
            bit = FILTERS.index(letter)
            rows.append((step, bit, before, before | 1 << bit))
            before |= 1 << bit
    return orders, np.array(rows)


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_orders(counts: DataFrame) -> DataFrame:
    """The audit's rows from one row a part: masks, and how many documents, good and toxic ones each has."""

    def work(batches):
        orders, plan = _steps()
        step, bit, before, after = plan.T
        named = [order for order in orders for _ in FILTERS]
        n = len(FILTERS)
        every = (1 << n) - 1
        for batch in batches:
            for part, masks, *measures in zip(*(c.to_pylist() for c in batch.columns)):
                # Counts are 64 bits wide; only the Shapley sums, 120 times as large, need Python's integers from 10^16 on.
                table = np.zeros((every + 1, 3), np.int64)
                table[masks] = np.array(measures, np.int64).T
                left = survivors(table)
                gone = left[before] - left[after]
                alone = left[0, 0] - left[1 << np.arange(n), 0]
                unique = left[every ^ (1 << np.arange(n)), 0] - left[every, 0]
                shapley = []
                for k in range(n):
                    without = [s for s in range(every + 1) if not s >> k & 1]
                    shapley.append(sum(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * int(left[s, 0] - left[s | 1 << k, 0]) for s in without))
                columns = [left[after, 0], gone[:, 0], alone[bit] - gone[:, 0], unique[bit], gone[:, 1], gone[:, 2], np.array(shapley, np.int64)[bit]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(step), pa.string()), pa.array(named), pa.array(step.astype(np.int32)), *(pa.array(c) for c in columns)], names=[x.split()[0] for x in AUDIT.split(", ")])

    return counts.select("part", "masks", "n", "good", "toxic").mapInArrow(work, AUDIT)


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (source), order of the filters and step, with what the step removes.

    Null text and null source are empty. A document is a row: rows of one doc_id count each, and neither is
    the other's earlier copy; a null doc_id is never earlier and never a copy, and has no label. Labels
    that repeat a doc_id count as good (quality 1) or toxic (toxic 1) if any row says so. A part always has
    its 600 rows; an empty table has no part. Other columns play no part. A text takes memory for its
    distinct words, besides its own bytes.
    """
    said = labels.select(F.col("doc_id").cast("long").alias("labelled"), "quality", "toxic").where("labelled IS NOT NULL").groupBy("labelled")
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    said = said.agg(one("quality"), one("toxic")).where("quality = 1 OR toxic = 1")
    rows = failure_masks(docs)
    labelled = rows.join(said, rows["doc_id"] == said["labelled"], "left")
    counts = labelled.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    cell = F.array_sort(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells")
    per_part = counts.groupBy("part").agg(cell)
    return audit_orders(per_part.select("part", *(F.col(f"cells.{c}").alias(name) for c, name in (("mask", "masks"), ("n", "n"), ("good", "good"), ("toxic", "toxic")))))
