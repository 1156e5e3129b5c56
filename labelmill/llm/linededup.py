"""Line dedup by pairwise alignment.

Documents overlap if they share a seed: a line long enough not to meet by chance (five words,
or ten characters of a script without spaces), or three lines in a row of which some are
shorter. Lines are counted without the empty ones. The earliest document that has a seed owns
it, and is the one that keeps it.

Seeds pair each later document with their owners, however many documents have them: a document meets
owners only, so a seed of a million copies makes a million pairs, not their square. Only what
a pair shares travels: the seeds of that owner in both documents, with the hashes of the lines
beside them. Of a seed that the owner repeats as many travel as the later document has, from the front.

A pair is aligned by patience diff: common head and tail, then the seeds that occur once on
either side, in their longest common ascending order, as fixed points, and the gaps between them
alike; a gap without such a seed gets an ordinary diff, by longest common subsequence. One
ascending alignment leaves blocks that moved or are repeated: what is left of the later document is
cut into runs that ascend in the owner, and each of them is aligned in its turn. Aligned seeds, and the
lines beside them that are alike too, are the common blocks that the later document loses;
nothing goes that wasn't aligned.

So no seed stays anywhere but in its owner, and a common block of three lines or more goes whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.llm import textscan as ts
from labelmill.session import materialize, release

SEED_WORDS = 5
#: So many bytes of non-ASCII characters make a line long too.
SEED_BYTES = 30
SEED_LINES = 3
#: A diff keeps so many bits at most, 32 MB.
LCS_BITS = 1 << 28
_IN_LINE = np.ones(256, bool)
_IN_LINE[0x0A] = False
_WORD = ts.NOT_SPACE


def _rising(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest part of points, sorted by their first place, whose second places ascend."""
    tops, piles, back = [], [], []
    for k, (_, y) in enumerate(points):
        at = bisect_left(tops, y)
        tops[at : at + 1] = [y]
        piles[at : at + 1] = [k]
        back.append(piles[at - 1] if at else -1)
    chain, k = [], piles[-1] if piles else -1
    while k >= 0:
        chain.append(points[k])
        k = back[k]
    return chain[::-1]


def _lcs_rows(a: list, b: list):
    """For each item of b the bits of a's places at which the longest common subsequence of a up
    to there and b up to the item does not grow (Hyyrö's bit-parallel form)."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for x in b:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & full
        yield v


def _lcs(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, ascending; b is split in halves while the bits of all rows would not fit."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) > LCS_BITS and b1 - b0 > 1:
            m, n = (b0 + b1) // 2, a1 - a0
            head, tail = _last_row(a[a0:a1], b[b0:m]), _last_row(a[a0:a1][::-1], b[m:b1][::-1])
            best = max(range(n + 1), key=lambda i: head[i] + tail[n - i])
            todo += [(a0, a0 + best, b0, m), (a0 + best, a1, m, b1)]
            continue
        rows = list(_lcs_rows(a[a0:a1], b[b0:b1]))
        i, j = a1 - a0, b1 - b0
        while i and j:
            if rows[j - 1] >> (i - 1) & 1:
                i -= 1
                continue
            j -= 1
            if not j or rows[j - 1] >> (i - 1) & 1:
                i -= 1
                found.append((a0 + i, b0 + j))
    return sorted(found)


def _last_row(a: list, b: list) -> list[int]:
    """Length of the longest common subsequence of b and each head of a."""
    for v in _lcs_rows(a, b):
        pass
    return [0, *accumulate(int(c == "0") for c in f"{v:0{len(a)}b}"[::-1])]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of equal items of two lists, ascending in both."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        places = {b[j]: j for j in range(b0, b1)}
        fixed = _rising([(i, places[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and in_b.get(a[i]) == 1])
        if not fixed:
            found += [(a0 + i, b0 + j) for i, j in _lcs(a[a0:a1], b[b0:b1])]
            continue
        ends = [(a0 - 1, b0 - 1), *fixed, (a1, b1)]
        found += fixed
        todo += [(i + 1, j, k + 1, m) for (i, k), (j, m) in zip(ends, ends[1:]) if i + 1 < j and k + 1 < m]
    return sorted(found)


def ascending_runs(early: list, late: list) -> list[tuple[list[int], list[int]]]:
    """Places in both lists, of runs of ``late`` that ascend in ``early``, in order; all items of late are in early.

    An item goes on with the run at its next place in early, and begins a new one if there is none.
    """
    places: dict = {}
    for i, x in enumerate(early):
        places.setdefault(x, []).append(i)
    runs, last = [], len(early)
    for j, x in enumerate(late):
        own = places[x]
        k = bisect_left(own, last + 1)
        if k == len(own):
            runs.append(([], []))
            k = 0
        last = own[k]
        runs[-1][0].append(last)
        runs[-1][1].append(j)
    return runs


def common_block(early: list[tuple], late: list[tuple]) -> set[int]:
    """Lines of the later document in aligned seeds, and beside them if they are alike too.

    Both lists are (place, size, hash, before, after) of the seeds that an owner shares with the
    document, in order of place; before and after are hashes of the lines beside, 0 for none.
    """
    theirs, mine = [x[2] for x in early], [x[2] for x in late]
    pairs = patience(theirs, mine)
    aligned = {j for _, j in pairs}
    rest = [j for j in range(len(mine)) if j not in aligned]
    for at, places in ascending_runs(theirs, [mine[j] for j in rest]):
        pairs += [(at[i], rest[places[k]]) for i, k in patience([theirs[i] for i in at], [mine[rest[k]] for k in places])]
    gone = set()
    for i, j in pairs:
        place, size, _, before, after = late[j]
        gone.update(range(place, place + size))
        if before and before == early[i][3]:
            gone.add(place - 1)
        if after and after == early[i][4]:
            gone.add(place + size)
    return gone


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def _long_lines(scan: ts.Scan, words: int) -> np.ndarray:
    """Which lines are seeds alone."""
    inside = _WORD[scan.data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[scan.starts] = inside[scan.starts]
    high = scan.data >= 0x80

    def count(flags):
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[scan.ends] - sums[scan.starts]

    return (count(first) >= words) | (count(high) >= SEED_BYTES)


SEED = "doc_id long, row long, place int, size byte, h1 long, h2 long, before long, after long"


def seeds(docs: DataFrame, seed_words: int = SEED_WORDS) -> DataFrame:
    """Every seed of every document: its first line's place among the lines that aren't empty, how many
    lines it has, a 128-bit hash, and hashes of the lines before and behind it (0: none)."""

    def work(batches):
        for batch in batches:
            for top, scan in ts.scans(batch.column(2), _IN_LINE, ts.IDENTITY):
                n = len(scan.words)
                doc = np.searchsorted(scan.bounds, np.arange(n), "right") - 1
                # Bounds repeat where a document has no line.
                alone = _long_lines(scan, seed_words)
                runs = scan.window_starts(SEED_LINES)
                some = np.zeros(n + 1, np.int64)
                np.cumsum(~alone, out=some[1:])
                runs = runs[some[runs + SEED_LINES] > some[runs]]
                at = np.concatenate([np.flatnonzero(alone), runs])
                size = np.repeat([1, SEED_LINES], [int(alone.sum()), len(runs)])
                h1, h2 = (np.concatenate([ts.mix(own[alone], 21), ts.gram_hashes(own, SEED_LINES, 22)[runs]]) for own in (scan.words, scan.second))
                own = np.concatenate([scan.words, np.zeros(1, np.uint64)])
                before = np.where(at > scan.bounds[doc[at]], own[at - 1], np.uint64(0))
                after = np.where(at + size < scan.bounds[doc[at] + 1], own[np.minimum(at + size, n)], np.uint64(0))
                pick = pa.array(top + doc[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), pa.array((at - scan.bounds[doc[at]]).astype(np.int32)), pa.array(size.astype(np.int8)), *(pa.array(ts.as_signed(x)) for x in (h1, h2, before, after))],
                    names=["doc_id", "row", "place", "size", "h1", "h2", "before", "after"],
                )

    return _keyed(docs).mapInArrow(work, SEED)


def common_lines(docs: DataFrame, seed_words: int = SEED_WORDS) -> DataFrame:
    """(doc_id, row, gone): places of the lines to delete from each document that loses any."""
    found = materialize(seeds(docs, seed_words), "seeds")
    held = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi")).where("owner < hi").select("h1", "h2", "owner")
    # A table of its own, so that AQE can split the rows of a hot seed in the join.
    held = materialize(held, "held")
    shared = materialize(found.join(held, ["h1", "h2"]), "shared")
    release(found, held)
    entry = F.struct("place", "size", "h1", "h2", "before", "after").alias("entry")
    lost = shared.where("doc_id > owner")
    late = lost.select("doc_id", "row", "owner", F.lit(False).alias("early"), entry)
    asked = lost.groupBy("doc_id", "row", "owner", "h1", "h2").agg(F.count_distinct("place").alias("times"))
    # Rows of one doc_id may differ in text; the owner is the one of them with the smallest hash that has the seed.
    own = shared.where("doc_id = owner")
    first = own.groupBy("owner", "h1", "h2").agg(F.min("row").alias("row"))
    own = own.join(first, ["owner", "h1", "h2", "row"]).dropDuplicates(["owner", "h1", "h2", "place"])
    own = own.withColumn("k", F.row_number().over(Window.partitionBy("owner", "h1", "h2").orderBy("place")))
    owned = materialize(own.select(F.col("owner").alias("early_id"), F.col("h1").alias("e1"), F.col("h2").alias("e2"), "k", entry), "early")
    early = asked.join(owned, (F.col("owner") == F.col("early_id")) & (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2"))).where("k <= times").select("doc_id", "row", "owner", F.lit(True).alias("early"), "entry")
    sides = [F.array_sort(F.collect_set(F.when(of, F.col("entry")))).alias(name) for of, name in ((F.col("early"), "theirs"), (~F.col("early"), "mine"))]
    # As sets: a repeated row (same doc_id and text) has each of its seeds once.
    pairs = late.unionByName(early).groupBy("doc_id", "row", "owner").agg(*sides).select("doc_id", "row", "theirs", "mine")

    def work(batches):
        for batch in batches:
            gone = []
            for entries in zip(*(_entries(batch.column(k)) for k in (2, 3))):
                gone.append(sorted(common_block(*entries)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "row", "gone"])

    aligned = pairs.mapInArrow(work, "doc_id long, row long, gone array<int>").select("doc_id", "row", F.explode("gone").alias("line"))
    gone = materialize(aligned.groupBy("doc_id", "row").agg(F.collect_set("line").alias("gone")), "gone")
    release(shared, owned)
    return gone


def _entries(column: pa.ListArray) -> list[list[tuple]]:
    flat = column.flatten()
    place, size, h1, h2, before, after = (flat.field(k).to_pylist() for k in range(6))
    rows = list(zip(place, size, zip(h1, h2), before, after))
    bounds = (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
    return [rows[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def without_lines(text: str, gone: set[int]) -> str:
    """The text without these of its lines, counted without empty ones, and their line ends."""
    kept, k = [], -1
    for line in text.split("\n"):
        k += line != ""
        if not line or k not in gone:
            kept.append(line)
    return "\n".join(kept)


def dedup_lines(docs: DataFrame, seed_words: int = SEED_WORDS, drop_emptied: bool = True) -> DataFrame:
    """docs, all columns as they are, with the blocks deleted from text that an earlier document has.

    A document of which nothing but white space stays goes (with drop_emptied false it stays,
    with what is left); an input text that was so before stays. The rest of a text, with its
    line ends, doesn't change; n_chars, if there, is set to the new length where text changed.
    Null and empty texts stay as they are and match nothing; a null doc_id is never earlier and
    loses nothing; rows of one doc_id lose nothing to each other, and a repeated row is aligned as
    one and cut alike; an empty table stays empty. A pair of documents is aligned by one task, which
    holds the seeds that they share.
    """
    gone = common_lines(docs, seed_words)
    match = (F.col("d.doc_id").cast("long") == F.col("g.doc_id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("g.row"))
    joined = docs.alias("d").join(gone.alias("g"), match, "left")
    at, n = docs.columns.index("text"), len(docs.columns)
    # By place: a column of docs may have any name.
    columns = [F.col("d.text").cast("string") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]
    rows = joined.select(*(c.alias(f"c{k}") for k, c in enumerate(columns)), F.col("g.gone").alias(f"c{n}"))

    def work(batches):
        for batch in batches:
            texts, touched = batch.column(at), batch.column(n).is_valid()
            cut = [without_lines(t.as_py(), set(g.as_py())) if g.is_valid else None for t, g in zip(texts, batch.column(n))] if touched.true_count else None
            columns = [batch.column(k) for k in range(n)]
            if cut is not None:
                columns[at] = pc.if_else(touched, pa.array(cut, pa.string()), texts.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, touched], names=[f"c{k}" for k in range(n + 1)])

    schema = ", ".join(f"c{k} {f.dataType.simpleString() if k != at else 'string'}" for k, f in enumerate(docs.schema)) + f", c{n} boolean"
    done = rows.mapInArrow(work, schema)
    touched, text = F.col(f"c{n}"), F.col(f"c{at}")
    if drop_emptied:
        done = done.where(~touched | text.rlike("[^\\s]"))
    out = {c: F.col(f"c{k}") for k, c in enumerate(docs.columns)}
    if "n_chars" in out:
        out["n_chars"] = F.when(touched, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return done.select(*(c.alias(name) for name, c in out.items()))
