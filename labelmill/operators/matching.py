"""Exclusive matching: each left row in order takes its best free right row.

Rows with equal candidate lists are one block: a list is stored once, however many rows have it. What a
sequential loop would give is found by deferred acceptance between blocks. In a round each block
hands out its list by itself: its smallest row takes the best right row, the next row the next one. A
right row keeps the smallest row that ever asked for it and so refuses all larger ones, whose
blocks hand out again in the next round, past what refuses them. Only blocks that lost something
take part in it. Rows below the smallest refused one are final; when what they leave is small enough, one
task runs the loop over it. So equal rows cost no rounds, and chains of dependent rows cost
few once the rest fits a task.

A block's right rows stream through a task in order of preference; only the ids of its left rows are held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.session import materialize

#: A rest of so many edges and left rows at most is matched by one task, which takes some 100 bytes for each.
SETTLED_EDGES = 1_000_000
BIGGEST = 2**63 - 1


def blocks_of(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, lists) of edges (left, right, score): left rows by block, and each block's candidates once.

    Lists are equal if their numbers of candidates and two 64-bit hashes over them are.
    """
    signed = edges.groupBy("left").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("right", "score")).alias("h1"), F.bit_xor(F.xxhash64("score", "right", F.lit(7))).alias("h2"))
    signed = materialize(signed, "signed")
    first = signed.groupBy("n", "h1", "h2").agg(F.min("left").alias("block"))
    members = materialize(signed.join(first, ["n", "h1", "h2"]).select("block", "left"), "members")
    lists = edges.join(members.where("left = block").select(F.col("left")), "left", "left_semi")
    return members, lists.select(F.col("left").alias("block"), "right", "score")


def _hand_out(members: DataFrame, lists: DataFrame) -> DataFrame:
    """(right, left, block): each block's members in order on its candidates in order of preference.

    ``lists`` has held, the smallest left row that asked for the right one: it refuses all larger ones.
    """

    def work(batches):
        from array import array

        import pyarrow as pa

        block, ids, k = None, array("q"), 0
        for batch in batches:
            right, left, of = [], [], []
            for b, candidate, i, held in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block:
                    block, ids, k = b, array("q"), 0
                if not candidate:
                    ids.append(i)
                elif k < len(ids) and ids[k] <= held:
                    right.append(i)
                    left.append(ids[k])
                    of.append(b)
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (right, left, of)], names=["right", "left", "block"])

    rows = members.select("block", F.lit(False).alias("candidate"), F.lit(0.0).alias("worse"), F.col("left").alias("id"), F.lit(0).cast("long").alias("held")).unionByName(
        lists.select("block", F.lit(True).alias("candidate"), (-F.col("score")).alias("worse"), F.col("right").alias("id"), F.coalesce("held", F.lit(BIGGEST)).alias("held"))
    )
    return rows.repartition("block").sortWithinPartitions("block", "candidate", "worse", "id").select("block", "candidate", "id", "held").mapInArrow(work, "right long, left long, block long")


def _settle(members: DataFrame, lists: DataFrame) -> DataFrame:
    """The sequential loop over a rest that is known to be small, by one task."""

    def work(batches):
        import pyarrow as pa

        candidates, taken, at = {}, set(), {}
        for batch in batches:
            right, left, of = [], [], []
            for member, b, i in zip(*(c.to_pylist() for c in batch.columns)):
                if not member:
                    candidates.setdefault(b, []).append(i)
                    continue
                own, k = candidates.get(b, ()), at.get(b, 0)
                while k < len(own) and own[k] in taken:
                    k += 1
                # What is taken stays so, for the block's later rows too.
                at[b] = k
                if k < len(own):
                    taken.add(own[k])
                    right.append(own[k])
                    left.append(i)
                    of.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (right, left, of)], names=["right", "left", "block"])

    rows = members.select(F.lit(True).alias("member"), "block", F.lit(0.0).alias("worse"), F.col("left").alias("id")).unionByName(lists.select(F.lit(False).alias("member"), "block", (-F.col("score")).alias("worse"), F.col("right").alias("id")))
    return rows.repartition(1).sortWithinPartitions("member", "worse", "id").select("member", "block", "id").mapInArrow(work, "right long, left long, block long")


def match_blocks(members: DataFrame, lists: DataFrame, settled: int = SETTLED_EDGES) -> DataFrame:
    """(left, right, score) of members (block, left) and lists (block, right, score), all ids longs.

    The pairs of the loop over left rows in ascending order, of which each takes the free right row of
    highest score, the smallest of equals. A left row is in one block; a block lists a right row once.
    """
    lists, members = materialize(lists.where("score IS NOT NULL"), "lists"), materialize(members, "members")
    if members.count() <= settled and lists.count() <= settled:
        return _scored(materialize(_settle(members, lists), "held"), lists)
    held = active = None
    while True:
        some, own = lists.withColumn("held", F.lit(None).cast("long")), members
        if active is not None:
            some, own = (df.join(active, "block", "left_semi") for df in (lists, members))
            some = some.join(held.select("right", F.col("left").alias("held")), "right", "left")
        asked = _hand_out(own, some)
        if active is not None:
            asked = asked.unionByName(held.join(active, "block", "left_anti").select("right", "left", "block"))
        asked = materialize(asked, "asked")
        held = materialize(asked.groupBy("right").agg(F.min_by(F.struct("left", "block"), "left").alias("x")).select("right", "x.*"), "held")
        lost = asked.join(held.select("right", F.col("left").alias("winner")), "right").where("left > winner")
        active = materialize(lost.groupBy("block").agg(F.min("left").alias("lost")), "lost")
        least = active.agg(F.min("lost")).first()[0]
        active = active.select("block")
        if least is None:
            return _scored(held, lists)
        # All below the smallest refused row keep what they have.
        final = held.where(F.col("left") < least)
        rest = members.where(F.col("left") >= least)
        if rest.count() <= settled:
            left_over = lists.join(rest.select("block").distinct(), "block", "left_semi").join(final.select("right"), "right", "left_anti")
            if left_over.limit(settled + 1).count() <= settled:
                return _scored(materialize(final.unionByName(_settle(rest, left_over)), "held"), lists)


def _scored(held: DataFrame, lists: DataFrame) -> DataFrame:
    return held.join(lists, ["block", "right"]).select("left", "right", "score")


#: A component of so many left rows, right rows and pairs of classes at most is matched by one task, which takes some 10 bytes for each right row.
SETTLED_IDS = 8_000_000


def _components(edges: DataFrame) -> DataFrame:
    """(block, group, part) of pairs of classes: the smallest block reachable, by passing on the smallest until none changes."""
    edges = materialize(edges.select("block", "group").distinct(), "class_pairs")
    part = edges.select("block").distinct().withColumn("part", F.col("block"))
    while True:
        of_group = edges.join(part, "block").groupBy("group").agg(F.min("part").alias("least"))
        new = edges.join(of_group, "group").groupBy("block").agg(F.min("least").alias("least"))
        # A block named by another one takes that one's part at once, so long chains take few rounds.
        jump = new.select(F.col("block").alias("least"), F.col("least").alias("further"))
        new = new.join(jump, "least", "left").select("block", F.least("least", "further").alias("least"))
        joined = materialize(part.join(new, "block").select("block", F.col("least").alias("part"), (F.col("least") < F.col("part")).alias("moved")), "parts")
        part = joined.select("block", "part")
        if joined.where("moved").isEmpty():
            return edges.join(part, "block")


def match_classes(members: DataFrame, rights: DataFrame, lists: DataFrame, settled: int = SETTLED_IDS) -> DataFrame:
    """(left, right, score) as ``match_blocks`` gives, of members (block, left), rights (group, right) and lists (block, group, score).

    Right rows that every block scores alike are one group, so a pair of classes is stored once, however many rows
    both have. Classes that no list connects don't touch one another: each connected part is matched by a
    task of its own, and one that is too large for that by ``match_blocks``.
    """
    lists = materialize(lists.where("score IS NOT NULL"), "lists")
    edges = materialize(_components(lists), "components")
    of_block, of_group = edges.select("block", "part").distinct(), edges.select("group", "part").distinct()
    rows = (
        lists.join(of_block, "block").select("part", F.lit(0).alias("kind"), F.col("block").alias("class"), (-F.col("score")).alias("worse"), F.col("group").alias("id"))
        .unionByName(rights.join(of_group, "group").select("part", F.lit(1).alias("kind"), F.col("group").alias("class"), F.lit(0.0).alias("worse"), F.col("right").alias("id")))
        .unionByName(members.join(of_block, "block").select("part", F.lit(2).alias("kind"), F.col("block").alias("class"), F.lit(0.0).alias("worse"), F.col("left").alias("id")))
    )
    rows = materialize(rows, "rows")
    large = materialize(rows.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > settled).select("part"), "large")

    def work(batches):
        import heapq
        from array import array

        import pyarrow as pa

        part, tiers, free, at, open_at = None, {}, {}, {}, {}
        for batch in batches:
            out = ([], [], [])
            for p, kind, of, worse, i in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, tiers, free, at, open_at = p, {}, {}, {}, {}
                if kind == 0:
                    own = tiers.setdefault(of, [])
                    if not own or own[-1][0] != worse:
                        own.append((worse, []))
                    own[-1][1].append((-BIGGEST, i))
                elif kind == 1:
                    free.setdefault(of, array("q")).append(i)
                else:
                    # Of the first score that has any the smallest free row; a heap's entry may be out of date, but never too large.
                    own, k = tiers[of], open_at.get(of, 0)
                    while k < len(own):
                        worse, heap = own[k]
                        while heap:
                            seen, g = heap[0]
                            ids, n = free.get(g, ()), at.get(g, 0)
                            if n == len(ids):
                                heapq.heappop(heap)
                            elif ids[n] != seen:
                                heapq.heapreplace(heap, (ids[n], g))
                            else:
                                break
                        if heap:
                            break
                        k += 1
                    open_at[of] = k
                    if k < len(own):
                        at[g] = n + 1
                        for x, v in zip(out, (i, seen, -worse)):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["left", "right", "score"])

    small = rows.join(F.broadcast(large), "part", "left_anti")
    found = small.repartition("part").sortWithinPartitions("part", "kind", F.when(F.col("kind") < 2, F.col("class")), "worse", "id").select("part", "kind", "class", "worse", "id").mapInArrow(work, "left long, right long, score double")
    if not large.isEmpty():
        some = rows.join(large, "part")
        pick = lambda kind, c, i: some.where(F.col("kind") == kind).select(F.col("class").alias(c), F.col("id").alias(i))
        wide = some.where("kind = 0").select(F.col("class").alias("block"), F.col("id").alias("group"), (-F.col("worse")).alias("score")).join(pick(1, "group", "right"), "group")
        found = found.unionByName(match_blocks(pick(2, "block", "left"), wide.select("block", "right", "score")))
    return found


#: A part of so many rows and makers' pairs at most is matched by one task, which takes some 50 bytes for each.
SETTLED_ROWS = 8_000_000


def match_composite(members: DataFrame, rights: DataFrame, names: DataFrame, makers: DataFrame, shares: tuple[float, float], least: float, settled: int = SETTLED_ROWS) -> DataFrame:
    """(left, right, score) as ``match_blocks`` gives, of members (a, m, left, open) and rights (b, k, right, open).

    A pair scores shares[0] * the sim of names (a, b, sim) + shares[1] * that of makers (m, k, sim), and counts
    from ``least`` on. Names that are not listed never pair; nor do makers, unless one is open: then their sim is 0.
    Neither pairs of rows nor pairs of names and makers at once are stored: names that no listed pair connects
    don't touch one another, so each connected part is one task's, whose left rows in order look through the
    names near their own from above, at the first free row of each maker, until no later name can score more.
    A right id that repeats is used once.
    """
    names, rights = materialize(names, "names"), materialize(rights, "rights")
    again = rights.groupBy("right").agg(F.count("*").alias("n")).where("n > 1").select("right", (-1 - F.monotonically_increasing_id()).alias("block"))
    again = materialize(again, "again")
    # An id that repeats connects its names; its block is below all others.
    ties = rights.join(again, "right").select("block", F.col("b").alias("group"))
    edges = materialize(_components(names.select(F.col("a").alias("block"), F.col("b").alias("group")).unionByName(ties)), "components")
    of_a, of_b = edges.select(F.col("block").alias("a"), "part").distinct(), edges.select(F.col("group").alias("b"), "part").distinct()
    owned = materialize(members.join(of_a, "a"), "owned")
    near = makers.groupBy("m").agg(F.collect_list(F.struct("k", "sim")).alias("near"))
    none = F.lit(None)
    row = lambda kind, x, y, i, sim, flag, some: [F.col("part"), F.lit(kind).alias("kind"), x.cast("long").alias("x"), y.cast("long").alias("y"), i.cast("long").alias("id"), sim.cast("double").alias("sim"), flag.cast("boolean").alias("flag"), some.cast("array<struct<k:bigint,sim:double>>").alias("near")]
    rows = (
        names.join(of_a, "a").select(row(0, F.col("a"), F.col("b"), none, F.col("sim"), none, none))
        .unionByName(rights.join(of_b, "b").select(row(1, F.col("b"), F.col("k"), F.col("right"), none, F.col("open"), none)))
        .unionByName(owned.select("part", "m").distinct().join(near, "m").select(row(2, F.col("m"), none, none, none, none, F.col("near"))))
        .unionByName(owned.select(row(3, F.col("a"), F.col("m"), F.col("left"), none, F.col("open"), none)))
    )
    rows = materialize(rows, "rows")
    large = materialize(rows.groupBy("part").agg(F.sum(1 + F.coalesce(F.size("near"), F.lit(0)).cast("long")).alias("n")).where(F.col("n") > settled).select("part"), "large")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        def prepared(read):
            """The part's names by a, makers by m, and of each b its makers, with where their rows begin and end and the first free id."""
            x, y, i, _, flag = (np.concatenate(c) for c in zip(*read[1])) if read[1] else [np.zeros(0, np.int64)] * 5
            order = np.lexsort((i, y, x))
            x, y, i, flag = x[order], y[order], i[order], flag[order].astype(bool)
            ks = np.unique(y)
            unlisted = np.full(len(ks), -1.0)
            unlisted[np.searchsorted(ks, y[flag])] = 0.0
            starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, np.int64)
            ends, first = np.r_[starts[1:], len(x)], x[starts]
            cut = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else np.zeros(0, np.int64)
            cells = {int(first[c]): (np.searchsorted(ks, y[starts[c:d]]), starts[c:d].copy(), ends[c:d], i[starts[c:d]]) for c, d in zip(cut, np.r_[cut[1:], len(first)])}
            x, y, _, sim, _ = (np.concatenate(c) for c in zip(*read[0])) if read[0] else [np.zeros(0, np.int64)] * 5
            listed = {}
            for n in np.lexsort((-sim, x)):
                if int(y[n]) in cells:
                    listed.setdefault(int(x[n]), []).append((float(sim[n]), cells[int(y[n])]))
            at = {}
            for m, k, sim in read[2]:
                place = np.minimum(np.searchsorted(ks, k), max(len(ks) - 1, 0))
                here = ks[place] == k if len(ks) else np.zeros(len(k), bool)
                at[m] = place[here], sim[here]
            return i, ks, unlisted, listed, at

        part, read, state, out_of, taken = None, None, None, set(), set()
        for batch in batches:
            part_of, kind_of = (batch.column(c).to_numpy() for c in (0, 1))
            x, y, ids = (batch.column(c).fill_null(0).to_numpy() for c in (2, 3, 4))
            sims, flags = batch.column(5).fill_null(0.0).to_numpy(), batch.column(6).fill_null(False).to_numpy(zero_copy_only=False)
            bounds = np.flatnonzero(np.r_[True, (part_of[1:] != part_of[:-1]) | (kind_of[1:] != kind_of[:-1]), True]) if len(part_of) else []
            out = ([], [], [])
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if part_of[lo] != part:
                    part, read, state, out_of, taken = part_of[lo], ([], [], []), None, set(), set()
                kind = kind_of[lo]
                if kind < 2:
                    read[kind].append(tuple(c[lo:hi].copy() for c in (x, y, ids, sims, flags)))
                    continue
                if kind == 2:
                    for n in range(lo, hi):
                        some = batch.column(7)[n].values
                        read[2].append((int(x[n]), some.field(0).to_numpy(), some.field(1).to_numpy()))
                    continue
                if state is None:
                    state, read = prepared(read), None
                right, ks, unlisted, listed, at = state
                for a, m, left, is_open in zip(x[lo:hi].tolist(), y[lo:hi].tolist(), ids[lo:hi].tolist(), flags[lo:hi].tolist()):
                    if (a, m) in out_of or a not in listed:
                        continue
                    alike = np.zeros(len(ks)) if is_open else unlisted.copy()
                    if m in at:
                        alike[at[m][0]] = at[m][1]
                    most = alike.max()
                    while True:
                        best, found, place = least, BIGGEST, None
                        for sim, cell in listed[a] if most >= 0 else ():
                            if sim * shares[0] + most * shares[1] < best:
                                break
                            own = alike[cell[0]]
                            score = np.where((own >= 0) & (cell[3] != BIGGEST), sim * shares[0] + own * shares[1], -1.0)
                            top = score.max()
                            if top < best:
                                continue
                            n = np.flatnonzero(score == top)
                            n = n[cell[3][n].argmin()]
                            if top > best or cell[3][n] < found:
                                best, found, place = top, cell[3][n], (cell, n)
                        if place is None:
                            # What is taken stays so, for later rows of this name and maker too.
                            out_of.add((a, m))
                            break
                        (_, now, ends, free), n = place
                        now[n] += 1
                        free[n] = right[now[n]] if now[n] < ends[n] else BIGGEST
                        if found not in taken:
                            taken.add(found)
                            for c, v in zip(out, (left, int(found), float(best))):
                                c.append(v)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["left", "right", "score"])

    small = rows.join(F.broadcast(large), "part", "left_anti")
    order = ["part", "kind", "id", "x", "y"]
    found = small.repartition("part").sortWithinPartitions(*order).select("part", "kind", "x", "y", "id", "sim", "flag", "near").mapInArrow(work, "left long, right long, score double")
    if not large.isEmpty():
        some = owned.join(large, "part").drop("part")
        blocks = materialize(some.groupBy("a", "m", "open").agg(F.min("left").alias("block")), "blocks")
        pairs = blocks.join(names.withColumnRenamed("sim", "name_sim"), "a").join(rights.withColumnRenamed("open", "right_open"), "b").join(makers, ["m", "k"], "left")
        score = F.col("name_sim") * shares[0] + F.coalesce("sim", F.when(F.col("open") | F.col("right_open"), F.lit(0.0))) * shares[1]
        lists = pairs.select("block", "right", score.alias("score")).where(F.col("score") >= least).groupBy("block", "right").agg(F.max("score").alias("score"))
        found = found.unionByName(match_blocks(some.join(blocks, ["a", "m"]).select("block", "left"), lists))
    return found


def exclusive_match(edges: DataFrame, left: str, right: str, score: str, settled: int = SETTLED_EDGES) -> DataFrame:
    """(left, right, score): sequential greedy matching; each left row in order takes its best free right row (ties: smallest).

    Ids are whole numbers. Of an edge that repeats the highest score counts; edges without a score or an id don't.
    """
    known = edges.select(F.col(left).cast("long").alias("left"), F.col(right).cast("long").alias("right"), F.col(score).cast("double").alias("score")).where("left IS NOT NULL AND right IS NOT NULL AND score IS NOT NULL")
    known = materialize(known.groupBy("left", "right").agg(F.max("score").alias("score")), "edges")
    # Few edges are matched by one task, for which each row may as well be its own block.
    members, lists = (known.select(F.col("left").alias("block"), "left").distinct(), known.withColumnRenamed("left", "block")) if known.count() <= settled else blocks_of(known)
    pairs = match_blocks(members, lists, settled)
    return pairs.select(F.col("left").cast(edges.schema[left].dataType).alias(left), F.col("right").cast(edges.schema[right].dataType).alias(right), F.col("score").cast(edges.schema[score].dataType).alias(score))
