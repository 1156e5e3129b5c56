"""Audit of a language's sources: how far each one's term probabilities lie from another's.

A source's probability of a term is a fixed-point number of its count and total, so what two sources
contribute for a term depends on their two counts alone. Each pair of sources therefore gets a
histogram of the pairs of counts that occur, and the contribution is worked out once for each
of those, times its multiplicity. Tasks tally where both counts are over zero; where one or both are
zero follows from the sources' own histograms of counts, so such terms are never visited.

Terms are counted within tasks first, and a row of a kept term holds the counts of its sources: there are
fewer of those than rows of the result that a source gets. All arithmetic is on integers.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from labelmill.llm import textscan as ts
from labelmill.session import materialize

#: A term of a language counts if it stands in so many of its documents.
LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: A task hands on its counts when it holds so many terms, and its tallies at so many pairs of counts.
HELD_TERMS, HELD_PAIRS = 300_000, 1_000_000
PIECE = 1 << 20
_TERM, _BREAK = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
_FOLD = ts.ASCII_LOWER.tobytes()


def _pieces(text: bytes):
    """The text in pieces of about 1 MB that end between terms."""
    start = 0
    while start < len(text):
        found = _BREAK.search(text, start + PIECE)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed over all rows."""

    def work(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def flush():
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x] * len(terms), pa.string()) for x in (lang, source)] + [pa.array(terms, pa.binary()).cast(pa.string())] + [pa.array([c[t] for t in terms], pa.int64()) for c in (n, docs)],
                    names=["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for batch in batches:
            body, offs = ts.binary_parts(batch.column(2))
            for lang, source, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offs.tolist(), offs[1:].tolist()):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                own = set()
                for piece in _pieces(body[a:b].tobytes().translate(_FOLD)):
                    terms = _TERM.findall(piece)
                    n.update(terms)
                    own.update(terms)
                docs.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from flush()
        yield from flush()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("string"))
    counted = rows.mapInArrow(work, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def pair_tallies(terms: DataFrame) -> DataFrame:
    """(lang, a, b, na, nb, m): how many terms have these counts, both over zero, in sources a < b.

    ``terms`` has lang and cells, an array of (source, n) in order of source.
    """

    def work(batches):
        codes: dict[tuple, int] = {}
        keys, times, raw = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merge():
            nonlocal keys, times
            # Tallies so far weigh their count, new pairs one each.
            every = np.concatenate([keys, *raw])
            weight = np.concatenate([times, np.ones(len(every) - len(keys), np.int64)])
            raw.clear()
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            keys, times = every[first], np.add.reduceat(weight, first) if len(first) else weight

        def flush():
            nonlocal keys, times
            merge()
            lang, source, n = zip(*codes) if codes else ((), (), ())
            lang, source, n = pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(n, pa.int64())
            for k in range(0, len(keys), 1 << 17):
                one, other = (pa.array(x) for x in (keys[k : k + (1 << 17)] >> 32, keys[k : k + (1 << 17)] & 0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays([lang.take(one), source.take(one), source.take(other), n.take(one), n.take(other), pa.array(times[k : k + (1 << 17)])], names=["lang", "a", "b", "na", "nb", "m"])
            codes.clear()
            keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        for batch in batches:
            cells = batch.column(1)
            flat = cells.flatten()
            lengths = np.diff(cells.offsets.to_numpy())
            lang = batch.column(0).take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))
            code = np.array([codes.setdefault(x, len(codes)) for x in zip(lang.to_pylist(), flat.field(0).to_pylist(), flat.field(1).to_pylist())], np.int64)
            # Each cell meets those behind it in its row.
            partners = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code)) - 1
            total = np.concatenate([[0], np.cumsum(partners)])
            start = 0
            while start < len(code):
                end = max(start + 1, int(np.searchsorted(total, total[start] + HELD_PAIRS, "right")) - 1)
                one = np.repeat(np.arange(start, end), partners[start:end])
                other = one + 1 + np.arange(len(one)) - (total[one] - total[start])
                raw.append(code[one] << 32 | code[other])
                if sum(map(len, raw)) > HELD_PAIRS:
                    merge()
                start = end
            if len(keys) > HELD_PAIRS or len(codes) > HELD_PAIRS:
                yield from flush()
        yield from flush()

    return terms.select("lang", "cells").mapInArrow(work, "lang string, a string, b string, na long, nb long, m long")


def _div(a: Column, b: Column) -> Column:
    """Quotient of whole numbers, rounded down (none of ours is negative)."""
    return F.call_function("div", a, b)


def probability(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 size)), exact for any count."""
    wide = lambda c: c.cast("decimal(20,0)")
    return _div(wide(n + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + 2 * size)) + 1


def contribution(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so longs hold all of it."""
    return _div((p - q) * (p - q), p + q)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, lang_n, cells): a row for each kept term, with the count of each source that has it.

    cells is an array of (source, n) in order of source. The row of a term is as long as its language has
    sources, of which the result has a row for each pair.
    """
    cell = F.struct("source", "n")
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.array_sort(F.collect_list(cell)).alias("cells"))
    return by_term.where(F.col("docs") >= least_docs).drop("docs")


def source_groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, total, n_terms, lang_total, size): every group, also one without terms."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    langs = terms.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("size"))
    own = terms.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"))
    filled = named.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    return filled.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "n_terms", "lang_total", "size")))


def count_histograms(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, na, nb, m): how many kept terms have these counts in sources a < b, zeros included."""
    tallies = pair_tallies(terms)
    cell = lambda na, nb, m: F.struct(na.alias("na"), nb.alias("nb"), m.alias("m"))
    na, nb, m, zero = F.col("na"), F.col("nb"), F.col("m"), F.lit(0).cast("long")
    # A term with both counts over zero is none of those that the two margins count as (na, 0) and (0, nb).
    both = tallies.select("lang", "a", "b", F.inline(F.array(cell(na, nb, m), cell(na, zero, -m), cell(zero, nb, -m), cell(zero, zero, m))))
    margins = terms.select("lang", F.inline("cells")).groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    names = groups.where("size > 0").select("lang", F.col("source").alias("other"), "size", "n_terms")
    met = margins.join(names, "lang").where(F.col("source") != F.col("other"))
    earlier = F.col("source") < F.col("other")
    one = met.select(
        "lang",
        F.least("source", "other").alias("a"),
        F.greatest("source", "other").alias("b"),
        F.when(earlier, F.col("n")).otherwise(zero).alias("na"),
        F.when(earlier, zero).otherwise(F.col("n")).alias("nb"),
        "m",
    )
    neither = _pairs(groups).where("size > 0").select("lang", "a", "b", zero.alias("na"), zero.alias("nb"), (F.col("size") - F.col("terms_a") - F.col("terms_b")).alias("m"))
    return both.unionByName(one).unionByName(neither).groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("m")).where("m > 0")


def _pairs(groups: DataFrame) -> DataFrame:
    """Each two sources of a language once, a < b."""
    side = lambda x: groups.select("lang", F.col("source").alias(x), F.col("total").alias(f"total_{x}"), F.col("n_terms").alias(f"terms_{x}"), *(["size"] if x == "a" else []))
    return side("a").join(side("b"), "lang").where("a < b")


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language.

    In part ``pair`` the items are the language's other sources and the value is the divergence from each, all
    of them; in part ``term`` they are the ``top`` kept terms that the source has oftener than its language,
    with what they add to the divergence from it. Ranks count from 1 by value downwards, then item.

    Null lang, source and text are empty; each row is a document, also where a doc_id repeats;
    a language without kept terms has pairs of value 0, one with a single source has no pairs; an empty table
    gives no rows. Long texts are read in pieces. Other columns play no part, whatever their names.
    """
    terms = materialize(kept_terms(docs, least_docs), "terms")
    groups = materialize(source_groups(docs, terms), "groups")
    side = lambda x: probability(F.col(f"n{x}"), F.col(f"total_{x}"), F.col("size"))
    pairs = materialize(_pairs(groups), "pairs")
    met = count_histograms(terms, groups).join(pairs.select("lang", "a", "b", "total_a", "total_b", "size"), ["lang", "a", "b"])
    summed = met.select("lang", "a", "b", (contribution(side("a"), side("b")) * F.col("m")).alias("f")).groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))
    valued = materialize(pairs.select("lang", "a", "b").join(summed, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("f", F.lit(0))), "valued")
    way = lambda source, item: F.struct(F.col(source).alias("source"), F.col(item).alias("item"))
    both_ways = valued.select("lang", F.inline(F.array(way("a", "b"), way("b", "a"))), "value")
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_pairs = both_ways.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    cells = terms.select("lang", F.col("term").alias("item"), "lang_n", F.inline("cells")).join(groups, ["lang", "source"])
    p, q = probability(F.col("n"), F.col("total"), F.col("size")), probability(F.col("lang_n"), F.col("lang_total"), F.col("size"))
    over = cells.select("lang", "source", "item", p.alias("p"), q.alias("q")).where("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), "item", contribution(F.col("p"), F.col("q")).alias("value"))
    of_terms = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return of_pairs.unionByName(of_terms)
