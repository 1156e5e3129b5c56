"""MinHash near-duplicate detection with odd sketches.

Each document is the set of its distinct word shingles. 128 MinHash samples of the set, by
permutations of their own, make 32 band keys of four samples, which find candidates. 2048 more
samples, the least hash in each of 2048 bins of one permutation, are folded into an odd sketch
of 2048 bits: every sample flips the bit that its hash names. The population count of the XOR
of two sketches tells how many samples differ, and so estimates a high similarity closely.
Pairs that differ in more bits than a pair at the threshold does, by 4.5 standard deviations,
are left before any text moves. What remains is decided on the full sets.

No group of alike documents is expanded into pairs. Documents with equal sets form a class,
seen through its smallest id. In each bucket of equal band keys one member is the hub; every
document is compared with the hubs that it shares most buckets with, and links join components.
A bucket whose members are in one component needs nothing more. Where some remain apart, other
hubs are taken, and at last all pairs of members of different components, with each large
bucket dealt out in blocks of which each two meet once. So each pair of different components that share a bucket is
compared on sketches and, if alike, on sets.

A link of exactly the threshold 0.75 shares no band with a probability of 5e-6.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm import textscan as ts
from labelmill.llm.components import connected_components
from labelmill.operators.dedup import first_per_group
from labelmill.session import materialize, release

SHINGLE_WORDS = 5
SAMPLES = 128
BAND_ROWS = 4
BINS = 2048
SKETCH_BITS = 2048
DEVIATIONS = 4.5
STAR_ROUNDS = 2
HUBS = 6
BLOCK = 256
#: 8 MB.
FILTER_BITS = 1 << 26

_rng = np.random.Generator(np.random.PCG64(7))
FACTORS = (_rng.integers(0, 2**31, SAMPLES, dtype=np.int64) * 2 + 1).astype(np.uint32)
SHIFTS = _rng.integers(0, 2**32, SAMPLES, dtype=np.int64).astype(np.uint32)


def shingle_sets(scan: ts.Scan, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    at, hashes = scan.windows(size, salt=size)
    bounds = np.searchsorted(at, scan.bounds)
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    counts = scan.counts()
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        sets[i] = ts.gram_hashes(scan.words[scan.bounds[i] : scan.bounds[i + 1]], int(counts[i]), salt=int(counts[i]))
    return sets


def min_hashes(items: np.ndarray) -> np.ndarray:
    """128 samples of a set that has items."""
    low = (items >> np.uint64(32)).astype(np.uint32)
    least = None
    for k in range(0, len(low), 4096):
        part = (low[k : k + 4096, None] * FACTORS[None, :] + SHIFTS[None, :]).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One long for each band of each row of samples."""
    n = len(samples)
    bands = samples.reshape(n, SAMPLES // BAND_ROWS, BAND_ROWS).astype(np.uint64)
    key = np.zeros(bands.shape[:2], np.uint64)
    for k in range(BAND_ROWS):
        key = ts.mix(key ^ bands[:, :, k], salt=k + 1)
    return ts.mix(key + np.arange(SAMPLES // BAND_ROWS, dtype=np.uint64)[None, :])


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps of sorted sets: the least item of each bin flips one bit."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    items = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    bins = (items // np.uint64(2**64 // BINS)).astype(np.int64) + owner * BINS
    least = np.ones(len(items), bool)
    least[1:] = bins[1:] != bins[:-1]
    places = (ts.mix(items[least], salt=99) % np.uint64(SKETCH_BITS)).astype(np.int64) + owner[least] * SKETCH_BITS
    flips = np.bincount(places, minlength=n * SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.uint64)


SIGNED = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("n_shingles", T.LongType()), ("h1", T.LongType()), ("h2", T.LongType()), ("bands", T.ArrayType(T.LongType())), ("sketch", T.ArrayType(T.LongType())))])


def signatures(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """Set size, a 128-bit hash of the set, band keys and odd sketch of every document."""

    def work(batches):
        for batch in batches:
            for first, scan in ts.scans(batch.column(1), ts.NOT_SPACE, ts.ASCII_LOWER):
                sets = shingle_sets(scan, size)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                samples = np.stack([min_hashes(sets[i]) for i in full]) if len(full) else np.zeros((0, SAMPLES), np.uint32)
                h = np.array([[ts.mix(s, 1).sum(), ts.mix(s, 2).sum()] for s in sets], np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)),
                        pa.array(n),
                        pa.array(ts.as_signed(np.ascontiguousarray(h[:, 0]))),
                        pa.array(ts.as_signed(np.ascontiguousarray(h[:, 1]))),
                        ts.list_array(ts.as_signed(band_keys(samples).ravel()), (n > 0) * (SAMPLES // BAND_ROWS), pa.int64()),
                        ts.list_array(ts.as_signed(odd_sketches([sets[i] for i in full]).ravel()), (n > 0) * (SKETCH_BITS // 64), pa.int64()),
                    ],
                    names=SIGNED.names,
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, SIGNED)


def sketch_distance(a: str, b: str) -> Column:
    """Bits in which two odd sketches differ."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(1, SKETCH_BITS // 64)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def sketch_limit(n_a, n_b, threshold: int, exp=F.exp, sqrt=F.sqrt, greatest=F.greatest, least=lambda x, y: F.least(x, F.lit(y))):
    """Most bits in which the sketches of two sets at the threshold differ, by DEVIATIONS; sizes are columns, or arrays with numpy's functions.

    Of the bins that the union fills, the share 1 - J has its least item in one set only. Such
    a bin flips one bit, and one more if the other set has a later item in it.
    """
    j = threshold / 100
    union = (n_a + n_b) / (1 + j)
    bins = BINS * (1 - exp(-union / BINS))
    second = 1 - exp(-greatest(n_a, n_b) / BINS)
    flips = (1 - j) * bins * (1 + second)
    spread = bins * j * (1 - j) * (1 - bins / (union + 1)) * (1 + second) ** 2 + (1 - j) * bins * second * (1 - second)
    slope = exp(-2 * flips / SKETCH_BITS)
    return SKETCH_BITS / 2 * (1 - slope) + DEVIATIONS * sqrt(slope**2 * spread + least(2 * flips**2 / SKETCH_BITS, SKETCH_BITS / 4)) + 3


def alike(a: str, b: str, n_a: str, n_b: str, threshold: int) -> Column:
    """Two sketches, of sets of these sizes, may be of a pair that reaches the threshold."""
    sizes = (100 * F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b))
    return sizes & (sketch_distance(a, b) <= sketch_limit(F.col(n_a).cast("double"), F.col(n_b).cast("double"), threshold))


def alike_places(p: np.ndarray, q: np.ndarray, sketches: np.ndarray, n: np.ndarray, threshold: int) -> np.ndarray:
    """Which of the places p and q in arrays of sketches and set sizes are ``alike``."""
    few, many = np.minimum(n[p], n[q]), np.maximum(n[p], n[q])
    found = np.flatnonzero(100 * few >= threshold * many)
    distance = np.bitwise_count(sketches[p[found]] ^ sketches[q[found]]).sum(axis=1, dtype=np.int64)
    limit = sketch_limit(few[found].astype(float), many[found].astype(float), threshold, np.exp, np.sqrt, np.maximum, np.minimum)
    return found[distance <= limit]


def _places(c: Column) -> tuple[Column, Column]:
    """Which number of the bitmap an id's bit stands in, and the bit."""
    place = F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    return F.shiftright(place, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def among(ids: DataFrame) -> tuple[Callable[[str], Column], Broadcast]:
    """What tells of a column of longs whether it is among ids (one column, id) or few others, and what its tasks look ids up in.

    Ids make a bitmap by hash, of FILTER_BITS whatever their number: it reaches the driver as at most a 64th of
    that in numbers, and each executor as one broadcast. With very many ids it lets more through. So rows that
    a join would drop don't leave the scan, however large both of its sides are.
    """
    word, bit = _places(F.col("id"))
    found = ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    sent = ids.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def held(word: pd.Series, bit: pd.Series) -> pd.Series:
        return pd.Series((sent.value[word.to_numpy()] & bit.to_numpy()) != 0)

    return lambda c: held(*_places(F.col(c))), sent


def sketched(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that may reach the threshold by their sketches, as a table; other sketches stay where they are."""
    pairs = materialize(pairs, "compared")
    held, sent = among(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    wanted = sketches.where(held("rep"))
    sides = [wanted.select(F.col("rep").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab"]
    near = materialize(pairs.join(sides[0], "a").join(sides[1], "b").where(alike("sketch_a", "sketch_b", "n_a", "n_b", threshold)).select("a", "b"), "near")
    sent.destroy()
    release(pairs)
    return near


def texts_of(ids: DataFrame, docs: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(rep, text) of the docs whose doc_id is among ids (rep), and of few others; and what its tasks look ids up in."""
    held, sent = among(ids.select(F.col("rep").alias("id")))
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    return texts.where(held("rep")), sent


def verified(near: DataFrame, docs: DataFrame, threshold: int, size: int) -> DataFrame:
    """The pairs (a, b) of a table, which is released, whose shingle sets reach the threshold, a percentage.

    Partners b of one a are dealt out in blocks; in each block the text of a comes first and
    then those of its partners, so a text that many are compared with moves once for a block.
    """
    many = materialize(near.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "partners")
    pairs = materialize(near.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b"), "pairs")
    # The hub's row has no b and so comes first; one join brings the texts of both kinds of row.
    hubs = pairs.select(F.col("a").alias("rep"), "a", "block", F.lit(None).cast("long").alias("b")).distinct()
    wanted = hubs.unionByName(pairs.select(F.col("b").alias("rep"), "a", "block", "b"))
    texts, sent = texts_of(wanted, docs)
    rows = wanted.join(texts, "rep").select("a", "block", "b", "text").repartition("a", "block").sortWithinPartitions("a", "block", "b")

    def work(batches):
        # The sets of a; repeated rows of one doc_id may have several texts.
        mine, fresh = [], True
        for batch in batches:
            keep, partner = np.zeros(batch.num_rows, bool), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            for first, scan in ts.scans(batch.column(3), ts.NOT_SPACE, ts.ASCII_LOWER):
                for k, items in enumerate(shingle_sets(scan, size), first):
                    if not partner[k]:
                        mine = [items] if fresh else [*mine, items]
                    for other in mine if partner[k] else ():
                        together = len(np.intersect1d(other, items, assume_unique=True))
                        keep[k] |= together > 0 and 100 * together >= threshold * (len(other) + len(items) - together)
                    fresh = partner[k]
            yield batch.select([0, 2]).filter(pa.array(keep))

    links = materialize(rows.mapInArrow(work, "a long, b long"), "links")
    sent.destroy()
    release(near, many, pairs)
    return links


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, component) after linking components; a rep without a label is its own component."""
    ends = [labels.select(F.col("rep").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    edges = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    roots = connected_components(edges)
    old = labels.join(roots, labels["component"] == roots["node"], "left").select("rep", F.coalesce(roots["component"], labels["component"]).alias("component"))
    new = roots.select(F.col("node").alias("rep"), "component").join(labels.select("rep"), "rep", "left_anti")
    return materialize(old.unionByName(new), "labels")


def with_hubs(rows: DataFrame, rank: Column, ranked: DataFrame | None = None) -> DataFrame:
    """(key, rep, component, size, hub, hub_component) of the rows (key, rep, component) of buckets that hold
    more than one component, as a table.

    A bucket's hub is of its largest component, its member of the least rank (a column of ``ranked``, if given). One
    aggregate by bucket says which are left, how large they are and what their hub is.
    """
    parts = (rows if ranked is None else ranked).groupBy("key", "component").agg(F.count("*").alias("members"), F.min(F.struct(rank.alias("rank"), "rep")).alias("first"))
    largest = F.struct("members", -F.col("first.rank"), "component", F.col("first.rep").alias("hub"))
    tops = parts.groupBy("key").agg(F.max(largest).alias("top"), F.sum("members").alias("size"), F.count("*").alias("components")).where("components > 1")
    # A table of its own, so that AQE can split the rows of a hot bucket in the join.
    tops = materialize(tops.select("key", "size", F.col("top.hub").alias("hub"), F.col("top.component").alias("hub_component")), "hubs")
    found = materialize(rows.select("key", "rep", "component").join(tops, "key"), "buckets")
    release(tops)
    return found


def hub_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents with hubs of other components: for each document the hubs that it
    shares most buckets with, HUBS at most."""
    shared = rows.where(F.col("component") != F.col("hub_component")).groupBy("rep", "hub").agg(F.count("*").alias("shared"))
    best = first_per_group(shared, ["rep"], [F.col("shared").desc(), F.col("hub")], HUBS)
    return best.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()


def left_pairs(rows: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of members of different components in one bucket (rows of ``with_hubs``) that may reach the
    threshold by their sketches, as a table.

    Members are dealt out to their bucket's blocks. Each two blocks, and each block alone, are one group of sorted rows,
    so a sketch moves once for each block of a bucket; other sketches stay where they are.
    """
    keys = rows.groupBy("rep").agg(F.collect_set("key").alias("keys"))
    held, sent = among(rows.select(F.col("rep").alias("id")))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block, other = F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    dealt = rows.join(sketches.where(held("rep")).join(keys, "rep"), "rep").select("key", "rep", "component", "n", "sketch", "keys", block, other)
    ends = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("late")
    groups = dealt.select("key", *ends, "rep", "component", "n", "sketch", "keys").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs(batch: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        """Of rows of whole groups: each row is compared with those that stand 1, 2, ... places later in its group."""
        i, j, late, rep, component, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 7))
        bits = batch.column(7).flatten().to_numpy().view(np.uint64).reshape(len(n), -1)
        p, far, found = np.arange(len(n)), 0, [np.zeros((2, 0), np.int64)]
        while len(p):
            far += 1
            p = p[p + far < len(n)]
            p = p[group[p] == group[p + far]]
            q = p + far
            meet = np.flatnonzero((component[p] != component[q]) & ((i[p] == j[p]) | (late[p] != late[q])))
            meet = meet[alike_places(p[meet], q[meet], bits, n, threshold)]
            found.append(np.stack([p[meet], q[meet]]))
        p, q = np.concatenate(found, axis=1)
        # A pair that shares several buckets counts in one of them only.
        own = {k: set(batch.column(8)[k].as_py()) for k in np.unique([p, q]).tolist()}
        once = np.array([min(own[x] & own[y]) == key for x, y, key in zip(p.tolist(), q.tolist(), batch.column(0).take(pa.array(p)).to_pylist())], bool)
        p, q = p[once], q[once]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[p], rep[q])), pa.array(np.maximum(rep[p], rep[q]))], names=["a", "b"])

    def work(batches):
        rest = []
        for batch in chain(batches, (None,)):
            rest += [] if batch is None else [batch]
            if not any(x.num_rows for x in rest):
                continue
            rows = pa.concat_batches(rest)
            places = np.stack([rows.column(k).to_numpy() for k in range(3)])
            group = np.append(0, np.cumsum((places[:, 1:] != places[:, :-1]).any(axis=0)))
            # The last group may go on in the next batch.
            ended = rows.num_rows if batch is None else int(np.searchsorted(group, group[-1]))
            rest = [rows.slice(ended)]
            if ended:
                yield pairs(rows.slice(0, ended), group[:ended])

    near = materialize(groups.mapInArrow(work, "a long, b long"), "near")
    sent.destroy()
    return near


def near_links(sigs: DataFrame, docs: DataFrame, threshold: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The classes (with h1, h2, rep), and the components (rep, component) of the representatives that have links, both as
    tables. Signatures are released."""
    full = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # A set that no other document has is a class as it stands; only copies, and few others, are brought together.
    copied = full.groupBy("h1", "h2").agg(F.count("*").alias("rows")).where("rows > 1")
    held, sent = among(copied.select(F.col("h1").alias("id")))
    first = full.where(held("h1")).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("first"))
    single = full.where(~held("h1")).select("h1", "h2", F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands", "sketch")
    classes = materialize(single.unionByName(first.select("h1", "h2", F.col("first.doc_id").alias("rep"), F.col("first.n_shingles").alias("n"), "first.bands", "first.sketch")), "classes")
    sent.destroy()
    release(sigs)
    sketches = classes.select("rep", "sketch", "n")
    member = classes.select(F.explode("bands").alias("key"), "rep")
    # Most keys are one document's own. They are told by 48 bits, which is all that moves of a key to be counted, and left in the scan.
    part = F.shiftrightunsigned("key", 16)
    held, sent = among(member.groupBy(part.alias("id")).agg(F.count("*").alias("rows")).where("rows > 1").select("id"))
    shared = materialize(member.withColumn("part", part).where(held("part")).select("key", "rep"), "shared")
    sent.destroy()
    sizes = materialize(shared.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key", "members"), "sizes")
    bands = materialize(shared.join(sizes, "key").select("key", "rep", F.col("rep").alias("component"), "members"), "bands")
    release(shared, sizes)
    # In the first turn the hub is the member that meets most others in all its buckets, later another one each time.
    meets = bands.groupBy("rep").agg(F.sum("members").alias("meets"))
    rows = with_hubs(bands, -F.col("meets"), bands.join(meets, "rep"))
    release(bands)
    labels = classes.select("rep", F.col("rep").alias("component")).limit(0)
    for turn in range(STAR_ROUNDS):
        found, before = verified(sketched(hub_pairs(rows), sketches, threshold), docs, threshold, size), (rows, labels)
        if not found.isEmpty():
            labels = merged(labels, found)
            release(before[1])
        named_rows = rows.select("key", "rep").join(labels, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        rows = with_hubs(named_rows, F.xxhash64("rep", F.lit(turn + 1)))
        release(found, before[0])
        if rows.isEmpty():
            release(rows)
            return classes, labels
    found = verified(left_pairs(rows, sketches, threshold), docs, threshold, size)
    release(rows)
    return classes, labels if found.isEmpty() else merged(labels, found)


def near_duplicates(docs: DataFrame, threshold: int = 75, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of (doc_id, text); other columns don't matter.

    Two documents are linked if 100 * intersection >= threshold * union of their sets of
    ``size``-word shingles, A-Z lower-cased; a shorter text is one shingle. Documents without
    words, and null texts, have no links. component_id is the smallest doc_id reachable; one
    document of each component is kept. Rows that repeat a doc_id are one document: they share
    a component. A null doc_id keeps its row, with a null component_id and kept true. An empty
    table gives no rows.
    """
    sigs = materialize(signatures(docs, size), "signatures")
    # Samples and sketches don't stay for the last join.
    rows = materialize(sigs.select("doc_id", "n_shingles", "h1", "h2"), "rows")
    classes, labels = near_links(sigs, docs, threshold, size)
    by_class = materialize(classes.join(labels, "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component")), "components")
    release(classes, labels)
    joined = rows.join(by_class, ["h1", "h2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, threshold: int = 75, size: int = SHINGLE_WORDS) -> DataFrame:
    """The documents, all columns as they are, without near-duplicates of a kept one.

    Rows that repeat the doc_id of a kept document stay, as do null ids, null and empty texts;
    an empty table stays empty. Whole texts are compared, however long; columns may have any names.
    """
    gone = near_duplicates(docs, threshold, size).where("NOT kept").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
