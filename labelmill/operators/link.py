"""Record linkage: similarity joins, pass cascades, and exclusive matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions import similarity as S
from labelmill.operators.dedup import first_per_group
from labelmill.operators.matching import exclusive_match, match_blocks, match_classes, match_composite  # noqa: F401
from labelmill.session import materialize

#: A dictionary's automaton of up to so many bytes goes to every task; a larger one is looked up by shuffles.
AUTOMATON_BYTES = 64 << 20
#: What a character of a word takes in the automaton at most.
NODE_BYTES = 100


def _ranked_grams(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str, gram, block: str | None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of both sides (k, b, grams), and (k, b, size, g, r): each gram with its rank from rare to common."""
    sides = []
    for df, key in ((left, left_key), (right, right_key)):
        cols = [F.col(key).alias("k"), gram(F.col(text)).alias("grams")] + ([F.col(block).alias("b")] if block else [F.lit(0).alias("b")])
        sides.append(df.select(*cols).where((F.size("grams") > 0) & F.col("b").isNotNull()))
    # A table of its own, so that AQE can split the rows of a hot trigram in the join.
    count = materialize(sides[0].unionByName(sides[1]).select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n")), "grams")
    ranked = []
    for side in sides:
        each = side.select("k", "b", F.size("grams").alias("size"), F.explode("grams").alias("g")).join(count, "g")
        ranked.append(each.withColumn("r", F.row_number().over(Window.partitionBy("k", "b").orderBy("n", "g"))).drop("n"))
    return sides, ranked


def _candidate_pairs(ranked: list[DataFrame], threshold: float) -> DataFrame:
    """(kl, kr, b) of pairs that may reach the threshold by the grams they share first and by their sizes."""
    prefixes = [r.where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).select("k", "b", "size", "g", "r") for r in ranked]
    a, b = (p.select(F.col("k").alias(f"k{x}"), F.col("size").alias(f"size{x}"), "b", "g", F.col("r").alias(f"r{x}")) for x, p in zip("lr", prefixes))
    fits = (F.least("sizel", "sizer") >= F.greatest("sizel", "sizer") * threshold - 1e-9)
    # From the first shared trigram on, so many can be shared at most; the threshold asks for this many.
    left_over = 1 + F.least(F.col("sizel") - F.col("rl"), F.col("sizer") - F.col("rr"))
    reaches = left_over * (1 + threshold) >= (F.col("sizel") + F.col("sizer")) * threshold - 1e-6
    return a.join(b, ["b", "g"]).where(fits & reaches).select("kl", "kr", "b").distinct()


def _verified(pairs: DataFrame, sides: list[DataFrame], left_key: str, right_key: str, threshold: float) -> DataFrame:
    whole = pairs.join(sides[0].select(F.col("k").alias("kl"), "b", F.col("grams").alias("gl")), ["kl", "b"]).join(sides[1].select(F.col("k").alias("kr"), "b", F.col("grams").alias("gr")), ["kr", "b"])
    scored = whole.select(F.col("kl").alias(left_key), F.col("kr").alias(right_key), S.jaccard(F.col("gl"), F.col("gr")).alias("sim"))
    return scored.where(F.col("sim") >= threshold)


def trigram_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str, threshold: float, gram=S.trigrams, block: str | None = None) -> DataFrame:
    """(left_key, right_key, sim) of all pairs whose trigram sets reach the threshold, exactly.

    No cross join: trigrams are ordered from rare to common, and a pair can only reach the
    threshold if it shares one of the first n - ceil(t * n) + 1 of either side. Pairs found by
    those are kept if their sizes allow it, and then compared on their whole sets. With
    ``block`` only rows of equal value in that column are compared. Run it on distinct texts.
    """
    sides, ranked = _ranked_grams(left, right, left_key, right_key, text, gram, block)
    return _verified(_candidate_pairs(ranked, threshold), sides, left_key, right_key, threshold)


#: Thresholds that a top-k join tries from above, where the lowest one would make more than so many rows.
TIERS = (0.8, 0.6, 0.45)
PAIRS_AT_ONCE = 5_000_000
#: Where a threshold finds k partners for less than this share of the rows that it is tried for, the lowest one comes next.
WORTHWHILE = 0.1


def _shared_rows(ranked: list[DataFrame], threshold: float) -> int:
    """How many rows the join of both sides' first trigrams makes at a threshold."""
    first = F.col("r") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    a, b = (r.where(first).groupBy("b", "g").agg(F.count("*").alias(n)) for r, n in zip(ranked, ("n", "m")))
    return a.join(b, ["b", "g"]).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]


def top_k_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str, k: int, floor: float, gram=S.trigrams, block: str | None = None, at_once: int = PAIRS_AT_ONCE, counted: list | None = None) -> DataFrame:
    """(left_key, right_key, sim) of the k most similar rows of each left row, of those that reach ``floor``; ties by right_key.

    At a low threshold a similarity join pairs nearly everything, mostly for rows that have k better
    partners. So thresholds come from above: a left row that has its k at one of them is done, as whatever
    a lower one finds is less similar, and only the others go on. A threshold that hardly any row is done at
    is followed by the lowest. Where the lowest would make ``at_once`` rows at most, it is the only one. Left keys are distinct. ``counted`` gets the number of candidate pairs of each threshold.
    """
    sides, ranked = _ranked_grams(left, right, left_key, right_key, text, gram, block)
    ranked = [materialize(r, "ranked") for r in ranked]
    tiers = [t for t in TIERS if t > floor] if _shared_rows(ranked, floor) > at_once else []
    todo, out = [*tiers, floor], None
    open_rows = materialize(ranked[0].select("k").distinct(), "open")
    while todo:
        threshold = todo.pop(0)
        pairs = _candidate_pairs([ranked[0].join(open_rows, "k", "left_semi") if out is not None else ranked[0], ranked[1]], threshold)
        if counted is not None:
            counted.append(pairs.count())
        found = first_per_group(_verified(pairs, sides, left_key, right_key, threshold), [left_key], [F.col("sim").desc(), F.col(right_key)], k, "rank")
        found = materialize(found, "top")
        if todo:
            full = materialize(found.where(F.col("rank") == k).select(F.col(left_key).alias("k")), "full")
            found = found.join(full.withColumnRenamed("k", left_key), left_key, "left_semi")
            if full.count() < WORTHWHILE * open_rows.count():
                todo = [floor]
            open_rows = materialize(open_rows.join(full, "k", "left_anti"), "open")
        out = found if out is None else out.unionByName(found)
    return out.drop("rank")


def _grams(c: Column, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, F.lit(size))))


def substring_join(needles: DataFrame, haystacks: DataFrame, needle: str, haystack: str, shortest: int = 1) -> DataFrame:
    """(needle, haystack) of distinct texts where one is inside the other.

    Each needle looks only at haystacks that hold its rarest trigram; a needle of one or two
    characters at those that hold it among their single characters or pairs. Needles have
    ``shortest`` characters at least; with 3 the short ones are not looked for. Empty ones and nulls match nothing.
    """
    n = needles.select(F.col(needle).alias("n")).where(F.length("n") >= shortest).distinct()
    h = haystacks.select(F.col(haystack).alias("h")).where(F.length("h") >= shortest).distinct()
    held = h.where(F.length("h") >= 3).select("h", F.explode(_grams(F.col("h"), 3)).alias("g"))
    # A table of its own, so that AQE can split the rows of a hot trigram in the join.
    count = materialize(held.groupBy("g").agg(F.count("*").alias("c")), "grams")
    asked = n.where(F.length("n") >= 3).select("n", F.explode(_grams(F.col("n"), 3)).alias("g")).join(count, "g", "left").groupBy("n").agg(F.min_by("g", F.struct(F.coalesce("c", F.lit(0)), "g")).alias("g"))
    found = materialize(asked, "asked").join(held, "g").where(F.contains("h", F.col("n"))).select("n", "h")
    for size in range(max(1, shortest), 3):
        short = n.where(F.length("n") == size)
        found = found.unionByName(short.join(h.where(F.length("h") >= size).select("h", F.explode(_grams(F.col("h"), size)).alias("n")), "n").select("n", "h"))
    return found.select(F.col("n").alias(needle), F.col("h").alias(haystack))


def dictionary_hits(texts: DataFrame, dictionary: DataFrame, key: str, text: str, word: str) -> DataFrame:
    """(key, word) of every dictionary word inside a text; each word once for a row of texts.

    A dictionary whose automaton is within AUTOMATON_BYTES goes to every task, which reads each
    text once; a larger one is joined on the words' trigrams, short words on themselves. Both
    give the same. Null and empty words and texts match nothing.
    """
    words = dictionary.select(F.col(word).cast("string").alias("w")).where("w != ''").distinct()
    size = words.agg(F.coalesce(F.sum(F.length("w").cast("long") * NODE_BYTES), F.lit(0))).first()[0]
    if size > AUTOMATON_BYTES:
        pairs = substring_join(words, texts.select(F.col(text).alias("t")), "w", "t")
        return texts.select(key, F.col(text).alias("t")).join(pairs, "t").select(key, F.col("w").alias(word))
    stated = [r[0] for r in words.collect()]

    def work(batches):
        import ahocorasick
        import numpy as np
        import pyarrow as pa

        found = ahocorasick.Automaton()
        for w in stated:
            found.add_word(w, w)
        if stated:
            found.make_automaton()
        for batch in batches:
            hits = [sorted({w for _, w in found.iter(t)}) if t and stated else [] for t in batch.column(1).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(hits)), [len(x) for x in hits]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([w for x in hits for w in x], pa.string())], names=["k", "w"])

    rows = texts.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(work, f"k {rows.schema['k'].dataType.simpleString()}, w string").select(F.col("k").alias(key), F.col("w").alias(word))


def exact_hits(names: DataFrame, dictionary: DataFrame, name_key: str, entry_key: str, order: Column) -> DataFrame:
    """names joined with the dictionary on a normal form; of entries with one key the last in order wins."""
    one = first_per_group(dictionary, [entry_key], [order.desc()], 1, "entry_rank").drop("entry_rank")
    return names.join(one, F.col(name_key) == F.col(entry_key))


def cascade(passes: list[DataFrame], entity: str, order: list[Column]) -> DataFrame:
    """Of candidates of several passes the first pass's best one for each entity. Adds pass_no."""
    rows = None
    for k, found in enumerate(passes, 1):
        found = found.withColumn("pass_no", F.lit(k))
        rows = found if rows is None else rows.unionByName(found)
    return first_per_group(rows, [entity], [F.col("pass_no"), *order], 1, "rank").drop("rank")


def top_then_filter(candidates: DataFrame, entity: str, order: list[Column], keep: Column, n: int = 3) -> DataFrame:
    """Best of the first n candidates of each entity that passes ``keep``; a later one is never tried."""
    some = first_per_group(candidates, [entity], order, n, "candidate_rank")
    return first_per_group(some.where(keep), [entity], [F.col("candidate_rank")], 1, "rank").drop("rank", "candidate_rank")


def equal_rows(df: DataFrame, columns: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(members, firsts): rows by block, the smallest id of those with equal columns (null equals null), and the columns of each block."""
    ids = F.col(key).cast("long")
    firsts = df.where(ids.isNotNull()).groupBy(*columns).agg(F.min(ids).alias("block"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"r.`{c}`").eqNullSafe(F.col(f"f.`{c}`"))
    members = df.where(ids.isNotNull()).alias("r").join(firsts.alias("f"), same).select(F.col("f.block"), F.col(f"r.{key}").cast("long").alias("left"))
    return members, firsts


def outer_parts(left: DataFrame, right: DataFrame, matches: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(part, left_key, right_key): matched pairs, left rows without one, right rows without one."""
    pairs = matches.select(left_key, right_key)
    only_left = left.select(left_key).join(pairs, left_key, "left_anti")
    only_right = right.select(right_key).join(pairs, right_key, "left_anti")
    return (
        pairs.select(F.lit("matched").alias("part"), left_key, right_key)
        .unionByName(only_left.select(F.lit("left_only").alias("part"), left_key), allowMissingColumns=True)
        .unionByName(only_right.select(F.lit("right_only").alias("part"), right_key), allowMissingColumns=True)
    )


def merge_datasets(left: DataFrame, right: DataFrame, least: float = 0.6) -> DataFrame:
    """Products (left_id, product_name, manufacturer) matched with facts (right_id, …) by composite similarity.

    Every pair that reaches ``least`` has names of a similarity of at least (least - 0.3) / 0.7, which
    finds the candidates; matching is exclusive, in order of left_id. Rows without an id match nothing.
    Distinct forms of names are compared with one another and distinct forms of makers so, whatever rows have both.
    """
    from labelmill.functions import extract, normalize

    floor = max((least - S.MAKER_SHARE) / S.NAME_SHARE, 0.05)
    sides, names, makers = [], [], []
    for df, key, x, y in ((left, "left_id", "a", "m"), (right, "right_id", "b", "k")):
        forms = [normalize.name(F.col("product_name")).alias("name"), F.coalesce(extract.volume(F.col("product_name")), F.lit("")).alias("volume"), normalize.manufacturer(F.col("manufacturer")).alias("maker")]
        rows = materialize(df.select(F.col(key).cast("long").alias(key[:-3]), *forms).where(F.col(key[:-3]).isNotNull()), "forms")
        names.append(materialize(rows.select("name", "volume").distinct().withColumn(x, F.monotonically_increasing_id()), "names"))
        makers.append(materialize(rows.select("maker").distinct().withColumn(y, F.monotonically_increasing_id()), "makers"))
        sides.append(rows.join(names[-1], ["name", "volume"]).join(makers[-1], "maker").select(x, y, key[:-3], (F.length("maker") <= 1).alias("open")))
    texts = [df.select("name").distinct().withColumn(k, F.col("name")) for df, k in zip(names, ("name_l", "name_r"))]
    near = trigram_join(*texts, "name_l", "name_r", "name", floor)
    a, b = (df.withColumnsRenamed({"name": f"name_{s}", "volume": f"volume_{s}"}) for df, s in zip(names, "lr"))
    near = near.join(a, "name_l").join(b, "name_r").where("volume_l = '' OR volume_r = '' OR volume_l = volume_r").select("a", "b", "sim")
    # With names equal, makers must be alike by this; where it is more than LEAST_MAKER, that holds for short ones too.
    needed = (least - S.NAME_SHARE) / S.MAKER_SHARE - 1e-9
    known = trigram_join(*makers, "m", "k", "maker", max(needed, S.LEAST_MAKER))
    if needed < S.LEAST_MAKER:
        for short in ([makers[0].where("length(maker) <= 1"), makers[1]], [makers[0].where("length(maker) > 1"), makers[1].where("length(maker) <= 1")]):
            known = known.unionByName(trigram_join(*short, "m", "k", "maker", max(needed, 1e-6)))
        known = known.distinct()
    found = match_composite(*sides, near, known, (S.NAME_SHARE, S.MAKER_SHARE), least)
    return found.select(F.col("left").cast(left.schema["left_id"].dataType).alias("left_id"), F.col("right").cast(right.schema["right_id"].dataType).alias("right_id"), "score")


def fuzzy_facts(products: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, decisions) of products (product_id, normalized_name, normalized_maker, product_name) and
    facts (fact_id, the same): names alike by a threshold for their length, blocked by maker if the
    maker has over one character; top 3 per fact, unit families must not differ, a product is used once."""
    from labelmill.functions import extract

    t = 0.7
    # Facts of equal names and maker have the same candidates.
    rows = materialize(facts.select("fact_id", "normalized_name", "normalized_maker", "product_name"), "facts")
    members, firsts = equal_rows(rows, ["normalized_name", "normalized_maker", "product_name"], "fact_id")
    firsts = materialize(firsts, "blocks")
    left = firsts.select("block", F.col("normalized_name").alias("txt"), F.when(F.length("normalized_maker") > 1, F.col("normalized_maker")).alias("maker"), F.col("product_name").alias("fp"))
    right = materialize(products.select("product_id", F.col("normalized_name").alias("txt"), F.col("normalized_maker").alias("maker"), F.col("product_name").alias("pp")), "products")
    # A text is compared once, whatever its makers and rows. Tables of their own, so that trigrams are made of distinct texts only.
    texts = [materialize(df.select("txt").distinct(), "texts").withColumn(k, F.col("txt")) for df, k in ((left, "txt_l"), (right, "txt_r"))]
    pairs = materialize(trigram_join(texts[0], texts[1], "txt_l", "txt_r", "txt", t).where(F.col("sim") >= S.length_threshold(F.col("txt_l"))), "pairs")

    def nearest(some: DataFrame, cols: list[str]) -> DataFrame:
        """The three nearest products of each block; of products of equal cols only the first three can be among them."""
        rows = first_per_group(right, cols, [F.col("product_id")], 3, "n").drop("n").withColumnRenamed("txt", "txt_r")
        near = some.select(*cols).distinct().withColumnRenamed("txt", "txt_l").join(pairs, "txt_l").join(rows.select("txt_r", "product_id", "pp", *cols[1:]), ["txt_r", *cols[1:]])
        top = first_per_group(near, ["txt_l", *cols[1:]], [F.col("sim").desc(), F.col("product_id")], 3, "candidate_rank")
        return some.join(top.withColumnRenamed("txt_l", "txt"), cols).select("block", "product_id", "sim", "fp", "pp", "candidate_rank")

    ranked = materialize(nearest(left.where("maker IS NOT NULL"), ["txt", "maker"]).unionByName(nearest(left.where("maker IS NULL").drop("maker"), ["txt"])), "ranked")
    fu, pu = extract.unit_family(F.col("fp")), extract.unit_family(F.col("pp"))
    clash = F.coalesce(fu != pu, F.lit(False))
    good = ranked.where(~clash).select("block", F.col("product_id").cast("long").alias("group"), F.col("sim").alias("score")).where("group IS NOT NULL")
    fact, product = (df.schema[k].dataType for df, k in ((facts, "fact_id"), (products, "product_id")))
    # Facts that share no candidate, however far apart, don't touch one another, so they are matched side by side.
    found = materialize(match_classes(members, good.select("group", F.col("group").alias("right")).distinct(), good), "matches")
    matches = found.select(F.col("left").cast(fact).alias("fact_id"), F.col("right").cast(product).alias("product_id"), F.col("score").alias("sim"))
    refused = ranked.where(clash).join(members, "block").select(F.col("left").cast(fact).alias("fact_id"), "product_id", "sim")
    decisions = (
        matches.select("fact_id", "product_id", "sim", F.lit("matched").alias("status"), F.lit(None).cast("string").alias("reason"))
        .unionByName(refused.select("fact_id", "product_id", "sim", F.lit("rejected").alias("status"), F.lit("unit_mismatch").alias("reason")))
        .unionByName(rows.select("fact_id").join(matches, "fact_id", "left_anti").select("fact_id", F.lit(None).cast("long").alias("product_id"), F.lit(None).cast("double").alias("sim"), F.lit("pooled").alias("status"), F.lit(None).cast("string").alias("reason")))
    )
    return matches, decisions
