"""Enrichment steps of the batch pipeline: registrations, names, facts and ingredients of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions import extract, normalize
from labelmill.functions import similarity as S
from labelmill.operators import dedup, link, matching
from labelmill.session import materialize

LOOSE, MAKER_PASS = 0.85, 0.5


def with_keys(df: DataFrame, key: str, id_column: str, unit: str | None = None, default_unit: str = "g") -> DataFrame:
    """df with 'NO_BARCODE_<id>' where the key is missing, and a default unit."""
    out = df.withColumn(key, F.coalesce(normalize.blank_to_null(F.col(key)), F.concat(F.lit("NO_BARCODE_"), F.col(id_column).cast("string"))))
    return out.withColumn(unit, F.coalesce(normalize.blank_to_null(F.col(unit)), F.lit(default_unit))) if unit else out


def enrich_from_reports(products: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, decisions): products (product_id, report_no, food_type, is_active, enriched) filled from the
    first report (id, report_no, food_type, production) of their number.

    A filled food_type stays; a product is inactive if production says '아니오' (unknown counts as
    active); enriched products and ones without a report don't change.
    """
    first = dedup.first_per_group(reports, ["report_no"], [F.col("id")]).select("report_no", F.col("food_type").alias("new_type"), F.col("production").alias("new_production"), F.lit(True).alias("found"))
    joined = products.join(first, "report_no", "left").withColumn("takes", F.coalesce("found", F.lit(False)) & ~F.coalesce("enriched", F.lit(False)))
    takes, active = F.col("takes"), F.coalesce(F.col("new_production") != "아니오", F.lit(True))
    changed = {"food_type": F.when(takes, F.coalesce("food_type", "new_type")).otherwise(F.col("food_type")), "is_active": F.when(takes, active).otherwise(F.col("is_active")), "enriched": takes | F.coalesce("enriched", F.lit(False))}
    status = F.when(takes, "matched").when(F.col("report_no").isNull() | F.coalesce("enriched", F.lit(False)), "skipped").otherwise("rejected")
    reason = F.when(~takes & F.col("report_no").isNotNull() & ~F.coalesce("enriched", F.lit(False)), "no_report")
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in products.columns)), joined.select("product_id", status.alias("status"), reason.alias("reason"))


def register_ingredients(products: DataFrame, lines: DataFrame, registered: DataFrame) -> DataFrame:
    """(product_id, raw_text) of products (product_id, report_no) that aren't registered: the ingredient lines
    (id, report_no, name) of their number, joined in order; blank ones are left out."""
    texts = lines.where(normalize.blank_to_null(F.col("name")).isNotNull()).groupBy("report_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.trim("name").alias("name")))), lambda x: x["name"]), ", ").alias("raw_text"))
    return products.select("product_id", "report_no").join(registered.select("product_id"), "product_id", "left_anti").join(texts, "report_no").select("product_id", "raw_text")


def official_names(products: DataFrame, reports: DataFrame) -> DataFrame:
    """(product_id, official_name): of the last report (id, report_no, name) of the product's number."""
    last = dedup.first_per_group(reports, ["report_no"], [F.col("id").desc()]).select("report_no", F.col("name").alias("official_name"))
    return products.select("product_id", "report_no").join(last, "report_no").select("product_id", "official_name")


def _nearest(wanted: DataFrame, facts: DataFrame, pairs: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(best, every) of (cols, fact_id, fu, sim): the facts near each text of ``wanted`` by pairs (txt_l, txt_r, sim), inside a maker if cols name one.

    Which of them a product may take is a matter of their unit family alone, so ``best`` is the first of each family,
    however many are near. Facts of one text and family are equally near to all others; the smallest id stands for them.
    """
    names = wanted.select(*cols).where("txt != ''").distinct()
    if len(cols) > 1:
        names = names.where(F.col(cols[1]).isNotNull())
    some = dedup.first_per_group(facts.where("txt != ''"), [*cols, "fu"], [F.col("fact_id")]).select(F.col("txt").alias("txt_r"), *cols[1:], "fact_id", "fu")
    every = names.join(pairs, F.col("txt") == F.col("txt_l")).join(some, ["txt_r", *cols[1:]]).select(*cols, "fact_id", "fu", "sim")
    return dedup.first_per_group(every, [*cols, "fu"], [F.col("sim").desc(), F.col("fact_id")]).drop("rank"), every


def match_facts(products: DataFrame, facts: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, decisions) for products (product_id, report_no, product_name, maker) and facts
    (fact_id, product_name, maker). Facts may be used again, so the order of products doesn't matter.

    Pass 1 compares deep names inside a maker, by a threshold for their length; pass 2 does the same
    with the official name where it differs; pass 3 takes any maker at 0.85. In each pass all facts that reach
    the threshold are tried, the most similar first, and pairs of different unit families are rejected; the first
    pass that yields a match wins. Products of the same normal forms are looked up once for all of them; of facts of the same
    forms and family a match, and a rejection, names the smallest id.
    """
    forms = {"txt": normalize.deep(F.col("product_name")), "maker_key": F.nullif(normalize.maker(F.col("maker")), F.lit(""))}
    # Of facts of one name and maker the smallest id is the one that is named.
    known = facts.groupBy("product_name", "maker").agg(F.min("fact_id").alias("fact_id"))
    f = materialize(known.select("fact_id", *(c.alias(k) for k, c in forms.items()), F.coalesce(extract.unit_family(F.col("product_name")), F.lit("")).alias("fu")), "facts")
    named = products.join(official_names(products, reports).withColumnRenamed("product_id", "named_id"), F.col("product_id") == F.col("named_id"), "left")
    p = named.select("product_id", *(c.alias(k) for k, c in forms.items()), normalize.deep(F.col("official_name")).alias("official"), extract.unit_family(F.col("product_name")).alias("pu"))
    p = p.withColumn("official", F.when(F.col("official") != F.col("txt"), F.col("official")).otherwise(""))
    # All that a product's matches depend on; '' stands for what it lacks and matches nothing.
    keys = ["txt", "maker_key", "official", "pu"]
    p = materialize(p.select("product_id", *(F.coalesce(k, F.lit("")).alias(k) for k in keys)), "products")
    kinds = materialize(p.select(*keys).distinct(), "kinds")
    w = kinds.withColumn("maker_key", F.nullif("maker_key", F.lit("")))
    official = w.select(F.col("official").alias("txt"), "maker_key")
    # A text is compared once, whatever its makers, passes and rows. Tables of their own, so that trigrams are made of distinct texts only.
    texts = [materialize(df.select("txt").where("txt != ''").distinct(), "texts").withColumn(k, F.col("txt")) for df, k in ((w.select("txt").unionByName(official.select("txt")), "txt_l"), (f, "txt_r"))]
    pairs = materialize(link.trigram_join(texts[0], texts[1], "txt_l", "txt_r", "txt", 0.7), "pairs")
    alike = pairs.where(F.col("sim") >= S.length_threshold(F.col("txt_l")))
    order = [F.col("sim").desc(), F.col("fact_id")]
    near = [_nearest(w, f, alike, ["txt", "maker_key"]), _nearest(official, f, alike, ["txt", "maker_key"]), _nearest(w, f, pairs.where(F.col("sim") >= LOOSE), ["txt"])]

    def of_kinds(rows: list[DataFrame]) -> list[DataFrame]:
        """Each pass's rows for every kind of product."""
        rows = [rows[0], rows[1].withColumnRenamed("txt", "official"), rows[2]]
        return [kinds.join(x, on).select(*keys, "fact_id", "sim", "fu") for x, on in zip(rows, (["txt", "maker_key"], ["official", "maker_key"], ["txt"]))]

    clash = (F.col("pu") != "") & (F.col("fu") != "") & (F.col("pu") != F.col("fu"))
    kind = F.struct(*keys)
    tops = [materialize(t, "tops") for t in of_kinds([best for best, _ in near])]
    best = link.cascade([t.where(~clash).select(kind.alias("kind"), "fact_id", "sim") for t in tops], "kind", order)
    one = p.select("product_id", kind.alias("kind"))
    best = materialize(dedup.first_per_group(one.join(best, "kind"), ["product_id"], [F.col("pass_no"), *order]).select("product_id", "fact_id", "sim", "pass_no"), "best")
    tried = of_kinds([every for _, every in near])
    refused = tried[0].unionByName(tried[1]).unionByName(tried[2]).where(clash).select(kind.alias("kind"), "fact_id", "sim").distinct()
    rejected = one.join(refused, "kind").select("product_id", "fact_id", "sim").distinct()
    decisions = best.select("product_id", "fact_id", F.lit("matched").alias("status"), F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("product_id", "fact_id", F.lit("rejected").alias("status"), F.lit("unit_mismatch").alias("reason")))
    return best, decisions


def match_ingredients(products: DataFrame, staged: DataFrame, loose: bool = False, max_pass: int = 3) -> DataFrame:
    """(product_id, report_no, sim, pass_no) of products (product_id, product_name, maker) and staged
    ingredient lists (report_no, name, maker).

    Pass 1: the product's name (3 characters or more) is inside the staged one and the makers are
    the same, shortest staged name first among ten; pass 2: similar by 0.5 and the same maker,
    best of five; pass 3, if asked for, similar by 0.6 whatever the maker (5 characters or more).
    """
    p = materialize(products.select("product_id", F.trim("product_name").alias("pn"), normalize.maker(F.col("maker")).alias("pm")), "products")
    s = materialize(staged.select("report_no", F.trim("name").alias("sn"), normalize.maker(F.col("maker")).alias("sm")), "staged")
    # What is tried depends on a product's name alone, what is kept on its maker too; each is found once.
    names, kinds = p.select("pn").where("pn IS NOT NULL").distinct(), p.select("pn", "pm").distinct()
    same = S.same_maker(F.col("pm"), F.col("sm"))
    order = [F.col("sim").desc(), F.col("sn"), F.col("report_no")]

    def tried(pairs: DataFrame, order: list[Column], n: int) -> DataFrame:
        """The first n staged rows of each pn by its pairs (pn, sn, sim); of rows of one name only the first n can be among them."""
        rows = dedup.first_per_group(s.where("sn IS NOT NULL"), ["sn"], [F.col("report_no")], n).drop("rank")
        return materialize(dedup.first_per_group(pairs.join(rows, "sn"), ["pn"], order, n, "candidate_rank"), "tried")

    def kept(rows: DataFrame, keep: Column) -> DataFrame:
        """The first of the tried rows that passes, for each name and maker."""
        some = kinds.join(rows, "pn").where(keep).withColumn("kind", F.struct("pn", "pm"))
        return dedup.first_per_group(some, ["kind"], [F.col("candidate_rank")]).select("kind", "report_no", "sim")

    inside = link.substring_join(names, s, "pn", "sn", shortest=3).withColumn("sim", F.lit(1.0))
    passes = [kept(tried(inside, [F.length("sn"), F.col("sn"), F.col("report_no")], 10), same)]
    distinct = [df.select(F.col(c).alias("txt")).distinct().withColumn(c, F.col("txt")) for df, c in ((names.where(F.length("pn") >= 3), "pn"), (s, "sn"))]
    # Each staged name has a row at least, so the best five rows are those of the best five names at most.
    near = tried(link.top_k_join(distinct[0], distinct[1], "pn", "sn", "txt", 5, MAKER_PASS, gram=S.word_trigrams), order, 5)
    passes.append(kept(near, same))
    if loose:
        passes.append(kept(near, (F.col("candidate_rank") == 1) & (F.col("sim") >= 0.6) & (F.length("pn") >= 5)))
    best = link.cascade(passes[:max_pass], "kind", [F.col("report_no")])
    found = p.where("pn IS NOT NULL").select("product_id", F.struct("pn", "pm").alias("kind")).join(best, "kind").drop("kind")
    return dedup.first_per_group(found, ["product_id"], [F.col("pass_no"), F.col("report_no")]).select("product_id", "report_no", "sim", "pass_no")


def substring_facts(products: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id, product_id): for each food name (fact_id, food_name), in order of fact_id, the first product
    (product_id, product_name) without facts whose name holds it; each product once. Upper and lower case are alike.

    Facts of one name look for it once and are dealt the products that hold it by their place in the order.
    Blank and null names match nothing.
    """
    food, name = F.lower(F.trim("food_name")), F.lower("product_name")
    named = facts.select(F.col("fact_id").cast("long").alias("fact_id"), food.alias("food")).where("food != '' AND fact_id IS NOT NULL")
    blocks = named.groupBy("food").agg(F.min("fact_id").alias("block"))
    held = products.select(F.col("product_id").cast("long").alias("right"), name.alias("held")).where("held IS NOT NULL AND right IS NOT NULL")
    blocks = materialize(blocks, "blocks")
    # Products of one name (or set of names, if an id repeats) are a class: which of them a food takes first is a matter of their ids alone.
    rights = held.groupBy("right").agg(F.array_sort(F.collect_set("held")).alias("names"))
    groups = materialize(rights.groupBy("names").agg(F.min("right").alias("group")), "groups")
    known = groups.select("group", F.explode("names").alias("held"))
    lists = link.substring_join(blocks, known, "food", "held").join(blocks, "food").join(known, "held").select("block", "group", F.lit(1.0).alias("score")).distinct()
    found = matching.match_classes(named.join(blocks, "food").select("block", F.col("fact_id").alias("left")), rights.join(groups, "names").select("group", "right"), lists)
    return found.select(F.col("left").cast(facts.schema["fact_id"].dataType).alias("fact_id"), F.col("right").cast(products.schema["product_id"].dataType).alias("product_id"))


def maker_synonyms(products: DataFrame, registered: DataFrame, staged: DataFrame, top: int = 50, each: int = 10) -> DataFrame:
    """(maker, n_lacking, candidate, sim): other names that makers may go by whose products lack ingredients.

    Of products (product_id, maker) without a registered list (product_id), the ``top`` makers with most of
    them; for each the ``each`` most alike makers of staged lists (maker), if similar by 0.3, without those that its
    normal form already meets by being equal, inside or around. Blank makers, and normal forms of one character, don't count.
    """
    lacking = products.where("maker != ''").join(registered.select("product_id"), "product_id", "left_anti")
    makers = lacking.groupBy("maker").agg(F.count("*").alias("n_lacking")).orderBy(F.col("n_lacking").desc(), "maker").limit(top)
    makers = makers.where(F.length(normalize.maker(F.col("maker"))) >= 2)
    names = staged.where("maker != ''").select(F.col("maker").alias("candidate")).distinct()
    pairs = link.top_k_join(makers.withColumn("txt", F.col("maker")), names.withColumn("txt", F.col("candidate")), "maker", "candidate", "txt", each, 0.3, gram=S.word_trigrams)
    met = S.same_maker(normalize.maker(F.col("maker")), normalize.maker(F.col("candidate")))
    return pairs.where(~met).join(makers, "maker").select("maker", "n_lacking", "candidate", "sim")


def match_rates(decisions: DataFrame) -> DataFrame:
    """(status, n, rate) of a decision log, rate in percent of all decisions."""
    counts = decisions.groupBy("status").agg(F.count("*").alias("n"))
    # One row for each status, so one task takes the total.
    return counts.withColumn("rate", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))


def additive_groups(links: DataFrame, additives: DataFrame, product: str, additive: str, name: str, color: str, rank: Column) -> DataFrame:
    """(product, dominant_rank, additives): each product's additives as an array sorted by name; products without any give no row."""
    rows = links.select(product, additive).distinct().join(additives, additive)
    return rows.groupBy(product).agg(F.greatest(F.max(rank), F.lit(1)).alias("dominant_rank"), F.array_sort(F.collect_list(F.struct(name, color))).alias("additives"))
