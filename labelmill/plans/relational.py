"""Relational core: lookups, filters, joins, aggregations, sorts, dedup and changes of state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelmill.functions import normalize as N
from labelmill.operators import dedup, quality, score, search
from labelmill.plans.registry import query
from labelmill.session import table
from labelmill.sources import landing
from labelmill.streaming import admission

SCALE = "floor(({}) * 100 + 0.5) / 100"


def _cents(c):
    return F.floor(c * 100 + 0.5) / 100


@query("point_lookup", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey = 17")
def point_lookup(spark, d):
    return search.by_key(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), "p_partkey", 17)


@query(
    "validate_keys",
    "SELECT c_custkey, regexp_matches(k, '^[0-9]{8,14}$') AS valid FROM (SELECT c_custkey, CAST(c_custkey * 7919 * 1013 AS VARCHAR) AS k FROM customer)",
)
def validate_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", search.valid_barcode((F.col("c_custkey") * 7919 * 1013).cast("string")).alias("valid"))


@query("search_substring", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%' || 'RING' || '%'")
def search_substring(spark, d):
    return table(spark, d, "part").where(F.ilike("p_name", F.lit("%RING%"))).select("p_partkey", "p_name")


@query("blank_guard", "SELECT event_id, nullif(trim(event_type), '') AS kind FROM events WHERE nullif(trim(props), '') IS NOT NULL")
def blank_guard(spark, d):
    return table(spark, d, "events").where(N.blank_to_null(F.col("props")).isNotNull()).select("event_id", N.blank_to_null(F.col("event_type")).alias("kind"))


@query("not_in_or_null", "SELECT o_orderkey FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NULL OR nullif(o_orderpriority, '5-LOW') NOT IN ('1-URGENT', '2-HIGH')")
def not_in_or_null(spark, d):
    kind = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return table(spark, d, "orders").where(kind.isNull() | ~kind.isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_exists(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("anti_missing", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_missing(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("range_anomaly", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_extendedprice > 90000 OR l_quantity <= 1 OR l_quantity IS NULL")
def range_anomaly(spark, d):
    return table(spark, d, "lineitem").where("l_extendedprice > 90000 OR l_quantity <= 1 OR l_quantity IS NULL").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query(
    "pattern_buckets",
    """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(s_name, '^Supplier#0+[0-9]$') THEN 'one digit' WHEN regexp_matches(s_name, '^Supplier#0+[0-9]{2}$') THEN 'two digits'
       WHEN regexp_matches(s_name, '^Supplier#[0-9]+$') THEN 'more' ELSE 'other' END AS bucket FROM supplier) GROUP BY bucket""",
)
def pattern_buckets(spark, d):
    c = F.col("s_name")
    bucket = F.when(c.rlike("^Supplier#0+[0-9]$"), "one digit").when(c.rlike("^Supplier#0+[0-9]{2}$"), "two digits").when(c.rlike("^Supplier#[0-9]+$"), "more").otherwise("other")
    return quality.frequency(table(spark, d, "supplier").select(bucket.alias("bucket")), "bucket")


@query("json_path_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90")
def json_path_filter(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k >= 90")


@query("truthy_any", "SELECT l_orderkey, l_linenumber, (coalesce(l_discount, 0) <> 0 OR coalesce(l_tax, 0) <> 0) AS has_any, CASE WHEN l_tax IS NULL OR l_tax = 0 THEN 100 ELSE l_tax + 0.0 END AS tax_or_default FROM lineitem")
def truthy_any(spark, d):
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0)) != 0
    fill = F.when(F.col("l_tax").isNull() | (F.col("l_tax") == 0), F.lit(100.0)).otherwise(F.col("l_tax") + 0.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_discount") | c("l_tax")).alias("has_any"), fill.alias("tax_or_default"))


@query("left_join_facts", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def left_join_facts(spark, d):
    facts = table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey", "o_orderkey", "o_totalprice")
    return table(spark, d, "customer").join(facts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query(
    "fanout_two_left",
    """SELECT p_type, count(*) AS fanned_rows, count(DISTINCT p_partkey) AS parts, count(l_orderkey) AS with_lines FROM part
       LEFT JOIN (SELECT l_partkey, l_orderkey FROM lineitem WHERE l_quantity > 45) ON p_partkey = l_partkey GROUP BY p_type""",
)
def fanout_two_left(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey", "l_orderkey")
    joined = table(spark, d, "part").select("p_partkey", "p_type").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.groupBy("p_type").agg(F.count("*").alias("fanned_rows"), F.countDistinct("p_partkey").alias("parts"), F.count("l_orderkey").alias("with_lines"))


@query(
    "first_row_lookup",
    """SELECT c_custkey, o_orderkey AS first_order, o_totalprice FROM customer LEFT JOIN
       (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) o ON c_custkey = o_custkey AND r = 1""",
)
def first_row_lookup(spark, d):
    first = dedup.first_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_orderkey")])
    return table(spark, d, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("first_order"), "o_totalprice")


@query("bridge_join", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def bridge_join(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("pending_queue", """SELECT o_orderkey, o_orderstatus, n_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey,
       LATERAL (SELECT coalesce(c, 0) AS n_lines) ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 25""")
def pending_queue(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("c"))
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    order = [F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey")]
    return rows.orderBy(*order).limit(25).select("o_orderkey", "o_orderstatus", F.coalesce("c", F.lit(0)).alias("n_lines"))


@query("prefix_consistency", "SELECT a.doc_id, trim(substring(a.text, 1, 50)) = trim(substring(b.text, 1, 50)) AS same FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def prefix_consistency(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.trim(F.substring("text", 1, 50)).alias("head"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("head").alias("other"))
    return docs.join(other, "doc_id").select("doc_id", (F.col("head") == F.col("other")).alias("same"))


@query("coverage_summary", """SELECT count(*) AS total, count(*) FILTER (l_discount > 0.05) AS discounted, round(count(*) FILTER (l_discount > 0.05) * 100.0 / count(*), 1) AS discounted_rate,
       count(*) FILTER (l_returnflag = 'R') AS returned, round(count(*) FILTER (l_returnflag = 'R') * 100.0 / count(*), 1) AS returned_rate FROM lineitem""")
def coverage_summary(spark, d):
    return quality.coverage(table(spark, d, "lineitem"), {"discounted": F.col("l_discount") > 0.05, "returned": F.col("l_returnflag") == "R"})


@query("distinct_counts", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders FROM lineitem")
def distinct_counts(spark, d):
    return table(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_orderkey").alias("orders"))


@query("frequency_table", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def frequency_table(spark, d):
    return quality.frequency(table(spark, d, "documents"), "source")


@query("step_status_matrix", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def step_status_matrix(spark, d):
    return quality.frequency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("coverage_by_type", """SELECT p_brand, count(*) AS total, count(v) AS with_value, round(count(v) * 100.0 / count(*), 1) AS rate FROM (SELECT p_brand, CASE WHEN p_size > 25 THEN 1 END AS v FROM part)
       GROUP BY p_brand HAVING count(*) >= 10 ORDER BY rate DESC, total DESC, p_brand LIMIT 15""")
def coverage_by_type(spark, d):
    return quality.coverage_by(table(spark, d, "part").select("p_brand", F.when(F.col("p_size") > 25, 1).alias("v")), "p_brand", "v")


@query("ordered_concat", """SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ', ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY l_orderkey
       HAVING length(string_agg(CAST(l_partkey AS VARCHAR), ', ' ORDER BY l_linenumber, l_partkey, l_suppkey)) > 5""")
def ordered_concat(spark, d):
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["l_partkey"].cast("string")), ", ")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(joined.alias("parts")).where(F.length("parts") > 5)


@query("min_id_per_group", "SELECT user_id, event_type, min(event_id) AS keep_id, count(*) AS n FROM events GROUP BY user_id, event_type")
def min_id_per_group(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("keep_id"), F.count("*").alias("n"))


@query("guarded_average", "SELECT event_type, coalesce(floor(avg(CASE WHEN value > 100 THEN value END) * 1000 + 0.5) / 1000, 0) AS mean_value FROM events GROUP BY event_type")
def guarded_average(spark, d):
    mean = F.avg(F.when(F.col("value") > 100, F.col("value")))
    return table(spark, d, "events").groupBy("event_type").agg(F.coalesce(F.floor(mean * 1000 + 0.5) / 1000, F.lit(0.0)).alias("mean_value"))


@query("null_rate_profile", """SELECT 'small' AS column_name, round(avg(CASE WHEN p_size > 10 THEN 1 ELSE 0 END) * 100, 1) AS null_rate FROM part
       UNION ALL SELECT 'promo', round(avg(CASE WHEN p_type = 'PROMO' THEN 0 ELSE 1 END) * 100, 1) FROM part UNION ALL SELECT 'p_name', round(avg(CASE WHEN p_name IS NULL THEN 1 ELSE 0 END) * 100, 1) FROM part""")
def null_rate_profile(spark, d):
    rows = table(spark, d, "part").select(F.when(F.col("p_size") <= 10, 1).alias("small"), F.when(F.col("p_type") == "PROMO", 1).alias("promo"), "p_name")
    return quality.null_rates(rows, ["small", "promo", "p_name"])


@query("bucket_histogram", "SELECT CASE WHEN value >= 200 THEN 200.0 WHEN value >= 100 THEN 100.0 WHEN value >= 50 THEN 50.0 WHEN value >= 10 THEN 10.0 ELSE -1.0 END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def bucket_histogram(spark, d):
    return quality.histogram(table(spark, d, "events"), "value", [10, 50, 100, 200])


@query("group_variants", """SELECT lower(event_type || '-' || CAST(user_id % 7 AS VARCHAR)) AS normal_form, string_agg(DISTINCT raw, '|' ORDER BY raw) AS names, count(DISTINCT raw) AS n_names
       FROM (SELECT event_type, user_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || '-' || CAST(user_id % 7 AS VARCHAR) AS raw FROM events) GROUP BY 1 HAVING count(DISTINCT raw) > 1
       ORDER BY n_names DESC, normal_form LIMIT 50""")
def group_variants(spark, d):
    tail = F.concat(F.lit("-"), (F.col("user_id") % 7).cast("string"))
    raw = F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), tail)
    return quality.variants(table(spark, d, "events").select(raw.alias("raw_name")), "raw_name", F.lower("raw_name"))


@query("recent_orders", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 20")
def recent_orders(spark, d):
    return search.recent(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("hash_sample", "SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents ORDER BY h, doc_id LIMIT 100")
def hash_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h")).orderBy("h", "doc_id").limit(100)


@query("union_tagged", "SELECT 'customer' AS origin, c_name AS name FROM customer UNION ALL SELECT DISTINCT 'clerk', 'Clerk ' || CAST(o_custkey % 50 AS VARCHAR) FROM orders")
def union_tagged(spark, d):
    clerks = table(spark, d, "orders").select(F.lit("clerk").alias("origin"), F.concat(F.lit("Clerk "), (F.col("o_custkey") % 50).cast("string")).alias("name")).distinct()
    return table(spark, d, "customer").select(F.lit("customer").alias("origin"), F.col("c_name").alias("name")).unionByName(clerks)


@query("intersection_report", "SELECT count(DISTINCT o_custkey) AS in_both FROM orders JOIN (SELECT DISTINCT user_id FROM events) ON o_custkey = user_id")
def intersection_report(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("o_custkey"))
    return table(spark, d, "orders").join(users, "o_custkey", "left_semi").agg(F.countDistinct("o_custkey").alias("in_both"))


@query("dedup_keep_latest", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def dedup_keep_latest(spark, d):
    return dedup.keep_latest(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("dedup_keep_earliest", "SELECT doc_id, md5(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_keep_earliest(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return dedup.keep_earliest(rows, ["h"], "doc_id")


@query("dedup_null_keys", """WITH e AS (SELECT event_id, event_type, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS u FROM events)
       SELECT event_id, u, event_type FROM e WHERE u IS NOT NULL QUALIFY row_number() OVER (PARTITION BY u ORDER BY event_id DESC) = 1
       UNION ALL SELECT event_id, u, event_type FROM e WHERE u IS NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1""")
def dedup_null_keys(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("u"), "event_type")
    return dedup.keep_latest_or(rows, "u", "event_type", "event_id")


@query("dedup_guarded", """WITH e AS (SELECT event_id, event_type, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS u FROM events)
       SELECT event_id, u, event_type FROM (SELECT *, row_number() OVER (PARTITION BY u, event_type ORDER BY event_id DESC) AS r FROM e) WHERE r = 1 OR u IS NULL""")
def dedup_guarded(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("u"), "event_type")
    return dedup.keep_latest(rows, ["u", "event_type"], "event_id")


@query("upsert_latest", """SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL
       SELECT s_suppkey, upper(s_name), s_acctbal + 1 FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey + 1000000, 'new', 0.0 FROM supplier WHERE s_suppkey % 10 = 0""")
def upsert_latest(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    old = s.where("s_suppkey % 5 = 0").select("s_suppkey", F.upper("s_name").alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal"))
    new = s.where("s_suppkey % 10 = 0").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), F.lit("new").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    later = old.withColumns({"s_name": F.concat(F.col("s_name"), F.lit(" again")), "s_acctbal": F.lit(-1.0)})
    return dedup.upsert(s, later.unionByName(old).unionByName(new), ["s_suppkey"], [F.col("s_name")])


@query("insert_if_absent", """SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 'in:' || c_name FROM customer WHERE c_custkey % 8 = 0""")
def insert_if_absent(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    incoming = c.where("c_custkey % 8 = 0 OR c_custkey % 3 = 1").select("c_custkey", F.concat(F.lit("in:"), "c_name").alias("c_name"))
    return dedup.insert_if_absent(c.where("c_custkey % 4 <> 0"), incoming.where("c_custkey % 8 = 0 OR c_custkey % 4 <> 0"), ["c_custkey"], [F.col("c_name")])


@query("coalesce_fill", "SELECT p_partkey, coalesce(CASE WHEN p_size > 20 THEN p_type END, CASE WHEN p_partkey % 2 = 0 THEN 'filled' END) AS p_type FROM part")
def coalesce_fill(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 20, F.col("p_type")).alias("p_type"))
    fill = table(spark, d, "part").where("p_partkey % 2 = 0").select("p_partkey", F.explode(F.array(F.lit("other"), F.lit("filled"))).alias("p_type"))
    return dedup.patch(p, fill, "p_partkey", ["p_type"])


@query("case_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 250000 THEN 'verified' WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'unverified' END AS status FROM orders")
def case_update(spark, d):
    status = F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 250000), "verified").when(F.col("o_orderstatus") == "P", "partial").otherwise("unverified")
    return table(spark, d, "orders").select("o_orderkey", status.alias("status"))


@query("status_update", """WITH RECURSIVE p AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'unverified' WHEN 'P' THEN 'partial' ELSE 'admin_verified' END AS s, o_orderkey % 2 AS c FROM orders),
       e AS (SELECT user_id AS k, value / 100 AS sure, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click'),
       f AS (SELECT o_orderkey, s, c, CAST(0 AS BIGINT) AS n FROM p
             UNION ALL SELECT f.o_orderkey, CASE WHEN f.s = 'unverified' THEN CASE WHEN e.sure >= 0.9 THEN 'partial' ELSE 'unverified' END WHEN f.s = 'partial' AND f.c >= 1 THEN 'verified' ELSE f.s END, f.c + 1, e.n FROM f JOIN e ON e.k = f.o_orderkey AND e.n = f.n + 1)
       SELECT o_orderkey, s AS verification, c AS verify_count FROM f QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY n DESC) = 1""")
def status_update(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "unverified").when(F.col("o_orderstatus") == "P", "partial").otherwise("admin_verified")
    products = table(spark, d, "orders").select("o_orderkey", status.alias("verification"), (F.col("o_orderkey") % 2).alias("verify_count"))
    clicks = table(spark, d, "events").where("event_type = 'click'").withColumnRenamed("user_id", "o_orderkey")
    return admission.advance(products, clicks, "o_orderkey", "ts", "event_id", F.col("value") / 100)


@query("missing_page_keys", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)")
def missing_page_keys(spark, d):
    staged = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return dedup.missing_keys(table(spark, d, "lineitem"), staged, ["l_orderkey"])


@query("page_repair", "SELECT n_nationkey, n_name FROM nation")
def page_repair(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    twice = n.unionByName(n.withColumn("n_name", F.concat(F.col("n_name"), F.lit(" again"))))
    return landing.repaired(n.where("n_nationkey % 2 = 0"), twice, ["n_nationkey"], "n_name")


@query("page_rescan", "SELECT o_orderkey, max(v) AS version FROM (SELECT o_orderkey, 1 AS v FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 2 FROM orders) GROUP BY o_orderkey")
def page_rescan(spark, d):
    """All pages are read again; of a row that was staged already the new one counts."""
    o = table(spark, d, "orders").select("o_orderkey")
    staged = o.where("o_orderkey % 3 <> 0").withColumn("version", F.lit(1))
    return landing.rescanned(staged, o.withColumn("version", F.lit(2)), ["o_orderkey"], [F.col("version").desc()])


@query("header_aliases", "SELECT c_custkey AS id, coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE ' ' END), ''), nullif(trim(c_mktsegment), '')) AS label FROM customer")
def header_aliases(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" ").alias("local name"), F.col("c_mktsegment").alias("CODE"))
    return landing.map_records(rows, {"id": ["id"], "label": ["local name", "CODE", "absent"]}).withColumn("id", F.col("id").cast("long"))


@query("landing_rows", "SELECT r_name AS name, CAST(json_extract_string(to_json({'r_regionkey': r_regionkey, 'r_name': r_name}), '$.r_regionkey') AS INTEGER) AS raw_key FROM region")
def landing_rows(spark, d):
    return landing.stage(table(spark, d, "region"), {"name": "r_name"}).select("name", F.get_json_object("raw_data", "$.r_regionkey").cast("int").alias("raw_key"))


@query("dictionary_merge", "SELECT n_name AS word, CASE WHEN n_nationkey % 3 = 0 THEN 'stored' ELSE 'default' END AS origin FROM nation WHERE n_nationkey < 20 OR n_nationkey % 3 = 0")
def dictionary_merge(spark, d):
    n = table(spark, d, "nation")
    default = n.where("n_nationkey < 20").select(F.col("n_name").alias("word"), F.lit("default").alias("origin"))
    stored = n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("word"), F.lit("stored").alias("origin"))
    return landing.merged_dictionary(default, stored, "word")


@query("dup_24h", """SELECT event_id, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) < 86400000000, false) AS is_repeat FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def dup_24h(spark, d):
    return admission.follows_within(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "is_repeat")


@query("dup_24h_accepted", """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts), event_id) AS n FROM events),
       f AS (SELECT event_id, user_id, event_type, n, t AS last, true AS accepted FROM e WHERE n = 1
             UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.n, CASE WHEN e.t - f.last >= 86400000000 THEN e.t ELSE f.last END, e.t - f.last >= 86400000000
             FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1)
       SELECT event_id, accepted FROM f""")
def dup_24h_accepted(spark, d):
    return admission.accepted_first(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "accepted")


@query("reports_30d", """SELECT event_id, n AS n_reports, n >= 3 AS disputed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 2591999999999 PRECEDING AND CURRENT ROW) AS n
       FROM (SELECT event_id, user_id, epoch_us(ts) AS s FROM events WHERE event_type = 'error'))""")
def reports_30d(spark, d):
    return admission.reports_in(table(spark, d, "events").where("event_type = 'error'"), "user_id", "ts").select("event_id", "n_reports", "disputed")


@query("dispute_rows", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, value > 90 AS shown FROM events WHERE event_type = 'error'),
       n AS (SELECT *, lag(t, 2) OVER (PARTITION BY user_id ORDER BY t, event_id) AS f FROM e), r AS (SELECT *, coalesce(t - f < 2592000000000, false) AS enough FROM n),
       g AS (SELECT *, count(*) FILTER (NOT enough) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r)
       SELECT user_id, make_timestamp(t) AS disputed_at, make_timestamp(f) AS first_report_at, CAST(3 AS BIGINT) AS n_reports FROM (SELECT * FROM g WHERE enough AND NOT shown QUALIFY row_number() OVER (PARTITION BY user_id, run ORDER BY t, event_id) = 1)""")
def dispute_rows(spark, d):
    return admission.disputes(table(spark, d, "events").where("event_type = 'error'"), "user_id", "ts", "event_id", F.col("value") > 90)


@query("verify_state", """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value / 100 AS c FROM events WHERE event_type = 'click'),
       g AS (SELECT user_id, count(*) AS verify_count, min(CASE WHEN c >= 0.9 THEN n END) AS s FROM e GROUP BY user_id)
       SELECT user_id, CASE WHEN s IS NULL THEN 'unverified' WHEN verify_count > s THEN 'verified' ELSE 'partial' END AS status, verify_count FROM g""")
def verify_state(spark, d):
    return admission.verification(table(spark, d, "events").where("event_type = 'click'"), "user_id", "ts", "event_id", F.col("value") / 100)


@query("gate_reasons", """SELECT event_id, CASE WHEN coalesce(value / 100, 0) < 0.7 THEN 'low_confidence' WHEN k > 95 THEN 'sanity_failed' WHEN k > 90 THEN 'mass_balance' WHEN event_type = 'signup' THEN 'public_source'
       WHEN rep THEN 'duplicate' END AS reject_reason FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), ts) < 86400000000, false) AS rep FROM events)""")
def gate_reasons(spark, d):
    e = admission.follows_within(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    warn = lambda cond, kind: F.when(cond, F.struct(F.lit(kind).alias("kind")))
    warnings = F.array_compact(F.array(warn(k > 95, "negative_value"), warn((k > 90) & (k <= 95), "mass_balance_exceeded"), warn(k < 5, "calorie_deviation")))
    return e.select("event_id", admission.gate(F.col("value") / 100, warnings, F.col("event_type") == "signup", F.col("is_repeat")).alias("reject_reason"))


@query("stale_flags", "SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-01-01' AS is_stale, datediff('day', o_orderdate, TIMESTAMP '2000-01-01') AS age_days, datediff('day', o_orderdate, TIMESTAMP '2000-01-01') > 1095 AS is_expired FROM orders")
def stale_flags(spark, d):
    as_of = F.lit("2000-01-01").cast("timestamp")
    fresh = score.freshness(F.col("o_orderdate"), as_of)
    return table(spark, d, "orders").select("o_orderkey", admission.stale(F.col("o_orderdate"), as_of).alias("is_stale"), fresh["age_days"].cast("long").alias("age_days"), fresh["is_expired"].alias("is_expired"))


@query("running_total", "SELECT o_orderkey, floor(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) * 100 + 0.5) / 100 AS spent FROM orders")
def running_total(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_orderkey", _cents(F.sum("o_totalprice").over(w)).alias("spent"))
