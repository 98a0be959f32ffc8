"""Filters, joins, aggregates, window-like, set and merge operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.operators import components as cc
from placelens.operators import publish, quality, sessions
from placelens.operators import relational as R
from placelens.plans.base import sessions as session_events
from placelens.plans.base import table
from placelens.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()
c = F.col


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('', 'BUILDING') THEN 'none' ELSE c_mktsegment END AS segment FROM customer")
def null_token_cleanup(spark, d):
    from placelens.functions.text import blank_to_null

    return table(spark, d, "customer").select("c_custkey", F.coalesce(blank_to_null(c("c_mktsegment"), "BUILDING"), F.lit("none")).alias("segment"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus LIKE 'O%' THEN false END AS done FROM orders")
def tri_state_flag(spark, d):
    from placelens.functions.text import tri_state

    return table(spark, d, "orders").select("o_orderkey", tri_state(c("o_orderstatus"), "F", "O").alias("done"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a%' AND regexp_matches(p_brand, '\\d') AND p_type ILIKE '%s%' AND substr(p_brand, 1, 1) NOT IN ('S', 'W')")
def predicate_mix(spark, d):
    p = table(spark, d, "part")
    return p.where(F.lower("p_name").contains("a") & c("p_brand").rlike(r"\d") & c("p_type").ilike("%s%") & ~F.substring("p_brand", 1, 1).isin("S", "W")).select("p_partkey", "p_name")


@query("SELECT doc_id, list_has_any(string_split(lower(text), ' '), ['the', 'der', 'les']) AS hit, list_contains(string_split(lower(text), ' '), 'of') AS has_of FROM documents")
def array_overlap_membership(spark, d):
    words = F.split(F.lower("text"), " ")
    return table(spark, d, "documents").select("doc_id", F.arrays_overlap(words, F.array(F.lit("the"), F.lit("der"), F.lit("les"))).alias("hit"), F.array_contains(words, "of").alias("has_of"))


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R') OR o_orderpriority = '1-URGENT'")
def exists_or_kind(spark, d):
    o = table(spark, d, "orders")
    has = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey")).distinct().withColumn("has", F.lit(True))
    return o.join(has, "o_orderkey", "left").where(c("has").isNotNull() | (c("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def inner_join_chain(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return table(spark, d, "customer").join(n, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def left_join_filtered_right(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), c("o_custkey") == c("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, CASE WHEN c_acctbal > 0 THEN c_name END, n_name) AS label, CASE WHEN s_acctbal > 0 THEN 'supplier' WHEN c_acctbal > 0 THEN 'customer' ELSE 'nation' END AS label_source FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def coalesce_with_provenance(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "supplier"), c("s_suppkey") == c("c_custkey"), "left").join(table(spark, d, "nation"), c("n_nationkey") == c("c_nationkey"), "left")
    label = [("supplier", F.when(c("s_acctbal") > 0, c("s_name"))), ("customer", F.when(c("c_acctbal") > 0, c("c_name"))), ("nation", c("n_name"))]
    return j.select("c_custkey", *R.coalesce_with_source(label=label))


@query("SELECT c_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def lateral_min_max(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))
    return table(spark, d, "customer").join(o, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", "first_order", "last_order")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_returnflag = 'R' OR NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_returnflag = 'R')")
def delete_with_sibling(spark, d):
    return R.delete_siblings(table(spark, d, "lineitem"), ["l_orderkey"], c("l_returnflag") == "R").select("l_orderkey", "l_linenumber")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 1000")
def self_pairs_in_block(spark, d):
    s = table(spark, d, "supplier")
    a, b = s.select(c("s_suppkey").alias("a"), "s_nationkey", c("s_acctbal").alias("x")), s.select(c("s_suppkey").alias("b"), "s_nationkey", c("s_acctbal").alias("y"))
    return a.join(b, "s_nationkey").where((c("a") < c("b")) & (F.abs(c("x") - c("y")) < 1000)).select("a", "b")


@query("SELECT coalesce(o_orderpriority, '--TOTAL--') AS o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority)")
def rollup_total(spark, d):
    return R.rollup_counts(table(spark, d, "orders"), "o_orderpriority")


@query("SELECT r_name, n_name, CAST(grouping(r_name, n_name) AS BIGINT) AS level, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_levels(spark, d):
    return R.rollup_marked(inner_join_chain(spark, d), ["r_name", "n_name"])


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, count(*) FILTER (WHERE l_linestatus = 'O') AS open FROM lineitem GROUP BY 1")
def filtered_counts(spark, d):
    return R.count_filters(table(spark, d, "lineitem"), ["l_returnflag"], {"discounted": c("l_discount") > 0.05, "open": c("l_linestatus") == "O"})


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 100000) AS big_customers, count(DISTINCT (o_custkey, o_orderpriority)) AS pairs FROM orders GROUP BY 1")
def filtered_distinct_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct(F.when(c("o_totalprice") > 100000, c("o_custkey"))).alias("big_customers"), F.count_distinct(F.struct("o_custkey", "o_orderpriority")).alias("pairs"))


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_r, bool_or(l_returnflag = 'A') AS any_a, max(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS max_f FROM lineitem GROUP BY 1")
def one_hot_flags(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(c("l_returnflag") == "R").alias("any_r"), F.bool_or(c("l_returnflag") == "A").alias("any_a"), F.max(F.when(c("l_linestatus") == "F", c("l_quantity"))).alias("max_f"))


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1 HAVING count(*) > 2 AND string_agg(n_name, ',') ILIKE '%a%'")
def ordered_string_agg(spark, d):
    g = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"), F.count("*").alias("n"))
    return g.where("n > 2").select("n_regionkey", F.array_join(c("l.n_name"), "|").alias("names")).where(c("names").ilike("%a%"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def distinct_on(spark, d):
    return R.distinct_on(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank, n > 3 AS overflow FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE rank <= 3")
def top_k_with_overflow(spark, d):
    return R.top_k(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank", "overflow")


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def unnest_count(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, round(avg(l_quantity), 4) AS mean, round(median(l_extendedprice), 4) AS median, max(l_quantity) AS top FROM lineitem GROUP BY 1")
def mean_median(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 4).alias("mean"), F.round(F.median("l_extendedprice"), 4).alias("median"), F.max("l_quantity").alias("top"))


@query("SELECT c_mktsegment, n, round(100.0 * n / sum(n) OVER (), 1) AS pct FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def percent_of_total(spark, d):
    return R.share_of_total(table(spark, d, "customer"), "c_mktsegment")


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def frequency_pivot(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0).toDF("o_custkey", "f", "o", "p")


@query("SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, CASE WHEN count(DISTINCT l_returnflag) = 3 THEN 'all' ELSE 'some' END AS tier FROM lineitem GROUP BY 1")
def set_union_classify(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("s"))
    return g.select("l_suppkey", F.array_join("s", ",").alias("flags"), F.when(F.size("s") == 3, "all").otherwise("some").alias("tier"))


@query("SELECT c_custkey, c_nationkey, n AS uses FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE n > 5")
def sharing_counts(spark, d):
    return R.shared_values(table(spark, d, "customer"), "c_custkey", "c_nationkey", 5)


@query("""WITH f AS (SELECT c_nationkey AS k, unnest([CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END]) AS rule FROM customer)
SELECT t.k, r.rule, t.n - coalesce(m, 0) AS present, round(100.0 * (t.n - coalesce(m, 0)) / t.n, 1) AS pct FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) t
CROSS JOIN (VALUES ('balance'), ('segment')) r(rule) LEFT JOIN (SELECT k, rule, count(*) AS m FROM f GROUP BY 1, 2) x ON x.k = t.k AND x.rule = r.rule""")
def coverage_by_field(spark, d):
    cust = table(spark, d, "customer").withColumn("k", c("c_nationkey"))
    broken = quality.violations(cust.select("k", "c_acctbal", "c_mktsegment"), "k", {"balance": c("c_acctbal") < 0, "segment": c("c_mktsegment") == "BUILDING"})
    return R.coverage(cust.groupBy("k").agg(F.count("*").alias("total")), broken, "k", "rule", ["balance", "segment"])


@query("SELECT l_orderkey, l_linenumber, l_quantity, least(l_quantity, greatest(0, 60 - coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS used FROM lineitem")
def running_pool(spark, d):
    return R.pool_depletion(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", F.lit(60.0)).select("l_orderkey", "l_linenumber", "l_quantity", "used")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, o_totalprice AS t, floor(o_totalprice * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) * 100 + 0.5) / 100 AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1 AS last FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, round(CASE WHEN last THEN t - sum(CASE WHEN last THEN 0 ELSE part END) OVER (PARTITION BY l_orderkey) ELSE part END, 2) AS share FROM p""")
def allocation_with_remainder(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), c("o_orderkey") == c("l_orderkey"))
    return R.allocate_with_remainder(j, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", c("o_totalprice")).select("l_orderkey", "l_linenumber", "share")


@query("""WITH s AS (SELECT o_orderkey, m, (year(o_orderdate) * 12 + month(o_orderdate) + m) % 5 = 0 AS on FROM orders, unnest(range(0, 13)) t(m))
SELECT a.o_orderkey, CAST(min(b.m) AS INT) AS at, arg_min(b.on, b.m) AS becomes FROM s a JOIN s b ON a.o_orderkey = b.o_orderkey AND a.m = 0 AND b.on <> a.on GROUP BY 1""")
def timeline_transition(spark, d):
    s = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("m"))
    s = s.withColumn("on", (F.year("o_orderdate") * 12 + F.month("o_orderdate") + c("m")) % 5 == 0)
    return R.first_transition(s, "o_orderkey", "m", "on")


@query("SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region UNION ALL SELECT s_name, 'supplier' FROM supplier")
def union_of_phases(spark, d):
    parts = [table(spark, d, t).select(c(f"{t[0]}_name").alias("name"), F.lit(t).alias("kind")) for t in ("nation", "region", "supplier")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), string_split(p_type, ' '))) > 0 AS meets, len(list_distinct(string_split(p_name, ' '))) AS n_words FROM part")
def array_intersect(spark, d):
    a, b = F.split("p_name", " "), F.split("p_type", " ")
    return table(spark, d, "part").select("p_partkey", (F.size(F.array_intersect(a, b)) > 0).alias("meets"), F.size(F.array_distinct(a)).cast("long").alias("n_words"))


@query("""WITH m AS (SELECT DISTINCT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)
SELECT 'customers_order' AS "check", (SELECT count(*) FROM m) AS n_missing, CASE WHEN (SELECT count(*) FROM m) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, coalesce((SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT CAST(k AS VARCHAR) AS s FROM m ORDER BY k LIMIT 10)), '') AS sample""")
def set_difference_check(spark, d):
    return R.set_check(table(spark, d, "customer").select(c("c_custkey").alias("k")), table(spark, d, "orders").select(c("o_custkey").alias("k")), ["k"], "customers_order")


@query("SELECT c_custkey, CASE WHEN o.t IS NULL THEN c_acctbal ELSE o.t END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS t FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def update_from_join(spark, d):
    o = table(spark, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("t"))
    return R.update_from(table(spark, d, "customer"), o, ["c_custkey"], "c_acctbal", "t").select("c_custkey", "c_acctbal")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation WHERE n_nationkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, c_name FROM customer")
def upsert_last_wins(spark, d):
    base = table(spark, d, "nation").select(c("n_nationkey").cast("long").alias("k"), c("n_name").alias("v"))
    new = table(spark, d, "customer").select(c("c_custkey").alias("k"), c("c_name").alias("v"))
    return R.upsert(base, new, ["k"], c("v"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation)")
def insert_ignore_first_wins(spark, d):
    base = table(spark, d, "nation").select(c("n_nationkey").cast("long").alias("k"), c("n_name").alias("v"))
    new = table(spark, d, "customer").select(c("c_custkey").alias("k"), c("c_name").alias("v"))
    return R.insert_ignore(base, new, ["k"], c("v"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) + (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def richest_first(spark, d):
    o = table(spark, d, "orders").withColumn("a", F.when(c("o_totalprice") > 100000, 1)).withColumn("b", F.when(c("o_orderstatus") == "F", 1))
    return R.richest_first(o, ["o_custkey"], ["a", "b"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderpriority, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS price, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS state FROM orders)
SELECT o_custkey, arg_min(price, o_orderkey) FILTER (WHERE price IS NOT NULL) AS price, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE price IS NOT NULL) AS price_source, arg_min(state, o_orderkey) FILTER (WHERE state IS NOT NULL) AS state, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE state IS NOT NULL) AS state_source FROM s GROUP BY 1""")
def resolve_by_priority(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.when(c("o_totalprice") > 50000, c("o_totalprice")).alias("price"), F.when(c("o_orderstatus") != "O", c("o_orderstatus")).alias("state"))
    return R.resolve_by_priority(o, "o_custkey", "o_orderkey", "o_orderpriority", ["price", "state"])


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 50")
def page_of_rows(spark, d):
    return R.paginate(table(spark, d, "customer"), [F.desc("c_acctbal"), F.asc("c_custkey")], 1).select("c_custkey", "c_name")


@query("""WITH RECURSIVE n AS (SELECT s_suppkey AS id, s_nationkey % 7 AS a, CAST(floor(s_acctbal / 100) AS BIGINT) AS b FROM supplier),
e AS (SELECT x.id AS u, y.id AS v FROM n x JOIN n y ON x.id <> y.id AND (x.a = y.a AND x.a < 3 OR x.b = y.b)),
r AS (SELECT id, id AS c FROM n UNION SELECT r.id, e.v FROM r JOIN e ON r.c = e.u)
SELECT id, min(c) AS component FROM r GROUP BY 1""")
def connected_components(spark, d):
    n = table(spark, d, "supplier").select(c("s_suppkey").alias("id"), F.when(c("s_nationkey") % 7 < 3, c("s_nationkey") % 7).alias("a"), F.floor(c("s_acctbal") / 100).alias("b"))
    return cc.components(n, cc.key_edges(n, "id", ["a", "b"]))


@query("""WITH s AS (SELECT *, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id FROM events),
g AS (SELECT session_id, count(*) AS n_events, count(DISTINCT event_type) AS n_kinds, CAST(count_if(event_type = 'view') AS BIGINT) AS n_view, CAST(count_if(event_type = 'click') AS BIGINT) AS n_click, CAST(count_if(event_type = 'purchase') AS BIGINT) AS n_purchase,
 CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS seconds, arg_min(event_type, (ts, event_id)) AS first_kind, arg_max(event_type, (ts, event_id)) AS last_kind,
 CAST(max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END) AS BIGINT) AS furthest_step, round(avg(value), 4) AS mean_value, round(median(value), 4) AS median_value, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM s GROUP BY 1),
k AS (SELECT session_id, event_type, count(*) AS n, min((ts, event_id)) AS first_at FROM s GROUP BY 1, 2), m AS (SELECT session_id, event_type AS top_kind FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first_at) AS r FROM k) WHERE r = 1)
SELECT g.*, top_kind FROM g JOIN m ON g.session_id = m.session_id""")
def session_features(spark, d):
    return sessions.session_features(session_events(spark, d), ["view", "click", "purchase"])


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n_events FROM s GROUP BY user_id, k""")
def gap_sessions(spark, d):
    return sessions.gap_sessions(table(spark, d, "events"), "user_id")


@query("""SELECT rule, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (WHERE r <= 3) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY o_orderkey) AS r FROM
(SELECT o_orderkey, unnest([CASE WHEN o_totalprice < 10000 THEN 'cheap' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN year(o_orderdate) < 1993 THEN 'old' END]) AS rule FROM orders) WHERE rule IS NOT NULL) GROUP BY 1""")
def rule_violations(spark, d):
    o = table(spark, d, "orders")
    return quality.summary(quality.violations(o, "o_orderkey", {"cheap": c("o_totalprice") < 10000, "pending": c("o_orderstatus") == "P", "old": F.year("o_orderdate") < 1993}), "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 5 <> 0 THEN c_name END AS c_name, CASE WHEN c_nationkey % 5 = 0 THEN 'AB1' ELSE 'AB1 2CD' END AS postcode FROM customer")
def privacy_masking(spark, d):
    cust = table(spark, d, "customer").withColumn("postcode", F.lit("AB1 2CD"))
    return publish.mask(cust, c("c_nationkey") % 5 == 0, ["c_name"], "postcode").select("c_custkey", "c_name", "postcode")


@query("""SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"' || coalesce(',"items":[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']', '') || '}' AS doc
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def nested_documents(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return publish.nested_documents(table(spark, d, "customer").select("c_custkey", "c_name"), o, "c_custkey", ["o_orderkey", "o_orderstatus"], "o_orderkey")


@query("SELECT c_custkey, c_nationkey, CAST(list_position(w, c_mktsegment) - 1 AS BIGINT) AS index FROM customer JOIN (SELECT c_nationkey AS k, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS w FROM customer GROUP BY 1) ON k = c_nationkey")
def local_dictionary(spark, d):
    return publish.dictionary_encode(table(spark, d, "customer"), "c_nationkey", "c_mktsegment").select("c_custkey", "c_nationkey", "index")


@query("SELECT s_nationkey, min(s_acctbal) AS low, max(s_acctbal) AS high, count(*) AS n FROM supplier GROUP BY 1")
def envelope(spark, d):
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, kind, amount FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) ON quantity, discount, tax INTO NAME kind VALUE amount)")
def unpivot_fees(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c("l_quantity").alias("quantity"), c("l_discount").alias("discount"), c("l_tax").alias("tax"))
    return own.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "kind", "amount")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k > 50")
