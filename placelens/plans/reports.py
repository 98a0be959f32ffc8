"""Look-ups, cross-filters, folds, scores and household sums over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.operators import decisions, indexed, publish, relational, resolve
from placelens.operators import reporting as R
from placelens.plans.base import PROVIDERS_SQL, from_sql, providers, table
from placelens.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()
c = F.col


@query("""SELECT c_custkey, coalesce(s.v, n.v, r.v) AS v, CASE WHEN s.v IS NOT NULL THEN 'postcode' WHEN n.v IS NOT NULL THEN 'district' WHEN r.v IS NOT NULL THEN 'area' END AS v_source FROM customer
 LEFT JOIN (SELECT s_suppkey AS k, min(s_name) AS v FROM supplier GROUP BY 1) s ON s.k = c_custkey LEFT JOIN (SELECT n_nationkey AS k, CASE WHEN n_regionkey < 2 THEN n_name END AS v FROM nation) n ON n.k = c_nationkey LEFT JOIN (SELECT 'BUILDING' AS k, 'built' AS v) r ON r.k = c_mktsegment""")
def lookup_cascade(spark, d):
    steps = [
        ("postcode", table(spark, d, "supplier").select(c("s_suppkey").alias("c_custkey"), c("s_name").alias("v")), ["c_custkey"]),
        ("district", table(spark, d, "nation").select(c("n_nationkey").alias("c_nationkey"), F.when(c("n_regionkey") < 2, c("n_name")).alias("v")), ["c_nationkey"]),
        ("area", spark.sql("SELECT 'BUILDING' AS c_mktsegment, 'built' AS v"), ["c_mktsegment"]),
    ]
    return resolve.cascade(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), steps, "v").select("c_custkey", "v", "v_source")


@query("SELECT l_orderkey, l_linenumber, o_orderkey * 10 AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def surrogate_remap(spark, d):
    o = table(spark, d, "orders")
    old = o.select(c("o_orderkey").alias("id"), "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")
    new = o.select((c("o_orderkey") * 10).alias("id"), "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")
    rows = table(spark, d, "lineitem").select(c("l_orderkey").alias("id"), "l_orderkey", "l_linenumber")
    return resolve.remapped(rows, old, new, "id", ["o_custkey", "o_orderdate", "o_totalprice", "o_orderkey"])


@query("SELECT n_nationkey, n_regionkey, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT s_nationkey, s_nationkey % 5 AS r, count(*) AS n FROM supplier GROUP BY 1, 2) ON s_nationkey = n_nationkey AND r = n_regionkey")
def composite_key_onto_all(spark, d):
    s = table(spark, d, "supplier").groupBy(c("s_nationkey").alias("n_nationkey"), (c("s_nationkey") % 5).alias("n_regionkey")).agg(F.count("*").alias("n"))
    return resolve.onto_all(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), s, ["n_nationkey", "n_regionkey"], {"n": 0})


@query("""WITH l AS (SELECT c_custkey AS id, c_nationkey AS b, c_custkey % 40 AS u, c_acctbal AS x FROM customer), r AS (SELECT s_suppkey AS match_id, s_nationkey AS b, CASE WHEN s_suppkey < 30 THEN s_suppkey END AS u, s_acctbal AS y FROM supplier),
one AS (SELECT id, min(match_id) AS match_id, 1 AS level FROM l JOIN r USING (u) GROUP BY 1), two AS (SELECT id, match_id, 2 AS level FROM (SELECT id, match_id, row_number() OVER (PARTITION BY id ORDER BY abs(x - y), match_id) AS n FROM l JOIN r USING (b) WHERE abs(x - y) <= 500 AND id NOT IN (SELECT id FROM one)) WHERE n = 1)
SELECT * FROM one UNION ALL SELECT * FROM two""")
def two_level_match(spark, d):
    left = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_nationkey").alias("b"), (c("c_custkey") % 40).alias("u"), c("c_acctbal").alias("x"))
    right = table(spark, d, "supplier").select(c("s_suppkey").alias("match_id"), c("s_nationkey").alias("b"), F.when(c("s_suppkey") < 30, c("s_suppkey")).alias("u"), c("s_acctbal").alias("y"))
    return resolve.two_level_match(left, right, "u", "b", -F.abs(c("x") - c("y")), -500)


@query("""SELECT o_custkey, arg_max(r, o_orderkey) FILTER (WHERE r IS NOT NULL AND f = 'F') AS "F", arg_max(r, o_orderkey) FILTER (WHERE r IS NOT NULL AND f = 'O') AS "O", arg_max(r, o_orderkey) FILTER (WHERE r IS NOT NULL AND f = 'P') AS "P" FROM (SELECT o_custkey, o_orderkey, o_orderstatus AS f, CASE WHEN o_totalprice > 90000 THEN o_totalprice END AS r FROM orders) GROUP BY 1""")
def cost_columns(spark, d):
    rate = F.when(c("o_totalprice") > 90000, c("o_totalprice"))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", *(F.when(c("o_orderstatus") == f, rate).alias(f) for f in "FOP"))
    return resolve.later_non_null(rows, ["o_custkey"], "o_orderkey", ["F", "O", "P"])


@query("SELECT o_custkey, CAST(sum(n) OVER (ORDER BY o_custkey) - n AS BIGINT) AS first, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def row_ranges(spark, d):
    return indexed.row_ranges(table(spark, d, "orders"), "o_custkey").select("o_custkey", c("first").cast("long").alias("first"), "n")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 7.5 WHEN s IS NOT NULL THEN s ELSE 0 END AS amount, CASE WHEN c_custkey % 3 = 0 THEN 'provider' WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'provider_band' WHEN s IS NOT NULL THEN 'area' ELSE 'none' END AS source
FROM customer LEFT JOIN (SELECT s_nationkey, max(CASE WHEN s_acctbal > 5000 THEN s_acctbal END) AS s FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey""")
def fee_resolution(spark, d):
    area = table(spark, d, "supplier").groupBy(c("s_nationkey").alias("c_nationkey")).agg(F.max(F.when(c("s_acctbal") > 5000, c("s_acctbal"))).alias("s"))
    k = c("c_custkey")
    own, band = F.when(k % 3 == 0, c("c_acctbal")), F.when((k % 3 == 1) & (k % 2 == 0), 7.5)
    return table(spark, d, "customer").join(area, "c_nationkey", "left").select("c_custkey", resolve.fee(own, band, c("s")).alias("f")).select("c_custkey", "f.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'report_card' WHEN o_orderkey % 5 = 0 THEN 'legacy' WHEN o_orderkey % 3 = 0 THEN 'early_years' WHEN o_orderkey % 2 = 0 THEN 'ungraded' ELSE 'legacy_transition' END AS framework FROM orders")
def inspection_framework(spark, d):
    k = c("o_orderkey")
    has = lambda n: F.when(k % n == 0, F.lit("x"))
    return table(spark, d, "orders").select("o_orderkey", resolve.inspection_framework(has(7), has(5), has(3), has(2)).alias("framework"))


@query("""SELECT c_custkey FROM customer WHERE coalesce(CASE WHEN c_nationkey % 4 <> 0 THEN CAST(c_nationkey AS VARCHAR) END, '(no LA)') IN ('(no LA)', '7', '11') AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def cross_filter(spark, d):
    cust = table(spark, d, "customer").withColumn("la", F.when(c("c_nationkey") % 4 != 0, c("c_nationkey")))
    orders = table(spark, d, "orders").select(c("o_custkey").alias("c_custkey"), "o_orderstatus")
    return R.cross_filter(cust, {"la": [R.NO_AREA, "7", "11"], "c_mktsegment": ["BUILDING", "MACHINERY"]}, (orders.where("o_orderstatus = 'F'"), ["c_custkey"]), (orders.where("o_orderstatus = 'P'"), ["c_custkey"])).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '#00000012') OR c_custkey IN (SELECT o_custkey FROM orders WHERE contains(lower(o_orderpriority), '1-urg'))")
def header_text_filter(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    cust = table(spark, d, "customer")
    by_name = R.text_filter(cust, "#00000012", ["c_name", "c_mktsegment"], orders, "c_custkey", ["o_orderstatus"])
    by_child = R.text_filter(cust, "1-URG", ["c_name"], orders, "c_custkey", ["o_orderpriority"])
    return by_name.union(by_child).select("c_custkey").distinct()


@query(f"""WITH p AS ({PROVIDERS_SQL}) SELECT area, greatest(0, total - seen) AS missing FROM (SELECT area, CAST(sum(provider_id % 2) AS BIGINT) AS total, count(*) FILTER (WHERE bbox_south BETWEEN 51 AND 52) AS seen FROM p GROUP BY 1)""")
def missing_boxes(spark, d):
    own = providers(spark, d)
    return R.missing_boxes(own.select("area", (c("provider_id") % 2).alias("box_only")), own.where("bbox_south between 51 and 52"), "area")


@query("SELECT o_orderpriority, CASE WHEN count(a) > 0 AND count(b) > 0 AND count(p) > 0 THEN round((avg(a) + avg(b) + avg(p)) / 3, 2) END AS score FROM (SELECT o_orderpriority, o_orderkey % 100 * 1.0 AS a, o_custkey % 50 * 1.0 AS b, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey % 7 * 1.0 END AS p FROM orders) GROUP BY 1")
def version_score(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", (c("o_orderkey") % 100 * 1.0).cast("double").alias("a"), (c("o_custkey") % 50 * 1.0).cast("double").alias("b"), F.when(c("o_orderpriority") != "5-LOW", (c("o_orderkey") % 7 * 1.0).cast("double")).alias("p"))
    return R.score(o, "o_orderpriority", ["a", "b", "p"])


@query("""SELECT o_orderpriority, round(100.0 * avg(ok) FILTER (WHERE o_orderstatus = 'F'), 1) AS "F", round(100.0 * avg(ok) FILTER (WHERE o_orderstatus = 'O'), 1) AS "O" FROM (SELECT *, CASE WHEN o_totalprice > 50000 THEN 1.0 ELSE 0.0 END AS ok FROM orders) GROUP BY 1""")
def version_trend(spark, d):
    return R.trend(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", F.avg((c("o_totalprice") > 50000).cast("double")), ["F", "O"])


@query("SELECT s_nationkey % 5 AS region, CAST(sum(floor(n * 100.0 / pct + 0.5)) AS BIGINT) AS total FROM (SELECT s_nationkey, s_suppkey % 20 AS n, s_suppkey % 11 * 1.0 AS pct FROM supplier) WHERE pct > 0 GROUP BY 1")
def denominators(spark, d):
    s = table(spark, d, "supplier").select((c("s_nationkey") % 5).alias("region"), (c("s_suppkey") % 20).alias("n"), (c("s_suppkey") % 11 * 1.0).cast("double").alias("pct"))
    return R.denominators(s, "region", "n", "pct")


@query("SELECT c_nationkey AS lat, c_custkey % 4 AS lon, count(*) AS n, bool_or(c_acctbal < 0) AS flag, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1, 2")
def colocated(spark, d):
    rows = table(spark, d, "customer").select(c("c_nationkey").alias("lat"), (c("c_custkey") % 4).alias("lon"), (c("c_acctbal") < 0).alias("flag"), c("c_acctbal").alias("low"), c("c_acctbal").alias("high"))
    return R.colocated(rows, "lat", "lon", "flag", "low", "high")


@query("SELECT r_name, max(n_nationkey) AS high, min(n_nationkey) AS low, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def district_fold(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return n.groupBy("r_name").agg(F.max("n_nationkey").alias("high"), F.min("n_nationkey").alias("low"), F.count("*").alias("n"))


@query("SELECT c_mktsegment, place, CAST(row_number() OVER (ORDER BY place, c_mktsegment = 'BUILDING', c_mktsegment) AS BIGINT) AS bar FROM (SELECT DISTINCT c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END AS place FROM customer)")
def ordered_categories(spark, d):
    from pyspark.sql import Window

    kinds = table(spark, d, "customer").select("c_mktsegment").distinct().withColumn("place", R.ranked_categories("c_mktsegment", ["MACHINERY", "BUILDING"]).cast("int"))
    return kinds.withColumn("bar", F.row_number().over(Window.orderBy("place", *R.last_of_order("c_mktsegment", "BUILDING"))).cast("long"))


@query("""SELECT 'orders' AS "check", (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS n_missing, CASE WHEN (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
UNION ALL SELECT 'customers', n, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))""")
def subset_checks(spark, d):
    cust, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    return R.subset_checks([("orders", o.select("o_custkey"), cust), ("customers", cust, o.where("o_orderstatus = 'F'").select("o_custkey"))])


@query("SELECT c_custkey, concat_ws('|', CASE WHEN NOT c_acctbal > 0 THEN 'balance' END, CASE WHEN c_nationkey < 10 THEN 'nation' END, 'never') AS steps FROM customer")
def invalid_steps(spark, d):
    steps = {"balance": c("c_acctbal") > 0, "nation": c("c_nationkey") >= 10, "never": F.lit(None).cast("boolean"), "always": F.lit(True)}
    return table(spark, d, "customer").select("c_custkey", F.array_join(R.invalid_steps(steps), "|").alias("steps"))


@query("SELECT p_partkey, concat_ws('|', 'childminder', CASE WHEN m < 60 THEN 'private_nursery' END, CASE WHEN m BETWEEN 24 AND 59 THEN 'school_based_nursery' END, CASE WHEN m >= 48 THEN 'breakfast_club' END, CASE WHEN m >= 48 THEN 'after_school_club' END) AS kinds FROM (SELECT p_partkey, p_size * 2 AS m FROM part)")
def available_types(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(R.available_types(c("p_size") * 2), "|").alias("kinds"))


@query("""WITH x AS (SELECT c_nationkey AS area, c_mktsegment AS g, 'p' || c_custkey % 3 AS p, round(avg(c_custkey % 97), 2) AS cost FROM customer GROUP BY 1, 2, 3),
y AS (SELECT area, g, '{' || string_agg('"' || p || '":' || CAST(cost AS VARCHAR), ',' ORDER BY p) || '}' AS v FROM x GROUP BY 1, 2) SELECT area, '{' || string_agg('"' || g || '":' || v, ',' ORDER BY g) || '}' AS doc FROM y GROUP BY 1""")
def area_documents(spark, d):
    cust = table(spark, d, "customer").select(c("c_nationkey").alias("area"), c("c_mktsegment").alias("g"), F.concat(F.lit("p"), c("c_custkey") % 3).alias("p"), (c("c_custkey") % 97).cast("double").alias("v"))
    return R.area_documents(cust, "area", "g", "p", "v")


@query("""WITH x AS (SELECT l_orderkey AS family, l_linenumber AS child, l_extendedprice AS g, CASE WHEN l_discount > 0.05 THEN l_extendedprice * 2 ELSE 10 END AS s FROM lineitem), y AS (SELECT family, child, sum(g) AS g, sum(s) AS s FROM x GROUP BY 1, 2)
SELECT family, child, round(g, 2) AS gross, round(s, 2) AS support, round(greatest(g - s, 0), 2) AS net FROM (SELECT family, child, g, s FROM y UNION ALL SELECT family, NULL, sum(g), sum(s) FROM y GROUP BY 1)""")
def household_totals(spark, d):
    rows = table(spark, d, "lineitem").select(c("l_orderkey").alias("family"), c("l_linenumber").alias("child"), c("l_extendedprice").alias("g"), F.when(c("l_discount") > 0.05, c("l_extendedprice") * 2).otherwise(10.0).alias("s"))
    return R.household_totals(rows, "family", "child", "g", "s")


@query("""SELECT id, CASE k WHEN 0 THEN 'all' ELSE 'under2' END AS band, 'per_hour' AS period, a * 1.0 AS amount FROM (SELECT c_custkey AS id, c_custkey % 4 AS k, c_custkey % 10 AS a FROM customer) WHERE k IN (0, 1) UNION ALL SELECT c_custkey, 'age2', 'per_day', 50.5 FROM customer WHERE c_custkey % 4 = 1""")
def fee_rows(spark, d):
    rows = from_sql(spark, d, "SELECT c_custkey AS id, c_custkey % 4 AS k, c_custkey % 10 AS a FROM customer", "customer")
    fees = F.expr("""CASE k WHEN 0 THEN concat('{"per_hour":', a, '}') WHEN 1 THEN concat('{"under2":{"per_hour":', a, '},"age2":{"per_day":50.5},"other":{"per_day":1}}') WHEN 2 THEN 'broken' END""")
    return R.fee_rows(rows.withColumn("fees", fees), "id", "fees", ["under2", "age2"])


@query("SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS place FROM customer")
def numbered_from_zero(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "customer").select("c_custkey", (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("long").alias("place"))


@query("SELECT o_orderstatus, count(DISTINCT (o_custkey, o_orderpriority)) FILTER (WHERE o_totalprice > 100000) AS pairs FROM orders GROUP BY 1")
def filtered_distinct_pairs(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct(F.when(c("o_totalprice") > 100000, F.struct("o_custkey", "o_orderpriority"))).alias("pairs"))


@query("SELECT event_id, event_type IN ('view', 'click') AS has FROM events")
def json_containment(spark, d):
    sources = F.from_json(F.concat(F.lit('["view","click","'), c("event_type"), F.lit('x"]')), "array<string>")
    return table(spark, d, "events").select("event_id", F.array_contains(sources, c("event_type")).alias("has"))


@query("SELECT k, kind FROM (SELECT c_custkey AS k, 'box' AS kind, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, 'point', s_acctbal FROM supplier) ORDER BY v DESC, kind, k LIMIT 100")
def merged_sorted_lists(spark, d):
    box = table(spark, d, "customer").select(c("c_custkey").alias("k"), F.lit("box").alias("kind"), c("c_acctbal").alias("v"))
    point = table(spark, d, "supplier").select(c("s_suppkey").alias("k"), F.lit("point").alias("kind"), c("s_acctbal").alias("v"))
    return box.union(point).orderBy(F.desc("v"), "kind", "k").limit(100).select("k", "kind")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def top_unmatched(spark, d):
    matched = table(spark, d, "orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(matched, "c_custkey", "left_anti").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey")


@query("SELECT k FROM (SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier UNION SELECT o_custkey FROM orders)")
def union_of_three(spark, d):
    return table(spark, d, "customer").select(c("c_custkey").alias("k")).union(table(spark, d, "supplier").select("s_suppkey")).union(table(spark, d, "orders").select("o_custkey")).distinct()


@query("SELECT c_custkey, 'b|a|' || CAST(c_nationkey AS VARCHAR) AS kept FROM customer")
def distinct_in_order(spark, d):
    n = c("c_nationkey").cast("string")
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.array_distinct(F.array(F.lit("b"), F.lit("a"), F.lit("b"), n, n, F.lit("a"))), "|").alias("kept"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS c_custkey, row_number() OVER (ORDER BY n_name) AS place FROM nation JOIN customer ON c_custkey = n_nationkey")
def shortlist(spark, d):
    """Customers on a list, in the list's order."""
    from pyspark.sql import Window

    listed = table(spark, d, "nation").select(c("n_nationkey").cast("long").alias("c_custkey"), "n_name")
    kept = table(spark, d, "customer").select("c_custkey").join(listed, "c_custkey")
    return kept.select("c_custkey", F.row_number().over(Window.orderBy("n_name")).cast("long").alias("place"))


@query("SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS decoded FROM customer GROUP BY 1")
def decoded_dictionary(spark, d):
    coded = publish.dictionary_encode(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")
    rows = coded.groupBy("c_nationkey", "dictionary").agg(F.array_sort(F.collect_set("index")).alias("at"))
    return rows.select("c_nationkey", F.array_join(publish.decode_indices(c("dictionary"), F.concat("at", F.array(F.lit(99), F.lit(-1)))), "|").alias("decoded"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'primary' WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 1 THEN 'academy' WHEN c_custkey % 5 = 0 THEN 'minder' WHEN c_custkey % 2 = 1 AND c_nationkey < 5 THEN 'club' WHEN c_mktsegment = 'BUILDING' THEN 'nursery' ELSE 'unknown' END AS kind FROM customer""")
def institution_types(spark, d):
    k = c("c_custkey")
    tables = {"phase": {"Primary": "primary"}, "school": {"Academy": "academy"}, "registration": {"CMR": "minder"}, "care": {"BUILDING": "nursery"}}
    name = F.when(c("c_nationkey") < 5, "Kids Club").otherwise("Oak")
    kind = decisions.institution_type(F.when(k % 3 == 0, "Primary"), F.when(k % 3 == 1, "Academy"), F.when(k % 5 == 0, "CMR"), name, c("c_mktsegment"), k % 2 == 0, tables, [("Club", "club")])
    return table(spark, d, "customer").select("c_custkey", kind.alias("kind"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AND c_nationkey < 5 AS insufficient FROM customer")
def insufficient_records(spark, d):
    name = F.when(c("c_custkey") % 4 == 0, "REDACTED").when(c("c_custkey") % 4 == 2, "  ").otherwise(c("c_name"))
    return table(spark, d, "customer").select("c_custkey", publish.insufficient(name, [F.when(c("c_nationkey") >= 5, "x"), F.lit(None)]).alias("insufficient"))


@query("SELECT id, rule FROM (SELECT c_custkey AS id, unnest([CASE WHEN c_custkey % 3 = 0 THEN 'name' END, CASE WHEN c_nationkey < 5 THEN 'city_digits' END, CASE WHEN c_custkey % 7 = 0 THEN 'coordinates' END, CASE WHEN c_custkey % 4 = 0 THEN 'contact' END, CASE WHEN c_custkey % 5 = 0 THEN 'postcode' END]) AS rule FROM customer) WHERE rule IS NOT NULL")
def provider_rules(spark, d):
    from placelens.operators import quality

    k = c("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(k % 3 != 0, c("c_name")).alias("name"), F.when(k % 5 == 0, "nope").otherwise("M1 1AE").alias("postcode"), F.lit("1 High St").alias("address"), F.when(c("c_nationkey") < 5, "Leeds 7").otherwise("Leeds").alias("city"), F.when(k % 7 == 0, 95.0).otherwise(51.0).alias("lat"), F.lit(-1.0).alias("lon"), F.when(k % 4 != 0, "0123").alias("phone"), F.lit(None).cast("string").alias("email"))
    return quality.violations(rows, "id", quality.provider_rules(c("name"), c("postcode"), c("address"), c("city"), c("lat"), c("lon"), [c("phone"), c("email")]))


@query("SELECT o_custkey, max(o_orderkey) AS last_kept FROM orders GROUP BY 1")
def last_per_key(spark, d):
    return relational.distinct_on(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderkey")]).select("o_custkey", c("o_orderkey").alias("last_kept"))
