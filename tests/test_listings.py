"""Nulls, blanks, ties, repeated rows and empty tables of placelens.operators.listings."""

from pyspark.sql import functions as F

from placelens.functions import records
from placelens.operators import linkage
from placelens.operators import listings as L


def _got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_field_sources(spark):
    records = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    values = spark.createDataFrame([(1, "email", "b", 2), (1, "email", "a", 1), (2, "email", "b", 3), (9, "email", "z", 1)], "id int, field string, source string, i int")
    got = _got(L.field_sources(records, values, "id", ["email", "phone"], "i"))
    assert got == [("email", "a", 1, 33.3), ("email", "absent", 1, 33.3), ("email", "b", 1, 33.3), ("phone", "absent", 3, 100.0)]
    assert _got(L.field_sources(records.where("id > 9"), values, "id", ["email"], "i")) == []


def test_issues(spark):
    rows = spark.createDataFrame([(1, None, 5, "x"), (2, 9, 5, None), (3, 1, None, "y"), (3, 1, None, "y")], "id int, low int, high int, kind string")
    checks = [*L.field_checks("low", required=True, low=1, high=8), *L.field_checks("kind", allowed=["x"]), L.pair_check("low", "high")]
    found = L.issues(rows, "id", checks)
    assert _got(found) == sorted([(1, "low", "invalid_type"), (2, "low", "custom"), (2, "low", "too_big"), (3, "kind", "invalid_value"), (3, "kind", "invalid_value")], key=repr)
    assert ("kind", "invalid_value", 2, "3") in _got(L.issue_summary(found, "id", samples=1))
    assert {r["id"]: r["pass"] for r in L.validated(rows.select("id").distinct(), "id", found).collect()} == {1: False, 2: False, 3: False}
    assert _got(L.issue_summary(found.where("id > 9"), "id")) == []


def test_map_features(spark):
    care = spark.createDataFrame([(1, 1, 0, 5, False), (1, 4, 2, 9, None), (2, 2, None, None, True)], "id int, bit int, low int, high int, funded boolean")
    places = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0), (3, 4.0, 4.0), (4, None, 4.0)], "id int, lat double, lon double")
    assert _got(L.map_features(care, places, "id", "lat", "lon")) == [(1.0, 2.0, 2, 1, 7, 0, 9, True), (4.0, 4.0, 1, 3, 0, None, None, False)]


def test_fee_lines(spark):
    schema = "band string, hour double, am double, pm double, day double, session double, daily double"
    rows = [(None, 0.0, None, None, None, 0.0, 40.0), ("2 yrs", 6.5, 30.0, 30.0, None, None, None), ("3 yrs", None, None, 20.0, 55.0, 7.0, 8.0), (None, *[None] * 6)]
    got = spark.createDataFrame(rows, schema).select(L.fee_lines(*map(F.col, ("band", "hour", "am", "pm", "day", "session", "daily")))).collect()
    assert [[tuple(x) for x in r[0]] for r in got] == [
        [("Per session", "Free"), ("Per day", "£40.00")],
        [("2 yrs", "£6.50 per hour"), ("2 yrs AM", "£30.00")],
        [("3 yrs PM", "£20.00"), ("3 yrs full day", "£55.00"), ("3 yrs", "£7.00 per session"), ("3 yrs", "£8.00 per day")],
        [],
    ]


def test_forms_and_children(spark):
    none = "no_recourse_to_public_funds"
    schema = "residency string, partner_residency string, benefits array<string>, income_under int, savings_under int, credit_below boolean"
    rows = [(none, None, None, 5, None, True), (none, "citizen", ["universal_credit"], 5, 6, True), (None, None, ["universal_credit"], 5, 6, None)]
    got = L.resolved_form(spark.createDataFrame(rows, schema)).select("benefits", "income_under", "savings_under", "credit_below").collect()
    assert [tuple(r) for r in got] == [([], 5, 0, False), (["universal_credit"], 0, 0, True), (["universal_credit"], 0, 0, False)]
    children = spark.createDataFrame([(1, 1, " Ann "), (1, 2, " "), (1, 3, None), (2, 1, "")], "family int, i int, name string")
    assert _got(L.named_children(children, "family", "i", "name")) == [(1, 1, "Ann"), (1, 2, "Child 2"), (1, 3, "Child 3"), (2, 1, "Child 1")]


def test_study_support(spark):
    schema = "family int, i int, bracket string, studying boolean, level string, apprentice boolean, funded boolean, full_time boolean, finance boolean, resident boolean, in_england boolean"
    rows = [
        (1, 1, "16-17", True, "further_education", False, False, None, None, True, True),  # the first who fits is judged
        (1, 2, "18-20", True, "further_education", False, True, None, None, True, True),
        (2, 1, "21+", True, "higher_education", False, True, True, True, True, True),
        (3, 1, "18-20", True, "school_sixth_form", False, True, None, None, True, False),
        (4, 1, None, None, None, None, None, None, None, None, None),
    ]
    assert _got(L.study_support(spark.createDataFrame(rows, schema), "family", "i")) == [(1, False, True, False), (2, False, False, True), (3, False, False, False), (4, False, False, False)]
    wages = spark.createDataFrame([("21+", False, "month"), ("21+", True, "week"), (None, False, "year"), ("18-20", None, "other")], "b string, a boolean, p string")
    assert [r[0] for r in wages.select(L.minimum_wage(F.col("b"), F.col("a"), F.col("p"))).collect()] == [881.23, 128.0, None, None]


def test_labels_and_checks(spark):
    rows = spark.createDataFrame([(1, "Oak School"), (1, None), (2, "x"), (None, "x")], "layer int, name string")
    label = L.layer_label(F.col("layer"), F.col("name"), {1: "School", 2: "Club"}, {1: "Nursery"}, "School")
    assert [r[0] for r in rows.select(label).collect()] == ["School", "Nursery", "Club", None]
    assert [r[0] for r in spark.createDataFrame([("a", "b"), (" ", "b"), (None, "")], "n string, p string").select(L.report_status(F.col("n"), F.col("p"))).collect()] == ["success", "partial", "not_published"]
    pairs = spark.createDataFrame([("£6", "(Day):"), ("Oak", "- Leeds"), ("a", "b"), (None, None)], "l string, v string")
    assert [tuple(r[0]) for r in pairs.select(L.triaged(F.col("l"), F.col("v"))).collect()] == [("fee", "£6 (Day)"), ("school", "Oak - Leeds"), ("pair", "b"), ("pair", None)]
    shapes = spark.createDataFrame([("E1", "a", "g"), ("E2", " ", "g"), (None, "a", None)], "code string, name string, shape string")
    assert _got(L.boundary_checks(shapes, "code", "name", "shape")) == [("complete", 2, "E2,unknown", "WARN"), ("non_empty", 0, "", "PASS")]
    assert _got(L.boundary_checks(shapes.where("code = 'q'"), "code", "name", "shape")) == [("complete", 0, "", "PASS"), ("non_empty", 1, "", "WARN")]
    index = spark.createDataFrame([(1, "a")], "k int, v string")
    features = spark.createDataFrame([(1, "E01234567"), (1, "X01234567"), (2, "E01234567"), (1, None)], "k int, code string")
    assert _got(L.indexed_features(features, index, "k", "code")) == [(1, "E01234567", "a")]


def test_match_schools(spark):
    schema = "id int, name string, core string, postcode string"
    left = [(1, "oak school", "oak", "A1"), (2, "oak school", "oak", "B1"), (3, "the elm", "elm", None), (4, "ashe grove x", "ashe grove", "C1"), (5, "zzz", "zzz", "D1"), (6, "zzz", "zzz", "Z9"), (7, None, None, None)]
    right = [(10, "oak school", "oak", "A1"), (11, "elm", "elm", "E1"), (12, "ash grove", "ash grove", "C1"), (13, "new", "new", "D1"), (14, "oak school", "oak", "A1"), (15, "w", "w", "C1")]
    got = linkage.match_schools(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    assert _got(got) == [
        (1, 10, "exact_name_postcode", 1.0), (2, 10, "exact_name", 0.95), (3, 11, "core_name_postcode", 0.92), (4, 12, "core_similarity", 0.947),
        (5, 13, "sole_postcode_match", 0.85), (6, None, None, None), (7, None, None, None),
    ]


def test_json_leaves(spark):
    deep = "[" * 300 + "1" + "]" * 300
    texts = ['{"a": {"b": [1, "", {"c": "x"}]}, "d": null, "e": [], "f": 2.5}', "not json", None, '"x"', "[]", deep]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(records.json_leaves(F.col("t"))).collect()
    assert [[tuple(x) for x in r[0]] for r in got] == [[("a.b[0]", "1"), ("a.b[2].c", "x"), ("f", "2.5")], [], [], [], [], [("[0]" * 300, "1")]]
