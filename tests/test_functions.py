import pytest
from pyspark.sql import functions as F

from placelens.functions import geo, numbers, parse, text
from placelens.functions.similarity import ratio, similarity


def _one(spark, f, *values):
    """f over one row of values."""
    kinds = {str: "string", float: "double", int: "long", bool: "boolean"}
    df = spark.createDataFrame([values], ", ".join(f"c{k} {kinds.get(type(v), 'string')}" for k, v in enumerate(values)))
    return df.select(f(*(F.col(f"c{k}") for k in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "want"),
    [("St Paul's Nursery", "saint pauls nursery"), ("Nursery & Children's Centre", "nursery and childrens centre"), ("C of E Primary", "church of england primary"), ("CofE Prim School", "church of england primary school"), (None, ""), ("  The  Oaks (UK) Ltd ", "oaks"), ("J I & N School", "junior infant and nursery school")],
)
def test_normalise_name(spark, name, want):
    assert _one(spark, text.normalise_name, name) == want


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.normalise_postcode, " sw1a1aa ", "SW1A 1AA"), (text.normalise_postcode, "zz", "ZZ"), (text.normalise_postcode, None, ""), (text.outward_code, "m1 1ae", "M1"), (text.outward_code, "SW1A1AA", "SW1A"),
        (text.clean_phone, "+44 1234 567890", "01234567890"), (text.clean_phone, "N/A", None), (text.clean_phone, "01234 567890 or 07000", "01234567890"), (text.clean_phone, "12", None), (text.clean_phone, None, None),
        (text.clean_email, " a@b..org. ", "a@b.org"), (text.clean_email, "www.a.b", None), (text.clean_email, "x@y,uk;z@q.com", None), (text.clean_email, "//x@y.org,uk", "x@y.org.uk"),
        (text.clean_website, "example.org", "https://example.org"), (text.clean_website, "https://facebook.com/", None), (text.clean_website, "https://facebook.com/p", "https://facebook.com/p"), (text.clean_website, "hello", None), (text.clean_website, "https://", None),
        (text.clean_urn, "EY123456 link", "EY123456"), (text.clean_urn, "none", "none"), (text.extract_venue, "Kids @ Oak School", "Oak School"), (text.extract_venue, "Fun at St Mary Primary School", "St Mary Primary School"), (text.extract_venue, "Fun", None),
        (text.name_inversion, "Bristol, City of", "City of Bristol"), (text.privacy_postcode, "AB1 2CD", "AB1"), (text.clean_text, " a \n b ", "a b"), (text.clean_text, "  ", None), (text.last_segment, "la:1:name", "name"),
    ],
)
def test_text(spark, f, value, want):
    assert _one(spark, f, value) == want


def test_rounding_goes_up_at_halves(spark):
    assert _one(spark, numbers.round_half_up, 2.005 * 1000 / 1000) == pytest.approx(2.0 if 2.005 * 100 + 0.5 < 201 else 2.01)
    assert _one(spark, lambda x: numbers.round_half_up(x, 0), -2.5) == -2
    assert _one(spark, numbers.round_to_ten, 15.0) == 20


def test_terms_and_school_age(spark):
    day = lambda y, m: _one(spark, numbers.next_term_start, y, m).isoformat()
    assert (day(2024, 9), day(2024, 8), day(2024, 3)) == ("2025-01-01", "2024-09-01", "2024-04-01")
    pre = lambda y, m, at: _one(spark, lambda a, b, c: numbers.is_pre_school(a, b, c.cast("date")), y, m, at)
    assert pre(2021, 8, "2025-08-31") and not pre(2021, 8, "2025-09-01") and pre(2021, 9, "2025-10-01")
    assert _one(spark, numbers.decimal_hours, "17:45") == 17.75
    assert _one(spark, numbers.days_bitmask, "135") == 0b10101


def test_geometry(spark):
    wide = _one(spark, lambda *b: F.array(*geo.inflate(*b)), 51.0, -1.0, 52.0, 0.0)
    assert wide == [50.5, -1.5, 52.5, 0.5]
    assert _one(spark, geo.haversine_km, 51.5, -0.12, 48.85, 2.35) == pytest.approx(342, abs=2)
    box = (51.0, -1.0, 52.0, 0.0)
    assert not _one(spark, lambda r: geo.box_within_circle(F.lit(51.5), F.lit(-0.5), r, tuple(map(F.lit, box))), 50.0)
    assert _one(spark, lambda r: geo.box_within_circle(F.lit(51.5), F.lit(-0.5), r, tuple(map(F.lit, box))), 80.0)
    assert _one(spark, lambda r: geo.circle_meets_box(F.lit(53.0), F.lit(-0.5), r, tuple(map(F.lit, box))), 112.0)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("All ages", (0, None, 18)), ("0-12", (0, None, 12)), ("2 years 10 months to 5 years", (None, 2, 5)), ("3 months - 4 years", (3, None, 4)), ("Up to 8 years", (0, None, 8)), ("From 6 months to 5 years", (6, None, 5)), ("From 2 years", (None, 2, None)), ("0-5 Years5-8 Years", (0, None, 8)), ("3-4 years", (None, 3, 4)), ("18+", (None,) * 3), ("", (None,) * 3), (None, (None,) * 3), ("whenever", (None,) * 3)],
)
def test_age_range(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "t string").select(parse.parse_age_range(F.col("t")).alias("a")).first().a
    assert tuple(got) == want


def test_hours_and_fees(spark):
    assert parse.opening_hours("Mon-Fri 08:00-18:00; Sat 9am to 1pm") == [("12345", "08:00", "18:00"), ("6", "09:00", "13:00")]
    assert parse.opening_hours("Monday to Thursday: 7.30 - 5.30") == [("1234", "07:30", "17:30")]
    assert parse.opening_hours(None) == parse.opening_hours("closed") == []
    rows = spark.createDataFrame([("£8.50 per hour; under 2s £95 full day; £9 per hour",), (None,), ("free",)], "t string")
    assert [[tuple(x) for x in r.f] for r in rows.select(parse.parse_fees(F.col("t")).alias("f")).collect()] == [[("all", "per_hour", 8.5), ("under2", "full_day", 95.0)], [], []]
    got = spark.createDataFrame([("0-12",), (None,)], "t string").select(parse.parse_age_range(F.col("t")).alias("a")).collect()
    assert [tuple(r.a) for r in got] == [(0, None, 12), (None, None, None)]


def test_weeks_and_funded_answers(spark):
    assert _one(spark, parse.operating_weeks, "Term time only", "open for 44 weeks") == 44
    assert _one(spark, lambda a: parse.operating_weeks(a, F.lit("")), "Term time only") == 38
    funded = lambda *a: _one(spark, lambda x: parse.funded_hours(F.array(*map(F.lit, a))), "x")
    assert funded("No", "Yes") is True and funded("no", "No") is False and funded("maybe") is None


def test_similarity_is_difflibs(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x"), ("private thread", "pit")], "a string, b string")
    got = [r.x for r in df.select(similarity("a", "b").alias("x")).collect()]
    assert got == [0.75, None, ratio("private thread", "pit")]
