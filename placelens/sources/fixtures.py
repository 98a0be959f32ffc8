"""Provider documents in JSON as seven tables, from one scan, with keys that are the same on every run.

A provider's key is its own id; a care type's is a hash of the provider and its
place in the list, so that children find it without a sequence or a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.operators import scratch

# Age bands of fees, in order, and digits of days.
BANDS = ("under2", "age2", "age3to4", "age2plus", "age5plus")
DAYS = {"monday": "1", "tuesday": "2", "wednesday": "3", "thursday": "4", "friday": "5", "saturday": "6", "sunday": "7"}
_RATES = {"morning_session": "morningSession", "afternoon_session": "afternoonSession", "full_day": "fullDay", "per_session": "perSession", "per_hour": "perHour", "per_day": "perDay"}
_FLAT = ("perSession", "perHour", "perDay")

_CARE = (
    "array<struct<type: string, operatingWeeksPerYear: int, sessionHours: struct<morning: double, afternoon: double, fullDay: double>, eligibleAgeRange: struct<minMonths: int, minYears: int, maxYears: int>, eligibleAttendeesOnly: boolean,"
    " eligibleInstitutions: array<string>, eligibleOther: array<string>, fundedHoursAccepted: boolean, minimumCommitment: string, openingHours: array<struct<days: string, open: string, close: string>>, fees: map<string, string>,"
    " additionalCharges: array<struct<item: string, cost: double, unit: string, description: string>>, waitingList: map<string, struct<weeks: int, months: int>>, notes: array<struct<type: string, description: string>>>>"
)
#: ofsted has its grades as a map, whatever they are.
_SCHEMA = (
    "id string, name string, lad25cd string, institutionType string, latitude double, longitude double, phone string, email string, website string, fisUrl string, registeredPlaces int, bboxGeoType string, bboxGeoCode string,"
    " address struct<line1: string, line2: string, city: string, postcode: string>, ofsted map<string, string>, staff struct<graduatePercentage: double, turnoverPercentage: double>, facilities struct<hasGarden: boolean, hasKitchen: boolean>,"
    f" boundingBox struct<geoType: string, geoCode: string>, careTypes {_CARE}"
)
_INSPECTION = {
    "inspection_date": "inspectionDate", "framework": "framework", "safeguarding_met": "safeguardingMet", "achievement": "achievement", "curriculum_and_teaching": "curriculumAndTeaching", "behaviour_attitudes_routines": "behaviourAttitudesRoutines",
    "childrens_welfare_wellbeing": "childrensWelfareWellbeing", "attendance_and_behaviour": "attendanceAndBehaviour", "personal_development_wellbeing": "personalDevelopmentWellbeing", "inclusion": "inclusion",
    "leadership_and_governance": "leadershipAndGovernance", "early_years": "earlyYears", "sixth_form": "sixthForm", "ccr_met": "ccrMet", "vcr_met": "vcrMet", "oosc_met": "ooscMet",
}
_LEGACY = {"quality_of_education": "qualityOfEducation", "behaviour_and_attitudes": "behaviourAndAttitudes", "personal_development": "personalDevelopment", "leadership_and_management": "leadershipAndManagement", "early_years": "earlyYears", "sixth_form": "sixthForm"}

c = F.col


def _phone(x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9+]", "")
    return F.when(digits.startswith("+44"), F.concat(F.lit("0"), F.substr(digits, F.lit(4)))).when(digits.startswith("44") & (F.length(digits) > 10), F.concat(F.lit("0"), F.substr(digits, F.lit(3)))).otherwise(digits)


def fee_rows(fees: Column) -> Column:
    """Rates of a care type as rows: one for all ages where a flat rate stands at the top, else one per age band with an object."""
    rates = "map<string, double>"
    row = lambda band, get: F.struct(F.lit(band).alias("age_band"), *(get(v).cast("double").alias(k) for k, v in _RATES.items()))
    flat = F.exists(F.map_keys(fees), lambda k: k.isin(*_FLAT))
    one = F.array(row("all", lambda k: F.try_element_at(fees, F.lit(k)).try_cast("double") if k in _FLAT else F.lit(None)))
    banded = lambda b: F.from_json(F.when(F.try_element_at(fees, F.lit(b)).startswith("{"), F.try_element_at(fees, F.lit(b))), rates)
    many = F.array_compact(F.array(*(F.when(banded(b).isNotNull(), row(b, lambda k, b=b: F.try_element_at(banded(b), F.lit(k)))) for b in BANDS)))
    return F.when(flat, one).otherwise(many)


def read_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A row per document: lines of JSON, or whole files with multi_line. Ids must be p and a number; others are an error."""
    docs = spark.read.option("multiLine", multi_line).schema(_SCHEMA).json(path)
    ok = F.col("id").rlike("^p[0-9]+$")
    return docs.withColumn("number", F.when(ok, F.substr("id", F.lit(2)).cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a provider id: "), F.coalesce("id", F.lit("null")))).cast("long")))


def tables(docs: DataFrame, prefix: str = "fixture:") -> dict[str, DataFrame]:
    """providers, care_types, opening_hours, fee_rates, additional_charges, waiting_list_entries, care_type_notes.

    The documents are read once and written flat; of documents with equal ids the least text stays.
    """
    whole = docs.select("number", F.struct(*docs.columns).alias("d"), F.to_json(F.struct(*docs.columns)).alias("t"))
    docs = scratch.written(whole.groupBy("number").agg(F.min_by("d", "t").alias("d")).select("d.*").withColumn("provider_id", F.concat(F.lit(prefix), c("id"))))
    o = lambda k: F.try_element_at(c("ofsted"), F.lit(k))
    legacy = F.from_json(o("legacySubGrades"), "map<string, string>")
    providers = docs.select(
        "provider_id", c("number").alias("bigint_id"), c("name").alias("provider_name"), "address.postcode", "lad25cd", c("institutionType").alias("institution_type"), F.when(F.size("careTypes") > 0, c("careTypes.type")).alias("care_types"),
        c("address.line1").alias("address_line1"), c("address.line2").alias("address_line2"), "address.city", "latitude", "longitude", _phone(c("phone")).alias("phone"), "email", "website", c("fisUrl").alias("fis_url"),
        F.coalesce(F.nullif(o("legacyRating"), F.lit("")), o("rating")).alias("legacy_rating"), *(o(v).alias(k) for k, v in _INSPECTION.items()), *(F.try_element_at(legacy, F.lit(v)).alias(f"legacy_{k}") for k, v in _LEGACY.items()),
        c("registeredPlaces").alias("registered_places"), c("staff.graduatePercentage").alias("graduate_percentage"), c("staff.turnoverPercentage").alias("turnover_percentage"), c("facilities.hasGarden").alias("has_garden"), c("facilities.hasKitchen").alias("has_kitchen"),
        F.coalesce(F.nullif("boundingBox.geoType", F.lit("")), "bboxGeoType").alias("bbox_geo_type"), F.coalesce(F.nullif("boundingBox.geoCode", F.lit("")), "bboxGeoCode").alias("bbox_geo_code"),
    )
    care = docs.select("provider_id", F.posexplode("careTypes").alias("place", "k"))
    care = care.withColumn("care_type_id", F.left(F.sha2(F.concat_ws("\0", "provider_id", c("place").cast("string")), 256), F.lit(32)))
    none = F.array().cast("array<string>")
    least = F.from_json(F.when(c("k.minimumCommitment").startswith("{"), c("k.minimumCommitment")), "amount double, unitPerWeek string, duration string")
    care_types = care.withColumn("m", least).select(
        "care_type_id", "provider_id", c("k.type").alias("care_type"), c("k.operatingWeeksPerYear").alias("operating_weeks_per_year"), c("k.sessionHours.morning").alias("session_hours_morning"), c("k.sessionHours.afternoon").alias("session_hours_afternoon"),
        c("k.sessionHours.fullDay").alias("session_hours_full_day"), c("k.eligibleAgeRange.minMonths").alias("eligible_min_months"), c("k.eligibleAgeRange.minYears").alias("eligible_min_years"), c("k.eligibleAgeRange.maxYears").alias("eligible_max_years"),
        F.coalesce("k.eligibleAttendeesOnly", F.lit(False)).alias("eligible_attendees_only"), F.coalesce("k.eligibleInstitutions", none).alias("eligible_institutions"), F.coalesce("k.eligibleOther", none).alias("eligible_other"), c("k.fundedHoursAccepted").alias("funded_hours_accepted"),
        c("m.amount").alias("min_commitment_amount"), c("m.unitPerWeek").alias("min_commitment_unit"), c("m.duration").alias("min_commitment_duration"), F.coalesce(c("k.minimumCommitment") == "false", F.lit(False)).alias("no_minimum_commitment"),
    )
    hours = care.select("care_type_id", F.explode("k.openingHours").alias("h")).select("care_type_id", *(F.coalesce(c("h.days").contains(x), F.lit(False)).alias(k) for k, x in DAYS.items()), "h.open", "h.close")
    return {
        "providers": providers, "care_types": care_types, "opening_hours": hours, "fee_rates": care.select("care_type_id", F.explode(fee_rows(c("k.fees"))).alias("f")).select("care_type_id", "f.*"),
        "additional_charges": care.select("care_type_id", F.explode("k.additionalCharges").alias("x")).select("care_type_id", "x.*"), "waiting_list_entries": care.select("care_type_id", F.explode("k.waitingList").alias("age_band", "x")).select("care_type_id", "age_band", "x.weeks", "x.months"),
        "care_type_notes": care.select("care_type_id", F.explode("k.notes").alias("x")).select("care_type_id", c("x.type").alias("note_type"), "x.description"),
    }


def orphans(loaded: dict[str, DataFrame]) -> DataFrame:
    """(table, n): rows of each child table whose parent is missing."""
    out = None
    for name, df in loaded.items():
        if name == "providers":
            continue
        parent, key = ("providers", "provider_id") if name == "care_types" else ("care_types", "care_type_id")
        lost = df.join(loaded[parent].select(key), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = lost if out is None else out.unionByName(lost)
    return out


def refresh(loaded: dict[str, DataFrame], where: str) -> None:
    """Full refresh: every table is replaced as a whole, parents first."""
    for name, df in loaded.items():
        df.write.mode("overwrite").parquet(f"{where}/{name}")


def stamp(spark: SparkSession, where: str, commit: str | None) -> DataFrame:
    """Write which commit ("unknown" without one) the data are of and when (UTC), two lines of text."""
    lines = spark.range(1).select(F.concat(F.lit(f"commit: {commit or 'unknown'}\ntimestamp: "), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(where)
    return spark.read.text(where)


def postcode_areas(spark: SparkSession, path: str) -> DataFrame:
    """postcode (normalised) and area of a gzipped CSV with a header; of equal postcodes the last line's area. One file is one task, so it is dealt out after reading."""
    from placelens.functions.text import normalise_postcode

    rows = spark.read.schema("postcode string, area string").option("header", True).option("enforceSchema", True).csv(path)
    rows = rows.where("area is not null").select(normalise_postcode(c("postcode")).alias("postcode"), "area", F.monotonically_increasing_id().alias("_line"))
    return rows.groupBy("postcode").agg(F.max_by("area", "_line").alias("area"))
