"""Which care is offered where: claims of six sources, and one answer from them.

Every source becomes rows of the same columns. Claims of one source with equal
id and care type count once; claims of different sources about one place and
care type are settled by the order of sources, and what the others say
otherwise is kept beside the winner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.functions import text

COLUMNS = ("source", "source_id", "area", "care_type", "label", "method", "name", "postcode", "urn", "school_urn", "phase")
# Kinds of registration and the care they stand for; a subkind of None is for all others.
REGISTRATIONS = {
    ("Childminder", None): "childminder",
    ("Childminder without domestic premises", None): "childminder",
    ("Home childcarer", None): "childminder",
    ("Childcare on domestic premises", None): "childminder",
    ("Childcare on non-domestic premises", "Full day care"): "private_nursery",
    ("Childcare on non-domestic premises", "Sessional day care"): "private_nursery",
    ("Childcare on non-domestic premises", "Out-of-school day care"): "after_school_club",
    ("Childcare on non-domestic premises", None): "private_nursery",
}
# Registers that are not for under-fives.
OLDER_ONLY, OLDER = ("VCR only", "CCR only"), "CCR-VCR"
# What in a name says which care, the first that is found.
NAME_PARTS = {
    "breakfast club": "breakfast_club", "breakfast": "breakfast_club", "after school": "after_school_club", "afterschool": "after_school_club", "out of school": "after_school_club", " asc": "after_school_club",
    "holiday club": "holiday_club", "holiday camp": "holiday_club", "holiday": "holiday_club", "play scheme": "holiday_club", "playscheme": "holiday_club", "forest school": "holiday_club", "active camp": "holiday_club",
}
# Phases of schools that are left out, kinds of scheme members that are, and the prefix of counties.
LEFT_OUT_PHASES, LEFT_OUT_MEMBERS, COUNTY = ("Pupil referral unit", "Non-maintained special school"), ("Special_AP",), "E10"

c = F.col


def _rows(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    own = {"source": F.lit(source), **columns}
    return df.select(*(own.get(k, F.lit(None)).cast("string").alias(k) for k in COLUMNS))


def postcode(x: Column) -> Column:
    """Normalised; blank and words for nothing are null."""
    return F.when(~F.upper(F.trim(x)).isin("NULL", "N/A", "NA", ""), text.normalise_postcode(x))


def listed(listings: DataFrame, links: DataFrame, source: str = "la_scrape") -> DataFrame:
    """listings: area, provider_id, classes and labels (arrays), name, postcode; links: area, provider_id, urn, school_urn.

    Each class once, with the label at its first place; without classes, what the name says; else one row without care.
    """
    rows = listings.join(links, ["area", "provider_id"])
    labelled = F.transform(F.array_distinct("classes"), lambda x: F.struct(x.alias("care"), F.get("labels", (F.array_position("classes", x) - 1).cast("int")).alias("label"), F.lit("structured").alias("method")))
    guess = text.first_label(c("name"), NAME_PARTS)
    other = F.array(F.struct(guess.alias("care"), F.when(guess.isNotNull(), c("name")).alias("label"), F.when(guess.isNotNull(), "inferred_from_name").otherwise("none").alias("method")))
    rows = rows.withColumn("x", F.explode(F.when(F.coalesce(F.size("classes"), F.lit(0)) > 0, labelled).otherwise(other)))
    return _rows(rows, source, source_id=F.concat_ws(":", "area", "provider_id"), area=c("area"), care_type=c("x.care"), label=c("x.label"), method=c("x.method"), name=c("name"), postcode=postcode(c("postcode")), urn=c("urn"), school_urn=c("school_urn"))


def inspected(inspections: DataFrame, scraped: DataFrame, consented: DataFrame, areas: DataFrame, districts: DataFrame, source: str = "ofsted") -> DataFrame:
    """inspections: urn, kind, subkind, authority, name, postcode, register; scraped: urn, name, postcode, status; consented:
    urn, name, postcode; areas: name, code; districts: postcode, district.

    Registers for older children only leave out rows whose name names no care. A county becomes the district of the postcode.
    """
    s = scraped.where("status in ('success', 'partial')").select("urn", c("name").alias("s_name"), c("postcode").alias("s_postcode"))
    rows = inspections.where("urn <> ''").join(s, "urn", "left").join(consented.select("urn", c("name").alias("c_name"), c("postcode").alias("c_postcode")), "urn", "left")
    rows = rows.withColumn("name", F.when(c("name") == "REDACTED", F.coalesce("s_name", "c_name")).otherwise(c("name"))).withColumn("postcode", postcode(F.coalesce(F.when(~c("postcode").isin("", "REDACTED"), c("postcode")), "s_postcode", "c_postcode")))
    exact = F.coalesce(*(F.when((c("kind") == k) & (c("subkind") == sub), v) for (k, sub), v in REGISTRATIONS.items() if sub))
    care = F.coalesce(exact, *(F.when(c("kind") == k, v) for (k, sub), v in REGISTRATIONS.items() if not sub))
    named, register = text.first_label(c("name"), NAME_PARTS), F.coalesce("register", F.lit(""))
    care = F.when(register.isin(*OLDER_ONLY), named).when((register == OLDER) & ~F.coalesce(care == "after_school_club", F.lit(False)), named).otherwise(care)
    rows = rows.withColumn("care", care).where(~register.isin(*OLDER_ONLY) | c("care").isNotNull())
    rows = _with_area(rows, areas, "authority").join(districts.select("postcode", "district"), "postcode", "left")
    area = F.when(c("code").startswith(COUNTY), F.coalesce("district", "code")).otherwise(c("code"))
    label = F.nullif(F.concat_ws(" — ", F.nullif("kind", F.lit("")), F.nullif("subkind", F.lit(""))), F.lit(""))
    return _rows(rows, source, source_id=c("urn"), area=area, care_type=c("care"), label=label, method=F.when(c("care").isNotNull(), "registration_type_map"), name=F.when(c("name") != "REDACTED", c("name")), postcode=c("postcode"), urn=c("urn"))


def _with_area(rows: DataFrame, areas: DataFrame, name: str) -> DataFrame:
    return rows.join(areas.select(c("name").alias(name), "code"), name, "left")


def schools(census: DataFrame, register: DataFrame, source: str = "school_census") -> DataFrame:
    """census: urn, name, postcode, area, phase, n_nursery (text); register: urn, provision. The first rule that holds says nursery."""
    rows = census.where("urn <> ''").where(~F.coalesce(c("phase").isin(*LEFT_OUT_PHASES), F.lit(False))).join(register.select("urn", "provision"), "urn", "left")
    pupils = F.coalesce(F.try_to_number(F.trim("n_nursery"), F.lit("999999999")), F.lit(0))
    method = F.when(c("phase") == "State-funded nursery", "phase_type").when(pupils > 0, "census_nursery_pupils").when(c("provision") == "Has Nursery Classes", "gias_nursery_provision")
    care = F.when(method.isNotNull(), "school_based_nursery")
    return _rows(rows, source, source_id=c("urn"), area=c("area"), care_type=care, label=c("phase"), method=method, name=c("name"), postcode=postcode(c("postcode")), school_urn=c("urn"), phase=c("phase"))


def members(scheme: DataFrame, census: DataFrame, areas: DataFrame, source: str = "free_breakfast", label: str = "Free breakfast club scheme") -> DataFrame:
    """scheme: urn, name, authority, kind; with what the census has of them."""
    own = census.select("urn", c("postcode").alias("s_postcode"), c("phase").alias("s_phase"), c("area").alias("s_area"))
    rows = _with_area(scheme.where("urn <> ''").where(~F.coalesce(c("kind").isin(*LEFT_OUT_MEMBERS), F.lit(False))), areas, "authority").join(own, "urn", "left")
    known = c("s_postcode").isNotNull() | c("s_phase").isNotNull()
    method = F.when(known, "scheme_membership_census_enriched").otherwise("scheme_membership")
    area, care = F.coalesce(F.nullif("s_area", F.lit("")), "code"), F.lit("free_breakfast_club")
    return _rows(rows, source, source_id=c("urn"), area=area, care_type=care, label=F.lit(label), method=method, name=c("name"), postcode=postcode(c("s_postcode")), school_urn=c("urn"), phase=c("s_phase"))


def agency(feed: DataFrame, areas: DataFrame, districts: DataFrame, source: str = "tiney", label: str = "Tiney CMA childminder") -> DataFrame:
    """feed: urn, name, postcode, authority, status; those that are open. The area by name, else by postcode."""
    rows = _with_area(feed.where("urn <> '' and status = 'open'").withColumn("postcode", postcode(c("postcode"))), areas, "authority").join(districts.select("postcode", "district"), "postcode", "left")
    return _rows(rows, source, source_id=c("urn"), area=F.coalesce("code", "district"), care_type=F.lit("childminder"), label=F.lit(label), method=F.lit("source_feed"), name=c("name"), postcode=c("postcode"), urn=c("urn"))


def wraparound(matched: DataFrame, area: str, source: str = "bristol_wraparound") -> DataFrame:
    """matched: school_urn, name, postcode, before_spaces, after_spaces; a club for each that has spaces."""
    both = F.array(F.when(c("before_spaces") > 0, F.struct(F.lit("breakfast_club").alias("care"), F.lit("before").alias("at"))), F.when(c("after_spaces") > 0, F.struct(F.lit("after_school_club").alias("care"), F.lit("after").alias("at"))))
    rows = matched.withColumn("x", F.explode(F.array_compact(both)))
    return _rows(rows, source, source_id=c("school_urn"), area=F.lit(area), care_type=c("x.care"), label=F.concat(F.lit("Wraparound childcare ("), c("x.at"), F.lit(" school)")), method=F.lit("council_wraparound_directory"), name=c("name"), postcode=postcode(c("postcode")), school_urn=c("school_urn"))


def claims(*sources: DataFrame) -> DataFrame:
    """All sources in their order (rank), each (source, source_id, care_type) once; of several the least name, then postcode. Rows without care all stay."""
    out = None
    for rank, df in enumerate(sources):
        df = df.withColumn("rank", F.lit(rank))
        out = df if out is None else out.unionByName(df)
    rest = F.struct(*(F.coalesce(k, F.lit("￿")).alias(k) for k in ("name", "postcode", "label")), *(c(k).alias(f"_{k}") for k in (*COLUMNS, "rank")))
    once = out.where("care_type is not null").groupBy("source", "source_id", "care_type").agg(F.min(rest).alias("x"))
    return once.select(*(c(f"x._{k}").alias(k) for k in (*COLUMNS, "rank"))).unionByName(out.where("care_type is null"))


def by_district(rows: DataFrame, counties: DataFrame) -> DataFrame:
    """Rows of a county once for each of its districts; counties: county, district. A county without districts stays."""
    return rows.join(counties.select(c("county").alias("area"), "district"), "area", "left").withColumn("area", F.coalesce("district", "area")).select(rows.columns)


def settled(rows: DataFrame) -> DataFrame:
    """One row per place (number, school's number, else id) and care type: the claim of the first source, and in conflicts
    what others (source, area, name) say of the area or the name otherwise. Claims without a care are left out."""
    place = F.coalesce("urn", "school_urn", "source_id").alias("place")
    own = rows.where("care_type is not null").select(place, "care_type", "rank", "source", "source_id", "area", "name", "method").distinct()
    first = own.groupBy("place", "care_type").agg(F.min(F.struct("rank", "source_id", "source", "area", "name", "method")).alias("w"))
    said = own.join(first, ["place", "care_type"]).where(c("rank") > c("w.rank"))
    differs = ~c("area").eqNullSafe(c("w.area")) | ~c("name").eqNullSafe(c("w.name"))
    others = said.where(differs).groupBy("place", "care_type").agg(F.array_sort(F.collect_set(F.struct("source", "area", "name"))).alias("conflicts"))
    out = first.join(others, ["place", "care_type"], "left")
    return out.select("place", "care_type", "w.source", "w.area", "w.name", "w.method", F.coalesce("conflicts", F.array().cast("array<struct<source: string, area: string, name: string>>")).alias("conflicts"))
