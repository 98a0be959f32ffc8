"""All columns of a session: events become facts, which are counted once and then looked up by a table of rules.

events: session_id, event_id, ts, event (its name) and properties (JSON text),
which is read as a VARIANT once. A property may come as a value or as text, a
list also as JSON in text; whole numbers count, other texts do not. The session
id is for grouping only and is left out of the result unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Steps of the form in order, kinds of care, schemes and the columns that count them.
STEPS = ("postcode", "partner", "immigration", "working", "benefits", "children", "childcare")
CARE = ("childminder", "private_nursery", "school_based_nursery", "after_school_club", "breakfast_club", "holiday_club")
SCHEMES = {
    "15_hours_2_year_olds": "scheme_15h_2yr", "15_hours_universal": "scheme_15h_universal", "30_hours_working_families": "scheme_30h_working", "childcare_grant": "scheme_childcare_grant", "free_breakfast_clubs": "scheme_free_breakfast",
    "haf": "scheme_haf", "learner_support": "scheme_learner_support", "tax_free_childcare": "scheme_tfc", "universal_credit_childcare": "scheme_uc_childcare", "wraparound_childcare": "scheme_wraparound",
}
# Yes-or-no answers with the step they are of, bands of distance, values that count as none.
ANSWERS = {"has_partner": "partner", "settled_in_uk": "immigration", "working": "working", "is_studying": "working", "receives_benefits": "benefits"}
BANDS = {"<1mi": "lt1", "1-3mi": "1_3", "3-5mi": "3_5", "5-10mi": "5_10", "10+mi": "10_plus", "unknown": "unknown"}
NONE = ("", "null")
# The events that a column counts.
EVENTS = {
    "provider_search": "provider_searches", "provider_filter_changed": "provider_filters_changed", "provider_detail_viewed": "provider_details_viewed", "provider_shortlisted": "provider_shortlist_interactions",
    "provider_zoom_in": "provider_zoom_ins", "provider_zoom_out": "provider_zoom_outs", "provider_zoom_to_la": "provider_zoom_to_la", "provider_show_more": "provider_show_more_clicks", "$pageview": "pageviews_total",
}

c = F.col


def _text(key: str) -> Column:
    return c("_p")[key]


def _given(key: str) -> Column:
    return F.when(~_text(key).isin(*NONE), _text(key))


def _number(key: str) -> Column:
    return F.when(_text(key).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(_text(key)).try_cast("long"))


def _named(value: Column, names: dict[str, str]) -> Column:
    """The column that counts such a value, null of others."""
    out = F
    for text, name in names.items():
        out = out.when(value == text, name)
    return out


def _fact(name: Column, value: Column | None = None) -> Column:
    return F.struct(name.alias("fact"), (F.lit(None).cast("string") if value is None else value).alias("value"))


def _facts(*names: Column) -> Column:
    return F.array(*map(_fact, names))


def _listed(key: str, names: dict[str, str]) -> Column:
    """The facts of a list, one per text."""
    return F.transform(F.from_json(_text(key), "array<string>"), lambda x: _fact(_named(x, names)))


def _like(prefix: str, *texts: str) -> dict[str, str]:
    return {x: f"{prefix}_{x}" for x in texts}


def _counted() -> Column:
    """The columns that an event adds one to, as often as it does; nulls among them count nowhere."""
    path, step = _text("$pathname"), _text("step")
    area = F.when(path.startswith("/support") | path.startswith("/costs"), "event_count_form").when(path.startswith("/providers"), "event_count_provider").otherwise("event_count_other")
    visited = F.when(path == "/", "visited_home")
    for x in ("support", "costs", "providers"):
        visited = visited.when(path.startswith(f"/{x}"), f"visited_{x}")
    answers = [F.when(step == s, _named(_text(name), _like(name, "true", "false"))) for name, s in ANSWERS.items()]
    children = [_named(_number("child_count"), {1: "child_count_1", 2: "child_count_2", 3: "child_count_3plus"}), _named(_text("youngest_band"), {"0-4": "youngest_band_0_4", "5+": "youngest_band_5_plus"})]
    own = _facts(_named(c("event"), EVENTS), area, visited)
    source = _facts(_named(_text("source"), _like("provider_zoom", "keyboard", "button")))
    more = {
        "step_completed": (_facts(_named(_text("form"), _like("steps_completed", "support", "costs")), *answers, *(F.when(step == "children", x) for x in children)), F.when(step == "childcare", _listed("care_types_sought", _like("care_sought", *CARE[:3])))),
        "schemes_eligible": (_facts(_named(_text("form"), {"support": "reached_entitlements_results", "costs": "reached_costs_results"})), _listed("schemes", SCHEMES)),
        "provider_filter_changed": (
            _facts(_named(_text("funded_hours_only"), _like("provider_filter_funded_hours", "true", "false")), _named(_text("sort_by"), _like("provider_sort", "distance", "best_ofsted"))),
            _listed("care_types", _like("provider_filter_care", *CARE)), _listed("child_age_bands", {"0-4": "provider_child_band_0_4", "5+": "provider_child_band_5_plus"}),
        ),
        "provider_detail_viewed": (_facts(_named(_text("distance_band"), {b: f"provider_detail_dist_band_{k}" for b, k in BANDS.items()})),),
        "provider_shortlisted": (_listed("shortlist_care_types", _like("provider_shortlist", *CARE)),),
        "provider_zoom_in": (source,), "provider_zoom_out": (source,),
    }
    none, chosen = F.array().cast("array<struct<fact:string,value:string>>"), F
    for event, lists in more.items():
        chosen = chosen.when(c("event") == event, F.concat(*(F.coalesce(x, none) for x in lists)))
    return F.concat(own, F.coalesce(chosen, none))


def _seen() -> dict[str, Column]:
    """The values of an event that its session's columns are made of, by kind; null where there is none."""
    search, path, iod = c("event") == "provider_search", _text("$pathname"), _number("iod_decile").cast("string")
    steps = {f"steps_{x}": F.when((c("event") == "step_completed") & (_text("form") == x), _text("step")) for x in ("support", "costs")}
    return {
        "device_type": F.nullif(_text("$device_type"), F.lit("")), "lad": _given("lad25cd"), "iod_decile": iod, "path": F.nullif(path, F.lit("")), **steps,
        "provider_search_lad": F.when(search, F.nullif(_text("lad25cd"), F.lit(""))), "provider_search_iod": F.when(search, iod), "page": F.when(c("event") == "provider_show_more", _number("page").cast("string")),
    }


def facts() -> Column:
    """What an event tells of its session, as (fact, value): a column to add one to, without a value, or a kind and a value."""
    seen = (_fact(F.when(v.isNotNull(), k), v) for k, v in _seen().items())
    return F.concat(_counted(), F.array(*seen, _fact(F.lit("referrer_domain"), _text("$referring_domain"))))


def _of(fact: str, value: Column) -> Column:
    return F.when(c("fact") == fact, value)


def _json(values: Column, quoted: bool) -> Column:
    """Sorted values as a JSON list with a space after each comma."""
    one = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "") if quoted else x.cast("string")
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(values), one), ", "), F.lit("]"))


def _furthest(form: str) -> Column:
    places = F
    for k, step in enumerate(STEPS):
        places = places.when(c("value") == step, k)
    return F.get(F.array(*map(F.lit, STEPS)), F.max(_of(f"steps_{form}", places)))


def _spread(prefix: str, fact: str) -> dict[str, Column]:
    v = _of(fact, c("value").cast("long"))
    mean = F.sum(v.cast("double") * c("n")) / F.sum(_of(fact, c("n")))
    return {f"{prefix}_min": F.min(v), f"{prefix}_max": F.max(v), f"{prefix}_mean": F.bround(mean, 2), f"{prefix}_median": F.percentile(v, F.lit(0.5), c("n"))}


def rules() -> dict[str, Column]:
    """Every column by name, an aggregate over a session's distinct facts: how often each is there (n), where it came first (at), its times."""
    counts = F.map_from_entries(F.collect_list(F.when(c("value").isNull(), F.struct("fact", "n"))))
    n = lambda *names: {x: F.coalesce(counts[x], F.lit(0).cast("long")) for x in names}
    distinct = lambda fact: F.count(_of(fact, F.lit(1))).cast("int")
    listed = lambda fact, quoted=True: _json(F.collect_list(_of(fact, c("value") if quoted else c("value").cast("long"))), quoted)
    out = {
        "session_date": F.to_date(F.min("first_ts")), "session_duration_s": F.max("last_ts").cast("double") - F.min("first_ts").cast("double"), **n("event_count_form", "event_count_provider", "event_count_other"),
        "device_type": F.min_by("value", _of("device_type", c("at"))), "referrer_domain": F.min_by("value", _of("referrer_domain", c("at"))),
    }
    for form in ("support", "costs"):
        out |= n(f"steps_completed_{form}") | {f"distinct_steps_{form}": distinct(f"steps_{form}"), f"furthest_step_{form}": _furthest(form)}
    out |= n("reached_entitlements_results", "reached_costs_results")
    out |= {"lad_codes": listed("lad"), "lad_count": distinct("lad"), **_spread("iod_decile", "iod_decile"), "iod_deciles": listed("iod_decile", False)}
    for name in ANSWERS:
        out |= n(f"{name}_true", f"{name}_false")
        yes, no = out[f"{name}_true"], out[f"{name}_false"]
        out |= {f"{name}_pct": F.bround(F.when(yes + no > 0, yes / (yes + no)), 4)}
    out |= n("child_count_1", "child_count_2", "child_count_3plus", "youngest_band_0_4", "youngest_band_5_plus", *_like("care_sought", *CARE[:3]).values(), *SCHEMES.values(), "provider_searches")
    out |= {"provider_search_lads": listed("provider_search_lad"), **_spread("provider_search_iod", "provider_search_iod")}
    out |= n("provider_filters_changed", *_like("provider_filter_care", *CARE).values(), "provider_filter_funded_hours_true", "provider_filter_funded_hours_false", "provider_sort_distance", "provider_sort_best_ofsted", "provider_child_band_0_4", "provider_child_band_5_plus")
    out |= n("provider_details_viewed", *(f"provider_detail_dist_band_{k}" for k in BANDS.values()), "provider_shortlist_interactions", *_like("provider_shortlist", *CARE).values())
    out |= n("provider_zoom_ins", "provider_zoom_outs", "provider_zoom_keyboard", "provider_zoom_button", "provider_zoom_to_la", "provider_show_more_clicks")
    out |= {"provider_max_page": F.max(_of("page", c("value").cast("long"))), "pages_distinct": distinct("path"), **n("pageviews_total")}
    out |= {x: v > 0 for x, v in n("visited_support", "visited_costs", "visited_providers", "visited_home").items()}
    return out | {"lad_mode": F.min_by("value", _of("lad", F.struct(-c("n"), "at")))}


def session_columns(events: DataFrame, keep_id: bool = False) -> DataFrame:
    """A row per session with every rule's column and lad_mode, the commonest area, of equals the one seen first.

    Events without a session or a time are left out; broken properties count as none.
    """
    read = events.where("session_id <> '' and ts is not null").select("session_id", "event_id", "ts", "event", F.try_variant_get(F.try_parse_json("properties"), F.lit("$"), "map<string,string>").alias("_p"))
    own = read.select("session_id", "event_id", "ts", facts().alias("facts"))
    ordered = own.withColumn("at", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")))
    told = ordered.select("session_id", "ts", "at", F.inline("facts")).where("fact is not null and (at = 1 or fact <> 'referrer_domain')")
    distinct = told.groupBy("session_id", "fact", "value").agg(F.count("*").alias("n"), F.min("at").alias("at"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    out = distinct.groupBy("session_id").agg(*(v.alias(k) for k, v in rules().items()))
    return out if keep_id else out.drop("session_id")
