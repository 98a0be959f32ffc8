"""Every column of sessions over made events: properties as JSON on one side, as columns on the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.operators import session_columns as S
from placelens.operators.scratch import dealt
from placelens.plans.base import table
from placelens.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()

_EVENTS = ("step_completed", "schemes_eligible", "provider_search", "provider_filter_changed", "provider_detail_viewed", "provider_shortlisted", "provider_zoom_in", "provider_zoom_out", "provider_zoom_to_la", "provider_show_more", "$pageview")
_N = len(_EVENTS)
#: By property the values of k modulo their number, as JSON; None leaves the property out.
_VALUES = {
    "$pathname": ('"/support/x"', '"/costs"', '"/providers/map"', '"/"', None, '"/about"', '""'), "$device_type": (None, '"Mobile"', '"Desktop"'), "$referring_domain": (None, '"g.com"', None, '"h.org"'),
    "form": ('"support"', '"costs"', None), "step": (*(f'"{s}"' for s in S.STEPS), '"other"', None), "lad25cd": (None, '"null"', '"E2"', '"E1"', '"E3"'), "iod_decile": (None, '"null"', '"x"', "3", '"7"', "10", "4"),
    **dict.fromkeys(S.ANSWERS, ("true", "false", '"true"', None, '"false"')), "child_count": ("1", '"2"', "3", '"x"', None, "4"), "youngest_band": ('"0-4"', '"5+"', None),
    "care_types_sought": ('["childminder","private_nursery","childminder"]', r'"[\"school_based_nursery\"]"', '"bad"', None), "care_types": ('["holiday_club"]', '["breakfast_club","after_school_club"]', "7"),
    "shortlist_care_types": (r'"[\"holiday_club\",\"childminder\"]"', '["private_nursery"]'), "schemes": ('["haf","15_hours_universal"]', '["tax_free_childcare","haf","learner_support"]', "[]", None), "child_age_bands": ('["0-4"]', '["5+","0-4"]'),
    "funded_hours_only": ("true", '"false"', None), "sort_by": ('"distance"', '"best_ofsted"', '"cost"', None), "distance_band": (*(f'"{b}"' for b in S.BANDS), None), "source": ('"keyboard"', '"button"', None), "page": ("2", '"5"', None, "3"),
}
_SESSION = "concat('s', user_id, '-', event_id % 40)"


def _made(spark, d):
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    one = lambda key, values: f"CASE k % {len(values)} {' '.join(f'WHEN {n} THEN {quoted(f'"{key}": {v}')}' for n, v in enumerate(values) if v is not None)} END"
    props = "concat('{', array_join(array_compact(array(" + ", ".join(one(k, v) for k, v in _VALUES.items()) + ")), ', '), '}')"
    e = table(spark, d, "events").withColumn("k", F.floor(F.col("event_id") / _N)).withColumn("ts", F.date_trunc("second", "ts").cast("timestamp"))
    name = F.get(F.array(*map(F.lit, _EVENTS)), (F.col("event_id") % _N).cast("int"))
    own = e.select(F.expr(_SESSION).alias("session_id"), "event_id", "ts", name.alias("event"), "k")
    return dealt(own, "session_id", rows=50000).select("session_id", "event_id", "ts", "event", F.expr(props).alias("properties"))


def _plain(v: str | None) -> str:
    """A JSON value as the text that it stands for, in SQL."""
    return "NULL" if v is None else "'" + (v[1:-1] if v[0] == '"' else v).replace('\\"', '"').replace("'", "''") + "'"


def _sql() -> str:
    columns = [f"CASE k % {len(v)} {' '.join(f'WHEN {n} THEN {_plain(x)}' for n, x in enumerate(v))} END AS \"{key}\"" for key, v in _VALUES.items()]
    names = f"[{', '.join(map(repr, _EVENTS))}][CAST(event_id % {_N} AS BIGINT) + 1]"
    of = lambda event, more="": f"event = '{event}'{more}"
    n = lambda where: f"count(*) FILTER (WHERE {where})"
    number = lambda p: f"CASE WHEN regexp_matches(\"{p}\", '^[0-9]+$') THEN CAST(\"{p}\" AS BIGINT) END"
    listed = lambda p: f"CASE WHEN \"{p}\" LIKE '[%' THEN CAST(\"{p}\" AS VARCHAR[]) ELSE [] END"
    times = lambda p, x, where: f"CAST(coalesce(sum(len(list_filter({listed(p)}, lambda y: trim(y, '\"') = '{x}'))) FILTER (WHERE {where}), 0) AS BIGINT)"
    given = "CASE WHEN lad25cd NOT IN ('', 'null') THEN lad25cd END"
    out = {
        "session_date": "CAST(min(ts) AS DATE)", "session_duration_s": "CAST(epoch(max(ts)) - epoch(min(ts)) AS DOUBLE)", "event_count_form": n("path LIKE '/support%' OR path LIKE '/costs%'"), "event_count_provider": n("path LIKE '/providers%'"),
        "event_count_other": n("NOT coalesce(path LIKE '/support%' OR path LIKE '/costs%' OR path LIKE '/providers%', false)"), "device_type": "arg_min(\"$device_type\", (ts, event_id)) FILTER (WHERE \"$device_type\" IS NOT NULL)",
        "referrer_domain": "first(\"$referring_domain\" ORDER BY ts, event_id)", "lad_codes": f"'[' || coalesce(string_agg(DISTINCT '\"' || ({given}) || '\"', ', ' ORDER BY '\"' || ({given}) || '\"'), '') || ']'", "lad_count": f"count(DISTINCT {given})",
        "provider_searches": n(of("provider_search")), "provider_search_lads": "'[' || coalesce(string_agg(DISTINCT '\"' || lad25cd || '\"', ', ' ORDER BY '\"' || lad25cd || '\"') FILTER (WHERE event = 'provider_search' AND lad25cd IS NOT NULL), '') || ']'",
        "iod_deciles": f"'[' || coalesce(array_to_string(list_sort(list_distinct(list({number('iod_decile')}))), ', '), '') || ']'",
        "provider_filters_changed": n(of("provider_filter_changed")), "provider_details_viewed": n(of("provider_detail_viewed")), "provider_shortlist_interactions": n(of("provider_shortlisted")), "provider_zoom_ins": n(of("provider_zoom_in")), "provider_zoom_outs": n(of("provider_zoom_out")),
        "provider_zoom_to_la": n(of("provider_zoom_to_la")), "provider_show_more_clicks": n(of("provider_show_more")), "provider_max_page": f"max({number('page')}) FILTER (WHERE event = 'provider_show_more')", "pages_distinct": "count(DISTINCT nullif(path, ''))", "pageviews_total": n(of("$pageview")),
        "visited_home": n("path = '/'") + " > 0", **{f"visited_{x}": n(f"path LIKE '/{x}%'") + " > 0" for x in ("support", "costs", "providers")}, "reached_entitlements_results": n(of("schemes_eligible", " AND form = 'support'")), "reached_costs_results": n(of("schemes_eligible", " AND form = 'costs'")),
    }
    for prefix, where in (("iod_decile", "true"), ("provider_search_iod", of("provider_search"))):
        v = f"({number('iod_decile')})"
        out |= {f"{prefix}_{k}": x.format(v=v) + f" FILTER (WHERE {where})" + (", 2)" if k == "mean" else "") for k, x in (("min", "min({v})"), ("max", "max({v})"), ("mean", "round_even(avg({v})"), ("median", "median({v})"))}
    for x in ("support", "costs"):
        own = of("step_completed", f" AND form = '{x}'")
        rank = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(S.STEPS))
        out |= {f"steps_completed_{x}": n(own), f"distinct_steps_{x}": f"count(DISTINCT step) FILTER (WHERE {own})", f"furthest_step_{x}": f"arg_max(step, CASE step {rank} END) FILTER (WHERE {own} AND step IN {S.STEPS})"}
    for name, step in S.ANSWERS.items():
        yes, no = (n(of("step_completed", f" AND step = '{step}' AND \"{name}\" = '{v}'")) for v in ("true", "false"))
        out |= {f"{name}_true": yes, f"{name}_false": no, f"{name}_pct": f"round_even({yes} / nullif({yes} + {no}, 0), 4)"}
    children, changed = of("step_completed", " AND step = 'children'"), of("provider_filter_changed")
    out |= {f"child_count_{k}": n(f"{children} AND child_count = '{v}'") for k, v in (("1", 1), ("2", 2), ("3plus", 3))}
    out |= {f"youngest_band_{k}": n(f"{children} AND youngest_band = '{v}'") for k, v in (("0_4", "0-4"), ("5_plus", "5+"))}
    out |= {f"care_sought_{k}": times("care_types_sought", k, of("step_completed", " AND step = 'childcare'")) for k in S.CARE[:3]}
    out |= {column: times("schemes", k, of("schemes_eligible")) for k, column in S.SCHEMES.items()}
    out |= {f"provider_filter_care_{k}": times("care_types", k, changed) for k in S.CARE} | {f"provider_shortlist_{k}": times("shortlist_care_types", k, of("provider_shortlisted")) for k in S.CARE}
    out |= {f"provider_filter_funded_hours_{x}": n(f"{changed} AND funded_hours_only = '{x}'") for x in ("true", "false")} | {f"provider_sort_{x}": n(f"{changed} AND sort_by = '{x}'") for x in ("distance", "best_ofsted")}
    out |= {f"provider_child_band_{k}": times("child_age_bands", v, changed) for k, v in (("0_4", "0-4"), ("5_plus", "5+"))} | {f"provider_detail_dist_band_{k}": n(of("provider_detail_viewed", f" AND distance_band = '{b}'")) for b, k in S.BANDS.items()}
    out |= {f"provider_zoom_{x}": n(f"event IN ('provider_zoom_in', 'provider_zoom_out') AND source = '{x}'") for x in ("keyboard", "button")}
    every = ", ".join(f'{v} AS "{k}"' for k, v in out.items())
    return f"""WITH k AS (SELECT 's' || user_id || '-' || event_id % 40 AS session_id, event_id, date_trunc('second', ts) AS ts, {names} AS event, event_id // {_N} AS k FROM events), m AS (SELECT *, {', '.join(columns)} FROM k), e AS (SELECT *, "$pathname" AS path FROM m),
a AS (SELECT session_id, lad25cd, count(*) AS n, min((ts, event_id)) AS seen FROM e WHERE lad25cd NOT IN ('', 'null') GROUP BY 1, 2), mode AS (SELECT session_id, arg_min(lad25cd, (-n, seen)) AS lad_mode FROM a GROUP BY 1),
w AS (SELECT session_id, {every} FROM e GROUP BY session_id) SELECT w.*, lad_mode FROM w LEFT JOIN mode USING (session_id)"""


@query(_sql())
def session_columns(spark, d):
    return S.session_columns(_made(spark, d), keep_id=True)
