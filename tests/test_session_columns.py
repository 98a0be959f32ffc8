import datetime
import json

from placelens.operators.session_columns import session_columns
from placelens.plans import sessions

_SHAPE = "session_id string, event_id long, ts timestamp, event string, properties string"


def _events(spark, rows):
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(s, k, None if t is None else at + datetime.timedelta(seconds=t), e, p if p is None or isinstance(p, str) else json.dumps(p)) for k, (s, t, e, p) in enumerate(rows)], _SHAPE)


def test_properties_are_read_once_and_events_dealt_once(spark, tmp_path):
    events = _events(spark, [("a", 0, "$pageview", {})])
    plan = session_columns(events, keep_id=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("Exchange ") == 1 and "Join" not in plan
    spark.range(50).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' AS ts", "id % 3 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    made = sessions.session_columns(spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("Exchange ") == 1 and made.count() == 50


def test_columns_of_a_session(spark):
    rows = [
        ("a", 5, "step_completed", {"form": "costs", "step": "childcare", "care_types_sought": '["childminder", "childminder", 3]', "$device_type": "Mobile", "$referring_domain": "later"}),
        ("a", 0, "provider_search", {"lad25cd": "null", "iod_decile": "4", "$pathname": "/providers/x", "$device_type": ""}),
        ("a", 5, "schemes_eligible", {"form": "support", "schemes": ["haf", "haf", None, "none such"], "lad25cd": "E2", "iod_decile": 3.0}),
        ("a", 6, "step_completed", {"form": "costs", "step": "other", "lad25cd": "E1", "iod_decile": "3.5"}),
        ("a", 7, "step_completed", {"form": "costs", "step": "working", "working": True, "is_studying": "false", "lad25cd": "E1"}),
        ("a", 8, "step_completed", {"form": "costs", "step": "working", "working": False, "lad25cd": "E2", "iod_decile": 10}),
        ("a", 9, "provider_show_more", {"page": "12", "$pathname": "/"}), ("a", 9, "provider_show_more", {"page": 9, "$pathname": "/"}), ("a", 9, "provider_zoom_out", {"source": "button"}),
        ("b", 3, "$pageview", '{"lad25cd": "E1", broken'), ("b", 4, "provider_search", '[{"lad25cd": "E1"}]'), ("b", 4, "provider_search", None), (None, 1, "$pageview", {}), ("", 1, "$pageview", {}), ("c", None, "$pageview", {}),
    ]
    got = {r.session_id: r.asDict() for r in session_columns(_events(spark, rows), keep_id=True).collect()}
    assert set(got) == {"a", "b"}
    want = {
        "session_duration_s": 9.0, "event_count_form": 0, "event_count_provider": 1, "event_count_other": 8, "device_type": "Mobile", "referrer_domain": None, "steps_completed_costs": 4, "steps_completed_support": 0,
        "distinct_steps_costs": 3, "furthest_step_costs": "childcare", "furthest_step_support": None, "reached_entitlements_results": 1, "reached_costs_results": 0, "lad_codes": '["E1", "E2"]', "lad_count": 2, "lad_mode": "E2",
        "iod_decile_min": 3, "iod_decile_max": 10, "iod_decile_mean": 5.67, "iod_decile_median": 4.0, "iod_deciles": "[3, 4, 10]", "working_true": 1, "working_false": 1, "working_pct": 0.5, "is_studying_pct": 0.0, "has_partner_pct": None,
        "care_sought_childminder": 2, "scheme_haf": 2, "provider_searches": 1, "provider_search_lads": '["null"]', "provider_search_iod_median": 4.0, "provider_zoom_button": 1, "provider_max_page": 12, "pages_distinct": 2, "visited_home": True, "visited_providers": True, "visited_costs": False,
    }
    assert {k: got["a"][k] for k in want} == want
    empty = {"event_count_other": 3, "pageviews_total": 1, "provider_searches": 2, "lad_codes": "[]", "lad_mode": None, "iod_decile_mean": None, "pages_distinct": 0, "device_type": None}
    assert {k: got["b"][k] for k in empty} == empty


def test_texts_with_brackets_stay_whole_in_lists(spark):
    events = _events(spark, [("a", k, "provider_search", {"lad25cd": x}) for k, x in enumerate(("E]1", '["', "E2]"))])
    [row] = session_columns(events).collect()
    assert json.loads(row.lad_codes) == sorted(("E]1", '["', "E2]")) and row.provider_search_lads == row.lad_codes and "session_id" not in row
