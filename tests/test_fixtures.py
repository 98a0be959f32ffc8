"""Provider documents become seven tables whose keys hold; stamps and look-ups."""

import gzip
import json
import re

import pytest
from placelens.sources import fixtures

_DOC = {
    "id": "p12", "name": "Oak", "lad25cd": "E1", "institutionType": "nursery", "latitude": 51.5, "phone": "+44 (1234) 567", "address": {"line1": "1 High St", "postcode": "AB1 2CD"},
    "ofsted": {"rating": "Good", "legacyRating": "", "safeguardingMet": True, "legacySubGrades": {"earlyYears": "Good"}}, "boundingBox": {"geoType": "postcode"}, "bboxGeoCode": "X", "facilities": {"hasGarden": True},
    "careTypes": [
        {"type": "private_nursery", "sessionHours": {"fullDay": 10}, "minimumCommitment": {"amount": 2, "unitPerWeek": "days"}, "fees": {"under2": {"fullDay": 70.5, "perHour": 8}, "age2": 5, "odd": {"fullDay": 1}, "age5plus": {}},
         "openingHours": [{"days": "125", "open": "08:00", "close": "18:00"}], "waitingList": {"under2": {"weeks": 3}, "age2": {"months": 1}}, "notes": [{"type": "a", "description": "b"}], "additionalCharges": [{"item": "i", "cost": 1.5, "unit": "per day", "description": None}]},
        {"type": "breakfast_club", "minimumCommitment": False, "fees": {"perSession": 6.5, "under2": {"fullDay": 1}}, "eligibleAttendeesOnly": True},
    ],
}


def test_tables(spark, tmp_path):
    docs = [_DOC, _DOC, {"id": "p13", "name": "Bare"}, {"id": "p14", "careTypes": []}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, docs)))
    (tmp_path / "b.json").write_text(json.dumps(_DOC, indent=2))
    loaded = fixtures.tables(fixtures.read_documents(spark, f"file://{tmp_path}/a.json"))
    again = fixtures.tables(fixtures.read_documents(spark, f"file://{tmp_path}/b.json", multi_line=True))
    assert {k: v.count() for k, v in loaded.items()} == {"providers": 3, "care_types": 2, "opening_hours": 1, "fee_rates": 3, "additional_charges": 1, "waiting_list_entries": 2, "care_type_notes": 1}
    p = loaded["providers"].where("bigint_id = 12").first()
    assert (p.provider_id, p.phone, p.legacy_rating, p.safeguarding_met, p.legacy_early_years, p.bbox_geo_type, p.bbox_geo_code, p.has_garden, p.care_types) == ("fixture:p12", "01234567", "Good", "true", "Good", "postcode", "X", True, ["private_nursery", "breakfast_club"])
    assert loaded["providers"].where("bigint_id <> 12 and care_types is null").count() == 2
    fees = {(r.age_band, r.full_day, r.per_hour, r.per_session) for r in loaded["fee_rates"].collect()}
    assert fees == {("under2", 70.5, 8.0, None), ("age5plus", None, None, None), ("all", None, None, 6.5)}
    kinds = {r.care_type: (r.min_commitment_amount, r.no_minimum_commitment, r.eligible_attendees_only, r.session_hours_full_day) for r in loaded["care_types"].collect()}
    assert kinds == {"private_nursery": (2.0, False, False, 10.0), "breakfast_club": (None, True, True, None)}
    h = loaded["opening_hours"].first()
    assert (h.monday, h.tuesday, h.wednesday, h.thursday, h.friday, h.open) == (True, True, False, False, True, "08:00")
    ids = lambda x: {r.care_type_id for r in x["care_types"].collect()}
    assert ids(loaded) == ids(again)
    assert all(r.n == 0 for r in fixtures.orphans(loaded).collect())
    assert {r.table: r.n for r in fixtures.orphans({**loaded, "care_types": loaded["care_types"].where("care_type = 'breakfast_club'")}).collect()}["fee_rates"] == 2
    for _ in range(2):
        fixtures.refresh(loaded, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/fee_rates").count() == 3


def test_wrong_id(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "x1"}')
    with pytest.raises(Exception, match="not a provider id"):
        fixtures.tables(fixtures.read_documents(spark, f"file://{tmp_path}/a.json"))["providers"].collect()


def test_stamp_and_postcodes(spark, tmp_path):
    first, second = (r.value for r in fixtures.stamp(spark, f"file://{tmp_path}/s", None).collect())
    assert first == "commit: unknown" and re.fullmatch(r"timestamp: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", second)
    with gzip.open(tmp_path / "p.csv.gz", "wt") as f:
        f.write("postcode,lad\nab12cd,E1\nAB1 2CD,E2\nZZ,E3\nY\n")
    assert {tuple(r) for r in fixtures.postcode_areas(spark, f"file://{tmp_path}/p.csv.gz").collect()} == {("AB1 2CD", "E2"), ("ZZ", "E3")}
