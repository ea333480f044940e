"""Nested catalog rows of loose values."""

import json

from pyspark.sql import functions as F

from sorrel.operators import bundle


def row(**more):
    live = {"publication_state": "published", "published_at": "2026-01-01"}
    return live | more


def test_nested_rows(spark):
    venue = row(id="v1", name="Hall", cities=[{"city_town": "Guelph", "province_state": "ON"}], latitude="43.5", longitude="west", wheelchair_accessible="maybe")
    session = row(
        id="s1", venues=[venue], start_date="2026-07-06T00:00", end_date="soon", schedule_format="fortnight", stay_type=None, price_amount="310.50", age_min="6", age_max=7.5, provider_confirmed="yes", age_min_inclusive=True,
        core_hours_start="09:00:00", core_hours_end="noon", before_care_offered="yes", before_care_start_time="07:30:00", registration_status=None, camp_session_spots=[{"state": "full", "checked_at": "t", "spots_left": None}], notes=" ",
    )
    odd = row(id="s2", venues={**venue, "id": "v2", "name": ""}, camp_session_spots={"state": "full", "checked_at": "t", "spots_left": "x"}, price_amount=True, registration_status="odd")
    program = row(id="p1", slug="p-1", name="Camp", providers={**row(id="pr", name="Org")}, camp_sessions=[session, odd, row(name="no id"), {"id": "s3"}, 7, None], secondary_themes=["a", 1, "b"], prerequisites=[], audience="dogs",
                  camp_packing_items=[{"sort_order": 2, "body": "hat", "kind": "required"}, {"body": "book", "kind": "suggested"}, {"body": "x", "kind": "odd"}, {"body": " ", "kind": "required"}])
    rows = [program, {**program, "id": "p2", "publication_state": "draft"}, {**program, "id": "p3", "providers": []}, {**program, "id": "p4", "name": " "}, {**program, "id": "p5", "published_at": None}]
    raws = [(i, json.dumps(r)) for i, r in enumerate(rows)] + [(7, "[1]"), (8, "{bad"), (9, None), (10, "3")]
    n = bundle.nested_programs(spark.createDataFrame(raws, "i int, raw string"), "raw", "i")
    (r,) = n.collect()
    assert (r.program.id, r.program.secondary_themes, r.program.prerequisites, r.program.audience, r.provider.name) == ("p1", ["a", "b"], None, "unknown", "Org")
    assert [(x.text, x.kind) for x in r.program.packing_items] == [("book", "suggested"), ("hat", "required")]
    one, two = r.sessions
    assert (one.id, one.venue.city, one.venue.latitude, one.venue.longitude, one.venue.wheelchair_accessible) == ("s1", "Guelph", 43.5, None, "unknown")
    assert (one.start_date, one.end_date, one.schedule_format, one.stay_type, one.price_amount, one.age_min, one.age_max) == ("2026-07-06", None, "unknown", None, 310.5, 6, None)
    assert (one.provider_confirmed, one.age_min_inclusive, one.core_hours_start, one.core_hours_end, one.before_care.offered, one.before_care.start, one.after_care.offered, one.notes) == (None, True, "09:00", None, "yes", "07:30", "unknown", None)
    assert one.registration_status == "availability_unknown" and tuple(one.spot_check) == (None, "full", "t")
    assert (two.id, two.venue, two.spot_check, two.price_amount, two.registration_status) == ("s2", None, None, None, "availability_unknown")
    assert [v.id for v in bundle.venues_of(n).collect()] == ["v1"] and [p.id for p in bundle.providers_of(n).collect()] == ["pr"]
    assert sorted((s.id, s.venue_id) for s in bundle.sessions_of(n).collect()) == [("s1", "v1"), ("s2", None)]
    listed = {x.id: (x.title, x.area, x.single_day, x.verification) for x in bundle.camp_listings(n).collect()}
    assert listed == {"s1": ("Camp", "Guelph", None, "unverified"), "s2": ("Camp", None, None, "unverified")}


def test_price_notes(spark):
    rows = [("a", 1.0, "per_day", "CAD"), ("a", 2.0, "per_day", "CAD"), ("b", 1.0, "per_day", "CAD"), ("b", None, "per_day", "CAD"), ("c", 1.0, "per_day", "CAD"), ("c", 1.0, "per_week", "CAD"), ("d", 1.0, "unknown", "CAD"), ("e", 1.0, "per_day", None), ("f", 1.0, "per_day", "CAD"), ("f", 1.0, "per_day", "USD")]
    got = dict(map(tuple, bundle.price_notes(spark.createDataFrame(rows, "o string, price_amount double, price_unit string, currency string"), "o").collect()))
    assert got == {"a": "comparable", "b": "unknown", "c": "incomparable", "d": "unknown", "e": "unknown", "f": "incomparable"}


def test_last_of_equal_ids_wins(spark):
    def program(i, name, venues):
        return (i, json.dumps(row(id=f"p{i}", slug="s", name="n", providers=row(id="same", name=name), camp_sessions=[row(id=f"s{i}{k}", venues=row(id="v", name=v)) for k, v in enumerate(venues)])))

    n = bundle.nested_programs(spark.createDataFrame([program(2, "new", ["c", "d"]), program(1, "old", ["a", "b"])], "i int, raw string"), "raw", "i")
    assert bundle.providers_of(n).first()["name"] == "new" and bundle.venues_of(n).first()["name"] == "d"
    assert bundle.nested_programs(spark.createDataFrame([], "i int, raw string"), "raw", "i").select(F.size("sessions")).count() == 0
