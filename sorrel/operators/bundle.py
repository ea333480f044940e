"""Published catalog rows, which come as nested JSON of loose values, mapped to typed nested records in one plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.functions.facts import clock, iso_day, text_or_null
from sorrel.functions.jsons import strict_json
from sorrel.functions.text import let
from sorrel.sources.variants import flag_at, number_at, text_at, typed_at

# Members of the catalog's enumerations; fixed values of its format.
AUDIENCES = ("child_only", "parent_and_child", "family", "other", "unknown")
SCHEDULES = ("full_day", "half_day", "short_session", "single_day", "weekly", "multiweek", "other", "unknown")
STAYS = ("day", "overnight", "unknown")
DELIVERIES = ("in_person", "online", "unknown")
PRICE_UNITS = ("per_day", "per_week", "full_program", "per_session", "other", "unknown")
CURRENCIES = ("CAD", "USD", "unknown")
REGISTRATION = ("registration_open", "registration_closed", "no_upcoming_dates", "waitlist", "not_yet_open", "availability_unknown")
SEATS = ("unknown", "confirmed_available", "confirmed_full")
AGE_RULES = ("as_of_date", "as_of_session_start", "unknown")
SPOTS = ("available", "full", "waitlist", "unknown")

Read = Callable[[Column, str], Column]


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def is_object(v: Column) -> Column:
    """Whether a value is an object; its fields aren't looked at, as a schema of it would."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def missing(v: Column, path: str) -> Column:
    """Absent, or the null of JSON."""
    return F.coalesce(F.schema_of_variant(at(v, path)) == "VOID", F.lit(True))


def text(v: Column, path: str) -> Column:
    return typed_at(v, path, lambda x: F.when((x["kind"] == "STRING") & (F.trim(x["text"]) != ""), x["text"]))


def day(v: Column, path: str) -> Column:
    return typed_at(v, path, lambda x: F.when(x["kind"] == "STRING", iso_day(x["text"])))


def time(v: Column, path: str) -> Column:
    return typed_at(v, path, lambda x: F.when(x["kind"] == "STRING", clock(x["text"])))


def whole_number(v: Column, path: str) -> Column:
    return let(number_at(v, path), lambda d: F.when(d == F.floor(d), d.try_cast("long")))


def one_of(members: tuple[str, ...], unknown: str = "unknown") -> Read:
    """A member stays, null stays null, anything else is the unknown member."""
    return lambda v, path: typed_at(v, path, lambda x: F.when(x["kind"] != "VOID", F.when((x["kind"] == "STRING") & x["text"].isin(*members), x["text"]).otherwise(unknown)))


def tri_or_null(v: Column, path: str) -> Column:
    return one_of(("yes", "no", "unknown"))(v, path)


def tri(v: Column, path: str) -> Column:
    return F.coalesce(tri_or_null(v, path), F.lit("unknown"))


def texts(v: Column, path: str) -> Column:
    """The strings of an array; empty for anything else."""
    items = F.try_variant_get(v, path, "array<variant>")
    found = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(found, F.expr("CAST(array() AS array<string>)"))


def one(v: Column, path: str) -> Column:
    """An embedded row, or the first of an array of them; null if that is no row."""
    return let(F.struct((v if path == "$" else at(v, path)).alias("own"), at(v, f"{path}[0]").alias("first")), lambda x: F.when(is_object(x["own"]), x["own"]).when(is_object(x["first"]), x["first"]))


def many(v: Column, path: str) -> Column:
    """The rows of an embedded array."""
    return F.coalesce(F.filter(F.try_variant_get(v, path, "array<variant>"), is_object), F.expr("CAST(array() AS array<variant>)"))


def record(v: Column, fields: dict[str, Any]) -> Column:
    """A struct with each field read from the member of its name, or as a pair (member, how) says; a dict is a struct of more of the members; Columns stay.

    The object is taken apart once, as a look-up of each path would go over all its members anew.
    """

    def plan(fields: dict[str, Any]) -> dict[str, Any]:
        return {name: plan(how) if isinstance(how, dict) else how if isinstance(how, (Column, tuple)) else (name, how) for name, how in fields.items()}

    def members(fields: dict[str, Any]) -> list[str]:
        return [m for how in fields.values() if not isinstance(how, Column) for m in (members(how) if isinstance(how, dict) else [how[0]])]

    def made(own: Column, fields: dict[str, Any]) -> Column:
        return F.struct(*[(how if isinstance(how, Column) else made(own, how) if isinstance(how, dict) else how[1](own[how[0]], "$")).alias(name) for name, how in fields.items()])

    planned = plan(fields)
    kind = ", ".join(f"`{m}` variant" for m in dict.fromkeys(members(planned)))
    return let(F.try_variant_get(v, "$", f"struct<{kind}>"), lambda own: made(own, planned))


def published(v: Column) -> Column:
    return F.coalesce((text_at(v, "$.publication_state") == "published") & text(v, "$.published_at").isNotNull(), F.lit(False))


def provider_of(v: Column) -> Column:
    """A published provider with an id and a name, else null."""
    own = record(v, {"id": text, "name": text, "website_url": text, "registration_info_url": text, "notes": text})
    return F.when(published(v), let(own, lambda x: F.when(x["id"].isNotNull() & x["name"].isNotNull(), x)))


def venue_of(v: Column) -> Column:
    """A published venue with an id and a name, its city's fields beside its own, else null."""
    city = ("cities", lambda x, path: let(one(x, path), lambda c: record(c, {"town": ("city_town", text), "province": ("province_state", text)})))
    own = record(v, {"id": text, "name": text, "neighbourhood": text, "address_line": text, "in": city, "postal_code": text, "latitude": number_at, "longitude": number_at, "notes": text, "wheelchair_accessible": tri_or_null})

    def flat(x: Column) -> Column:
        first = ("id", "name", "neighbourhood", "address_line")
        rest = ("postal_code", "latitude", "longitude", "notes", "wheelchair_accessible")
        return F.struct(*[x[n].alias(n) for n in first], x["in"]["town"].alias("city"), x["in"]["province"].alias("province"), *[x[n].alias(n) for n in rest])

    return F.when(published(v), let(own, lambda x: F.when(x["id"].isNotNull() & x["name"].isNotNull(), flat(x))))


def care_of(name: str) -> dict[str, Any]:
    return {"offered": (f"{name}_offered", tri), "start": (f"{name}_start_time", time), "end": (f"{name}_end_time", time), "separate": (f"{name}_separate_booking", tri)}


def spots_of(v: Column, path: str) -> Column:
    """The reading of a session's spots; null if its state, its time or a stated count can't be understood."""
    def read(row: Column) -> Column:
        own = record(row, {"spots_left": whole_number, "state": text, "checked_at": text})
        return let(own, lambda x: F.when(x["state"].isin(*SPOTS) & x["checked_at"].isNotNull() & (x["spots_left"].isNotNull() | missing(row, "$.spots_left")), x))

    return let(one(v, path), read)


def session_of(v: Column) -> Column:
    """A published session with an id, with its venue inside, else null."""
    own = record(v, {
        "id": text, "venue": ("venues", lambda x, path: let(one(x, path), venue_of)), "start_date": day, "end_date": day, "timing_label": text, "schedule_format": one_of(SCHEDULES), "stay_type": one_of(STAYS), "delivery_mode": one_of(DELIVERIES),
        "core_hours_start": time, "core_hours_end": time, "before_care": care_of("before_care"), "after_care": care_of("after_care"), "price_amount": number_at, "price_unit": one_of(PRICE_UNITS), "currency": one_of(CURRENCIES),
        "fee_notes": text, "registration_status": lambda x, path: F.coalesce(one_of(REGISTRATION, "availability_unknown")(x, path), F.lit("availability_unknown")), "registration_opens_on": day, "registration_deadline_on": day,
        "waitlist_url": text, "registration_url": text, "source_url": text, "source_checked_date": day, "provider_confirmed": flag_at, "seat_availability": one_of(SEATS), "spot_check": ("camp_session_spots", spots_of), "age_min": whole_number, "age_max": whole_number,
        "age_min_inclusive": flag_at, "age_max_inclusive": flag_at, "age_assessed_at_date": day, "age_assessment_rule": one_of(AGE_RULES), "notes": text,
    })
    return F.when(published(v), let(own, lambda x: F.when(x["id"].isNotNull(), x)))


def packing_of(v: Column) -> Column:
    """What to bring, in its own order: items with a text that are required or suggested; null if there are none."""
    rows = F.transform(many(v, "$.camp_packing_items"), lambda x, i: F.struct(F.coalesce(number_at(x, "$.sort_order"), F.lit(0.0)).alias("sort"), i.alias("i"), text(x, "$.body").alias("text"), text_at(x, "$.kind").alias("kind")))
    known = F.array_sort(F.filter(rows, lambda x: x["text"].isNotNull() & x["kind"].isin("required", "suggested")))
    return F.when(F.size(known) > 0, F.transform(known, lambda x: F.struct(x["text"].alias("text"), x["kind"].alias("kind"))))


def nested_programs(rows: DataFrame, raw: str, order: str) -> DataFrame:
    """(order, program, provider, sessions): each published program of JSON texts with its provider and its published sessions, venues within them.

    A program needs an id, a slug, a name and a published provider. Text that isn't one JSON object, and
    drafts at any level, are left out; a value of another kind than its field's is null or unknown. Write the
    result before it is taken apart, so that each row is mapped once.
    """
    v = F.col("v")
    need = texts(v, "$.prerequisites")
    program = record(v, {
        "id": text, "slug": text, "name": text, "description": text, "primary_category": text, "secondary_themes": texts, "typical_age_min": whole_number, "typical_age_max": whole_number, "typical_age_min_inclusive": flag_at,
        "typical_age_max_inclusive": flag_at, "typical_age_assessed_at_date": day, "audience": one_of(AUDIENCES), "notes": text, "accessibility_support_tags": texts, "experience_summary": text, "prerequisites": F.when(F.size(need) > 0, need),
        "support_info": text, "policies_summary": text, "preparation_notes": text, "packing_items": packing_of(v),
    })

    def shown(x: Column) -> Column:
        stated = reduce(lambda a, f: a & text(x, f"$.{f}").isNotNull(), ("id", "slug", "name"), published(x))
        offered = let(one(x, "$.providers"), lambda p: published(p) & text(p, "$.id").isNotNull() & text(p, "$.name").isNotNull())
        return is_object(x) & stated & F.coalesce(offered, F.lit(False))

    # Rows are chosen by exploding: a condition would be moved below the parser, which each of its parts would then call anew.
    base = rows.select(F.col(order).alias("order"), F.explode(F.filter(F.array(strict_json(F.col(raw))), shown)).alias("v"))
    sessions = F.filter(F.transform(many(v, "$.camp_sessions"), session_of), lambda s: s.isNotNull())
    return base.select("order", program.alias("program"), let(one(v, "$.providers"), provider_of).alias("provider"), sessions.alias("sessions"))


def sessions_of(nested: DataFrame) -> DataFrame:
    """A row a session: program_id, the session's fields, and venue_id for its venue."""
    rows = nested.select("order", F.col("program.id").alias("program_id"), F.posexplode("sessions").alias("place", "s"))
    return rows.select("program_id", *[F.col(f"s.{f}").alias(f) for f in nested.schema["sessions"].dataType.elementType.names if f != "venue"], F.col("s.venue.id").alias("venue_id"))


def venues_of(nested: DataFrame) -> DataFrame:
    """A row a venue: of rows with one id the last one, as programs and their sessions come."""
    rows = nested.select("order", F.posexplode("sessions").alias("place", "s")).where("s.venue IS NOT NULL")
    return rows.groupBy(F.col("s.venue.id").alias("venue_key")).agg(F.max(F.struct("order", "place", "s.venue")).alias("last")).select("last.venue.*")


def providers_of(nested: DataFrame) -> DataFrame:
    """A row a provider: of rows with one id the last one."""
    return nested.groupBy(F.col("provider.id").alias("provider_key")).agg(F.max(F.struct("order", "provider")).alias("last")).select("last.provider.*")


#: The columns that a listing has, whatever it lists.
LISTING = ("id", "category", "title", "provider_name", "area", "age_min", "age_max", "age_min_inclusive", "age_max_inclusive", "primary_category", "last_verified_on", "verification", "price_amount", "price_unit", "currency", "start_date", "end_date", "single_day")


def camp_listings(nested: DataFrame) -> DataFrame:
    """LISTING rows of sessions. A session of a known other format is of one day if its dates are equal; one whose format isn't known is neither."""
    rows = nested.select("program", "provider", F.explode("sessions").alias("s"))
    s = lambda f: F.col(f"s.{f}")
    area = F.coalesce(text_or_null(F.trim(s("venue.neighbourhood"))), text_or_null(F.trim(s("venue.city"))))
    same = F.coalesce(s("start_date") == s("end_date"), F.lit(False))
    single = F.when(s("schedule_format") == "single_day", True).when(~F.coalesce(s("schedule_format"), F.lit("unknown")).eqNullSafe("unknown"), same)
    checked = s("source_checked_date")
    proof = F.when(s("provider_confirmed").eqNullSafe(True) & checked.isNotNull(), "provider_confirmed").when(checked.isNotNull(), "source_checked").otherwise("unverified")
    return rows.select(
        s("id").alias("id"), F.lit("camps").alias("category"), F.col("program.name").alias("title"), F.col("provider.name").alias("provider_name"), area.alias("area"), *[s(f).alias(f) for f in LISTING[5:9]],
        F.col("program.primary_category").alias("primary_category"), checked.alias("last_verified_on"), proof.alias("verification"), *[s(f).alias(f) for f in LISTING[12:17]], single.alias("single_day"),
    )


def venue_listings(places: DataFrame, types: DataFrame, key: str = "id") -> DataFrame:
    """LISTING rows of places to play (key, name, branch_name, neighbourhood, city, place_type, ages, source_checked_date); ``types``: (key, place_type, is_primary)."""
    main = types.where("is_primary").groupBy(F.col(key).alias("type_key")).agg(F.min("place_type").alias("main_type"))
    p = places.join(main, F.col(key) == F.col("type_key"), "left")
    both = F.col("neighbourhood").isNotNull() & F.col("city").isNotNull()
    null = lambda kind: F.lit(None).cast(kind)
    return p.select(
        F.col(key).cast("string").alias("id"), F.lit("play").alias("category"), F.when(F.coalesce("branch_name", F.lit("")) != "", F.concat_ws(", ", "name", "branch_name")).otherwise(F.col("name")).alias("title"), null("string").alias("provider_name"),
        F.when(both, F.concat_ws(", ", "neighbourhood", "city")).otherwise(F.coalesce("neighbourhood", "city")).alias("area"), *[F.col(f) for f in LISTING[5:9]], F.coalesce("main_type", "place_type").alias("primary_category"),
        F.col("source_checked_date").alias("last_verified_on"), F.lit("source_checked").alias("verification"), null("double").alias("price_amount"), null("string").alias("price_unit"), null("string").alias("currency"),
        null("string").alias("start_date"), null("string").alias("end_date"), null("boolean").alias("single_day"),
    )


def price_notes(columns: DataFrame, owner: str, amount: str = "price_amount", unit: str = "price_unit", currency: str = "currency") -> DataFrame:
    """(owner, note): whether the prices that an owner compares are unknown (at least one), incomparable (units or currencies differ) or comparable."""
    known = F.col(amount).isNotNull() & (F.coalesce(unit, F.lit("unknown")) != "unknown") & (F.coalesce(currency, F.lit("unknown")) != "unknown")
    differ = (F.min(unit) != F.max(unit)) | (F.min(currency) != F.max(currency))
    return columns.groupBy(owner).agg(F.when(~F.every(known), "unknown").when(differ, "incomparable").otherwise("comparable").alias("note"))
