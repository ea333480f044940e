"""Facts as a catalog stores them: loose values to typed ones, one canonical form of a record, and its fingerprint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "camp-facts-v2"
#: Fields that say how a fact was read and not what it is.
OBSERVATION = frozenset(("rawValue", "observedAt", "extractionMethod"))
# What a record of each type states; a type that isn't named states all its fields. Fixed values of the stored form.
SESSION_V1 = (
    "startDate", "endDate", "weekIdentity", "weekNumber", "themeTitle", "themeTitleNormalized", "ageMin", "ageMax", "priceTierKey", "priceTierLabel", "priceAmount", "priceUnit", "currency",
    "shortWeekPriceAmount", "addOnFeeCad", "addOnLabel", "outingLabel", "coreHoursStart", "coreHoursEnd", "registrationUrl", "registrationPlatform",
)
ALLOWED = {
    "program": (
        "name", "marketingAgeMin", "marketingAgeMax", "typicalAgeMin", "typicalAgeMax", "derivedAvailableAgeMin", "derivedAvailableAgeMax", "seasonStartDate", "seasonEndDate", "coreHoursStart", "coreHoursEnd",
        "registrationUrl", "registrationPlatform", "policies", "businessAddress", "knownGaps",
    ),
    "session": (*SESSION_V1, "scheduleFormat", "gradeMin", "gradeMax", "ageBands", "seatAvailability", "registrationStatus", "enrolmentCapPerWeek", "beforeCare", "afterCare", "priceOptions"),
    "venue": ("name", "addressLine", "city", "province", "postalCode"),
    "provider": ("name", "websiteUrl", "registrationPlatform"),
}
#: Never a fact, in whatever record or depth.
EXCLUDED = frozenset((
    "observations", "factScope", "sharedObservationKey", "externalId", "providerId", "programId", "venueId", "sourceUrl", "sourceSnapshotId", "snapshotId", "extractionRunId", "observedAt", "extractionMethod", "rawValue", "confidence", "warnings",
))
#: Lists whose items have a form of their own: the fields in the order in which items are sorted, and those that stand only where an item has them.
ITEMS = {"ageBands": (("ageMin", "ageMax", "hoursStart", "hoursEnd", "label"), ("label",)), "priceOptions": (("key", "label", "amount", "unit", "currency"), ())}


def text_or_null(value: Column) -> Column:
    """The text, null if blank."""
    return F.when(F.trim(value) != "", value)


def number(value: Column) -> Column:
    """A finite double of a number or of a text that is one: decimal, with an exponent, or 0x, 0o and 0b; else null."""
    t = F.trim(value.cast("string"))
    decimal = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    digits = F.substring(t, F.lit(3), F.char_length(t))
    other = [F.when(t.rlike(f"^0[{k}{k.upper()}][{d}]+$"), F.conv(digits, n, 10).cast("double")) for k, d, n in (("x", "0-9a-fA-F", 16), ("o", "0-7", 8), ("b", "01", 2))]
    d = F.coalesce(decimal, *other)
    return F.when(F.abs(d) < float("inf"), d)


def whole(value: Column) -> Column:
    """A whole number, else null."""
    d = number(value)
    return F.when(d == F.floor(d), d.try_cast("long"))


def iso_day(value: Column) -> Column:
    """The first ten characters of a text that begins with a date."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(value, 1, 10))


def clock(value: Column) -> Column:
    """HH:MM of a text that begins so."""
    return F.when(value.rlike(r"^\d{2}:\d{2}"), F.substring(value, 1, 5))


def texts(value: Column) -> Column:
    """An array of texts without nulls; a null array is empty."""
    return F.coalesce(F.array_compact(value), F.expr("CAST(array() AS array<string>)"))


def first_embedded(rows: Column) -> Column:
    """The first of embedded rows, or null."""
    return F.get(rows, F.lit(0))


def care_window(offered: Column, start: Column, end: Column, separate: Column) -> Column:
    """struct<offered, start, end, separate> of a care window's columns; offered and separate are yes, no or unknown."""
    def tri(c: Column) -> Column:
        return F.when(c.isin("yes", "no"), c).otherwise("unknown")

    return F.struct(tri(offered).alias("offered"), clock(start).alias("start"), clock(end).alias("end"), tri(separate).alias("separate"))


def spot_check(state: Column, left: Column, checked_at: Column) -> Column:
    """struct<spots_left, state, checked_at> of a reading; null if its state, its time or a stated count can't be understood."""
    count = whole(left)
    fine = state.isin("available", "full", "waitlist", "unknown") & text_or_null(checked_at).isNotNull() & (left.isNull() | count.isNotNull())
    return F.when(fine, F.struct(count.alias("spots_left"), state.alias("state"), checked_at.alias("checked_at")))


def packing_items(items: Column) -> Column:
    """array<struct<text, kind>> of the required and suggested items with a text, by their place; null if there are none. ``items``: array<struct<sort_order, body, kind>>."""
    known = F.filter(items, lambda x: (F.trim(x["body"]) != "") & x["kind"].isin("required", "suggested"))
    placed = F.array_sort(F.transform(known, lambda x, i: F.struct(F.coalesce(x["sort_order"], F.lit(0)).alias("sort"), i.alias("i"), x["body"].alias("text"), x["kind"].alias("kind"))))
    return F.when(F.size(placed) > 0, F.transform(placed, lambda x: F.struct(x["text"], x["kind"])))


def published(state: Column, at: Column) -> Column:
    return F.coalesce((state == "published") & (F.trim(at.cast("string")) != ""), F.lit(False))


def canonical(value: Column, kind: T.DataType, excluded: frozenset[str] = frozenset()) -> Column:
    """One JSON text of a value, whatever the order of its fields and of its arrays' items.

    Fields come in the order of their names, without those ``excluded``; nulls stay nulls, so unknown
    is neither false nor zero. An observation (a struct with ``value`` and one of OBSERVATION) is its value.
    """
    if isinstance(kind, T.StructType):
        names = {f.name: f for f in kind.fields}
        if "value" in names and OBSERVATION & names.keys():
            return canonical(value["value"], names["value"].dataType, excluded)
        fields = [F.concat(F.lit(f'"{n}":'), canonical(value[n], names[n].dataType, excluded)) for n in sorted(names) if n not in excluded]
        out = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")) if fields else F.lit("{}")
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(value, lambda x: canonical(x, kind.elementType, excluded))), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.concat(canonical(e["key"].cast("string"), T.StringType()), F.lit(":"), canonical(e["value"], kind.valueType, excluded)))
        out = F.concat(F.lit("{"), F.array_join(F.array_sort(pairs), ","), F.lit("}"))
    else:
        out = F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", "$1")
    return F.when(value.isNull(), "null").otherwise(out)


def canonical_items(value: Column, item: T.StructType, form: tuple[tuple[str, ...], tuple[str, ...]]) -> Column:
    """The canonical JSON of a list of age bands or price options (see ITEMS): its own fields only, missing ones null, items in the order of what they state.

    An option without a key is known by its role.
    """
    have = {f.name: f.dataType for f in item.fields}
    order, optional = form

    def field(x: Column, n: str) -> tuple[Column, T.DataType]:
        if n == "key" and "role" in have:
            return (F.coalesce(x["key"], x["role"]) if "key" in have else x["role"]), have["role"]
        return (x[n], have[n]) if n in have else (F.lit(None).cast("string"), T.StringType())

    def form_of(x: Column) -> Column:
        stated = F.concat_ws("|", *[F.coalesce(field(x, n)[0].cast("string"), F.lit("")) for n in order])
        body = [F.concat(F.lit(f'"{n}":'), canonical(*field(x, n))) for n in sorted(order) if n in have or n not in optional]
        return F.struct(stated.alias("order"), F.concat(F.lit("{"), F.concat_ws(",", *body), F.lit("}")).alias("json"))

    return F.when(value.isNull(), "null").otherwise(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.transform(value, form_of)), lambda x: x["json"]), ","), F.lit("]")))


def fact_payload(kind: str, fields: dict[str, tuple[Column, T.DataType]], excluded: frozenset[str] = frozenset()) -> Column:
    """The canonical JSON of a record's facts, with its type: of the fields those that ALLOWED names for the type, age bands and price options in their own form."""
    def one(n: str, c: Column, t: T.DataType) -> Column:
        if n in ITEMS and isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            return canonical_items(c, t.elementType, ITEMS[n])
        return canonical(c, t, excluded | EXCLUDED)

    kept = {n: f for n, f in fields.items() if n not in excluded | EXCLUDED and (kind not in ALLOWED or n in ALLOWED[kind])}
    parts = [F.concat(F.lit(f'"{n}":'), one(n, *f)) for n, f in sorted(kept.items())]
    return F.concat(F.lit(f'{{"type":"{kind}","fields":{{'), F.concat_ws(",", *parts), F.lit("}}"))


def set_digest(payload: Column, version: str = VERSION) -> Column:
    """Aggregate: version:sha256:hex of a set of records, in any order.

    The records' digests are summed in eight parts, so no group is gathered; a repeated record counts as often as it stands.
    """
    digest = F.sha2(payload, 256)
    sums = [F.pmod(F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")), F.lit(2**32)).cast("string") for i in range(8)]
    return F.concat(F.lit(f"{version}:sha256:"), F.sha2(F.concat_ws("-", F.count(payload).cast("string"), *sums), 256))


def parse_fingerprint(value: Column) -> Column:
    """struct<version, algorithm, hash>; a fingerprint without a version is of a legacy one; null for anything else."""
    now, old = r"^([^:]*):([^:]*):([0-9a-fA-F]+)$", r"^sha256:([^:]+)$"
    return F.when(value.rlike(now), F.struct(F.regexp_extract(value, now, 1).alias("version"), F.lit("sha256").alias("algorithm"), F.lower(F.regexp_extract(value, now, 3)).alias("hash"))).when(
        value.rlike(old), F.struct(F.lit("legacy-unversioned").alias("version"), F.lit("sha256").alias("algorithm"), F.lower(F.regexp_extract(value, old, 1)).alias("hash"))
    )


def compare_fingerprints(previous: Column, following: Column) -> Column:
    """baseline if either is missing, version_mismatch if either can't be read or their versions differ, else unchanged or changed."""
    a, b = parse_fingerprint(previous), parse_fingerprint(following)
    missing = (F.coalesce(previous, F.lit("")) == "") | (F.coalesce(following, F.lit("")) == "")
    return F.when(missing, "baseline").when(a.isNull() | b.isNull() | (a["version"] != b["version"]), "version_mismatch").when(a["hash"] == b["hash"], "unchanged").otherwise("changed")


def facts_unchanged(previous: Column, following: Column) -> Column:
    return compare_fingerprints(previous, following) == "unchanged"


def values_equal(old: Column, new: Column) -> Column:
    """Whether a proposed value is the catalog's: equal values of one type, nulls equal. A changed spelling is a change, and blank isn't null."""
    return old.eqNullSafe(new)


def same_words(old: Column, new: Column) -> Column:
    """Whether two texts say the same but for case and white space; blank is null, and null says the same as null only."""
    def plain(c: Column) -> Column:
        return F.nullif(F.lower(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " "))), F.lit(""))

    return plain(old).eqNullSafe(plain(new))


def entry_id(kind: Column, program: Column, item: Column) -> Column:
    """The key of a saved item."""
    return F.when(kind == "camp_session", F.concat_ws(":", kind, program, item)).when(kind == "camp_program", F.concat_ws(":", kind, program)).when(kind == "discover_listing", F.concat_ws(":", kind, item))


def safe_public_id(value: Column) -> Column:
    """A text of 1 to 120 characters without a URL's slashes."""
    return F.coalesce(F.char_length(F.trim(value)).between(1, 120) & ~value.contains("//"), F.lit(False))


def whole_ages(ages: Column, most: int = 18) -> Column:
    """Distinct whole ages from 0 to ``most``, ascending, of an array of numbers."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(ages, lambda a: (a == F.floor(a)) & a.between(0, most)), lambda a: a.cast("int"))))


def family_ages(raw: Column) -> Column:
    """struct<ages, as_of> of a stored JSON text; what can't be read is empty."""
    found = F.from_json(raw, "struct<ages: array<double>, asOfDate: string>")
    return F.struct(F.coalesce(whole_ages(found["ages"]), F.expr("CAST(array() AS array<int>)")).alias("ages"), F.when(found["asOfDate"].rlike(r"^\d{4}-\d{2}-\d{2}$"), found["asOfDate"]).alias("as_of"))


def known_ids(raw: Column, allowed: Column) -> Column:
    """The ids of a comma-separated text that are allowed, once each, as they come; null without a text."""
    return F.filter(F.array_distinct(F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")), lambda x: F.array_contains(allowed, x))
