"""Where sessions are: predicates of place, theme, care and date, coverage of places by listings, pins and distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.functions.text import fold_accents

#: The box within which a pin is believed: south, north, west, east; fixed values of the catalog.
MAP_BOX = (43.0, 44.5, -80.5, -78.5)
EARTH_KM = 6371.0088
#: Features of settings; fixed values of the catalog.
SETTINGS = {
    "indoor": ["indoor"], "virtual": ["indoor"], "primarily_indoor": ["indoor", "indoor-fallback"],
    "both": ["indoor", "outdoor", "indoor-fallback"], "outdoor": ["outdoor"], "primarily_outdoor": ["outdoor"],
}


def norm(value: Column) -> Column:
    return F.lower(F.trim(value))


def place_key(name: Column) -> Column:
    """For comparing names of places: folded, other marks as single spaces."""
    return F.trim(F.regexp_replace(fold_accents(name), r"[^a-z0-9]+", " "))


def themes_match(primary: Column, secondary: Column, themes: list[str]) -> Column:
    """One of the asked themes is the program's category or one of its themes; no theme asked passes."""
    own = F.transform(F.array_compact(F.concat(F.array(primary), F.coalesce(secondary, F.expr("CAST(array() AS array<string>)")))), norm)
    return F.arrays_overlap(own, F.array(*[F.lit(t.strip().lower()) for t in themes])) if themes else F.lit(True)


def care_offered(offered: Column) -> Column:
    return offered.eqNullSafe("yes")


def location_match(venue_id: Column, labels: list[Column], locations: list[str], venue_ids: list[str]) -> Column:
    """The session's venue is one of ``venue_ids`` and is labelled as one of ``locations`` (neighbourhood, city or name); an empty list asks nothing."""
    ids = venue_id.isin(*venue_ids) if venue_ids else F.lit(True)
    named = F.exists(F.array_compact(F.array(*map(norm, labels))), lambda x: x.isin(*[v.strip().lower() for v in locations])) if locations else F.lit(True)
    return F.coalesce(ids & named, F.lit(False))


def attendance_days(start: Column, end: Column) -> Column:
    """The known days of a session: its start, and its end if that is another day."""
    return F.array_compact(F.array(start, F.when(~end.eqNullSafe(start), end)))


def in_dates(start: Column, end: Column, day_from: str | None, day_to: str | None) -> Column:
    """The days from start to end (or the start alone) meet the asked ones; an unknown start never does, unless nothing is asked."""
    out = F.lit(True)
    if day_from:
        out = out & (F.coalesce(end, start) >= F.lit(day_from).cast("date")) & start.isNotNull()
    if day_to:
        out = out & (start <= F.lit(day_to).cast("date"))
    return F.coalesce(out, F.lit(False))


def timing_match(label: Column, words: list[str]) -> Column:
    """A session's timing label holds one of the words; no label never does."""
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: norm(label).contains(w)), F.lit(False)) if words else F.lit(True)


def active_filters(**filters) -> int:
    """How many filters of a search are set: lists by their items, others once if they aren't None, empty, false or ``all``."""
    return sum(len(v) if isinstance(v, (list, tuple, set)) else int(v not in (None, "", False, "all")) for v in filters.values())


def has_coordinates(latitude: Column, longitude: Column) -> Column:
    def fine(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return fine(latitude) & fine(longitude)


def effective_coordinates(own: tuple[Column, Column], fallback: tuple[Column, Column]) -> Column:
    """struct<latitude, longitude>: the place's own pair if valid, else the venue's, else null."""
    def pair(lat: Column, lng: Column) -> Column:
        return F.when(lat.between(-90, 90) & lng.between(-180, 180), F.struct(lat.alias("latitude"), lng.alias("longitude")))

    return F.coalesce(pair(*own), pair(*fallback))


def distance_km(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    """Equirectangular distance, good over a city; null if a coordinate is."""
    x = F.radians(lng_b - lng_a) * F.cos(F.radians((lat_a + lat_b) / 2))
    return EARTH_KM * F.sqrt(x * x + F.pow(F.radians(lat_b - lat_a), 2))


def nearest_first(places: DataFrame, latitude: str, longitude: str, key: str, origin: tuple[float, float], within_km: float | None = None) -> DataFrame:
    """Places with ``km`` from the origin, those without coordinates left out; with ``within_km`` a box of degrees reaches the scan first."""
    lat, lng = F.col(latitude), F.col(longitude)
    out = places.where(has_coordinates(lat, lng))
    if within_km is not None:
        span = within_km / (math.pi * EARTH_KM / 180)
        wide = span / max(1e-6, math.cos(math.radians(min(89.0, abs(origin[0]) + span))))
        out = out.where(lat.between(origin[0] - span, origin[0] + span) & lng.between(origin[1] - wide, origin[1] + wide))
    out = out.withColumn("km", distance_km(F.lit(origin[0]), F.lit(origin[1]), lat, lng))
    return (out if within_km is None else out.where(F.col("km") <= within_km)).orderBy("km", key)


def distance_availability(has: Column) -> Column:
    """Aggregate: why no distance is shown for a group of venues. A distance is never guessed from a city."""
    return F.when(F.bool_or(has), "no_map").otherwise("no_coordinates")


def in_province(province: Column, names: tuple[str, ...] = ("on", "ontario")) -> Column:
    """The province is one of the names, or isn't stated."""
    return F.coalesce(province.isNull() | (province == "") | place_key(province).isin(*names), F.lit(True))


def coverage(sessions: DataFrame, venues: DataFrame, venue: str, city: str, neighbourhood: str, province: str) -> DataFrame:
    """(level, place, venue): the venues with a listed session, by the names of their city and neighbourhood."""
    listed = venues.join(sessions.where(F.col(venue).isNotNull()).select(venue).distinct(), venue, "left_semi").where(in_province(F.col(province)))
    names = F.array(*[F.struct(F.lit(level).alias("level"), place_key(F.col(c)).alias("place")) for level, c in (("city", city), ("neighbourhood", neighbourhood))])
    return listed.select(venue, F.inline(names)).where("place IS NOT NULL AND place <> ''").select("level", "place", venue).distinct()


def location_index(places: DataFrame, key: str, name: str) -> DataFrame:
    """(key, place, ambiguous): the searchable names of a list of places, and whether several share one."""
    named = places.select(key, place_key(F.col(name)).alias("place"))
    shared = named.groupBy("place").agg((F.count_distinct(key) > 1).alias("ambiguous"))
    return named.join(shared, "place").select(key, "place", "ambiguous")


def resolve_locations(asked: DataFrame, index: DataFrame, covered: DataFrame, key: str, venue: str) -> DataFrame:
    """(asked columns, status, matched_by): none, unknown_location, no_listings, unconfirmed (several places share the name) or covered.

    A place matches listings by its own name only: a city first, else a neighbourhood.
    """
    have = covered.groupBy("place").agg(F.bool_or(F.col("level") == "city").alias("as_city"))
    found = asked.join(index.select(F.col(key).alias("known_key"), "place", "ambiguous"), F.col(key) == F.col("known_key"), "left").join(have, "place", "left")
    status = (
        F.when(F.coalesce(F.col(key).cast("string"), F.lit("")) == "", "none").when(F.col("known_key").isNull(), "unknown_location")
        .when(F.col("as_city").isNull(), "no_listings").when(F.col("ambiguous"), "unconfirmed").otherwise("covered")
    )
    by = F.when(status == "covered", F.when(F.col("as_city"), "city").otherwise("neighbourhood"))
    return found.select(*asked.columns, "place", status.alias("status"), by.alias("matched_by"))


def venues_of(resolved: DataFrame, covered: DataFrame, venue: str) -> DataFrame:
    """(resolved columns, venue): the venues that a covered location allows; other statuses allow none."""
    hit = covered.select(F.col("level").alias("matched_by"), "place", venue)
    return resolved.where("status = 'covered'").join(hit, ["matched_by", "place"])


def map_pins(matches: DataFrame, venues: DataFrame, venue: str, program: str, latitude: str, longitude: str, name: str, box: tuple[float, float, float, float] = MAP_BOX) -> tuple[DataFrame, DataFrame]:
    """(pins (venue, lat, lng, title, camps), programs that no pin shows): one pin a venue, each program once on it. A venue outside the box isn't believed."""
    lat, lng = F.col(latitude), F.col(longitude)
    usable = venues.where(lat.between(box[0], box[1]) & lng.between(box[2], box[3]))
    on = matches.select(program, venue).distinct().join(usable.select(venue, lat.alias("lat"), lng.alias("lng"), F.col(name).alias("title")), venue)
    pins = on.groupBy(venue, "lat", "lng", "title").agg(F.count("*").alias("camps"))
    return pins, matches.select(program).distinct().join(on.select(program), program, "left_anti")


def setting_features(indoor_outdoor: Column) -> Column:
    """What a program's setting offers; an unknown setting offers nothing that is known."""
    table = SETTINGS
    out = F.expr("CAST(array() AS array<string>)")
    for value, names in table.items():
        out = F.when(indoor_outdoor == value, F.array(*map(F.lit, names))).otherwise(out)
    return out


def rain_pivot(sessions: DataFrame, programs: DataFrame, program: str, setting: str) -> DataFrame:
    """Sessions with ``verdict``: kept under cover, hidden_outdoor, or hidden_unknown (no program, or its setting isn't known)."""
    features = setting_features(F.col(setting))
    cover = F.arrays_overlap(features, F.array(F.lit("indoor"), F.lit("indoor-fallback")))
    verdict = F.when(cover, "kept").when(F.col(setting).isin("outdoor", "primarily_outdoor"), "hidden_outdoor").otherwise("hidden_unknown")
    joined = sessions.join(programs.select(F.col(program).alias("pivot_program"), F.col(setting)), F.col(program) == F.col("pivot_program"), "left")
    return joined.withColumn("verdict", verdict).select(*sessions.columns, "verdict")


def inclement(code: Column) -> Column:
    """Weather codes of drizzle, rain, snow, showers and storms; fixed values of the code."""
    spans = ((51, 67), (71, 77), (80, 82), (85, 86), (95, 99))
    out = F.lit(False)
    for lo, hi in spans:
        out = out | code.between(lo, hi)
    return F.coalesce(out, F.lit(False))


def weather_phrase(code: Column) -> Column:
    return F.when(code == 0, "clear").when(code <= 3, "cloudy").when(code.isin(45, 48), "fog").when(inclement(code), "wet or stormy").otherwise("mixed")


def weather_reading(payload: Column) -> Column:
    """struct<at, code, inclement, phrase> of a forecast's JSON; null without a code and a time."""
    now = F.from_json(payload, "struct<current: struct<weather_code: double, time: string>>")["current"]
    return F.when(now["weather_code"].isNotNull() & (now["time"] != ""), F.struct(now["time"].alias("at"), now["weather_code"].alias("code"), inclement(now["weather_code"]).alias("inclement"), weather_phrase(now["weather_code"]).alias("phrase")))


def access_rows(programs: DataFrame, providers: DataFrame, sessions: DataFrame, program: str, provider: str, name: str, checked: str, facts: list[str]) -> DataFrame:
    """Programs with their provider's name, the day that a session was last checked, and access facts as yes, no or unknown."""
    last = sessions.groupBy(F.col(program).alias("checked_program")).agg(F.max(checked).alias("last_verified"))
    named = providers.select(F.col(provider).alias("named_provider"), F.col(name).alias("provider_name"))
    out = programs.join(last, F.col(program) == F.col("checked_program"), "left").join(named, F.col(provider) == F.col("named_provider"), "left")
    return out.select(program, F.coalesce("provider_name", F.lit("Provider unknown")).alias("provider_name"), "last_verified", *[F.when(F.col(f).isin("yes", "no"), F.col(f)).otherwise("unknown").alias(f) for f in facts])


def passes_toggles(toggles: list[str]) -> Column:
    """Each asked access fact is a known yes."""
    out = F.lit(True)
    for t in toggles:
        out = out & F.col(t).eqNullSafe("yes")
    return out


def transit_stops(venues: DataFrame, note: str, latitude: str, longitude: str, placed: bool = False) -> DataFrame:
    """Venues with a transit note; with ``placed`` only those with coordinates."""
    out = venues.where(F.trim(F.col(note)) != "").withColumn(note, F.trim(note))
    return out.where(F.col(latitude).isNotNull() & F.col(longitude).isNotNull()) if placed else out
