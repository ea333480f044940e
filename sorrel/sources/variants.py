"""JSON of a shape that isn't known before: kept as VARIANT, malformed text as null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.functions.facts import entry_id, number, safe_public_id
from sorrel.functions.jsons import strict_json
from sorrel.functions.text import decode_entities, let


def embedded_json(html: Column, attribute: str) -> Column:
    """VARIANT of the JSON in the first ``attribute="..."`` of a page, its entities decoded; null without one or if it is malformed."""
    found = F.regexp_extract(html, rf"""(?i)\b{attribute}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
    other = F.regexp_extract(html, rf"""(?i)\b{attribute}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 2)
    return strict_json(decode_entities(F.concat(found, other)))


def typed_at(v: Column, path: str, use: Callable[[Column], Column]) -> Column:
    """``use`` of struct<kind, text> of the value at a path, which is looked up once: its kind as SQL names it, and its text."""
    found = v if path == "$" else F.try_variant_get(v, path, "variant")
    return let(F.struct(F.schema_of_variant(found).alias("kind"), F.try_variant_get(v, path, "string").alias("text")), use)


def text_at(v: Column, path: str) -> Column:
    """The string at a path; null for any other kind of value."""
    return typed_at(v, path, lambda x: F.when(x["kind"] == "STRING", x["text"]))


def number_at(v: Column, path: str) -> Column:
    """The finite number at a path, also of a text that is one; null for any other value."""
    return typed_at(v, path, lambda x: F.when((x["kind"] == "STRING") | x["kind"].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number(x["text"])))


def flag_at(v: Column, path: str) -> Column:
    """The boolean at a path; null for any other value."""
    return typed_at(v, path, lambda x: F.when(x["kind"] == "BOOLEAN", x["text"] == "true"))


def elements(rows: DataFrame, variant: str) -> DataFrame:
    """``rows`` with (pos, element) for each element of an array in ``variant``; other values have none."""
    kind = F.schema_of_variant(F.col(variant))
    array = rows.where(kind.startswith("ARRAY")).withColumn("variant_rows", F.col(variant))
    exploded = array.lateralJoin(array.sparkSession.tvf.variant_explode(F.col("variant_rows").outer()))
    return exploded.select(*rows.columns, "pos", F.col("value").alias("element"))


def product_variations(pages: DataFrame, html: str, attribute: str = "data-product_variations", kind_paths: tuple[str, ...] = ("$.attributes.attribute_pa_player_type", "$.attributes['attribute_pa_player-type']"), kinds: tuple[str, ...] = ("goalie", "player")) -> DataFrame:
    """``pages`` (but ``html``) with (pos, kind, price, availability, description, in_stock) for each variation in a page's markup.

    Prices may be numbers or their texts; marks are taken out of texts; a field of another kind is null.
    A page without the attribute, or whose JSON is malformed or no array, has none.
    """

    def bare(text: Column) -> Column:
        return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(text, r"<[^>]*>", " ")), r"\s+", " "))

    keep = [c for c in pages.columns if c != html]
    rows = elements(pages.select(*keep, embedded_json(F.col(html), attribute).alias("variant_json")), "variant_json")
    e = F.col("element")
    kind = F.lower(F.coalesce(*[text_at(e, p) for p in kind_paths]))
    return rows.select(
        *keep, "pos", F.when(kind.isin(*kinds), kind).alias("kind"), number_at(e, "$.display_price").alias("price"), bare(text_at(e, "$.availability_html")).alias("availability"),
        bare(text_at(e, "$.variation_description")).alias("description"), flag_at(e, "$.is_in_stock").alias("in_stock"),
    )


#: Why an item was put aside; fixed values of the stored form.
REASONS = ("removed", "unavailable")


def past_items(rows: DataFrame, raw: str, reasons: tuple[str, ...] = REASONS) -> DataFrame:
    """``rows`` (but ``raw``) with (pos, entry, reason, saved_at, moved_at, registered_at) for each readable item of a stored list.

    An item needs a reference of a known kind with safe ids, and a known reason. A missing or malformed time
    of saving is the epoch, of moving the time of saving, of registering null.
    """
    keep = [c for c in rows.columns if c != raw]
    e = F.col("element")

    def time(path: str) -> Column:
        t = text_at(e, path)
        return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T") & F.try_to_timestamp(t).isNotNull(), t)

    def safe(path: str) -> Column:
        t = text_at(e, path)
        return F.when(safe_public_id(t), t)

    kind, program = text_at(e, "$.ref.kind"), safe("$.ref.programId")
    item = F.when(kind == "camp_session", F.when(program.isNotNull(), safe("$.ref.sessionId"))).when(kind == "camp_program", program).when(kind == "discover_listing", safe("$.ref.listingId"))
    saved = F.coalesce(time("$.savedAt"), F.lit("1970-01-01T00:00:00.000Z"))
    out = elements(rows.select(*keep, strict_json(F.col(raw)).alias("variant_json")), "variant_json").select(
        *keep, "pos", F.when(item.isNotNull(), entry_id(kind, program, item)).alias("entry"), text_at(e, "$.reason").alias("reason"),
        saved.alias("saved_at"), F.coalesce(time("$.movedAt"), saved).alias("moved_at"), time("$.registeredMarkedAt").alias("registered_at"),
    )
    return out.where(F.col("entry").isNotNull() & F.col("reason").isin(*reasons))
