"""Canadian street addresses in lines of text: a street with its number, a town, a province, perhaps a postal code, with commas between."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sorrel.functions.text import let

#: How addresses write provinces, and the codes of those that are written out; fixed values of the format.
PROVINCES = {"ON": "ON", "ONTARIO": "ON", "QC": "QC", "QUEBEC": "QC", **{c: c for c in ("BC", "AB", "MB", "SK", "NS", "NB", "NL", "PE", "YT", "NT", "NU")}}


def street(part: Column) -> Column:
    """From a civic number of up to six digits to the part's end, if three characters or more and at most 60 follow it; null else."""
    found = F.trim(F.regexp_extract(part, r"\d.*$", 0))
    rest = F.regexp_replace(found, r"^\d{1,6}", "")
    return F.when((found != "") & F.char_length(rest).between(3, 60), found)


def town(part: Column) -> Column:
    """A part of letters, spaces, dots, hyphens and apostrophes, of 3 to 31 characters; null else."""
    t = F.trim(part)
    return F.when(F.char_length(t).between(3, 31) & F.regexp_replace(F.lower(t), "[a-z .'-]", "").eqNullSafe(F.lit("")) & F.substring(t, 1, 1).rlike("[A-Za-z]"), t)


def province(part: Column) -> Column:
    """The code of the province that a part begins with; null if it begins with another word."""
    codes = F.create_map(*[F.lit(x) for kv in PROVINCES.items() for x in kv])
    return F.try_element_at(codes, F.upper(F.regexp_extract(F.trim(part), "^[A-Za-z]+", 0)))


def postal_code(after: Column) -> Column:
    """The postal code that the text behind a province begins with, in capitals; null without one."""
    begin = F.regexp_replace(F.upper(after), r"^[.,\s]+", "")
    return F.nullif(F.regexp_replace(F.regexp_extract(begin, r"^[A-Z]\d[A-Z]\s?\d[A-Z]\d", 0), r"\s", " "), F.lit(""))


def address(line: Column) -> Column:
    """struct<address_line, city, province, postal_code> of the first address in a line; null without one."""

    def at(ps: Column) -> Column:
        def one(i: Column) -> Column:
            code = province(F.get(ps, i + 2))
            behind = F.regexp_replace(F.trim(F.array_join(F.slice(ps, i + 3, F.lit(2)), ",")), "^[A-Za-z]+", "")
            return F.struct(street(F.get(ps, i)).alias("address_line"), town(F.get(ps, i + 1)).alias("city"), code.alias("province"), postal_code(behind).alias("postal_code"))

        tried = F.transform(F.sequence(F.lit(0), F.greatest(F.size(ps) - 3, F.lit(0))), one)
        return F.get(F.filter(tried, lambda a: a["address_line"].isNotNull() & a["city"].isNotNull() & a["province"].isNotNull()), F.lit(0))

    return let(F.split(line, ","), at)
