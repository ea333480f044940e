"""JSON texts as VARIANT, by the strict grammar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value; null for a null or empty text, a malformed one, and one with anything behind its value.

    The parser stops behind the first value. So the text is also parsed as the only element of an array and
    as a field of an object: what would end one of them early is an error in the other.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.try_variant_get(in_array, "$[1]", "variant").isNull() & in_object.isNotNull()
    return F.when(alone, F.try_variant_get(in_array, "$[0]", "variant"))
