"""Strict reading of small JSON documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_object(text: Column) -> Column:
    """The document as a variant if it is exactly one JSON object, otherwise null.

    The parser stops after the first complete value, so text after it would go unnoticed. Placed
    inside an object and inside a list, the document has to be followed by the right bracket.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    parsed = F.try_parse_json(text)
    sound = (
        (F.size(F.try_variant_get(in_object, "$", "map<string, variant>")) == 1)
        & (F.size(F.try_variant_get(in_list, "$", "array<variant>")) == 1)
        & F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    )
    return F.when(sound, parsed)
