"""Web addresses that are safe to hand to a browser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenlens import params as P
from screenlens.functions.documents import json_object


def safe_url(value: Column) -> Column:
    """The trimmed value when it is itself an http(s) address with a host, otherwise null."""
    text = F.regexp_replace(value, r"(?U)\A\s+|\s+\z", "")
    host = F.regexp_extract(text, r"(?i)\Ahttps?://([^/?#]+)", 1)
    unclean = text.rlike(r"(?U)[\s\x00-\x1f\x7f]")
    half_bracket = F.contains(host, F.lit("[")) != F.contains(host, F.lit("]"))
    return F.when((host != "") & ~unclean & ~half_bracket, text)


def _first_from_json(document: Column) -> Column:
    parsed = json_object(document)
    return F.coalesce(
        *[safe_url(F.try_variant_get(parsed, f"$.{key}", "string")) for key in P.INFO_KEYS]
    )


def origin_url(info_full: Column, info_stem: Column, tags: Column) -> Column:
    """struct(url, url_from): the sidecar named after the whole file, then the one named after its
    stem, then the container's tags; key case does not matter in the tags."""
    sidecar = F.coalesce(_first_from_json(info_full), _first_from_json(info_stem))
    lowered = F.map_from_entries(
        F.array_distinct(
            F.transform(
                F.map_entries(tags),
                lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
            )
        )
    )
    container = F.coalesce(*[safe_url(F.try_element_at(lowered, F.lit(k))) for k in P.CONTAINER_KEYS])
    return F.struct(
        F.coalesce(sidecar, container).alias("url"),
        F.when(sidecar.isNotNull(), F.lit("info-json"))
        .when(container.isNotNull(), F.lit("container"))
        .alias("url_from"),
    )
