"""What reading the kept images costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlens import params as P


def _fit(width: Column, height: Column, long_edge: int) -> tuple[Column, Column]:
    longest = F.greatest(width, height)
    scale = F.lit(float(long_edge)) / longest
    too_big = longest > long_edge
    return tuple(
        F.when(too_big, F.bround(side * scale)).otherwise(side).cast("long") for side in (width, height)
    )


def reduced_size(width: Column, height: Column, long_edge: int = P.READ_LONG_EDGE) -> Column:
    """struct(w, h) of the read copy; never enlarged."""
    w, h = _fit(width, height, long_edge)
    return F.struct(w.alias("w"), h.alias("h"))


def image_tokens(width: Column, height: Column) -> Column:
    w, h = _fit(width, height, P.TOKEN_LONG_EDGE)
    return F.floor(w * h / P.PIXELS_PER_TOKEN).cast("long")


def read_path(image: Column) -> Column:
    return F.concat(F.lit("read/"), F.substring_index(image, "/", -1))


def read_budget(images: DataFrame, keys: list[str] = ["video_id", "run"]) -> DataFrame:
    """Count and tokens of the read copies per run. ``images``: keys, w, h of the read copies."""
    return (
        images.groupBy(*keys)
        .agg(
            F.count("*").alias("n_images"),
            F.sum(image_tokens(F.col("w"), F.col("h"))).alias("tokens"),
        )
        .withColumns({"long_edge": F.lit(P.READ_LONG_EDGE), "rule": F.lit(P.TOKEN_RULE)})
    )
