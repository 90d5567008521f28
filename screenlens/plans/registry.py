"""All registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from screenlens.plans import (
    detection,
    dialogue,
    files,
    lineage,
    marks,
    pixels,
    sqltext,
    streams,
    subtitles,
)
from screenlens.plans.bridges import Corpus

MODULES = [detection, dialogue, marks, subtitles, lineage, pixels, files, streams, sqltext]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(run):
        return lambda spark, sf_dir: run(Corpus(spark, sf_dir))

    return {name: bound(run) for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
