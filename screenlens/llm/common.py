"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, ``[\x20\x09-\x0D]``; fixed by the contracts of the text operators.
WHITE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; every other character as it is.

    Where ``lower`` changes nothing but A-Z it is taken, as it is many times faster than a translation of characters:
    in ASCII texts, and in those without any other character that has a lower case.
    """
    ascii_only = F.octet_length(text) == F.length(text)
    others = text.rlike(r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{IsUppercase}]]")
    return F.when(ascii_only | ~others, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def only(docs: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names: ``only(docs, doc_id="id")``; others cannot clash with ours."""
    return docs.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()])
