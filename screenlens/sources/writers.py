"""Engine tables and documents to files."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlens.session import materialize
from screenlens.sources import small

BUCKETS = 64


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("video_bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int"))


def write_table(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """One relation as parquet in a fixed number of video buckets (a folder per video would not
    scale). The rebalance hint evens out file sizes, so a bucket with a huge video becomes several
    files."""
    _bucketed(df, buckets).hint("rebalance", "video_bucket").write.mode("overwrite").partitionBy(
        "video_bucket"
    ).parquet(path)


def write_tables(tables: dict[str, DataFrame], root: str, buckets: int = BUCKETS) -> None:
    """Every relation below ``root``. Measured series and decisions are separate tables, so a new
    threshold never needs a new measurement."""
    for name, df in tables.items():
        write_table(df, f"{root}/{name}", buckets)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("video_bucket")


def replace_videos(spark: SparkSession, path: str, fresh: DataFrame, buckets: int = BUCKETS) -> None:
    """Replace the rows of the videos in ``fresh``; only their buckets are rewritten."""
    upsert(spark, path, fresh, ["video_id"], buckets)


def upsert(spark: SparkSession, path: str, fresh: DataFrame, keys: list[str], buckets: int = BUCKETS) -> None:
    """Replace the rows of a table, written by ``write_table`` or not there yet, whose ``keys`` (video_id among them) stand
    in ``fresh``, and add the others of ``fresh``.

    Only the buckets of the videos in ``fresh`` are read and rewritten, so the cost does not depend on what earlier calls
    wrote. The same call again changes nothing.
    """
    arrived = materialize(_bucketed(fresh, buckets), "upsert")
    if not stored(spark, path):
        merged = arrived
    else:
        # A table that grew new columns, or lacks some, keeps both sides' columns.
        touched = arrived.select("video_bucket").distinct()
        kept = (
            spark.read.parquet(path)
            .join(F.broadcast(touched), "video_bucket", "left_semi")  # at most ``buckets`` rows
            .join(arrived.select(*keys).distinct(), keys, "left_anti")
        )
        merged = materialize(kept.unionByName(arrived, allowMissingColumns=True), "replace")
    merged.hint("rebalance", "video_bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("video_bucket").parquet(path)


def rows_of(spark: SparkSession, path: str, videos: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of some videos (video_id), read from their buckets only."""
    wanted = _bucketed(videos.select("video_id").distinct(), buckets)
    touched = wanted.select("video_bucket").distinct()
    pruned = spark.read.parquet(path).join(F.broadcast(touched), "video_bucket", "left_semi")
    return pruned.join(wanted.select("video_id"), "video_id", "left_semi").drop("video_bucket")


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a table has any bucket at ``path``."""
    buckets = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "video_bucket=*")
    found = buckets.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(buckets)
    return found is not None and len(found) > 0


def write_documents(documents: DataFrame, path: str, keys: list[str]) -> None:
    """Documents (keys, text) as one text file in a folder per document. The text goes out as it
    is, plus the final newline of the text sink. Where the file system is mounted, tasks write the files themselves."""
    spark = documents.sparkSession
    root = small.mounted(spark, path)
    if root is None:
        documents.select(*keys, "text").write.mode("overwrite").partitionBy(*keys).text(path)
        return
    small.cleared(spark, path)
    small.write_keyed(documents, root, keys)


def read_documents(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys, text) as written; keys keep leading zeros and any character."""
    root = small.mounted(spark, path)
    if root is not None:
        found = small.read_whole(spark, root, ".txt").withColumn("origin", F.substr("origin", F.lit(len(f"file:{root}") + 1)))
        named = {k: F.regexp_extract("origin", f"/{k}=([^/]+)/", 1) for k in keys}
        read = [F.when(v != small.MISSING, F.url_decode(F.replace(v, F.lit("+"), F.lit("%2B")))).alias(k) for k, v in named.items()]
        return found.select(*read, F.regexp_replace("value", r"\n\z", "").alias("text"))
    schema = "value string, " + ", ".join(f"{k} string" for k in keys)
    raw = spark.read.schema(schema).text(path, wholetext=True)
    return raw.select(*keys, F.regexp_replace("value", r"\n\z", "").alias("text"))


def write_frame_images(frames: DataFrame, path: str) -> None:
    """Gray frames (video_id, run, image, h, w, gray) as uncompressed pictures that image readers take, below folders that
    carry their video and run, under their ``image`` names. A frame without pixels, or of another size than h x w, is left
    out; frames of one run have different names.

    On a file system that is mounted where Spark runs (scheme ``file``) tasks write the files themselves, each under a
    hidden name first, so that a repeated task does no harm. Elsewhere the text sink writes them, which takes a string's
    bytes as they are: every picture has a folder of its own then, and the line end that the sink adds lies behind it.
    """
    pictures = frames.filter("h > 0 AND w > 0 AND size(gray) = h * w").select(
        "video_id", "run", F.substring_index("image", "/", -1).alias("image"), bitmap("gray", "h", "w").alias("value")
    )
    spark = frames.sparkSession
    root = small.mounted(spark, path)
    if root is None:
        sunk = pictures.withColumn("value", F.col("value").cast("string"))
        sunk.write.mode("overwrite").partitionBy("video_id", "run", "image").text(path)
        return
    small.cleared(spark, path)

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for video, run, image, value in batch.itertuples(index=False, name=None):
                small.put(f"{root}/video_id={_escaped(video)}/run={_escaped(run)}", _escaped(image), value)
            yield pd.DataFrame({"n": [len(batch)]})

    pictures.mapInPandas(store, "n long").agg(F.sum("n")).collect()


def _escaped(name: str | None) -> str:
    """A value as a part of a path, as Spark names a folder of values that are missing."""
    return quote(name, safe=" ") if name else "__HIVE_DEFAULT_PARTITION__"


@F.pandas_udf(T.BinaryType())
def bitmap(gray: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """Gray values, rounded and kept to 0..255, as a BMP file of 24 bits a pixel."""
    out = []
    for pixels, rows, columns in zip(gray, h, w, strict=True):
        levels = np.rint(np.nan_to_num(np.asarray(pixels, np.float64))).clip(0, 255).astype(np.uint8)
        # Lines run upwards and are filled up to four bytes.
        lines = np.zeros((rows, (3 * columns + 3) // 4 * 4), np.uint8)
        lines[:, : 3 * columns] = np.repeat(levels.reshape(rows, columns)[::-1], 3, axis=1)
        size = lines.size
        head = struct.pack("<2sIHHI", b"BM", 54 + size, 0, 0, 54)
        out.append(head + struct.pack("<IiiHHIIiiII", 40, columns, rows, 1, 24, 0, size, 0, 0, 0, 0) + lines.tobytes())
    return pd.Series(out)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row, such as the ``export_compare`` documents."""
    df.select(F.col("json").alias("value")).write.mode("overwrite").text(path)
