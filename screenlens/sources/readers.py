"""Files to engine tables. Every reader has a fixed schema; broken files never fail a job."""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlens.functions.documents import json_object
from screenlens.operators.ranking import subtitle_format
from screenlens.sources import small

SUBTITLE_GLOB = "*.{[sS][rR][tT],[vV][tT][tT],[wW][eE][bB][vV][tT][tT],[sS][mM][iI],[sS][aA][mM][iI]}"
#: A frame's file, or the folder that a writer gave it.
FRAME_NAME = r"scene_(\d+)_t([\d.]+)\.[A-Za-z]+(?:/part-[^/]+)?$"
SEGMENT = "array<struct<start: double, end: double, text: string>>"
PLAIN_ENDING = re.compile(r"\*([\w.]*\.(?:json|txt))")
GLOB = re.compile(r"[*?{}\[\]\\]")
WORD = "array<struct<word: string, start: double, end: double>>"
TRANSCRIPT = f"text string, segments {SEGMENT}, words {WORD}, backend string, device string, model string"


#: Frames of a run lie in <video>/runs/<run>/frames.
RUN_FOLDER = r"([^/]+)/runs/([^/]+)/frames/[^/]+$"


def _unescaped(text: Column) -> Column:
    """Percent escapes decoded; a plus sign is a plus sign."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _folder(path: Column) -> Column:
    """Value of a ``video_id=`` folder in the path (escaped there by the writer), otherwise the
    folder that holds the runs, otherwise the parent folder's name."""
    parent = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    holder = F.regexp_extract(path, RUN_FOLDER, 1)
    keyed = F.regexp_extract(path, r"/video_id=([^/]+)/", 1)
    return F.when(keyed != "", _unescaped(keyed)).when(holder != "", holder).otherwise(parent)


def _documents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Whole small files (origin, value). Tasks list and read them where the file system is mounted and ``pattern`` is a plain
    ending of files that are not compressed."""
    ending = PLAIN_ENDING.fullmatch(pattern)
    root = small.mounted(spark, path) if ending and not GLOB.search(path) else None
    if root is not None and os.path.isdir(root):
        return small.read_whole(spark, root.rstrip("/"), ending[1])
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
    )
    return raw.select(_unescaped(F.col("_metadata.file_path")).alias("origin"), "value")


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def read_frame_images(spark: SparkSession, path: str, w: int = 64, h: int = 36) -> DataFrame:
    """Folder of extracted frames to the frames table: number and time from the file name, the
    picture as gray values averaged down to ``w`` x ``h``, null for a file that is no readable image.
    The path gives the video and the run (``runs/<run>/frames``, or the folders of ``write_frame_images``); folders are
    searched at any depth."""
    image = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    origin = _unescaped(F.col("image.origin"))
    keyed, held = F.regexp_extract(origin, r"/run=([^/]+)/", 1), F.regexp_extract(origin, RUN_FOLDER, 2)
    return image.select(
        _folder(origin).alias("video_id"),
        F.nullif(F.when(keyed != "", _unescaped(keyed)).otherwise(held), F.lit("")).alias("run"),
        F.regexp_extract(origin, FRAME_NAME, 1).try_cast("bigint").alias("frame_no"),
        F.regexp_extract(origin, FRAME_NAME, 2).try_cast("double").alias("t"),
        F.lit(h).alias("h"),
        F.lit(w).alias("w"),
        _gray(w, h)("image.data", "image.height", "image.width", "image.nChannels").alias("gray"),
    )


def _gray(w: int, h: int):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def shrink(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for raw, rows, columns, n in zip(data, height, width, channels):
            if raw is None or not rows > 0 or not columns > 0 or len(raw) != rows * columns * n:
                out.append(None)
                continue
            rows, columns, n = int(rows), int(columns), int(n)
            pixels = np.frombuffer(raw, np.uint8).reshape(rows, columns, n).astype(np.float64)
            # The image source stores blue, green, red.
            luma = pixels[..., :3] @ [0.114, 0.587, 0.299] if n >= 3 else pixels[..., 0]
            ys = (np.arange(h) * rows // h).clip(max=rows - 1)
            xs = (np.arange(w) * columns // w).clip(max=columns - 1)
            if rows >= h and columns >= w:
                sums = np.add.reduceat(np.add.reduceat(luma, ys, axis=0), xs, axis=1)
                counts = np.outer(np.diff([*ys, rows]), np.diff([*xs, columns]))
                small = sums / counts
            else:
                small = luma[np.ix_(ys, xs)]
            out.append(small.astype(np.float32).ravel())
        return pd.Series(out)

    return shrink


def read_subtitle_corpus(spark: SparkSession, path: str, pattern: str = SUBTITLE_GLOB) -> DataFrame:
    """All subtitle files below a folder with their bytes (path, dir, name, format, length, content).
    The format is null for suffixes that are not subtitles."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    name = _name(F.col("path"))
    return files.select(
        "path",
        F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"),
        name.alias("name"),
        subtitle_format(name).alias("format"),
        "length",
        "content",
    )


def read_transcripts(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Transcript documents, one JSON file per video; the folder names the video."""
    parsed = _documents(spark, path, pattern).select(
        _folder(F.col("origin")).alias("video_id"),
        F.when(json_object(F.col("value")).isNotNull(), F.from_json("value", TRANSCRIPT)).alias("_d"),
    )
    return parsed.filter("_d IS NOT NULL").select("video_id", "_d.*")


def read_segments(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(video_id, seg_no, start, end, text)"""
    documents = read_transcripts(spark, path, pattern)
    rows = documents.select("video_id", F.posexplode("segments").alias("seg_no", "_s"))
    return rows.select("video_id", F.col("seg_no").cast("long").alias("seg_no"), "_s.*")


def read_words(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    documents = read_transcripts(spark, path, pattern)
    return documents.select("video_id", F.explode("words").alias("_w")).select("video_id", "_w.*")


def read_info_json(spark: SparkSession, path: str, pattern: str = "*.info.json") -> DataFrame:
    """Sidecar documents (dir, name, document); files that are not one JSON object are left out."""
    sound = json_object(F.col("value")).isNotNull()
    return _documents(spark, path, pattern).filter(sound).select(
        F.regexp_extract("origin", r"^(.*)/[^/]+$", 1).alias("dir"),
        _name(F.col("origin")).alias("name"),
        F.col("value").alias("document"),
    )


def read_flags(spark: SparkSession, path: str, pattern: str = "*flags.json") -> DataFrame:
    """Ground-truth flags (video_id, press_no, t, note) from one JSON file per video; unreadable
    files hold no flags."""
    schema = "flags array<struct<time: double, note: string>>"
    parsed = F.when(json_object(F.col("value")).isNotNull(), F.from_json("value", schema))
    rows = _documents(spark, path, pattern).select(
        _folder(F.col("origin")).alias("video_id"),
        F.posexplode(parsed["flags"]).alias("press_no", "_f"),
    )
    return rows.select(
        "video_id",
        F.col("press_no").cast("long").alias("press_no"),
        F.col("_f.time").alias("t"),
        "_f.note",
    )


def read_file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, path, length) of every file below a folder of analyses, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inner = F.substring_index(F.col("path"), path.rstrip("/") + "/", -1)
    return files.select(
        F.substring_index(inner, "/", 1).alias("video_id"),
        F.regexp_replace(inner, r"^[^/]+/", "").alias("path"),
        "length",
    )
