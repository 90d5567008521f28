"""Subtitle files to cues, and whether the cues can serve as a transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlens import params as P
from screenlens.functions.text import clean_text, voice_prefix
from screenlens.operators.ordered import (
    Ordered,
    neighbours,
    number_rows,
    running_max,
    upcoming,
)

FILE = ["file_id"]

# How a timed cue and a SAMI document are written.
STAMP = r"(?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3}"
STAMP_PARTS = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"
NOT_CUES = ["NOTE", "STYLE", "REGION"]
SMI_COMMENT = r"(?s)<!--.*?-->"
SMI_BODY_END = r"(?is)</body>.*\z"
SMI_SYNC = r"(?i)<sync\b"
SMI_START = r"(?i)\bstart\s*=\s*\"?(-?\d+)"
SMI_PARAGRAPH = r"(?i)<p\b"
SMI_CLASS = r"(?i)\bclass\s*=\s*\"?([\w.-]+)"


def stamp_seconds(stamp: Column) -> Column:
    """Seconds of a time stamp, null for any other text; hours are optional."""
    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(stamp, STAMP_PARTS, i).try_cast("bigint"), F.lit(0))

    fraction = F.regexp_extract(stamp, STAMP_PARTS, 4)
    return (
        part(1) * 3600 + part(2) * 60 + part(3)
        + fraction.try_cast("int") / F.pow(F.lit(10), F.length(fraction))
    )


def _numbered(cues: DataFrame) -> DataFrame:
    """Cue numbers by (start, end). The cues of a file come from one input row, so a file is a
    bounded group here."""
    by_time = Window.partitionBy("file_id").orderBy("start", "end", "_pos")
    return cues.withColumn("cue_no", (F.row_number().over(by_time) - 1).cast("long")).select(
        "file_id", "cue_no", "start", "end", "text"
    )


def parse_timed_blocks(files: DataFrame, entities: str | None = "all") -> DataFrame:
    """SRT and VTT files (file_id, text) to cues.

    Blocks are separated by blank lines; the line with an arrow carries the two times and the lines
    below it are the text. Everything else in a block (numbers, identifiers, settings) falls away.
    """
    unix = F.regexp_replace("text", r"\r\n?", "\n")
    blocks = files.select("file_id", F.posexplode(F.split(unix, r"\n[ \t]*\n+")).alias("_pos", "_block"))
    lines = F.filter(F.split("_block", "\n"), lambda x: x.rlike(r"(?U)\S"))
    arrow = F.array_position(F.transform(F.col("_lines"), lambda x: F.contains(x, F.lit("-->"))), True)
    first_word = F.upper(F.regexp_extract(F.try_element_at("_lines", F.lit(1)), r"(?U)(\S+)", 1))
    body = F.array_join(F.expr("slice(_lines, cast(_arrow + 1 as int), size(_lines))"), "\n")
    cues = (
        blocks.withColumn("_lines", lines)
        .withColumn("_arrow", arrow)
        .filter(~first_word.isin(NOT_CUES) & (F.col("_arrow") > 0))
        .withColumn(
            "_stamps",
            F.regexp_extract_all(
                F.get("_lines", F.col("_arrow").cast("int") - 1), F.lit(STAMP), F.lit(0)
            ),
        )
        .filter(F.size("_stamps") >= 2)
        .select(
            "file_id",
            "_pos",
            stamp_seconds(F.get("_stamps", F.lit(0))).alias("start"),
            stamp_seconds(F.get("_stamps", F.lit(1))).alias("end"),
            voice_prefix(body, entities).alias("text"),
        )
        .filter("end > start AND text <> ''")
    )
    return _numbered(cues)


def smi_entries(files: DataFrame, entities: str | None = "all") -> DataFrame:
    """SAMI files to (file_id, pos, start, class, class_pos, text): one row per time mark and
    language class. Of a class named twice under one mark the first text that is not empty counts."""
    bare = F.regexp_replace(F.regexp_replace("text", SMI_COMMENT, " "), SMI_BODY_END, "")
    marks = (
        files.select("file_id", F.posexplode(F.split(bare, SMI_SYNC)).alias("pos", "_mark"))
        .filter("pos > 0")
        .withColumn("_head", F.regexp_extract("_mark", r"(?s)\A([^>]*)>", 1))
        .withColumn("_ms", F.regexp_extract("_head", SMI_START, 1).try_cast("bigint"))
        .filter("_ms >= 0")
        .withColumn("_body", F.regexp_replace("_mark", r"(?s)\A[^>]*>", ""))
    )
    pieces = F.split("_body", SMI_PARAGRAPH)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("class"), F.col("_body").alias("raw")))
    named = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))),
        lambda x: F.struct(
            F.nullif(
                F.upper(F.regexp_extract(F.regexp_extract(x, r"(?s)\A([^>]*)>", 1), SMI_CLASS, 1)),
                F.lit(""),
            ).alias("class"),
            F.regexp_replace(x, r"(?s)\A[^>]*>", "").alias("raw"),
        ),
    )
    texts = marks.select(
        "file_id",
        "pos",
        (F.col("_ms") / 1000.0).alias("start"),
        F.posexplode(F.when(F.size(pieces) > 1, named).otherwise(whole)).alias("class_pos", "_p"),
    ).select("file_id", "pos", "start", "class_pos", "_p.class", clean_text(F.col("_p.raw"), entities).alias("text"))
    said = F.when(F.col("text") != "", F.struct("class_pos", "text"))
    return texts.groupBy("file_id", "pos", "start", "class").agg(
        F.min("class_pos").alias("class_pos"),
        F.coalesce(F.min(said)["text"], F.lit("")).alias("text"),
    )


def smi_class_pick(entries: DataFrame) -> DataFrame:
    """Per file the language class with most texts; ties go to the one that appears first."""
    return (
        entries.groupBy("file_id", "class")
        .agg(
            F.count_if(F.col("text") != "").alias("n_texts"),
            F.min(F.struct("start", "pos", "class_pos")).alias("_first"),
        )
        .withColumn(
            "_rank",
            F.row_number().over(
                Window.partitionBy("file_id").orderBy(F.desc("n_texts"), F.asc("_first"))
            ),
        )
        .groupBy("file_id")
        .agg(
            F.max_by(F.struct("class"), -F.col("_rank"))["class"].alias("class"),
            F.max_by("n_texts", -F.col("_rank")).alias("n_texts"),
            F.count("*").alias("n_classes"),
        )
    )


def smi_end_times(starts: DataFrame, keys: list[str], cap: float = P.SMI_MAX_CUE) -> DataFrame:
    """End of each mark = start of the next one (an empty mark ends the cue before it), at most
    ``cap`` seconds later. Empty cues go only after the ends are known; ``capped`` marks cut ones.

    ``starts``: keys, pos, start, text.
    """
    ended = (
        Ordered.of(starts, keys, ["start", "pos"])
        .scan(_next=upcoming(F.col("start"), inclusive=False))
        .rows()
        .withColumn("end", F.least(F.coalesce("_next", F.col("start") + cap), F.col("start") + cap))
        .withColumn("capped", F.coalesce(F.col("_next") > F.col("end"), F.lit(False)))
    )
    return ended.filter("text <> '' AND end > start").drop("_next")


def _smi_ended(files: DataFrame, entities: str | None) -> tuple[DataFrame, DataFrame]:
    """Cues of each file's chosen class with ``capped``, and the choices."""
    entries = smi_entries(files, entities)
    picked = smi_class_pick(entries)
    marks = entries.select("file_id", "pos", "start").distinct()
    chosen = entries.join(
        picked.select("file_id", F.col("class").alias("_class")), "file_id"
    ).filter(F.col("class").eqNullSafe(F.col("_class")))
    texts = marks.join(chosen.select("file_id", "pos", "text"), ["file_id", "pos"], "left").withColumn(
        "text", F.coalesce("text", F.lit(""))
    )
    return smi_end_times(texts, FILE), picked


def parse_smi_corpus(files: DataFrame, entities: str | None = "all") -> DataFrame:
    """SAMI files to cues of the chosen language class."""
    return _numbered(_smi_ended(files, entities)[0].withColumnRenamed("pos", "_pos"))


def smi_notes(files: DataFrame, entities: str | None = "all") -> DataFrame:
    """What a reader of the cues should know (file_id, notes): that a file has several language classes and which one was
    taken, and how many cues had no end of their own and were cut. Files without either have no row."""
    ended, picked = _smi_ended(files, entities)
    cut = ended.groupBy("file_id").agg(F.count_if("capped").alias("_cut"))
    several = F.format_string("%d language classes, %s taken", "n_classes", F.coalesce("class", F.lit("that without a name")))
    long = F.format_string("%d cues without an end of their own cut to %.0f s", "_cut", F.lit(P.SMI_MAX_CUE))
    notes = F.array_compact(F.array(F.when(F.col("n_classes") > 1, several), F.when(F.col("_cut") > 0, long)))
    return picked.join(cut, "file_id", "left").select("file_id", notes.alias("notes")).filter(F.size("notes") > 0)


def cue_order(cues: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """Cues numbered by (start, end); ``ord`` breaks ties."""
    return number_rows(cues, keys, ["start", "end", "ord"], "cue_no")


def close_open_cues(cues: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """A cue without an end lasts two seconds or until the next cue starts."""
    limit = F.col("start") + P.OPEN_CUE_SECONDS
    return (
        Ordered.of(cues, keys, ["start", "ord"])
        .scan(_next=upcoming(F.col("start"), inclusive=False))
        .rows()
        .withColumn("end", F.coalesce("end", F.least(limit, F.coalesce("_next", limit))))
        .drop("_next")
    )


def coverage_union(cues: DataFrame, files: DataFrame) -> DataFrame:
    """Share of the duration covered by at least one cue (file_id, covered, coverage).

    Summed and divided in millionths of a second: a sum of doubles depends on the order of the rows, and a file that is
    covered to exactly the required share would pass or fail by it.
    """
    exact = "decimal(18,6)"
    clipped = (
        cues.join(files.select("file_id", "duration"), "file_id")
        .select(
            "file_id",
            "cue_no",
            F.greatest("start", F.lit(0.0)).alias("_a"),
            F.least("end", "duration").alias("_b"),
        )
        .filter("_b > _a")
    )
    added = (
        Ordered.of(clipped, FILE, ["_a", "cue_no"])
        .scan(_reach=running_max(F.col("_b"), inclusive=False))
        .rows()
        .withColumn(
            "_new",
            F.greatest(F.lit(0.0), F.col("_b") - F.greatest("_a", F.coalesce("_reach", F.col("_a")))),
        )
        .groupBy("file_id")
        .agg(F.sum(F.col("_new").try_cast(exact)).cast(exact).alias("_sum"))
    )
    covered = F.coalesce("_sum", F.lit(0).cast(exact))
    share = F.try_divide(covered, F.col("duration").try_cast(exact)).cast("double")
    return files.join(added, "file_id", "left").select(
        "file_id",
        covered.cast("double").alias("covered"),
        F.when(F.col("duration") > 0, F.coalesce(share, covered.cast("double") / F.col("duration"))).otherwise(0.0).alias("coverage"),
    )


def rollup_ratio(cues: DataFrame) -> DataFrame:
    """Share of adjacent cues whose text begins with the whole text before it."""
    folded = F.lower(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))
    near = neighbours(
        cues.select("file_id", "cue_no", folded.alias("_now")),
        FILE,
        "cue_no",
        before={"_was": F.col("_now")},
    )
    grows = (F.col("_was") != "") & F.startswith(F.col("_now"), F.col("_was"))
    return near.groupBy("file_id").agg(
        F.coalesce(
            F.count_if(grows) / F.nullif(F.count("_was"), F.lit(0)), F.lit(0.0)
        ).alias("rollup")
    )


def subtitle_quality(cues: DataFrame, files: DataFrame) -> DataFrame:
    """Verdict per file (file_id, duration): the first failing check is the reason. Checks against
    the duration are skipped when it is not known (0 or less)."""
    spans = cues.groupBy("file_id").agg(
        F.count("*").alias("n_cues"),
        F.min("start").alias("span_start"),
        F.max("end").alias("span_end"),
    )
    judged = (
        files.select("file_id", "duration")
        .join(spans, "file_id", "left")
        .join(coverage_union(cues, files).drop("covered"), "file_id", "left")
        .join(rollup_ratio(cues), "file_id", "left")
        .withColumns(
            {
                "n_cues": F.coalesce("n_cues", F.lit(0)).cast("long"),
                "rollup": F.coalesce("rollup", F.lit(0.0)),
            }
        )
    )
    known = F.col("duration") > 0
    outside = (F.col("span_end") > F.col("duration") * P.SPAN_OVERHANG + P.SPAN_SLACK) | (
        F.col("span_start") < -P.SPAN_SLACK
    )
    reason = (
        F.when(F.col("n_cues") < P.MIN_CUES, F.lit("too-few-cues"))
        .when(F.col("rollup") > P.MAX_ROLLUP, F.lit("auto-generated"))
        .when(known & outside, F.lit("other-video"))
        .when(known & (F.col("coverage") < P.MIN_COVERAGE), F.lit("partial"))
    )
    return judged.withColumn("reason", reason).select(
        "file_id",
        F.col("reason").isNull().alias("ok"),
        "reason",
        "n_cues",
        "coverage",
        "span_start",
        "span_end",
        "rollup",
    )
