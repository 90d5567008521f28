"""From subtitle candidates to one transcript source per video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlens.functions.rounding import exact_round
from screenlens import params as P
from screenlens.functions.lang import (
    forced_name,
    lang_matches,
    lang_normalize,
    language_mismatch,
    language_tag,
)
from screenlens.operators.ordered import joined_text, number_rows, union_all

VIDEO = ["video_id"]
FILE = ["video_id", "path"]
RULE = "by language, then files beside the video, unforced, default, format, track number and name"


def subtitle_format(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r".\.([^.]+)$", 1))
    pairs = [F.lit(x) for item in P.SUBTITLE_FORMATS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), suffix)


def sidecar_match(videos: DataFrame, files: DataFrame) -> DataFrame:
    """Subtitle files that belong to a video of the same directory by their name.

    A file belongs if its name starts with the video's full name or stem plus a dot. Each file
    offers its few dotted prefixes and each video its two, so this is a plain equi-join however many
    files a directory holds. The longest matching prefix counts.

    ``videos`` (video_id, dir, name), ``files`` (dir, name).
    """
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]+$", "")
    wanted = videos.select(
        "video_id",
        "dir",
        F.explode(
            F.array_distinct(F.array(F.concat("name", F.lit(".")), F.concat(stem, F.lit("."))))
        ).alias("prefix"),
    )
    pieces = F.split("name", r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))),
        lambda i: F.concat(F.array_join(F.slice(pieces, 1, i), "."), F.lit(".")),
    )
    offered = (
        files.select("dir", "name")
        .withColumn("format", subtitle_format(F.col("name")))
        .filter("format IS NOT NULL")
        .withColumn("prefix", F.explode(prefixes))
    )
    return (
        offered.join(wanted, ["dir", "prefix"])
        .groupBy("video_id", "dir", "name", "format")
        .agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    )


def sidecar_candidates(matched: DataFrame) -> DataFrame:
    return matched.select(
        "video_id",
        F.lit("sidecar").alias("kind"),
        F.concat_ws("/", "dir", "name").alias("path"),
        "name",
        "format",
        language_tag(F.col("name"), F.col("prefix")).alias("language"),
        F.concat(F.lit("sidecar '"), "name", F.lit("'")).alias("label"),
        forced_name(F.col("name")).alias("forced"),
        F.lit(False).alias("is_default"),
        F.lit(None).cast("int").alias("track"),
    )


def embedded_track_filter(tracks: DataFrame) -> DataFrame:
    """Container tracks with their flags spelled out and, where unusable, the reason."""
    def bit(mask: int) -> Column:
        return F.col("disposition").bitwiseAND(mask) != 0

    language = F.nullif(F.col("language"), F.lit(""))
    flagged = tracks.withColumns(
        {
            "language": F.when(~language.isin("und", "unknown"), language),
            "is_default": bit(P.DISPOSITION_DEFAULT),
            "forced": bit(P.DISPOSITION_FORCED),
            "hearing_impaired": bit(P.DISPOSITION_HEARING_IMPAIRED),
        }
    )
    return flagged.withColumn(
        "skipped",
        F.when(F.col("is_text").isNull(), F.lit("unknown-codec"))
        .when(~F.col("is_text"), F.lit("bitmap"))
        .when(F.col("forced"), F.lit("forced"))
        .when(F.col("n_cues") <= 0, F.lit("no-cues")),
    )


def embedded_candidates(described: DataFrame) -> DataFrame:
    name = F.format_string("track%d.srt", F.col("track"))
    return described.filter("skipped IS NULL").select(
        "video_id",
        F.lit("embedded").alias("kind"),
        F.concat(F.lit("subs/"), name).alias("path"),
        name.alias("name"),
        F.lit("srt").alias("format"),
        lang_normalize(F.col("language")).alias("language"),
        F.format_string("embedded track %d(%s)", F.col("track"), F.col("codec")).alias("label"),
        "forced",
        "is_default",
        F.col("track").cast("int").alias("track"),
    )


def candidate_pools(sidecars: DataFrame, embedded: DataFrame) -> DataFrame:
    return sidecars.unionByName(embedded)


def rank_subtitles(candidates: DataFrame, target: str | None) -> DataFrame:
    """All candidates of a video in one order, ``rank`` from 1; a wrong language only demotes."""
    grade = F.when(lang_matches(F.col("language"), F.lit(target)), F.lit(0)).when(
        F.col("language").isNull(), F.lit(1)
    ).otherwise(F.lit(2))

    def place(values: list[str], column: str) -> Column:
        return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)).cast("int")

    keys = {
        "_k1": grade,
        "_k2": place(P.SOURCE_ORDER, "kind"),
        "_k3": F.col("forced").cast("int"),
        "_k4": (~F.col("is_default")).cast("int"),
        "_k5": place(P.FORMAT_ORDER, "format"),
        "_k6": F.coalesce("track", F.lit(-1)),
    }
    ordered = [*keys, "name", "path"]
    return number_rows(candidates.withColumns(keys), VIDEO, ordered, "rank", first=1).drop(*keys)


def choose_subtitle(ranked: DataFrame, quality: DataFrame, videos: DataFrame) -> DataFrame:
    """Per video the best-ranked candidate whose cues pass, and how many better ones failed. Videos
    without one fall to speech recognition (``whisper``) or, without audio, to ``none``.
    ``quality`` is keyed by video and path: embedded tracks of all videos have the same paths."""
    judged = ranked.join(quality.select(*FILE, "ok", "reason"), FILE, "left")
    taken = judged.filter("ok").groupBy("video_id").agg(
        F.min_by(F.struct("kind", "path", "format", "language", "label", "track", "rank"), "rank").alias("_c"),
    )
    tried = judged.groupBy("video_id").agg(F.count("*").alias("n_candidates"))
    kind = F.coalesce("_c.kind", F.when(F.col("has_audio"), F.lit("whisper")).otherwise(F.lit("none")))
    zero = F.lit(0).cast("long")
    return (
        videos.select("video_id", "has_audio")
        .join(taken, "video_id", "left")
        .join(tried, "video_id", "left")
        .select(
            "video_id",
            kind.alias("kind"),
            "_c.path",
            "_c.format",
            "_c.language",
            "_c.label",
            "_c.track",
            "_c.rank",
            F.coalesce("n_candidates", zero).alias("n_candidates"),
            F.coalesce(F.col("_c.rank") - 1, "n_candidates", zero).alias("n_rejected"),
        )
    )


def rejection_notes(ranked: DataFrame, quality: DataFrame, chosen: DataFrame) -> DataFrame:
    """One note per better-ranked candidate that failed."""
    limits = chosen.select("video_id", F.col("rank").alias("_taken"))
    return (
        ranked.join(quality.select(*FILE, "reason"), FILE, "left")
        .join(limits, "video_id")
        .filter(F.col("_taken").isNull() | (F.col("rank") < F.col("_taken")))
        .select("video_id", "rank", F.concat_ws(": ", "label", "reason").alias("note"))
    )


def choice_notes(ranked: DataFrame, chosen: DataFrame) -> DataFrame:
    """Why a candidate was taken when there were several, and a warning whenever its name says
    forced. (video_id, note_no, note)"""
    taken = chosen.filter("rank IS NOT NULL").select(
        "video_id", F.col("rank").alias("_taken"), F.col("label").alias("_label"), "n_candidates"
    )
    joined = ranked.select("video_id", "rank", "label", "forced").join(taken, "video_id")
    losers = joined_text(joined.filter("rank <> _taken"), VIDEO, ["rank"], F.col("label"), ", ")
    lead = F.format_string(
        "chosen from %d candidates: %s (%s / others: ",
        F.col("n_candidates"),
        F.col("_label"),
        F.lit(RULE),
    )
    several = losers.join(taken, "video_id").select(
        "video_id",
        F.lit(0).alias("note_no"),
        F.concat(lead, "text").alias("note"),
    )
    forced = joined.filter("rank = _taken AND forced").select(
        "video_id",
        F.lit(1).alias("note_no"),
        F.concat("label", F.lit(": the name says forced, it may hold only part of the dialogue")).alias("note"),
    )
    return several.unionByName(forced)


def explicit_waiver(named: DataFrame, quality: DataFrame) -> DataFrame:
    """A file the user named is used whatever its quality (the reason becomes a note) unless it has
    no cue at all. ``named`` (video_id, path)."""
    judged = named.join(quality.select(*FILE, "ok", "reason", "n_cues"), FILE, "left")
    empty = F.coalesce("n_cues", F.lit(0)) == 0
    return judged.select(
        "video_id",
        "path",
        (~empty).alias("used"),
        F.when(empty, F.lit("no dialogue in this file"))
        .when(~F.col("ok"), F.concat(F.lit("used because it was named; otherwise refused: "), "reason"))
        .alias("note"),
    )


def transcript_source(
    chosen: DataFrame, quality: DataFrame, target: str | None, requested: bool, notes: list[DataFrame] | None = None
) -> DataFrame:
    """Audit record of where a transcript came from; every field is always present and the kind is
    one of the known ones (others carry ``error``).

    ``span`` is where its cues lie. ``notes`` are texts in order: of each given table (video_id, a
    number, note) in turn, such as choice and rejection notes or those on SAMI files.
    """
    want = lang_normalize(F.lit(target))
    joined = chosen.join(
        quality.select(*FILE, "n_cues", "coverage", "span_start", "span_end"), FILE, "left"
    ).join(_collected(notes or [], chosen), "video_id", "left")
    language = lang_normalize(F.col("language"))
    return joined.select(
        "video_id",
        "kind",
        "path",
        "track",
        "format",
        language.alias("language"),
        want.alias("target_language"),
        F.when(want.isNotNull(), F.lit("requested" if requested else "locale")).alias(
            "target_language_source"
        ),
        language_mismatch(language, want).alias("language_mismatch"),
        F.coalesce("n_cues", F.lit(0)).cast("long").alias("n_cues"),
        exact_round(F.coalesce("coverage", F.lit(0.0)), 4).alias("coverage"),
        F.struct(
            exact_round(F.col("span_start"), 2).alias("start"), exact_round(F.col("span_end"), 2).alias("end")
        ).alias("span"),
        F.coalesce("notes", F.array().cast("array<string>")).alias("notes"),
        F.when(~F.col("kind").isin(P.SOURCE_KINDS), F.lit("unknown kind")).alias("error"),
    )


def _collected(notes: list[DataFrame], videos: DataFrame) -> DataFrame:
    """(video_id, notes): the texts of the given tables, one after the other, by their numbers."""
    numbered = [videos.select("video_id", F.lit(-1).alias("_of"), F.lit(0).cast("long").alias("_no"), F.lit(None).cast("string").alias("note"))]
    for i, df in enumerate(notes):
        number = next(c for c in df.columns if c not in ("video_id", "note"))
        numbered.append(df.select("video_id", F.lit(i).alias("_of"), F.col(number).cast("long").alias("_no"), "note"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("_of", "_no", "note"))))
    return union_all(numbered).groupBy("video_id").agg(F.transform(ordered, lambda n: n["note"]).alias("notes"))
