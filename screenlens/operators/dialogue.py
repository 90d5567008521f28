"""Which screen a sentence belongs to, and which sentence a moment belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlens.functions.rounding import exact_round
from screenlens.operators.intervals import interval_at, overlap_pairs
from screenlens.operators.ordered import around, asof, joined_text

RUN = ["video_id", "run"]
VIDEO = ["video_id"]


def segments_in(segments: DataFrame, spans: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Segments that strictly overlap their run's span (keys, lo, hi), once per run."""
    return (
        segments.join(spans.select(*keys, "lo", "hi"), [k for k in keys if k in segments.columns])
        .filter((F.col("end") > F.col("lo")) & (F.col("start") < F.col("hi")))
        .drop("lo", "hi")
    )


def screen_span(screens: DataFrame) -> DataFrame:
    return screens.groupBy(*RUN).agg(
        F.min_by("start", "screen").alias("lo"), F.max_by("end", "screen").alias("hi")
    )


def _screens_named(screens: DataFrame) -> DataFrame:
    return screens.select(*RUN, "screen", F.col("start").alias("_a"), F.col("end").alias("_b"))


def assign_segments(segments: DataFrame, screens: DataFrame) -> DataFrame:
    """Every segment on exactly one screen of its run: the one it overlaps most (ties to the
    lowest), otherwise the nearest one by min(|start - start|, |end - end|).

    ``segments`` (video_id, run, seg_no, start, end, ...), ``screens`` (video_id, run, screen,
    start, end) disjoint and ordered.
    """
    named = _screens_named(screens)
    seg = segments.select(*RUN, "seg_no", F.col("start").alias("_s"), F.col("end").alias("_e"))
    overlap = F.least("_e", "_b") - F.greatest("_s", "_a")
    best = (
        overlap_pairs(seg, named, RUN, ("_s", "_e"), ("_a", "_b"), overlap > 0)
        .groupBy(*RUN, "seg_no")
        .agg(F.max_by("screen", F.struct(overlap, -F.col("screen"))).alias("_best"))
    )
    # Starts and ends both rise with the screen number, so the nearest start is that of the screen before or after the
    # segment's start, and the nearest end likewise.
    span = {"screen": F.col("screen"), "a": F.col("_a"), "b": F.col("_b")}
    by_start = around(seg, named, RUN, F.col("_s"), F.col("_a"), span, F.col("screen"))
    by_start = by_start.withColumnsRenamed({"_prev": "_n1", "_next": "_n2"})
    near = around(by_start, named, RUN, F.col("_e"), F.col("_b"), span, F.col("screen"))

    def reach(name: str) -> Column:
        a, b, screen = (F.col(f"{name}.{c}") for c in ("a", "b", "screen"))
        distance = F.least(F.abs(a - F.col("_s")), F.abs(b - F.col("_e")))
        return F.when(screen.isNotNull(), F.struct(distance.alias("d"), screen.alias("screen")))

    nearest = F.array_min(F.array_compact(F.array(*[reach(n) for n in ("_n1", "_n2", "_prev", "_next")])))["screen"]
    chosen = near.join(best, [*RUN, "seg_no"], "left").select(*RUN, "seg_no", F.coalesce("_best", nearest).alias("screen"))
    return segments.join(chosen.filter("screen IS NOT NULL"), [*RUN, "seg_no"])


def frame_to_screen(frames: DataFrame, screens: DataFrame) -> DataFrame:
    """The last screen that started by the frame's time, or screen 0; rejected frames too."""
    numbered = asof(
        frames,
        screens,
        RUN,
        F.col("t"),
        F.col("start"),
        {"screen": F.col("screen")},
        tie=F.col("screen"),
    )
    return numbered.withColumn("screen", F.coalesce("screen", F.lit(0).cast("long")))


def attach_dialogue(frames: DataFrame, screens: DataFrame, assigned: DataFrame) -> DataFrame:
    """Frames with their screen's interval and, for accepted ones, that screen's segments as one
    row each (a frame without dialogue keeps one row). All images of a screen share its dialogue."""
    on_screen = frame_to_screen(frames, screens)
    spans = screens.select(
        *RUN,
        "screen",
        exact_round(F.col("start"), 2).alias("interval_start"),
        exact_round(F.col("end"), 2).alias("interval_end"),
    )
    said = assigned.select(
        *RUN,
        "screen",
        F.lit("accepted").alias("status"),
        "seg_no",
        F.col("start").alias("said_start"),
        F.col("end").alias("said_end"),
        "text",
    )
    return on_screen.join(spans, [*RUN, "screen"]).join(said, [*RUN, "screen", "status"], "left")


def segment_at(points: DataFrame, segments: DataFrame, at: str, point_id: list[str]) -> DataFrame:
    """The first segment that contains the moment, otherwise the nearest by its edges."""
    spans = segments.withColumn("ord", F.col("seg_no"))
    return interval_at(points, spans, VIDEO, at, point_id, True, ["seg_no", "text"])


def segment_index_at(points: DataFrame, segments: DataFrame, at: str) -> DataFrame:
    """The last segment that started by the moment, if it is still running."""
    found = asof(
        points,
        segments,
        VIDEO,
        F.col(at),
        F.col("start"),
        {"seg_no": F.col("seg_no"), "_end": F.col("end")},
        tie=F.col("seg_no"),
    )
    running = F.col("_end") >= F.col(at)
    return found.withColumn("seg_no", F.when(running, F.col("seg_no"))).drop("_end")


def request_holder(
    requests: DataFrame, frames: DataFrame, videos: DataFrame, segments: DataFrame
) -> DataFrame:
    """The screen interval an on-demand frame belongs to, and what was being said when asked.

    ``requests`` (video_id, run, request_no, at, time), ``frames`` accepted frames with
    ``interval_start``/``interval_end`` and ``frame_no``. Without frames the interval is the video.
    """
    spans = (
        frames.groupBy(*RUN, "interval_start", "interval_end")
        .agg(F.min("frame_no").alias("ord"))
        .withColumns({"start": F.col("interval_start"), "end": F.col("interval_end")})
    )
    held = interval_at(
        requests, spans, RUN, "time", ["request_no"], False, ["interval_start", "interval_end"]
    )
    whole = held.join(videos.select("video_id", "duration"), "video_id", "left").withColumns(
        {
            "interval_start": F.coalesce("interval_start", F.lit(0.0)),
            "interval_end": F.coalesce("interval_end", exact_round(F.col("duration"), 2)),
        }
    )
    said = segment_at(whole, segments, "at", ["run", "request_no"])
    return said.withColumn("said_at", F.coalesce(F.trim("text"), F.lit(""))).drop(
        "text", "seg_no", "duration"
    )


def hosts(screens: DataFrame, assigned: DataFrame) -> DataFrame:
    """Screens without dialogue of their own that a longer sentence runs across, with the screen
    that owns the sentence; of several such sentences the last one decides."""
    # A sentence that lasts and crosses one screen only belongs to that screen, so others that it crosses are enough.
    seg = assigned.filter("end > start").select(
        *RUN, "seg_no", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("screen").alias("host")
    )
    crosses = (F.col("_e") > F.col("_a")) & (F.col("_s") < F.col("_b")) & (F.col("screen") != F.col("host"))
    crossed = overlap_pairs(seg, _screens_named(screens), RUN, ("_s", "_e"), ("_a", "_b"), crosses)
    speaking = assigned.select(*RUN, "screen").distinct()
    return (
        crossed.join(speaking, [*RUN, "screen"], "left_anti")
        .groupBy(*RUN, "screen")
        .agg(F.max_by("host", "seg_no").alias("host"))
    )


def transcript_segments(cues: DataFrame) -> DataFrame:
    """Cues as transcript segments, times at three decimals."""
    return cues.select(
        *[c for c in cues.columns if c not in ("start", "end")],
        exact_round(F.col("start"), 3).alias("start"),
        exact_round(F.col("end"), 3).alias("end"),
    )


def transcript_text(cues: DataFrame, key: str = "video_id", order: str = "seg_no") -> DataFrame:
    """Cue texts joined by one space in order, as (key, text)."""
    return joined_text(cues, [key], [order], F.col("text"), " ")


def word_density(words: DataFrame, bin_seconds: float) -> DataFrame:
    return (
        words.groupBy("video_id", F.floor(F.col("start") / bin_seconds).cast("long").alias("bin"))
        .agg(F.count("*").alias("n_words"))
        .withColumn("bin_start", F.col("bin") * F.lit(bin_seconds))
    )
