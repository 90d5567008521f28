"""The driver's tables seen as engine tables. The oracle queries state the same mappings in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlens.operators.budget import reduced_size
from screenlens.operators.dialogue import assign_segments, frame_to_screen, segments_in
from screenlens.operators.ordered import number_rows
from screenlens.operators.screens import (
    blank_gate,
    frame_candidates,
    screen_end_pairs,
    screen_periods,
    sequence_names,
    window_filter,
)
from screenlens.session import materialize

HOURS_MERGE = 12.0
HOURS_SETTLE = 24.0


def event_hours() -> "F.Column":
    return F.expr(
        "(unix_micros(cast(ts as timestamp)) - unix_micros(cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp)))"
        " / 3600000000.0D"
    )


class Corpus:
    """One data set; every table is defined once per query and the costly ones are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def timed_events(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").cast("string").alias("video_id"),
            "event_id",
            event_hours().alias("t"),
            "event_type",
            "value",
        )

    @cached_property
    def signals(self) -> DataFrame:
        """A user's events as one video: hours as seconds, the value as change rate."""
        rate = F.col("value") / 5000.0
        numbered = number_rows(self.timed_events, ["video_id"], ["t", "event_id"], "idx")
        kind = F.col("event_type")
        measured = numbered.select(
            "video_id",
            "idx",
            "t",
            F.when(kind == "signup", rate).otherwise(0.0).alias("anchor"),
            rate.alias("rate"),
            F.when(kind.isin("error", "purchase"), rate).otherwise(0.0).alias("area"),
            ((kind == "click") & (F.col("value") > 40)).alias("is_anchor_reset"),
        )
        return materialize(measured, "signals")

    @cached_property
    def segments(self) -> DataFrame:
        """A conversation as one video, a turn as one (sometimes overlapping) spoken segment."""
        start = F.col("turn") * 5.0
        return self.table("conversations").select(
            F.col("conv_id").cast("string").alias("video_id"),
            F.col("turn").alias("seg_no"),
            start.alias("start"),
            (start + 1 + (F.length("text") % 70) / 10.0).alias("end"),
            F.col("text"),
        )

    @cached_property
    def videos(self) -> DataFrame:
        return (
            self.table("conversations")
            .groupBy("conv_id")
            .agg(((F.max("turn") + 1) * 5.0 + 3.0).alias("duration"))
            .select(
                F.col("conv_id").cast("string").alias("video_id"),
                "duration",
                F.lit(15.0).alias("fps"),
                (F.col("conv_id") % 3 != 0).alias("has_audio"),
                F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("title"),
            )
        )

    @cached_property
    def squeezed_events(self) -> DataFrame:
        """Every event as a moment of a conversation: users are dealt to conversations by their
        number, and their hours are squeezed into the duration."""
        n_videos = self.videos.agg(F.count("*")).scalar()
        dealt = (F.col("video_id").cast("long") % n_videos).cast("string")
        return (
            self.timed_events.withColumn("video_id", dealt)
            .join(self.videos.select("video_id", "duration"), "video_id")
            .withColumn("t", F.col("t") / 720.0 * F.col("duration"))
            .drop("duration")
        )

    @cached_property
    def changes(self) -> DataFrame:
        """Screen-change events of a conversation: all its events but clicks, which are points."""
        timed = self.squeezed_events.filter("event_type <> 'click'").select(
            "video_id",
            "event_id",
            "t",
            (F.col("t") - 0.2).alias("before_t"),
            (F.col("t") + F.col("value") % 1.0).alias("after_t"),
        )
        numbered = number_rows(timed, ["video_id"], ["t", "event_id"], "event_no")
        return materialize(numbered.drop("event_id"), "changes")

    @cached_property
    def points(self) -> DataFrame:
        """Moments asked about: the clicks."""
        clicks = self.squeezed_events.filter("event_type = 'click'")
        return clicks.select("video_id", "event_id", F.col("t").alias("at"))

    @cached_property
    def runs(self) -> DataFrame:
        """The whole video and its stretch from 5 to 20 seconds."""
        spans = F.array(
            F.struct(F.lit("full").alias("run"), F.lit(0.0).alias("lo"), F.col("duration").alias("hi")),
            F.struct(
                F.lit("0005_0-0020_0").alias("run"),
                F.lit(5.0).alias("lo"),
                F.least("duration", F.lit(20.0)).alias("hi"),
            ),
        )
        return self.videos.select("video_id", "duration", "title", F.explode(spans).alias("_r")).select(
            "video_id", "duration", "title", "_r.*"
        )

    @cached_property
    def screens(self) -> DataFrame:
        return materialize(screen_periods(self.changes, self.runs), "screens")

    @cached_property
    def scoped_segments(self) -> DataFrame:
        """Segments of each run that fall into its screens' span."""
        return segments_in(self.segments, self.runs)

    @cached_property
    def candidates(self) -> DataFrame:
        """Gated capture candidates of every run, with a made-up content area per candidate."""
        seeds = self.videos.select(
            "video_id", F.lit(0.5).alias("seed_t"), F.lit(0.0).alias("seed_from")
        )
        pairs = screen_end_pairs(self.changes, seeds, F.lit(15.0))
        changed = pairs.select("video_id", "event_no", (F.col("event_no") % 3 != 0).alias("changed"))
        found = window_filter(frame_candidates(pairs, seeds, changed), self.runs)
        measured = found.select(
            "video_id", "run", "ord", "t", "detected_at", "sources",
            F.when(F.col("ord") % 13 != 5, (F.col("ord") * 7 % 11) / 5000.0).alias("content_area"),
        )
        return materialize(sequence_names(blank_gate(measured)), "candidates")

    @cached_property
    def frames_on_screens(self) -> DataFrame:
        """Every candidate with its screen; ``frame_no`` is its sequence number."""
        placed = frame_to_screen(self.candidates, self.screens)
        return materialize(placed.withColumn("frame_no", F.col("seq")), "frames")

    @cached_property
    def assigned(self) -> DataFrame:
        return materialize(assign_segments(self.scoped_segments, self.screens), "assigned")


def images(frames: DataFrame) -> DataFrame:
    """Read-copy sizes of accepted frames: originals of three sizes, reduced."""
    k = F.col("frame_no") % 3
    w = F.when(k == 0, 1920).when(k == 1, 1280).otherwise(640)
    h = F.when(k == 0, 1080).when(k == 1, 1024).otherwise(480)
    return frames.filter("status = 'accepted'").select(
        "video_id", "run", "frame_no", "screen", reduced_size(w, h).alias("_s")
    ).select("video_id", "run", "frame_no", "screen", "_s.*")
