"""What lies at a moment: frames, samples and marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlens import params as P
from screenlens.operators.ordered import Ordered, asof, latest, union_all, upcoming

VIDEO = ["video_id"]


def frame_at(points: DataFrame, frames: DataFrame, at: str) -> DataFrame:
    """The first frame at or after the moment (1 ms slack), past the end the last one. Frames
    without a time are skipped."""
    timed = frames.filter("t IS NOT NULL").select("video_id", "frame_no", "t")
    found = asof(
        points,
        timed,
        VIDEO,
        F.col(at) - P.FRAME_AT_SLACK,
        F.col("t"),
        {"_no": F.col("frame_no"), "_t": F.col("t")},
        tie=F.col("frame_no"),
        forward=True,
    )
    last = timed.groupBy("video_id").agg(
        F.max("frame_no").alias("_last_no"), F.max_by("t", "frame_no").alias("_last_t")
    )
    return found.join(last, "video_id", "left").select(
        *points.columns,
        F.coalesce("_no", "_last_no").alias("frame_no"),
        F.coalesce("_t", "_last_t").alias("frame_t"),
    )


def frame_index_at(points: DataFrame, frames: DataFrame, at: str) -> DataFrame:
    """The last frame whose time is at most 0.05 s after the moment."""
    return asof(
        points,
        frames,
        VIDEO,
        F.col(at) + P.FRAME_INDEX_SLACK,
        F.col("t"),
        {"frame_no": F.col("frame_no")},
        tie=F.col("frame_no"),
    )


def series_at(points: DataFrame, signals: DataFrame, at: str) -> DataFrame:
    """The three series values of the first sample at or after the moment, clamped to the last."""
    value = F.struct("idx", "anchor", "rate", "area")
    found = asof(
        points,
        signals,
        VIDEO,
        F.col(at),
        F.col("t"),
        {"_v": value},
        tie=F.col("idx"),
        forward=True,
    )
    last = signals.groupBy("video_id").agg(F.max(value).alias("_last"))
    return (
        found.join(last, "video_id", "left")
        .withColumn("_v", F.coalesce("_v", "_last"))
        .select(*points.columns, "_v.idx", "_v.anchor", "_v.rate", "_v.area")
    )


def timeline_readout(
    points: DataFrame,
    frames: DataFrame,
    segments: DataFrame,
    signals: DataFrame,
    at: str,
    anchor_threshold: float = P.ANCHOR_THRESHOLD,
    rate_threshold: float = P.RATE_THRESHOLD,
    cut_area_threshold: float = P.CUT_AREA_THRESHOLD,
) -> DataFrame:
    """Frame, running segment and series values at each moment, with threshold markers.

    One table of all moments in order, read once: each point takes the latest frame and segment and the next sample
    along. A frame is placed by its time less the slack, and what rounding may do to that is put right by its neighbours.
    """
    slack = F.lit(P.FRAME_INDEX_SLACK)

    def placed(df: DataFrame, side: int, time: Column, tie: Column, name: str, columns: list[str]) -> DataFrame:
        return df.select(
            "video_id",
            time.cast("double").alias("_time"),
            F.lit(side).alias("_side"),
            tie.cast("long").alias("_tie"),
            F.struct(*columns).alias(name),
        )

    # At one moment frames and segments come before a point, and samples after it.
    everything = union_all(
        [
            placed(frames.filter("t IS NOT NULL"), 0, F.col("t") - slack, F.col("frame_no"), "_frame", ["t", "frame_no"]),
            placed(segments, 1, F.col("start"), F.col("seg_no"), "_segment", ["end", "seg_no"]),
            placed(points, 2, F.col(at), F.lit(0), "_point", points.columns),
            placed(signals, 3, F.col("t"), F.col("idx"), "_sample", ["idx", "anchor", "rate", "area"]),
        ]
    )
    read = (
        Ordered.of(everything, VIDEO, ["_time", "_side", "_tie"])
        .scan(_earlier=latest(F.col("_frame"), inclusive=False))
        .with_columns(_frames=F.when(F.col("_frame").isNotNull(), F.struct("_frame", "_earlier")))
        .scan(
            _shown=latest(F.col("_frames")),
            _next=upcoming(F.col("_frame")),
            _said=latest(F.col("_segment")),
            _ahead=upcoming(F.col("_sample")),
            _last=latest(F.col("_sample")),
        )
        .rows()
        .filter(F.col("_point").isNotNull())
    )
    until = F.col(f"_point.{at}") + slack
    shown = (
        F.when(F.col("_next.t") <= until, F.col("_next.frame_no"))
        .when(F.col("_shown._frame.t") <= until, F.col("_shown._frame.frame_no"))
        .otherwise(F.col("_shown._earlier.frame_no"))
    )
    measured = F.coalesce("_ahead", "_last")
    return read.select(
        "_point.*",
        shown.alias("frame_no"),
        F.when(F.col("_said.end") >= F.col(f"_point.{at}"), F.col("_said.seg_no")).alias("seg_no"),
        *[measured[c].alias(c) for c in ("idx", "anchor", "rate", "area")],
    ).withColumns(
        {
            "anchor_above": F.col("anchor") > anchor_threshold,
            "rate_quiet": F.col("rate") <= rate_threshold,
            "area_above": F.col("area") > cut_area_threshold,
        }
    )


def marks(**tables: DataFrame) -> DataFrame:
    """(video_id, kind, t) from one table per kind, each with video_id and t."""
    unknown = set(tables) - set(P.MARK_KINDS)
    if unknown:
        raise ValueError(f"unknown mark kinds: {sorted(unknown)}")
    return union_all(
        [df.select("video_id", F.lit(kind).alias("kind"), "t") for kind, df in tables.items()]
    )


def mark_counts(all_marks: DataFrame) -> DataFrame:
    """Marks per video and kind, with totals per video and for the corpus (null columns)."""
    return all_marks.rollup("video_id", "kind").agg(F.count("*").alias("n_marks"))


def jump_mark(
    points: DataFrame,
    all_marks: DataFrame,
    at: str,
    forward: bool = True,
    kinds: list[str] | None = None,
) -> DataFrame:
    """The nearest mark strictly beyond the moment ± 0.05 s among the given kinds."""
    kinds = P.MARK_KINDS_JUMPED if kinds is None else kinds
    order = F.array_position(F.array(*[F.lit(k) for k in P.MARK_KINDS]), F.col("kind"))
    slack = P.MARK_SLACK if forward else -P.MARK_SLACK
    return asof(
        points,
        all_marks.filter(F.col("kind").isin(kinds)),
        VIDEO,
        F.col(at) + slack,
        F.col("t"),
        {"mark_t": F.col("t"), "mark_kind": F.col("kind")},
        tie=order if forward else -order,
        forward=forward,
        strict=True,
    )
