"""From frames to the audit of a run: every decision measured on the frames themselves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlens import params as P
from screenlens.functions.rounding import exact_round
from screenlens.operators import detect, pixels, screens
from screenlens.operators.budget import image_tokens
from screenlens.operators.dialogue import frame_to_screen, request_holder
from screenlens.operators.lookups import frame_at
from screenlens.operators.ordered import number_rows
from screenlens.session import materialize

RUN = ["video_id", "run"]
#: How long after the start, and after a moment asked about, a picture is taken if it stands still.
SEED_OFFSET, REQUEST_OFFSET = 0.5, 0.3


@dataclass(frozen=True)
class Analysed:
    """``events`` (detect_events), ``screens`` (screen_periods), ``candidates``: every capture with its screen, content
    area, mean luma, status and image name."""

    events: DataFrame
    screens: DataFrame
    candidates: DataFrame


def analyse(
    frames: DataFrame,
    runs: DataFrame,
    videos: DataFrame,
    bands: DataFrame | None = None,
    anchor_threshold: float = P.ANCHOR_THRESHOLD,
    rate_threshold: float = P.RATE_THRESHOLD,
    cut_area_threshold: float = P.CUT_AREA_THRESHOLD,
    merge_window: float = P.MERGE_WINDOW,
    settle_limit: float = P.SETTLE_LIMIT,
    blank_area: float = P.BLANK_AREA,
) -> Analysed:
    """Screens and captures of every run (video_id, run, lo, hi) from the frames of its video.

    ``frames`` as in ``pixels``, with times; ``videos`` (video_id, duration, fps). Whether a screen changed while it was up
    is measured on its first and last picture, whether a capture is blank on the picture it shows, both without the
    overlay rows. Frames are measured once and shared by all runs of a video; a video without frames has one screen per
    run and no capture that could be read.
    """
    if bands is None:
        bands = pixels.overlay_body_band(pixels.row_change_frequency(frames))
    body = materialize(pixels.crop_rows(frames, bands), "body")
    whole = bands.select("video_id", F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    signals = materialize(pixels.measure_signals(body, whole), "signals")
    found = detect.detect_events(
        signals, None, anchor_threshold, rate_threshold, cut_area_threshold, merge_window, settle_limit
    )
    events = materialize(found, "events")
    starts = pixels.stable_capture_time(videos.select("video_id", F.lit(0.0).alias("at")), body, videos, "at", SEED_OFFSET)
    seeds = starts.select("video_id", F.col("stable_t").alias("seed_t"), F.col("at").alias("seed_from"))
    timed = events.join(videos.select("video_id", "fps"), "video_id")
    pairs = materialize(_pairs(timed, seeds), "pairs")
    compared = pixels.pair_changed(
        pairs.filter("long_enough").select("video_id", "event_no", "screen_start", "before_t"), body, "screen_start", "before_t"
    )
    taken = screens.frame_candidates(pairs, seeds, compared.select("video_id", "event_no", "changed"))
    in_runs = screens.window_filter(taken, runs)
    seen = frame_at(in_runs, body, "t").withColumnRenamed("frame_no", "shown_no").drop("frame_t")
    pictures = body.select(
        "video_id", F.col("frame_no").alias("shown_no"), pixels.content_area(F.col("gray")).alias("content_area"),
        pixels.mean_luma(F.col("gray")).alias("yavg"),
    )
    gated = screens.blank_gate(seen.join(pictures, ["video_id", "shown_no"], "left"), blank_area)
    shown = materialize(screens.screen_periods(events, runs), "screens")
    placed = frame_to_screen(screens.sequence_names(gated), shown)
    return Analysed(events, shown, materialize(placed.withColumn("frame_no", F.col("seq")), "captures"))


def _pairs(timed: DataFrame, seeds: DataFrame) -> DataFrame:
    """``screen_end_pairs`` with each video's own frame rate."""
    fps = timed.groupBy("video_id").agg(F.first("fps").alias("_fps"))
    pairs = screens.screen_end_pairs(timed, seeds, F.lit(None).cast("double")).drop("long_enough")
    lasted = F.col("before_t") - F.col("screen_start") > 1.0 / F.greatest(F.coalesce("_fps", F.lit(1.0)), F.lit(1.0))
    return pairs.join(fps, "video_id").withColumn("long_enough", lasted).drop("_fps")


def answer_requests(
    asked: DataFrame,
    ledger: DataFrame,
    frames: DataFrame,
    videos: DataFrame,
    runs: DataFrame,
    found: Analysed,
    segments: DataFrame,
) -> DataFrame:
    """A batch of pictures asked for by hand: one row per (video_id, run, at, reason) of ``asked`` or of ``ledger``.

    ``status`` is ``known`` for what the ledger has, which stays as it is, ``refused`` with an ``error`` (unknown-run,
    out-of-range of the video, out-of-window of the run, extract-failed), otherwise ``new``: ``time`` at which the picture
    stands still, ``image``, ``yavg``, ``image_tokens`` of the picture at its own size, ``warning`` when it is dark, the
    interval of the screen it belongs to and what was being said when it was asked for. The ledger afterwards is what is
    not refused; the same batch again changes nothing. ``segments`` (video_id, seg_no, start, end, text).
    """
    key = [*RUN, "at", "reason"]
    wanted = asked.select(*key).distinct()
    new = wanted.join(ledger.select(*key), key, "left_anti")
    bounds = runs.select(*RUN, "lo", "hi")
    limited = new.join(videos.select("video_id", "duration"), "video_id", "left").join(bounds, RUN, "left")
    at = F.col("at")
    error = (
        F.when(F.col("lo").isNull() | F.col("duration").isNull(), F.lit("unknown-run"))
        .when(~at.between(F.lit(0.0), F.col("duration")), F.lit("out-of-range"))
        .when(~at.between(F.col("lo"), F.col("hi")), F.lit("out-of-window"))
    )
    checked = materialize(limited.select(*key, error.alias("error")), "requests")
    sound = checked.filter("error IS NULL").drop("error")
    stood = pixels.stable_capture_time(sound, frames, videos, "at", REQUEST_OFFSET).drop("similarity")
    seen = frame_at(stood, frames, "stable_t").drop("frame_t")
    pictures = frames.select(
        "video_id", "frame_no", pixels.mean_luma(F.col("gray")).alias("yavg"),
        image_tokens(F.col("w"), F.col("h")).alias("image_tokens"),
    )
    taken = materialize(
        seen.join(pictures, ["video_id", "frame_no"], "left").select(
            *key,
            exact_round(F.col("stable_t"), 2).alias("time"),
            F.format_string("requested/req_%07.2f.jpg", exact_round(F.col("stable_t"), 2)).alias("image"),
            exact_round(F.col("yavg"), 2).alias("yavg"),
            "image_tokens",
            pixels.dark_warning(F.col("yavg")).alias("warning"),
        ),
        "taken",
    )
    spans = found.screens.select(
        *RUN, "screen", exact_round(F.col("start"), 2).alias("interval_start"), exact_round(F.col("end"), 2).alias("interval_end")
    )
    accepted = found.candidates.filter("status = 'accepted'").select(*RUN, "screen", "frame_no").join(spans, [*RUN, "screen"])
    numbered = number_rows(taken.filter("yavg IS NOT NULL"), RUN, ["at", "reason"], "request_no")
    held = request_holder(numbered, accepted, videos, segments).drop("request_no").withColumn("status", F.lit("new"))
    failed = taken.filter("yavg IS NULL").select(*key, F.lit("extract-failed").alias("error"))
    refused = checked.filter("error IS NOT NULL").unionByName(failed).withColumn("status", F.lit("refused"))
    everything = held.unionByName(refused, allowMissingColumns=True)
    return ledger.withColumn("status", F.lit("known")).unionByName(everything, allowMissingColumns=True)
