"""Screens, capture candidates and analysis runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlens.functions.rounding import exact_round
from screenlens import params as P
from screenlens.operators.intervals import overlap_pairs
from screenlens.operators.ordered import Ordered, latest, neighbours, number_rows, running_sum

RUN = ["video_id", "run"]
LAST = (1 << 63) - 1


def screen_periods(events: DataFrame, runs: DataFrame) -> DataFrame:
    """(video_id, run, screen, start, end): how long each screen was up inside the run's window.

    A screen lasts from the previous event's after-capture (or the window start) to the event; the
    change itself belongs to no screen. The window end closes the last one, and a window without
    any period is one screen.
    """
    inside = (
        events.select("video_id", F.col("event_no").cast("long").alias("event_no"), "t", "after_t")
        .join(runs.select(*RUN, "lo", "hi"), "video_id")
        .filter("t BETWEEN lo AND hi AND after_t IS NOT NULL")
    )
    closing = runs.select(
        *RUN, "lo", "hi", F.lit(LAST).alias("event_no"), F.col("hi").alias("t")
    )
    cut = (
        Ordered.of(
            inside.unionByName(closing, allowMissingColumns=True), RUN, ["event_no"]
        )
        .scan(_resume=latest(F.col("after_t"), inclusive=False))
        .with_columns(start=F.coalesce("_resume", "lo"))
        .with_columns(_kept=F.col("t") > F.col("start"))
        .scan(_n=running_sum(F.col("_kept").cast("long")))
        .rows()
    )
    whole = (F.col("event_no") == LAST) & (F.col("_n") == 0)
    return cut.filter(F.col("_kept") | whole).select(
        *RUN,
        F.greatest(F.col("_n") - 1, F.lit(0)).alias("screen"),
        F.when(whole, F.col("lo")).otherwise(F.col("start")).alias("start"),
        F.least("t", "hi").alias("end"),
    )


def screen_end_pairs(events: DataFrame, seeds: DataFrame, fps: Column) -> DataFrame:
    """Per event the start of the screen it ends, and whether that screen was up long enough
    (over one frame) for its end state to be worth comparing. ``seeds``: (video_id, seed_t)."""
    near = neighbours(
        events.select("video_id", "event_no", "t", "before_t", "after_t"),
        ["video_id"],
        "event_no",
        before={"_resume": F.col("after_t")},
    ).join(seeds, "video_id", "left")
    start = F.coalesce("_resume", "seed_t")
    return near.select(
        "video_id",
        "event_no",
        "t",
        "before_t",
        "after_t",
        start.alias("screen_start"),
        (F.col("before_t") - start > 1.0 / F.greatest(fps, F.lit(1.0))).alias("long_enough"),
    )


def frame_candidates(pairs: DataFrame, seeds: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Capture candidates: the initial seed, a screen-start after each event, and a screen-end
    before it when the screen changed while it was up.

    ``changed`` (video_id, event_no, changed) is the image comparison of the ``long_enough`` pairs;
    a pair that was not compared counts as changed.
    """
    if changed is None:
        judged = pairs.withColumn("changed", F.lit(True))
    else:
        judged = pairs.join(changed, ["video_id", "event_no"], "left").withColumn(
            "changed", F.coalesce("changed", F.lit(True))
        )

    def candidate(time: str, order: int, source: str) -> Column:
        return F.struct(
            F.col(time).alias("t"), F.col("t").alias("detected_at"), F.lit(source).alias("source"),
            (F.col("event_no") * 2 + order).alias("ord"),
        )

    ended = F.when(
        F.col("long_enough") & F.col("changed"), candidate("before_t", 1, "screen-end")
    )
    rows = judged.select(
        "video_id",
        F.explode(F.array_compact(F.array(ended, candidate("after_t", 2, "screen-start")))).alias("_c"),
    ).select("video_id", "_c.*")
    initial = seeds.select(
        "video_id",
        F.col("seed_t").alias("t"),
        F.col("seed_from").alias("detected_at"),
        F.lit("initial").alias("source"),
        F.lit(0).cast("long").alias("ord"),
    )
    return initial.unionByName(rows).select(
        "video_id", "ord", "t", "detected_at", F.array("source").alias("sources")
    )


def window_filter(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Candidates inside each run's window; the initial seed is always kept."""
    initial = F.col("sources") == F.array(F.lit("initial"))
    return (
        candidates.join(runs.select(*RUN, "lo", "hi"), "video_id")
        .filter(initial | F.col("t").between(F.col("lo"), F.col("hi")))
        .drop("lo", "hi")
    )


def sequence_names(candidates: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Sequence number by time and the file name that carries both."""
    named = number_rows(candidates, keys, ["t", "ord"], "seq")
    return named.withColumn(
        "image", F.format_string("frames/scene_%03d_t%07.2f.jpg", F.col("seq"), exact_round(F.col("t"), 2))
    )


def blank_gate(candidates: DataFrame, threshold: float = P.BLANK_AREA) -> DataFrame:
    """Status and reason per candidate from its content area (null: the frame could not be read).
    Nothing is dropped; rejected rows keep their reason."""
    failed = F.col("content_area").isNull()
    blank = F.col("content_area") <= threshold
    return candidates.withColumns(
        {
            "status": F.when(failed | blank, F.lit("rejected")).otherwise(F.lit("accepted")),
            "reject_reason": F.when(failed, F.lit("extract-failed")).when(
                blank, F.lit(f"blank(<={threshold})")
            ),
        }
    )


def validate_range(requests: DataFrame, text: str = "range_text") -> DataFrame:
    """Parse ``start-end`` (seconds) and check it against the video's ``duration``."""
    trimmed = F.trim(F.col(text))
    one_dash = F.length(trimmed) - F.length(F.replace(trimmed, F.lit("-"), F.lit(""))) == 1
    lo = F.trim(F.substring_index(trimmed, "-", 1)).try_cast("double")
    hi = F.trim(F.substring_index(trimmed, "-", -1)).try_cast("double")
    parsed = requests.withColumns({"_lo": lo, "_hi": hi})
    error = (
        F.when(~one_dash, F.lit("format"))
        .when(F.col("_lo").isNull() | F.col("_hi").isNull(), F.lit("not-a-number"))
        .when(F.col("_lo") >= F.col("_hi"), F.lit("empty"))
        .when((F.col("_lo") < 0) | (F.col("_hi") > F.col("duration") + 0.5), F.lit("out-of-range"))
    )
    checked = parsed.withColumn("error", error)
    fine = F.col("error").isNull()
    return checked.withColumns(
        {
            "lo": F.when(fine, F.greatest("_lo", F.lit(0.0))),
            "hi": F.when(fine, F.least("_hi", "duration")),
        }
    ).drop("_lo", "_hi")


def run_name(lo: Column, hi: Column) -> Column:
    return F.when(lo.isNull(), F.lit("full")).otherwise(
        F.translate(
            F.format_string("%07.1f-%07.1f", exact_round(lo, 1), exact_round(hi, 1)), ".", "_"
        )
    )


def distinct_ranges(ranges: DataFrame) -> DataFrame:
    """Identical clipped ranges once; overlapping ones stay apart. A video's whole-length run has
    null bounds."""
    return ranges.select("video_id", "lo", "hi").distinct().withColumn(
        "run", run_name(F.col("lo"), F.col("hi"))
    )


def merge_run_index(existing: DataFrame, made: DataFrame, live: DataFrame) -> DataFrame:
    """Run index after an analysis: new entries replace those of the same name, runs without
    output are dropped; ``position`` lists the whole-length run first, then by range."""
    tagged = existing.withColumn("_new", F.lit(0)).unionByName(made.withColumn("_new", F.lit(1)))
    fields = [c for c in existing.columns if c not in RUN]
    newest = (
        tagged.groupBy(*RUN)
        .agg(F.max_by(F.struct(*fields), "_new").alias("_e"))
        .select(*RUN, "_e.*")
    )
    kept = live_runs(newest, live).withColumns(
        {"_ranged": F.col("lo").isNotNull().cast("int"), "_lo": F.coalesce("lo", F.lit(0.0)),
         "_hi": F.coalesce("hi", F.lit(0.0))}
    )
    return number_rows(kept, ["video_id"], ["_ranged", "_lo", "_hi", "run"], "position").drop(
        "_ranged", "_lo", "_hi"
    )


def live_runs(index: DataFrame, live: DataFrame) -> DataFrame:
    return index.join(live.select(*RUN).distinct(), RUN, "left_semi")


def run_summary(screens: DataFrame, candidates: DataFrame) -> DataFrame:
    """Screens, accepted and rejected frames per run."""
    per_screen = screens.groupBy(*RUN).agg(F.count("*").alias("n_screens"))
    per_frame = candidates.groupBy(*RUN).agg(
        F.count_if(F.col("status") == "accepted").alias("n_frames"),
        F.count_if(F.col("status") == "rejected").alias("n_rejected"),
    )
    zero = F.lit(0).cast("long")
    return per_screen.join(per_frame, RUN, "left").select(
        *RUN,
        "n_screens",
        F.coalesce("n_frames", zero).alias("n_frames"),
        F.coalesce("n_rejected", zero).alias("n_rejected"),
    )


def source_counts(candidates: DataFrame) -> DataFrame:
    """Accepted frames per source; a frame with several sources counts in each."""
    return (
        candidates.filter("status = 'accepted'")
        .select(*RUN, F.explode("sources").alias("source"))
        .groupBy(*RUN, "source")
        .agg(F.count("*").alias("n_frames"))
    )


def transitions(events: DataFrame, runs: DataFrame) -> DataFrame:
    """The stretches during which the screen was changing, inside each run's window."""
    return (
        events.join(runs.select(*RUN, "lo", "hi"), "video_id")
        .filter("t BETWEEN lo AND hi")
        .select(*RUN, "event_no", F.col("t").alias("start"), F.col("after_t").alias("end"))
    )


def unanalysed_gaps(runs: DataFrame, videos: DataFrame) -> DataFrame:
    """The parts of a video before and after a run's window, when long enough to show."""
    spans = F.array(
        F.struct(F.lit(0.0).alias("start"), F.coalesce("lo", F.lit(0.0)).alias("end")),
        F.struct(F.coalesce("hi", "duration").alias("start"), F.col("duration").alias("end")),
    )
    return (
        runs.join(videos.select("video_id", "duration"), "video_id")
        .select(*RUN, "duration", F.explode(spans).alias("_g"))
        .select(*RUN, "duration", "_g.*")
        .filter("end - start > duration * 1e-4")
        .drop("duration")
    )


def rejected_in(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """Rejected candidates inside each half-open span (video_id, span_id, start, end)."""
    rejected = candidates.filter("status = 'rejected'").select("video_id", "t", "reject_reason")
    named = spans.filter("end > start").select("video_id", "span_id", "start", "end")
    inside = (F.col("start") <= F.col("t")) & (F.col("t") < F.col("end"))
    return overlap_pairs(rejected, named, ["video_id"], ("t", "t"), ("start", "end"), inside).select(
        "video_id", "span_id", "t", "reject_reason"
    )


def longest_screens(screens: DataFrame, tokens: DataFrame, budget: int) -> DataFrame:
    """Screens by time on display while the running token sum stays within ``budget``."""
    sized = screens.join(tokens, [*RUN, "screen"], "left").select(
        *RUN,
        "screen",
        "start",
        "end",
        F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
        (-(F.col("end") - F.col("start"))).alias("_rank"),
    )
    summed = Ordered.of(sized, RUN, ["_rank", "screen"]).scan(
        tokens_so_far=running_sum(F.col("tokens"))
    )
    return summed.rows().filter(F.col("tokens_so_far") <= budget).drop("_rank")
