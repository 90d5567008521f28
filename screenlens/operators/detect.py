"""From three change series to screen-change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlens import params as P
from screenlens.functions.rounding import exact_round
from screenlens.operators.clusters import with_leaders
from screenlens.operators.ordered import Ordered, asof, latest, neighbours, running_sum, upcoming

VIDEO = ["video_id"]


def signal_peaks(signals: DataFrame, series: str, height: float) -> DataFrame:
    """Samples above ``height`` that are not below their left and are above their right neighbour
    (so a plateau is represented by its end). The first and last sample never qualify."""
    value = F.col(series)
    near = neighbours(
        signals.select("video_id", "idx", "t", value.alias("value")),
        VIDEO,
        "idx",
        before={"_prev": F.col("value")},
        after={"_next": F.col("value")},
    )
    hit = _is_peak(F.col("_prev"), F.col("value"), F.col("_next"), F.lit(height))
    return near.filter(hit).select("video_id", "idx", "t", "value")


def _is_peak(prev: Column, value: Column, following: Column, height: Column) -> Column:
    return (value > height) & (value >= prev) & (value > following)


def tagged_peaks(
    signals: DataFrame,
    extra_hits: DataFrame | None = None,
    anchor_threshold: float = P.ANCHOR_THRESHOLD,
    rate_threshold: float = P.RATE_THRESHOLD,
    cut_area_threshold: float = P.CUT_AREA_THRESHOLD,
) -> DataFrame:
    """(video_id, idx, t, signal) for all three series plus auxiliary hits (video_id, t)."""
    setting = [("", anchor_threshold, rate_threshold, cut_area_threshold)]
    peaks = _peaks_per_setting(signals, setting).drop("setting", "rate_threshold")
    if extra_hits is not None:
        peaks = peaks.unionByName(hits_to_samples(signals, extra_hits))
    return peaks


def _peaks_per_setting(signals: DataFrame, settings: list[tuple]) -> DataFrame:
    near = neighbours(
        signals.select("video_id", "idx", "t", "anchor", "rate", "area"),
        VIDEO,
        "idx",
        before={"_p": F.struct("anchor", "rate", "area")},
        after={"_n": F.struct("anchor", "rate", "area")},
    ).filter(F.col("_p").isNotNull() & F.col("_n").isNotNull())
    rows = [
        F.struct(
            F.lit(name).alias("setting"),
            F.lit(float(anchor)).alias("anchor_threshold"),
            F.lit(float(rate)).alias("rate_threshold"),
            F.lit(float(cut)).alias("cut_area_threshold"),
        )
        for name, anchor, rate, cut in settings
    ]

    def peak(series: str, height: Column) -> Column:
        return _is_peak(F.col(f"_p.{series}"), F.col(series), F.col(f"_n.{series}"), height)

    def tag(name: str, series: str, height: Column) -> Column:
        return F.when(peak(series, height), F.lit(name))

    # peaks of the lowest thresholds are a few samples in a hundred; only they are tried with every setting
    lowest = [min(float(s[i]) for s in settings) for i in (1, 2, 3)]
    any_peak = (
        peak("anchor", F.lit(lowest[0]))
        | peak("rate", F.lit(lowest[1] * P.RATE_PEAK_MULTIPLE))
        | peak("area", F.lit(lowest[2]))
    )
    per_setting = near.filter(any_peak).withColumn("_s", F.explode(F.array(*rows))).select("*", "_s.*")

    tags = F.array_compact(
        F.array(
            tag("cut", "area", F.col("cut_area_threshold")),
            tag("anchor", "anchor", F.col("anchor_threshold")),
            tag("rate", "rate", F.col("rate_threshold") * P.RATE_PEAK_MULTIPLE),
        )
    )
    return per_setting.select(
        "video_id", "setting", "rate_threshold", "idx", "t", F.explode(tags).alias("signal")
    )


def hits_to_samples(signals: DataFrame, hits: DataFrame) -> DataFrame:
    """Auxiliary hit times moved to the first sample at or after them; later hits are dropped."""
    placed = asof(
        hits.select("video_id", F.col("t").alias("hit_t")),
        signals,
        VIDEO,
        F.col("hit_t"),
        F.col("t"),
        {"idx": F.col("idx"), "t": F.col("t")},
        tie=F.col("idx"),
        forward=True,
    )
    return placed.filter("idx IS NOT NULL").select(
        "video_id", "idx", "t", F.lit("adaptive").alias("signal")
    )


def neighbour_ratio_cut(
    signals: DataFrame, ratio: float = P.NEIGHBOUR_RATIO, floor: float = 0.012
) -> DataFrame:
    """Auxiliary detector: rate at least ``ratio`` times the mean of the two samples on each side
    and above a floor; the first sample is a forced boundary and never reported."""
    one, two = F.struct("rate"), F.struct("_b1", "_a1")
    near = (
        Ordered.of(signals.select("video_id", "idx", "t", "rate"), VIDEO, ["idx"])
        .scan(_b1=latest(one, inclusive=False), _a1=upcoming(one, inclusive=False))
        .scan(_b2=latest(two, inclusive=False), _a2=upcoming(two, inclusive=False))
        .rows()
    )
    around = F.array_compact(F.array("_b2._b1.rate", "_b1.rate", "_a1.rate", "_a2._a1.rate"))
    mean = F.aggregate(around, F.lit(0.0), lambda a, x: a + x) / F.size(around)
    return near.filter(
        (F.col("idx") > 0)
        & (F.size(around) > 0)
        & (F.col("rate") > floor)
        & (F.col("rate") >= ratio * mean)
    ).select("video_id", F.col("idx").alias("frame_no"), "t")


def frame_no_to_pts(
    hits: DataFrame, signals: DataFrame, videos: DataFrame, strict: bool = False
) -> DataFrame:
    """Frame numbers to times: the sample's time (numbers past the end use the last sample), or
    number / fps for videos without samples. A fallback time beyond the duration + 0.5 s shows a
    wrong time base: the whole video is then marked in ``error`` (``strict``: raised)."""
    last = signals.groupBy("video_id").agg(F.max("idx").alias("_last"))
    bounded = (
        hits.join(videos.select("video_id", "fps", "duration"), "video_id", "left")
        .join(last, "video_id", "left")
        .withColumn("_at", F.least("frame_no", "_last"))
    )
    timed = bounded.join(
        signals.select("video_id", F.col("idx").alias("_at"), F.col("t").alias("_t")),
        ["video_id", "_at"],
        "left",
    ).withColumn("t", F.coalesce("_t", F.col("frame_no") / F.col("fps")))
    beyond = F.col("_last").isNull() & (F.col("t") > F.col("duration") + 0.5)
    bad = timed.filter(beyond).select("video_id").distinct().withColumn("_bad", F.lit(True))
    flagged = timed.join(bad, "video_id", "left").withColumn(
        "error", F.when(F.col("_bad"), F.lit("time base does not match the video"))
    )
    if strict:
        flagged = flagged.withColumn(
            "t", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("t"))
        )
    return flagged.select("video_id", "frame_no", "t", "error")


def merge_peaks(peaks: DataFrame, merge_window: float = P.MERGE_WINDOW, keys: list[str] = VIDEO) -> DataFrame:
    """Leader clustering: a peak joins the open cluster while it is at most ``merge_window`` after
    the cluster's *first* peak.

    Peaks are cut into even chunks in order. From a leader one binary search jumps to the next one, so a chunk is a map
    from the cluster open on entry to the cluster open on exit. The maps of all chunks are worked out side by side and
    composed, and each chunk is then finished from its entry. A train without gaps is spread like any other.
    """
    samples = peaks.groupBy(*keys, "idx", "t").agg(F.array_sort(F.collect_set("signal")).alias("tags"))
    led = with_leaders(samples, keys, merge_window)
    return (
        led.groupBy(*keys, "leader")
        .agg(
            F.min_by("t", "idx").alias("t"),
            F.max(F.struct("idx", "t")).alias("_last"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("signals"),
        )
        .select(
            *keys,
            F.col("leader").alias("idx"),
            "t",
            F.col("_last.idx").alias("last_idx"),
            F.col("_last.t").alias("last_t"),
            "signals",
        )
    )


def settle_points(
    clusters: DataFrame,
    signals: DataFrame,
    rate_threshold: float | Column = P.RATE_THRESHOLD,
    settle_limit: float = P.SETTLE_LIMIT,
    keys: list[str] = VIDEO,
) -> DataFrame:
    """Capture points before and after each cluster.

    Backwards from the cluster's first sample (not past the previous cluster's last) and forwards
    from its last (not past the next cluster's first), within ``settle_limit`` seconds: the nearest
    quiet sample other than the start, otherwise the quietest one scanned, nearest first.
    """
    bounded = (
        Ordered.of(clusters, keys, ["idx"])
        .scan(
            _low=latest(F.col("last_idx"), inclusive=False),
            _high=upcoming(F.col("idx"), inclusive=False),
            event_no=running_sum(F.lit(1).cast("long"), inclusive=False),
        )
        .rows()
    )
    threshold = rate_threshold if isinstance(rate_threshold, Column) else F.lit(rate_threshold)
    width = float(settle_limit) if settle_limit > 0 else 1.0
    reach = F.sequence(
        F.floor((F.col("t") - settle_limit) / width), F.floor((F.col("last_t") + settle_limit) / width)
    )
    wanted = bounded.withColumn("_quiet", threshold).withColumn("_bucket", F.explode(reach))
    samples = signals.select(
        "video_id",
        F.floor(F.col("t") / width).alias("_bucket"),
        F.col("idx").alias("_i"),
        F.col("t").alias("_t"),
        F.col("rate").alias("_r"),
    )
    i, first, last = F.col("_i"), F.col("idx"), F.col("last_idx")
    back = (
        (i <= first)
        & ((i == first) | (i >= F.coalesce("_low", F.lit(0))))
        & (F.abs(F.col("_t") - F.col("t")) <= settle_limit)
    )
    ahead = (
        (i >= last)
        & ((i == last) | F.col("_high").isNull() | (i <= F.col("_high")))
        & (F.abs(F.col("_t") - F.col("last_t")) <= settle_limit)
    )
    quiet = F.col("_r") <= F.col("_quiet")
    here = F.struct(F.col("_i").alias("idx"), F.col("_t").alias("t"))
    scanned = (
        wanted.join(samples, ["video_id", "_bucket"])
        .filter(back | ahead)
        .groupBy(*keys, "event_no")
        .agg(
            F.max(F.when(back & (i < first) & quiet, here)).alias("_bq"),
            F.min_by(here, F.when(back, F.struct(F.col("_r"), first - i))).alias("_bb"),
            F.min(F.when(ahead & (i > last) & quiet, here)).alias("_aq"),
            F.min_by(here, F.when(ahead, F.struct(F.col("_r"), i - last))).alias("_ab"),
        )
        .select(
            *keys,
            "event_no",
            F.coalesce("_bq", "_bb").alias("_before"),
            F.coalesce("_aq", "_ab").alias("_after"),
        )
    )
    kept = [c for c in bounded.columns if c not in ("_low", "_high", "last_idx", "last_t")]
    return bounded.join(scanned, [*keys, "event_no"]).select(
        *kept,
        F.col("_before.idx").alias("before_idx"),
        F.col("_before.t").alias("before_t"),
        F.col("_after.idx").alias("after_idx"),
        F.col("_after.t").alias("after_t"),
    )


def detect_events(
    signals: DataFrame,
    extra_hits: DataFrame | None = None,
    anchor_threshold: float = P.ANCHOR_THRESHOLD,
    rate_threshold: float = P.RATE_THRESHOLD,
    cut_area_threshold: float = P.CUT_AREA_THRESHOLD,
    merge_window: float = P.MERGE_WINDOW,
    settle_limit: float = P.SETTLE_LIMIT,
) -> DataFrame:
    """(video_id, event_no, idx, t, signals, before_idx, before_t, after_idx, after_t)"""
    peaks = tagged_peaks(signals, extra_hits, anchor_threshold, rate_threshold, cut_area_threshold)
    clusters = merge_peaks(peaks, merge_window)
    return settle_points(clusters, signals, rate_threshold, settle_limit)


def threshold_sweep(
    signals: DataFrame,
    settings: list[tuple[str, float, float, float]],
    merge_window: float = P.MERGE_WINDOW,
    settle_limit: float = P.SETTLE_LIMIT,
) -> DataFrame:
    """Events again for each (name, anchor, rate, cut area) setting over one measured table."""
    keys = ["video_id", "setting"]
    peaks = _peaks_per_setting(signals, settings).drop("rate_threshold")
    clusters = merge_peaks(peaks, merge_window, keys)
    rates = F.create_map(*[F.lit(x) for name, _, rate, _ in settings for x in (name, float(rate))])
    return settle_points(clusters, signals, rates[F.col("setting")], settle_limit, keys)


def sweep_report(events: DataFrame, baseline: str, tolerance: float) -> DataFrame:
    """Per setting: events and frames (samples to capture before and after events) kept, the share of
    frames saved against the baseline, and the share of the baseline's capture times recovered
    within ``tolerance`` seconds. Matching is by time bucket, never all pairs."""
    captures = F.explode(F.array("before_idx", "after_idx")).alias("idx")
    frames = (
        events.select("setting", "video_id", captures)
        .distinct()
        .groupBy("setting")
        .agg(F.count("*").alias("n_frames"))
    )
    counts = events.groupBy("setting").agg(F.count("*").alias("n_events"))
    base = events.filter(F.col("setting") == baseline).select(
        "video_id", "event_no", F.col("after_t").alias("_want")
    )
    width = float(tolerance) if tolerance > 0 else 1.0
    spread = base.withColumn(
        "_bucket",
        F.explode(
            F.sequence(F.floor((F.col("_want") - tolerance) / width), F.floor((F.col("_want") + tolerance) / width))
        ),
    )
    have = events.select(
        "video_id", "setting", F.col("after_t").alias("_have"), F.floor(F.col("after_t") / width).alias("_bucket")
    ).distinct()
    found = (
        spread.join(have, ["video_id", "_bucket"])
        .filter(F.abs(F.col("_want") - F.col("_have")) <= tolerance)
        .select("setting", "video_id", "event_no")
        .distinct()
        .groupBy("setting")
        .agg(F.count("*").alias("n_recovered"))
    )
    one_row_per_setting = Window.partitionBy(F.lit(1))
    n_found = F.coalesce("n_recovered", F.lit(0)).cast("long")
    n_base = F.max(F.when(F.col("setting") == baseline, F.col("n_events"))).over(one_row_per_setting)
    base_frames = F.max(F.when(F.col("setting") == baseline, F.col("n_frames"))).over(one_row_per_setting)
    saved = exact_round(1 - F.col("n_frames") / F.nullif(base_frames, F.lit(0)), 4)
    return counts.join(frames, "setting").join(found, "setting", "left").select(
        "setting",
        "n_events",
        "n_frames",
        saved.alias("frames_saved"),
        n_found.alias("n_recovered"),
        exact_round(n_found / F.nullif(n_base, F.lit(0)), 4).alias("recall"),
    )


def signal_counts(events: DataFrame, keys: list[str] = VIDEO) -> DataFrame:
    """Events per contributing signal; an event counts once for each of its signals."""
    return (
        events.select(*keys, F.explode("signals").alias("signal"))
        .groupBy(*keys, "signal")
        .agg(F.count("*").alias("n_events"))
    )


def anchor_reset_points(signals: DataFrame) -> DataFrame:
    """Samples at which the anchor moved, with the series value shown there."""
    return signals.filter("is_anchor_reset").select("video_id", "idx", "t", "anchor")


def lane_normalise(
    signals: DataFrame,
    anchor_threshold: float = P.ANCHOR_THRESHOLD,
    rate_threshold: float = P.RATE_THRESHOLD,
    cut_area_threshold: float = P.CUT_AREA_THRESHOLD,
) -> DataFrame:
    """Each series scaled to 0..1 of a few thresholds, with a marker for the side it is on."""

    def lane(series: str, full: float, threshold: float) -> Column:
        return F.least(F.greatest(F.col(series) / (full * threshold), F.lit(0.0)), F.lit(1.0))

    return signals.select(
        "video_id",
        "idx",
        "t",
        lane("anchor", 4.0, anchor_threshold).alias("anchor_lane"),
        lane("rate", 6.0, rate_threshold).alias("rate_lane"),
        lane("area", 4.0, cut_area_threshold).alias("area_lane"),
        (F.col("anchor") > anchor_threshold).alias("anchor_above"),
        (F.col("rate") > rate_threshold).alias("rate_above"),
        (F.col("area") > cut_area_threshold).alias("area_above"),
    )
