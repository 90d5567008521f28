"""Ground-truth flags: keeping them and scoring detections against them."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlens.functions.rounding import exact_round
from screenlens import params as P
from screenlens.operators.ordered import Ordered, around, latest, replayed, running_sum

VIDEO = ["video_id"]


def _with_nearest(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Each left row with the time of the nearest right row; ties go to the earlier one."""
    both = around(left, right, VIDEO, F.col("t"), F.col("t"), {"t": F.col("t")})
    back, ahead = F.col("t") - F.col("_prev.t"), F.col("_next.t") - F.col("t")
    use_next = F.col("_prev").isNull() | (ahead < back)
    return both.withColumn(
        name, F.when(use_next, F.col("_next.t")).otherwise(F.col("_prev.t"))
    ).drop("_prev", "_next")


def flag_match(flags: DataFrame, detections: DataFrame, tolerance: float) -> DataFrame:
    """Each flag with the nearest detection if that is within tolerance (shared detections are
    fine), and the signed gap at two decimals."""
    near = _with_nearest(flags, detections, "_d")
    hit = F.abs(F.col("_d") - F.col("t")) <= tolerance
    return near.withColumns(
        {
            "detected_t": F.when(hit, F.col("_d")),
            "gap": F.when(hit, exact_round(F.col("_d") - F.col("t"), 2)),
        }
    ).drop("_d")


def unmatched_detections(detections: DataFrame, flags: DataFrame, tolerance: float) -> DataFrame:
    """Detections without any flag within tolerance."""
    near = _with_nearest(detections, flags, "_f")
    far = F.col("_f").isNull() | (F.abs(F.col("_f") - F.col("t")) > tolerance)
    return near.filter(far).drop("_f")


def flags_in_windows(flags: DataFrame, windows: DataFrame) -> DataFrame:
    """Only flags inside the analysed window count."""
    return (
        flags.join(windows.select("video_id", "lo", "hi"), "video_id")
        .filter("t BETWEEN lo AND hi")
        .drop("lo", "hi")
    )


def compare_metrics(
    videos: DataFrame, flags: DataFrame, detections: DataFrame, tolerance: float
) -> DataFrame:
    """Recall and precision per video; null where there is nothing to judge by."""
    matched = (
        flag_match(flags, detections, tolerance)
        .groupBy("video_id")
        .agg(F.count("*").alias("n_flags"), F.count("detected_t").alias("n_matched"))
    )
    found = detections.groupBy("video_id").agg(F.count("*").alias("n_detected"))
    extra = (
        unmatched_detections(detections, flags, tolerance)
        .groupBy("video_id")
        .agg(F.count("*").alias("n_extra"))
    )
    counts = ["n_flags", "n_detected", "n_matched", "n_extra"]
    joined = videos.select("video_id")
    for df in (matched, found, extra):
        joined = joined.join(df, "video_id", "left")
    filled = joined.select(
        "video_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts]
    )
    none = F.lit(0)
    return filled.withColumns(
        {
            "n_missed": F.col("n_flags") - F.col("n_matched"),
            "recall": exact_round(F.col("n_matched") / F.nullif("n_flags", none), 3),
            "precision": F.when(
                F.col("n_flags") > 0,
                exact_round(
                    (F.col("n_detected") - F.col("n_extra")) / F.nullif("n_detected", none), 3
                ),
            ),
        }
    )


def flag_dedupe(presses: DataFrame, within: float = P.FLAG_DEDUPE) -> DataFrame:
    """Presses in order; one within ``within`` seconds of a flag already kept is dropped.

    Only presses joined by gaps of at most ``within`` can affect each other, and of presses at the
    same (rounded) time only the first can stay. Each group of joined presses is streamed in press
    order; its state is the sorted times of the flags kept.
    """
    rounded = presses.withColumn("t", exact_round(F.col("t"), 2))
    rest = [c for c in presses.columns if c not in ("video_id", "t")]
    first = rounded.groupBy("video_id", "t").agg(
        F.min_by(F.struct(*rest), "press_no").alias("_r")
    ).select("video_id", "t", "_r.*")

    def start():
        kept: list[float] = []

        def take(press: int, t: float) -> list[tuple]:
            at = bisect_left(kept, t)
            if any(abs(f - t) <= within for f in kept[max(at - 1, 0) : at + 1]):
                return []
            kept.insert(at, t)
            return [(press,)]

        return take

    groups = _linked(first, within).select("video_id", "group", "press_no", "t")
    kept = replayed(
        groups, ["video_id", "group"], ["press_no"], start, "video_id string, group long, press_no long"
    )
    return first.join(kept, ["video_id", "press_no"], "left_semi").select(*presses.columns)


def _linked(points: DataFrame, gap: float) -> DataFrame:
    """Groups of points whose neighbours in time are at most ``gap`` apart."""
    return (
        Ordered.of(points, VIDEO, ["t", "press_no"])
        .scan(_before=latest(F.col("t"), inclusive=False))
        .with_columns(_opens=F.coalesce(F.col("t") - F.col("_before") > gap, F.lit(True)))
        .scan(group=running_sum(F.col("_opens").cast("long")))
        .rows()
        .drop("_before", "_opens")
    )


def flag_toggle_replay(
    presses: DataFrame, within: float = P.FLAG_TOGGLE, dedupe: float = P.FLAG_DEDUPE
) -> DataFrame:
    """Flags left after replaying presses: one near a kept flag removes the nearest, otherwise it
    adds a flag at its rounded time.

    Presses further apart than the larger of ``within`` and ``dedupe`` (plus rounding) never meet,
    so each group of nearby presses replays alone: streamed in press order, with the sorted times
    of its current flags as state.
    """
    points = presses.select("video_id", "press_no", "t", "note")
    groups = _linked(points, max(within, dedupe) + 0.01).select("video_id", "group", "press_no", "t", "note")

    def start():
        times: list[float] = []
        notes: list[str | None] = []

        def take(press: int | None = None, t: float = 0.0, note: str | None = None) -> list[tuple]:
            if press is None:
                return list(zip(times, notes, strict=True))
            at = bisect_left(times, t)
            near = [i for i in (at - 1, at) if 0 <= i < len(times)]
            nearest = min(near, key=lambda i: abs(times[i] - t), default=None)
            if nearest is not None and abs(times[nearest] - t) <= within:
                del times[nearest], notes[nearest]
                return []
            shown = round(t, 2)
            at = bisect_left(times, shown)
            if all(abs(f - shown) > dedupe for f in times[max(at - 1, 0) : at + 1]):
                times.insert(at, shown)
                notes.insert(at, note)
            return []

        return take

    schema = "video_id string, group long, t double, note string"
    return replayed(groups, ["video_id", "group"], ["press_no"], start, schema, at_end=True).drop("group")
