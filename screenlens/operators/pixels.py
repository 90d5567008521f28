"""Pixel measurements on small gray frames: what changed, where, and how far from the anchor.

``frames``: video_id, frame_no (dense from 0), t (nullable), h, w, gray (array of h*w values, row by
row). Frames of one video have one size. Heavy pixel loops run in numpy on Arrow batches of one
frame chunk; Spark decides the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlens import params as P
from screenlens.operators.lookups import frame_at
from screenlens.operators.ordered import Ordered, latest, union_all
from screenlens.session import materialize

VIDEO = ["video_id"]
CHUNK_FRAMES = 1024


def frame_time(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Frame times, falling back to number / fps where the container gave none (0.0 at frame 0)."""
    fps = videos.select("video_id", F.col("fps").alias("_fps"))
    return (
        frames.join(fps, "video_id", "left")
        .withColumn("t", F.coalesce("t", F.col("frame_no") / F.col("_fps"), F.when(F.col("frame_no") == 0, 0.0)))
        .drop("_fps")
    )


def _with_previous(frames: DataFrame, size: int) -> DataFrame:
    """Frames in chunks of ``size``, each chunk led by the last frame of the one before it."""
    home = F.floor(F.col("frame_no") / size)
    copies = F.array_distinct(F.array(home, F.floor((F.col("frame_no") + 1) / size)))
    return frames.withColumn("_part", F.explode(copies))


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("gray").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).astype(np.float64)


def row_change_frequency(
    frames: DataFrame,
    pixel_delta: float = P.PIXEL_DELTA,
    changed_share: float = P.ROW_CHANGED_SHARE,
    chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Share of adjacent frame pairs in which each pixel row changed (video_id, row, freq)."""

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_no")
        h, w = table.column("h")[0].as_py(), table.column("w")[0].as_py()
        values = _matrix(table)
        moved = np.abs(np.diff(values, axis=0)) > pixel_delta
        hits = (moved.reshape(-1, h, w).mean(axis=2) > changed_share).sum(axis=0)
        return pa.table(
            {
                "video_id": [table.column("video_id")[0].as_py()] * h,
                "row": pa.array(range(h), pa.int64()),
                "hits": pa.array(hits, pa.int64()),
                "pairs": pa.array([len(values) - 1] * h, pa.int64()),
            }
        )

    slim = frames.select("video_id", "frame_no", "h", "w", "gray")
    per_chunk = (
        _with_previous(slim, chunk)
        .groupBy("video_id", "_part")
        .applyInArrow(count, "video_id string, row bigint, hits bigint, pairs bigint")
    )
    return (
        per_chunk.groupBy("video_id", "row")
        .agg(F.sum("hits").alias("_hits"), F.sum("pairs").alias("_pairs"))
        .filter("_pairs > 0")
        .select("video_id", "row", (F.col("_hits") / F.col("_pairs")).alias("freq"))
    )


def overlay_body_band(row_freq: DataFrame) -> DataFrame:
    """The vertical share of the picture that holds content (video_id, lo, hi).

    Rows that change far more often than the median are hot; hot rows that reach in from the top or
    bottom edge are an overlay, unless they take up more than a fifth of the rows. The groups hold
    one value per pixel row of a frame.
    """
    stats = row_freq.groupBy("video_id").agg(
        F.median("freq").alias("_median"), F.count("*").alias("_n")
    )
    hot = F.col("freq") > F.greatest(F.col("_median") * P.HOT_ROW_MULTIPLE, F.lit(P.HOT_ROW_FLOOR))
    edges = (
        row_freq.join(stats, "video_id")
        .groupBy("video_id", "_n")
        .agg(
            F.min(F.when(~hot, F.col("row"))).alias("_first"),
            F.max(F.when(~hot, F.col("row"))).alias("_last"),
        )
    )
    n = F.col("_n")
    top = F.coalesce(F.col("_first"), n)
    bottom = F.coalesce(F.col("_last") + 1, n)
    limit = n * P.MAX_BAND_SHARE
    kept_top = F.when(top > limit, 0).otherwise(top)
    kept_bottom = F.when(n - bottom > limit, n).otherwise(bottom)
    full = (n < P.MIN_BAND_ROWS) | (kept_top >= kept_bottom)
    return edges.select(
        "video_id",
        F.when(full, 0.0).otherwise(kept_top / n).alias("lo"),
        F.when(full, 1.0).otherwise(kept_bottom / n).alias("hi"),
    )


def crop_rows(frames: DataFrame, bands: DataFrame) -> DataFrame:
    """Frames reduced to their video's body band; an empty band leaves the frame whole."""
    a, b = F.bround(F.col("h") * F.col("lo")).cast("int"), F.bround(F.col("h") * F.col("hi")).cast("int")
    joined = frames.join(bands.select("video_id", "lo", "hi"), "video_id", "left").withColumns(
        {"_a": a, "_rows": b - a}
    )
    keep = F.col("_rows") >= 1
    return joined.withColumns(
        {
            "gray": F.when(
                keep, F.slice("gray", F.col("_a") * F.col("w") + 1, F.col("_rows") * F.col("w"))
            ).otherwise(F.col("gray")),
            "h": F.when(keep, F.col("_rows")).otherwise(F.col("h")),
        }
    ).drop("lo", "hi", "_a", "_rows")


def frame_change(
    frames: DataFrame, pixel_delta: float = P.PIXEL_DELTA, chunk: int = CHUNK_FRAMES
) -> DataFrame:
    """Change against the previous frame (video_id, frame_no, t, rate, area): mean difference over
    255 and share of pixels that moved by more than ``pixel_delta``; both 0 at the first frame."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_no")
        delta = np.abs(np.diff(_matrix(table), axis=0))
        rate = np.concatenate([[0.0], delta.mean(axis=1) / 255.0])
        area = np.concatenate([[0.0], (delta > pixel_delta).mean(axis=1)])
        numbers = table.column("frame_no").to_numpy()
        home = (numbers // chunk) == table.column("_part")[0].as_py()
        kept = table.select(["video_id", "frame_no", "t"])
        kept = kept.append_column("rate", pa.array(rate)).append_column("area", pa.array(area))
        return kept.filter(pa.array(home))

    slim = frames.select("video_id", "frame_no", F.col("t").cast("double"), "gray")
    return (
        _with_previous(slim, chunk)
        .groupBy("video_id", "_part")
        .applyInArrow(compare, "video_id string, frame_no bigint, t double, rate double, area double")
    )


def anchor_diff(
    frames: DataFrame,
    change: DataFrame,
    anchor_threshold: float = P.ANCHOR_RESET_THRESHOLD,
    cut_threshold: float = P.CUT_RESET_THRESHOLD,
    settle_threshold: float = P.RATE_SETTLE_THRESHOLD,
    chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Distance to the anchor frame (video_id, frame_no, anchor, is_anchor_reset).

    The anchor starts as frame 0. A frame over the anchor or cut threshold unsettles the series and
    the next quiet frame after it becomes the new anchor; this is sequential by nature. But after a
    cut the next quiet frame becomes the anchor whatever the state was before, so those frames split
    a video into pieces that can be folded independently.

    A piece without cuts may still be a whole recording, so it is cut into chunks of ``chunk`` frames, all of which run at
    once from a guess: the piece's first anchor, settled. A chunk hands on the number of its last anchor and whether it
    is settled. Chunks that began with another state than the one before them handed on run again from that, until none
    is left; a chunk that sets an anchor of its own hands on the same whatever it began with. A task holds one anchor and
    one batch of frames.
    """
    quiet = F.col("rate") <= settle_threshold
    cut = (F.col("area") > cut_threshold) & ~quiet
    number = F.col("frame_no")
    pieces = (
        Ordered.of(change.select("video_id", "frame_no", "rate", "area"), VIDEO, ["frame_no"])
        .scan(
            _quiet=latest(F.when(quiet, number), inclusive=False),
            _cut=latest(F.when(cut, number), inclusive=False),
        )
        .with_columns(
            _sure=(number == 0)
            | (quiet & F.col("_cut").isNotNull() & F.coalesce(F.col("_cut") > F.col("_quiet"), F.lit(True)))
        )
        .scan(piece=latest(F.when(F.col("_sure"), number), inclusive=False))
        .rows()
    )
    key = ["video_id", "piece", "part"]
    placed = materialize(
        pieces.filter("piece IS NOT NULL").select(
            "video_id", "frame_no", "rate", "area", "piece", F.floor((number - F.col("piece") - 1) / chunk).alias("part")
        ),
        "anchor-parts",
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, anchor_no, unsettled, last = None, -1, False, None
        for batch in batches:
            pixels = _matrix(pa.Table.from_batches([batch]))
            numbers, order = batch.column("frame_no").to_numpy(), batch.column("at").to_numpy()
            if np.any(np.diff(order) <= 0):
                raise ValueError("frames arrived out of order")
            rates, areas = batch.column("rate").to_numpy(), batch.column("area").to_numpy()
            distance = np.zeros(len(numbers))
            reset = np.zeros(len(numbers), dtype=bool)
            begin = 0
            if anchor is None:  # the first row is the state that the chunk begins with
                anchor, anchor_no, unsettled = pixels[0], int(numbers[0]), bool(batch.column("unsettled")[0].as_py())
                begin = 1
            for i in range(begin, len(numbers)):
                distance[i] = np.abs(pixels[i] - anchor).mean() / 255.0
                if not unsettled:
                    unsettled = distance[i] > anchor_threshold or areas[i] > cut_threshold
                elif rates[i] <= settle_threshold:
                    anchor, anchor_no, unsettled, reset[i] = pixels[i], int(numbers[i]), False, True
            last = batch
            rows = batch.select(key).slice(begin)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(numbers[begin:]), pa.array(distance[begin:]), pa.array(reset[begin:]),
                 pa.array(np.zeros(len(numbers) - begin, bool))],
                names=[*key, "frame_no", "anchor", "is_anchor_reset", "handed_on"],
            )
        if last is not None:
            yield pa.RecordBatch.from_arrays(
                [*last.select(key).slice(0, 1).columns, pa.array([anchor_no]), pa.array([0.0]), pa.array([bool(unsettled)]),
                 pa.array([True])],
                names=[*key, "frame_no", "anchor", "is_anchor_reset", "handed_on"],
            )

    shown = frames.select("video_id", "frame_no", "gray")
    schema = (
        "video_id string, piece bigint, part bigint, frame_no bigint, anchor double, is_anchor_reset boolean, handed_on boolean"
    )

    def run(entries: DataFrame) -> DataFrame:
        """Chunks (key, begin_no, begin_unsettled) folded: a row per frame, and one with the state handed on."""
        begun = entries.select(
            *key, F.col("begin_no").alias("frame_no"), F.col("begin_unsettled").alias("unsettled"),
            F.lit(0.0).alias("rate"), F.lit(0.0).alias("area"), F.lit(-1).cast("long").alias("at"),
        )
        members = placed.join(entries.select(*key), key, "left_semi").select(
            *key, "frame_no", F.lit(False).alias("unsettled"), "rate", "area", F.col("frame_no").alias("at")
        )
        rows = begun.unionByName(members).join(shown, ["video_id", "frame_no"])
        arranged = rows.repartition(*key).sortWithinPartitions(*key, "at")
        return materialize(arranged.groupBy(*key).applyInArrow(fold, schema), "anchor-runs")

    guess = {"begin_no": F.col("piece"), "begin_unsettled": F.lit(False)}
    began = placed.select(*key).distinct().withColumns(guess)
    results = [run(began)]
    began = began.withColumn("run", F.lit(0))
    while True:
        # Of every chunk the run that counts, what it began with and what it handed on.
        told = union_all([r.filter("handed_on").withColumn("run", F.lit(n)) for n, r in enumerate(results)])
        state = began.join(told.select(*key, "run", "frame_no", "is_anchor_reset"), [*key, "run"])
        before = state.select(
            "video_id", "piece", (F.col("part") + 1).alias("part"),
            F.col("frame_no").alias("true_no"), F.col("is_anchor_reset").alias("true_unsettled"),
        )
        wrong = (F.col("true_no") != F.col("begin_no")) | (F.col("true_unsettled") != F.col("begin_unsettled"))
        checked = materialize(
            state.select(*key, "begin_no", "begin_unsettled", "run").join(before, key, "left").withColumn(
                "wrong", F.coalesce(wrong, F.lit(False))
            ),
            "anchor-states",
        )
        if checked.filter("wrong").isEmpty():
            break
        n = len(results)
        results.append(
            run(checked.filter("wrong").select(*key, F.col("true_no").alias("begin_no"), F.col("true_unsettled").alias("begin_unsettled")))
        )
        began = checked.select(
            *key,
            F.when(F.col("wrong"), F.col("true_no")).otherwise(F.col("begin_no")).alias("begin_no"),
            F.when(F.col("wrong"), F.col("true_unsettled")).otherwise(F.col("begin_unsettled")).alias("begin_unsettled"),
            F.when(F.col("wrong"), F.lit(n)).otherwise(F.col("run")).alias("run"),
        )
    first = change.filter("frame_no = 0").select(
        "video_id", "frame_no", F.lit(0.0).alias("anchor"), F.lit(False).alias("is_anchor_reset")
    )
    kept = [r.filter("NOT handed_on").withColumn("run", F.lit(n)) for n, r in enumerate(results)]
    done = union_all(kept) if len(kept) > 1 else kept[0]
    if len(kept) > 1:
        done = done.join(checked.select(*key, "run"), [*key, "run"], "left_semi")
    return first.unionByName(done.select("video_id", "frame_no", "anchor", "is_anchor_reset"))


def measure_signals(frames: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    """Frames to the signals table: overlay band, crop, change, anchor."""
    if bands is None:
        bands = overlay_body_band(row_change_frequency(frames))
    body = crop_rows(frames, bands)
    change = materialize(frame_change(body), "change")
    anchors = anchor_diff(body, change)
    return change.join(anchors, ["video_id", "frame_no"]).select(
        "video_id", F.col("frame_no").alias("idx"), "t", "anchor", "rate", "area", "is_anchor_reset"
    )


def content_area(gray: Column, delta: float = P.PIXEL_DELTA) -> Column:
    """Share of pixels that stand out from the frame's median."""
    n = F.size(gray)
    ordered = F.sort_array(gray)
    middle = (
        F.element_at(ordered, F.floor((n + 1) / 2).cast("int")).cast("double")
        + F.element_at(ordered, F.floor(n / 2).cast("int") + 1)
    ) / 2
    return F.size(F.filter(gray, lambda p: F.abs(p - middle) > delta)) / n


def mean_luma(gray: Column) -> Column:
    return F.aggregate(gray, F.lit(0.0).cast("double"), lambda a, p: a + p) / F.size(gray)


def dark_warning(luma: Column) -> Column:
    """Warning for an on-demand frame, or null."""
    return F.when(luma < P.DARK_LUMA, F.lit("dark or empty screen"))


def _window_means(image: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    return (
        total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]
    ) / (size * size)


def _similarity(a: np.ndarray, b: np.ndarray, size: int = 7, span: float = 255.0) -> float:
    """Mean structural similarity (Wang et al. 2004), uniform windows, sample covariance."""
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    correct = size * size / (size * size - 1)
    ma, mb = _window_means(a, size), _window_means(b, size)
    va = correct * (_window_means(a * a, size) - ma * ma)
    vb = correct * (_window_means(b * b, size) - mb * mb)
    cov = correct * (_window_means(a * b, size) - ma * mb)
    score = ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))
    return float(score.mean())


@F.pandas_udf(T.DoubleType())
def ssim(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """Structural similarity of two gray frames; null when one is missing or they differ in size."""
    out = []
    for x, y, rows, columns in zip(a, b, h, w):
        if x is None or y is None or len(x) != len(y) or min(rows, columns) < 7:
            out.append(None)
            continue
        shape = (int(rows), int(columns))
        out.append(
            _similarity(np.asarray(x, np.float64).reshape(shape), np.asarray(y, np.float64).reshape(shape))
        )
    return pd.Series(out, dtype="float64")


def _compared(pairs: DataFrame, frames: DataFrame, first: str, second: str) -> DataFrame:
    """Pairs with the similarity of the frames shown at two moments. Only frame numbers travel
    through the lookups; pixels are fetched by number."""
    looked = frame_at(pairs, frames, first).withColumnRenamed("frame_no", "_na").drop("frame_t")
    looked = frame_at(looked, frames, second).withColumnRenamed("frame_no", "_nb").drop("frame_t")
    a = frames.select(
        "video_id", F.col("frame_no").alias("_na"), F.col("gray").alias("_ga"), F.col("h").alias("_h"),
        F.col("w").alias("_w"),
    )
    b = frames.select("video_id", F.col("frame_no").alias("_nb"), F.col("gray").alias("_gb"))
    return (
        looked.join(a, ["video_id", "_na"], "left")
        .join(b, ["video_id", "_nb"], "left")
        .withColumn("similarity", ssim("_ga", "_gb", "_h", "_w"))
        .drop("_na", "_nb", "_ga", "_gb", "_h", "_w")
    )


def pair_changed(
    pairs: DataFrame, frames: DataFrame, first: str, second: str, below: float = P.PAIR_CHANGED_BELOW
) -> DataFrame:
    """Whether the picture differs between two moments; a missing frame counts as changed."""
    return _compared(pairs, frames, first, second).withColumn(
        "changed", F.coalesce(F.col("similarity") < below, F.lit(True))
    )


def stable_capture_time(
    points: DataFrame,
    frames: DataFrame,
    videos: DataFrame,
    at: str,
    offset: float = 1.5,
    retry: float = 1.0,
    below: float = P.STABLE_BELOW,
) -> DataFrame:
    """A moment shortly after ``at`` at which the picture stands still, or a later one if it does
    not half a second on."""
    end = F.col("duration") - 0.05
    timed = points.join(videos.select("video_id", "duration"), "video_id").withColumn(
        "_first_at", F.least(F.col(at) + offset, end)
    )
    timed = timed.withColumn("_second_at", F.least(F.col("_first_at") + 0.5, F.col("duration") - 0.02))
    later = F.least(F.col(at) + offset + retry, end)
    return (
        _compared(timed, frames, "_first_at", "_second_at")
        .withColumn("stable_t", F.when(F.col("similarity") < below, later).otherwise(F.col("_first_at")))
        .select(*points.columns, "stable_t", "similarity")
    )
