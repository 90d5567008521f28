"""Interval joins by a plane sweep over stretches that hold equally many intervals.

The time line of every key is cut at every so many of all interval starts in order: some cuts for a key that
holds much of the table, none for most others. An interval is copied to the stretches it reaches into, at most one per cut of
its own key however far away its end is. Within a stretch both sides are sorted by start, and the partners of an interval
that start while it lasts are one contiguous run, found by binary search. So the work is the rows, their sorting, and the
pairs found; nothing depends on a bucket width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlens.operators.ordered import BATCH, Groups, asof, chunks_for, every_so_many, union_all, whole_groups


def stretches(spans: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, cuts: where ``n`` range partitions of (keys, ``_s``), and chunks of rows in them, begin; one cut per chunk."""
    begins = spans.select(*keys, "_s").repartitionByRange(n, *keys, "_s").sortWithinPartitions(*keys, "_s")
    first = begins.withColumn("_leads", every_so_many()[1]).filter("_leads")
    return first.groupBy(*keys).agg(F.array_sort(F.collect_set("_s")).alias("_cuts"))


def _cuts_up_to(value: Column) -> Column:
    """How many of ``_cuts`` are at most ``value``, by binary search."""
    start = F.struct(F.lit(0).alias("lo"), F.size("_cuts").alias("hi"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        open_ = state["lo"] < state["hi"]
        up = open_ & (F.element_at("_cuts", F.least(middle + 1, F.size("_cuts"))) <= value)
        return F.struct(
            F.when(up, middle + 1).otherwise(state["lo"]).alias("lo"),
            F.when(open_ & ~up, middle).otherwise(state["hi"]).alias("hi"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size("_cuts") + 1)).cast("int"))
    found = F.aggregate(steps, start, halve, lambda state: state["lo"])
    return F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(found)


def _expanded(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every j in low[i] .. high[i] - 1, in slices of bounded size."""
    ends = np.cumsum(np.maximum(high - low, 0))
    total = int(ends[-1]) if len(ends) else 0
    for a in range(0, total, BATCH):
        pair = np.arange(a, min(a + BATCH, total))
        i = np.searchsorted(ends, pair, "right")
        yield i, high[i] - (ends[i] - pair)


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    condition: Column,
) -> DataFrame:
    """Pairs of equal keys whose spans share a moment and satisfy ``condition``.

    A span that ends before it starts is the moment of its start; one with a null bound has no pairs. Column names of
    both sides must differ apart from ``keys``.
    """
    sides = []
    for number, (df, span, name) in enumerate(((left, left_span, "_l"), (right, right_span, "_r"))):
        s, e = (F.col(c).cast("double") for c in span)
        kept = [c for c in df.columns if c not in keys]
        bounded = df.filter(s.isNotNull() & e.isNotNull() & ~F.isnan(s) & ~F.isnan(e))
        sides.append(
            bounded.select(
                *keys, F.lit(number).alias("_side"), s.alias("_s"), F.greatest(s, e).alias("_e"), F.struct(*kept).alias(name)
            )
        )
    spans = union_all(sides)
    n = chunks_for(spans)
    if n == 1:
        placed = spans.withColumns({"_home": F.lit(0), "_stretch": F.lit(0)})
    else:
        # At most one cut per chunk, so the cuts may be sent to every task.
        placed = (
            spans.join(F.broadcast(stretches(spans, keys, n)), keys, "left")
            .withColumn("_home", _cuts_up_to(F.col("_s")))
            .withColumn("_stretch", F.explode(F.sequence("_home", _cuts_up_to(F.col("_e")))))
            .drop("_cuts")
        )
    along = [*keys, "_stretch"]
    swept = placed.repartition(*along).sortWithinPartitions(*along, "_s")
    fields = [placed.schema[c] for c in (*keys, "_l", "_r")]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, along):
            group = Groups.by(rows, along).of
            side, here = rows["_side"].to_numpy(), rows["_home"].to_numpy() == rows["_stretch"].to_numpy()
            n = rows.num_rows
            # One number per (group, time), so that one binary search serves all groups at once.
            times, rank = np.unique(np.append(rows["_s"].to_numpy(), rows["_e"].to_numpy()), return_inverse=True)
            start, end = group * len(times) + rank[:n], group * len(times) + rank[n:]
            l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            # A pair belongs to the stretch in which the later one starts, whoever that is.
            for near, far, tie in ((l, r, "left"), (r, l, "right")):
                mine = far[here[far]]
                low = np.searchsorted(start[mine], start[near], tie)
                high = np.searchsorted(start[mine], end[near], "right")
                for i, j in _expanded(low, high):
                    pair = (near[i], mine[j]) if near is l else (mine[j], near[i])
                    a, b = rows.take(pa.array(pair[0])), rows["_r"].take(pa.array(pair[1]))
                    done = pa.Table.from_arrays([*[a[k] for k in keys], a["_l"], b], names=[f.name for f in fields])
                    yield from done.combine_chunks().to_batches()

    pairs = swept.mapInArrow(sweep, T.StructType(fields))
    return pairs.select(*keys, "_l.*", "_r.*").filter(condition)


def interval_at(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    at: str,
    point_id: list[str],
    closed_end: bool,
    take: list[str],
) -> DataFrame:
    """For each point the first interval (lowest ``ord``) that contains it, otherwise the one with
    the nearest edge (ties to the lowest ``ord``); without any interval the taken columns are null.

    ``intervals`` has columns keys, ord, start, end and the taken ones.
    """
    named = intervals.select(
        *keys,
        F.col("ord").cast("long").alias("_ord"),
        F.col("start").alias("_a"),
        F.col("end").alias("_b"),
        *[F.col(c).alias(f"_x_{c}") for c in take],
    )
    slim = points.select(*keys, *point_id, F.col(at).alias("_p"), F.col(at).alias("_q"))
    upper = F.col("_p") <= F.col("_b") if closed_end else F.col("_p") < F.col("_b")
    values = ["_ord", "_a", "_b", *[f"_x_{c}" for c in take]]
    taken = {"_hit": F.struct(*values)}
    inside = overlap_pairs(slim, named, keys, ("_p", "_q"), ("_a", "_b"), (F.col("_a") <= F.col("_p")) & upper)
    # An interval that starts before the point and ends before it is nearest by its end; one that
    # starts after it by its start. Two candidates therefore suffice.
    alone = slim.drop("_q")
    ends = asof(alone, named, keys, F.col("_p"), F.col("_b"), taken, tie=-F.col("_ord"))
    starts = asof(alone, named, keys, F.col("_p"), F.col("_a"), taken, tie=F.col("_ord"), forward=True)
    distance = F.least(F.abs(F.col("_hit._a") - F.col("_p")), F.abs(F.col("_hit._b") - F.col("_p")))
    found = union_all(
        [
            inside.withColumn("_hit", F.struct(*values)).withColumn("_far", F.lit(-1.0)),
            *[near.filter(F.col("_hit").isNotNull()).withColumn("_far", distance) for near in (ends, starts)],
        ]
    )
    hits = (
        found.groupBy(*keys, *point_id)
        .agg(F.min_by("_hit", F.struct(F.col("_far"), F.col("_hit._ord"))).alias("_hit"))
    )
    return points.join(hits, [*keys, *point_id], "left").select(
        *points.columns, *[F.col(f"_hit._x_{c}").alias(c) for c in take]
    )
