"""Leader clustering along a sequence: a sample joins the open cluster while it is near the cluster's first one.

From a leader a binary search jumps to the next one, so the leaders of a stretch are a chain of jumps, followed by
doubling the jumps. A stretch as a whole is a map from the cluster open where it begins to the cluster open where it
ends; maps of stretches compose. Batch and stream share these functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from screenlens.operators.ordered import CHUNK, FIRST, Groups, cut, folded, key_at


def jumps(t: np.ndarray, of: np.ndarray, last: np.ndarray, window: float) -> np.ndarray:
    """Of each sample the next one more than ``window`` later, or the first of the next run.

    ``t`` rises within each run of equal ``of``; ``last`` is the last place of each sample's run.
    """
    n = len(t)
    here = np.arange(n)
    # One number per (run, time), so that one binary search serves all runs.
    times, rank = np.unique(np.append(t, t + window), return_inverse=True)
    following = np.searchsorted(of * len(times) + rank[:n], of * len(times) + rank[n:], "right")
    following = np.clip(following, here + 1, last + 1)
    while True:  # t + window is rounded; what counts is the difference
        back = (following - 1 > here) & (t[following - 1] - t > window)
        ahead = (following <= last) & (t[np.minimum(following, n - 1)] - t <= window)
        if not back.any() and not ahead.any():
            return following
        following = following - back + ahead


def chain(following: np.ndarray, start: int) -> np.ndarray:
    """Places reached from ``start`` by jumps, marked."""
    n = len(following)
    marked = np.zeros(n + 1, bool)
    found, jump = np.array([start]), np.append(following, n)
    while True:
        marked[found] = True
        if jump[found[0]] >= n:
            return marked[:n]
        found, jump = np.append(found, jump[found]), jump[jump]
        found = found[found < n]


def roots(following: np.ndarray) -> np.ndarray:
    """The last place that jumps reach from each place."""
    n = len(following)
    leads = np.where(following < n, np.minimum(following, n - 1), np.arange(n))
    while True:
        further = leads[leads]
        if (further == leads).all():
            return leads
        leads = further


def first_beyond(t: np.ndarray, begin: float, window: float) -> int:
    """The first sample more than ``window`` after ``begin``."""
    return int(np.searchsorted(t - begin > window, True))


def through(t: np.ndarray, window: float) -> list[tuple[float, int]]:
    """One run as a map from the leader open before it to the leader open at its end.

    With a leader at ``begin``, the first (reach, place) with reach - begin > window has the place of the leader at the
    end; without one, the cluster stays open throughout. There are as many steps as different leaders at the end.
    """
    n = len(t)
    of = np.zeros(n, np.int64)
    ends = roots(jumps(t, of, of + n - 1, window))[: first_beyond(t, float(t[0]), window) + 1]
    steps = np.append(np.flatnonzero(ends[1:] != ends[:-1]), len(ends) - 1)
    return [(float(t[i]), int(ends[i])) for i in steps]


def led(t: np.ndarray, of: np.ndarray, last: np.ndarray, window: float, begin: float | None) -> np.ndarray:
    """The place of every sample's leader, -1 where it is the one at ``begin``, open before the first sample."""
    n = len(t)
    kept = 0 if begin is None else first_beyond(t[: last[0] + 1], begin, window)
    if kept == n:
        return np.full(n, -1)
    return np.maximum.accumulate(np.where(chain(jumps(t, of, last, window), kept), np.arange(n), -1))


def with_leaders(samples: DataFrame, keys: list[str], window: float) -> DataFrame:
    """``samples`` (keys, idx, t, ...; t rises with idx) with ``leader``, the idx of the first sample of their cluster.

    A key may hold any share of the rows: partitions are even, and each is one map.
    """
    staged, is_cut = cut(samples, keys, ["idx"])

    def summarise(rows: pa.Table) -> object:
        t, idx = rows["t"].to_numpy(), rows["idx"].to_numpy()
        first, last = key_at(rows, keys, 0), key_at(rows, keys, rows.num_rows - 1)
        begin = int(Groups.by(rows, keys).first[-1])
        tail = t[begin:]
        of = np.zeros(len(tail), np.int64)
        end = begin + int(roots(jumps(tail, of, of + len(tail) - 1, window))[0])
        steps = [(reach, (int(idx[i]), float(t[i]))) for reach, i in through(tail, window)] if first == last else None
        return first, last, (int(idx[end]), float(t[end])), steps

    def compose(states: list[object]) -> list[object]:
        reached, key, carry = [], None, None
        for first, last, alone, steps in states:
            carry = carry if first == key else None
            reached.append(carry)
            if carry is None or steps is None:
                carry = alone
            else:
                carry = next((leader for reach, leader in steps if reach - carry[1] > window), carry)
            key = last
        return reached

    def apply(rows: pa.Table, carry: tuple[int, float] | None) -> pa.Table:
        runs = Groups.by(rows, keys)
        place = led(rows["t"].to_numpy(), runs.of, runs.last, window, carry and carry[1])
        idx = rows["idx"].to_numpy()
        leader = np.where(place >= 0, idx[place], carry[0] if carry else -1)
        return rows.append_column("leader", pa.array(leader, pa.int64()))

    schema = T.StructType([*staged.schema.fields, T.StructField("leader", T.LongType())])
    return folded(staged, is_cut, keys, ["idx"], summarise, compose, apply, schema).drop(CHUNK, FIRST)
