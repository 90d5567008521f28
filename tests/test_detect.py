"""Events from hand-made series; expected values worked out on paper or by brute force."""

import random

import pytest

from screenlens.operators import detect as D

SIGNALS = "video_id string, idx bigint, t double, anchor double, rate double, area double, is_anchor_reset boolean"


def series(spark, n, fps=30.0, rate=None, area=None, anchor=None, video="v", base=0.0):
    rate, area, anchor = rate or {}, area or {}, anchor or {}
    data = [
        (video, i, i / fps, anchor.get(i, 0.0), rate.get(i, base), area.get(i, 0.0), False) for i in range(n)
    ]
    return spark.createDataFrame(data, SIGNALS)


def events(df, **kw):
    return [r.asDict() for r in D.detect_events(df, **kw).orderBy("event_no").collect()]


def test_one_event_with_capture_points(spark):
    df = series(spark, 13, rate={5: 0.02, 6: 0.05, 7: 0.02}, area={6: 0.10})
    (e,) = events(df)
    assert (e["idx"], e["signals"], e["before_idx"], e["after_idx"]) == (6, ["cut", "rate"], 4, 8)


def test_each_signal_finds_its_own_event(spark):
    df = series(spark, 70, area={5: 0.05}, anchor={30: 0.05}, rate={55: 0.05})
    assert [(e["idx"], e["signals"]) for e in events(df)] == [(5, ["cut"]), (30, ["anchor"]), (55, ["rate"])]


def test_near_peaks_are_one_event(spark):
    df = series(spark, 40, area={10: 0.05}, anchor={11: 0.05}, rate={12: 0.05})
    (e,) = events(df)
    assert (e["idx"], e["signals"]) == (10, ["anchor", "cut", "rate"])


def test_capture_points_stay_between_events(spark):
    df = series(spark, 60, area={10: 0.05, 35: 0.05}, base=0.01)
    first, second = events(df)
    assert 10 <= first["after_idx"] <= 35 and 10 <= second["before_idx"] <= 35


def test_capture_points_stay_within_the_limit(spark):
    df = series(spark, 200, area={100: 0.05}, base=0.01)
    (e,) = events(df, settle_limit=0.5)
    assert abs(e["before_t"] - e["t"]) <= 0.5 and abs(e["after_t"] - e["t"]) <= 0.5


def test_plateau_is_represented_by_its_end(spark):
    df = series(spark, 8, area={2: 0.05, 3: 0.05})
    assert [r.idx for r in D.signal_peaks(df, "area", 0.01).collect()] == [3]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_short_series_has_no_peaks(spark, n):
    assert D.detect_events(series(spark, n, area={0: 1.0, 1: 1.0})).count() == 0


def test_extra_hits_join_and_late_ones_fall_out(spark):
    df = series(spark, 30)
    hits = spark.createDataFrame([("v", 0.41), ("v", 99.0)], "video_id string, t double")
    assert [(e["idx"], e["signals"]) for e in events(df, extra_hits=hits)] == [(13, ["adaptive"])]


def brute_force(rows, anchor_thr=0.02, rate_thr=0.0015, cut_thr=0.002, merge=0.5, limit=1.0):
    t = [r[2] for r in rows]
    rate = [r[4] for r in rows]

    def tops(values, height):
        return [i for i in range(1, len(values) - 1) if values[i] > height and values[i - 1] <= values[i] > values[i + 1]]

    tags = {}
    for name, values, height in (
        ("cut", [r[5] for r in rows], cut_thr), ("anchor", [r[3] for r in rows], anchor_thr), ("rate", rate, rate_thr * 8),
    ):
        for i in tops(values, height):
            tags.setdefault(i, set()).add(name)
    groups = []
    for i in sorted(tags):
        if groups and t[i] - t[groups[-1][0]] <= merge:
            groups[-1].append(i)
        else:
            groups.append([i])
    out = []
    for k, g in enumerate(groups):
        low = groups[k - 1][-1] if k else 0
        high = groups[k + 1][0] if k + 1 < len(groups) else len(t) - 1

        def pick(start, way):
            near = [i for i in way if abs(t[i] - t[start]) <= limit]
            quiet = [i for i in near[1:] if rate[i] <= rate_thr]
            return quiet[0] if quiet else min(near, key=lambda i: (rate[i], abs(i - start)))

        names = sorted(set().union(*(tags[i] for i in g)))
        out.append((g[0], names, pick(g[0], range(g[0], low - 1, -1)), pick(g[-1], range(g[-1], high + 1))))
    return out


def test_random_series_match_brute_force_however_they_are_cut(spark, both_ways):
    rng = random.Random(5)
    data = []
    for v in range(4):
        t = 0.0
        for i in range(400):
            t += rng.choice([1 / 30, 1 / 30, 1 / 10, 0.4])
            noisy = rng.random() < (0.3 if v != 2 else 0.9)  # video 2 changes all the time
            data.append((f"v{v}", i, t, rng.random() * 0.03, rng.random() * 0.02 if noisy else 0.001,
                         rng.random() * 0.004 if noisy else 0.0, False))
    df = spark.createDataFrame(data, SIGNALS)
    want = {
        (v, *[x if not isinstance(x, list) else "+".join(x) for x in e])
        for v in {r[0] for r in data}
        for e in brute_force([r for r in data if r[0] == v])
    }
    found = D.settle_points(D.merge_peaks(D.tagged_peaks(df)), df)
    got = {(r.video_id, r.idx, "+".join(r.signals), r.before_idx, r.after_idx) for r in found.collect()}
    assert got == want


@pytest.mark.parametrize(
    "times",
    [
        [0, 0.3, 0.4999999995, 0.4999999999, 0.6, 0.9],
        [0, 0.5, 0.5000000001, 1.0, 1.5, 1.5000000002],
        [i * 0.2999 for i in range(10_000)],
    ],
)
def test_trains_of_any_length_and_edge_times(spark, both_ways, times):
    peaks = spark.createDataFrame([("v", i, float(t), "cut") for i, t in enumerate(times)], "video_id string, idx long, t double, signal string")
    want, first = [], None
    for i, t in enumerate(times):
        if first is None or t - times[first] > 0.5:
            first = i
            want.append([i, i])
        want[-1][1] = i
    got = sorted([r.idx, r.last_idx] for r in D.merge_peaks(peaks).collect())
    assert got == want


def test_signal_counts(spark):
    df = series(spark, 70, area={5: 0.05}, anchor={6: 0.05}, rate={55: 0.05})
    counts = {r.signal: r.n_events for r in D.signal_counts(D.detect_events(df)).collect()}
    assert counts == {"cut": 1, "anchor": 1, "rate": 1}


def test_frame_numbers_beyond_the_duration_condemn_the_video(spark):
    videos = spark.createDataFrame([("a", 10.0, 5.0), ("b", 10.0, 5.0)], "video_id string, fps double, duration double")
    hits = spark.createDataFrame([("a", 10), ("a", 90), ("b", 20)], "video_id string, frame_no bigint")
    out = {(r.video_id, r.frame_no): (r.t, r.error is None) for r in D.frame_no_to_pts(hits, series(spark, 0), videos).collect()}
    assert out[("b", 20)] == (2.0, True) and not out[("a", 10)][1] and not out[("a", 90)][1]


def test_sweep_keeps_the_baseline_whole(spark):
    df = series(spark, 300, area={i: 0.003 + 0.01 * (i % 40 == 0) for i in range(20, 280, 20)})
    swept = D.threshold_sweep(df, [("base", 0.02, 0.0015, 0.002), ("cut", 0.02, 0.0015, 0.01)])
    report = {r.setting: (r.n_events, r.recall) for r in D.sweep_report(swept, "base", 0.5).collect()}
    assert report["base"][1] == 1.0 and report["cut"][0] < report["base"][0]
