import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlens.operators import budget, pixels

FRAMES = "video_id string, frame_no bigint, t double, h int, w int, gray array<float>"


def frames_of(spark, stack, video="v", fps=15.0):
    n, h, w = stack.shape
    data = [(video, i, i / fps, h, w, stack[i].astype(np.float32).ravel().tolist()) for i in range(n)]
    return spark.createDataFrame(data, FRAMES)


def reference_fold(stack, a_thr, c_thr, r_thr):
    """Straight loop over one video, state carried from frame to frame."""
    flat = stack.reshape(len(stack), -1).astype(np.float64)
    anchor, open_, out = flat[0], False, [(0.0, False)]
    for i in range(1, len(flat)):
        move = np.abs(flat[i] - flat[i - 1])
        d, rate, area = np.abs(flat[i] - anchor).mean() / 255, move.mean() / 255, (move > 25).mean()
        reset = open_ and rate <= r_thr
        out.append((d, reset))
        if open_:
            if reset:
                anchor, open_ = flat[i], False
        else:
            open_ = d > a_thr or area > c_thr
    return out


@pytest.mark.parametrize(("drift", "chunk"), [(0.0, 16), (3.0, 16), (3.0, 1), (12.0, 7)])
def test_recordings_without_a_cut_run_in_chunks(spark, drift, chunk):
    """A still picture, and ones that drift so slowly that no frame is a cut, but the anchor moves many times."""
    rng = np.random.default_rng(5)
    picture, stack = rng.uniform(60, 190, (9, 16)), []
    for i in range(120 if chunk > 1 else 25):
        if i % 5 == 3:
            picture = np.clip(picture + drift, 0, 255)
        if i % 40 == 39:
            picture = rng.permutation(picture.ravel()).reshape(9, 16) * 0.1 + picture * 0.9
        stack.append(picture.astype(np.float32))
    stack = np.array(stack)
    df = frames_of(spark, stack)
    limits = (0.02, 0.5, 0.0015)  # nothing counts as a cut
    change = pixels.frame_change(df)
    got = pixels.anchor_diff(df, change, *limits, chunk=chunk).orderBy("frame_no").collect()
    want = reference_fold(stack, *limits)
    assert [r.frame_no for r in got] == list(range(len(stack)))
    assert [r.is_anchor_reset for r in got] == [reset for _, reset in want]
    assert np.allclose([r.anchor for r in got], [d for d, _ in want])
    assert (sum(reset for _, reset in want) > 1) == (drift > 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_anchor_pieces_equal_the_sequential_fold(spark, seed, both_ways):
    rng = np.random.default_rng(seed)
    picture, stack = rng.uniform(0, 255, (9, 16)), []
    for i in range(300):
        if rng.random() < 0.05:
            picture = rng.uniform(0, 255, (9, 16))       # a cut
        elif rng.random() < 0.3:
            picture = np.clip(picture + rng.normal(0, 4, (9, 16)), 0, 255)   # drift
        stack.append(picture)
    stack = np.array(stack).astype(np.float32)
    df = frames_of(spark, stack)
    change = pixels.frame_change(df, chunk=37)
    got = pixels.anchor_diff(df, change).orderBy("frame_no").collect()
    want = reference_fold(stack, 0.02, 0.02, 0.0015)
    assert [r.is_anchor_reset for r in got] == [w[1] for w in want]
    assert np.allclose([r.anchor for r in got], [w[0] for w in want])
    assert sum(w[1] for w in want) > 3


def test_caption_rows_are_measured_and_cropped(spark):
    stack = np.full((12, 36, 64), 128.0)
    stack[::2, 33:36, :] = 250.0
    df = frames_of(spark, stack)
    full = pixels.frame_change(df).agg(F.max("area")).first()[0]
    assert full > 0.02
    bands = pixels.overlay_body_band(pixels.row_change_frequency(df, chunk=5))
    assert tuple(bands.first())[1:] == (0.0, 33 / 36)
    assert pixels.frame_change(pixels.crop_rows(df, bands)).agg(F.max("area")).first()[0] == 0.0


def freq_table(spark, values):
    return spark.createDataFrame([("v", i, float(f)) for i, f in enumerate(values)], "video_id string, row bigint, freq double")


@pytest.mark.parametrize(
    "values, band",
    [
        ([0.03] * 33 + [0.20] * 3, (0.0, 33 / 36)),
        ([0.0009] * 33 + [0.014] * 3, (0.0, 33 / 36)),
        ([0.01] * 15 + [0.9] * 6 + [0.01] * 15, (0.0, 1.0)),
        ([0.01] * 24 + [0.9] * 12, (0.0, 1.0)),
        ([0.9] * 2 + [0.01] * 34, (2 / 36, 1.0)),
        ([0.9] * 4, (0.0, 1.0)),
    ],
)
def test_body_band(spark, values, band):
    assert tuple(pixels.overlay_body_band(freq_table(spark, values)).first())[1:] == band


def test_content_area_separates_blank_from_written(spark):
    blank = np.full((1, 90, 160), 12.0)
    bright = blank.copy()
    bright[0, 40:44, 50:110] = 200.0
    for stack, check in ((blank, lambda a: a == 0.0), (bright, lambda a: a > 0.001)):
        assert check(frames_of(spark, stack).select(pixels.content_area(F.col("gray"))).first()[0])


def test_similarity_of_equal_and_different_pictures(spark):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(0, 255, (2, 20, 30))
    stack = np.stack([a, a, b])
    df = frames_of(spark, stack, fps=1.0)
    pairs = spark.createDataFrame([("v", 1, 0.0, 1.0), ("v", 2, 1.0, 2.0)], "video_id string, n int, x double, y double")
    got = {r.n: (r.similarity, r.changed) for r in pixels.pair_changed(pairs, df, "x", "y").collect()}
    assert got[1] == (1.0, False) and got[2][1]

    # brute force: every 7x7 window on its own
    def windows(p, q):
        out = []
        for i in range(14):
            for j in range(24):
                u, v = p[i : i + 7, j : j + 7].ravel(), q[i : i + 7, j : j + 7].ravel()
                c1, c2 = 2.55**2, 7.65**2
                cov = np.cov(u, v)
                out.append((2 * u.mean() * v.mean() + c1) * (2 * cov[0, 1] + c2)
                           / ((u.mean() ** 2 + v.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2)))
        return np.mean(out)

    f32 = stack.astype(np.float32).astype(np.float64)
    assert abs(got[2][0] - windows(f32[1], f32[2])) < 1e-9


def test_missing_frame_counts_as_changed(spark):
    df = frames_of(spark, np.zeros((2, 8, 8)), video="other")
    pairs = spark.createDataFrame([("v", 0.0, 1.0)], "video_id string, x double, y double")
    assert pixels.pair_changed(pairs, df, "x", "y").first().changed


def test_capture_moves_on_while_the_picture_changes(spark):
    rng = np.random.default_rng(4)
    still = np.repeat(rng.uniform(0, 255, (1, 16, 16)), 60, axis=0)
    moving = rng.uniform(0, 255, (60, 16, 16))
    for stack, want in ((still, 1.5), (moving, 2.5)):
        df = frames_of(spark, stack, fps=10.0)
        videos = spark.createDataFrame([("v", 6.0)], "video_id string, duration double")
        points = spark.createDataFrame([("v", 0.0)], "video_id string, at double")
        assert pixels.stable_capture_time(points, df, videos, "at").first().stable_t == want


@pytest.mark.parametrize("w, h, tokens", [(768, 432, 442), (1024, 576, 786), (1920, 1080, 1843), (100, 100, 13)])
def test_image_tokens(spark, w, h, tokens):
    assert spark.range(1).select(budget.image_tokens(F.lit(w), F.lit(h))).first()[0] == tokens


def test_read_copies_are_never_enlarged(spark):
    out = spark.range(1).select(
        budget.reduced_size(F.lit(1920), F.lit(1080)), budget.reduced_size(F.lit(640), F.lit(480))
    ).first()
    assert tuple(out[0]) == (768, 432) and tuple(out[1]) == (640, 480)
