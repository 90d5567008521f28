"""Frames to a document, every decision measured."""

import numpy as np
from pyspark.sql import functions as F

from screenlens.operators import analysis, budget, dialogue, documents
from screenlens.sources import readers, writers

FRAMES = "video_id string, frame_no bigint, t double, h int, w int, gray array<float>"


def clip(h=36, w=64, fps=10):
    """Four screens of four seconds: slides, a slide that gets a line more while it is up, an empty one, a slide."""
    rng = np.random.default_rng(3)
    slides = [rng.choice([20.0, 230.0], (h, w)) for _ in range(3)]
    empty = np.full((h, w), 128.0)
    grown = slides[1].copy()
    grown[10:14, 5:45] = 255 - grown[10:14, 5:45]
    stack = []
    for n, picture in enumerate([slides[0], slides[1], empty, slides[2]]):
        stack += [grown if n == 1 and i > 25 else picture for i in range(4 * fps)]
    return [("v", i, i / fps, h, w, p.astype(np.float32).ravel().tolist()) for i, p in enumerate(stack)]


def test_frames_become_a_document(spark):
    rows = clip()
    frames = spark.createDataFrame(rows, FRAMES)
    videos = spark.createDataFrame([("v", 16.0, 10.0)], "video_id string, duration double, fps double")
    runs = spark.createDataFrame([("v", "full", 0.0, 16.0), ("v", "0004_0-0008_0", 4.0, 8.0)], "video_id string, run string, lo double, hi double")
    bands = spark.createDataFrame([("v", 0.0, 1.0)], "video_id string, lo double, hi double")
    found = analysis.analyse(frames, runs, videos, bands, cut_area_threshold=0.01)
    events = [round(r.t, 1) for r in found.events.orderBy("event_no").collect()]
    assert events == [4.0, 6.6, 8.0, 12.0]
    full = found.candidates.filter("run = 'full'").orderBy("seq").collect()
    # Within the empty screen the frame after the change and none else are taken, and it is rejected as blank.
    blank = [r for r in full if r.status == "rejected"]
    assert [(r.reject_reason, r.screen) for r in blank] == [("blank(<=0.001)", 3)]
    assert all(8.0 <= r.t < 12.0 for r in blank)
    assert {r.screen for r in full if r.status == "accepted"} == {0, 1, 2, 4}
    # A screen that stood still needs no second picture.
    assert not [r for r in full if list(r.sources) == ["screen-end"]]
    shown = {(r.run, r.screen): (round(r.start, 1), round(r.end, 1)) for r in found.screens.collect()}
    assert len([k for k in shown if k[0] == "full"]) == 5 and shown["full", 0][0] == 0.0 and shown["full", 4][1] == 16.0
    said = spark.createDataFrame([("v", 0, 1.0, 2.0, "first"), ("v", 1, 9.0, 10.0, "nothing to see")], "video_id string, seg_no bigint, start double, end double, text string")
    assigned = dialogue.assign_segments(dialogue.segments_in(said, runs), found.screens)
    accepted = found.candidates.filter("status = 'accepted'")
    titles = runs.filter("run = 'full'").withColumns({"title": F.lit("talk"), "duration": F.lit(16.0)})
    costs = budget.read_budget(accepted.withColumns({"w": F.lit(768), "h": F.lit(432)}))
    made = documents.render_context(titles, found.screens, dialogue.hosts(found.screens, assigned), assigned, accepted, costs)
    text = {r.run: r.text for r in made.collect()}["full"]
    assert "# talk" in text and "first" in text
    assert documents.NO_IMAGE + "\nnothing to see" in text and text.count("![](read/scene_") == 4


def test_pictures_asked_for_by_hand(spark):
    frames = spark.createDataFrame(clip(), FRAMES)
    videos = spark.createDataFrame([("v", 16.0, 10.0)], "video_id string, duration double, fps double")
    runs = spark.createDataFrame([("v", "full", 0.0, 16.0), ("v", "part", 4.0, 8.0)], "video_id string, run string, lo double, hi double")
    bands = spark.createDataFrame([("v", 0.0, 1.0)], "video_id string, lo double, hi double")
    found = analysis.analyse(frames, runs, videos, bands, cut_area_threshold=0.01)
    said = spark.createDataFrame([("v", 0, 1.0, 2.0, "first"), ("v", 1, 9.0, 10.0, " later ")], "video_id string, seg_no bigint, start double, end double, text string")
    key = "video_id string, run string, at double, reason string"
    asked = [("v", "full", 1.5, "a"), ("v", "full", 1.5, "a"), ("v", "full", 1.5, "b"), ("v", "full", 9.5, "a"), ("v", "full", 3.9, "a"),
             ("v", "full", 17.0, "a"), ("v", "part", 9.0, "a"), ("v", "part", 5.0, "a"), ("w", "full", 1.0, "a"), ("v", "full", 2.0, "old")]
    ledger = spark.createDataFrame([("v", "full", 2.0, "old", 2.3)], key + ", time double")
    batch = spark.createDataFrame(asked, key)
    rows = analysis.answer_requests(batch, ledger, frames, videos, runs, found, said).collect()
    by_key = {(r.video_id, r.run, r.at, r.reason): r for r in rows}
    assert len(by_key) == len(rows) == 9
    errors = {k: r.error for k, r in by_key.items() if r.status == "refused"}
    assert errors == {("v", "full", 17.0, "a"): "out-of-range", ("v", "part", 9.0, "a"): "out-of-window", ("w", "full", 1.0, "a"): "unknown-run"}
    assert (by_key["v", "full", 2.0, "old"].status, by_key["v", "full", 2.0, "old"].time) == ("known", 2.3)
    one = by_key["v", "full", 1.5, "a"]
    assert (one.status, one.time, one.image, one.image_tokens, one.said_at) == ("new", 1.8, "requested/req_0001.80.jpg", 3, "first")
    assert one.interval_start == 0.0 and one.warning is None
    # Just before the cut the picture is not yet still, so it is taken a second later.
    assert by_key["v", "full", 3.9, "a"].time in (4.2, 5.2)
    assert by_key["v", "full", 9.5, "a"].said_at == "later"
    after = analysis.answer_requests(batch, spark.createDataFrame([r for r in rows if r.status != "refused"], _schema(rows)).drop("status"), frames, videos, runs, found, said)
    assert {r.status for r in after.collect()} == {"known", "refused"}


def _schema(rows):
    types = {"time": "double", "yavg": "double", "at": "double", "interval_start": "double", "interval_end": "double", "image_tokens": "long"}
    return ", ".join(f"{c} {types.get(c, 'string')}" for c in rows[0].__fields__)


def test_images_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("my talk+1", "0004_0-0008_0", f"frames/scene_{n:03d}_t{n / 4:07.2f}.jpg", 5, 7, rng.uniform(-9, 270, 35).astype(np.float32).tolist()) for n in range(6)]
    rows += [("x", "full", "scene_000_t0000.00.jpg", 5, 7, None), ("x", "full", "scene_001_t0000.00.jpg", 5, 7, [1.0])]
    frames = spark.createDataFrame(rows, "video_id string, run string, image string, h int, w int, gray array<float>")
    path = str(tmp_path / "pictures")
    writers.write_frame_images(frames, path)
    got = readers.read_frame_images(spark, path, 7, 5).orderBy("frame_no").collect()
    assert [(r.video_id, r.run, r.frame_no, r.t) for r in got] == [("my talk+1", "0004_0-0008_0", n, n / 4) for n in range(6)]
    for r, row in zip(got, rows):
        assert np.allclose(r.gray, np.rint(row[5]).clip(0, 255), atol=0.01)


def test_a_video_without_frames(spark):
    none = spark.createDataFrame([], FRAMES)
    videos = spark.createDataFrame([("v", 16.0, 10.0)], "video_id string, duration double, fps double")
    runs = spark.createDataFrame([("v", "full", 0.0, 16.0)], "video_id string, run string, lo double, hi double")
    found = analysis.analyse(none, runs, videos)
    assert [(r.screen, r.start, r.end) for r in found.screens.collect()] == [(0, 0.0, 16.0)]
    assert [(r.status, r.reject_reason) for r in found.candidates.collect()] == [("rejected", "extract-failed")]


def test_pictures_of_a_run_lie_in_one_folder(spark, tmp_path):
    """A folder a picture made a task of every folder when the pictures were listed, and three for every write."""
    frames = spark.range(40).selectExpr("'v/1' AS video_id", "'full' AS run", "format_string('scene_%03d_t%07.2f.bmp', id, id / 4) AS image", "2 AS h", "3 AS w", "array_repeat(cast(id AS float), 6) AS gray")
    path = tmp_path / "pictures"
    for _ in range(2):  # the second time replaces what the first one wrote
        writers.write_frame_images(frames, str(path))
    (folder,) = {p.parent for p in path.rglob("*.bmp") if p.is_file()}
    assert sorted(p.name for p in folder.iterdir()) == [f"scene_{n:03d}_t{n / 4:07.2f}.bmp" for n in range(40)]
    got = readers.read_frame_images(spark, str(path), 3, 2).orderBy("frame_no").collect()
    assert [(r.video_id, r.run, r.frame_no, r.t, r.gray) for r in got] == [("v/1", "full", n, n / 4, [float(n)] * 6) for n in range(40)]
