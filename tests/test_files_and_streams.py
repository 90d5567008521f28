import json
import struct

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from screenlens.operators import detect, documents, lineage, pixels
from screenlens.plans import registry
from screenlens.sources import readers, writers
from screenlens.streaming import streams


def bmp(gray):
    h, w = gray.shape
    pad = (4 - w * 3 % 4) % 4
    rows = b"".join(np.repeat(gray[y], 3).astype(np.uint8).tobytes() + b"\0" * pad for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def test_frame_images(spark, tmp_path):
    (tmp_path / "talk").mkdir()
    picture = np.add.outer(np.arange(72) * 2, np.arange(128)) % 256
    (tmp_path / "talk" / "scene_003_t0012.33.bmp").write_bytes(bmp(picture))
    (r,) = readers.read_frame_images(spark, str(tmp_path / "talk"), 64, 36).collect()
    assert (r.video_id, r.frame_no, r.t, len(r.gray)) == ("talk", 3, 12.33, 64 * 36)
    want = picture.reshape(36, 2, 64, 2).mean(axis=(1, 3)).ravel()
    assert np.allclose(r.gray, want, atol=0.01)


def test_subtitle_files(spark, tmp_path):
    for name in ("a.srt", "b.VTT", "c.sami", "d.txt", "e.ko.smi"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.name: r.format for r in readers.read_subtitle_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.srt": "srt", "b.VTT": "vtt", "c.sami": "smi", "e.ko.smi": "smi"}


def test_json_readers_survive_broken_files(spark, tmp_path):
    for video, content in (
        ("a", json.dumps({"flags": [{"time": 1.5, "note": "x"}, {"time": 2.0}]})), ("b", "{broken"), ("c", "[1]"), ("d", '{"flags": []} x'),
    ):
        (tmp_path / video).mkdir()
        (tmp_path / video / "user_flags.json").write_text(content)
    got = readers.read_flags(spark, str(tmp_path)).orderBy("press_no").collect()
    assert [(r.video_id, r.t, r.note) for r in got] == [("a", 1.5, "x"), ("a", 2.0, None)]


def test_transcripts(spark, tmp_path):
    (tmp_path / "talk").mkdir()
    body = {"text": "a b", "segments": [{"start": 0.0, "end": 1.0, "text": "a\nb"}], "words": [{"word": "a", "start": 0.0, "end": 0.4}]}
    (tmp_path / "talk" / "transcript.json").write_text(json.dumps(body, indent=1))
    assert tuple(readers.read_segments(spark, str(tmp_path)).first()) == ("talk", 0, 0.0, 1.0, "a\nb")
    assert tuple(readers.read_words(spark, str(tmp_path)).first()) == ("talk", "a", 0.0, 0.4)


def test_clean_up_levels_are_cumulative(spark, tmp_path):
    sizes = {"video.mkv": 10, "runs/full/frames/a.jpg": 20, "runs/full/read/a.jpg": 5, "transcript.json": 7, "reviews/full.md": 3}
    for name, n in sizes.items():
        path = tmp_path / "talk.analysis" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * n)
    r = lineage.clean_survey(readers.read_file_sizes(spark, str(tmp_path))).first()
    assert (r.video_id, r.cache_bytes, r.images_bytes, r.total_bytes) == ("talk.analysis", 10, 30, 45)


def test_tables_replace_only_the_given_videos(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_table(spark.range(100).select(F.format_string("v%d", F.col("id") % 7).alias("video_id"), "id"), path, 4)
    fresh = spark.createDataFrame([("v3", -1)], "video_id string, id bigint")
    writers.replace_videos(spark, path, fresh, 4)
    got = writers.read_table(spark, path)
    assert got.count() == sum(1 for i in range(100) if i % 7 != 3) + 1
    assert [r.id for r in got.filter("video_id = 'v3'").collect()] == [-1]


def test_documents_round_trip(spark, tmp_path):
    rows = [("007", "full", "# a\n\nb\n"), ("7", "full", "x"), ("my talk+50%: a/b", "1.0", "é"), ("2024-01-01", "full", "")]
    docs = spark.createDataFrame(rows, "video_id string, run string, text string")
    writers.write_documents(docs, str(tmp_path / "d"), ["video_id", "run"])
    back = sorted(tuple(r) for r in writers.read_documents(spark, str(tmp_path / "d"), ["video_id", "run"]).collect())
    assert back == sorted(rows)


def test_a_long_transcript_comes_back_whole(spark, tmp_path):
    text = "a sentence of some length that somebody said in the lecture"
    said = spark.range(70_000).select(
        F.lit("my talk+1").alias("video_id"), F.col("id").alias("seg_no"), F.col("id").cast("double").alias("start"),
        (F.col("id") + 1).cast("double").alias("end"), F.lit(text).alias("text"),
    )
    listed = documents.json_list_documents(said, "segments", "seg_no", F.struct("start", "end", "text"))
    writers.write_documents(listed, str(tmp_path / "t"), ["video_id"])
    got = readers.read_segments(spark, str(tmp_path / "t"), "*.txt")
    assert got.count() == 70_000 and got.exceptAll(said).isEmpty()


def test_frames_of_runs_and_broken_images(spark, tmp_path):
    folder = tmp_path / "my talk" / "runs" / "full" / "frames"
    folder.mkdir(parents=True)
    (folder / "scene_000_t1.0.jpg").write_bytes(b"no image at all")
    (folder / "scene_001_t2.5.bmp").write_bytes(bmp(np.full((2, 2), 20.0)))
    got = sorted(readers.read_frame_images(spark, str(tmp_path), 1, 1).select("video_id", "run", "frame_no", "t", "gray").collect())
    assert got[-1][:4] == ("my talk", "full", 1, 2.5) and abs(got[-1].gray[0] - 20) < 0.01
    assert all(r.gray is None for r in got[:-1])



def feed(spark, tmp_path, df, slices, operator, name):
    source, out, state = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
    for part in slices:
        df.filter(part).write.mode("append").parquet(source)
        streams.run_to_table(operator(spark.readStream.schema(df.schema).parquet(source)), out, state)
    return spark.read.parquet(out)


@pytest.mark.parametrize(("cuts", "shift"), [((30, 60), 0), ((7, 8), 0), ((30, 60), 15), ((50, 90), 15)])
def test_streamed_events_equal_batch_events(spark, tmp_path, cuts, shift):
    """Also with every third sample arriving ``shift`` samples late, and with the end of the video in the last batch."""
    rng = np.random.default_rng(8)
    data = [("v", i, i / 10, 0.0, float(rng.choice([0.001, 0.02])), float(rng.choice([0.0, 0.0, 0.01])), False) for i in range(120)]
    df = spark.createDataFrame(data, streams.SIGNAL_ROW)
    fed = df.unionByName(spark.createDataFrame([("v", None)], "video_id string, idx bigint"), allowMissingColumns=True)
    a, b = cuts
    at = F.coalesce(F.col("idx") + F.when(F.col("idx") % 3 == 0, shift).otherwise(0), F.lit(999))
    slices = [at < a, (at >= a) & (at < b), at >= b]
    got = feed(spark, tmp_path, fed, slices, lambda s: streams.stream_events(s, lateness=shift / 10), "events")
    batch = detect.detect_events(df).withColumn("signals", F.array_join("signals", "+"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*got.columns).collect()))


@pytest.mark.parametrize("hit", [False, True])
def test_a_sample_waits_for_a_late_neighbour(spark, tmp_path, hit):
    """Sample 1 lies before all that may still come, but what follows it is late: a higher sample, so it is no peak."""
    times, areas = [0.0, 1.0, 10.0, 11.0, 30.0, 31.0], [0.0, 0.5, 0.9, 0.0, 0.0, 0.0]
    data = [("v", i, t, 0.0, 0.001, area, False) for i, (t, area) in enumerate(zip(times, areas, strict=True))]
    df = spark.createDataFrame(data, streams.SIGNAL_ROW)
    fed = df.unionByName(spark.createDataFrame([("v", None)], "video_id string, idx bigint"), allowMissingColumns=True)
    hits = spark.createDataFrame([("v", 0.5)], "video_id string, t double") if hit else None
    path = str(tmp_path / "hits")
    if hit:
        hits.write.parquet(path)

    def detected(stream):
        extra = spark.readStream.schema(hits.schema).parquet(path) if hit else None
        return streams.stream_events(stream, merge_window=1.0, settle_limit=2.0, lateness=4.0, extra_hits=extra)

    slices = [F.col("idx").isin(0, 1, 3), F.col("idx").isNull() | F.col("idx").isin(2, 4, 5)]
    got = feed(spark, tmp_path, fed, slices, detected, "gap")
    batch = detect.detect_events(df, hits, merge_window=1.0, settle_limit=2.0).withColumn("signals", F.array_join("signals", "+"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*got.columns).collect()))


def test_streamed_signals_equal_batch_signals(spark, tmp_path):
    rng = np.random.default_rng(9)
    picture, data = rng.uniform(0, 255, 64), []
    for i in range(60):
        if rng.random() < 0.1:
            picture = rng.uniform(0, 255, 64)
        data.append(("v", i, i / 15, 8, 8, picture.astype(np.float32).tolist()))
    df = spark.createDataFrame(data, "video_id string, frame_no bigint, t double, h int, w int, gray array<float>")
    got = feed(spark, tmp_path, df, [F.col("frame_no") < 25, F.col("frame_no") >= 25], streams.stream_signals, "signals")
    full = spark.createDataFrame([("v", 0.0, 1.0)], "video_id string, lo double, hi double")
    want = pixels.measure_signals(df, full).select(*got.columns).orderBy("idx").collect()
    for g, w in zip(got.orderBy("idx").collect(), want, strict=True):
        assert g.is_anchor_reset == w.is_anchor_reset
        assert np.allclose([g.anchor, g.rate, g.area], [w.anchor, w.rate, w.area])


FRAME = "video_id string, frame_no bigint, t double, gray array<float>"


def test_late_frames_are_measured_in_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [("v", i, float(i), rng.uniform(0, 255, 16).astype(np.float32).tolist()) for i in range(40)]
    df = spark.createDataFrame(data, FRAME)
    want = feed(spark, tmp_path, df, [F.lit(True)], streams.stream_signals, "whole").orderBy("idx").collect()
    fed = df.unionByName(spark.createDataFrame([("v", None, None, None)], FRAME))
    at = F.coalesce(F.col("frame_no") + F.when(F.col("frame_no") % 3 == 0, 6).otherwise(0), F.lit(99))
    slices = [at < 3, (at >= 3) & (at < 20), at >= 20]
    got = feed(spark, tmp_path, fed, slices, lambda s: streams.stream_signals(s, lateness=6.0), "late").orderBy("idx").collect()
    assert len(got) == 40 and got == want


def test_late_presses_are_replayed_in_order(spark, tmp_path):
    times = [1.0, 5.0, 1.2, 9.0, 9.1, 14.0, 14.2, 20.0]
    df = spark.createDataFrame([("v", i, t) for i, t in enumerate(times)], "video_id string, press_no bigint, t double")
    want = sorted(map(tuple, feed(spark, tmp_path, df, [F.lit(True)], streams.stream_flags, "all").collect()))
    fed = df.unionByName(spark.createDataFrame([("v", None, None)], df.schema))
    slices = [F.col("press_no").isin(0, 2, 4), F.col("press_no").isin(1, 3, 6), F.coalesce("press_no", F.lit(7)).isin(5, 7)]
    got = feed(spark, tmp_path, fed, slices, lambda s: streams.stream_flags(s, lateness=15.0), "late")
    assert sorted(map(tuple, got.collect())) == want


def test_a_timer_sends_the_tail_of_a_video(spark, tmp_path):
    """Video a gets no end row; the watermark passes its last sample when b's come."""
    seconds = [("a", i) for i in range(30)] + [("b", i) for i in range(500, 530)]
    base = spark.createDataFrame(seconds, "video_id string, n long").withColumn("ts", F.timestamp_seconds("n"))
    t = F.col("n").cast("double").alias("t")
    slices = [F.col("video_id") == "a", F.col("video_id") == "b"]
    frames = base.select("video_id", F.col("n").alias("frame_no"), t, F.array(F.lit(1.0), F.lit(2.0)).alias("gray"), "ts")
    got = feed(spark, tmp_path, frames, slices, lambda s: streams.stream_signals(s, lateness=9.0, delay="20 seconds"), "f")
    assert got.where("video_id = 'a'").count() == 30
    presses = base.select("video_id", F.col("n").alias("press_no"), t, "ts")
    got = feed(spark, tmp_path, presses, slices, lambda s: streams.stream_flags(s, lateness=9.0, delay="20 seconds"), "p")
    assert got.where("video_id = 'a'").agg(F.max("press_no")).first()[0] == 29
    peak = F.when(F.col("n") % 100 == 28, 0.5).otherwise(0.0)
    signals = base.select(
        "video_id", F.col("n").alias("idx"), t, F.lit(0.0).alias("anchor"), F.lit(0.0).alias("rate"), peak.alias("area"), "ts"
    )
    got = feed(spark, tmp_path, signals, slices, lambda s: streams.stream_events(s, delay="20 seconds"), "e")
    assert [r.idx for r in got.where("video_id = 'a'").collect()] == [28]


def test_streamed_events_with_hits_equal_batch_events(spark, tmp_path):
    """Hits of another detector come as a second stream, some of them late, one after the end of the samples."""
    rng = np.random.default_rng(12)
    data = [("v", i, i / 10, 0.0, float(rng.choice([0.001, 0.02])), float(rng.choice([0.0] * 9 + [0.01])), False) for i in range(150)]
    df = spark.createDataFrame(data, streams.SIGNAL_ROW)
    hits = spark.createDataFrame([("v", t) for t in (0.0, 1.23, 1.25, 4.0, 9.99, 14.9, 15.4)], "video_id string, t double")
    fed = df.unionByName(spark.createDataFrame([("v", None)], "video_id string, idx bigint"), allowMissingColumns=True)
    parts = {"s": (fed, F.coalesce(F.col("t"), F.lit(99.0))), "h": (hits, F.col("t") + 1.0)}
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for low, high in ((-1, 3.0), (3.0, 9.0), (9.0, 100.0)):
        for name, (rows, at) in parts.items():
            rows.filter((at >= low) & (at < high)).write.mode("append").parquet(str(tmp_path / name))
        read = {n: spark.readStream.schema(rows.schema).parquet(str(tmp_path / n)) for n, (rows, _) in parts.items()}
        figures = streams.run_to_table(streams.stream_events(read["s"], lateness=2.0, extra_hits=read["h"]), out, state)
    batch = detect.detect_events(df, hits).withColumn("signals", F.array_join("signals", "+"))
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*got.columns).collect()))
    assert any("adaptive" in r.signals for r in got.collect()) and figures == [{"rows": 0}]


@pytest.mark.parametrize("by_timer", [False, True])
def test_no_state_is_left_when_videos_have_ended(spark, tmp_path, by_timer):
    base = spark.createDataFrame([(v, i) for v in "abc" for i in range(20)], "video_id string, n long")
    base = base.withColumn("ts", F.timestamp_seconds("n"))
    names = base.select("video_id").distinct()
    last = spark.createDataFrame([("z", 10_000)], "video_id string, n long").withColumn("ts", F.timestamp_seconds("n"))
    t = F.col("n").cast("double").alias("t")
    delay = "20 seconds" if by_timer else None
    forms = {
        "frame_no": ([F.array(F.lit(1.0), F.lit(2.0)).alias("gray")], streams.stream_signals),
        "press_no": ([], streams.stream_flags),
        "idx": ([F.lit(0.0).alias("anchor"), F.lit(0.0).alias("rate"), F.when(F.col("n") % 9 == 4, 0.5).otherwise(0.0).alias("area")], streams.stream_events),
    }
    for number, (more, operator) in forms.items():
        rows = [df.select("video_id", F.col("n").alias(number), t, "ts", *more) for df in (base, last)]
        ends = names.select("video_id", F.lit(None).cast("long").alias(number), F.lit(None).cast("double").alias("t"))
        source, out, state = (str(tmp_path / f"{number}-{x}") for x in ("in", "out", "state"))
        left = []
        for part in (rows[0], rows[1] if by_timer else ends):
            part.write.mode("append").parquet(source)
            stream = spark.readStream.schema(rows[0].schema).parquet(source)
            left.append(streams.run_to_table(operator(stream, lateness=5.0, delay=delay), out, state)[0]["rows"])
        videos = {r.video_id for r in spark.read.parquet(out).select("video_id").distinct().collect()}
        assert left[0] > 0 and videos == {"a", "b", "c"}
        # by timer only z is open: its clock, what waits, its timer
        assert left[1] <= 6 if by_timer else left[1] == 0, (number, left)


def test_upsert_by_several_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "video_id string, path string, ok boolean"
    first = [("a", "subs/track1.srt", True), ("b", "subs/track1.srt", False), ("b", "x", True)]
    second = [("b", "subs/track1.srt", True), ("c", "x", False)]
    for rows in (first, second, second, []):
        writers.upsert(spark, path, spark.createDataFrame(rows, schema), ["video_id", "path"], 4)
    want = {("a", "subs/track1.srt"): True, ("b", "subs/track1.srt"): True, ("b", "x"): True, ("c", "x"): False}
    assert {(r.video_id, r.path): r.ok for r in writers.read_table(spark, path).collect()} == want
    some = writers.rows_of(spark, path, spark.createDataFrame([("b",), ("z",)], "video_id string"), 4)
    assert sorted((r.video_id, r.path) for r in some.collect()) == [("b", "subs/track1.srt"), ("b", "x")]


def test_a_refresh_that_failed_is_made_up_for(spark, tmp_path):
    source, recorded, out, state = (str(tmp_path / x) for x in ("in", "recorded", "out", "state"))
    schema = "video_id string, path string, size long, seen_no int"

    def run(render, rows=()):
        if rows:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        streams.refresh_outputs(spark.readStream.schema(schema).parquet(source), recorded, out, state, render).awaitTermination()

    made = []

    def render(videos):
        made.append(sorted(r.video_id for r in videos.collect()))
        return videos.select("video_id", F.lit("full").alias("run"), F.col("size").cast("string").alias("text"))

    def broken(videos):
        raise OSError("no space left")

    run(render, [("a", "p", 1, 0), ("b", "p", 2, 0), ("b", "p", 3, 1), ("c", None, None, 0)])
    with pytest.raises(Exception, match="no space left"):
        run(broken, [("a", "p", 1, 2), ("b", "q", 3, 2), ("c", None, None, 2)])
    run(render)
    assert made == [["a", "b", "c"], ["b"]]
    assert {r.video_id: r.text for r in writers.read_table(spark, out).collect()} == {"a": "1", "b": "3", "c": None}


def sidecar_files(root):
    """Files in folders that readers look into, files and folders that they leave out, and names with odd characters."""
    files = {
        "a.info.json": b'{"n": 1}', "deep/er/b.info.json": b'{"n": 2}\n', "my talk+50%41 \xc3\xa9/c#1.info.json".encode("latin-1").decode(): b'{"n": 3}',
        "video_id=x%2Fy/d.info.json": b"\xff\xfe", "e.json": b'{"n": 5}', ".f.info.json": b"{}", "_g/h.info.json": b"{}", "i.info.json": b"",
        "_k=1/l.info.json": b'{"n": 6}',
    }
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)


def test_tasks_find_the_files_that_spark_finds(spark, tmp_path):
    sidecar_files(tmp_path)
    got = readers._documents(spark, str(tmp_path), "*.info.json")
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.info.json").text(str(tmp_path), wholetext=True)
    want = raw.select(readers._unescaped(F.col("_metadata.file_path")).alias("origin"), "value")
    both = [sorted(df.select("origin", F.col("value").cast("binary")).collect()) for df in (got, want)]
    assert both[0] == both[1] and len(both[0]) == 5
    assert not any("FileScan" in line for line in got._jdf.queryExecution().toString().splitlines())


def test_documents_are_written_as_the_text_sink_does(spark, tmp_path):
    rows = [("a:b/é[1]", "full", "x\ny"), ("", None, "index"), ("k", "r", None), ("k", "r", "two"), ("k", "s", "")]
    docs = spark.createDataFrame(rows, "video_id string, run string, text string").coalesce(1)
    ours, sink = tmp_path / "ours", tmp_path / "sink"
    for _ in range(2):
        writers.write_documents(docs, str(ours), ["video_id", "run"])
    docs.write.partitionBy("video_id", "run").text(str(sink))

    def files(root):
        return sorted((str(f.parent.relative_to(root)), f.read_bytes()) for f in root.rglob("part-*"))

    assert files(ours) == files(sink) and len(files(ours)) == 4
    back = {(r.video_id, r.run): r.text for r in writers.read_documents(spark, str(ours), ["video_id", "run"]).collect()}
    assert back == {("a:b/é[1]", "full"): "x\ny", (None, None): "index", ("k", "r"): "\ntwo", ("k", "s"): ""}


def test_a_document_of_every_run_and_an_index_of_every_video(spark, tmp_path):
    said = [(0, 0, "user", "hello there"), (0, 1, "assistant", "good day"), (7, 0, "user", "one more")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    seen = [(i, "2024-01-03 04:05:06", i % 3, kind, 7.5) for i, kind in enumerate(["view", "click", "signup", "error"])]
    events = spark.createDataFrame(seen, "event_id long, ts string, user_id long, event_type string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    found = registry.queries()["write_context_markdown"](spark, str(tmp_path)).collect()
    want = {(v, run) for v in "07" for run in ("full", "0005_0-0020_0", None)}
    assert {(r.video_id, r.run) for r in found} == want and len(found) == 6
    (index,) = [r.text for r in found if (r.video_id, r.run) == ("7", None)]
    assert index.startswith("# conversation 7\n") and "`runs/full/context.md`" in index and "`runs/0005_0-0020_0/context.md`" in index


def test_intake_ranks_the_touched_videos_again(spark, tmp_path):
    """A verdict of b comes again and another way; a's choice stays as it was made."""
    schema, touched = "video_id string, path string, ok boolean", []
    source, out, state, chosen = (str(tmp_path / x) for x in ("in", "out", "state", "chosen"))
    pool = [(v, p, r) for v in "abc" for r, p in ((1, "x"), (2, "y"))]
    candidates = spark.createDataFrame(pool, "video_id string, path string, rank int")

    def choose(again, verdicts):
        touched.append(sorted({r.video_id for r in again.collect()}))
        good = again.join(verdicts, ["video_id", "path"], "left").groupBy("video_id")
        return good.agg(F.min(F.when(F.col("ok"), F.col("rank"))).alias("rank"), F.lit(len(touched)).alias("made"))

    for rows in ([("a", "x", False), ("a", "y", True), ("b", "x", True)], [("b", "x", False)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(schema).parquet(source)
        streams.subtitle_intake(arriving, out, state, lambda batch: batch, candidates, choose, chosen).awaitTermination()
    assert touched == [["a", "b"], ["b"]]
    assert {(r.video_id, r.rank, r.made) for r in writers.read_table(spark, chosen).collect()} == {("a", 2, 1), ("b", None, 2)}


def test_subtitle_intake_tells_what_each_video_takes(spark, tmp_path):
    said = [(v, turn, "user", f"sentence {turn} of some length that is said here") for v in (0, 1, 2) for turn in range(6 if v < 2 else 2)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = registry.queries()["stream_subtitle_intake"](spark, str(tmp_path)).collect()
    got = {r.video_id: (r.path, r.reason, r.kind, r.n_candidates, r.n_rejected) for r in found}
    assert got == {
        "0": ("subs/track0.srt", None, "sidecar", 3, 0),
        "1": ("subs/track1.srt", None, "sidecar", 3, 1),
        "2": ("subs/track2.srt", "too-few-cues", "whisper", 3, 3),
    }


def test_a_video_costs_one_read_and_one_write_a_batch(monkeypatch):
    """However many rows come at a time. Nulls, repeated samples and hits are taken as the batch form takes them."""
    calls, value = [], {}

    class State:
        def get(self):
            calls.append("get")
            return value.get("v")

        def update(self, new):
            calls.append("update")
            value["v"] = new

        def clear(self):
            value.clear()

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return State()

    one = Row("video_id", "idx", "t", "anchor", "rate", "area", "hit")
    rng = np.random.default_rng(4)
    rows = [one("v", i, float(i), None if i % 9 == 4 else 0.0, float(rng.choice([0.001, 0.02])), float(rng.choice([0.0, 0.01])), False) for i in range(60)]
    late = [one("v", -5, 20.5, None, None, None, True), one("v", 30, 99.0, 1.0, 1.0, 1.0, False)]
    heights = {"cut": ("area", 0.002), "anchor": ("anchor", 0.02), "rate": ("rate", 0.012)}
    found = []
    for size in (10_000, 7):
        monkeypatch.setattr(streams, "BATCH", size)
        video = streams._Events(0.0, False, heights, 0.0015, 1.5, 2.0)
        video.init(Handle())
        got = [*video.handleInputRows(("v",), iter(rows[:40]), None), *video.handleInputRows(("v",), iter(late + rows[40:]), None)]
        assert calls == ["get", "update"] * 2
        got += [*video.handleInputRows(("v",), iter([one("v", None, None, None, None, None, False)]), None)]
        assert calls == ["get", "update"] * 2 + ["get"] and not value
        found.append(got)
        calls.clear()
    assert found[0] == found[1] and len(found[0]) > 5
    assert all(type(x) in (str, int, float) for event in found[0] for x in event)
