import json
import random

from pyspark.sql import functions as F

from screenlens.operators import dialogue, documents, screens

SCREENS = "video_id string, run string, screen bigint, start double, end double"
SEGMENTS = "video_id string, run string, seg_no bigint, start double, end double, text string"
EVENTS = "video_id string, event_no bigint, t double, after_t double"
RUNS = "video_id string, run string, lo double, hi double"


def make_screens(spark, spans):
    return spark.createDataFrame([("v", "full", i, float(a), float(b)) for i, (a, b) in enumerate(spans)], SCREENS)


def make_segments(spark, spans):
    return spark.createDataFrame(
        [("v", "full", i, float(a), float(b), f"s{i}") for i, (a, b) in enumerate(spans)], SEGMENTS
    )


def test_screen_periods(spark, rows, both_ways):
    events = spark.createDataFrame([("v", 0, 10.0, 10.1), ("v", 1, 30.0, 30.1)], EVENTS)
    runs = spark.createDataFrame(
        [("v", "full", 0.0, 50.0), ("v", "part", 20.0, 30.05), ("quiet", "full", 0.0, 9.0)], RUNS
    )
    got = rows(screens.screen_periods(events, runs), "video_id", "run", "screen")
    assert got == [
        ("quiet", "full", 0, 0.0, 9.0),
        ("v", "full", 0, 0.0, 10.0),
        ("v", "full", 1, 10.1, 30.0),
        ("v", "full", 2, 30.1, 50.0),
        ("v", "part", 0, 20.0, 30.0),
    ]


def test_event_at_the_start_leaves_no_empty_screen(spark, rows):
    events = spark.createDataFrame([("v", 0, 0.0, 9.0)], EVENTS)
    runs = spark.createDataFrame([("v", "full", 0.0, 5.0)], RUNS)
    assert rows(screens.screen_periods(events, runs)) == [("v", "full", 0, 0.0, 5.0)]


def test_every_segment_on_exactly_one_screen(spark):
    shown = make_screens(spark, [(0, 10), (10.1, 30), (30.1, 50)])
    said = make_segments(spark, [(1, 3), (8, 12), (12, 20), (29, 31.5), (35, 40), (44, 49)])
    got = {r.seg_no: r.screen for r in dialogue.assign_segments(said, shown).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 2}


def brute_assign(segs, spans):
    out = {}
    for i, (s, e) in enumerate(segs):
        overlaps = [min(e, b) - max(s, a) for a, b in spans]
        top = max(overlaps)
        if top > 0:
            out[i] = overlaps.index(top)
        else:
            gaps = [min(abs(a - s), abs(b - e)) for a, b in spans]
            out[i] = gaps.index(min(gaps))
    return out


def brute_hosts(segs, spans, owner):
    out = {}
    for i, (s, e) in enumerate(segs):
        hit = [k for k, (a, b) in enumerate(spans) if e > a and s < b]
        if len(hit) > 1:
            for k in hit:
                if k != owner[i] and k not in owner.values():
                    out[k] = owner[i]
    return out


def test_random_assignment_and_hosts_match_brute_force(spark, both_ways):
    rng = random.Random(11)
    spans, t = [], 0.0
    for _ in range(120):
        t += rng.choice([0.0, 0.1, 4.0])
        spans.append((round(t, 2), round(t + rng.uniform(0.3, 9), 2)))
        t = spans[-1][1]
    segs = []
    for _ in range(150):
        s = rng.uniform(-5, t + 5)
        segs.append((round(s, 2), round(s + rng.choice([0.0, 0.5, 3.0, 40.0, 200.0]), 2)))
    shown, said = make_screens(spark, spans), make_segments(spark, segs)
    assigned = dialogue.assign_segments(said, shown)
    owner = {r.seg_no: r.screen for r in assigned.collect()}
    assert owner == brute_assign(segs, spans)
    hosts = {r.screen: r.host for r in dialogue.hosts(shown, assigned).collect()}
    assert hosts == brute_hosts(segs, spans, owner)


def test_frame_before_a_cut_stays_on_its_screen(spark):
    shown = make_screens(spark, [(0, 10), (10.1, 30)])
    frames = spark.createDataFrame([("v", "full", 9.97), ("v", "full", 10.1), ("v", "full", -1.0)], "video_id string, run string, t double")
    got = {r.t: r.screen for r in dialogue.frame_to_screen(frames, shown).collect()}
    assert got == {9.97: 0, 10.1: 1, -1.0: 0}


def test_moment_lookups(spark, both_ways):
    said = make_segments(spark, [(0, 5), (4, 6), (10, 12)]).drop("run")
    points = spark.createDataFrame([("v", i, at) for i, at in enumerate([4.5, 7.0, 9.5, 13.0, 5.5])] + [("none", 9, 1.0)], "video_id string, n int, at double")
    got = {r.n: r.seg_no for r in dialogue.segment_at(points, said, "at", ["n"]).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 1, 9: None}
    running = {r.n: r.seg_no for r in dialogue.segment_index_at(points, said, "at").collect()}
    assert running == {0: 1, 1: None, 2: None, 3: None, 4: 1, 9: None}


def test_requests_belong_to_a_screen_even_between_screens(spark):
    frames = spark.createDataFrame(
        [("v", "full", 0, 0.0, 9.9), ("v", "full", 1, 20.0, 40.0), ("v", "full", 2, 30.0, 60.0)],
        "video_id string, run string, frame_no bigint, interval_start double, interval_end double",
    )
    requests = spark.createDataFrame(
        [("v", "full", 1, 42.0, 42.0), ("v", "full", 2, 10.0, 10.0), ("w", "full", 3, 1.0, 1.0)],
        "video_id string, run string, request_no bigint, at double, time double",
    )
    videos = spark.createDataFrame([("v", 60.0), ("w", 33.333)], "video_id string, duration double")
    said = make_segments(spark, [(41, 43)]).drop("run")
    got = {r.request_no: (r.interval_start, r.interval_end, r.said_at) for r in dialogue.request_holder(requests, frames, videos, said).collect()}
    assert got == {1: (30.0, 60.0, "s0"), 2: (0.0, 9.9, "s0"), 3: (0.0, 33.33, "")}


def test_screens_without_pictures_keep_their_dialogue(spark):
    shown = make_screens(spark, [(0, 10), (10.1, 30), (30.1, 50)])
    said = make_segments(spark, [(1, 3), (12, 20), (35, 40)])
    assigned = dialogue.assign_segments(said, shown)
    frames = spark.createDataFrame(
        [("v", "full", 0, 1.0, 0, "frames/a.jpg")],
        "video_id string, run string, screen bigint, t double, frame_no bigint, image string",
    )
    hosts = dialogue.hosts(shown, assigned)
    got = documents.sections(shown, hosts, assigned, frames).orderBy("section").collect()
    assert [(r.section, r.n_images, r.text) for r in got] == [(0, 1, "s0"), (1, 0, "s1"), (2, 0, "s2")]
    titles = spark.createDataFrame([("v", "full", "talk", 50.0)], "video_id string, run string, title string, duration double")
    costs = spark.createDataFrame([("v", "full", 1, 442, 768, "rule")], "video_id string, run string, n_images bigint, tokens bigint, long_edge int, rule string")
    (doc,) = documents.render_context(titles, shown, hosts, assigned, frames, costs).collect()
    assert doc.text.startswith("# talk\n\n3 screens, 1 images, 50 s\n")
    assert "## 0.0-10.0s\n![](read/a.jpg)\ns0\n" in doc.text and f"## 10.1-30.0s\n{documents.NO_IMAGE}\ns1\n" in doc.text


def candidates(spark, events, seed=0.5, changed=None):
    df = spark.createDataFrame([("v", *e) for e in events], "video_id string, event_no bigint, t double, before_t double, after_t double")
    seeds = spark.createDataFrame([("v", seed, 0.0)], "video_id string, seed_t double, seed_from double")
    pairs = screens.screen_end_pairs(df, seeds, F.lit(30.0))
    judged = None if changed is None else spark.createDataFrame([("v", 0, changed)], "video_id string, event_no bigint, changed boolean")
    return [(r.t, r.sources[0]) for r in screens.frame_candidates(pairs, seeds, judged).orderBy("ord").collect()]


def test_screen_end_only_when_the_screen_changed(spark):
    event = [(0, 30.0, 29.9, 30.2)]
    assert candidates(spark, event, changed=True) == [(0.5, "initial"), (29.9, "screen-end"), (30.2, "screen-start")]
    assert candidates(spark, event, changed=False) == [(0.5, "initial"), (30.2, "screen-start")]
    assert candidates(spark, [(0, 0.3, 0.2, 0.4)]) == [(0.5, "initial"), (0.4, "screen-start")]


def test_range_requests(spark):
    asked = spark.createDataFrame([(t, 1000.0) for t in ["120", "300-120", "100-100", "a-b", "1-2-3", "120-300", "900-1000.4", "900-1002"]], "range_text string, duration double")
    got = {r.range_text: (r.error, r.lo, r.hi) for r in screens.validate_range(asked).collect()}
    assert got["120-300"] == (None, 120.0, 300.0) and got["900-1000.4"] == (None, 900.0, 1000.0)
    assert [got[k][0] for k in ("120", "300-120", "100-100", "a-b", "1-2-3", "900-1002")] == ["format", "empty", "empty", "not-a-number", "format", "out-of-range"]


def test_run_names(spark):
    pairs = spark.createDataFrame([(120.0, 300.0), (6.25, 6.75), (None, None)], "lo double, hi double")
    assert [r[0] for r in pairs.select(screens.run_name(F.col("lo"), F.col("hi"))).collect()] == ["00120_0-00300_0", "00006_2-00006_8", "full"]


def test_audit_document_is_whole_json(spark):
    titles = spark.createDataFrame(
        [("v", "full", 'a "talk"', 50.004, 30.0, None, None, "whisper", "small", (0.5,)), ("w", "x", "empty", 1.0, 25.0, 0.25, 1.0, None, None, (0.5,))],
        "video_id string, run string, title string, duration double, fps double, lo double, hi double, backend string, model string, params struct<merge: double>",
    )
    shown = make_screens(spark, [(0, 10), (10.1, 30)])
    said = make_segments(spark, [(1, 3), (12, 20)])
    frames = spark.createDataFrame(
        [("v", "full", 0, 1.005, "a.jpg", ["initial"], 0, "accepted", None), ("v", "full", 1, 11.0, "b.jpg", ["screen-start"], 1, "rejected", "blank"), ("v", "full", 2, 12.0, "c.jpg", ["screen-end"], 1, "accepted", None)],
        "video_id string, run string, ord bigint, t double, image string, sources array<string>, screen bigint, status string, reject_reason string",
    )
    frames = frames.withColumn("yavg", F.col("ord") + 20.0)
    assigned = said.withColumn("screen", F.col("seg_no"))
    costs = spark.createDataFrame([("v", "full", 2, 900, 768)], "video_id string, run string, n_images bigint, tokens bigint, long_edge int")
    asked = spark.createDataFrame([("v", "full", 7, 3.333)], "video_id string, run string, request_no bigint, time double")
    rows = documents.export_metadata(titles, shown, frames, said, assigned, costs, asked, "s@2").collect()
    got = {r.video_id: json.loads(r.text) for r in rows}
    v, w = got["v"], got["w"]
    assert list(v) == list(w) == [
        "schema", "source", "window", "images", "screens", "frames", "rejected", "requested", "transcript", "transcript_file", "params",
    ]
    assert v["source"] == {"file": 'a "talk"', "duration": 50.0, "fps": 30.0} and v["window"] == [0.0, 50.0] and w["window"] == [0.25, 1.0]
    assert v["screens"] == [[0.0, 10.0], [10.1, 30.0]] and v["images"] == {"count": 2, "tokens": 900, "long_edge": 768}
    assert [f["image"] for f in v["frames"]] == ["a.jpg", "c.jpg"] and v["frames"][0]["time"] == round(1.005, 2)
    assert v["frames"][0]["interval"] == [0.0, 10.0] and [s["text"] for s in v["frames"][1]["dialogue"]] == ["s1"]
    assert v["rejected"][0]["reject_reason"] == "blank" and v["requested"] == [{"request_no": 7, "time": 3.33}]
    assert v["transcript"]["text"] == "s0 s1" and [s["text"] for s in v["transcript"]["segments"]] == ["s0", "s1"]
    assert w["transcript"] == {"backend": None, "model": None, "text": "", "segments": []} and w["frames"] == w["screens"] == []
