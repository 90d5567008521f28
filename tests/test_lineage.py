import hashlib

import pytest
from pyspark.sql import functions as F

from screenlens import params as P
from screenlens.functions import text as T
from screenlens.operators import lineage, lookups, screens, truth


def review_of(body, sha):
    header = f'{{"schema":"{P.REVIEW_SCHEMA}","run":"full","context":"c","context_sha256":"{sha}","at":"x","version":"1"}}'
    return f"{P.REVIEW_BEGIN}\n<!-- {header} -->\n# full\n{P.REVIEW_END}\n{body}"


@pytest.mark.parametrize(
    "previous, body, now, force, want",
    [
        (None, "a", "s1", False, "create"),
        ("no header", "a", "s1", False, "create"),
        (review_of("a\n", "s1"), "\n\na  ", "s1", False, "unchanged"),
        (review_of("a\n", "s1"), "a", "s2", False, "refresh"),
        (review_of("a\n", "s1"), "b", "s2", False, "update"),
        (review_of("a\n", "s1"), "b", "s1", False, "conflict"),
        (review_of("a\n", "s1"), "b", "s1", True, "update"),
        (review_of("a\n", "s1").replace('"at"', '"at'), "a", "s1", False, "create"),
        (review_of("a\n", "s1").replace("review@1", "review@9"), "a", "s1", False, "create"),
    ],
)
def test_review_decisions(spark, previous, body, now, force, want):
    df = spark.createDataFrame([(previous, body, now, force)], "p string, b string, n string, f boolean")
    assert df.select(lineage.review_decide(F.col("p"), F.col("b"), F.col("n"), F.col("f"))).first()[0] == want


def test_review_states(spark):
    runs = spark.createDataFrame([("v", r) for r in "abcde"], "video_id string, run string")
    reviews = spark.createDataFrame(
        [("v", "b", "lost"), ("v", "c", review_of("x", "old")), ("v", "d", review_of("x", "now")), ("v", "e", review_of("x", "now"))],
        "video_id string, run string, review string",
    )
    contexts = spark.createDataFrame([("v", r, "now") for r in "abcd"], "video_id string, run string, context_sha256 string")
    got = {r.run: r.state for r in lineage.review_status(runs, reviews, contexts).collect()}
    assert got == {"a": "missing", "b": "unreadable", "c": "stale", "d": "current", "e": "stale"}


def test_review_text_keeps_its_indent(spark):
    df = spark.createDataFrame([("﻿\r\n\r\n    code\r\ntext \t\r\n\r\n",)], "s string")
    assert df.select(T.normalize_review(F.col("s"))).first()[0] == "    code\ntext\n"
    composed = T.compose_review(F.col("s"), F.lit("full"), F.lit("c"), F.lit("sha"), F.lit("now"), F.lit("1"))
    again = df.select(composed.alias("r")).select(T.review_header(F.col("r")).alias("h"), T.review_body(F.col("r")).alias("b")).first()
    assert again.h.context_sha256 == "sha" and again.b == "    code\ntext\n"


def test_context_hash(spark):
    docs = spark.createDataFrame([("v", "full", "abc"), ("w", "full", "ab" * 5_000_000)], "video_id string, run string, text string")
    got = {r.video_id: r.context_sha256 for r in lineage.context_fingerprint(docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {"v": sha("abc"), "w": sha("ab" * 5_000_000)}


def test_run_index(spark):
    schema = "video_id string, run string, lo double, hi double, n int"
    old = spark.createDataFrame([("v", "full", None, None, 1), ("v", "late", 50.0, 60.0, 1), ("v", "gone", 1.0, 2.0, 1)], schema)
    new = spark.createDataFrame([("v", "early", 5.0, 9.0, 2), ("v", "late", 50.0, 60.0, 2)], schema)
    live = spark.createDataFrame([("v", r) for r in ("full", "late", "early")], "video_id string, run string")
    got = [(r.run, r.n) for r in screens.merge_run_index(old, new, live).orderBy("position").collect()]
    assert got == [("full", 1), ("early", 2), ("late", 2)]


def test_transcript_rewrite_reopens_frames(spark):
    stages = spark.createDataFrame(
        [("a", "split", True, 1), ("a", "transcribe", True, 5), ("a", "frames", True, 3), ("b", "split", True, 1), ("c", "split", True, 1), ("c", "transcribe", True, 2), ("c", "frames", True, 3)],
        "video_id string, stage string, done boolean, at int",
    )
    videos = spark.createDataFrame([(v,) for v in "abcd"], "video_id string")
    got = {r.video_id: r.due for r in lineage.stale_stages(stages, videos).collect()}
    assert got == {"a": "frames", "b": "transcribe", "c": None, "d": "split"}


def flags(spark, *times):
    return spark.createDataFrame([("v", i, float(t)) for i, t in enumerate(times)], "video_id string, press_no bigint, t double")


def test_scores(spark):
    videos = spark.createDataFrame([("v",)], "video_id string")
    got = truth.compare_metrics(videos, flags(spark, 10, 50, 90), flags(spark, 10.5, 51, 200), 2.0).first()
    assert (got.recall, got.precision, got.n_missed, got.n_extra) == (0.667, 0.667, 1, 1)
    missed = truth.flag_match(flags(spark, 10, 50, 90), flags(spark, 10.5, 51, 200), 2.0).filter("detected_t IS NULL")
    assert [r.t for r in missed.collect()] == [90.0]


def test_nothing_to_judge_by(spark):
    videos = spark.createDataFrame([("v",)], "video_id string")
    no_flags = truth.compare_metrics(videos, flags(spark), flags(spark, 1), 2.0).first()
    no_hits = truth.compare_metrics(videos, flags(spark, 1), flags(spark), 2.0).first()
    assert (no_flags.recall, no_flags.precision) == (None, None)
    assert (no_hits.recall, no_hits.precision) == (0.0, None)


def brute_dedupe(times, within):
    kept = []
    for t in times:
        t = round(t, 2)
        if all(abs(k - t) > within for k in kept):
            kept.append(t)
    return sorted(kept)


@pytest.mark.parametrize("n", [120, 10_000])
def test_dedupe_in_press_order(spark, n):
    import random

    rng = random.Random(2)
    times = [rng.choice([5.0, 20.0]) + rng.uniform(0, n / 30) for _ in range(n // 2)] + [i * 0.05 for i in range(n // 2)]
    presses = flags(spark, *times).withColumn("note", F.lit("n"))
    got = sorted(r.t for r in truth.flag_dedupe(presses, 0.25).collect())
    assert got == brute_dedupe(times, 0.25)


@pytest.mark.parametrize(("within", "dedupe"), [(0.6, 0.25), (0.1, 0.25), (0.3, 0.3)])
def test_toggle_replay_against_brute_force(spark, within, dedupe):
    import random

    rng = random.Random(5)
    times = [1.0, 1.2, *[rng.uniform(2, 60) for _ in range(300)]]
    kept = []
    for t in times:
        nearest = min(sorted(kept), key=lambda f: abs(f - t), default=None)
        if nearest is not None and abs(nearest - t) <= within:
            kept.remove(nearest)
        elif all(abs(f - round(t, 2)) > dedupe for f in kept):
            kept.append(round(t, 2))
    presses = flags(spark, *times).withColumn("note", F.lit("n"))
    assert sorted(r.t for r in truth.flag_toggle_replay(presses, within, dedupe).collect()) == sorted(kept)


def test_toggle_replay(spark):
    presses = flags(spark, 10.0, 10.4, 10.8, 30.004, 50.0).withColumn("note", F.lit("n"))
    got = sorted(r.t for r in truth.flag_toggle_replay(presses).collect())
    assert got == [10.8, 30.0, 50.0]


def test_marks(spark):
    a = spark.createDataFrame([("v", 1.0), ("v", 5.0)], "video_id string, t double")
    b = spark.createDataFrame([("v", 1.03), ("v", 7.0)], "video_id string, t double")
    both = lookups.marks(frame=a, flag=b, segment=a)
    points = spark.createDataFrame([("v", 1.0), ("v", 6.0), ("v", 9.0)], "video_id string, at double")
    ahead = {r.at: (r.mark_t, r.mark_kind) for r in lookups.jump_mark(points, both, "at").collect()}
    back = {r.at: r.mark_t for r in lookups.jump_mark(points, both, "at", forward=False).collect()}
    assert ahead == {1.0: (5.0, "frame"), 6.0: (7.0, "flag"), 9.0: (None, None)}
    assert back == {1.0: None, 6.0: 5.0, 9.0: 7.0}
    totals = {(r.video_id, r.kind): r.n_marks for r in lookups.mark_counts(both).collect()}
    assert totals[("v", "frame")] == 2 and totals[(None, None)] == 6


def test_requests_are_idempotent(spark):
    schema = "video_id string, run string, at double, reason string, request_no bigint"
    ledger = spark.createDataFrame([("v", "full", 1.0, "why", 1)], schema)
    asked = spark.createDataFrame([("v", "full", 1.0, "why", 2), ("v", "full", 1.0, "else", 3), ("v", "full", 1.0, "else", 4)], schema)
    got = sorted((r.reason, r.request_no, r.is_new) for r in lineage.request_ledger_upsert(ledger, asked).collect())
    assert got == [("else", 3, True), ("why", 1, False)]
