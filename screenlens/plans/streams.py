"""Registered queries that run the streaming forms to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenlens.operators import detect, dialogue
from screenlens.operators import pixels as px
from screenlens.operators import ranking
from screenlens.operators import subtitles as sub
from screenlens.plans import pixels as P
from screenlens.plans import subtitles as S
from screenlens.plans.detection import EVENTS, EVENTS_WITH_HITS, SIG
from screenlens.plans.dialogue import SEGMENTS
from screenlens.plans.marks import TOGGLED, _presses
from screenlens.session import scratch_path
from screenlens.sources import writers
from screenlens.streaming import streams

SLICES = [240.0, 480.0]


def _stream_of(c, df, label):
    """The table as a file stream."""
    path = scratch_path(c.spark, label)
    df.write.parquet(path)
    return c.spark.readStream.schema(df.schema).parquet(path)


def _finished(c, stream, label):
    out, state = scratch_path(c.spark, label), scratch_path(c.spark, label + "-state")
    streams.run_to_table(stream, out, state)
    return c.spark.read.schema(stream.schema).parquet(out)


def _arriving(c, df, time, operator, label):
    """Rows arrive in three slices of ``time``; after each the stream resumes from its checkpoint
    and runs until nothing is left. A batch holds one slice of a video, never all of it."""
    source, out, state = (scratch_path(c.spark, label + end) for end in ("-in", "-out", "-state"))
    edges = [float("-inf"), *SLICES, float("inf")]
    for low, high in zip(edges, edges[1:]):
        df.filter((time >= low) & (time < high)).write.mode("append").parquet(source)
        result = operator(c.spark.readStream.schema(df.schema).parquet(source))
        streams.run_to_table(result, out, state)
    return c.spark.read.schema(result.schema).parquet(out)


def _late(df, number, time, late):
    """Every other row arrives ``late`` after its ``time``, and last of all a row that ends each video."""
    ends = df.select("video_id").distinct().withColumn("arrives", F.lit(1e9))
    arrives = time + F.when(F.col(number) % 2 == 0, late).otherwise(0.0)
    return df.withColumn("arrives", arrives).unionByName(ends, allowMissingColumns=True)


def stream_signals(c):
    """Every other frame arrives three frames late."""
    frames = P._frames(c)
    body = px.crop_rows(frames, px.overlay_body_band(px.row_change_frequency(frames, P.ROW_DELTA)))

    def measure(stream):
        return streams.stream_signals(stream, P.ANCHOR, P.CUT, P.SETTLE, lateness=0.25)

    late = _late(body, "frame_no", F.col("frame_no") * 20, 60.0)
    done = _arriving(c, late, F.col("arrives"), measure, "frames")
    return done.select(
        "video_id", F.col("idx").alias("frame_no"), F.round("anchor", 8).alias("anchor"), "is_anchor_reset"
    )


def stream_events(c):
    """Samples arrive up to 24 hours late: the slices are cut by a time that every other sample is moved in. The last
    slice ends all videos."""

    def detect(stream):
        return streams.stream_events(stream, merge_window=12.0, settle_limit=24.0, lateness=24.0)

    signals = c.signals.select("video_id", "idx", "t", "anchor", "rate", "area")
    return _arriving(c, _late(signals, "idx", F.col("t"), 20.0), F.col("arrives"), detect, "signals")


def stream_events_with_hits(c):
    """As ``stream_events``, with the hits of another detector as a second stream, 20 hours late."""
    signals = _late(c.signals.select("video_id", "idx", "t", "anchor", "rate", "area"), "idx", F.col("t"), 20.0)
    hits = detect.neighbour_ratio_cut(c.signals).select("video_id", "t", (F.col("t") + 20.0).alias("arrives"))
    sources = {name: scratch_path(c.spark, f"hits-{name}") for name in ("signals", "hits")}
    out, state = scratch_path(c.spark, "hits-out"), scratch_path(c.spark, "hits-state")
    edges = [float("-inf"), *SLICES, float("inf")]
    for low, high in zip(edges, edges[1:]):
        read = {}
        for name, rows in (("signals", signals), ("hits", hits)):
            now = rows.filter((F.col("arrives") >= low) & (F.col("arrives") < high))
            now.write.mode("append").parquet(sources[name])
            read[name] = c.spark.readStream.schema(rows.schema).parquet(sources[name])
        found = streams.stream_events(
            read["signals"], merge_window=12.0, settle_limit=24.0, lateness=24.0, extra_hits=read["hits"].drop("arrives")
        )
        streams.run_to_table(found, out, state)
    return c.spark.read.schema(streams.EVENT_ROW).parquet(out)


def stream_flags(c):
    """Every other press arrives 20 hours late."""

    def replay(stream):
        return streams.stream_flags(stream, 24.0, lateness=24.0)

    changes = _arriving(c, _late(_presses(c), "press_no", F.col("t"), 20.0), F.col("arrives"), replay, "presses")
    return changes.groupBy("video_id", "t").agg(F.sum("change").alias("n")).where("n > 0").select("video_id", "t")


def stream_signal_windows(c):
    timed = c.signals.withColumn("ts", streams.event_time(F.col("t")))
    windows = streams.stream_signal_windows(_stream_of(c, timed, "timed-in"), "60 seconds")
    done = _finished(c, windows, "windows-out")
    return done.select(
        "video_id",
        F.unix_seconds("window_start").alias("window_start"),
        "max_area",
        F.round("mean_rate", 8).alias("mean_rate"),
        F.round("quiet_share", 6).alias("quiet_share"),
        "n_samples",
    )


def _judge(batch):
    """Verdicts of subtitle files (video_id, path, text, duration); a path may stand in any number of videos."""
    named = batch.withColumn("file_id", F.concat("video_id", F.lit("/"), "path"))
    cues = sub.parse_timed_blocks(named.select("file_id", "text"), "basic")
    judged = sub.subtitle_quality(cues, named.select("file_id", "duration"))
    return judged.join(named.select("file_id", "video_id", "path"), "file_id").drop("file_id")


def _subtitle_files(c):
    return S._srt_files(c).join(c.videos.select(F.col("video_id").alias("file_id"), "duration"), "file_id")


def _track(k):
    return F.concat(F.lit("subs/track"), k.cast("string"), F.lit(".srt"))


def _three_each(c):
    """A row for each video and track."""
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return c.videos.select("video_id", "has_audio", k.alias("k"))


def _track_candidates(c):
    """Three candidates of the same three paths for each video, in three languages."""
    return _three_each(c).select(
        "video_id",
        F.lit("sidecar").alias("kind"),
        _track(F.col("k")).alias("path"),
        F.col("k").cast("string").alias("name"),
        F.lit("srt").alias("format"),
        F.when(F.col("k") == 0, "de").when(F.col("k") == 2, "fr").alias("language"),
        _track(F.col("k")).alias("label"),
        F.lit(False).alias("forced"),
        F.lit(False).alias("is_default"),
        F.lit(None).cast("int").alias("track"),
    )


def _chooser(c):
    def choose(again, verdicts):
        videos = c.videos.join(again.select("video_id").distinct(), "video_id", "left_semi")
        return ranking.choose_subtitle(ranking.rank_subtitles(again, "de"), verdicts, videos)

    return choose


def stream_subtitle_intake(c):
    """Files of three names only, so that many videos share a path. Each video has all three as candidates, of which one
    arrives: its verdict, and what the video's ranking takes then."""
    path = _track(F.col("file_id").cast("long") % 3)
    files = _subtitle_files(c).select(F.col("file_id").alias("video_id"), path.alias("path"), "text", "duration")
    arriving = _stream_of(c, files, "subtitles-in")
    out, state, chosen = (scratch_path(c.spark, f"verdicts{x}") for x in ("", "-state", "-chosen"))
    streams.subtitle_intake(arriving, out, state, _judge, _track_candidates(c), _chooser(c), chosen).awaitTermination()
    taken = writers.read_table(c.spark, chosen).select("video_id", "kind", "n_candidates", "n_rejected")
    verdicts = writers.read_table(c.spark, out).join(taken, "video_id")
    return verdicts.select(
        "video_id", "path", "ok", "reason", "n_cues", F.round("coverage", 6).alias("coverage"), "kind", "n_candidates", "n_rejected"
    )


def stream_subtitle_choice(c):
    """Each video has three candidates of the same three paths, with the text of its own file and of the next two, in three
    languages. Files arrive in three slices; after each the videos it touches are ranked again."""
    each, path = _three_each(c), _track(F.col("k"))
    source, out, state, chosen = (scratch_path(c.spark, f"choice-{x}") for x in ("in", "out", "state", "chosen"))
    text_of = each.withColumn("file_id", (F.col("video_id").cast("long") + F.col("k")).cast("string"))
    files = text_of.join(_subtitle_files(c), "file_id").select("video_id", path.alias("path"), "text", "duration", "file_id")
    for n in range(3):
        files.where(F.col("file_id").cast("long") % 3 == n).drop("file_id").write.mode("append").parquet(source)
        arriving = c.spark.readStream.schema(files.drop("file_id").schema).parquet(source)
        streams.subtitle_intake(arriving, out, state, _judge, _track_candidates(c), _chooser(c), chosen).awaitTermination()
    return writers.read_table(c.spark, chosen).select("video_id", "kind", "path", "n_candidates", "n_rejected")


def refresh_documents(c):
    """Transcripts of all videos, then sightings of all of them again with two sources grown: only their documents are made
    anew. The text names the size it was made from, ``generation`` the delivery."""
    sizes = c.videos.select("video_id", F.col("title").alias("path"), (F.col("duration") * 100).cast("long").alias("size"))
    grown = F.when(F.col("video_id").isin("1", "2"), F.col("size") + 1).otherwise(F.col("size"))
    source, recorded, out, state = (scratch_path(c.spark, f"refresh-{x}") for x in ("in", "recorded", "out", "state"))

    def render(generation):
        def documents(videos):
            said = dialogue.transcript_text(c.segments.join(videos.select("video_id"), "video_id", "left_semi"))
            text = F.concat(F.lit("v"), F.col("size").cast("string"), F.lit(": "), "text")
            return said.join(videos, "video_id").select(
                "video_id", F.lit("full").alias("run"), F.lit(generation).alias("generation"), text.alias("text")
            )

        return documents

    for number, seen in ((1, sizes), (2, sizes.withColumn("size", grown))):
        seen.withColumn("seen_no", F.lit(number)).write.mode("append").parquet(source)
        arriving = c.spark.readStream.schema("video_id string, path string, size long, seen_no int").parquet(source)
        streams.refresh_outputs(arriving, recorded, out, state, render(number)).awaitTermination()
    return writers.read_table(c.spark, out).select("video_id", "run", "generation", "text")


def refresh_on_change(c):
    parts = c.table("part").select(
        F.col("p_partkey").cast("string").alias("video_id"), F.col("p_name").alias("path"),
        F.col("p_size").alias("size"), "p_retailprice",
    )
    recorded = parts.filter("size > 5")
    grown = F.when(F.col("p_retailprice") > 1000, F.col("size") + 1).otherwise(F.col("size"))
    now = parts.withColumn("size", grown)
    runs = c.table("lineitem").select(
        F.col("l_partkey").cast("string").alias("video_id"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("run")
    ).distinct()
    sightings = _stream_of(c, now.drop("p_retailprice"), "inventory-in")
    return _finished(c, streams.refresh_on_change(sightings, recorded, runs), "refresh-out")


QUERIES = {
    f.__name__: f
    for f in (
        stream_signals, stream_events, stream_events_with_hits, stream_flags, stream_signal_windows, stream_subtitle_intake,
        stream_subtitle_choice, refresh_on_change, refresh_documents,
    )
}

INTAKE = f"""{SEGMENTS},
cu AS (SELECT video_id AS file_id, seg_no AS cue_no, start, "end", text FROM seg),
{S.MEASURED},{S.VERDICTS}"""

ORACLE = {
    "stream_signals": P.ORACLE["anchor_diff"],
    "stream_events": f"""WITH RECURSIVE {EVENTS}
SELECT e.video_id, event_no, e.idx, e.t, array_to_string(e.signals, '+') AS signals, before_idx, before_t, after_idx, after_t FROM ev e""",
    "stream_events_with_hits": f"""WITH RECURSIVE {EVENTS_WITH_HITS}
SELECT e.video_id, event_no, e.idx, e.t, array_to_string(e.signals, '+') AS signals, before_idx, before_t, after_idx, after_t FROM ev e""",
    "stream_flags": f"{TOGGLED}SELECT video_id, k.t AS t FROM un",
    "stream_signal_windows": f"""WITH {SIG}, w AS (SELECT *, floor(t / 60)::BIGINT * 60 AS window_start FROM sig)
SELECT video_id, window_start, max(area) AS max_area, round(avg(rate), 8) AS mean_rate, round(avg((rate <= 0.0015::DOUBLE)::INT), 6) AS quiet_share, count(*) AS n_samples
FROM w WHERE window_start + 60 <= (SELECT max(t) FROM sig) - 10 GROUP BY 1, 2""",
    "stream_subtitle_intake": f"""WITH {INTAKE}
SELECT file_id AS video_id, 'subs/track' || (file_id::INT % 3) || '.srt' AS path, reason IS NULL AS ok, reason, n_cues, round(coverage, 6) AS coverage,
       CASE WHEN reason IS NULL THEN 'sidecar' WHEN has_audio THEN 'whisper' ELSE 'none' END AS kind,
       3 AS n_candidates, CASE WHEN reason IS NULL THEN file_id::INT % 3 ELSE 3 END AS n_rejected
FROM r JOIN vid v ON v.video_id = r.file_id""",
    "stream_subtitle_choice": f"""WITH {INTAKE},
ca AS (SELECT video_id, (video_id::INT + k)::VARCHAR AS file_id, k AS rank FROM vid, (SELECT unnest([0, 1, 2]) AS k)),
ok AS (SELECT ca.* FROM ca JOIN r USING (file_id) WHERE reason IS NULL),
best AS (SELECT video_id, min(rank) AS rank FROM ok GROUP BY 1)
SELECT v.video_id, CASE WHEN b.rank IS NOT NULL THEN 'sidecar' WHEN has_audio THEN 'whisper' ELSE 'none' END AS kind,
       'subs/track' || b.rank || '.srt' AS path, 3 AS n_candidates, coalesce(b.rank, 3) AS n_rejected
FROM vid v LEFT JOIN best b USING (video_id)""",
    "refresh_documents": f"""WITH {SEGMENTS}, said AS (SELECT video_id, string_agg(text, ' ' ORDER BY seg_no) AS text FROM seg GROUP BY 1)
SELECT v.video_id, 'full' AS run, CASE WHEN v.video_id IN ('1', '2') THEN 2 ELSE 1 END AS generation,
       'v' || ((v.duration * 100)::BIGINT + CASE WHEN v.video_id IN ('1', '2') THEN 1 ELSE 0 END) || ': ' || s.text AS text
FROM vid v JOIN said s USING (video_id)""",
    "refresh_on_change": """SELECT DISTINCT l_partkey::VARCHAR AS video_id, 'r' || l_linenumber AS run FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_size <= 5 OR p_retailprice > 1000""",
}
