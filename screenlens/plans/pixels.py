"""Registered queries over pixel grids: embeddings as 8x8 gray frames, one video per label."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenlens.operators import analysis, budget, documents, pixels
from screenlens.operators.dialogue import assign_segments, hosts, segments_in
from screenlens.operators.ordered import number_rows
from screenlens.plans.dialogue import CANDIDATES, CHANGES
from screenlens.session import materialize, scratch_path
from screenlens.sources import readers, writers

ROW_DELTA = 120.0
ANCHOR, CUT, SETTLE = 0.115, 0.5, 0.105


def _frames(c):
    """The last pixel row moves several times as much as the others, like a caption line."""
    numbered = number_rows(c.table("embeddings"), ["label"], ["vec_id"], "frame_no")

    def value(x, i):
        return (F.when(i >= 56, 900.0).otherwise(200.0) * x.cast("double") + 128.0).cast("float")

    frames = numbered.select(
        F.col("label").cast("string").alias("video_id"),
        "frame_no",
        F.when(F.col("frame_no") % 10 != 9, F.col("frame_no") / 15.0).alias("t"),
        F.lit(8).alias("h"),
        F.lit(8).alias("w"),
        F.transform("embedding", value).alias("gray"),
    )
    return materialize(frames, "frames")


def _videos(frames):
    last = frames.groupBy("video_id").agg(F.max("frame_no").alias("_n"))
    return last.select("video_id", F.lit(15.0).alias("fps"), ((F.col("_n") + 1) / 15.0).alias("duration"))


def _body(c):
    frames = _frames(c)
    bands = pixels.overlay_body_band(pixels.row_change_frequency(frames, ROW_DELTA))
    return pixels.crop_rows(frames, bands)


def frame_time(c):
    frames = _frames(c)
    timed = pixels.frame_time(frames, _videos(frames))
    return timed.select("video_id", "frame_no", F.round("t", 6).alias("t"))


def row_change_frequency(c):
    return pixels.row_change_frequency(_frames(c), ROW_DELTA)


def overlay_body_band(c):
    return pixels.overlay_body_band(pixels.row_change_frequency(_frames(c), ROW_DELTA))


def crop_rows(c):
    body = _body(c)
    return body.select(
        "video_id", "frame_no", F.col("h").cast("long").alias("h"), F.size("gray").cast("long").alias("n"),
        F.round(pixels.mean_luma(F.col("gray")), 4).alias("luma"),
    )


def inst_diff(c):
    return pixels.frame_change(_body(c)).select("video_id", "frame_no", F.round("rate", 8).alias("rate"))


def cut_area(c):
    return pixels.frame_change(_body(c)).select("video_id", "frame_no", F.round("area", 8).alias("area"))


def _measured(c):
    body = _body(c)
    change = materialize(pixels.frame_change(body), "change")
    return pixels.anchor_diff(body, change, ANCHOR, CUT, SETTLE)


def anchor_diff(c):
    return _measured(c).withColumn("anchor", F.round("anchor", 8))


def content_area(c):
    return _frames(c).select(
        "video_id", "frame_no", F.round(pixels.content_area(F.col("gray")), 8).alias("content_area")
    )


def mean_luma(c):
    luma = pixels.mean_luma(F.col("gray"))
    return _frames(c).select(
        "video_id", "frame_no", F.round(luma, 4).alias("luma"),
        pixels.dark_warning(luma - 120.0).alias("warning"),
    )


def _pairs(frames):
    return frames.select(
        "video_id", "frame_no", (F.col("frame_no") / 15.0).alias("a"),
        ((F.col("frame_no") + F.col("frame_no") % 3) / 15.0).alias("b"),
    ).withColumnRenamed("frame_no", "pair_no")


def pair_changed(c):
    frames = _frames(c)
    rows = pixels.pair_changed(_pairs(frames), frames, "a", "b")
    return rows.withColumn("similarity", F.round("similarity", 6))


def stable_capture_time(c):
    frames = _frames(c)
    rows = pixels.stable_capture_time(_pairs(frames).drop("b"), frames, _videos(frames), "a", offset=0.5)
    return rows.withColumns({"similarity": F.round("similarity", 6), "stable_t": F.round("stable_t", 6)})


def _sizes(c):
    key = F.col("l_partkey")
    return c.table("lineitem").select(
        "l_orderkey", "l_linenumber", (key * 7 % 2500 + 1).alias("w"), (key * 11 % 1900 + 1).alias("h")
    )


def reduced_size(c):
    return _sizes(c).select(
        "l_orderkey", "l_linenumber", "w", "h", budget.reduced_size(F.col("w"), F.col("h")).alias("_s")
    ).select("l_orderkey", "l_linenumber", "w", "h", F.col("_s.w").alias("read_w"), F.col("_s.h").alias("read_h"))


def image_tokens(c):
    return _sizes(c).select(
        "l_orderkey", "l_linenumber", "w", "h", budget.image_tokens(F.col("w"), F.col("h")).alias("tokens")
    )


def read_path(c):
    return c.candidates.select("video_id", "run", "seq", budget.read_path(F.col("image")).alias("read_path"))


def _analysed(c):
    frames = _frames(c)
    frames = pixels.frame_time(frames, _videos(frames))
    videos = _videos(frames).withColumn("title", F.concat(F.lit("frames "), "video_id"))
    runs = videos.select("video_id", "title", "duration", F.lit("full").alias("run"), F.lit(0.0).alias("lo"), F.col("duration").alias("hi"))
    bands = pixels.overlay_body_band(pixels.row_change_frequency(frames, ROW_DELTA))
    return frames, videos, runs, analysis.analyse(frames, runs, videos, bands, ANCHOR, SETTLE / 8, CUT)


def frames_document(c):
    """Documents of the frames' videos, the text of the conversations of the same numbers spoken over them."""
    _, _, runs, found = _analysed(c)
    said = assign_segments(segments_in(c.segments, runs), found.screens)
    accepted = found.candidates.filter("status = 'accepted'")
    hosted = hosts(found.screens, said)
    size = accepted.select("video_id", "run", "frame_no", "screen", F.lit(768).alias("w"), F.lit(432).alias("h"))
    return documents.render_context(runs, found.screens, hosted, said, accepted, budget.read_budget(size))


def answer_requests(c):
    """A picture asked for at every fifth frame, some before the start; of every tenth frame the ledger has one already."""
    frames, videos, runs, found = _analysed(c)
    at = F.col("frame_no") / 15.0 - F.when(F.col("frame_no") % 25 == 0, 1.0).otherwise(0.0)
    asked = frames.filter("frame_no % 5 = 0").select("video_id", F.lit("full").alias("run"), at.alias("at"), F.lit("look").alias("reason"))
    ledger = frames.filter("frame_no % 10 = 0").select(
        "video_id", F.lit("full").alias("run"), at.alias("at"), F.lit("look").alias("reason"), at.alias("time")
    )
    return analysis.answer_requests(asked, ledger, frames, videos, runs, found, c.segments)


def read_frame_images(c):
    """The frames written as pictures and read back; values are whole numbers then."""
    path = scratch_path(c.spark, "pictures")
    named = _frames(c).withColumns(
        {
            "run": F.lit("full"),
            "image": F.format_string("scene_%03d_t%07.2f.bmp", "frame_no", F.col("frame_no") / 15.0),
        }
    )
    writers.write_frame_images(named, path)
    back = readers.read_frame_images(c.spark, path, 8, 8)
    return back.select(
        "video_id", "run", "frame_no", "t", F.size("gray").cast("long").alias("n"),
        F.round(pixels.mean_luma(F.col("gray")), 4).alias("luma"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        frame_time, row_change_frequency, overlay_body_band, crop_rows, inst_diff, cut_area, anchor_diff,
        content_area, mean_luma, pair_changed, stable_capture_time, reduced_size, image_tokens, read_path,
        read_frame_images, frames_document, answer_requests,
    )
}

FRAMES = """
fr AS (SELECT label::VARCHAR AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no,
              list_transform(embedding, lambda x, i: ((CASE WHEN i > 56 THEN 900.0::DOUBLE ELSE 200.0::DOUBLE END) * x::DOUBLE + 128.0::DOUBLE)::FLOAT) AS gray
       FROM embeddings)"""
ROWS = FRAMES + """,
px AS (SELECT video_id, frame_no, unnest(gray)::DOUBLE AS v, unnest(range(64)) AS i FROM fr),
dp AS (SELECT a.video_id, a.frame_no, a.i // 8 AS r, avg((abs(a.v - b.v) > 120)::INT) AS share
       FROM px a JOIN px b ON b.video_id = a.video_id AND b.frame_no = a.frame_no - 1 AND b.i = a.i GROUP BY 1, 2, 3),
rf AS (SELECT video_id, r AS row, avg((share > 0.02)::INT) AS freq FROM dp GROUP BY 1, 2)"""
BAND = ROWS + """,
hm AS (SELECT *, freq > greatest(4 * median(freq) OVER (PARTITION BY video_id), 0.005) AS hot FROM rf),
eg AS (SELECT video_id, coalesce(min(row) FILTER (NOT hot), 8) AS top, coalesce(max(row) FILTER (NOT hot) + 1, 8) AS bottom FROM hm GROUP BY 1),
kp AS (SELECT video_id, CASE WHEN top > 1.6 THEN 0 ELSE top END AS top, CASE WHEN 8 - bottom > 1.6 THEN 8 ELSE bottom END AS bottom FROM eg),
bd AS (SELECT video_id, CASE WHEN top >= bottom THEN 0 ELSE top END AS top, CASE WHEN top >= bottom THEN 8 ELSE bottom END AS bottom FROM kp),
bo AS (SELECT f.video_id, frame_no, bottom - top AS h, gray[top * 8 + 1 : bottom * 8] AS gray FROM fr f JOIN bd USING (video_id))"""
CHANGE = BAND + """,
ch AS (SELECT a.video_id, a.frame_no, a.gray,
         coalesce(list_sum(list_transform(list_zip(a.gray, b.gray), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / len(a.gray) / 255, 0) AS rate,
         coalesce(len(list_filter(list_zip(a.gray, b.gray), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE) > 25)) / len(a.gray)::DOUBLE, 0) AS area
       FROM bo a LEFT JOIN bo b ON b.video_id = a.video_id AND b.frame_no = a.frame_no - 1)"""
#: Similarity (lk.similarity) of the frames shown at two moments x and y of pairs (pr): the mean over the four 7x7 windows
#: of an 8x8 frame.
SIMILAR = """,
ft AS (SELECT video_id, frame_no, frame_no / 15.0::DOUBLE AS t FROM fr WHERE frame_no % 10 <> 9),
lf AS (SELECT video_id, max(frame_no) AS n FROM ft GROUP BY 1),
la AS (SELECT p.*, f.frame_no AS fa FROM pr p ASOF LEFT JOIN ft f ON f.video_id = p.video_id AND p.x - 0.001::DOUBLE <= f.t),
lb AS (SELECT p.*, f.frame_no AS fb FROM la p ASOF LEFT JOIN ft f ON f.video_id = p.video_id AND p.y - 0.001::DOUBLE <= f.t),
wd AS (SELECT k.video_id, k.pair_no, w, list_transform(range(49), lambda i: ga.gray[(w // 2 + i // 7) * 8 + w % 2 + i % 7 + 1]::DOUBLE) AS va,
              list_transform(range(49), lambda i: gb.gray[(w // 2 + i // 7) * 8 + w % 2 + i % 7 + 1]::DOUBLE) AS vb
       FROM lb k JOIN lf USING (video_id), fr ga, fr gb, (SELECT unnest(range(4)) AS w)
       WHERE ga.video_id = k.video_id AND ga.frame_no = coalesce(k.fa, lf.n) AND gb.video_id = k.video_id AND gb.frame_no = coalesce(k.fb, lf.n)),
mo AS (SELECT video_id, pair_no, list_avg(va) AS ma, list_avg(vb) AS mb, list_avg(list_transform(va, lambda v: v * v)) AS aa,
              list_avg(list_transform(vb, lambda v: v * v)) AS bb, list_avg(list_transform(list_zip(va, vb), lambda z: z[1] * z[2])) AS ab FROM wd),
sm AS (SELECT video_id, pair_no, avg((2 * ma * mb + 6.5025::DOUBLE) * (2 * 49 / 48.0::DOUBLE * (ab - ma * mb) + 58.5225::DOUBLE)
              / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (49 / 48.0::DOUBLE * (aa - ma * ma + bb - mb * mb) + 58.5225::DOUBLE))) AS similarity
       FROM mo GROUP BY 1, 2)"""
FIT = "CASE WHEN greatest(w, h) > {m} THEN round_even({s} * ({m}::DOUBLE / greatest(w, h)), 0)::BIGINT ELSE {s} END"
SIZES = "s AS (SELECT l_orderkey, l_linenumber, l_partkey * 7 % 2500 + 1 AS w, l_partkey * 11 % 1900 + 1 AS h FROM lineitem)"

ORACLE = {
    "frame_time": f"WITH {FRAMES} SELECT video_id, frame_no, round(frame_no / 15.0::DOUBLE, 6) AS t FROM fr",
    "row_change_frequency": f"WITH {ROWS} SELECT * FROM rf",
    "overlay_body_band": f"WITH {BAND} SELECT video_id, top / 8.0::DOUBLE AS lo, bottom / 8.0::DOUBLE AS hi FROM bd",
    "crop_rows": f"WITH {BAND} SELECT video_id, frame_no, h, len(gray) AS n, round(list_sum(list_transform(gray, lambda x: x::DOUBLE)) / len(gray), 4) AS luma FROM bo",
    "inst_diff": f"WITH {CHANGE} SELECT video_id, frame_no, round(rate, 8) AS rate FROM ch",
    "cut_area": f"WITH {CHANGE} SELECT video_id, frame_no, round(area, 8) AS area FROM ch",
    "anchor_diff": f"""WITH RECURSIVE {CHANGE},
fold AS (SELECT video_id, frame_no, gray AS anchor, false AS unsettled, 0.0::DOUBLE AS d, false AS reset FROM ch WHERE frame_no = 0
  UNION ALL
  SELECT video_id, frame_no, CASE WHEN was AND rate <= {SETTLE} THEN gray ELSE anchor END,
         CASE WHEN NOT was THEN d > {ANCHOR} OR area > {CUT} ELSE rate > {SETTLE} END, d, was AND rate <= {SETTLE}
  FROM (SELECT c.video_id, c.frame_no, c.gray, p.anchor, p.unsettled AS was, c.rate, c.area,
               list_sum(list_transform(list_zip(c.gray, p.anchor), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / len(c.gray) / 255 AS d
        FROM fold p JOIN ch c ON c.video_id = p.video_id AND c.frame_no = p.frame_no + 1))
SELECT video_id, frame_no, round(d, 8) AS anchor, reset AS is_anchor_reset FROM fold""",
    "content_area": f"""WITH {FRAMES}, m AS (SELECT *, (list_sort(gray)[32]::DOUBLE + list_sort(gray)[33]) / 2 AS mid FROM fr)
SELECT video_id, frame_no, round(len(list_filter(gray, lambda x: abs(x - mid) > 25)) / 64.0::DOUBLE, 8) AS content_area FROM m""",
    "mean_luma": f"""WITH {FRAMES}, m AS (SELECT *, list_sum(list_transform(gray, lambda x: x::DOUBLE)) / 64 AS luma FROM fr)
SELECT video_id, frame_no, round(luma, 4) AS luma, CASE WHEN luma - 120 < 5 THEN 'dark or empty screen' END AS warning FROM m""",
    "read_frame_images": f"""WITH {FRAMES}
SELECT video_id, 'full' AS run, frame_no, round(frame_no / 15.0::DOUBLE, 2) AS t, 64::BIGINT AS n,
       round(list_sum(list_transform(gray, lambda x: least(greatest(round_even(x::DOUBLE, 0), 0), 255))) / 64, 4) AS luma FROM fr""",
    "pair_changed": f"""WITH {FRAMES},
pr AS (SELECT video_id, frame_no AS pair_no, frame_no / 15.0::DOUBLE AS x, (frame_no + frame_no % 3) / 15.0::DOUBLE AS y FROM fr){SIMILAR}
SELECT video_id, pair_no, x AS a, y AS b, round(similarity, 6) AS similarity, similarity < 0.93 AS changed FROM pr JOIN sm USING (video_id, pair_no)""",
    "stable_capture_time": f"""WITH {FRAMES},
du AS (SELECT video_id, (max(frame_no) + 1) / 15.0::DOUBLE AS d FROM fr GROUP BY 1),
fi AS (SELECT video_id, frame_no AS pair_no, frame_no / 15.0::DOUBLE AS a, d, least(frame_no / 15.0::DOUBLE + 0.5, d - 0.05) AS x FROM fr JOIN du USING (video_id)),
pr AS (SELECT *, least(x + 0.5, d - 0.02) AS y FROM fi){SIMILAR}
SELECT video_id, pair_no, a, round(similarity, 6) AS similarity, round(CASE WHEN similarity < 0.97 THEN least(a + 1.5, d - 0.05) ELSE x END, 6) AS stable_t
FROM pr JOIN sm USING (video_id, pair_no)""",
    "reduced_size": f"WITH {SIZES} SELECT *, {FIT.format(m=768, s='w')} AS read_w, {FIT.format(m=768, s='h')} AS read_h FROM s",
    "image_tokens": f"WITH {SIZES} SELECT *, ({FIT.format(m=1568, s='w')} * {FIT.format(m=1568, s='h')}) // 750 AS tokens FROM s",
    "read_path": f"WITH {CHANGES}{CANDIDATES} SELECT video_id, run, seq, replace(image, 'frames/', 'read/') AS read_path FROM named",
}
