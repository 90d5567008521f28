"""Registered queries for lookups, marks and ground truth (hours as seconds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenlens.operators import documents, lookups, truth
from screenlens.plans.detection import SERIES, SIG
from screenlens.plans.dialogue import CANDIDATES, POINTS, SCREENS

TOLERANCE = 6.0
NEAR = 24.0


def _of(c, kind):
    return c.timed_events.filter(F.col("event_type") == kind).select("video_id", "event_id", "t")


def _frames(c):
    """Views as frames of the user's video, numbered by the event."""
    return _of(c, "view").withColumnRenamed("event_id", "frame_no")


def _asked(c):
    return _of(c, "click").withColumnRenamed("t", "at")


def _flags(c):
    return _of(c, "click").select("video_id", F.col("event_id").alias("press_no"), F.round("t", 2).alias("t"))


def _detections(c):
    return _of(c, "purchase")


def frame_at(c):
    return lookups.frame_at(_asked(c), _frames(c), "at")


def frame_index_at(c):
    return lookups.frame_index_at(_asked(c), _frames(c), "at")


def series_at(c):
    return lookups.series_at(_asked(c), c.signals, "at")


def timeline_readout(c):
    """Conversation moments against candidates, segments and the user's series."""
    shown = c.candidates.filter("run = 'full'").select("video_id", F.col("seq").alias("frame_no"), "t")
    return lookups.timeline_readout(c.points, shown, c.segments, c.signals, "at")


def _marks(c):
    full = c.candidates.filter("run = 'full'")
    return lookups.marks(
        frame=full.filter("status = 'accepted'"),
        rejected=full.filter("status = 'rejected'"),
        screen=c.screens.filter("run = 'full'").withColumnRenamed("start", "t"),
        flag=c.points.withColumn("t", F.round("at", 2)),
        segment=c.segments.withColumnRenamed("start", "t"),
        transition=c.changes,
    )


def mark_counts(c):
    return lookups.mark_counts(_marks(c))


def _ends(c):
    return c.segments.select("video_id", "seg_no", F.col("end").alias("at"))


def next_mark(c):
    return lookups.jump_mark(_ends(c), _marks(c), "at")


def prev_mark(c):
    return lookups.jump_mark(_ends(c), _marks(c), "at", forward=False)


def flag_match(c):
    return truth.flag_match(_flags(c), _detections(c), TOLERANCE)


def unmatched_detections(c):
    return truth.unmatched_detections(_detections(c), _flags(c), TOLERANCE)


def compare_metrics(c):
    videos = c.timed_events.select("video_id").distinct()
    windows = videos.select("video_id", F.lit(100.0).alias("lo"), F.lit(600.0).alias("hi"))
    scoped = truth.flags_in_windows(_flags(c), windows)
    return truth.compare_metrics(videos, scoped, _detections(c), TOLERANCE)


def export_compare(c):
    return documents.export_compare(compare_metrics(c).drop("recall", "precision"))


def _presses(c):
    return c.timed_events.filter("event_type IN ('click', 'view')").select(
        "video_id", F.col("event_id").alias("press_no"), "t", F.col("event_type").alias("note")
    )


def flag_dedupe(c):
    return truth.flag_dedupe(_presses(c), NEAR)


def flag_toggle_replay(c):
    return truth.flag_toggle_replay(_presses(c), NEAR)


QUERIES = {
    "frame_at": frame_at,
    "frame_index_at": frame_index_at,
    "series_at": series_at,
    "timeline_readout": timeline_readout,
    "mark_counts": mark_counts,
    "next_mark": next_mark,
    "prev_mark": prev_mark,
    "flag_match": flag_match,
    "unmatched_detections": unmatched_detections,
    "compare_metrics": compare_metrics,
    "export_compare": export_compare,
    "flag_dedupe": flag_dedupe,
    "flag_toggle_replay": flag_toggle_replay,
}

BASE = SIG + """,
fr AS (SELECT video_id, event_id AS frame_no, t FROM timed WHERE event_type = 'view'),
ask AS (SELECT video_id, event_id, t AS "at" FROM timed WHERE event_type = 'click')"""
DETECTED = "det AS (SELECT video_id, event_id, t FROM timed WHERE event_type = 'purchase')"
FLAGS = f"""{SIG},
fl AS (SELECT video_id, event_id AS press_no, round(t, 2) AS t FROM timed WHERE event_type = 'click'),
{DETECTED}"""
MATCH = """,
mt AS (SELECT f.video_id, f.press_no, f.t, arg_min(d.t, struct_pack(g := abs(d.t - f.t), t := d.t)) AS d
       FROM fl f LEFT JOIN det d USING (video_id) GROUP BY 1, 2, 3),
mm AS (SELECT video_id, press_no, t, CASE WHEN abs(d - t) <= 6 THEN d END AS detected_t,
              CASE WHEN abs(d - t) <= 6 THEN round(d - t, 2) END AS gap FROM mt),
ud AS (SELECT * FROM det d WHERE NOT EXISTS (SELECT 1 FROM fl f WHERE f.video_id = d.video_id AND abs(d.t - f.t) <= 6))"""
METRICS = f"""WITH {SIG},
fl AS (SELECT video_id, event_id AS press_no, round(t, 2) AS t FROM timed WHERE event_type = 'click' AND round(t, 2) BETWEEN 100 AND 600),
{DETECTED}{MATCH},
a AS (SELECT video_id, count(*) AS n_flags, count(detected_t) AS n_matched FROM mm GROUP BY 1),
b AS (SELECT video_id, count(*) AS n_detected FROM det GROUP BY 1),
e AS (SELECT video_id, count(*) AS n_extra FROM ud GROUP BY 1),
m AS (SELECT v.video_id, coalesce(n_flags, 0) AS n_flags, coalesce(n_detected, 0) AS n_detected,
             coalesce(n_matched, 0) AS n_matched, coalesce(n_extra, 0) AS n_extra
      FROM (SELECT DISTINCT video_id FROM timed) v LEFT JOIN a USING (video_id) LEFT JOIN b USING (video_id) LEFT JOIN e USING (video_id)),
sc AS (SELECT *, n_flags - n_matched AS n_missed, round_even(n_matched / nullif(n_flags, 0)::DOUBLE, 3) AS recall,
              CASE WHEN n_flags > 0 THEN round_even((n_detected - n_extra) / nullif(n_detected, 0)::DOUBLE, 3) END AS precision FROM m)"""
MARKS = SCREENS + CANDIDATES + """,
mk AS (SELECT video_id, 'frame' AS kind, t, 1 AS o FROM gated WHERE run = 'full' AND status = 'accepted'
       UNION ALL SELECT video_id, 'rejected', t, 2 FROM gated WHERE run = 'full' AND status = 'rejected'
       UNION ALL SELECT video_id, 'screen', start, 3 FROM scr WHERE run = 'full'
       UNION ALL SELECT video_id, 'flag', round(t, 2), 4 FROM sqz WHERE event_type = 'click'
       UNION ALL SELECT video_id, 'transition', t, 6 FROM chg
       UNION ALL SELECT video_id, 'segment', start, 7 FROM seg)"""
JUMPED = "('frame', 'rejected', 'flag', 'requested')"
PRESSES = SIG + """,
pr AS (SELECT video_id, event_id AS press_no, t, event_type AS note,
              row_number() OVER (PARTITION BY video_id ORDER BY event_id) AS n FROM timed WHERE event_type IN ('click', 'view'))"""

#: Flags left after all presses (un: video_id, k).
TOGGLED = f"""WITH RECURSIVE {PRESSES},
fold AS (SELECT video_id, 1 AS n, [struct_pack(t := round(t, 2), note := note)] AS kept FROM pr WHERE n = 1
         UNION ALL
         SELECT f.video_id, p.n,
           CASE WHEN len(list_filter(f.kept, lambda k: abs(k.t - p.t) <= 24)) > 0
                THEN list_filter(f.kept, lambda k: k.t <> list_sort(list_transform(f.kept, lambda j: struct_pack(d := abs(j.t - p.t), t := j.t)))[1].t)
                ELSE list_append(f.kept, struct_pack(t := round(p.t, 2), note := p.note)) END
         FROM fold f JOIN pr p ON p.video_id = f.video_id AND p.n = f.n + 1),
fin AS (SELECT video_id, arg_max(kept, n) AS kept FROM fold GROUP BY 1),
un AS (SELECT video_id, unnest(kept) AS k FROM fin)
"""

ORACLE = {
    "frame_at": f"""WITH {BASE}
SELECT a.video_id, a.event_id, a."at", coalesce(arg_min(f.frame_no, f.t) FILTER (f.t >= a."at" - 0.001::DOUBLE), arg_max(f.frame_no, f.frame_no)) AS frame_no,
  coalesce(min(f.t) FILTER (f.t >= a."at" - 0.001::DOUBLE), arg_max(f.t, f.frame_no)) AS frame_t
FROM ask a LEFT JOIN fr f USING (video_id) GROUP BY 1, 2, 3""",
    "frame_index_at": f"""WITH {BASE}
SELECT a.video_id, a.event_id, a."at", max(f.frame_no) AS frame_no
FROM ask a LEFT JOIN fr f ON f.video_id = a.video_id AND f.t <= a."at" + 0.05::DOUBLE GROUP BY 1, 2, 3""",
    "series_at": f"""WITH {BASE},
k AS (SELECT a.video_id, a.event_id, a."at", coalesce(min(s.idx) FILTER (s.t >= a."at"), max(s.idx)) AS idx FROM ask a JOIN sig s USING (video_id) GROUP BY 1, 2, 3)
SELECT k.*, s.anchor, s.rate, s.area FROM k JOIN sig s ON s.video_id = k.video_id AND s.idx = k.idx""",
    "timeline_readout": f"""WITH {SCREENS}{CANDIDATES}{POINTS}, {SERIES},
k AS (SELECT a.video_id, a.event_id, a."at", coalesce(min(s.idx) FILTER (s.t >= a."at"), max(s.idx)) AS idx FROM pts a JOIN sig s USING (video_id) GROUP BY 1, 2, 3)
SELECT k.*, (SELECT max(seq) FROM gated g WHERE g.video_id = k.video_id AND g.run = 'full' AND g.t <= k."at" + 0.05::DOUBLE) AS frame_no,
  (SELECT z.seg_no FROM seg z WHERE z.video_id = k.video_id AND z.seg_no = (SELECT max(y.seg_no) FROM seg y WHERE y.video_id = k.video_id AND y.start <= k."at") AND z."end" >= k."at") AS seg_no,
  s.anchor, s.rate, s.area, s.anchor > 0.02 AS anchor_above, s.rate <= 0.0015 AS rate_quiet, s.area > 0.002 AS area_above
FROM k JOIN sig s ON s.video_id = k.video_id AND s.idx = k.idx""",
    "mark_counts": f"WITH {MARKS} SELECT video_id, kind, count(*) AS n_marks FROM mk GROUP BY ROLLUP (video_id, kind)",
    "next_mark": f"""WITH {MARKS}
SELECT s.video_id, s.seg_no, s."end" AS "at", min(m.t) AS mark_t, arg_min(m.kind, struct_pack(t := m.t, o := m.o)) AS mark_kind
FROM seg s LEFT JOIN mk m ON m.video_id = s.video_id AND m.kind IN {JUMPED} AND m.t > s."end" + 0.05::DOUBLE GROUP BY 1, 2, 3""",
    "prev_mark": f"""WITH {MARKS}
SELECT s.video_id, s.seg_no, s."end" AS "at", max(m.t) AS mark_t, arg_min(m.kind, struct_pack(t := -m.t, o := m.o)) AS mark_kind
FROM seg s LEFT JOIN mk m ON m.video_id = s.video_id AND m.kind IN {JUMPED} AND m.t < s."end" + -0.05::DOUBLE GROUP BY 1, 2, 3""",
    "flag_match": f"WITH {FLAGS}{MATCH} SELECT * FROM mm",
    "unmatched_detections": f"WITH {FLAGS}{MATCH} SELECT * FROM ud",
    "compare_metrics": f"{METRICS} SELECT * FROM sc",
    "export_compare": METRICS + """ SELECT video_id, '{"n_flags":' || n_flags || ',"n_detected":' || n_detected || ',"n_matched":' || n_matched
  || ',"n_extra":' || n_extra || ',"n_missed":' || n_missed || '}' AS json FROM sc""",
    "flag_dedupe": f"""WITH RECURSIVE {PRESSES},
rr AS (SELECT video_id, n, round(t, 2) AS t FROM pr),
fold AS (SELECT video_id, 1 AS n, [t] AS kept FROM rr WHERE n = 1
         UNION ALL
         SELECT f.video_id, r.n, CASE WHEN len(list_filter(f.kept, lambda k: abs(k - r.t) <= 24)) > 0 THEN f.kept ELSE list_append(f.kept, r.t) END
         FROM fold f JOIN rr r ON r.video_id = f.video_id AND r.n = f.n + 1),
fin AS (SELECT video_id, arg_max(kept, n) AS kept FROM fold GROUP BY 1),
un AS (SELECT video_id, unnest(kept) AS t FROM fin)
SELECT u.video_id, min(p.press_no) AS press_no, u.t, arg_min(p.note, p.press_no) AS note
FROM un u JOIN pr p ON p.video_id = u.video_id AND round(p.t, 2) = u.t GROUP BY u.video_id, u.t""",
    "flag_toggle_replay": f"{TOGGLED}SELECT video_id, k.t AS t, k.note AS note FROM un",
}
