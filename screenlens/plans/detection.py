"""Registered queries over the change series."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenlens.operators import detect as D
from screenlens.plans import bridges as B

SWEEP = [
    ("base", 0.02, 0.0015, 0.002),
    ("cut", 0.02, 0.0015, 0.010),
    ("anchor", 0.08, 0.0015, 0.002),
    ("rate", 0.02, 0.003, 0.002),
]


def peaks(c):
    return D.tagged_peaks(c.signals)


def events(c):
    return D.detect_events(
        c.signals, merge_window=B.HOURS_MERGE, settle_limit=B.HOURS_SETTLE
    )


def _flat(df):
    return df.withColumn("signals", F.array_join("signals", "+"))


def signal_peaks(c):
    return D.signal_peaks(c.signals, "rate", 0.012)


def detector_union(c):
    signals = c.signals
    hits = D.neighbour_ratio_cut(signals).select("video_id", "t")
    return D.tagged_peaks(signals, hits)


def merge_peaks(c):
    return _flat(D.merge_peaks(peaks(c), B.HOURS_MERGE))


def settle_points(c):
    signals = c.signals
    clusters = D.merge_peaks(D.tagged_peaks(signals), B.HOURS_MERGE)
    settled = D.settle_points(clusters, signals, settle_limit=B.HOURS_SETTLE)
    return settled.select("video_id", "event_no", "before_idx", "before_t", "after_idx", "after_t")


def detect_events(c):
    return _flat(events(c))


def signal_counts(c):
    return D.signal_counts(events(c))


def anchor_reset_points(c):
    return D.anchor_reset_points(c.signals)


def lane_normalise(c):
    lanes = D.lane_normalise(c.signals)
    return lanes.withColumns({n: F.round(n, 6) for n in ("anchor_lane", "rate_lane", "area_lane")})


def neighbour_ratio_cut(c):
    return D.neighbour_ratio_cut(c.signals)


def frame_no_to_pts(c):
    signals = c.signals
    hits = D.neighbour_ratio_cut(signals).select("video_id", (F.col("frame_no") * 2).alias("frame_no"))
    videos = signals.groupBy("video_id").agg(F.lit(1.0).alias("fps"), F.max("t").alias("duration"))
    return D.frame_no_to_pts(hits, signals, videos)


def threshold_sweep(c):
    swept = D.threshold_sweep(c.signals, SWEEP, B.HOURS_MERGE, B.HOURS_SETTLE)
    return D.sweep_report(swept, "base", 6.0)


QUERIES = {
    "signal_peaks": signal_peaks,
    "tagged_peaks": peaks,
    "detector_union": detector_union,
    "merge_peaks": merge_peaks,
    "settle_points": settle_points,
    "detect_events": detect_events,
    "signal_counts": signal_counts,
    "anchor_reset_points": anchor_reset_points,
    "lane_normalise": lane_normalise,
    "neighbour_ratio_cut": neighbour_ratio_cut,
    "frame_no_to_pts": frame_no_to_pts,
    "threshold_sweep": threshold_sweep,
}

TIMED = """
timed AS (SELECT user_id::VARCHAR AS video_id, event_id,
                 (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3600000000::DOUBLE AS t,
                 event_type, value
          FROM events)"""
#: The series of a table ``timed``.
SERIES = """sig AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) - 1 AS idx, t,
               CASE WHEN event_type = 'signup' THEN value / 5000 ELSE 0.0::DOUBLE END AS anchor,
               value / 5000 AS rate,
               CASE WHEN event_type IN ('error', 'purchase') THEN value / 5000 ELSE 0.0::DOUBLE END AS area,
               event_type = 'click' AND value > 40 AS is_anchor_reset
        FROM timed)"""
SIG = f"{TIMED},\n{SERIES}"
NEAR = SIG + """,
nb AS (SELECT *, lag(area) OVER w AS pa, lead(area) OVER w AS na, lag(anchor) OVER w AS pn,
              lead(anchor) OVER w AS nn, lag(rate) OVER w AS pr, lead(rate) OVER w AS nr
       FROM sig WINDOW w AS (PARTITION BY video_id ORDER BY idx))"""


def _tags(anchor, rate, cut):
    return f"""SELECT video_id, idx, t, 'cut' AS signal FROM nb WHERE area > {cut}::DOUBLE AND area >= pa AND area > na
  UNION ALL SELECT video_id, idx, t, 'anchor' FROM nb WHERE anchor > {anchor}::DOUBLE AND anchor >= pn AND anchor > nn
  UNION ALL SELECT video_id, idx, t, 'rate' FROM nb WHERE rate > {rate}::DOUBLE * 8 AND rate >= pr AND rate > nr"""


TAGS = NEAR + f""",
tags AS ({_tags(0.02, 0.0015, 0.002)})"""

RATIO = """
ar AS (SELECT *, lag(rate, 2) OVER w AS b2, lag(rate) OVER w AS b1, lead(rate) OVER w AS a1, lead(rate, 2) OVER w AS a2
       FROM sig WINDOW w AS (PARTITION BY video_id ORDER BY idx)),
ratio AS (SELECT video_id, idx AS frame_no, t FROM (
            SELECT *, coalesce(b2, 0) + coalesce(b1, 0) + coalesce(a1, 0) + coalesce(a2, 0) AS total,
                   (b2 IS NOT NULL)::INT + (b1 IS NOT NULL)::INT + (a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT AS n
            FROM ar)
          WHERE idx > 0 AND n > 0 AND rate > 0.012::DOUBLE AND rate >= 2 * (total / n))"""


def _clusters(prefix="", keys="video_id"):
    """Leader clustering and settle points in plain SQL; keys may include a setting."""
    j = " AND ".join(f"l.{k} = p.{k}" for k in keys.split(", "))
    lk = ", ".join(f"l.{k}" for k in keys.split(", "))
    pk = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""
pk AS (SELECT {keys}, idx, min(t) AS t, list(signal) AS sigs FROM tags GROUP BY {keys}, idx),
lead_ AS (SELECT {keys}, min(idx) AS idx, arg_min(t, idx) AS t FROM pk GROUP BY {keys}
          UNION ALL
          SELECT {lk}, min(p.idx), arg_min(p.t, p.idx) FROM lead_ l JOIN pk p
            ON {j} AND p.idx > l.idx AND p.t - l.t > 12 GROUP BY {lk}),
led AS (SELECT {pk}, p.idx, p.t, p.sigs,
               max(l.idx) OVER (PARTITION BY {pk} ORDER BY p.idx) AS leader
        FROM pk p LEFT JOIN lead_ l ON {j} AND l.idx = p.idx),
clusters AS (SELECT {keys}, leader AS idx, arg_min(t, idx) AS t, max(idx) AS last_idx, arg_max(t, idx) AS last_t,
                    list_sort(list_distinct(flatten(list(sigs)))) AS signals
             FROM led GROUP BY {keys}, leader),
bounds AS (SELECT *, lag(last_idx) OVER (PARTITION BY {keys} ORDER BY idx) AS low,
                  lead(idx) OVER (PARTITION BY {keys} ORDER BY idx) AS high,
                  row_number() OVER (PARTITION BY {keys} ORDER BY idx) - 1 AS event_no
           FROM clusters)"""


def _settled(rate="0.0015::DOUBLE", keys="video_id"):
    ck = ", ".join(f"c.{k}" for k in keys.split(", "))
    back = "s.idx <= c.idx AND (s.idx = c.idx OR s.idx >= coalesce(c.low, 0)) AND c.t - s.t <= 24"
    ahead = "s.idx >= c.last_idx AND (s.idx = c.last_idx OR c.high IS NULL OR s.idx <= c.high) AND s.t - c.last_t <= 24"
    return f"""
settled AS (SELECT {ck}, c.event_no, c.idx, c.t, c.signals,
    coalesce(max(s.idx) FILTER ({back} AND s.idx < c.idx AND s.rate <= {rate}),
             arg_min(s.idx, struct_pack(r := s.rate, d := c.idx - s.idx)) FILTER ({back})) AS before_idx,
    coalesce(min(s.idx) FILTER ({ahead} AND s.idx > c.last_idx AND s.rate <= {rate}),
             arg_min(s.idx, struct_pack(r := s.rate, d := s.idx - c.last_idx)) FILTER ({ahead})) AS after_idx
  FROM bounds c JOIN sig s ON s.video_id = c.video_id
  GROUP BY {ck}, c.event_no, c.idx, c.t, c.signals),
ev AS (SELECT e.*, b.t AS before_t, a.t AS after_t FROM settled e
       JOIN sig b ON b.video_id = e.video_id AND b.idx = e.before_idx
       JOIN sig a ON a.video_id = e.video_id AND a.idx = e.after_idx)"""


EVENTS = TAGS + "," + _clusters() + "," + _settled()

EVENTS_WITH_HITS = f"""{NEAR}, {RATIO},
tags AS ({_tags(0.02, 0.0015, 0.002)} UNION ALL SELECT video_id, frame_no, t, 'adaptive' FROM ratio),{_clusters()},{_settled()}"""

SWEPT_TAGS = "\n UNION ALL ".join(
    f"SELECT *, '{name}' AS setting, {rate}::DOUBLE AS thr FROM ({_tags(anchor, rate, cut)})"
    for name, anchor, rate, cut in SWEEP
)
RATE_OF = "CASE c.setting WHEN 'rate' THEN 0.003::DOUBLE ELSE 0.0015::DOUBLE END"

ORACLE = {
    "signal_peaks": f"WITH {NEAR} SELECT video_id, idx, t, rate AS value FROM nb WHERE rate > 0.012::DOUBLE AND rate >= pr AND rate > nr",
    "tagged_peaks": f"WITH {TAGS} SELECT * FROM tags",
    "detector_union": f"""WITH {TAGS}, {RATIO}
SELECT * FROM tags UNION ALL SELECT video_id, frame_no, t, 'adaptive' FROM ratio""",
    "merge_peaks": f"""WITH RECURSIVE {TAGS}, {_clusters()}
SELECT video_id, idx, t, last_idx, last_t, array_to_string(signals, '+') AS signals FROM clusters""",
    "settle_points": f"""WITH RECURSIVE {EVENTS}
SELECT video_id, event_no, before_idx, before_t, after_idx, after_t FROM ev""",
    "detect_events": f"""WITH RECURSIVE {EVENTS}
SELECT video_id, event_no, idx, t, array_to_string(signals, '+') AS signals, before_idx, before_t, after_idx, after_t FROM ev""",
    "signal_counts": f"""WITH RECURSIVE {EVENTS}
SELECT video_id, signal, count(*) AS n_events FROM (SELECT video_id, unnest(signals) AS signal FROM ev) GROUP BY 1, 2""",
    "anchor_reset_points": f"WITH {SIG} SELECT video_id, idx, t, anchor FROM sig WHERE is_anchor_reset",
    "lane_normalise": f"""WITH {SIG} SELECT video_id, idx, t,
  round(least(greatest(anchor / (4 * 0.02::DOUBLE), 0), 1), 6) AS anchor_lane,
  round(least(greatest(rate / (6 * 0.0015::DOUBLE), 0), 1), 6) AS rate_lane,
  round(least(greatest(area / (4 * 0.002::DOUBLE), 0), 1), 6) AS area_lane,
  anchor > 0.02::DOUBLE AS anchor_above, rate > 0.0015::DOUBLE AS rate_above, area > 0.002::DOUBLE AS area_above FROM sig""",
    "neighbour_ratio_cut": f"WITH {SIG}, {RATIO} SELECT * FROM ratio",
    "frame_no_to_pts": f"""WITH {SIG}, {RATIO},
n AS (SELECT video_id, max(idx) AS last FROM sig GROUP BY 1)
SELECT r.video_id, 2 * r.frame_no AS frame_no, s.t, NULL::VARCHAR AS error
FROM ratio r JOIN n USING (video_id) JOIN sig s ON s.video_id = r.video_id AND s.idx = least(2 * r.frame_no, n.last)""",
    "threshold_sweep": f"""WITH RECURSIVE {NEAR}, tags AS ({SWEPT_TAGS}), {_clusters(keys="video_id, setting")},
{_settled(RATE_OF, "video_id, setting")},
base AS (SELECT * FROM ev WHERE setting = 'base'),
hit AS (SELECT DISTINCT e.setting, b.video_id, b.event_no FROM base b JOIN ev e
        ON e.video_id = b.video_id AND abs(e.after_t - b.after_t) <= 6),
kept AS (SELECT setting, count(*) AS n_frames FROM (SELECT video_id, setting, before_idx AS idx FROM ev UNION SELECT video_id, setting, after_idx FROM ev) GROUP BY 1)
SELECT e.setting, e.n_events, k.n_frames, round(1 - k.n_frames / (SELECT n_frames FROM kept WHERE setting = 'base')::DOUBLE, 4) AS frames_saved,
       coalesce(h.n, 0) AS n_recovered,
       round(coalesce(h.n, 0) / (SELECT count(*) FROM base)::DOUBLE, 4) AS recall
FROM (SELECT setting, count(*) AS n_events FROM ev GROUP BY 1) e JOIN kept k USING (setting)
LEFT JOIN (SELECT setting, count(*) AS n FROM hit GROUP BY 1) h USING (setting)""",
}
