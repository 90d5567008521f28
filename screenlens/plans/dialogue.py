"""Registered queries over screens, candidates and dialogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenlens.operators import budget, dialogue, documents, screens
from screenlens.plans import bridges as B
from screenlens.plans.detection import TIMED
from screenlens.session import materialize


def screen_periods(c):
    return screens.screen_periods(c.changes, c.runs)


def frame_candidates(c):
    seeds = c.videos.select(
        "video_id", F.lit(0.5).alias("seed_t"), F.lit(0.0).alias("seed_from")
    )
    pairs = screens.screen_end_pairs(c.changes, seeds, F.lit(15.0))
    changed = pairs.select("video_id", "event_no", (F.col("event_no") % 3 != 0).alias("changed"))
    found = screens.frame_candidates(pairs, seeds, changed)
    return found.withColumn("sources", F.array_join("sources", "+"))


def window_filter(c):
    kept = c.candidates
    return kept.select("video_id", "run", "ord", "t", F.array_join("sources", "+").alias("sources"))


def sequence_names(c):
    return c.candidates.select("video_id", "run", "ord", "seq", "image")


def blank_gate(c):
    return c.candidates.select(
        "video_id", "run", "ord", "content_area", "status", "reject_reason"
    )


def transitions(c):
    return screens.transitions(c.changes, c.runs)


def unanalysed_gaps(c):
    return screens.unanalysed_gaps(c.runs.drop("duration"), c.videos)


def run_summary(c):
    return screens.run_summary(c.screens, c.candidates)


def source_counts(c):
    return screens.source_counts(c.candidates)


def rejected_in(c):
    full = c.candidates.filter("run = 'full'")
    spans = c.segments.select("video_id", F.col("seg_no").alias("span_id"), "start", "end")
    return screens.rejected_in(full, spans)


def longest_screens(c):
    sized = B.images(c.frames_on_screens)
    tokens = sized.groupBy("video_id", "run", "screen").agg(
        F.sum(budget.image_tokens(F.col("w"), F.col("h"))).alias("tokens")
    )
    best = screens.longest_screens(c.screens, tokens, 3000)
    return best.select("video_id", "run", "screen", "tokens", "tokens_so_far")


def segments_in(c):
    return c.scoped_segments.select("video_id", "run", "seg_no")


def assign_segments(c):
    assigned = dialogue.assign_segments(c.scoped_segments, c.screens)
    return assigned.select("video_id", "run", "seg_no", "screen")


def frame_to_screen(c):
    placed = dialogue.frame_to_screen(c.candidates, c.screens)
    return placed.select("video_id", "run", "seq", "screen")


def attach_dialogue(c):
    all_screens = c.screens
    said = dialogue.assign_segments(c.scoped_segments, all_screens)
    rows = dialogue.attach_dialogue(c.candidates, all_screens, said)
    return rows.select(
        "video_id", "run", "seq", "screen", "interval_start", "interval_end", "seg_no", "said_start"
    )


def hosts(c):
    all_screens, scoped = c.screens, c.scoped_segments
    said = dialogue.assign_segments(scoped, all_screens)
    return dialogue.hosts(all_screens, said)


def _shown(c):
    all_screens, scoped = c.screens, c.scoped_segments
    said = c.assigned
    hosted = materialize(dialogue.hosts(all_screens, said), "hosts")
    frames = c.frames_on_screens.filter("status = 'accepted'")
    return all_screens, hosted, said, frames


def sections(c):
    return documents.sections(*_shown(c))


def rag_rows(c):
    return documents.rag_rows(documents.sections(*_shown(c)))


def render_context(c):
    shown = _shown(c)
    costs = budget.read_budget(B.images(shown[3]))
    return documents.render_context(c.runs, *shown, costs)


def render_index(c):
    summary = screens.run_summary(c.screens, c.candidates)
    made = summary.join(c.runs.select("video_id", "run", "lo", "hi"), ["video_id", "run"])
    whole = made.withColumns(
        {n: F.when(F.col("run") != "full", F.col(n)) for n in ("lo", "hi")}
    )
    index = screens.merge_run_index(
        whole.filter("run = 'full'"), whole.filter("run <> 'full'"), whole.select("video_id", "run")
    )
    return documents.render_index(c.videos, index)


def export_metadata_json(c):
    titles = c.runs.join(c.videos.select("video_id", "fps"), "video_id").select(
        "*",
        F.lit("subtitle").alias("backend"),
        F.lit(None).cast("string").alias("model"),
        F.struct(F.lit(0.5).alias("merge_window"), F.lit(15).alias("fps_read")).alias("params"),
    )
    frames = c.frames_on_screens.withColumn("yavg", F.col("seq") + 16.5)
    requested = c.points.select(
        "video_id", F.lit("full").alias("run"), F.col("event_id").alias("request_no"), F.col("at").alias("time")
    )
    costs = budget.read_budget(B.images(c.frames_on_screens))
    return documents.export_metadata(
        titles, c.screens, frames, c.scoped_segments, c.assigned, costs, requested, "screenlens/metadata@2"
    )


def read_budget(c):
    return budget.read_budget(B.images(c.frames_on_screens))


def segment_at(c):
    found = dialogue.segment_at(c.points, c.segments, "at", ["event_id"])
    return found.select("video_id", "event_id", "seg_no")


def segment_index_at(c):
    return dialogue.segment_index_at(c.points, c.segments, "at")


def request_holder(c):
    frames = c.frames_on_screens.filter("status = 'accepted'")
    spans = c.screens.select(
        "video_id", "run", "screen", F.round("start", 2).alias("interval_start"),
        F.round("end", 2).alias("interval_end"),
    )
    held = frames.join(spans, ["video_id", "run", "screen"])
    requests = c.points.select(
        "video_id", F.lit("full").alias("run"), F.col("event_id").alias("request_no"), "at",
        (F.col("at") + 0.3).alias("time"),
    )
    done = dialogue.request_holder(requests, held, c.videos, c.segments)
    return done.select("video_id", "request_no", "interval_start", "interval_end", "said_at")


def transcript_text(c):
    return dialogue.transcript_text(c.segments)


def word_density(c):
    words = c.segments.select(
        "video_id", "start", F.explode(F.split("text", " ")).alias("word")
    )
    return dialogue.word_density(words, 10.0)


QUERIES = {
    "screen_periods": screen_periods,
    "frame_candidates": frame_candidates,
    "window_filter": window_filter,
    "sequence_names": sequence_names,
    "blank_gate": blank_gate,
    "transitions": transitions,
    "unanalysed_gaps": unanalysed_gaps,
    "run_summary": run_summary,
    "source_counts": source_counts,
    "rejected_in": rejected_in,
    "longest_screens": longest_screens,
    "segments_in": segments_in,
    "assign_segments": assign_segments,
    "frame_to_screen": frame_to_screen,
    "attach_dialogue": attach_dialogue,
    "segment_at": segment_at,
    "segment_index_at": segment_index_at,
    "request_holder": request_holder,
    "hosts": hosts,
    "sections": sections,
    "rag_rows": rag_rows,
    "render_context": render_context,
    "render_index": render_index,
    "export_metadata_json": export_metadata_json,
    "read_budget": read_budget,
    "transcript_text": transcript_text,
    "word_density": word_density,
}

SEGMENTS = """
seg AS (SELECT conv_id::VARCHAR AS video_id, turn AS seg_no, turn * 5.0::DOUBLE AS start,
               turn * 5.0::DOUBLE + 1 + (length(text) % 70) / 10.0::DOUBLE AS "end", text
        FROM conversations),
vid AS (SELECT conv_id::VARCHAR AS video_id, (max(turn) + 1) * 5.0::DOUBLE + 3 AS duration,
               'conversation ' || conv_id AS title, conv_id % 3 <> 0 AS has_audio
        FROM conversations GROUP BY conv_id)"""
CHANGES = TIMED + "," + SEGMENTS + """,
sqz AS (SELECT v.video_id, event_id, event_type, t.t / 720 * duration AS t, value
        FROM timed t JOIN vid v ON v.video_id = (t.video_id::BIGINT % (SELECT count(*) FROM vid))::VARCHAR),
sq AS (SELECT * FROM sqz WHERE event_type <> 'click'),
chg AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) - 1 AS event_no, t,
               t - 0.2::DOUBLE AS before_t, t + value % 1 AS after_t FROM sq),
runs AS (SELECT video_id, 'full' AS run, 0.0::DOUBLE AS lo, duration AS hi, duration, title FROM vid
         UNION ALL SELECT video_id, '0005_0-0020_0', 5.0::DOUBLE, least(duration, 20), duration, title FROM vid)"""
SCREENS = CHANGES + """,
ins AS (SELECT r.video_id, r.run, r.lo, r.hi, c.event_no, c.t, c.after_t FROM chg c JOIN runs r USING (video_id)
        WHERE c.t BETWEEN r.lo AND r.hi
        UNION ALL SELECT video_id, run, lo, hi, 999999999, hi, NULL FROM runs),
stp AS (SELECT *, coalesce(lag(after_t) OVER (PARTITION BY video_id, run ORDER BY event_no), lo) AS start FROM ins),
per AS (SELECT video_id, run, row_number() OVER (PARTITION BY video_id, run ORDER BY event_no) - 1 AS screen,
               start, t AS "end" FROM stp WHERE t > start),
scr AS (SELECT * FROM per UNION ALL
        SELECT video_id, run, 0, lo, hi FROM runs r
        WHERE NOT EXISTS (SELECT 1 FROM per p WHERE p.video_id = r.video_id AND p.run = r.run))"""
CANDIDATES = """,
lg AS (SELECT *, coalesce(lag(after_t) OVER (PARTITION BY video_id ORDER BY event_no), 0.5) AS screen_start FROM chg),
cand AS (SELECT video_id, 0 AS ord, 0.5::DOUBLE AS t, 0.0::DOUBLE AS detected_at, 'initial' AS sources FROM vid
         UNION ALL SELECT video_id, event_no * 2 + 2, after_t, t, 'screen-start' FROM lg
         UNION ALL SELECT video_id, event_no * 2 + 1, before_t, t, 'screen-end' FROM lg
                   WHERE before_t - screen_start > 1 / 15.0::DOUBLE AND event_no % 3 <> 0),
wc AS (SELECT c.video_id, r.run, c.ord, c.t, c.detected_at, c.sources,
              CASE WHEN c.ord % 13 <> 5 THEN (c.ord * 7 % 11) / 5000::DOUBLE END AS content_area
       FROM cand c JOIN runs r USING (video_id) WHERE c.sources = 'initial' OR c.t BETWEEN r.lo AND r.hi),
gated AS (SELECT *, CASE WHEN content_area IS NULL OR content_area <= 0.001 THEN 'rejected' ELSE 'accepted' END AS status,
                 CASE WHEN content_area IS NULL THEN 'extract-failed' WHEN content_area <= 0.001 THEN 'blank(<=0.001)' END AS reject_reason,
                 row_number() OVER (PARTITION BY video_id, run ORDER BY t, ord) - 1 AS seq FROM wc),
named AS (SELECT *, printf('frames/scene_%03d_t%07.2f.jpg', seq, t) AS image FROM gated)"""
SCOPED = """,
sc AS (SELECT s.video_id, r.run, s.seg_no, s.start, s."end", s.text FROM seg s JOIN runs r USING (video_id)
       WHERE s."end" > r.lo AND s.start < r.hi)"""
ASSIGNED = SCOPED + """,
ov AS (SELECT a.video_id, a.run, a.seg_no, a.start AS s, a."end" AS e, a.text, p.screen, p.start AS ps, p."end" AS pe,
              least(a."end", p."end") - greatest(a.start, p.start) AS o,
              least(abs(p.start - a.start), abs(p."end" - a."end")) AS d
       FROM sc a JOIN scr p ON p.video_id = a.video_id AND p.run = a.run),
asg AS (SELECT video_id, run, seg_no, any_value(s) AS start, any_value(e) AS "end", any_value(text) AS text,
               CASE WHEN max(o) > 0 THEN arg_max(screen, struct_pack(o := o, k := -screen))
                    ELSE arg_min(screen, struct_pack(d := d, k := screen)) END AS screen
        FROM ov GROUP BY 1, 2, 3)"""
PLACED = """,
fs AS (SELECT n.*, coalesce((SELECT max(screen) FROM scr p WHERE p.video_id = n.video_id AND p.run = n.run AND p.start <= n.t), 0) AS screen
       FROM named n)"""
HOSTS = """,
cross_ AS (SELECT *, count(*) OVER (PARTITION BY video_id, run, seg_no) AS n FROM ov WHERE e > ps AND s < pe),
hst AS (SELECT c.video_id, c.run, c.screen, arg_max(a.screen, c.seg_no) AS host FROM cross_ c
        JOIN asg a ON a.video_id = c.video_id AND a.run = c.run AND a.seg_no = c.seg_no
        WHERE c.n > 1 AND c.screen <> a.screen
          AND NOT EXISTS (SELECT 1 FROM asg x WHERE x.video_id = c.video_id AND x.run = c.run AND x.screen = c.screen)
        GROUP BY 1, 2, 3)"""
SHOWN = SCREENS + CANDIDATES + ASSIGNED + PLACED + HOSTS + """,
acc AS (SELECT f.*, coalesce(h.host, f.screen) AS section FROM fs f LEFT JOIN hst h
        ON h.video_id = f.video_id AND h.run = f.run AND h.screen = f.screen WHERE status = 'accepted'),
spn AS (SELECT p.video_id, p.run, coalesce(h.host, p.screen) AS section, min(p.start) AS start, max(p."end") AS "end", count(*) AS n_screens
        FROM scr p LEFT JOIN hst h ON h.video_id = p.video_id AND h.run = p.run AND h.screen = p.screen GROUP BY 1, 2, 3),
img AS (SELECT video_id, run, section, count(*) AS n_images, string_agg(image, chr(10) ORDER BY screen, t, seq) AS images,
               string_agg('![](read/' || replace(image, 'frames/', '') || ')' || chr(10), '' ORDER BY screen, seq) AS links
        FROM acc GROUP BY 1, 2, 3),
txt AS (SELECT video_id, run, screen AS section, count(*) AS n_segments, string_agg(trim(text), ' ' ORDER BY seg_no) FILTER (trim(text) <> '') AS text
        FROM asg GROUP BY 1, 2, 3),
secs AS (SELECT s.*, coalesce(n_images, 0) AS n_images, coalesce(n_segments, 0) AS n_segments, images, links, text
         FROM spn s LEFT JOIN img USING (video_id, run, section) LEFT JOIN txt USING (video_id, run, section)
         WHERE coalesce(n_images, 0) > 0 OR text <> '')"""
SIZES = """,
rd AS (SELECT *, CASE seq % 3 WHEN 0 THEN 768 WHEN 1 THEN 768 ELSE 640 END AS w,
              CASE seq % 3 WHEN 0 THEN 432 WHEN 1 THEN 614 ELSE 480 END AS h FROM fs WHERE status = 'accepted'),
bud AS (SELECT video_id, run, count(*) AS n_images, sum(w * h // 750)::BIGINT AS tokens FROM rd GROUP BY 1, 2)"""
RULE = "width x height / 750 tokens once the longer side is at most 1568 px"
POINTS = """,
pts AS (SELECT video_id, event_id, t AS at FROM sqz WHERE event_type = 'click')"""
SEGMENT_AT = """,
sa AS (SELECT p.video_id, p.event_id, p.at,
              coalesce(min(s.seg_no) FILTER (s.start <= p.at AND p.at <= s."end"),
                       arg_min(s.seg_no, struct_pack(d := least(abs(s.start - p.at), abs(s."end" - p.at)), n := s.seg_no))) AS seg_no
       FROM pts p LEFT JOIN seg s USING (video_id) GROUP BY 1, 2, 3)"""

ORACLE = {
    "screen_periods": f"WITH {SCREENS} SELECT * FROM scr",
    "frame_candidates": f"WITH {CHANGES}{CANDIDATES} SELECT video_id, ord, t, detected_at, sources FROM cand",
    "window_filter": f"WITH {CHANGES}{CANDIDATES} SELECT video_id, run, ord, t, sources FROM wc",
    "sequence_names": f"WITH {CHANGES}{CANDIDATES} SELECT video_id, run, ord, seq, image FROM named",
    "blank_gate": f"WITH {CHANGES}{CANDIDATES} SELECT video_id, run, ord, content_area, status, reject_reason FROM gated",
    "transitions": f"""WITH {CHANGES} SELECT r.video_id, r.run, event_no, c.t AS start, c.after_t AS "end"
FROM chg c JOIN runs r USING (video_id) WHERE c.t BETWEEN r.lo AND r.hi""",
    "unanalysed_gaps": f"""WITH {CHANGES}, g AS (
SELECT video_id, run, duration, 0.0::DOUBLE AS start, lo AS "end" FROM runs UNION ALL SELECT video_id, run, duration, hi, duration FROM runs)
SELECT video_id, run, start, "end" FROM g WHERE "end" - start > duration * 0.0001""",
    "run_summary": f"""WITH {SCREENS}{CANDIDATES},
a AS (SELECT video_id, run, count(*) AS n_screens FROM scr GROUP BY 1, 2),
b AS (SELECT video_id, run, count(*) FILTER (status = 'accepted') AS n_frames, count(*) FILTER (status = 'rejected') AS n_rejected FROM gated GROUP BY 1, 2)
SELECT video_id, run, n_screens, coalesce(n_frames, 0) AS n_frames, coalesce(n_rejected, 0) AS n_rejected FROM a LEFT JOIN b USING (video_id, run)""",
    "source_counts": f"WITH {CHANGES}{CANDIDATES} SELECT video_id, run, sources AS source, count(*) AS n_frames FROM gated WHERE status = 'accepted' GROUP BY 1, 2, 3",
    "rejected_in": f"""WITH {CHANGES}{CANDIDATES} SELECT g.video_id, s.seg_no AS span_id, g.t, g.reject_reason FROM gated g JOIN seg s USING (video_id)
WHERE g.run = 'full' AND g.status = 'rejected' AND s.start <= g.t AND g.t < s."end" """,
    "longest_screens": f"""WITH {SCREENS}{CANDIDATES}{PLACED}{SIZES},
tk AS (SELECT video_id, run, screen, sum(w * h // 750)::BIGINT AS tokens FROM rd GROUP BY 1, 2, 3),
j AS (SELECT p.video_id, p.run, p.screen, -(p."end" - p.start) AS r, coalesce(tokens, 0) AS tokens FROM scr p LEFT JOIN tk USING (video_id, run, screen)),
c AS (SELECT video_id, run, screen, tokens, (sum(tokens) OVER (PARTITION BY video_id, run ORDER BY r, screen ROWS UNBOUNDED PRECEDING))::BIGINT AS tokens_so_far FROM j)
SELECT * FROM c WHERE tokens_so_far <= 3000""",
    "segments_in": f"WITH {CHANGES}{SCOPED} SELECT video_id, run, seg_no FROM sc",
    "assign_segments": f"WITH {SCREENS}{ASSIGNED} SELECT video_id, run, seg_no, screen FROM asg",
    "frame_to_screen": f"WITH {SCREENS}{CANDIDATES}{PLACED} SELECT video_id, run, seq, screen FROM fs",
    "attach_dialogue": f"""WITH {SCREENS}{CANDIDATES}{ASSIGNED}{PLACED}
SELECT f.video_id, f.run, f.seq, f.screen, round(p.start, 2) AS interval_start, round(p."end", 2) AS interval_end, a.seg_no, a.start AS said_start
FROM fs f JOIN scr p ON p.video_id = f.video_id AND p.run = f.run AND p.screen = f.screen
LEFT JOIN asg a ON a.video_id = f.video_id AND a.run = f.run AND a.screen = f.screen AND f.status = 'accepted'""",
    "segment_at": f"WITH {CHANGES}{POINTS}{SEGMENT_AT} SELECT video_id, event_id, seg_no FROM sa",
    "segment_index_at": f"""WITH {CHANGES}{POINTS},
k AS (SELECT p.video_id, p.event_id, p.at, max(s.seg_no) AS n FROM pts p LEFT JOIN seg s ON s.video_id = p.video_id AND s.start <= p.at GROUP BY 1, 2, 3)
SELECT k.video_id, k.event_id, k.at, s.seg_no FROM k LEFT JOIN seg s ON s.video_id = k.video_id AND s.seg_no = k.n AND s."end" >= k.at""",
    "request_holder": f"""WITH {SCREENS}{CANDIDATES}{PLACED}{POINTS}{SEGMENT_AT},
iv AS (SELECT f.video_id, f.seq, round(p.start, 2) AS a, round(p."end", 2) AS b FROM fs f JOIN scr p
       ON p.video_id = f.video_id AND p.run = f.run AND p.screen = f.screen WHERE f.status = 'accepted' AND f.run = 'full'),
q AS (SELECT *, "at" + 0.3::DOUBLE AS tm FROM pts),
hl AS (SELECT q.video_id, q.event_id, coalesce(min(iv.seq) FILTER (iv.a <= q.tm AND q.tm < iv.b),
              arg_min(iv.seq, struct_pack(d := least(abs(iv.a - q.tm), abs(iv.b - q.tm)), n := iv.seq))) AS seq
       FROM q LEFT JOIN iv USING (video_id) GROUP BY 1, 2)
SELECT h.video_id, h.event_id AS request_no, coalesce(iv.a, 0) AS interval_start, coalesce(iv.b, round(v.duration, 2)) AS interval_end,
       coalesce(trim(s.text), '') AS said_at
FROM hl h JOIN vid v USING (video_id) LEFT JOIN iv ON iv.video_id = h.video_id AND iv.seq = h.seq
JOIN sa ON sa.video_id = h.video_id AND sa.event_id = h.event_id LEFT JOIN seg s ON s.video_id = sa.video_id AND s.seg_no = sa.seg_no""",
    "hosts": f"WITH {SCREENS}{ASSIGNED}{HOSTS} SELECT video_id, run, screen, host FROM hst",
    "sections": f"""WITH {SHOWN} SELECT video_id, run, section, start, "end", n_screens, n_images, n_segments, images, text FROM secs""",
    "rag_rows": f"""WITH {SHOWN} SELECT video_id, run, section, start, "end", images, trim(text) AS text FROM secs
WHERE images IS NOT NULL AND trim(text) <> ''""",
    "render_context": f"""WITH {SHOWN}{SIZES},
ns AS (SELECT video_id, run, count(*) AS n FROM scr GROUP BY 1, 2),
body AS (SELECT video_id, run, string_agg('## ' || round(start, 2) || '-' || round("end", 2) || 's' || chr(10)
           || coalesce(links, '(no image: the screen was empty)' || chr(10)) || coalesce(text, '(no speech)') || chr(10) || chr(10), '' ORDER BY section) AS b
         FROM secs GROUP BY 1, 2)
SELECT r.video_id, r.run, '# ' || r.title || chr(10) || chr(10) || ns.n || ' screens, ' || coalesce(bud.n_images, 0) || ' images, '
  || r.duration::BIGINT || ' s' || chr(10) || chr(10) || 'Images are reading copies; opening all ' || coalesce(bud.n_images, 0) || ' costs about '
  || coalesce(bud.tokens, 0) || ' tokens (' || CASE WHEN bud.tokens IS NULL THEN '' ELSE '{RULE}' END || '). Longer screens hold more: open those first.'
  || chr(10) || chr(10) || coalesce(b, '') AS text
FROM runs r JOIN ns USING (video_id, run) LEFT JOIN bud USING (video_id, run) LEFT JOIN body USING (video_id, run)""",
    "render_index": f"""WITH {SCREENS}{CANDIDATES},
a AS (SELECT video_id, run, count(*) AS n_screens FROM scr GROUP BY 1, 2),
b AS (SELECT video_id, run, count(*) FILTER (status = 'accepted') AS n_frames FROM gated GROUP BY 1, 2),
l AS (SELECT r.video_id, string_agg('| ' || r.run || ' | ' || CASE r.run WHEN 'full' THEN 'whole video' ELSE printf('%.1f-%.1f s', lo, hi) END || ' | '
        || n_screens || ' | ' || coalesce(n_frames, 0) || ' | `runs/' || r.run || '/context.md` |' || chr(10), '' ORDER BY r.run = 'full' DESC) AS rows_, count(*) AS n
      FROM runs r JOIN a USING (video_id, run) LEFT JOIN b USING (video_id, run) GROUP BY 1)
SELECT v.video_id, '# ' || title || chr(10) || chr(10) || duration::BIGINT || ' s, ' || n || ' runs.' || chr(10) || chr(10)
  || 'Runs are independent; where their ranges overlap they may divide the screens differently.' || chr(10) || chr(10)
  || '| run | range | screens | images | file |' || chr(10) || '|---|---|---|---|---|' || chr(10) || rows_ AS text
FROM vid v JOIN l USING (video_id)""",
    "export_metadata_json": f"""WITH {SCREENS}{CANDIDATES}{ASSIGNED}{PLACED}{SIZES}{POINTS},
dl AS (SELECT video_id, run, screen, string_agg('{{"start":' || start || ',"end":' || "end" || ',"text":' || to_json(text) || '}}', ',' ORDER BY seg_no) AS said FROM asg GROUP BY 1, 2, 3),
fj AS (SELECT f.*, '{{"time":' || round_even(f.t, 2) || ',"image":' || to_json(image) || ',"sources":["' || sources || '"],"screen":' || f.screen AS head,
              ',"interval":[' || round_even(p.start, 2) || ',' || round_even(p."end", 2) || '],"dialogue":[' || coalesce(said, '') || '],"yavg":' || (seq + 16.5::DOUBLE) || '}}' AS tail
       FROM fs f LEFT JOIN scr p ON p.video_id = f.video_id AND p.run = f.run AND p.screen = f.screen
       LEFT JOIN dl ON dl.video_id = f.video_id AND dl.run = f.run AND dl.screen = f.screen),
j1 AS (SELECT video_id, run, string_agg('[' || round_even(start, 2) || ',' || round_even("end", 2) || ']', ',' ORDER BY screen) AS x FROM scr GROUP BY 1, 2),
j2 AS (SELECT video_id, run, string_agg(head || tail, ',' ORDER BY t, ord) FILTER (status = 'accepted') AS x,
              string_agg(head || ',"reject_reason":' || to_json(reject_reason) || '}}', ',' ORDER BY t, ord) FILTER (status = 'rejected') AS y FROM fj GROUP BY 1, 2),
j3 AS (SELECT video_id, 'full' AS run, string_agg('{{"request_no":' || event_id || ',"time":' || round_even("at", 2) || '}}', ',' ORDER BY event_id) AS x FROM pts GROUP BY 1),
j4 AS (SELECT video_id, run, string_agg('{{"start":' || start || ',"end":' || "end" || ',"text":' || to_json(text) || '}}', ',' ORDER BY seg_no) AS x,
              string_agg(text, ' ' ORDER BY seg_no) AS y FROM sc GROUP BY 1, 2)
SELECT r.video_id, r.run, '{{"schema":"screenlens/metadata@2","source":{{"file":' || to_json(title) || ',"duration":' || round_even(duration, 2) || ',"fps":15.0}},"window":['
  || round_even(lo, 2) || ',' || round_even(hi, 2) || '],"images":{{"count":' || coalesce(n_images, 0) || ',"tokens":' || coalesce(tokens, 0)
  || ',"long_edge":' || CASE WHEN tokens IS NULL THEN 'null' ELSE '768' END || '}},"screens":[' || coalesce(j1.x, '') || '],"frames":[' || coalesce(j2.x, '') || '],"rejected":[' || coalesce(j2.y, '')
  || '],"requested":[' || coalesce(j3.x, '') || '],"transcript":{{"backend":"subtitle","model":null,"text":' || to_json(coalesce(j4.y, '')) || ',"segments":[' || coalesce(j4.x, '')
  || ']}},"transcript_file":"transcript.json","params":{{"merge_window":0.5,"fps_read":15}}}}' AS text
FROM runs r LEFT JOIN bud USING (video_id, run) LEFT JOIN j1 USING (video_id, run) LEFT JOIN j2 USING (video_id, run) LEFT JOIN j3 USING (video_id, run) LEFT JOIN j4 USING (video_id, run)""",
    "read_budget": f"WITH {SCREENS}{CANDIDATES}{PLACED}{SIZES} SELECT *, 768 AS long_edge, '{RULE}' AS rule FROM bud",
    "transcript_text": f"WITH {SEGMENTS} SELECT video_id, string_agg(text, ' ' ORDER BY seg_no) AS text FROM seg GROUP BY 1",
    "word_density": f"""WITH {SEGMENTS}, w AS (SELECT video_id, start, unnest(string_split(text, ' ')) AS word FROM seg)
SELECT video_id, floor(start / 10)::BIGINT AS bin, count(*) AS n_words, floor(start / 10) * 10 AS bin_start FROM w GROUP BY 1, 2, 4""",
}
