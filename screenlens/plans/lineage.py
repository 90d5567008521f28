"""Registered queries over runs, reviews and stage state."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenlens.functions import text as T
from screenlens.operators import lineage, screens

VERSION = "1"


def _orders(c):
    return c.table("orders")


def _range_text(key):
    lo, hi = (key % 7) * 20, (key % 11) * 25
    return (
        F.when(key % 9 == 0, F.lit("120"))
        .when(key % 9 == 1, F.lit("a-b"))
        .when(key % 9 == 2, F.lit("1-2-3"))
        .otherwise(F.format_string(" %d-%d ", lo, hi))
    )


def validate_range(c):
    asked = _orders(c).select(
        "o_orderkey", _range_text(F.col("o_orderkey")).alias("range_text"), F.lit(200.0).alias("duration")
    )
    return screens.validate_range(asked)


def run_name(c):
    lo = (F.col("o_orderkey") % 400) / 8.0
    return _orders(c).select(
        "o_orderkey",
        screens.run_name(F.when(F.col("o_orderkey") % 5 != 0, lo), lo + 100.25).alias("run"),
    )


def distinct_ranges(c):
    lo = (F.col("o_orderkey") % 4) * 10.0
    ranges = _orders(c).select(
        F.col("o_custkey").cast("string").alias("video_id"), lo.alias("lo"), (lo + 50.0).alias("hi")
    )
    return screens.distinct_ranges(ranges)


def _index(c, first):
    """Runs recorded before (finished orders) and now (all others)."""
    lo = F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 4) * 10.0)
    entries = _orders(c).filter((F.col("o_orderstatus") == "F") == F.lit(first)).select(
        F.col("o_custkey").cast("string").alias("video_id"),
        screens.run_name(lo, lo + 50).alias("run"),
        lo.alias("lo"),
        (lo + 50).alias("hi"),
        "o_orderkey",
    )
    return entries.groupBy("video_id", "run", "lo", "hi").agg(F.max("o_orderkey").alias("n_frames"))


def _live(c):
    lo = F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 4) * 10.0)
    kept = _orders(c).filter("o_orderpriority <> '5-LOW'")
    return kept.select(
        F.col("o_custkey").cast("string").alias("video_id"), screens.run_name(lo, lo + 50).alias("run")
    )


def merge_run_index(c):
    return screens.merge_run_index(_index(c, True), _index(c, False), _live(c))


def live_runs(c):
    return screens.live_runs(_index(c, True), _live(c))


def request_ledger_upsert(c):
    rows = _orders(c).select(
        F.col("o_custkey").cast("string").alias("video_id"),
        F.lit("full").alias("run"),
        (F.col("o_orderkey") % 3 * 1.5).alias("at"),
        F.col("o_orderpriority").alias("reason"),
        "o_orderstatus",
        "o_orderkey",
    )
    ledger = rows.filter("o_orderstatus = 'F'").groupBy("video_id", "run", "at", "reason").agg(
        F.min("o_orderkey").alias("request_no")
    )
    asked = rows.filter("o_orderstatus <> 'F'").select(
        "video_id", "run", "at", "reason", F.col("o_orderkey").alias("request_no")
    )
    return lineage.request_ledger_upsert(ledger, asked)


def source_changed(c):
    parts = c.table("part").select(
        F.col("p_partkey").cast("string").alias("video_id"), F.col("p_name").alias("path"),
        F.col("p_size").alias("size"), "p_retailprice",
    )
    grown = F.when(F.col("p_retailprice") > 1000, F.col("size") + 1).otherwise(F.col("size"))
    return lineage.source_changed(parts.filter("size > 5"), parts.filter("size < 45").withColumn("size", grown))


def subtitle_changed(c):
    key = F.col("o_orderkey")
    states = _orders(c).select(
        "o_orderkey",
        (F.col("o_orderstatus") == "F").alias("transcribed"),
        F.when(key % 3 != 0, F.col("o_orderpriority")).alias("prev_path"),
        F.when(key % 3 != 0, key % 2).alias("prev_size"),
        F.when(key % 4 != 0, F.col("o_orderpriority")).alias("path"),
        F.when(key % 4 != 0, key % 5 % 2).alias("size"),
    )
    return lineage.subtitle_changed(states).select("o_orderkey", "redo")


def fingerprint_target(c):
    key = F.col("o_orderkey")
    explicit = F.when(key % 3 == 0, F.concat(F.lit("given/"), key.cast("string")))
    sidecar = F.when(key % 2 == 0, F.concat(F.lit("beside/"), key.cast("string")))
    return _orders(c).select("o_orderkey", lineage.fingerprint_target(explicit, sidecar).alias("target"))


def _due(c):
    stage = F.element_at(F.array(*[F.lit(s) for s in ("split", "transcribe", "frames")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    stages = _orders(c).select(
        F.col("o_custkey").cast("string").alias("video_id"), stage.alias("stage"),
        (F.col("o_orderstatus") != "P").alias("done"), F.col("o_orderkey").alias("at"),
    )
    videos = c.table("customer").select(F.col("c_custkey").cast("string").alias("video_id"))
    return lineage.stale_stages(stages, videos), videos


def stale_stages(c):
    return _due(c)[0]


def schema_gate(c):
    docs = c.table("documents").select("doc_id", F.when(F.col("doc_id") % 6 != 0, F.col("source")).alias("schema_version"))
    return lineage.schema_gate(docs, "src1")


def transcript_reuse(c):
    key = F.col("o_orderkey")
    kinds = F.array(*[F.lit(k) for k in ("explicit", "sidecar", "whisper")])
    states = _orders(c).select(
        "o_orderkey",
        (key % 5 != 0).alias("transcribed"),
        (key % 7 == 0).alias("redo"),
        F.element_at(kinds, (key % 3 + 1).cast("int")).alias("source_kind"),
        F.lit("a.srt").alias("source_path"),
        F.when(key % 4 == 0, F.when(key % 8 == 0, "a.srt").otherwise("b.srt")).alias("explicit_path"),
        F.when(key % 3 == 2, "small").alias("model_size"),
        F.lit("ko").alias("language"),
        F.when(key % 2 == 0, F.when(key % 11 == 0, "small").otherwise("tiny")).alias("asked_model"),
        F.when(key % 13 < 4, F.when(key % 13 < 2, "kor").otherwise("en")).alias("asked_language"),
    )
    return lineage.transcript_reuse(states).select("o_orderkey", "reuse", "note")


def clean_survey(c):
    paths = F.array(
        *[F.lit(p) for p in ("video.mkv", "runs/full/frames/a.jpg", "runs/full/read/a.jpg", "transcript.json", "reviews/full.md", "runs/x/frames/b.jpg", "subs/track1.srt")]
    )
    files = c.table("lineitem").select(
        F.col("l_orderkey").cast("string").alias("video_id"),
        F.element_at(paths, ((F.col("l_linenumber") - 1) % 7 + 1).cast("int")).alias("path"),
        F.col("l_extendedprice").cast("long").alias("length"),
    )
    return lineage.clean_survey(files)


def _contexts(c):
    """Documents as rendered contexts: three to a video, one per run."""
    return c.table("documents").select(
        "doc_id",
        F.floor(F.col("doc_id") / 3).cast("string").alias("video_id"),
        F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")).alias("run"),
        (F.col("doc_id") % 3).alias("position"),
        "text",
    )


def context_fingerprint(c):
    return lineage.context_fingerprint(_contexts(c))


def _reviews(c):
    """Reviews of labelled documents; poor quality means the review was written over another text,
    every ninth one lost its header."""
    docs = _contexts(c).join(c.table("labels").select("doc_id", "quality"), "doc_id")
    seen = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat(F.lit("old"), "text"))
    body = F.concat(F.lit("\n\n  review of "), F.col("doc_id").cast("string"), F.lit("\r\n\n"))
    whole = T.compose_review(
        body, F.col("run"), F.lit("context.md"), F.sha2(seen, 256), F.lit("2024-01-01T00:00:00"), F.lit(VERSION)
    )
    file = F.when(F.col("doc_id") % 9 == 0, F.lit("no header here")).otherwise(whole)
    return docs.select("doc_id", "video_id", "run", "text", "quality", file.alias("review"))


def _statuses(c):
    return lineage.review_status(_contexts(c), _reviews(c), context_fingerprint(c))


def review_status(c):
    return _statuses(c).select("video_id", "run", "state")


def review_header(c):
    rows = _reviews(c).withColumn("_h", T.review_header(F.col("review")))
    return rows.select(
        "doc_id", "_h.run", "_h.context_sha256", T.review_body(F.col("review")).alias("body")
    )


def review_decide(c):
    doc = F.col("doc_id")
    body = F.when(doc % 2 == 0, F.concat(F.lit("  review of "), doc.cast("string"), F.lit("\n"))).otherwise("another text")
    action = lineage.review_decide(F.col("review"), body, F.sha2("text", 256), doc % 5 == 0)
    return _reviews(c).select("doc_id", action.alias("action"))


def normalize_review(c):
    messy = F.concat(F.lit("\n\n  "), F.replace("text", F.lit(" "), F.lit("\r\n")), F.lit("  \r\n\n"))
    return c.table("documents").select("doc_id", T.normalize_review(messy).alias("body"))


def review_body_check(c):
    doc = F.col("doc_id")
    body = (
        F.when(doc % 4 == 0, F.lit(" \n "))
        .when(doc % 4 == 1, F.concat("text", F.lit("<!-- screenlens:review END -->")))
        .otherwise(F.col("text"))
    )
    return c.table("documents").select("doc_id", lineage.review_body_check(body, 2000).alias("refused"))


def pending_head(c):
    return lineage.pending_head(_statuses(c), _contexts(c))


def next_action(c):
    due, _ = _due(c)
    videos = _contexts(c).select("video_id").distinct()
    costs = _contexts(c).select(
        "video_id", "run", (F.col("doc_id") % 40).alias("n_images"), (F.col("doc_id") % 40 * 442).alias("tokens")
    )
    return lineage.next_action(videos, due, pending_head(c), costs)


QUERIES = {
    f.__name__: f
    for f in (
        validate_range, run_name, distinct_ranges, merge_run_index, live_runs, request_ledger_upsert,
        source_changed, subtitle_changed, fingerprint_target, stale_stages, schema_gate,
        transcript_reuse, clean_survey, context_fingerprint, review_status, review_header,
        review_decide, normalize_review, review_body_check, pending_head, next_action,
    )
}

RANGES = """
rt AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '120' WHEN 1 THEN 'a-b' WHEN 2 THEN '1-2-3'
         ELSE ' ' || (o_orderkey % 7) * 20 || '-' || (o_orderkey % 11) * 25 || ' ' END AS range_text, 200.0::DOUBLE AS duration,
         (o_orderkey % 7) * 20 AS a, (o_orderkey % 11) * 25 AS b FROM orders),
re AS (SELECT *, CASE WHEN o_orderkey % 9 IN (0, 2) THEN 'format' WHEN o_orderkey % 9 = 1 THEN 'not-a-number'
         WHEN a >= b THEN 'empty' WHEN b > 200.5 THEN 'out-of-range' END AS error FROM rt)"""
INDEX = """
ix AS (SELECT o_custkey::VARCHAR AS video_id, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 4) * 10.0::DOUBLE END AS lo, lo + 50 AS hi,
         CASE WHEN lo IS NULL THEN 'full' ELSE replace(printf('%07.1f-%07.1f', lo, hi), '.', '_') END AS run,
         o_orderstatus AS st, o_orderkey AS k, o_orderpriority AS pr FROM orders),
xa AS (SELECT video_id, run, lo, hi, max(k) AS n_frames FROM ix WHERE st = 'F' GROUP BY ALL),
xb AS (SELECT video_id, run, lo, hi, max(k) AS n_frames FROM ix WHERE st <> 'F' GROUP BY ALL),
xl AS (SELECT DISTINCT video_id, run FROM ix WHERE pr <> '5-LOW'),
xm AS (SELECT * FROM xb UNION ALL SELECT * FROM xa WHERE NOT EXISTS (SELECT 1 FROM xb WHERE xb.video_id = xa.video_id AND xb.run = xa.run))"""
LEDGER = """
lr AS (SELECT o_custkey::VARCHAR AS video_id, 'full' AS run, o_orderkey % 3 * 1.5::DOUBLE AS "at", o_orderpriority AS reason, o_orderstatus AS st, o_orderkey AS k FROM orders),
le AS (SELECT video_id, run, "at", reason, min(k) AS request_no FROM lr WHERE st = 'F' GROUP BY ALL),
la AS (SELECT video_id, run, "at", reason, min(k) AS request_no FROM lr WHERE st <> 'F' GROUP BY ALL)"""
DUE = """
sg AS (SELECT o_custkey::VARCHAR AS video_id, max(o_orderkey) FILTER (o_orderkey % 3 = 0 AND o_orderstatus <> 'P') AS s,
         max(o_orderkey) FILTER (o_orderkey % 3 = 1 AND o_orderstatus <> 'P') AS t, max(o_orderkey) FILTER (o_orderkey % 3 = 2 AND o_orderstatus <> 'P') AS f FROM orders GROUP BY 1),
du AS (SELECT c_custkey::VARCHAR AS video_id, CASE WHEN s IS NULL THEN 'split' WHEN t IS NULL THEN 'transcribe' WHEN f IS NULL OR f < t THEN 'frames' END AS due
       FROM customer LEFT JOIN sg ON sg.video_id = c_custkey::VARCHAR)"""
REVIEWS = """
cx AS (SELECT doc_id, (doc_id // 3)::VARCHAR AS video_id, 'r' || doc_id % 3 AS run, doc_id % 3 AS position, text, sha256(text) AS sha FROM documents),
rv AS (SELECT c.*, quality, CASE WHEN doc_id % 9 <> 0 THEN CASE WHEN quality = 1 THEN sha ELSE sha256('old' || text) END END AS seen FROM cx c JOIN labels USING (doc_id)),
st AS (SELECT c.*, CASE WHEN r.doc_id IS NULL THEN 'missing' WHEN r.seen IS NULL THEN 'unreadable' WHEN r.seen = c.sha THEN 'current' ELSE 'stale' END AS state
       FROM cx c LEFT JOIN rv r USING (doc_id)),
pd AS (SELECT video_id, arg_min(run, position) AS run, arg_min(state, position) AS state, count(*) AS n_pending, string_agg(run, ',' ORDER BY position) AS pending
       FROM st WHERE state <> 'current' GROUP BY 1)"""

ORACLE = {
    "validate_range": f"WITH {RANGES} SELECT o_orderkey, range_text, duration, error, CASE WHEN error IS NULL THEN a::DOUBLE END AS lo, CASE WHEN error IS NULL THEN least(b, 200)::DOUBLE END AS hi FROM re",
    "run_name": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'full' ELSE
  replace(printf('%07.1f-%07.1f', (o_orderkey % 400) / 8.0::DOUBLE, (o_orderkey % 400) / 8.0::DOUBLE + 100.25::DOUBLE), '.', '_') END AS run FROM orders""",
    "distinct_ranges": """SELECT DISTINCT o_custkey::VARCHAR AS video_id, (o_orderkey % 4) * 10.0::DOUBLE AS lo, (o_orderkey % 4) * 10.0::DOUBLE + 50 AS hi,
  replace(printf('%07.1f-%07.1f', (o_orderkey % 4) * 10.0::DOUBLE, (o_orderkey % 4) * 10.0::DOUBLE + 50), '.', '_') AS run FROM orders""",
    "merge_run_index": f"""WITH {INDEX} SELECT video_id, run, lo, hi, n_frames, row_number() OVER (PARTITION BY video_id ORDER BY lo IS NOT NULL, lo, hi) - 1 AS position
FROM xm WHERE EXISTS (SELECT 1 FROM xl WHERE xl.video_id = xm.video_id AND xl.run = xm.run)""",
    "live_runs": f"WITH {INDEX} SELECT * FROM xa WHERE EXISTS (SELECT 1 FROM xl WHERE xl.video_id = xa.video_id AND xl.run = xa.run)",
    "request_ledger_upsert": f"""WITH {LEDGER} SELECT *, false AS is_new FROM le UNION ALL SELECT *, true FROM la
WHERE NOT EXISTS (SELECT 1 FROM le WHERE le.video_id = la.video_id AND le."at" = la."at" AND le.reason = la.reason)""",
    "source_changed": """SELECT p_partkey::VARCHAR AS video_id, CASE WHEN p_size <= 5 THEN 'new' WHEN p_size >= 45 THEN 'missing'
  WHEN p_retailprice > 1000 THEN 'changed' ELSE 'same' END AS state FROM part""",
    "subtitle_changed": """SELECT o_orderkey, o_orderstatus = 'F' AND ((o_orderkey % 3 <> 0) IS DISTINCT FROM (o_orderkey % 4 <> 0)
  OR (o_orderkey % 3 <> 0 AND o_orderkey % 2 <> o_orderkey % 5 % 2)) AS redo FROM orders""",
    "fingerprint_target": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'given/' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'beside/' || o_orderkey END AS target FROM orders",
    "stale_stages": f"WITH {DUE} SELECT * FROM du",
    "schema_gate": """SELECT doc_id, CASE WHEN doc_id % 6 <> 0 THEN source END AS schema_version,
  CASE WHEN doc_id % 6 = 0 THEN 'needs src1, found none' WHEN source <> 'src1' THEN 'needs src1, found ' || source END AS refused FROM documents""",
    "transcript_reuse": """WITH s AS (SELECT o_orderkey AS k, k % 5 <> 0 AND k % 7 <> 0 AND (k % 4 <> 0 OR (k % 8 = 0 AND k % 3 = 0)) AS reuse,
  CASE WHEN k % 2 = 0 THEN CASE WHEN k % 3 = 2 AND k % 11 <> 0 THEN 'other-model' WHEN k % 3 <> 2 THEN 'model-unused' END END AS m,
  CASE WHEN k % 13 IN (2, 3) THEN 'other-language' END AS l FROM orders)
SELECT k AS o_orderkey, reuse, CASE WHEN reuse THEN nullif(concat_ws(' / ', m, l), '') END AS note FROM s""",
    "clean_survey": """SELECT l_orderkey::VARCHAR AS video_id, coalesce(sum(len) FILTER (n = 0), 0)::BIGINT AS cache_bytes,
  coalesce(sum(len) FILTER (n IN (0, 1, 5)), 0)::BIGINT AS images_bytes, sum(len)::BIGINT AS total_bytes
FROM (SELECT l_orderkey, (l_linenumber - 1) % 7 AS n, trunc(l_extendedprice)::BIGINT AS len FROM lineitem) GROUP BY 1""",
    "context_fingerprint": f"WITH {REVIEWS} SELECT video_id, run, sha AS context_sha256 FROM cx",
    "review_status": f"WITH {REVIEWS} SELECT video_id, run, state FROM st",
    "review_header": f"""WITH {REVIEWS} SELECT doc_id, CASE WHEN seen IS NOT NULL THEN run END AS run, seen AS context_sha256,
  CASE WHEN seen IS NULL THEN 'no header here' ELSE '  review of ' || doc_id || chr(10) END AS body FROM rv""",
    "review_decide": f"""WITH {REVIEWS} SELECT doc_id, CASE WHEN seen IS NULL THEN 'create' WHEN doc_id % 2 = 0 AND seen = sha THEN 'unchanged' WHEN doc_id % 2 = 0 THEN 'refresh'
  WHEN seen <> sha OR doc_id % 5 = 0 THEN 'update' ELSE 'conflict' END AS action FROM rv""",
    "normalize_review": r"""SELECT doc_id, regexp_replace('  ' || replace(regexp_replace(text, '\r\n?', chr(10), 'g'), ' ', chr(10)),
  '[\s\v\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '') || chr(10) AS body FROM documents""",
    "review_body_check": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'empty' WHEN strlen(text) + CASE doc_id % 4 WHEN 1 THEN 30 ELSE 0 END > 2000 THEN 'too-large'
  WHEN doc_id % 4 = 1 THEN 'contains-marker' END AS refused FROM documents""",
    "pending_head": f"WITH {REVIEWS} SELECT video_id, run, state, n_pending, pending FROM pd",
    "next_action": f"""WITH {REVIEWS}, {DUE},
v AS (SELECT DISTINCT video_id FROM cx),
j AS (SELECT v.video_id, due, p.run, p.state, p.n_pending, p.pending, c.doc_id % 40 AS n_images, c.doc_id % 40 * 442 AS tokens,
        CASE WHEN due IS NOT NULL THEN 'run' WHEN p.run IS NOT NULL THEN 'read' ELSE 'done' END AS action
      FROM v LEFT JOIN du USING (video_id) LEFT JOIN pd p USING (video_id) LEFT JOIN cx c ON c.video_id = v.video_id AND c.run = p.run)
SELECT video_id, action, due AS stage, CASE WHEN action = 'read' THEN run END AS run, CASE WHEN action = 'read' THEN state END AS state,
  CASE WHEN action = 'read' THEN n_pending END AS n_pending, CASE WHEN action = 'read' THEN pending END AS pending,
  CASE WHEN action = 'read' THEN n_images END AS n_images, CASE WHEN action = 'read' THEN tokens END AS tokens FROM j""",
}
