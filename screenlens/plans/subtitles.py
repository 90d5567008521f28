"""Registered queries over subtitle text, quality, language and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenlens.functions import lang, text, urls
from screenlens.operators import documents, ranking, subtitles
from screenlens.operators.ordered import joined_text
from screenlens.plans.dialogue import SEGMENTS

TARGET = "de"


def clean_text(c):
    pages = c.table("pages")
    return pages.select("page_id", text.clean_text(F.col("html"), "basic").alias("text"))


def voice_prefix(c):
    body = F.concat(F.lit("<v "), "role", F.lit(">"), "text")
    return c.table("conversations").select("conv_id", "turn", text.voice_prefix(body, "basic").alias("text"))


def decode_subtitle_bytes(c):
    utf16 = F.col("conv_id") % 2 == 1
    data = F.when(utf16, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    decoded = c.table("conversations").withColumn("_d", text.decode_subtitle_bytes(data))
    return decoded.select("conv_id", "turn", "_d.text", "_d.encoding")


def _flat_cues(c):
    return c.segments.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))


def write_srt(c):
    return documents.srt_documents(_flat_cues(c))


def _srt_files(c):
    return write_srt(c).select(F.col("video_id").alias("file_id"), "text")


def parse_timed_blocks(c):
    parsed = subtitles.parse_timed_blocks(_srt_files(c), "basic")
    return parsed.withColumns({"start": F.round("start", 3), "end": F.round("end", 3)})


def _smi_files(c):
    """SAMI text from conversations: users and others in two classes, every third turn closed by an
    empty mark."""
    name = F.when(F.col("role") == "user", "KRCC").otherwise("ENCC")
    turns = c.table("conversations").withColumn("video_id", F.col("conv_id").cast("string"))
    said = F.format_string(
        "<SYNC Start=%d><P Class=%s>%s\n", F.col("turn") * 9000, name, F.col("text")
    )
    blank = F.format_string("<SYNC Start=%d><P Class=%s>&nbsp;\n", F.col("turn") * 9000 + 3000, name)
    mark = F.when(F.col("turn") % 3 == 2, F.concat(said, blank)).otherwise(said)
    body = joined_text(turns, ["video_id"], ["turn"], mark, "")
    return body.select(
        F.col("video_id").alias("file_id"),
        F.concat(F.lit("<SAMI><!-- <SYNC Start=5> --><BODY>"), "text", F.lit("</BODY></SAMI>")).alias("text"),
    )


def parse_smi_corpus(c):
    return subtitles.parse_smi_corpus(_smi_files(c), "basic")


def smi_notes(c):
    notes = subtitles.smi_notes(_smi_files(c), "basic")
    return notes.select("file_id", F.array_join("notes", "; ").alias("notes"))


def smi_class_pick(c):
    return subtitles.smi_class_pick(subtitles.smi_entries(_smi_files(c), "basic"))


def smi_end_times(c):
    marks = c.segments.select(
        "video_id", F.col("seg_no").alias("pos"), (F.col("seg_no") * 4.5).alias("start"),
        F.when(F.col("seg_no") % 3 == 2, "").otherwise(F.col("text")).alias("text"),
    )
    return subtitles.smi_end_times(marks, ["video_id"]).select("video_id", "pos", "start", "end", "capped")


def cue_order(c):
    shuffled = c.segments.select(
        "video_id", F.col("seg_no").alias("ord"), (F.col("seg_no") * 7 % 5).cast("double").alias("start"), "end"
    )
    return subtitles.cue_order(shuffled, ["video_id"])


def close_open_cues(c):
    cues = c.segments.select(
        "video_id", F.col("seg_no").alias("ord"), (F.col("start") / 4).alias("start"),
        F.when(F.col("seg_no") % 2 == 0, F.col("end") / 4).alias("end"),
    )
    return subtitles.close_open_cues(cues, ["video_id"])


def _files(c):
    return c.videos.select(F.col("video_id").alias("file_id"), "duration")


def _cues(c):
    """Segments as subtitle cues, with some files grown line by line, shifted or mostly silent."""
    conv = F.col("video_id").cast("long")
    end = F.when(conv % 7 == 5, F.col("start") + 0.5).otherwise(F.col("end"))
    shift = F.when(conv % 7 == 3, 100.0).otherwise(0.0)
    return c.segments.select(
        F.col("video_id").alias("file_id"),
        F.col("seg_no").alias("cue_no"),
        (F.col("start") + shift).alias("start"),
        (end + shift).alias("end"),
        F.when(conv % 5 == 0, F.expr("repeat('la ', cast(seg_no + 1 as int))")).otherwise(F.col("text")).alias("text"),
    )


def coverage_union(c):
    rows = subtitles.coverage_union(_cues(c), _files(c))
    return rows.select("file_id", F.round("covered", 6).alias("covered"), F.round("coverage", 6).alias("coverage"))


def rollup_ratio(c):
    return subtitles.rollup_ratio(_cues(c)).withColumn("rollup", F.round("rollup", 6))


def subtitle_quality(c):
    rows = subtitles.subtitle_quality(_cues(c), _files(c))
    return rows.withColumns({n: F.round(n, 6) for n in ("coverage", "rollup", "span_start", "span_end")})


def _documents(c):
    return c.table("documents").select("doc_id", "lang", "source", "n_chars")


def _target(doc_id):
    return F.element_at(
        F.array(*[F.lit(x) for x in ("ko", "de-DE", "deu", "FRA", "en_US", None)]), (doc_id % 6 + 1).cast("int")
    )


def lang_matches(c):
    return _documents(c).select(
        "doc_id", "lang", _target(F.col("doc_id")).alias("target"),
        lang.lang_matches(F.col("lang"), _target(F.col("doc_id"))).alias("matches"),
    )


def lang_normalize(c):
    return _documents(c).select("doc_id", lang.lang_normalize(_target(F.col("doc_id"))).alias("tag"))


def language_mismatch(c):
    return _documents(c).select(
        "doc_id", lang.language_mismatch(F.col("lang"), _target(F.col("doc_id"))).alias("mismatch"),
        lang.target_origin(_target(F.col("doc_id")), F.lit("fr")).alias("target_from"),
    )


def _video_files(c):
    k = F.floor(F.col("doc_id") / 5).cast("string")
    docs = _documents(c).select("doc_id", "lang", F.col("source").alias("dir"), k.alias("k"))
    form = F.col("doc_id") % 5
    stem = F.concat(F.lit("v"), "k")
    name = (
        F.when(form == 0, F.concat(stem, F.lit(".srt")))
        .when(form == 1, F.concat(stem, F.lit("."), "lang", F.lit(".forced.SRT")))
        .when(form == 2, F.concat(stem, F.lit(".mkv.srt")))
        .when(form == 3, F.concat(stem, F.lit(".mkv."), "lang", F.lit(".vtt")))
        .otherwise(F.concat(F.lit("w"), "k", F.lit(".smi")))
    )
    videos = docs.select(
        F.concat_ws("/", "dir", "k").alias("video_id"), "dir", F.concat(stem, F.lit(".mkv")).alias("name")
    ).distinct()
    return videos, docs.select("dir", name.alias("name"))


def sidecar_match(c):
    return ranking.sidecar_match(*_video_files(c))


def language_tag(c):
    matched = ranking.sidecar_match(*_video_files(c))
    return ranking.sidecar_candidates(matched).select("video_id", "name", "language", "forced")


def forced_name(c):
    _, files = _video_files(c)
    return files.select("dir", "name", lang.forced_name(F.col("name")).alias("forced"))


def _tracks(c):
    return c.table("lineitem").select(
        F.col("l_orderkey").cast("string").alias("video_id"),
        F.col("l_linenumber").alias("track"),
        F.col("l_linestatus").alias("codec"),
        F.when(F.col("l_returnflag") == "A", "und").when(F.col("l_returnflag") == "N", "KOR").otherwise("").alias("language"),
        (F.col("l_partkey") % 256).cast("int").alias("disposition"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_linestatus") == "F").alias("is_text"),
        (F.col("l_quantity").cast("long") % 5).alias("n_cues"),
    )


def embedded_track_filter(c):
    return ranking.embedded_track_filter(_tracks(c)).drop("codec", "is_text")


def candidate_pools(c):
    """Embedded tracks and sidecars as one list of candidates."""
    sidecars = ranking.sidecar_candidates(ranking.sidecar_match(*_video_files(c)))
    embedded = ranking.embedded_candidates(ranking.embedded_track_filter(_tracks(c)))
    return ranking.candidate_pools(sidecars, embedded).select("video_id", "kind", "path", "label")


def _candidates(c):
    doc = F.col("doc_id")
    form = F.element_at(F.array(F.lit("srt"), F.lit("vtt"), F.lit("smi")), (doc % 3 + 1).cast("int"))
    sidecar = F.substring("source", 4, 5).cast("int") % 2 == 0
    name = F.concat(F.lit("d"), doc.cast("string"), F.lit("."), form)
    return _documents(c).select(
        F.floor(doc / 5).cast("string").alias("video_id"),
        F.when(sidecar, "sidecar").otherwise("embedded").alias("kind"),
        F.when(sidecar, F.concat_ws("/", "source", name))
        .otherwise(F.format_string("subs/track%d.srt", doc % 6))
        .alias("path"),  # the tracks of all videos have the same paths
        name.alias("name"),
        form.alias("format"),
        F.when(doc % 5 != 2, F.col("lang")).alias("language"),
        F.concat(F.lit("candidate "), name).alias("label"),
        (doc % 7 == 0).alias("forced"),
        (~sidecar & (doc % 4 == 0)).alias("is_default"),
        F.when(~sidecar, (doc % 6).cast("int")).alias("track"),
        doc.alias("doc_id"),
    )


def _judged(c):
    """Quality by video and path from the labels; unlabelled documents have no verdict."""
    labelled = _candidates(c).select("doc_id", "video_id", "path").join(c.table("labels"), "doc_id")
    ok = F.col("quality") == 1
    return labelled.select(
        "video_id", "path", ok.alias("ok"), F.when(~ok, "partial").alias("reason"),
        (F.col("doc_id") % 4).alias("n_cues"),
        F.lit(0.5).alias("coverage"), F.lit(0.0).alias("span_start"), F.lit(9.0).alias("span_end"),
    )


def _videos(c):
    ids = _candidates(c).select("video_id").distinct()
    return ids.select("video_id", (F.col("video_id").cast("long") % 2 == 0).alias("has_audio"))


def _ranked(c):
    return ranking.rank_subtitles(_candidates(c), TARGET)


def rank_subtitles(c):
    return _ranked(c).select("video_id", "path", "rank")


def choose_subtitle(c):
    chosen = ranking.choose_subtitle(_ranked(c), _judged(c), _videos(c))
    return chosen.withColumn("track", F.col("track").cast("long"))


def rejection_notes(c):
    ranked, judged = _ranked(c), _judged(c)
    return ranking.rejection_notes(ranked, judged, ranking.choose_subtitle(ranked, judged, _videos(c)))


def choice_notes(c):
    ranked = _ranked(c)
    chosen = ranking.choose_subtitle(ranked, _judged(c), _videos(c))
    return ranking.choice_notes(ranked, chosen).withColumn("note_no", F.col("note_no").cast("long"))


def explicit_waiver(c):
    named = _candidates(c).groupBy("video_id").agg(F.min_by("path", "doc_id").alias("path"))
    return ranking.explicit_waiver(named, _judged(c))


def transcript_source(c):
    judged = _judged(c)
    ranked = _ranked(c)
    chosen = ranking.choose_subtitle(ranked, judged, _videos(c))
    notes = [ranking.choice_notes(ranked, chosen), ranking.rejection_notes(ranked, judged, chosen)]
    rows = ranking.transcript_source(chosen, judged, TARGET, True, notes)
    return rows.select(
        "video_id", "kind", "path", "language", "target_language", "language_mismatch", "n_cues", "coverage",
        F.col("span.end").alias("span_end"), F.array_join("notes", " / ").alias("notes"),
    )


def safe_url(c):
    pages = c.table("pages").withColumn("k", F.col("page_id") % 5)
    value = (
        F.when(F.col("k") == 1, F.concat(F.lit("  "), F.upper("url"), F.lit(" \n")))
        .when(F.col("k") == 2, F.concat(F.lit("see "), "url"))
        .when(F.col("k") == 3, F.regexp_replace("url", "^https?", "ftp"))
        .when(F.col("k") == 4, F.regexp_replace("url", "//[^/]+", "//"))
        .otherwise(F.col("url"))
    )
    return pages.select("page_id", urls.safe_url(value).alias("url"))


def origin_url(c):
    p = F.col("page_id")
    url = F.col("url")
    full = F.when(p % 4 == 0, F.to_json(F.struct(F.lit("file:///etc").alias("webpage_url"), url.alias("original_url")))).when(
        p % 4 == 1, F.concat(F.lit('{"url": "'), url)
    )
    stem = F.when(p % 3 == 0, F.to_json(F.struct(F.concat(url, F.lit("#stem")).alias("url"))))
    tags = F.create_map(F.lit("COMMENT"), F.concat(url, F.lit("#tag")), F.lit("Purl"), F.lit("not a url"))
    return c.table("pages").select("page_id", urls.origin_url(full, stem, tags).alias("_o")).select("page_id", "_o.*")


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, voice_prefix, decode_subtitle_bytes, write_srt, parse_timed_blocks, parse_smi_corpus, smi_notes,
        smi_class_pick, smi_end_times, cue_order, close_open_cues, coverage_union, rollup_ratio,
        subtitle_quality, lang_matches, lang_normalize, language_mismatch, sidecar_match, language_tag,
        forced_name, embedded_track_filter, candidate_pools, rank_subtitles, choose_subtitle,
        rejection_notes, choice_notes, explicit_waiver, transcript_source, safe_url, origin_url,
    )
}

FLAT = SEGMENTS + r""",
flat AS (SELECT video_id, seg_no, start, "end", trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM seg)"""
STAMP = """printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000)"""
SMI = r"""
cn AS (SELECT conv_id::VARCHAR AS file_id, turn, CASE role WHEN 'user' THEN 'KRCC' ELSE 'ENCC' END AS class,
              trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations),
en AS (SELECT file_id, turn * 9.0::DOUBLE AS start, class, text FROM cn
       UNION ALL SELECT file_id, turn * 9.0::DOUBLE + 3, class, '' FROM cn WHERE turn % 3 = 2),
cl AS (SELECT file_id, class, count(*) FILTER (text <> '') AS n, min(start) AS f FROM en GROUP BY 1, 2),
pk AS (SELECT file_id, arg_max(class, struct_pack(n := n, f := -f)) AS class, arg_max(n, struct_pack(n := n, f := -f)) AS n_texts, count(*) AS n_classes FROM cl GROUP BY 1)"""
#: From cues (cu) and videos (vid) to their coverage (cov) and roll-up ratio (rol).
MEASURED = """cp AS (SELECT c.file_id, c.cue_no, greatest(start, 0) AS a, least("end", duration) AS b FROM cu c JOIN vid v ON v.video_id = c.file_id),
isl AS (SELECT *, max(b) OVER (PARTITION BY file_id ORDER BY a, cue_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cp WHERE b > a),
isn AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY a, cue_no) AS g FROM isl),
cov AS (SELECT v.video_id AS file_id, coalesce(sum(len), 0) AS covered, coalesce(sum(len), 0) / any_value(duration) AS coverage
        FROM vid v LEFT JOIN (SELECT file_id, g, max(b) - min(a) AS len FROM isn GROUP BY 1, 2) i ON i.file_id = v.video_id GROUP BY 1),
low AS (SELECT file_id, cue_no, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS now FROM cu),
lag_ AS (SELECT *, lag(now) OVER (PARTITION BY file_id ORDER BY cue_no) AS was FROM low),
rol AS (SELECT file_id, coalesce(count(*) FILTER (was <> '' AND starts_with(now, was)) / nullif(count(was), 0)::DOUBLE, 0) AS rollup FROM lag_ GROUP BY 1)"""
#: From those to a verdict per file (r).
VERDICTS = """
q AS (SELECT c.file_id, any_value(v.duration) AS duration, count(*) AS n_cues, min(start) AS a, max("end") AS b FROM cu c JOIN vid v ON v.video_id = c.file_id GROUP BY 1),
r AS (SELECT *, CASE WHEN n_cues < 5 THEN 'too-few-cues' WHEN rollup > 0.3 THEN 'auto-generated' WHEN b > duration * 1.1::DOUBLE + 5 OR a < -5 THEN 'other-video'
        WHEN coverage < 0.3 THEN 'partial' END AS reason FROM q JOIN cov USING (file_id) JOIN rol USING (file_id))"""
CUES = SEGMENTS + """,
cu AS (SELECT video_id AS file_id, seg_no AS cue_no,
              start + CASE video_id::INT % 7 WHEN 3 THEN 100.0::DOUBLE ELSE 0 END AS start,
              CASE video_id::INT % 7 WHEN 5 THEN start + 0.5::DOUBLE ELSE "end" END + CASE video_id::INT % 7 WHEN 3 THEN 100.0::DOUBLE ELSE 0 END AS "end",
              CASE video_id::INT % 5 WHEN 0 THEN repeat('la ', seg_no + 1) ELSE text END AS text FROM seg),
""" + MEASURED
TARGETS = "CASE doc_id % 6 WHEN 0 THEN 'ko' WHEN 1 THEN 'de-DE' WHEN 2 THEN 'deu' WHEN 3 THEN 'FRA' WHEN 4 THEN 'en_US' END"
MATCHES = f"""
lg AS (SELECT doc_id, lang, {TARGETS} AS target FROM documents),
ln AS (SELECT *, lower(lang) AS a, lower(replace(target, '_', '-')) AS b FROM lg),
lm AS (SELECT *, coalesce(a = b OR split_part(a, '-', 1) = split_part(b, '-', 1)
         OR (length(split_part(a, '-', 1)) = 2 AND length(split_part(b, '-', 1)) = 3 AND starts_with(split_part(b, '-', 1), split_part(a, '-', 1)))
         OR (length(split_part(b, '-', 1)) = 2 AND length(split_part(a, '-', 1)) = 3 AND starts_with(split_part(a, '-', 1), split_part(b, '-', 1))), false) AS matches FROM ln)"""
FILES = """
fi AS (SELECT source AS dir, lang, doc_id // 5 AS k, doc_id % 5 AS form,
         CASE doc_id % 5 WHEN 0 THEN 'v' || k || '.srt' WHEN 1 THEN 'v' || k || '.' || lang || '.forced.SRT' WHEN 2 THEN 'v' || k || '.mkv.srt'
              WHEN 3 THEN 'v' || k || '.mkv.' || lang || '.vtt' ELSE 'w' || k || '.smi' END AS name FROM documents),
vi AS (SELECT DISTINCT dir || '/' || k AS video_id, dir, 'v' || k || '.mkv' AS name FROM fi),
sm AS (SELECT DISTINCT v.video_id, f.dir, f.name, CASE f.form WHEN 3 THEN 'vtt' ELSE 'srt' END AS format,
         CASE WHEN starts_with(f.name, v.name || '.') THEN v.name || '.' ELSE replace(v.name, '.mkv', '.') END AS prefix,
         CASE WHEN f.form IN (1, 3) THEN f.lang END AS language, f.form = 1 AS forced
       FROM fi f JOIN vi v ON v.dir = f.dir AND starts_with(f.name, replace(v.name, '.mkv', '.')))"""
TRACKS = """
tr AS (SELECT l_orderkey::VARCHAR AS video_id, l_linenumber AS track, l_linestatus AS codec, CASE l_returnflag WHEN 'N' THEN 'KOR' END AS language,
         l_partkey % 256 AS disposition, l_quantity::BIGINT % 5 AS n_cues, (l_partkey % 256) & 1 <> 0 AS is_default,
         (l_partkey % 256) & 64 <> 0 AS forced, (l_partkey % 256) & 128 <> 0 AS hearing_impaired,
         CASE WHEN l_suppkey % 10 = 0 THEN 'unknown-codec' WHEN l_linestatus <> 'F' THEN 'bitmap' WHEN (l_partkey % 256) & 64 <> 0 THEN 'forced'
              WHEN l_quantity::BIGINT % 5 <= 0 THEN 'no-cues' END AS skipped FROM lineitem)"""
RANKED = f"""
ca AS (SELECT (doc_id // 5)::VARCHAR AS video_id, doc_id, CASE WHEN substr(source, 4)::INT % 2 = 0 THEN 'sidecar' ELSE 'embedded' END AS kind,
         CASE doc_id % 3 WHEN 0 THEN 'srt' WHEN 1 THEN 'vtt' ELSE 'smi' END AS format, 'd' || doc_id || '.' || format AS name,
         CASE kind WHEN 'sidecar' THEN source || '/' || name ELSE 'subs/track' || doc_id % 6 || '.srt' END AS path, CASE WHEN doc_id % 5 <> 2 THEN lang END AS language, 'candidate ' || name AS label,
         doc_id % 7 = 0 AS forced, kind = 'embedded' AND doc_id % 4 = 0 AS is_default, CASE kind WHEN 'embedded' THEN doc_id % 6 END AS track
       FROM documents),
rk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN language = '{TARGET}' THEN 0 WHEN language IS NULL THEN 1 ELSE 2 END,
         kind = 'embedded', forced, NOT is_default, doc_id % 3, coalesce(track, -1), name, path) AS rank FROM ca),
ju AS (SELECT video_id, path, quality = 1 AS ok, CASE WHEN quality <> 1 THEN 'partial' END AS reason, doc_id % 4 AS n_cues FROM ca JOIN labels USING (doc_id)),
tk AS (SELECT video_id, min(rank) AS rank FROM rk JOIN ju USING (video_id, path) WHERE ok GROUP BY 1),
nc AS (SELECT video_id, count(*) AS n FROM rk GROUP BY 1),
ch AS (SELECT nc.video_id, coalesce(r.kind, CASE WHEN nc.video_id::INT % 2 = 0 THEN 'whisper' ELSE 'none' END) AS kind, r.path, r.format, r.language,
              r.label, r.track, r.rank, nc.n AS n_candidates, coalesce(r.rank - 1, nc.n) AS n_rejected, r.forced
       FROM nc LEFT JOIN tk USING (video_id) LEFT JOIN rk r ON r.video_id = tk.video_id AND r.rank = tk.rank)"""
NOTES = """,
cn_ AS (SELECT c.video_id, 0 AS note_no, 'chosen from ' || c.n_candidates || ' candidates: ' || c.label || ' (by language, then files beside the video, unforced, default, format, track number and name / others: '
  || string_agg(r.label, ', ' ORDER BY r.rank) AS note FROM ch c JOIN rk r ON r.video_id = c.video_id AND r.rank <> c.rank WHERE c.rank IS NOT NULL GROUP BY c.video_id, c.n_candidates, c.label
UNION ALL SELECT video_id, 1, label || ': the name says forced, it may hold only part of the dialogue' FROM ch WHERE forced),
rn_ AS (SELECT r.video_id, r.rank, concat_ws(': ', r.label, j.reason) AS note FROM rk r LEFT JOIN ju j USING (video_id, path)
JOIN ch c ON c.video_id = r.video_id WHERE c.rank IS NULL OR r.rank < c.rank)"""

ORACLE = {
    "clean_text": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\{\\[^}]*\}', '', 'g'), '<\d{1,2}:\d{2}(?::\d{2})?[.,]\d{1,3}>', '', 'g'),
    '(?i)<br\s*/?>', ' ', 'g'), '(?i)</?(?:i|b|u|s|em|strong|font|c|v|lang|ruby|rt|rp|p|body|sami|head|title|style|sync)\b[^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'),
  '[\s\v\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS text FROM pages""",
    "voice_prefix": r"""SELECT conv_id, turn, role || ': ' || trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')) AS text FROM conversations""",
    "decode_subtitle_bytes": "SELECT conv_id, turn, text, CASE conv_id % 2 WHEN 1 THEN 'utf-16' ELSE 'utf-8' END AS encoding FROM conversations",
    "write_srt": f"""WITH {FLAT}, m AS (SELECT *, round_even(start * 1000, 0)::BIGINT AS sms, round_even("end" * 1000, 0)::BIGINT AS ems,
  row_number() OVER (PARTITION BY video_id ORDER BY seg_no) AS n FROM flat)
SELECT video_id, string_agg(n || chr(10) || {STAMP.replace("ms ", "sms ")} || ' --> ' || {STAMP.replace("ms ", "ems ")}
  || chr(10) || text || chr(10), chr(10) ORDER BY seg_no) AS text FROM m GROUP BY 1""",
    "parse_timed_blocks": f"""WITH {FLAT}
SELECT video_id AS file_id, row_number() OVER (PARTITION BY video_id ORDER BY start, "end", seg_no) - 1 AS cue_no, round(start, 3) AS start, round("end", 3) AS "end", text
FROM flat WHERE text <> ''""",
    "parse_smi_corpus": f"""WITH {SMI},
nx AS (SELECT *, lead(start) OVER (PARTITION BY file_id ORDER BY start) AS nxt FROM en),
ou AS (SELECT n.file_id, n.start, least(coalesce(nxt, n.start + 7), n.start + 7) AS "end", n.text FROM nx n JOIN pk USING (file_id) WHERE n.class = pk.class AND n.text <> '')
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY start, "end") - 1 AS cue_no, start, "end", text FROM ou""",
    "smi_notes": f"""WITH {SMI},
nx AS (SELECT *, lead(start) OVER (PARTITION BY file_id ORDER BY start) AS nxt FROM en),
ct AS (SELECT n.file_id, count(*) AS n FROM nx n JOIN pk USING (file_id) WHERE n.class = pk.class AND n.text <> '' AND nxt > n.start + 7 GROUP BY 1)
SELECT file_id, concat_ws('; ', CASE WHEN n_classes > 1 THEN n_classes || ' language classes, ' || class || ' taken' END,
                          CASE WHEN n > 0 THEN n || ' cues without an end of their own cut to 7 s' END) AS notes
FROM pk LEFT JOIN ct USING (file_id) WHERE n_classes > 1 OR n > 0""",
    "smi_class_pick": f"WITH {SMI} SELECT * FROM pk",
    "smi_end_times": f"""WITH {SEGMENTS}, s AS (SELECT video_id, seg_no AS pos, seg_no * 4.5::DOUBLE AS start, seg_no % 3 = 2 AS blank FROM seg),
n AS (SELECT *, lead(start) OVER (PARTITION BY video_id ORDER BY start) AS nxt FROM s)
SELECT video_id, pos, start, least(coalesce(nxt, start + 7), start + 7) AS "end", coalesce(nxt > start + 7, false) AS capped FROM n WHERE NOT blank""",
    "cue_order": f"""WITH {SEGMENTS}, s AS (SELECT video_id, seg_no AS ord, (seg_no * 7 % 5)::DOUBLE AS start, "end" FROM seg)
SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, "end", ord) - 1 AS cue_no FROM s""",
    "close_open_cues": f"""WITH {SEGMENTS}, s AS (SELECT video_id, seg_no AS ord, start / 4 AS start, CASE WHEN seg_no % 2 = 0 THEN "end" / 4 END AS e FROM seg),
n AS (SELECT *, lead(start) OVER (PARTITION BY video_id ORDER BY start, ord) AS nxt FROM s)
SELECT video_id, ord, start, coalesce(e, least(start + 2, coalesce(nxt, start + 2))) AS "end" FROM n""",
    "coverage_union": f"WITH {CUES} SELECT file_id, round(covered, 6) AS covered, round(coverage, 6) AS coverage FROM cov",
    "rollup_ratio": f"WITH {CUES} SELECT file_id, round(rollup, 6) AS rollup FROM rol",
    "subtitle_quality": f"""WITH {CUES},{VERDICTS}
SELECT file_id, reason IS NULL AS ok, reason, n_cues, round(coverage, 6) AS coverage, round(a, 6) AS span_start, round(b, 6) AS span_end, round(rollup, 6) AS rollup FROM r""",
    "lang_matches": f"WITH {MATCHES} SELECT doc_id, lang, target, matches FROM lm",
    "lang_normalize": f"WITH {MATCHES} SELECT doc_id, b AS tag FROM lm",
    "language_mismatch": f"WITH {MATCHES} SELECT doc_id, b IS NOT NULL AND NOT matches AS mismatch, CASE WHEN b IS NOT NULL THEN 'requested' ELSE 'locale' END AS target_from FROM lm",
    "sidecar_match": f"WITH {FILES} SELECT video_id, dir, name, format, prefix FROM sm",
    "language_tag": f"WITH {FILES} SELECT video_id, name, language, forced FROM sm",
    "forced_name": f"WITH {FILES} SELECT dir, name, form = 1 AS forced FROM fi",
    "embedded_track_filter": f"WITH {TRACKS} SELECT video_id, track, language, disposition, n_cues, is_default, forced, hearing_impaired, skipped FROM tr",
    "candidate_pools": f"""WITH {FILES}, {TRACKS}
SELECT video_id, 'sidecar' AS kind, dir || '/' || name AS path, 'sidecar ''' || name || '''' AS label FROM sm
UNION ALL SELECT video_id, 'embedded', 'subs/track' || track || '.srt', 'embedded track ' || track || '(' || codec || ')' FROM tr WHERE skipped IS NULL""",
    "rank_subtitles": f"WITH {RANKED} SELECT video_id, path, rank FROM rk",
    "choose_subtitle": f"WITH {RANKED} SELECT video_id, kind, path, format, language, label, track, rank, n_candidates, n_rejected FROM ch",
    "rejection_notes": f"WITH {RANKED}{NOTES} SELECT * FROM rn_",
    "choice_notes": f"WITH {RANKED}{NOTES} SELECT * FROM cn_",
    "explicit_waiver": f"""WITH {RANKED}, nm AS (SELECT video_id, arg_min(path, doc_id) AS path FROM ca GROUP BY 1)
SELECT video_id, path, coalesce(n_cues, 0) <> 0 AS used, CASE WHEN coalesce(n_cues, 0) = 0 THEN 'no dialogue in this file'
  WHEN NOT ok THEN 'used because it was named; otherwise refused: ' || reason END AS note FROM nm LEFT JOIN ju USING (video_id, path)""",
    "transcript_source": f"""WITH {RANKED}{NOTES},
nt AS (SELECT video_id, 0 AS o, note_no AS n, note FROM cn_ UNION ALL SELECT video_id, 1, rank, note FROM rn_),
ns AS (SELECT video_id, string_agg(note, ' / ' ORDER BY o, n) AS notes FROM nt GROUP BY 1)
SELECT video_id, kind, path, language, '{TARGET}' AS target_language, language IS NOT NULL AND language <> '{TARGET}' AS language_mismatch,
  coalesce(n_cues, 0) AS n_cues, CASE WHEN n_cues IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS coverage,
  CASE WHEN n_cues IS NOT NULL THEN 9.0::DOUBLE END AS span_end, coalesce(notes, '') AS notes
FROM ch LEFT JOIN ju USING (video_id, path) LEFT JOIN ns USING (video_id)""",
    "safe_url": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN upper(url) END AS url FROM pages",
    "origin_url": """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 3 = 0 THEN url || '#stem' ELSE url || '#tag' END AS url,
  CASE WHEN page_id % 4 = 0 OR page_id % 3 = 0 THEN 'info-json' ELSE 'container' END AS url_from FROM pages""",
}
