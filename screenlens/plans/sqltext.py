"""Registered queries that are SQL text over the text functions of ``functions.sql``."""

from __future__ import annotations

from screenlens.functions import sql
from screenlens.operators import ranking
from screenlens.plans import lineage, subtitles

TARGET = subtitles.TARGETS
#: name -> (the query whose result it has, what its views are, SQL text); ``{}`` names the views
TEXTS = {
    "sql_clean_text": ("clean_text", ["pages"], "SELECT page_id, clean_text(html) AS text FROM {pages}"),
    "sql_voice_prefix": (
        "voice_prefix", ["conversations"],
        "SELECT conv_id, turn, voice_prefix(concat('<v ', role, '>', text)) AS text FROM {conversations}",
    ),
    "sql_decode_subtitle_bytes": (
        "decode_subtitle_bytes", ["conversations"],
        """SELECT conv_id, turn, d.text, d.encoding FROM (
             SELECT conv_id, turn, decode_subtitle_bytes(
               CASE WHEN conv_id % 2 = 1 THEN encode(text, 'UTF-16') ELSE encode(text, 'UTF-8') END) AS d
             FROM {conversations})""",
    ),
    "sql_timed_cues": (
        "parse_timed_blocks", ["subtitle_files"],
        """SELECT file_id, cast(n AS BIGINT) AS cue_no, round(cue.start, 3) AS start, round(cue.end, 3) AS end, cue.text
           FROM (SELECT file_id, timed_cues(text) AS cues FROM {subtitle_files}) LATERAL VIEW posexplode(cues) AS n, cue""",
    ),
    "sql_lang_normalize": ("lang_normalize", ["documents"], f"SELECT doc_id, lang_normalize({TARGET}) AS tag FROM {{documents}}"),
    "sql_lang_matches": (
        "lang_matches", ["documents"],
        f"SELECT doc_id, lang, {TARGET} AS target, lang_matches(lang, {TARGET}) AS matches FROM {{documents}}",
    ),
    "sql_language_mismatch": (
        "language_mismatch", ["documents"],
        f"""SELECT doc_id, language_mismatch(lang, {TARGET}) AS mismatch, target_origin({TARGET}, 'fr') AS target_from
            FROM {{documents}}""",
    ),
    "sql_language_tag": (
        "language_tag", ["matched"],
        "SELECT video_id, name, language_tag(name, prefix) AS language, forced_name(name) AS forced FROM {matched}",
    ),
    "sql_forced_name": ("forced_name", ["sidecars"], "SELECT dir, name, forced_name(name) AS forced FROM {sidecars}"),
    "sql_run_name": (
        "run_name", ["orders"],
        """SELECT o_orderkey, run_name(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 400 / 8.0D END,
                                       o_orderkey % 400 / 8.0D + 100.25D) AS run FROM {orders}""",
    ),
    "sql_safe_url": (
        "safe_url", ["pages"],
        """SELECT page_id, safe_url(CASE page_id % 5 WHEN 1 THEN concat('  ', upper(url), ' \\n') WHEN 2 THEN concat('see ', url)
             WHEN 3 THEN regexp_replace(url, '^https?', 'ftp') WHEN 4 THEN regexp_replace(url, '//[^/]+', '//') ELSE url END) AS url
           FROM {pages}""",
    ),
    "sql_normalize_review": (
        "normalize_review", ["documents"],
        """SELECT doc_id, normalize_review(concat('\\n\\n  ', replace(text, ' ', '\\r\\n'), '  \\r\\n\\n')) AS body
           FROM {documents}""",
    ),
}


def _view(c, name):
    if name == "matched":
        return ranking.sidecar_match(*subtitles._video_files(c))
    if name == "sidecars":
        return subtitles._video_files(c)[1]
    return subtitles._srt_files(c) if name == "subtitle_files" else c.table(name)


def _query(name):
    _, views, sql_text = TEXTS[name]

    def run(c):
        sql.register(c.spark)
        return c.spark.sql(sql_text, **{v: _view(c, v) for v in views})

    run.__name__ = name
    return run


QUERIES = {name: _query(name) for name in TEXTS}
ORACLE = {name: (lineage.ORACLE | subtitles.ORACLE)[like] for name, (like, _, _) in TEXTS.items()}
