"""The text helpers as functions that SQL text can call.

``register(spark)`` creates temporary functions whose bodies are the SQL of the column expressions themselves, so there is
one definition of each, and registers the pandas functions for what no expression can do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from screenlens.functions import lang, text, urls
from screenlens.operators import screens, subtitles

#: name -> (parameters with types, expression of columns of these names)
EXPRESSIONS: dict[str, tuple[str, Callable[..., Column]]] = {
    "clean_text": ("raw STRING", lambda raw: text.clean_text(raw, "basic")),
    "voice_prefix": ("body STRING", lambda body: text.voice_prefix(body, "basic")),
    "srt_time": ("seconds DOUBLE", text.srt_time),
    "stamp_seconds": ("stamp STRING", subtitles.stamp_seconds),
    "lang_normalize": ("tag STRING", lang.lang_normalize),
    "lang_matches": ("tag STRING, want STRING", lang.lang_matches),
    "language_mismatch": ("found STRING, target STRING", lang.language_mismatch),
    "target_origin": ("requested STRING, locale STRING", lang.target_origin),
    "language_tag": ("name STRING, prefix STRING", lang.language_tag),
    "forced_name": ("name STRING", lang.forced_name),
    "run_name": ("lo DOUBLE, hi DOUBLE", screens.run_name),
    "safe_url": ("value STRING", urls.safe_url),
    "normalize_review": ("body STRING", text.normalize_review),
    "review_body": ("review STRING", text.review_body),
}


def sql_of(spark: SparkSession, parameters: str, expression: Callable[..., Column]) -> str:
    """The expression over columns named like the parameters, as SQL text."""
    names = [p.split()[0] for p in parameters.split(", ")]
    nothing = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {p.split()[1]}) AS {p.split()[0]}" for p in parameters.split(", ")))
    plan = nothing.select(expression(*[F.col(n) for n in names]).alias("value"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


def timed_cues_sql(spark: SparkSession) -> str:
    """An SRT or VTT document as an array of (start, end, text) in order of time; see ``parse_timed_blocks``."""
    seconds = {n: sql_of(spark, f"{n} STRING", subtitles.stamp_seconds) for n in ("a", "b")}
    spoken = sql_of(spark, "body STRING", lambda body: text.voice_prefix(body, "basic"))
    skipped = ", ".join(f"'{word}'" for word in subtitles.NOT_CUES)

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"

    # Each step binds its result as the only element of an array, so that nothing is worked out twice.
    return rf"""
    transform(
      array_sort(filter(flatten(transform(
        split(regexp_replace(document, '\\r\\n?', '\n'), '\\n[ \\t]*\\n+'),
        (block, pos) -> flatten(transform(array(filter(split(block, '\n'), x -> x RLIKE '(?U)\\S')), ls ->
          flatten(transform(array(CAST(array_position(transform(ls, x -> contains(x, '-->')), true) AS INT)), arrow ->
            flatten(transform(array(regexp_extract_all(get(ls, arrow - 1), {quoted(subtitles.STAMP)}, 0)), stamps ->
              transform(
                filter(array(struct(get(stamps, 0) AS a, get(stamps, 1) AS b)), s -> arrow > 0 AND size(stamps) >= 2
                  AND NOT coalesce(upper(regexp_extract(try_element_at(ls, 1), '(?U)(\\S+)', 1)) IN ({skipped}), false)),
                s -> struct(
                  element_at(transform(array(s.a), a -> {seconds["a"]}), 1) AS start,
                  element_at(transform(array(s.b), b -> {seconds["b"]}), 1) AS end,
                  pos,
                  element_at(transform(array(array_join(slice(ls, arrow + 1, size(ls)), '\n')), body -> {spoken}), 1) AS text))
            ))))))
      )), cue -> cue.end > cue.start AND cue.text <> '')),
      cue -> struct(cue.start, cue.end, cue.text))"""


def register(spark: SparkSession) -> None:
    """Create all functions in the session; again if they are there."""
    for name, (parameters, expression) in EXPRESSIONS.items():
        body = sql_of(spark, parameters, expression)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION timed_cues(document STRING) RETURN {timed_cues_sql(spark)}"
    )
    spark.udf.register("unescape_entities", text.unescape_entities)
    spark.udf.register("decode_subtitle_bytes", text.decode_subtitle_bytes)
