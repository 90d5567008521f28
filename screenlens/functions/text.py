"""Text expressions for subtitle markup and review files."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlens import params as P

# Which markup counts as markup.
OVERRIDE = r"\{\\[^}]*\}"
INLINE_TIME = r"<\d{1,2}:\d{2}(?::\d{2})?[.,]\d{1,3}>"
LINE_BREAK = r"(?i)<br\s*/?>"
KNOWN_TAGS = (
    "i", "b", "u", "s", "em", "strong", "font", "c", "v", "lang",
    "ruby", "rt", "rp", "p", "body", "sami", "head", "title", "style", "sync",
)
TAG = r"(?i)</?(?:" + "|".join(KNOWN_TAGS) + r")\b[^>]*>"
VOICE = r"(?i)<v(?:\.[^\s>]+)*\s+([^>]+)>"
SPACE = r"(?U)[\s\x{00A0}]+"
BASIC_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")]


@F.pandas_udf(T.StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def clean_text(raw: Column, entities: str | None = "all") -> Column:
    """One subtitle line without markup. Entities are resolved once and after the tags, so text that
    was written as an escaped tag survives. ``entities``: "all", "basic" (five common ones, without
    leaving the JVM) or None."""
    bare = F.regexp_replace(raw, OVERRIDE, "")
    bare = F.regexp_replace(bare, INLINE_TIME, "")
    bare = F.regexp_replace(bare, LINE_BREAK, " ")
    bare = F.regexp_replace(bare, TAG, "")
    if entities == "all":
        bare = unescape_entities(bare)
    elif entities == "basic":
        for name, char in BASIC_ENTITIES:
            bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, SPACE, " "))


def voice_name(body: Column) -> Column:
    """Speaker named by the first voice tag, or null."""
    return F.nullif(F.regexp_extract(body, VOICE, 1), F.lit(""))


def voice_prefix(body: Column, entities: str | None = "all") -> Column:
    """Clean text with ``Name: `` in front when the cue names its speaker."""
    speaker = voice_name(body)
    return F.when(speaker.isNull(), clean_text(body, entities)).otherwise(
        F.trim(F.concat(clean_text(speaker, entities), F.lit(": "), clean_text(body, entities)))
    )


DECODED = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]
)


@F.pandas_udf(DECODED)
def decode_subtitle_bytes(data: pd.Series) -> pd.DataFrame:
    """A byte order mark decides; otherwise UTF-8, then CP949, then Latin-1 (never fails)."""
    return pd.DataFrame([_decode(b) for b in data], columns=["text", "encoding"])


def _decode(data: bytes | None) -> tuple[str | None, str | None]:
    if data is None:
        return None, None
    attempts = ["utf-8", "cp949", "latin-1"]
    if data[:3] == b"\xef\xbb\xbf":
        attempts.insert(0, "utf-8-sig")
    elif data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        attempts.insert(0, "utf-16")
    for name in attempts:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            pass
    return None, None


def srt_time(seconds: Column) -> Column:
    ms = F.greatest(F.bround(seconds * 1000).cast("long"), F.lit(0).cast("long"))
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(ms / 3600000),
        F.floor(ms / 60000) % 60,
        F.floor(ms / 1000) % 60,
        ms % 1000,
    )


def normalize_review(text: Column) -> Column:
    body = F.regexp_replace(text, r"\A\x{FEFF}+", "")
    body = F.regexp_replace(body, r"\r\n?", "\n")
    body = F.regexp_replace(body, r"\A\n+", "")
    return F.concat(F.regexp_replace(body, r"(?U)\s+\z", ""), F.lit("\n"))


HEADER = rf"(?s)\Q{P.REVIEW_BEGIN}\E\s*\n<!--\s*(\{{.*?\}})\s*-->"
HEADER_BLOCK = rf"(?s)\A(.*?)\Q{P.REVIEW_BEGIN}\E.*?\Q{P.REVIEW_END}\E\n*"
HEADER_TYPE = (
    "schema string, run string, context string, context_sha256 string, at string, version string"
)


def review_header(text: Column) -> Column:
    """The header record, or null when it is missing, broken or of another schema."""
    raw = F.nullif(F.regexp_extract(text, HEADER, 1), F.lit(""))
    sound = F.try_parse_json(raw).isNotNull()
    parsed = F.from_json(raw, HEADER_TYPE)
    return F.when(sound & (parsed["schema"] == P.REVIEW_SCHEMA), parsed)


def review_body(text: Column) -> Column:
    """Text without the first header block and its trailing blank lines."""
    return F.regexp_replace(F.regexp_replace(text, HEADER_BLOCK, "$1"), r"\A\n+", "")


def compose_review(body: Column, run: Column, context: Column, sha: Column, at: Column, version: Column) -> Column:
    meta = F.to_json(
        F.struct(
            F.lit(P.REVIEW_SCHEMA).alias("schema"),
            run.alias("run"),
            context.alias("context"),
            sha.alias("context_sha256"),
            at.alias("at"),
            version.alias("version"),
        )
    )
    return F.concat(
        F.lit(P.REVIEW_BEGIN + "\n<!-- "), meta, F.lit(" -->\n# "), run,
        F.lit("\n" + P.REVIEW_END + "\n"), normalize_review(body),
    )
