"""Language tags: form, equality and what a file name declares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,4})?$"
FORCED = r"(?i)(^|[.\-_])forced([.\-_]|$)"


def lang_normalize(tag: Column) -> Column:
    return F.nullif(F.lower(F.translate(F.trim(tag), "_", "-")), F.lit(""))


def lang_matches(tag: Column, want: Column) -> Column:
    """Same code, same primary subtag, or a two-letter code that starts the three-letter one.
    Unknown on either side is never a match."""
    a, b = lang_normalize(tag), lang_normalize(want)
    pa, pb = F.substring_index(a, "-", 1), F.substring_index(b, "-", 1)
    short_long = ((F.length(pa) == 2) & (F.length(pb) == 3) & F.startswith(pb, pa)) | (
        (F.length(pb) == 2) & (F.length(pa) == 3) & F.startswith(pa, pb)
    )
    return F.coalesce((a == b) | (pa == pb) | short_long, F.lit(False))


def language_mismatch(found: Column, target: Column) -> Column:
    """True only when both are known and differ."""
    known = lang_normalize(found).isNotNull() & lang_normalize(target).isNotNull()
    return known & ~lang_matches(found, target)


def target_origin(requested: Column, locale: Column) -> Column:
    return F.when(lang_normalize(requested).isNotNull(), F.lit("requested")).when(
        lang_normalize(locale).isNotNull(), F.lit("locale")
    )


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def language_tag(name: Column, prefix: Column | None = None) -> Column:
    """Tag a subtitle name declares. After the video's prefix only the first dotted piece counts;
    without a prefix (or when it does not fit) the last one."""
    base = stem(name)
    dotted = F.concat(base, F.lit("."))
    tail = F.when(F.contains(base, F.lit(".")), F.substring_index(base, ".", -1)).otherwise("")
    if prefix is None:
        piece = tail
    else:
        rest = F.substring_index(F.substr(dotted, F.length(prefix) + 1), ".", 1)
        fits = (F.coalesce(prefix, F.lit("")) != "") & F.startswith(dotted, prefix)
        piece = F.when(fits, rest).otherwise(tail)
    return F.when(piece.rlike(TAG), lang_normalize(piece))


def forced_name(name: Column) -> Column:
    return stem(name).rlike(FORCED)
