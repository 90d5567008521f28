"""Searchable sections and the documents made of them.

A document is a set of ordered text pieces; ``joined_text`` puts them together, one row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlens.functions.rounding import exact_round
from screenlens.functions.text import srt_time
from screenlens.operators.budget import read_path
from screenlens.operators.ordered import joined_text, number_rows, union_all

RUN = ["video_id", "run"]
NO_IMAGE = "(no image: the screen was empty)"
NO_SPEECH = "(no speech)"


def sections(
    screens: DataFrame, hosts: DataFrame, assigned: DataFrame, frames: DataFrame
) -> DataFrame:
    """Sections with their images (one path per line) and their text: (video_id, run, section, start, end, n_screens,
    n_images, n_segments, images, text), one row per screen that is not hosted elsewhere and has an image or a sentence
    to show. ``frames``: accepted frames with screen, t, frame_no, image.

    Screens, images and sentences are one tagged table, joined once to the hosts and aggregated once.
    """
    at = F.struct(F.col("screen").alias("a"), F.col("t").alias("b"), F.col("frame_no").cast("long").alias("c"))
    said = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0.0).alias("b"), F.col("seg_no").cast("long").alias("c"))
    keys = [*RUN, "screen"]
    rows = union_all(
        [
            screens.select(*keys, F.lit("screen").alias("kind"), "start", "end"),
            frames.select(*keys, F.lit("image").alias("kind"), at.alias("at"), F.col("image").alias("piece")),
            assigned.select(*keys, F.lit("said").alias("kind"), said.alias("at"), F.trim("text").alias("piece")),
        ]
    )
    shown_on = rows.join(hosts.select(*keys, "host"), keys, "left").withColumn("section", F.coalesce("host", "screen"))

    def count(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    def joined(kind: str, separator: str) -> Column:
        wanted = (F.col("kind") == kind) & ((F.col("piece") != "") | F.lit(kind == "image"))
        pieces = F.sort_array(F.collect_list(F.when(wanted, F.struct("at", F.coalesce("piece", F.lit("")).alias("piece")))))
        text = F.array_join(F.transform(pieces, lambda x: x["piece"]), separator)
        return F.when(F.size(pieces) > 0, text)

    return (
        shown_on.groupBy(*RUN, "section")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            count("screen").alias("n_screens"),
            count("image").alias("n_images"),
            count("said").alias("n_segments"),
            joined("image", "\n").alias("images"),
            joined("said", " ").alias("text"),
        )
        .filter("n_screens > 0 AND (n_images > 0 OR text IS NOT NULL)")
    )


def rag_rows(section_rows: DataFrame) -> DataFrame:
    """Screen state and the explanation spoken over it, as rows to search in."""
    return section_rows.filter("images IS NOT NULL AND trim(text) <> ''").select(
        *RUN, "section", "start", "end", "images", F.trim("text").alias("text")
    )


def _seconds(value: Column) -> Column:
    return exact_round(value, 2).cast("string")


def render_context(
    titles: DataFrame,
    screens: DataFrame,
    hosts: DataFrame,
    assigned: DataFrame,
    frames: DataFrame,
    costs: DataFrame,
) -> DataFrame:
    """One Markdown document per run (video_id, run, text).

    ``titles`` (video_id, run, title, duration), ``costs`` from ``read_budget``.
    """
    n_screens = screens.groupBy(*RUN).agg(F.count("*").alias("n_screens"))
    zero = F.lit(0).cast("long")
    head = (
        titles.join(n_screens, RUN, "left")
        .join(costs, RUN, "left")
        .select(
            *RUN,
            F.lit(-1).cast("long").alias("section"),
            F.format_string(
                "# %s\n\n%d screens, %d images, %d s\n\n"
                "Images are reading copies; opening all %d costs about %d tokens (%s). "
                "Longer screens hold more: open those first.\n\n",
                "title",
                F.coalesce("n_screens", zero),
                F.coalesce("n_images", zero),
                F.bround("duration").cast("long"),
                F.coalesce("n_images", zero),
                F.coalesce("tokens", zero),
                F.coalesce("rule", F.lit("")),
            ).alias("piece"),
        )
    )
    title = F.concat(F.lit("## "), _seconds(F.col("start")), F.lit("-"), _seconds(F.col("end")), F.lit("s\n"))
    links = F.transform(F.split("images", "\n"), lambda i: F.concat(F.lit("![]("), read_path(i), F.lit(")\n")))
    body = sections(screens, hosts, assigned, frames).select(
        *RUN,
        F.col("section").cast("long").alias("section"),
        F.concat(
            title,
            F.coalesce(F.array_join(links, ""), F.lit(NO_IMAGE + "\n")),
            F.coalesce("text", F.lit(NO_SPEECH)),
            F.lit("\n\n"),
        ).alias("piece"),
    )
    return joined_text(head.unionByName(body), RUN, ["section"], F.col("piece"), "")


def render_index(titles: DataFrame, index: DataFrame) -> DataFrame:
    """One Markdown index per video over its runs (video_id, text). ``titles`` (video_id,
    title, duration), ``index`` from ``merge_run_index``."""
    counts = index.groupBy("video_id").agg(F.count("*").alias("n_runs"))
    overlap = F.when(
        F.col("n_runs") > 1,
        F.lit("Runs are independent; where their ranges overlap they may divide the screens differently.\n\n"),
    ).otherwise(F.lit(""))
    head = titles.join(counts, "video_id").select(
        "video_id",
        F.lit(-1).cast("long").alias("position"),
        F.concat(
            F.format_string("# %s\n\n%d s, %d runs.\n\n", "title", F.bround("duration").cast("long"), "n_runs"),
            overlap,
            F.lit("| run | range | screens | images | file |\n|---|---|---|---|---|\n"),
        ).alias("piece"),
    )
    span = F.when(F.col("lo").isNull(), F.lit("whole video")).otherwise(
        F.format_string("%.1f-%.1f s", exact_round(F.col("lo"), 1), exact_round(F.col("hi"), 1))
    )
    rows = index.select(
        "video_id",
        "position",
        F.concat(
            F.lit("| "), "run", F.lit(" | "), span, F.lit(" | "), F.col("n_screens").cast("string"),
            F.lit(" | "), F.col("n_frames").cast("string"), F.lit(" | `runs/"), "run",
            F.lit("/context.md` |\n"),
        ).alias("piece"),
    )
    return joined_text(head.unionByName(rows), ["video_id"], ["position"], F.col("piece"), "")


def srt_documents(cues: DataFrame, key: str = "video_id", order: str = "seg_no") -> DataFrame:
    """Cues as SRT text (key, text), numbered from 1 in order."""
    numbered = number_rows(cues, [key], [order], "_no", first=1)
    block = F.concat(
        F.col("_no").cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "),
        srt_time(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n"),
    )
    return joined_text(numbered, [key], [order], block, "\n")


def _json_list(df: DataFrame, slot: int, order: list[str], value: Column, keys: list[str] = RUN) -> DataFrame:
    """Elements of one list as pieces."""
    columns = [F.col(c).cast("double").alias(f"o{i}") for i, c in enumerate(order)]
    return df.select(*keys, F.lit(slot).alias("slot"), *columns, F.to_json(value).alias("piece"))


def _json_text(pieces: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, text): the slots of each document in order, the pieces of one slot parted by commas."""
    order = [c for c in ("o0", "o1") if any(c in p.columns for p in pieces)]
    filled = union_all(pieces).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in order})
    slots = joined_text(filled, [*keys, "slot"], order, F.col("piece"), ",")
    return joined_text(slots, keys, ["slot"], F.col("text"), "")


def json_list_documents(df: DataFrame, field: str, order: str, value: Column) -> DataFrame:
    """One JSON object per video with a single list, such as ``segments`` or ``flags``
    (video_id, text)."""
    keys = ["video_id"]
    listed = joined_text(_json_list(df, 0, [order], value, keys), keys, ["o0"], F.col("piece"), ",")
    return listed.select(*keys, F.concat(F.lit('{"' + field + '":['), "text", F.lit("]}")).alias("text"))


_ALL_KEYS = {"ignoreNullFields": "false"}


def export_metadata(
    titles: DataFrame,
    screens: DataFrame,
    frames: DataFrame,
    segments: DataFrame,
    assigned: DataFrame,
    costs: DataFrame,
    requested: DataFrame,
    schema: str,
) -> DataFrame:
    """Audit document per run as JSON text (video_id, run, text); every key is always present.

    ``titles``: video_id, run, title, duration, fps, lo, hi, backend, model, params (a struct).
    ``frames``: every gated candidate with screen, status and yavg; accepted ones are listed with
    their screen's interval and dialogue (``assigned``), rejected ones with their reason.
    ``segments`` keyed by run, ``costs`` from ``read_budget``, ``requested`` (video_id, run,
    request_no, time) on-demand frames.
    """
    spoken = F.struct("seg_no", "start", "end", "text")
    said = assigned.groupBy(*RUN, "screen").agg(F.array_sort(F.collect_list(spoken)).alias("_said"))
    text = joined_text(segments, RUN, ["seg_no"], F.col("text"), " ").withColumnRenamed("text", "_text")
    whole = titles.join(costs.select(*RUN, "n_images", "tokens", "long_edge"), RUN, "left").join(text, RUN, "left")

    def literal(slot: int, piece: Column) -> DataFrame:
        return whole.select(*RUN, F.lit(slot).alias("slot"), piece.alias("piece"))

    def two(value: Column) -> Column:
        return exact_round(value, 2)

    zero = F.lit(0).cast("long")
    opening = F.to_json(
        F.struct(
            F.lit(schema).alias("schema"),
            F.struct(F.col("title").alias("file"), two(F.col("duration")).alias("duration"), "fps").alias("source"),
            F.array(two(F.coalesce("lo", F.lit(0.0))), two(F.coalesce("hi", "duration"))).alias("window"),
            F.struct(
                F.coalesce("n_images", zero).alias("count"), F.coalesce("tokens", zero).alias("tokens"), "long_edge"
            ).alias("images"),
        ),
        _ALL_KEYS,
    )
    heard = F.struct("backend", "model", F.coalesce("_text", F.lit("")).alias("text"))
    placed = frames.join(screens.select(*RUN, "screen", "start", "end"), [*RUN, "screen"], "left").join(
        said, [*RUN, "screen"], "left"
    )
    lines = F.transform("_said", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    shown = [two(F.col("t")).alias("time"), "image", "sources", "screen"]
    accepted = F.struct(
        *shown,
        F.array(two(F.col("start")), two(F.col("end"))).alias("interval"),
        F.coalesce(lines, F.array().cast("array<struct<start:double,end:double,text:string>>")).alias("dialogue"),
        "yavg",
    )
    pieces = [
        literal(0, F.concat(F.regexp_replace(opening, r"\}$", ""), F.lit(',"screens":['))),
        _json_list(screens, 1, ["screen"], F.array(two(F.col("start")), two(F.col("end")))),
        literal(2, F.lit('],"frames":[')),
        _json_list(placed.filter("status = 'accepted'"), 3, ["t", "ord"], accepted),
        literal(4, F.lit('],"rejected":[')),
        _json_list(frames.filter("status = 'rejected'"), 5, ["t", "ord"], F.struct(*shown, "reject_reason")),
        literal(6, F.lit('],"requested":[')),
        _json_list(requested, 7, ["request_no"], F.struct("request_no", two(F.col("time")).alias("time"))),
        literal(8, F.concat(F.lit('],"transcript":'), F.regexp_replace(F.to_json(heard, _ALL_KEYS), r"\}$", ""), F.lit(',"segments":['))),
        _json_list(segments, 9, ["seg_no"], F.struct("start", "end", "text")),
        literal(10, F.concat(F.lit(']},"transcript_file":"transcript.json","params":'), F.to_json("params", _ALL_KEYS), F.lit("}"))),
    ]
    return _json_text(pieces, RUN)


def export_compare(metrics: DataFrame) -> DataFrame:
    """Scores per video as one JSON object each."""
    fields = [c for c in metrics.columns if c != "video_id"]
    return metrics.select("video_id", F.to_json(F.struct(*fields)).alias("json"))
