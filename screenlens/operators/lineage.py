"""What is stale, what may be reused and what to do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlens import params as P
from screenlens.functions.lang import language_mismatch
from screenlens.functions.text import normalize_review, review_body, review_header
from screenlens.operators.ordered import joined_text

VIDEO = ["video_id"]
RUN = ["video_id", "run"]


def source_changed(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """Old and new inventory (video_id, path, size) compared; a first sighting is not a change."""
    old = recorded.select("video_id", F.struct("path", "size").alias("_old"))
    new = present.select("video_id", F.struct("path", "size").alias("_new"))
    state = (
        F.when(F.col("_old").isNull(), F.lit("new"))
        .when(F.col("_new").isNull(), F.lit("missing"))
        .when(F.col("_old") == F.col("_new"), F.lit("same"))
        .otherwise(F.lit("changed"))
    )
    return old.join(new, "video_id", "full").select("video_id", state.alias("state"))


def subtitle_changed(states: DataFrame) -> DataFrame:
    """Redo the transcript iff it was done and the subtitle it read differs now, where having none
    is a value too. ``states``: video_id, transcribed, prev_path, prev_size, path, size."""
    same = F.col("prev_path").eqNullSafe(F.col("path")) & F.col("prev_size").eqNullSafe(F.col("size"))
    return states.withColumn("redo", F.col("transcribed") & ~same)


def fingerprint_target(explicit: Column, first_sidecar: Column) -> Column:
    """The outside file a transcript depends on; embedded tracks are covered by the video itself."""
    return F.coalesce(explicit, first_sidecar)


def stale_stages(stages: DataFrame, videos: DataFrame) -> DataFrame:
    """The first stage still due per video. ``stages`` (video_id, stage, done, at): a transcript
    written after the frames reopens them."""
    done = stages.groupBy("video_id").agg(
        *[
            F.max(F.when((F.col("stage") == s) & F.col("done"), F.col("at"))).alias(f"_{s}")
            for s in P.STAGES
        ]
    )
    reopened = F.col("_frames") < F.col("_transcribe")
    due = (
        F.when(F.col("_split").isNull(), F.lit("split"))
        .when(F.col("_transcribe").isNull(), F.lit("transcribe"))
        .when(F.col("_frames").isNull() | reopened, F.lit("frames"))
    )
    return videos.select("video_id").join(done, "video_id", "left").select("video_id", due.alias("due"))


def context_fingerprint(documents: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """sha256 of each document's text."""
    return documents.select(*keys, F.sha2("text", 256).alias("context_sha256"))


def review_status(runs: DataFrame, reviews: DataFrame, contexts: DataFrame) -> DataFrame:
    """missing / unreadable / stale / current per run. ``reviews`` (video_id, run, review) whole
    review files, ``contexts`` (video_id, run, context_sha256)."""
    now = contexts.select(*RUN, F.col("context_sha256").alias("_now"))
    stored = reviews.select(*RUN, "review", review_header(F.col("review")).alias("_h"))
    state = (
        F.when(F.col("review").isNull(), F.lit("missing"))
        .when(F.col("_h").isNull(), F.lit("unreadable"))
        .when(F.col("_now") == F.col("_h.context_sha256"), F.lit("current"))
        .otherwise(F.lit("stale"))
    )
    return (
        runs.select(*RUN)
        .join(stored, RUN, "left")
        .join(now, RUN, "left")
        .select(*RUN, state.alias("state"), F.col("_h.context_sha256").alias("context_sha256"),
                F.col("_now").alias("context_sha256_now"))
    )


def review_decide(previous: Column, body: Column, now_sha: Column, force: Column) -> Column:
    """create / unchanged / refresh / update / conflict for a submitted review."""
    header = review_header(previous)
    same_body = review_body(previous) == normalize_review(body)
    same_sha = header["context_sha256"].eqNullSafe(now_sha)
    return (
        F.when(header.isNull(), F.lit("create"))
        .when(same_body & same_sha, F.lit("unchanged"))
        .when(same_body, F.lit("refresh"))
        .when(~same_sha | force, F.lit("update"))
        .otherwise(F.lit("conflict"))
    )


def review_body_check(body: Column, max_bytes: int = P.REVIEW_MAX_BYTES) -> Column:
    """Why a submitted review is refused, or null."""
    marked = F.contains(body, F.lit(P.REVIEW_BEGIN)) | F.contains(body, F.lit(P.REVIEW_END))
    return (
        F.when(F.octet_length(body) > max_bytes, F.lit("too-large"))
        .when(~body.rlike(r"(?U)\S"), F.lit("empty"))
        .when(marked, F.lit("contains-marker"))
    )


def pending_head(statuses: DataFrame, index: DataFrame) -> DataFrame:
    """Per video the first run in index order without a current review, and all such runs as
    (video_id, run, n_pending, pending)."""
    waiting = index.select(*RUN, "position").join(
        statuses.filter("state <> 'current'").select(*RUN, "state"), RUN
    )
    head = waiting.groupBy("video_id").agg(
        F.min_by(F.struct("run", "state"), "position").alias("_h"), F.count("*").alias("n_pending")
    )
    names = joined_text(waiting, VIDEO, ["position"], F.col("run"), ",")
    return head.join(names, "video_id").select(
        "video_id", "_h.run", "_h.state", "n_pending", F.col("text").alias("pending")
    )


def next_action(videos: DataFrame, due: DataFrame, pending: DataFrame, costs: DataFrame) -> DataFrame:
    """run (a stage is due), read (a run waits for its review; with its cost) or done."""
    joined = (
        videos.select("video_id")
        .join(due, "video_id", "left")
        .join(pending, "video_id", "left")
        .join(costs.select(*RUN, "n_images", "tokens"), RUN, "left")
    )
    action = (
        F.when(F.col("due").isNotNull(), F.lit("run"))
        .when(F.col("run").isNotNull(), F.lit("read"))
        .otherwise(F.lit("done"))
    )
    reading = action == "read"

    def only(column: str) -> Column:
        return F.when(reading, F.col(column)).alias(column)

    return joined.select(
        "video_id", action.alias("action"), F.col("due").alias("stage"), only("run"), only("state"),
        only("n_pending"), only("pending"), only("n_images"), only("tokens"),
    )


def schema_gate(rows: DataFrame, expected: str, tag: str = "schema_version") -> DataFrame:
    """Rows of another schema are refused with the reason; nothing is migrated."""
    found = F.coalesce(tag, F.lit("none"))
    return rows.withColumn(
        "refused",
        F.when(~F.col(tag).eqNullSafe(F.lit(expected)),
               F.concat(F.lit(f"needs {expected}, found "), found)),
    )


def transcript_reuse(states: DataFrame) -> DataFrame:
    """Whether a finished transcript is used again, and a note when it is not what was asked for.

    ``states``: video_id, transcribed, redo, source_kind, source_path, explicit_path, model_size,
    language, asked_model, asked_language.
    """
    demand = F.col("explicit_path").isNull() | (
        (F.col("source_kind") == "explicit") & F.col("source_path").eqNullSafe(F.col("explicit_path"))
    )
    reuse = F.col("transcribed") & ~F.col("redo") & F.coalesce(demand, F.lit(False))
    other_model = F.col("asked_model").isNotNull() & (F.col("model_size") != F.col("asked_model"))
    from_subtitle = F.col("asked_model").isNotNull() & F.col("source_kind").isin(
        "explicit", "sidecar", "embedded"
    )
    model_note = F.when(other_model, F.lit("other-model")).when(from_subtitle, F.lit("model-unused"))
    language_note = F.when(
        language_mismatch(F.col("language"), F.col("asked_language")), F.lit("other-language")
    )
    return states.withColumn("reuse", reuse).withColumn(
        "note",
        F.when(reuse, F.nullif(F.concat_ws(" / ", model_note, language_note), F.lit(""))),
    )


def request_ledger_upsert(ledger: DataFrame, asked: DataFrame) -> DataFrame:
    """On-demand requests keyed by (video, run, at, reason): known ones stay as they are, new ones
    are appended; ``is_new`` tells them apart."""
    key = [*RUN, "at", "reason"]
    fields = [c for c in asked.columns if c not in key]
    new = (
        asked.join(ledger.select(*key).distinct(), key, "left_anti")
        .groupBy(*key)
        .agg(F.min(F.struct(*fields)).alias("_f"))
        .select(*key, "_f.*")
    )
    return ledger.withColumn("is_new", F.lit(False)).unionByName(
        new.withColumn("is_new", F.lit(True)), allowMissingColumns=True
    )


def clean_survey(files: DataFrame) -> DataFrame:
    """Bytes that each clean-up level would free (levels include the ones before them) and the
    total. ``files`` (video_id, path, length); only the two classes below are ever freed."""
    level = F.when(F.col("path").rlike(r"^video\.mkv$"), F.lit(1)).when(
        F.col("path").rlike(r"^runs/[^/]+/frames/"), F.lit(2)
    )
    zero = F.lit(0).cast("long")
    return files.groupBy("video_id").agg(
        F.coalesce(F.sum(F.when(level <= 1, F.col("length"))), zero).alias("cache_bytes"),
        F.coalesce(F.sum(F.when(level <= 2, F.col("length"))), zero).alias("images_bytes"),
        F.sum("length").alias("total_bytes"),
    )
