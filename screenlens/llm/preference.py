"""Preference formatting: a prompt that two conversations share, and their two completions with loss masks.

Only DataFrame functions, and one path of three aggregations, each over the result of the one before: turns, where
repeated rows are reduced on the map side; blocks of BLOCK turn numbers, so that no task collects a whole conversation
row by row; pairs, one row each. The longest common turn prefix ends where a block first differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers of one block.
BLOCK = 1024
#: The rendering of a turn: what stands before the role, between role and text, and after the text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: The role whose turns are learnt.
LEARNT = "assistant"


def paired(turns: DataFrame) -> DataFrame:
    """pair_id, turn, c, r: (role, text) of both sides of a turn, of rows that repeat one the smallest.

    ``turns`` has pair_id, turn, role, text and the booleans chosen and rejected: the sides on which the row stands.
    """
    row = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = turns.where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull())
    return known.groupBy("pair_id", "turn").agg(
        F.min(F.when(F.col("chosen"), row)).alias("c"), F.min(F.when(F.col("rejected"), row)).alias("r")
    )


def formatted(both: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``preference_format`` from a ``paired`` table."""
    parts_at = F.when(~F.coalesce(F.col("c") == F.col("r"), F.lit(False)), F.col("turn"))
    blocks = both.groupBy("pair_id", F.floor(F.col("turn") / block).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "c", "r"))).alias("turns"), F.min(parts_at).alias("parting")
    )
    pairs = blocks.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.struct("block", "turns"))).alias("blocks"), F.min("parting").alias("parting")
    )
    parting = F.col("parting")

    def side(turns: Column, name: str, common: bool) -> Column:
        """Rendered turns of one side before the parting, or from there on."""
        before = parting.isNull() if common else parting.isNotNull()

        def held(t: Column) -> Column:
            where = before | (t["turn"] < parting) if common else before & (t["turn"] >= parting)
            return where & t[name].isNotNull()

        return F.transform(F.filter(turns, held), lambda t: _rendered(t[name]))

    def text(name: str, common: bool = False) -> Column:
        return F.array_join(
            F.transform("blocks", lambda b: F.array_join(F.transform(side(b["turns"], name, common), lambda p: p["text"]), "")), ""
        )

    prompt = F.transform("blocks", lambda b: F.size(side(b["turns"], "c", True)))
    return pairs.select(
        "pair_id",
        F.aggregate(prompt, F.lit(0).cast("long"), lambda a, n: a + n).alias("prompt_turns"),
        text("c", True).alias("prompt"),
        text("c").alias("chosen"),
        text("r").alias("rejected"),
        _spans(F.transform("blocks", lambda b: side(b["turns"], "c", False))).alias("chosen_spans"),
        _spans(F.transform("blocks", lambda b: side(b["turns"], "r", False))).alias("rejected_spans"),
    )


def preference_format(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id", block: int = BLOCK) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans: one row for every pair.

    ``chosen`` and ``rejected`` have ``key``, turn (long), role, text. Turns are equal if number, role and text are.
    ``prompt`` renders the common turns once, ``chosen`` and ``rejected`` what follows in each; spans are (start, end)
    in characters of that completion, over the texts of LEARNT turns with their closing mark: where loss counts.
    ``prompt_turns`` counts common turns. ``block`` only bounds what is collected at a time.

    Null role or text is empty; rows with a null key or turn are left out; repeated turns as in ``paired``. A key that
    only one side has pairs with an empty conversation, equal conversations have empty completions. Empty tables give
    no rows; other columns are ignored.
    """
    sides = [
        df.select(F.col(key).alias("pair_id"), "turn", "role", "text", F.lit(own).alias("chosen"), F.lit(not own).alias("rejected"))
        for df, own in ((chosen, True), (rejected, False))
    ]
    return formatted(paired(sides[0].unionByName(sides[1])), block)


def _rendered(turn: Column) -> Column:
    head = F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))
    return F.struct(
        F.concat(head, turn["text"], F.lit(CLOSE)).alias("text"),
        F.length(head).alias("head"),
        (turn["role"] == LEARNT).alias("learnt"),
    )


def _spans(blocks: Column) -> Column:
    """(start, end) of every learnt turn in the joined text of all blocks; running lengths are carried along."""
    one = "array<struct<start: long, end: long>>"

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(one).alias("spans"))

        def step(state: Column, turn: Column) -> Column:
            end = state["at"] + F.length(turn["text"])
            span = F.array(F.struct((state["at"] + turn["head"]).alias("start"), end.alias("end")))
            return F.struct(
                end.alias("at"), F.when(turn["learnt"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans")
            )

        return F.aggregate(block, start, step)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{one}>").alias("spans"))

    def moved(state: Column, block: Column) -> Column:
        spans = F.transform(
            block["spans"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end"))
        )
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["spans"], F.array(spans)).alias("spans"))

    return F.aggregate(F.transform(blocks, within), start, moved, lambda state: F.flatten(state["spans"]))


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Preference pairs out of a table of conversations (conv_id, turn, role, text), one of every conversation, as the
    rows that ``paired`` takes.

    A conversation is chosen over itself with another's last answer: that of its partner, the id that differs in the
    last bit. The rejected side ends there. If the partner has no answer or does not exist, the rejected side ends
    before the conversation's own answer; a conversation without an answer is chosen over itself, so it is all prompt.
    """
    turns = conversations.where("conv_id is not null and turn is not null").select(
        F.col("conv_id").cast("long").alias("pair_id"), "turn", "role", "text"
    )
    answer = (
        turns.where(F.col("role") == LEARNT)
        .groupBy("pair_id")
        .agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
        .select("pair_id", F.col("last.turn").alias("at"), F.col("last.text").alias("said"))
    )
    other = answer.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("said").alias("other"))
    own = turns.join(answer.select("pair_id", "at"), "pair_id", "left").select(
        "pair_id", "turn", "role", "text",
        F.lit(True).alias("chosen"), F.coalesce(F.col("turn") < F.col("at"), F.lit(True)).alias("rejected"),
    )
    swapped = answer.join(other, "pair_id").select(
        "pair_id", F.col("at").alias("turn"), F.lit(LEARNT).alias("role"), F.col("other").alias("text"),
        F.lit(False).alias("chosen"), F.lit(True).alias("rejected"),
    )
    return own.unionByName(swapped)


def digest(result: DataFrame) -> DataFrame:
    """Spans as text, ``start-end`` parted by commas."""

    def text(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")

    return result.withColumn("chosen_spans", text("chosen_spans")).withColumn("rejected_spans", text("rejected_spans"))


#: DuckDB SQL for ``digest(formatted(paired(swapped_answers(conversations))))``: what a conversation says up to its last
#: answer is the prompt, unless that answer is the other one's too.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS said
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
), answers AS (
  SELECT conv_id, turn, max(coalesce(text, '')) AS text
  FROM conversations c WHERE role = 'assistant' AND conv_id IS NOT NULL
    AND turn = (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = 'assistant')
  GROUP BY conv_id, turn
), ends AS (
  SELECT k.conv_id, own.turn AS answer_turn, other.conv_id IS NOT NULL AS has_other, other.text AS other_text
  FROM (SELECT DISTINCT conv_id FROM t) k LEFT JOIN answers own ON own.conv_id = k.conv_id
  LEFT JOIN answers other ON other.conv_id = xor(k.conv_id, 1) AND own.turn IS NOT NULL
), parted AS (
  SELECT t.conv_id, t.turn, t.said, e.answer_turn, e.other_text, e.has_other,
    -- the first turn that both sides do not share
    CASE WHEN e.answer_turn IS NULL THEN NULL
         WHEN e.has_other AND a.said = {'role': 'assistant', 'text': e.other_text}
           THEN (SELECT min(u.turn) FROM t u WHERE u.conv_id = t.conv_id AND u.turn > e.answer_turn)
         ELSE e.answer_turn END AS parting
  FROM t JOIN ends e USING (conv_id) LEFT JOIN t a ON a.conv_id = t.conv_id AND a.turn = e.answer_turn
), long AS (
  SELECT conv_id, CASE WHEN parting IS NULL OR turn < parting THEN 'p' ELSE 'c' END AS part, turn, said FROM parted
  UNION ALL
  SELECT DISTINCT conv_id, 'r', answer_turn, {'role': 'assistant', 'text': other_text} FROM parted
  WHERE has_other AND parting = answer_turn
), rendered AS (
  SELECT *, '<|im_start|>' || said.role || chr(10) || said.text || '<|im_end|>' || chr(10) AS piece,
         length('<|im_start|>' || said.role) + 1 AS head
  FROM long
), placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, part ORDER BY turn) AS ends FROM rendered
)
SELECT conv_id AS pair_id, count(*) FILTER (part = 'p') AS prompt_turns,
  coalesce(string_agg(piece, '' ORDER BY turn) FILTER (part = 'p'), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY turn) FILTER (part = 'c'), '') AS chosen,
  coalesce(string_agg(piece, '' ORDER BY turn) FILTER (part = 'r'), '') AS rejected,
  coalesce(string_agg((ends - length(piece) + head)::BIGINT || '-' || ends::BIGINT, ',' ORDER BY turn)
    FILTER (part = 'c' AND said.role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((ends - length(piece) + head)::BIGINT || '-' || ends::BIGINT, ',' ORDER BY turn)
    FILTER (part = 'r' AND said.role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY conv_id
"""
