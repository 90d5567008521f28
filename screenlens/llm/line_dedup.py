"""Drop lines that several documents share, keeping them in one document.

Lines are exploded with their positions, normalised and hashed (128 bits). Distinct documents per hash are counted in
two aggregations, so a line found in a third of all documents is summed on the map side and never meets in one task.
The positions of dropped lines, not the texts, go through the joins; each text moves once, to be put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlens.llm.common import WHITE, ascii_lower, only
from screenlens.session import materialize

MIN_CHARS = 10
MIN_DOCUMENTS = 2


def line_key(line: Column) -> Column:
    """What makes two lines equal: ASCII white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_positions(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """doc_id, text_hash, positions (array of the line numbers to drop) of documents that lose lines.

    ``docs`` has doc_id and text. ``text_hash`` tells apart rows that repeat a doc_id with another text.
    """
    lines = (
        docs.where("doc_id is not null")
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.unhex(F.md5("key")).alias("hash"))
    )
    # a table, not an aggregation below the join: the join may then split the rows of a frequent line
    shared = materialize(
        lines.select("hash", "doc_id")
        .distinct()
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keeper"))
        .where(F.col("n") >= min_documents)
        .select("hash", "keeper"),
        "shared-lines",
    )
    return (
        lines.join(shared, "hash")
        .where("doc_id <> keeper")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias("positions"))
    )


def _with_positions(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_documents: int) -> DataFrame:
    """``docs`` with __positions, the line numbers that its text loses (null for none)."""
    own = only(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    drops = dropped_positions(own, min_chars, min_documents).toDF("__id", "__hash", "__positions")
    text_hash = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    joined = docs.withColumn("__own_hash", text_hash)
    same = (joined[id_col] == F.col("__id")) & (F.col("__own_hash") == F.col("__hash"))
    return joined.join(drops, same, "left").drop("__id", "__hash", "__own_hash")


def _kept(text: Column) -> Column:
    """The text without the lines of __positions, put together from the stretches between them; no lines to drop leave it
    as it is."""
    lines = _lines(text)
    ends = F.concat(F.array(F.lit(-1)), F.sort_array("__positions"), F.array(F.size(lines)))

    def between(one: Column) -> Column:
        def stretch(i: Column) -> Column:
            start = F.get(one["ends"], i)
            return F.slice(one["lines"], start + 2, F.get(one["ends"], i + 1) - start - 1)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(one["ends"]) - 2), stretch))

    # as elements of an array, lines and ends are worked out once and not again for every stretch
    whole = F.transform(F.array(F.struct(lines.alias("lines"), ends.alias("ends"))), between)
    return F.when(F.col("__positions").isNull(), text).otherwise(F.array_join(F.get(whole, F.lit(0)), "\n"))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without its dropped lines): one row per input row.

    A key of at least ``min_chars`` code points found in at least ``min_documents`` documents loses all its lines
    except those in the smallest doc_id holding it, where all stay, repeats included.

    Null or empty text is one empty line. Rows that repeat a doc_id count as one document. A row with a null doc_id
    passes unchanged and its lines count for no document. A document may lose all lines: ``kept`` is then empty.
    An empty table gives an empty table; other columns are ignored. There is no limit on text or line length.
    """
    own = only(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return _with_positions(own, "doc_id", "text", min_chars, min_documents).select(
        "doc_id",
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("__positions"), F.lit(0)).cast("long").alias("n_dropped"),
        _kept(F.col("text")).alias("kept"),
    )


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str = "n_chars",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """``docs``, all rows and columns, with the texts that ``line_dedup`` keeps and their lengths, if there is such a
    column; null texts become empty."""
    kept = _kept(F.coalesce(text_col, F.lit("")))
    result = _with_positions(docs, id_col, text_col, min_chars, min_documents).withColumn(text_col, kept)
    if length_col in docs.columns:
        result = result.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return result.select(*docs.columns)


def digest(result: DataFrame) -> DataFrame:
    """``line_dedup``'s rows with the SHA-256 of the kept text in its place."""
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL for ``digest(line_dedup(documents))``.
SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), s AS (
  SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.doc_id, k.pos, k.line, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone
  FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
