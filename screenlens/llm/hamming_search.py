"""Exact k nearest binary codes by incremental multi-index hashing.

A code is cut into m segments of about log2(number of codes) bits. Two codes of which every segment differs in more than
r bits differ in at least m (r + 1) bits; so once all buckets within radius r of a query's segments were looked up, every
code nearer than that was found. Each round widens the radius by one for the queries whose k-th verified distance is not
yet covered by it, and only for those. Equal codes are one entry with its smallest ids, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlens.llm.common import only
from screenlens.session import materialize

K = 10
#: Query ids are the multiples of this.
EVERY = 50
#: Longest segment: its masks are listed in a task.
MAX_SEGMENT = 24


def sign_code(vector: str, bits: int) -> Column:
    """One bit per dimension, set where it is above zero, in words of 64; missing dimensions are zero."""

    def word(at: int) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(min(64, bits - at) - 1)),
            F.lit(0).cast("long"),
            lambda code, i: code.bitwiseOR(
                F.when(F.try_element_at(F.col(vector), i + at + 1) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(
                    F.lit(0).cast("long")
                )
            ),
        )

    return F.array(*[word(at) for at in range(0, bits, 64)])


def segments(bits: int, n_codes: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments for so many different codes."""
    width = max(1, min(bits, MAX_SEGMENT, n_codes.bit_length() - 1))
    m = -(-bits // width)
    cuts = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def segment_value(code: Column, first: int, width: int) -> Column:
    """The segment's bits as a number; a segment may reach over two words."""
    value, done = F.lit(0).cast("long"), 0
    while done < width:
        word, at = divmod(first + done, 64)
        n = min(width - done, 64 - at)
        bits = F.shiftrightunsigned(F.get(code, F.lit(word)), at).bitwiseAND(F.lit((1 << n) - 1 if n < 64 else -1))
        value = value.bitwiseOR(F.shiftleft(bits, done))
        done += n
    return value


def distance(a: str, b: str) -> Column:
    words = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(words, F.lit(0), lambda total, n: total + n)


@lru_cache(maxsize=64)
def _masks(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with ``radius`` of them set."""
    if not radius or radius > width:
        return np.zeros(0 if radius else 1, np.int64)
    bits = np.array(list(combinations(range(width), radius)), np.int64).reshape(-1, radius)
    return (np.int64(1) << bits).sum(axis=1)


def _probes(queries: DataFrame, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """query_id, query, segment, value: the buckets at exactly ``radius`` from each segment."""
    values = F.array(*[segment_value(F.col("query"), *p) for p in parts])
    rows = queries.select("query_id", "query", F.posexplode(values).alias("segment", "value"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            masks = [_masks(parts[s][1], radius) for s in batch["segment"]]
            batch["value"] = [v ^ m for v, m in zip(batch["value"], masks, strict=True)]
            yield batch

    spread_out = rows.mapInPandas(spread, "query_id long, query array<long>, segment int, value array<long>")
    return spread_out.withColumn("value", F.explode("value"))


def nearest(codes: DataFrame, queries: DataFrame, bits: int, k: int = K) -> DataFrame:
    """query_id, rank (from 1), id, distance: the k nearest ids of each query but its own, ties by the smaller id.

    ``codes`` (id, code) and ``queries`` (query_id, query) hold codes as arrays of 64-bit words. Repeated rows count
    once; a query with fewer than k others gets all of them.
    """
    member = Window.partitionBy("code").orderBy("id")
    entries = materialize(
        codes.distinct()
        .withColumn("n", F.row_number().over(member))
        .where(F.col("n") <= k + 1)
        .groupBy("code")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("entry", F.monotonically_increasing_id()),
        "codes",
    )
    parts = segments(bits, max(1, entries.count()))
    values = F.array(*[segment_value(F.col("code"), *p) for p in parts])
    index = materialize(
        entries.select(
            "entry", "code", F.col("ids")[0].alias("first_id"), F.posexplode(values).alias("in_segment", "in_value")
        ),
        "code-index",
    )
    open_ = materialize(queries.distinct(), "open-queries")
    spark = codes.sparkSession
    best = None
    radius = 0
    found = spark.createDataFrame([], "query_id long, rank int, id long, distance int")
    nearest_entries = Window.partitionBy("query_id").orderBy("distance", "first_id")
    while True:
        probes = _probes(open_, parts, radius)
        # the size of probes is not seen before they are made: merged, never broadcast
        same = (F.col("segment") == F.col("in_segment")) & (F.col("value") == F.col("in_value"))
        met = probes.hint("merge").join(index, same)
        new = met.select("query_id", "entry", "first_id", distance("query", "code").alias("distance"))
        if best is not None:
            new = new.unionByName(best.join(open_.select("query_id"), "query_id", "left_semi"))
        best = materialize(
            new.groupBy("query_id", "entry")
            .agg(F.first("first_id").alias("first_id"), F.first("distance").alias("distance"))
            .withColumn("n", F.row_number().over(nearest_entries))
            .where(F.col("n") <= k + 1)
            .drop("n"),
            "nearest-codes",
        )
        ranked = (
            best.join(entries.select("entry", "ids"), "entry")
            .select("query_id", "distance", F.explode("ids").alias("id"))
            .where("id <> query_id")
            .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
            .where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "distance")
        )
        last_round = radius >= max(width for _, width in parts)
        covered = len(parts) * (radius + 1) - 1
        sure = ranked.groupBy("query_id").agg(F.max("distance").alias("d"), F.max("rank").alias("r"))
        sure = sure.where((F.col("r") == k) & (F.col("d") <= covered)).select("query_id")
        if last_round:
            return found.unionByName(ranked)
        done = materialize(ranked.join(sure, "query_id", "left_semi"), "nearest-done")
        found = found.unionByName(done)
        open_ = materialize(open_.join(sure, "query_id", "left_anti"), "open-queries")
        if open_.isEmpty():
            return found
        radius += 1


def search(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY
) -> DataFrame:
    """query_id, rank, id, distance: for every row whose id is divisible by ``every``, its ``k`` nearest other rows.

    Distances are Hamming distances of the signs of the dimensions. Shorter vectors are filled with zeros, null or NaN
    dimensions are zero (NaN counts as above zero in SQL comparisons, so it is replaced). Rows with a null id or vector
    are not searched and not found; equal rows count once. An empty table gives no rows; other columns are ignored.
    """
    own = only(vectors, id=id_col, vector=vector_col).where("id is not null and vector is not null")
    own = own.withColumn("vector", F.transform("vector", lambda x: F.when(F.isnan(x), 0).otherwise(x)))
    bits = own.agg(F.max(F.size("vector"))).first()[0] or 1
    codes = materialize(own.select(F.col("id").cast("long").alias("id"), sign_code("vector", bits).alias("code")), "sign-codes")
    queries = codes.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    return nearest(codes, queries, bits, k)


#: DuckDB SQL for ``search(embeddings)``: every distance.
SQL = """
WITH c AS (
  SELECT DISTINCT vec_id AS id,
         list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), d AS (
  SELECT q.id AS query_id, c.id, hamming(q.code, c.code) AS distance
  FROM c AS q JOIN c ON q.id % 50 = 0 AND c.id <> q.id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS n FROM d
)
SELECT query_id, n::INTEGER AS rank, id, distance::INTEGER AS distance FROM r WHERE n <= 10
"""
