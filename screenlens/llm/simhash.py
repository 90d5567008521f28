"""SimHash near-duplicates: 64-bit fingerprints compared by bit planes.

Equal fingerprints are one node, named by its smallest doc_id, before anything is compared. Of ``n`` parts of a
fingerprint that differs in at most 4 bits from another, ``n - 4`` are equal: each choice of so many parts is a key, and
fingerprints under one key form a block that is compared bit-sliced (see ``bitslice``). A block passes on a spanning
forest of its links, never its pairs. More parts, hence longer keys, are taken as the number of fingerprints grows, so
blocks stay small. A block above TILE members is dealt into tiles, and every two tiles meet in a task of their own, so
its pairs are all compared and no task holds the whole of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlens.llm.bitslice import Forest, close_pairs
from screenlens.llm.common import only
from screenlens.llm.graph import components
from screenlens.session import materialize

WORDS = 4
RADIUS = 4
SEED = 42
#: Members of a block that one task compares with each other or with another tile.
TILE = 4096
#: Mean members of a block that the choice of parts aims at.
BLOCK = 128


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of a text; zero without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(tokens))
    of = xxhash.xxh64_intdigest
    spans = zip(starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.array([of(joined[a:b], seed) for a, b in spans], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (set_bits * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp of every row of ``docs`` (doc_id, text)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = [fingerprint(t, words, seed) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": np.array(fps, np.int64)})

    return docs.mapInPandas(scan, "doc_id long, fp long")


def parts_for(n_fingerprints: int, radius: int = RADIUS) -> list[tuple[int, ...]]:
    """Bit masks of the keys: which bits each key takes, for so many fingerprints."""
    for parts in range(radius + 1, radius + 5):
        cuts = [round(64 * i / parts) for i in range(parts + 1)]
        chosen = list(combinations(range(parts), parts - radius))
        bits = min(sum(cuts[p + 1] - cuts[p] for p in c) for c in chosen)
        if n_fingerprints <= BLOCK << bits or parts == radius + 4:
            break
    masks = []
    for c in chosen:
        mask = 0
        for p in c:
            mask |= ((1 << (cuts[p + 1] - cuts[p])) - 1) << cuts[p]
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _links_of(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links of the blocks in sorted rows (key_no, key, left tile, right tile, node, fp, tile).

    Rows of one block are adjacent; a block is compared once its last row has come.
    """
    block = ["key_no", "key", "tile_a", "tile_b"]
    held: list[pd.DataFrame] = []

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        names = rows[block].to_numpy()
        starts = np.concatenate([[0], np.nonzero((names[1:] != names[:-1]).any(axis=1))[0] + 1])
        forest = Forest(len(rows))
        for left, right in close_pairs(rows["fp"].to_numpy().view(np.uint64), starts, radius):
            forest.add(left, right)
        child, root = forest.links()
        node = rows["node"].to_numpy()
        return pd.DataFrame({"a": node[child], "b": node[root]})

    for batch in batches:
        if not len(batch):
            continue
        names = batch[block].to_numpy()
        last = int(np.nonzero((names != names[-1]).any(axis=1))[0].max(initial=-1)) + 1
        same = held and (held[-1][block].to_numpy()[-1] == names[0]).all()
        if last or not same:
            ready = [*held, batch.iloc[:last]] if last else held
            if ready:
                yield compared(pd.concat(ready, ignore_index=True))
            held = []
        held.append(batch.iloc[last:])
    if held:
        yield compared(pd.concat(held, ignore_index=True))


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: links that join all of ``nodes`` (node, fp; fp distinct) within ``radius`` bits into their components."""
    spark = nodes.sparkSession
    masks = parts_for(nodes.count(), radius)
    keyed = nodes.select(
        "node", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("key_no", "key")
    )
    large = (
        keyed.groupBy("key_no", "key")
        .count()
        .where(F.col("count") > tile)
        .select(
            F.col("key_no").alias("large_no"),
            F.col("key").alias("large_key"),
            F.ceil(F.col("count") / tile).cast("int").alias("tiles"),
        )
    )
    tiled = (
        keyed.join(large, (F.col("key_no") == F.col("large_no")) & (F.col("key") == F.col("large_key")), "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "key_no",
            "key",
            F.least("tile", "other").alias("tile_a"),
            F.greatest("tile", "other").alias("tile_b"),
            "node",
            "fp",
        )
    )
    block = ["key_no", "key", "tile_a", "tile_b"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        tiled.repartition(tasks, *block)
        .sortWithinPartitions(*block)
        .mapInPandas(lambda batches: _links_of(batches, radius), "a long, b long")
    )


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """doc_id, fp (signed 64 bits), component_id (smallest doc_id reachable): one row per input row.

    Words are runs without ASCII white space, A-Z lower-cased; shingles of ``words`` words, repeats included, are
    hashed by XXH64 (seed 42). A fingerprint bit is 1 if set in more than half the hashes. Two documents are linked at
    ``radius`` (at most 7) or fewer differing bits.

    Null, empty or blank text has fingerprint zero and is linked like any other. A row with a null doc_id gets its
    fingerprint and the component of its text; it names none: alone, its component_id is null. Rows that repeat a
    doc_id stay separate rows; their texts' groups are joined only through the fingerprints. Empty table: no rows.
    Other columns are ignored; texts are read whole, whatever their length.
    """
    marked = materialize(fingerprints(only(docs, doc_id=id_col, text=text_col), words), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "fingerprint-nodes")
    joined = materialize(components(links(nodes.select("node", "fp"), radius)), "fingerprint-components")
    named = (
        nodes.join(joined, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .select(F.col("fp").alias("node_fp"), "component", "doc_id")
    )
    smallest = named.groupBy(F.col("component").alias("c")).agg(F.min("doc_id").alias("component_id"))
    by_fp = named.join(smallest, F.col("component") == F.col("c")).select("node_fp", "component_id")
    return marked.join(by_fp, F.col("fp") == F.col("node_fp")).select("doc_id", "fp", "component_id")


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with one document of each group of near-duplicates: that of the smallest doc_id.

    Rows that repeat a doc_id are one document: they stay or go together. Rows with a null doc_id stay: nothing tells
    which document they are.
    """
    groups = simhash_dedup(docs)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
