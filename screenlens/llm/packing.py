"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents are tokenised and cut into pieces inside the scan; only lengths travel. Pieces are dealt at random into blocks
of about BLOCK pieces, and a block is packed by ISLANDS populations, each one row of a table. A gene is a whole bin:
crossover injects well-filled bins of one packing into another, removes the bins that hold the same pieces again, and
best-fits the pieces that lost their place, longest first. After every epoch the elite of an island is joined to its
neighbour, and the best packing of a block's islands is taken at the end. Pieces of bins that stayed badly filled are
dealt to new blocks and packed once more. Pieces that fill a sequence need no packing.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlens.llm.common import only
from screenlens.session import materialize

CAPACITY = 1024
END_ID = 2
#: Mean pieces of a block; islands of a block; epochs, between which elites move; offspring of an epoch.
BLOCK = 4096
ISLANDS = 3
EPOCHS = 2
OFFSPRING = 24
POPULATION = 6
ELITE = 2
#: Share of a sequence from which a bin of the first packing stays as it is.
WELL_FILLED = 0.97

#: Characters on which both tokenizer libraries surely agree what is a letter, a number or white space.
_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e¡-ɏ]")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from texts to lists of token ids of the byte-level BPE in ``path``.

    tokenizers needs more CPU time for a text than all else together, so plain texts are merged by tiktoken with the
    vocabulary of the same file (ids are merge ranks there); texts with any rarer character go through tokenizers.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t.content for t in slow.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in slow.get_vocab().items() if token not in special}
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if _PLAIN.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document of ``docs`` (doc_id, text).

    A document is its token ids and ``end_id``. One longer than ``capacity`` is cut into full pieces, what is over
    coming first. ``tokenizer`` is the file of a byte-level BPE, None for the public one.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer or tokenizer_path())
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                rest = len(ids) % capacity
                cuts = [*([0] if rest else []), *range(rest, len(ids), capacity), len(ids)]
                for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    out.append((doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            found = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield found.astype({"doc_id": "Int64"})

    return docs.mapInPandas(scan, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(
    lengths: np.ndarray, order: np.ndarray, assign: np.ndarray, room: dict[int, int], next_bin: int, capacity: int
) -> int:
    """Put the pieces of ``order`` one by one into the bin with the least room that is enough, else into a new one.

    ``room`` has the room left of open bins; ``assign`` gets the bins. Returns the next free bin number.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for b, r in room.items():
        by_room[r].append(b)
        open_ |= 1 << r
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_ >> length
        if fitting:
            r = length + (fitting & -fitting).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_ &= ~(1 << r)
        else:
            r, b = capacity, next_bin
            next_bin += 1
        assign[i] = b
        by_room[r - length].append(b)
        open_ |= 1 << (r - length)
    return next_bin


def fitness(assign: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Lower is better: the number of bins, then how unevenly they are filled (uneven leaves bins that can go)."""
    fill = np.bincount(assign, lengths)
    fill = fill[fill > 0] / capacity
    return len(fill), -float((fill * fill).sum())


def _renumbered(assign: np.ndarray) -> np.ndarray:
    return np.unique(assign, return_inverse=True)[1].astype(np.int32)


def crossover(
    receiver: np.ndarray, donor: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator
) -> np.ndarray:
    """``receiver`` with some of the fullest bins of ``donor`` injected whole."""
    fill = np.bincount(donor, lengths)
    wanted = max(1, len(fill) // 8)
    chosen = np.zeros(len(fill), bool)
    chosen[np.argsort(-fill + rng.random(len(fill)) * capacity / 64)[: 2 * wanted][rng.permutation(2 * wanted) % 2 == 0][:wanted]] = True
    injected = chosen[donor]
    hit = np.zeros(receiver.max() + 1, bool)
    hit[receiver[injected]] = True
    # the emptiest bins are opened as well, so that displaced pieces find new company
    left = np.where(hit, capacity + 1, np.bincount(receiver, lengths, len(hit)))
    hit[np.argsort(left)[: 1 + len(left) // 50]] = True
    child = receiver.copy()
    child[injected] = len(hit) + donor[injected]
    displaced = np.nonzero(hit[receiver] & ~injected)[0]
    used = np.bincount(receiver, lengths, len(hit))
    room = {b: int(capacity - used[b]) for b in np.nonzero(~hit & (used > 0) & (used < capacity))[0].tolist()}
    extra = np.nonzero(chosen & (fill < capacity))[0]
    room |= {len(hit) + b: int(capacity - fill[b]) for b in extra.tolist()}
    noisy = lengths[displaced] + rng.random(len(displaced)) * rng.choice([0, 8, 64])
    order = displaced[np.argsort(-noisy, kind="stable")]
    best_fit(lengths, order, child, room, len(hit) + len(fill), capacity)
    return _renumbered(child)


def evolve(
    lengths: np.ndarray, population: list[np.ndarray], offspring: int, seed: int, capacity: int = CAPACITY
) -> list[np.ndarray]:
    """POPULATION packings of ``lengths`` or fewer, the best first, bred from ``population`` or from scratch."""
    rng = np.random.default_rng(seed)
    population = list(population)
    while len(population) < POPULATION:
        noise = rng.random(len(lengths)) * (0 if not population else rng.choice([4, 32, 128]))
        packed = np.zeros(len(lengths), np.int32)
        best_fit(lengths, np.argsort(-(lengths + noise), kind="stable"), packed, {}, 0, capacity)
        population.append(packed)
    bound = -(-int(lengths.sum()) // capacity)
    scored = sorted(((fitness(p, lengths, capacity), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
    for n in range(offspring):
        if scored[0][0][0] == bound:
            break
        a, b = sorted(rng.integers(0, len(scored), 2).tolist()), rng.integers(0, len(scored))
        child = crossover(scored[a[0]][2], scored[b][2], lengths, capacity, rng)
        scored.append((fitness(child, lengths, capacity), len(population) + n, child))
        scored.sort(key=lambda x: x[:2])
        scored = scored[:POPULATION]
    return [p for _, _, p in scored[:POPULATION]]


_ISLAND = "block long, island int, lengths array<int>, population array<array<int>>"


def _epoch(islands: DataFrame, epoch: int, capacity: int, offspring: int) -> DataFrame:
    """One epoch on every island: rows of block, island, lengths, population (the best packing first)."""

    def bred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, island, lengths, population in zip(
                batch["block"], batch["island"], batch["lengths"], batch["population"], strict=True
            ):
                sizes = np.asarray(lengths, np.int64)
                start = [np.asarray(p, np.int32) for p in population]
                seed = [epoch, int(island), int(block)]
                best = evolve(sizes, start, offspring, seed, capacity)
                yield pd.DataFrame(
                    {"block": [block], "island": [island], "lengths": [lengths], "population": [[p.tolist() for p in best]]}
                )

    return islands.mapInPandas(bred, _ISLAND)


def _placed(best: DataFrame, capacity: int) -> DataFrame:
    """block, bins, offsets, fills of the chosen packing (block, lengths, packing)."""

    def offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, lengths, packing in zip(batch["block"], batch["lengths"], batch["packing"], strict=True):
                sizes, bins = np.asarray(lengths, np.int64), np.asarray(packing)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                first = np.searchsorted(bins[order], bins[order])
                at = np.empty(len(bins), np.int64)
                at[order] = before - before[first]
                fill = np.bincount(bins, sizes).astype(np.int64)[bins]
                yield pd.DataFrame(
                    {"block": [block], "bins": [bins.tolist()], "offsets": [at.tolist()], "fills": [fill.tolist()]}
                )

    return best.mapInPandas(offsets, "block long, bins array<int>, offsets array<long>, fills array<long>")


def _pack_blocks(
    rows: DataFrame, capacity: int, block: int, islands: int, epochs: int, offspring: int
) -> tuple[DataFrame, int]:
    """``rows`` (__row, length, others) dealt into blocks and packed: with block, bin, offset, fill; how many blocks."""
    names = rows.columns
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(1, -(-rows.count() // block))
    blocks = materialize(
        rows.select(F.pmod(F.xxhash64("__row"), F.lit(n_blocks)).alias("block"), F.struct("__row", *[n for n in names if n != "__row"]).alias("item"))
        .groupBy("block")
        .agg(F.sort_array(F.collect_list("item")).alias("items")),
        "packing-blocks",
    )
    state = blocks.select(
        "block",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.transform("items", lambda i: i["length"].cast("int")).alias("lengths"),
        F.array().cast("array<array<int>>").alias("population"),
    ).repartition(tasks, "block", "island")
    for epoch in range(epochs):
        if epoch:
            elites = state.select(
                F.col("block").alias("to_block"),
                F.pmod(F.col("island") + 1, F.lit(islands)).alias("to_island"),
                F.slice("population", 1, ELITE).alias("elite"),
            )
            state = state.join(
                elites, (F.col("block") == F.col("to_block")) & (F.col("island") == F.col("to_island"))
            ).select("block", "island", "lengths", F.concat("population", "elite").alias("population"))
        state = materialize(_epoch(state, epoch, capacity, offspring), "packing-islands")
    best_of = F.col("population")[0]
    best = (
        state.groupBy("block")
        .agg(F.min_by(F.struct("lengths", best_of.alias("packing")), F.struct(F.array_max(best_of), "island")).alias("b"))
        .select("block", "b.lengths", "b.packing")
    )
    placed = _placed(best, capacity).withColumnRenamed("block", "placed_block")
    packed = (
        blocks.join(placed, F.col("block") == F.col("placed_block"))
        .select("block", F.explode(F.arrays_zip("items", "bins", "offsets", "fills")).alias("p"))
        .select(
            F.struct(*[F.col("p.items").getField(n).alias(n) for n in names]).alias("item"),
            (F.col("block") * (1 << 20) + F.col("p.bins")).alias("bin"),
            F.col("p.offsets").alias("offset"),
            F.col("p.fills").alias("fill"),
        )
    )
    return packed, n_blocks


def pack(
    items: DataFrame,
    capacity: int = CAPACITY,
    block: int = BLOCK,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    offspring: int = OFFSPRING,
) -> DataFrame:
    """``items`` with sequence_id and offset (both long): their places in sequences of ``capacity``.

    ``items`` has length (long, 1 to ``capacity``) and any other columns, which stay. Sequences are filled gapless from
    0. Repeated rows are packed as often as they come. An empty table gives no rows.

    A block dealt too many long pieces leaves room that another lacks. So the pieces of all bins filled below WELL_FILLED
    are dealt and packed a second time, among themselves.
    """
    names = items.columns
    rows = materialize(items.withColumn("__row", F.monotonically_increasing_id()), "pieces")

    def result(df: DataFrame, sequence_id, offset) -> DataFrame:
        return df.select(*[F.col(f"item.{n}").alias(n) for n in names], sequence_id.alias("sequence_id"), offset.alias("offset"))

    item = F.struct("__row", *names).alias("item")
    full = rows.where(F.col("length") == capacity).select(item)
    first, n_blocks = _pack_blocks(rows.where(F.col("length") < capacity), capacity, block, islands, epochs, offspring)
    done = result(full, -1 - F.col("item.__row"), F.lit(0).cast("long"))
    if n_blocks == 1:  # no other block to exchange pieces with
        return done.unionByName(result(first, F.col("bin") * 2, F.col("offset")))
    first = materialize(first, "packed-once")
    well = F.col("fill") >= WELL_FILLED * capacity
    second, _ = _pack_blocks(first.where(~well).select("item.*"), capacity, block, islands, epochs, offspring)
    return done.unionByName(result(first.where(well), F.col("bin") * 2, F.col("offset"))).unionByName(
        result(second, F.col("bin") * 2 + 1, F.col("offset"))
    )


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, **options
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every row.

    Null text is empty: a piece of one token, the end. Repeated rows and null ids are packed like others, ties of
    length in any order. Texts are encoded whole. An empty table gives no rows; other columns are ignored.
    """
    own = only(docs, doc_id=id_col, text=text_col)
    return pack(pieces(own, tokenizer, options.get("capacity", CAPACITY)), **options)
