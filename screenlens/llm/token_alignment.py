"""Alignment of two tokenizers' tokens over the same bytes by diagonal run skipping.

Both tokenizers cover the same bytes, so a document is two increasing arrays of token ends. While the tokens are one to
one, the ends agree at a constant shift of the index: slices of doubling width are compared at that shift, and the
lowest bit that differs in the first failing slice is the run's end. What follows is an irregular group, resolved by two
pointers up to the next end that both share; its sizes give the new shift.

Only ids and counts leave a task. Documents are gathered into shards of about SHARD tokens, a shard being one row: what
is known of each document, and the shard's distinct pairs of ids with the number of its documents that hold them. Pairs
are summed over all shards, the sums joined back to the shards that hold the pair, and each shard is finished alone. So
no pair of ids has more rows than there are shards, however many documents hold it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlens.llm.common import only
from screenlens.llm.packing import encoder, tokenizer_path
from screenlens.session import materialize

#: Tokens of a shard; a longer document is a shard of its own.
SHARD = 1_000_000
#: Shards of one task are numbered from its number times this.
SHARDS_OF_TASK = 1 << 24
#: A Python worker keeps the ids of at most so many different words, none longer than WORD_LENGTH signs.
WORDS_KEPT = 200_000
WORD_LENGTH = 32

_SHARD_SCHEMA = (
    "shard long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, held array<int>, pair array<int>, times array<int>, code array<long>, docs array<long>"
)
_DIGEST_SCHEMA = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


@lru_cache(maxsize=2)
def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level BPE: its printable stand-ins read back as bytes."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab()
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        tokens[i] = bytes(byte_of[c] for c in entry)
    return tokens


@lru_cache(maxsize=2)
def pieces_of(path: str):
    """The SentencePiece model in ``path`` and the bytes of each of its pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)

    def read(piece: str) -> bytes:
        code = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(code[1], 16)]) if code else piece.replace("▁", " ").encode()

    return model, [read(model.id_to_piece(i)) for i in range(model.get_piece_size())]


class Words(dict):
    """Ids of single words by a SentencePiece model, as bytes of int32, and of texts by their words.

    No piece holds a space mark after another sign, so nothing merges across a single space: the ids of a text are those
    of its words, and the words of a text that are new are encoded together. Frequent words come early and are kept.
    """

    def __init__(self, model, tokens: list[bytes]):
        self.model, self.tokens = model, tokens
        self.opens = np.array([t.startswith(b" ") for t in tokens])
        # A model that joins words, drops or adds spaces, or has no bytes for a rare sign is asked for whole texts.
        self.apart = (
            not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(len(tokens)))
            and any(model.is_byte(i) for i in range(len(tokens)))
            and b"".join(map(tokens.__getitem__, model.encode(" a  b "))) == b"  a  b "
        )

    def whole(self, text: str) -> list[int] | None:
        """The model's ids of ``text``, None if they do not give it back."""
        ids = self.model.encode(text)
        return ids if b"".join(map(self.tokens.__getitem__, ids)) == (" " + text).encode() else None

    def ids(self, text: str) -> np.ndarray | None:
        """The ids of a text that is not empty, None if they do not give it back."""
        words = text.split(" ")
        if not self.apart or "" in words or "▁" in text:
            ids = self.whole(text)
            return None if ids is None else np.array(ids, np.int64)
        new = [word for word in dict.fromkeys(words) if word not in self]
        if new:
            ids = self.whole(" ".join(new))
            if ids is None:
                return None
            line = np.array(ids, "<i4")
            cuts = [*(4 * np.flatnonzero(self.opens[line])).tolist(), 4 * len(line)]
            data = line.tobytes()
            self.update(zip(new, [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        found = np.frombuffer(b"".join(map(self.__getitem__, words)), "<i4").astype(np.int64)
        full = len(self) > WORDS_KEPT
        for word in new:
            if full or len(word) > WORD_LENGTH:
                del self[word]
        return found


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(*pieces_of(path))


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two arrays of token ends that rise strictly to the same last end.

    Returns, for every group, how many tokens of each side it has, and for every pair of tokens whose bytes overlap the
    index on each side, in order.
    """
    a, b = ends_a.astype("<i8").tobytes(), ends_b.astype("<i8").tobytes()
    at_a, at_b = ends_a.tolist(), ends_b.tolist()
    n, m = len(at_a), len(at_b)
    i = j = 0
    starts_i, starts_j, runs = [], [], []  # a one-to-one run, then the group that ends it
    size_a, size_b = [], []
    left, right = [], []
    while i < n:
        from_i, from_j, width = i, j, 16
        while i < n:
            x, y = a[8 * i : 8 * (i + width)], b[8 * j : 8 * (j + width)]
            if x != y:  # the lowest bit that differs is in the first end that does
                differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
                same = (differ & -differ).bit_length() - 1 >> 6
                i, j = i + same, j + same
                break
            same = len(x) >> 3
            i, j, width = i + same, j + same, 2 * width
        starts_i.append(from_i)
        starts_j.append(from_j)
        runs.append(i - from_i)
        if i == n:
            break
        p, q = i, j
        x, y = at_a[p], at_b[q]
        left.append(p)
        right.append(q)
        while x != y:
            if x < y:
                p += 1
                x = at_a[p]
            else:
                q += 1
                y = at_b[q]
            left.append(p)
            right.append(q)
        size_a.append(p + 1 - i)
        size_b.append(q + 1 - j)
        i, j = p + 1, q + 1
    run = np.array(runs, np.int64)
    within = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
    straight = np.repeat(np.array(starts_i, np.int64), run) + within
    link_a = np.concatenate([straight, np.array(left, np.int64)])
    link_b = np.concatenate([np.repeat(np.array(starts_j, np.int64), run) + within, np.array(right, np.int64)])
    order = np.lexsort((link_b, link_a))
    # A group of one to one per token of a run, and the irregular groups between the runs.
    place = np.cumsum(run)[: len(size_a)]
    groups_a = np.insert(np.ones(run.sum(), np.int64), place, np.array(size_a, np.int64))
    groups_b = np.insert(np.ones(run.sum(), np.int64), place, np.array(size_b, np.int64))
    return groups_a, groups_b, link_a[order], link_b[order]


class Aligner:
    """Two tokenizers, and what a document looks like through both."""

    def __init__(self, byte_level: str, pieces: str):
        self.encode = encoder(byte_level)
        self.tokens_a = byte_level_tokens(byte_level)
        self.tokens_b = pieces_of(pieces)[1]
        self.words = words_of(pieces)
        self.length_a = np.array([len(t) for t in self.tokens_a], np.int64)
        self.length_b = np.array([len(t) for t in self.tokens_b], np.int64)
        va, vb = len(self.tokens_a), len(self.tokens_b)
        self.written = np.array(
            [f"{i}{mark}" for count, marks in ((va, ",|"), (vb, ",;")) for mark in marks for i in range(count)], "S"
        )

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, None for a text without tokens."""
        if not text:
            return None
        b = self.words.ids(text)
        if b is None:
            return None
        a = self.encode(" " + text)
        if b"".join(map(self.tokens_a.__getitem__, a)) != (" " + text).encode():
            return None
        return np.array(a, np.int64), b

    def groups(self, text: str | None):
        """n_a, n_b, n_groups, n_links, groups as text, codes of linked id pairs and how often each is linked."""
        found = self.tokens(text)
        if found is None:
            return 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = found
        groups_a, groups_b, link_a, link_b = align(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        codes, times = np.unique(a[link_a] * len(self.tokens_b) + b[link_b], return_counts=True)
        return len(a), len(b), len(groups_a), len(link_a), self.rendered(a, b, groups_a, groups_b), codes, times

    def rendered(self, a: np.ndarray, b: np.ndarray, groups_a: np.ndarray, groups_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: every id goes to its place with the mark that follows it."""
        va, vb = len(self.tokens_a), len(self.tokens_b)
        ends_a, ends_b = np.cumsum(groups_a), np.cumsum(groups_b)
        a, b = a.copy(), b + 2 * va
        a[ends_a - 1] += va
        b[ends_b - 1] += vb
        line = np.empty(len(a) + len(b), np.int64)
        line[np.arange(len(a)) + np.repeat(ends_b - groups_b, groups_a)] = a
        line[np.arange(len(b)) + np.repeat(ends_a, groups_b)] = b
        return self.written[line].tobytes().translate(None, b"\0")[:-1].decode()  # short ones are filled up with zeros


def shards(docs: DataFrame, byte_level: str, pieces: str, size: int = SHARD) -> DataFrame:
    """One row per shard of ``docs`` (doc_id, text).

    Arrays by document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, ``held`` (how many distinct pairs). ``pair``
    and ``times`` list these pairs of all documents one after the other, ``pair`` pointing into ``code``, the shard's
    distinct pairs, of which ``docs`` counts the documents.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(byte_level, pieces)
        number = TaskContext.get().partitionId() * SHARDS_OF_TASK
        gathered, tokens = [], 0

        def row() -> pd.DataFrame:
            ids, n_a, n_b, n_groups, n_links, sha, codes, times = zip(*gathered, strict=True)
            code, pair, docs_of = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            held = [len(c) for c in codes]
            cells = [number, list(ids), n_a, n_b, n_groups, n_links, sha, held, pair, np.concatenate(times), code, docs_of]
            names = [part.split()[0] for part in _SHARD_SCHEMA.split(", ")]
            return pd.DataFrame({name: [cell] for name, cell in zip(names, cells, strict=True)})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                n_a, n_b, n_groups, n_links, line, codes, times = aligner.groups(text)
                sha = hashlib.sha256(line.encode()).hexdigest() if line else ""
                gathered.append((None if pd.isna(doc_id) else int(doc_id), n_a, n_b, n_groups, n_links, sha, codes, times))
                tokens += n_a + n_b + 1
                if tokens >= size:
                    yield row()
                    number += 1
                    gathered, tokens = [], 0
        if gathered:
            yield row()

    return docs.mapInPandas(scan, _SHARD_SCHEMA)


def pair_counts(shards_: DataFrame, pieces_size: int) -> DataFrame:
    """code, a, b, count (documents of the corpus that hold the pair linked), best (no pair of ``a`` has a higher count)."""
    pairs = shards_.select(F.explode(F.arrays_zip("code", "docs")).alias("p")).select("p.code", "p.docs")
    totals = pairs.groupBy("code").agg(F.sum("docs").alias("count"))
    totals = totals.withColumn("a", F.expr(f"code div {pieces_size}")).withColumn("b", F.col("code") % pieces_size)
    # At most one row per id of the vocabulary, so it may be sent to every task.
    highest = totals.groupBy(F.col("a").alias("of")).agg(F.max("count").alias("highest"))
    marked = totals.join(F.broadcast(highest), F.col("a") == F.col("of"))
    return marked.select("code", "a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def token_alignment(
    docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, shard: int = SHARD
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): how two tokenizers' tokens of every text of ``docs`` (doc_id, text) overlap.

    ``byte_level`` is the file of a byte-level BPE (A), which reads space and text, ``pieces`` a SentencePiece model (B),
    which adds the space; None for the public ones. Documents: doc_id, n_a, n_b tokens, n_groups between byte offsets
    where tokens of both end, n_links (pairs of tokens whose bytes overlap), n_best and count_sum of their id pairs, and
    groups_sha256. Pairs: ids a and b, count (documents that hold the pair linked), best (highest of its a).

    A text that is null, empty, or not given back by the tokens of A or B has zeros and ''. Every row is a document of
    its own, repeated or null ids too. Ties are all best. An empty table gives no rows; other columns are ignored.
    """
    byte_level, pieces = byte_level or tokenizer_path(), pieces or tokenizer_path("piece_bpe_32k.model")
    size = pieces_of(pieces)[0].get_piece_size()
    held = materialize(shards(only(docs, doc_id="doc_id", text="text"), byte_level, pieces, shard), "token_shards")
    counts = materialize(pair_counts(held, size), "token_pairs")
    wanted = held.select("shard", F.explode("code").alias("code"))
    known = wanted.join(counts.select("code", "count", "best"), "code").select("shard", "code", "count", "best")
    whole = held.drop("docs").withColumnRenamed("shard", "own")

    def finish(key, row: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        one = row.iloc[0]
        order = np.argsort(pairs["code"].to_numpy())  # as in ``code``, which is sorted
        count, best = pairs["count"].to_numpy()[order], pairs["best"].to_numpy().astype(bool)[order]
        pair, times = np.asarray(one["pair"], np.int64), np.asarray(one["times"], np.int64)
        document = np.repeat(np.arange(len(one["held"])), one["held"])
        sums = np.zeros((2, len(one["held"])), np.int64)
        if len(pair):
            np.add.at(sums[0], document, times * best[pair])
            np.add.at(sums[1], document, times * count[pair])
        columns = {name: list(one[name]) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        columns |= {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": list(one["groups_sha256"])}
        return pd.DataFrame(columns).astype({"doc_id": "Int64"})

    done = whole.groupBy("own").cogroup(known.groupBy("shard")).applyInPandas(finish, _DIGEST_SCHEMA)
    return done, counts.select("a", "b", "count", "best")
