"""Katz backoff language model over words: counts in partitioned tables, scores evaluated recursively per token.

P(w|h) = d(r) r / den(h) for a bigram seen r times, else alpha(h) P(w); P(w) = d(r) r / (N + 1) for a known word, and
what is left goes to the one class of unknown words. d are Good-Turing discounts with Katz's cut at K, taken from the
counts of counts; den(h) is c(h), plus one above K, where no count may be discounted, so that something is always left;
alpha(h) makes the sum over all words and the unknown class exactly one.

Documents are encoded once into shards of bounded size: words as numbers of the shard's own vocabulary. What is shuffled
is not tokens but each shard's *distinct* words and bigrams, as 64-bit hashes in packed arrays, to buckets of the hash
range; a bigram that makes up a third of the corpus is one entry per shard. The buckets add up and answer each shard in
its own order, so an answer is a few bits per entry. Backoff weights are summed the same way, each bigram by the one
shard that the bucket named its owner, and are fetched only for histories that a document needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlens.llm.common import only, remainder
from screenlens.session import materialize

#: Counts up to this are discounted.
K = 5
#: Tokens of a shard (more only where one document has more), and tokens whose bigrams share a bucket.
SHARD_TOKENS = 1_000_000
BUCKET_TOKENS = 1_000_000

BEGIN, END = 0, 1
# no word holds white space, so these clash with none
_BEGIN_HASH, _END_HASH = xxhash.xxh64_intdigest(b" begin"), xxhash.xxh64_intdigest(b" end")


def pack(values: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, compressed; small numbers take few bits."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T) if len(values) else values
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned keys as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 2
        return number


_SHARD = "shard long, doc_ids array<long>, held array<boolean>, sizes array<int>, words binary, tokens binary"


def encode(docs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shards of ``docs`` (doc_id, text, held): ids, sizes (tokens with the end), hashes of the shard's words, tokens."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 32
        vocabulary, ids, held, parts, total, shards = _Vocabulary(), [], [], [], 0, 0

        def closed() -> pd.DataFrame:
            hashes = [_BEGIN_HASH, _END_HASH, *map(xxhash.xxh64_intdigest, vocabulary)]
            return pd.DataFrame(
                {
                    "shard": [base + shards],
                    "doc_ids": [ids],
                    "held": [held],
                    "sizes": [[len(p) for p in parts]],
                    "words": [np.array(hashes, np.uint64).tobytes()],
                    "tokens": [pack(np.concatenate(parts))],
                }
            )

        for batch in batches:
            for doc_id, text, out in zip(batch["doc_id"], batch["text"], batch["held"], strict=True):
                words = (text or "").encode().lower().split()
                if parts and total + len(words) >= shard_tokens:
                    yield closed()
                    vocabulary, ids, held, parts, total, shards = _Vocabulary(), [], [], [], 0, shards + 1
                tokens = np.full(len(words) + 1, END, np.uint32)
                tokens[:-1] = np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words))
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                held.append(bool(out))
                parts.append(tokens)
                total += len(tokens)
        if parts:
            yield closed()

    return docs.mapInPandas(scan, _SHARD)


class Shard:
    """A shard's tokens with their histories, and its distinct words and bigrams in the order of their hashes."""

    def __init__(self, row):
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.held = np.asarray(row["held"], bool)
        self.hashes = np.frombuffer(row["words"], np.uint64)
        self.tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        self.history = np.empty_like(self.tokens)
        self.history[1:] = self.tokens[:-1]
        self.history[self.starts] = BEGIN
        self.learnt = np.repeat(~self.held, self.sizes)
        n = len(self.hashes)
        self.word_order = np.argsort(self.hashes, kind="stable")
        pairs, self.pair_of_token = np.unique(self.history * n + self.tokens, return_inverse=True)
        self.pair_history, self.pair_word = pairs // n, pairs % n
        mixed = (self.hashes[self.pair_history] * np.uint64(0x9E3779B97F4A7C15)) ^ self.hashes[self.pair_word]
        mixed ^= mixed >> np.uint64(32)
        self.pair_hashes = mixed * np.uint64(0xD6E8FEB86659FD93)
        self.pair_order = np.argsort(self.pair_hashes, kind="stable")

    def word_counts(self) -> np.ndarray:
        """Times a word was learnt; for BEGIN, as often as a learnt document began."""
        counts = np.bincount(self.tokens[self.learnt], minlength=len(self.hashes))
        counts[BEGIN] = (~self.held).sum()
        return counts

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_of_token[self.learnt], minlength=len(self.pair_history))

    def held_words(self) -> np.ndarray:
        """Words that are a history in a held-out document."""
        found = np.zeros(len(self.hashes), bool)
        found[self.history[~self.learnt]] = True
        return found


def _edges(n_buckets: int) -> np.ndarray:
    """First hash of each bucket but the first."""
    return np.array([(i << 64) // n_buckets for i in range(1, n_buckets)], np.uint64)


def _segments(sorted_hashes: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    cuts = [0, *np.searchsorted(sorted_hashes, _edges(n_buckets)).tolist(), len(sorted_hashes)]
    for bucket, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            yield bucket, slice(a, b)


_ENTRIES = "pairs boolean, bucket int, shard long, keys binary, counts binary, held binary"


def _entries(shards: DataFrame, n_buckets: int) -> DataFrame:
    """Every shard's distinct words and bigrams with their learnt counts, by bucket."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                s = Shard(row)
                out = []
                held = s.held_words()[s.word_order]
                for pairs, hashes, counts in (
                    (False, s.hashes[s.word_order], s.word_counts()[s.word_order]),
                    (True, s.pair_hashes[s.pair_order], s.pair_counts()[s.pair_order]),
                ):
                    for bucket, at in _segments(hashes, n_buckets):
                        wanted = b"" if pairs else pack(held[at].astype(np.uint8))
                        out.append(
                            (pairs, bucket, row["shard"], pack_sorted(hashes[at]), pack(counts[at].astype(np.uint32)), wanted)
                        )
                yield pd.DataFrame(out, columns=["pairs", "bucket", "shard", "keys", "counts", "held"])

    return shards.mapInPandas(scan, _ENTRIES)


_ANSWERS = "shard long, pairs boolean, bucket int, counts binary, flags binary, statistics array<long>"


def _added_up(entries: DataFrame) -> DataFrame:
    """Total counts for every shard's entries, in its order.

    ``flags``: for bigrams, whether this shard owns it; for words, whether some held-out document has it as a history.
    One row per bucket has a null shard and statistics: known entries, their counts' sum, entries of count 1 to K + 1.
    """

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        pairs, bucket = bool(rows["pairs"].iloc[0]), int(rows["bucket"].iloc[0])
        keys = [unpack_sorted(k) for k in rows["keys"]]
        cuts = np.cumsum([0, *map(len, keys)])
        every, of = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpack(c, np.uint32) for c in rows["counts"]])
        totals = np.bincount(of, counts, len(every)).astype(np.uint32)
        flags = np.zeros(len(of), np.uint8)
        if pairs:
            learnt = np.nonzero(counts)[0]
            flags[learnt[np.unique(of[learnt], return_index=True)[1]]] = 1
        else:
            held = np.concatenate([unpack(h, np.uint8) for h in rows["held"]])
            flags = (np.bincount(of, held, len(every)) > 0).astype(np.uint8)[of]
            totals_of_words = totals.copy()
            totals_of_words[np.searchsorted(every, np.uint64(_BEGIN_HASH)) : np.searchsorted(every, np.uint64(_BEGIN_HASH), "right")] = 0
        known = totals if pairs else totals_of_words
        statistics = [int((known > 0).sum()), int(known.sum(dtype=np.int64))]
        statistics += [int((known == r).sum()) for r in range(1, K + 2)]
        answered = totals[of]
        out = [
            (int(shard), pairs, bucket, pack(answered[a:b]), pack(flags[a:b]), None)
            for shard, a, b in zip(rows["shard"], cuts[:-1], cuts[1:], strict=True)
        ]
        out.append((None, pairs, bucket, b"", b"", statistics))
        names = ["shard", "pairs", "bucket", "counts", "flags", "statistics"]
        return pd.DataFrame(out, columns=names).astype({"shard": "Int64"})

    return entries.groupBy("pairs", "bucket").applyInPandas(reduce, _ANSWERS)


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Good-Turing discounts of the counts 0 to K (that of 0 is not used).

    Where counts of counts give none between 0 and 1 (tables too small for the estimate), half a count is taken off.
    """
    n = [0, *counts_of_counts]
    found = np.ones(K + 1)
    cut = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        if n[r] and cut < 1:
            found[r] = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut)
        if not n[r] or cut >= 1 or not 0 < found[r] < 1:
            found[r] = (r - 0.5) / r
    return found


class Model:
    """What every task needs to know: discounts and totals, a few numbers."""

    def __init__(self, words: list[int], pairs: list[int]):
        self.types, self.tokens = words[:2]
        self.word_discounts, self.pair_discounts = discounts(words[2:]), discounts(pairs[2:])
        small = sum(r * n for r, n in enumerate(words[2 : 2 + K], 1))
        kept = sum(r * n * self.word_discounts[r] for r, n in enumerate(words[2 : 2 + K], 1))
        self.unknown = 1 - (self.tokens - small + kept) / (self.tokens + 1)

    def words(self, counts: np.ndarray) -> np.ndarray:
        """P(w) for words of these counts; that of the unknown class for 0."""
        kept = counts * self.word_discounts[np.minimum(counts, K)] if len(counts) else counts
        kept = np.where(counts > K, counts, kept)
        return np.where(counts > 0, kept / (self.tokens + 1), self.unknown)

    def seen(self, counts: np.ndarray) -> np.ndarray:
        """d(r) r of bigrams of these counts."""
        return np.where(counts > K, counts, counts * self.pair_discounts[np.minimum(counts, K)])

    @staticmethod
    def den(counts: np.ndarray) -> np.ndarray:
        return counts + (counts > K)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


_SCORED = (
    "shard long, kind string, bucket int, a binary, b binary, c binary, "
    "doc_ids array<long>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>"
)
_NAMES = ["shard", "kind", "bucket", "a", "b", "c", "doc_ids", "held", "n_tokens", "n_known", "base", "score"]


def _scored(shards: DataFrame, answers: DataFrame, model: Model, n_buckets: int) -> DataFrame:
    """Per shard: its documents' scores but for backoff weights ('docs'), which of its documents need the weight of which
    history ('wait' and, by bucket, 'need'), and what its own bigrams add to the weights of others ('sums')."""

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        s = Shard(row)

        def in_order(pairs: bool, order: np.ndarray):
            rows = right[right["pairs"] == pairs].sort_values("bucket")
            counts, flags = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
            counts[order] = np.concatenate([unpack(c, np.uint32) for c in rows["counts"]])
            flags[order] = np.concatenate([unpack(f, np.uint8) for f in rows["flags"]]).astype(bool)
            return counts, flags

        word_counts, wanted = in_order(False, s.word_order)
        pair_counts, owned = in_order(True, s.pair_order)
        p_word = model.words(word_counts)
        of_history = word_counts[s.pair_history]
        with np.errstate(divide="ignore", invalid="ignore"):
            direct = np.log10(model.seen(pair_counts) / model.den(of_history))
        backed = pair_counts == 0
        log_pair = np.where(backed, np.log10(p_word)[s.pair_word], direct)
        waits = backed & (of_history > 0)
        docs_of = np.repeat(np.arange(len(s.sizes)), s.sizes)
        per_doc = lambda values: np.bincount(docs_of, values, len(s.sizes))
        token_counts = word_counts[s.tokens]
        out = [
            (
                row["shard"], "docs", None, b"", b"", b"", row["doc_ids"], row["held"], s.sizes.tolist(),
                per_doc((token_counts > 0).astype(float)).astype(np.int64).tolist(),
                per_doc(model.base(token_counts)).tolist(), per_doc(log_pair[s.pair_of_token]).tolist(),
            )
        ]
        blank = [None] * 6
        # histories whose weight is needed, numbered in the order of their hashes
        waiting = waits[s.pair_of_token]
        needed = np.zeros(len(s.hashes), bool)
        needed[s.history[waiting]] = True
        order = s.word_order[needed[s.word_order]]
        number = np.zeros(len(s.hashes), np.int64)
        number[order] = np.arange(len(order))
        out.append(
            (row["shard"], "wait", None, pack(docs_of[waiting].astype(np.uint32)),
             pack(number[s.history[waiting]].astype(np.uint32)), b"", *blank)
        )
        for bucket, at in _segments(s.hashes[order], n_buckets):
            w = order[at]
            out.append((row["shard"], "need", bucket, pack_sorted(s.hashes[w]), pack(word_counts[w]), b"", *blank))
        mine = owned & wanted[s.pair_history]
        of = s.pair_history[mine]
        seen = np.bincount(of, model.seen(pair_counts[mine]), len(s.hashes))
        below = np.bincount(of, p_word[s.pair_word[mine]], len(s.hashes))
        order = s.word_order[(seen > 0)[s.word_order]]
        for bucket, at in _segments(s.hashes[order], n_buckets):
            w = order[at]
            out.append(
                (row["shard"], "sums", bucket, pack_sorted(s.hashes[w]), pack(seen[w]), pack(below[w]), *blank)
            )
        return pd.DataFrame(out, columns=_NAMES).astype({"bucket": "Int32"})

    answers = answers.where("shard is not null").select("shard", "pairs", "bucket", "counts", "flags")
    return shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(score, _SCORED)


def _weights(scored: DataFrame) -> DataFrame:
    """shard, bucket, weights: log10 alpha of the histories that a shard needs, in its order."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        need, sums = rows[rows["kind"] == "need"], rows[rows["kind"] == "sums"]
        if not len(need):
            return pd.DataFrame({"shard": [], "bucket": [], "weights": []})
        keys = [np.zeros(0, np.uint64), *[unpack_sorted(k) for k in sums["a"]]]
        every, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = [
            np.bincount(of, np.concatenate([np.zeros(0), *[unpack(v, np.float64) for v in sums[c]]]), len(every))
            for c in ("b", "c")
        ]
        out = []
        for shard, bucket, a, b in zip(need["shard"], need["bucket"], need["a"], need["b"], strict=True):
            wanted, den = unpack_sorted(a), Model.den(unpack(b, np.int64))
            at = np.minimum(np.searchsorted(every, wanted), max(len(every) - 1, 0))
            found = every[at] == wanted if len(every) else np.zeros(len(wanted), bool)
            seen, below = (np.where(found, t[at], 0) if len(every) else np.zeros(len(wanted)) for t in total)
            out.append((shard, bucket, pack(np.log10((1 - seen / den) / (1 - below)))))
        return pd.DataFrame(out, columns=["shard", "bucket", "weights"])

    rows = scored.where("kind in ('need', 'sums')").select("bucket", "shard", "kind", "a", "b", "c")
    return rows.groupBy("bucket").applyInPandas(reduce, "shard long, bucket int, weights binary")


def _added(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """shard, added: what backoff weights add to each document's score."""

    def add(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"shard": [], "added": []})
        row = left.iloc[0]
        docs, history = unpack(row["a"], np.uint32).astype(np.int64), unpack(row["b"], np.uint32)
        found = [np.zeros(0), *[unpack(w, np.float64) for w in right.sort_values("bucket")["weights"]]]
        total = np.bincount(docs, np.concatenate(found)[history], int(row["n"]))
        return pd.DataFrame({"shard": [row["shard"]], "added": [total.tolist()]})

    waits = scored.where("kind = 'wait'").select("shard", "a", "b")
    sizes = scored.where("kind = 'docs'").select(F.col("shard").alias("docs_shard"), F.size("doc_ids").alias("n"))
    left = waits.join(sizes, F.col("shard") == F.col("docs_shard")).select("shard", "a", "b", "n")
    return left.groupBy("shard").cogroup(weights.groupBy("shard")).applyInPandas(add, "shard long, added array<double>")


def lm_score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 5,
    held: int = 1,
    shard_tokens: int = SHARD_TOKENS,
    bucket_tokens: int = BUCKET_TOKENS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    Tokens are runs without ASCII white space, A-Z lower-cased, and one end per document. The model learns from rows
    whose crc32 of the id modulo ``modulus`` is not ``held``; the others, and rows with a null id, are held out.
    ``score`` is the log10 probability of the tokens, ``base_score`` that of words alone with half a count added.

    Null text is empty: its one token is the end. Repeated rows are counted and scored each. Nothing learnt: every
    token is the unknown class, with probability one. An empty table gives no rows; other columns are ignored. Words and
    bigrams are told apart by 64-bit hashes: n different ones clash n * n / 2 ** 65 times on average.
    """
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(True))
    own = only(docs, doc_id=id_col, text=text_col).withColumn("held", out)
    shards = materialize(encode(own, shard_tokens), "lm-shards")
    n_tokens = shards.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    n_buckets = max(1, -(-n_tokens // bucket_tokens))
    answers = materialize(_added_up(_entries(shards, n_buckets)), "lm-counts")
    totals = {False: [0] * (K + 3), True: [0] * (K + 3)}
    sums = [F.sum(F.col("statistics")[i]).alias(f"s{i}") for i in range(K + 3)]
    for r in answers.where("shard is null").groupBy("pairs").agg(*sums).collect():
        totals[r["pairs"]] = [r[f"s{i}"] for i in range(K + 3)]
    model = Model(totals[False], totals[True])
    scored = materialize(_scored(shards, answers, model, n_buckets), "lm-scored")
    added = _added(scored, _weights(scored)).withColumnRenamed("shard", "added_shard")
    done = scored.where("kind = 'docs'").join(added, F.col("shard") == F.col("added_shard"))
    rows = done.select(F.explode(F.arrays_zip("doc_ids", "held", "n_tokens", "n_known", "base", "score", "added")).alias("d"))
    return rows.select(
        F.col("d.doc_ids").alias("doc_id"),
        F.col("d.held").alias("held_out"),
        F.col("d.n_tokens").alias("n_tokens"),
        F.col("d.n_known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("d.base").alias("base_score"),
        (F.col("d.score") + F.col("d.added")).alias("score"),
    )
