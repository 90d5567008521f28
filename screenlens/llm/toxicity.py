"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other documents are unlabelled, whether a label says 0 or nothing. The
risk of a classifier is estimated as pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)), pi being the share of positives; where
the bracket turns negative, the classifier has begun to memorise and its step is reversed.

A text is the set of its words and of their beginnings and ends, hashed to a fixed number of features. Fitting takes a
sample with documented bounds: the features whose rates differ most between positives and unlabelled texts are selected,
then each of SHARDS tasks trains a numpy classifier on all positives and its share of the unlabelled texts. The scorer is
their mean, of fixed size. Scoring is one pass over whole texts that keeps no more than a table of words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlens.llm.common import only, remainder
from screenlens.session import materialize

DIMENSIONS = 1 << 18
#: Bounds of the sample that is fitted: confirmed toxic documents and unlabelled ones.
MAX_POSITIVE = 6000
MAX_UNLABELLED = 18000
#: Classifiers, each trained on the positives and its share of the unlabelled texts.
SHARDS = 3
#: Features that a classifier may use, and how many standard deviations their rates must differ by.
SELECTED = 1500
LEAST_Z = 2.0
#: Steps over all of a shard's sample, their size, and the penalty on squared weights.
STEPS = 150
RATE = 0.02
PENALTY = 2e-3

_WORD = re.compile(r"[^\W_]+")


def word_features(word: str) -> list[int]:
    """Feature numbers of a word: itself, its beginnings of 3 to 7 letters and its ends of 3 to 5."""
    names = ["=" + word]
    names += ["^" + word[:n] for n in range(3, 8) if len(word) >= n]
    names += ["$" + word[-n:] for n in range(3, 6) if len(word) >= n]
    return [zlib.crc32(n.encode()) % DIMENSIONS for n in names]


class Words(dict):
    """The features of words, kept as they come; forgets all once it is large."""

    LIMIT = 300_000

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights

    def __missing__(self, word: str):
        if len(self) >= self.LIMIT:
            self.clear()
        found = word_features(word)
        if self.weights is not None:
            found = [f for f in found if self.weights[f]]
        self[word] = found
        return found


def text_features(text: str | None, words: Words) -> np.ndarray:
    """The distinct features of a text, sorted."""
    seen: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        seen.update(words[word])
    return np.fromiter(sorted(seen), np.int64, len(seen))


def _rows_to_matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated features and the row of each."""
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return flat, np.repeat(np.arange(len(rows)), sizes)


def nnpu_fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float
) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear classifier under the logistic loss; rows are arrays of feature numbers."""
    w, bias = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    (p_at, p_row), (u_at, u_row) = _rows_to_matrix(positive), _rows_to_matrix(unlabelled)
    n_p, n_u = len(positive), len(unlabelled)

    def probability(at, row, n):
        return 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], n) + bias, -40, 40)))

    def gradient(at, row, per_row):
        return np.append(np.bincount(at, per_row[row], n_features), per_row.sum())

    mean, square = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, STEPS + 1):
        sp, su = probability(p_at, p_row, n_p), probability(u_at, u_row, n_u)
        negative_risk = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
        # slopes of the logistic losses: s where the text counts as negative, s - 1 where as positive
        negative = gradient(u_at, u_row, su / n_u) - gradient(p_at, p_row, prior * sp / n_p)
        if negative_risk < 0:
            slope = -negative
        else:
            slope = negative + gradient(p_at, p_row, prior * (sp - 1) / n_p)
        slope[:-1] += PENALTY * w
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return w, bias


class Scorer:
    """Weights of all features and an intercept; the mean of the shards' classifiers."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias


def fit(texts: DataFrame, labels: DataFrame, shards: int = SHARDS) -> Scorer:
    """Fits ``texts`` (doc_id, text) to ``labels`` (doc_id, toxic); null labels are as none.

    At most MAX_POSITIVE confirmed toxic documents and MAX_UNLABELLED others enter, those with the smallest hash of the
    id. The prior is the share of toxic among all labelled documents. Without any confirmed document, or without others,
    every text scores 0.
    """
    toxic = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumnRenamed("doc_id", "label_id")
    ids = materialize(
        texts.where("doc_id is not null")
        .select("doc_id", F.xxhash64("doc_id").alias("draw"))
        .distinct()
        .join(toxic, F.col("doc_id") == F.col("label_id"), "left")
        .select("doc_id", "draw", "toxic"),
        "toxicity-ids",
    )
    counts = ids.agg(F.count("toxic").alias("labelled"), F.sum(F.when(F.col("toxic") == 1, 1)).alias("toxic")).first()
    if not counts["toxic"]:
        return Scorer(np.zeros(DIMENSIONS), -40.0)
    prior = min(max(counts["toxic"] / counts["labelled"], 0.01), 0.6)
    is_toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    drawn = [ids.where(c).orderBy("draw").limit(n) for c, n in ((is_toxic, MAX_POSITIVE), (~is_toxic, MAX_UNLABELLED))]
    drawn = drawn[0].union(drawn[1]).select(F.col("doc_id").alias("drawn_id"), "draw", is_toxic.alias("positive"))
    # at most MAX_POSITIVE + MAX_UNLABELLED rows of two numbers: small enough to send to every task
    sample = materialize(
        texts.select("doc_id", "text")
        .join(F.broadcast(drawn), F.col("doc_id") == F.col("drawn_id"))
        .select("positive", "draw", "text"),
        "toxicity-sample",
    )
    chosen = _selected(sample)
    place = {f: i for i, f in enumerate(chosen)}

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            batch["features"] = [[place[f] for f in text_features(t, words).tolist() if f in place] for t in batch["text"]]
            yield batch[["positive", "draw", "features"]]

    def trained(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(order=[tuple(f) for f in rows["features"]]).sort_values(["draw", "order"])
        found = [np.asarray(f, np.int64) for f in rows["features"]]
        positive = [f for f, p in zip(found, rows["positive"], strict=True) if p]
        unlabelled = [f for f, p in zip(found, rows["positive"], strict=True) if not p]
        if not positive or not unlabelled:
            return pd.DataFrame({"feature": [], "weight": []})
        w, bias = nnpu_fit(positive, unlabelled, len(chosen), prior)
        return pd.DataFrame({"feature": np.append(chosen, -1).astype(np.int64), "weight": np.append(w, bias)})

    small = sample.mapInPandas(projected, "positive boolean, draw long, features array<int>")
    own = F.array(F.pmod(F.xxhash64("draw"), F.lit(shards)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    parts = small.withColumn("shard", F.explode(F.when(F.col("positive"), every).otherwise(own)))
    parts = parts.groupBy("shard").applyInPandas(trained, "feature long, weight double")
    # at most SELECTED + 1 rows
    rows = parts.groupBy("feature").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).collect()
    n = max((r["n"] for r in rows if r["feature"] == -1), default=0)
    if not n:
        return Scorer(np.zeros(DIMENSIONS), -40.0)
    weights, bias = np.zeros(DIMENSIONS), 0.0
    for r in rows:
        if r["feature"] < 0:
            bias = r["weight"] / n
        else:
            weights[r["feature"]] = r["weight"] / n
    return Scorer(weights, bias)


def _selected(sample: DataFrame) -> list[int]:
    """The SELECTED features whose document rates among positives and others differ most, in standard deviations."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, counts, n = Words(), np.zeros((2, DIMENSIONS), np.int64), [0, 0]
        for batch in batches:
            for text, positive in zip(batch["text"], batch["positive"], strict=True):
                counts[int(positive)][text_features(text, words)] += 1
                n[int(positive)] += 1
        some = np.nonzero(counts.any(axis=0))[0]
        yield pd.DataFrame(
            {"feature": np.append(some, -1), "others": np.append(counts[0][some], n[0]), "toxic": np.append(counts[1][some], n[1])}
        )

    rows = (
        sample.select("text", "positive")
        .mapInPandas(counted, "feature long, others long, toxic long")
        .groupBy("feature")
        .agg(F.sum("others").alias("others"), F.sum("toxic").alias("toxic"))
    )
    n = rows.where("feature = -1").first()
    p, u = n["toxic"] + 1, n["others"] + 1
    a, b = (F.col("toxic") + 0.5) / p, (F.col("others") + 0.5) / u
    z = F.abs(a - b) / F.sqrt(a * (1 - a) / p + b * (1 - b) / u)
    best = rows.where("feature >= 0 and toxic + others >= 4").withColumn("z", z).where(F.col("z") > LEAST_Z)
    best = best.orderBy(F.desc("z"), "feature").limit(SELECTED).select("feature")
    return sorted(r["feature"] for r in best.collect())


def scores_of(texts, scorer: Scorer, words: Words) -> np.ndarray:
    w = scorer.weights
    margin = [float(w[text_features(t, words)].sum()) + scorer.bias for t in texts]
    return 1 / (1 + np.exp(-np.clip(np.array(margin, float), -40, 40)))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1): one row per row of ``docs``; null and empty texts score as a text without features."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(scorer.weights)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": scores_of(batch["text"], scorer, words)})

    return only(docs, doc_id=id_col, text=text_col).mapInPandas(scan, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5): one row per row of ``docs``.

    Learns from rows whose crc32 of the id modulo ``modulus`` is not ``held``; the others are held out, and so is a row
    with a null id. Labels, languages, sources and ids are no input of a score. Repeated rows score alike; empty or
    null texts score by the intercept; texts are read whole. Empty ``docs``: no rows; no labels: score 0 for all.
    """
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(True))
    scorer = fit(docs.where(~out).select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return score(docs, scorer).select(
        "doc_id",
        out.alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic; no shuffle of texts."""
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(True))
    scorer = fit(docs.where(~out).select("doc_id", "text"), labels.select("doc_id", "toxic"))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(scorer.weights)
        for texts in batches:
            yield pd.Series(scores_of(texts, scorer, words))

    return docs.where(scored(F.col("text")) < 0.5)
