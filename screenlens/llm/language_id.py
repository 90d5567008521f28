"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are reduced to lower-case letters with single spaces between words; n-grams of 1 to ORDER characters are hashed to
DIMENSIONS features by a rolling hash over whole arrays. A feature's value is its share of the text's n-grams times its
inverse document frequency, which is counted over all texts that may be learnt from. Weights are trained by
follow-the-regularised-leader with elastic-net penalties on shards of a bounded sample, and averaged; most end at zero.
A temperature, fitted on sampled texts kept out of training, makes the probabilities honest.

A prediction needs no sparse vector: the margin of a language is the mean, over a text's n-grams, of one table entry.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlens.llm.common import only, remainder
from screenlens.session import materialize

ORDER = 3
BITS = 16
DIMENSIONS = 1 << BITS
#: Bound of the sample that is fitted, and the share of it that only the temperature sees (one in so many).
MAX_SAMPLE = 16_000
CALIBRATION = 8
SHARDS = 3
EPOCHS = 2
#: FTRL-proximal: learning rate and its offset, the penalties, and the scale of feature values.
ALPHA, BETA, L1, L2, SCALE = 0.3, 1.0, 0.02, 0.1, 40.0
TEMPERATURES = np.exp(np.linspace(np.log(0.02), np.log(20), 140))
UNKNOWN = "und"

#: Signs that ``\w`` takes for part of a word though they are neither letters nor digits, such as ² or Ⅷ.
_SIGNS = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha())
_OTHER = re.compile(r"[\W\d_]+")
_STEP = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)
#: Characters whose n-grams are held at once.
CHUNK = 1 << 18


def letters_of(text: str | None) -> str:
    """Lower-case letters, words parted by one space; empty if there is no letter."""
    lowered = (text or "").lower()
    if not lowered.isascii():
        for sign in _SIGNS.intersection(lowered):
            lowered = lowered.replace(sign, " ")
    words = _OTHER.sub(" ", lowered).strip()
    return f" {words} " if words else ""


def grams(letters: str) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams, in chunks."""
    codes = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes), CHUNK):
        part = codes[at : at + CHUNK + ORDER - 1]
        own = min(CHUNK, len(codes) - at)
        hashed = part + np.uint32(1)
        for n in range(1, ORDER + 1):
            if n > 1:
                hashed = hashed[:-1] * _STEP ^ (part[n - 1 :] + np.uint32(1))
            here = hashed[:own]
            if len(here):
                mixed = (here ^ (here >> np.uint32(15))) * _MIX
                yield ((mixed ^ (mixed >> np.uint32(13))) * _MIX) >> np.uint32(32 - BITS)


def counts_of(letters: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their shares of the text's n-grams."""
    total = np.zeros(DIMENSIONS, np.int64)
    for features in grams(letters):
        total += np.bincount(features, minlength=DIMENSIONS)
    found = np.nonzero(total)[0]
    return found, total[found] / total.sum()


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of ``texts`` (text) each feature occurs, and how many texts there are; the table has a fixed size."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, mark, n = np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, bool), 0
        for batch in batches:
            for text in batch["text"]:
                mark[:] = False
                for features in grams(letters_of(text)):
                    mark[features] = True
                found += mark
                n += 1
        some = np.nonzero(found)[0]
        yield pd.DataFrame({"feature": np.append(some, -1), "n": np.append(found[some], n)})

    rows = texts.select("text").mapInPandas(scan, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df, total = np.zeros(DIMENSIONS), 0
    for r in rows.collect():  # at most DIMENSIONS + 1 rows
        if r["feature"] < 0:
            total = r["n"]
        else:
            df[r["feature"]] = r["n"]
    return df, total


class Ftrl:
    """FTRL-proximal for a softmax over ``n`` classes; weights are derived from z and the sums of squared gradients."""

    def __init__(self, n: int):
        self.z, self.squares = np.zeros((DIMENSIONS, n)), np.zeros((DIMENSIONS, n))
        self.bias = np.zeros(n)

    def weights(self, rows) -> np.ndarray:
        z, q = self.z[rows], self.squares[rows]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(q)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, features: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(features)
        margin = values @ w + self.bias
        p = np.exp(margin - margin.max())
        p /= p.sum()
        p[label] -= 1
        g = values[:, None] * p
        q = self.squares[features]
        self.z[features] += g - (np.sqrt(q + g * g) - np.sqrt(q)) / ALPHA * w
        self.squares[features] = q + g * g
        self.bias -= 0.01 * p


class Model:
    """The learnt languages, a table of weights times inverse document frequency per language, bias, temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.languages, self.table, self.bias, self.temperature = languages, table, bias, temperature

    def margins(self, letters: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for features in grams(letters):
            n += len(features)
            for i, column in enumerate(self.table):
                total[i] += column[features].sum()
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        letters = letters_of(text)
        if not letters or not self.languages:
            return UNKNOWN, 0.0
        m = self.margins(letters) / self.temperature
        p = np.exp(m - m.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def fit(docs: DataFrame) -> Model:
    """Learns ``lang`` of ``docs`` (doc_id, text, lang), all of which may be learnt from.

    Fits at most MAX_SAMPLE texts, those with the smallest hash of the id. Null languages are left out; ties among
    languages go to the first in order. Without a labelled text, no language is known.
    """
    known = docs.where("lang is not null").select("doc_id", "text", "lang").withColumn("draw", F.xxhash64("doc_id"))
    df, n = document_frequencies(known)
    last = known.select("draw").orderBy("draw").limit(MAX_SAMPLE).agg(F.max("draw")).first()[0]
    if last is None:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    turn = F.pmod(F.xxhash64("draw"), F.lit(1 << 20))
    sample = materialize(known.where(F.col("draw") <= F.lit(last)).withColumn("turn", turn), "language-sample")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    number = {lang: i for i, lang in enumerate(languages)}
    idf = np.log((1 + n) / (1 + df)) + 1

    def trained(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "text"])
        data = []
        for text, lang in zip(rows["text"], rows["lang"], strict=True):
            letters = letters_of(text)
            if letters:
                features, share = counts_of(letters)
                data.append((features.astype(np.int32), (share * idf[features] * SCALE).astype(np.float32), number[lang]))
        model = Ftrl(len(languages))
        for _ in range(EPOCHS):
            for features, values, label in data:
                model.learn(features, values, label)
        w = model.weights(slice(None))
        feature, language = np.nonzero(w)
        return pd.DataFrame(
            {
                "feature": np.append(feature, np.full(len(languages), -1)),
                "language": np.append(language, np.arange(len(languages))),
                "weight": np.append(w[feature, language], model.bias),
            }
        )

    training = sample.where(F.col("turn") % CALIBRATION != 0).withColumn("shard", F.col("turn") % SHARDS)
    parts = training.groupBy("shard").applyInPandas(trained, "feature long, language int, weight double")
    table, bias, n_shards = np.zeros((len(languages), DIMENSIONS)), np.zeros(len(languages)), 0
    rows = parts.groupBy("feature", "language").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    for r in rows.collect():  # at most DIMENSIONS + 1 rows per language
        if r["feature"] < 0:
            bias[r["language"]], n_shards = r["weight"], r["n"]
        else:
            table[r["language"], r["feature"]] = r["weight"]
    n_shards = max(n_shards, 1)
    model = Model(languages, (table / n_shards * idf * SCALE).astype(np.float32), bias / n_shards)
    model.temperature = _temperature(sample.where(F.col("turn") % CALIBRATION == 0), model)
    return model


def _temperature(docs: DataFrame, model: Model) -> float:
    """The temperature with the least log loss on ``docs``; 1 without any."""

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, number = np.zeros(len(TEMPERATURES)), {lang: i for i, lang in enumerate(model.languages)}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                letters = letters_of(text)
                if letters:
                    m = model.margins(letters)[None, :] / TEMPERATURES[:, None]
                    m -= m.max(axis=1, keepdims=True)
                    total += np.log(np.exp(m).sum(axis=1)) - m[:, number[lang]]
        yield pd.DataFrame({"at": np.arange(len(total)), "loss": total})

    rows = docs.select("text", "lang").mapInPandas(losses, "at int, loss double").groupBy("at").agg(F.sum("loss").alias("loss"))
    best = min(((r["loss"], r["at"]) for r in rows.collect()), default=(0.0, 0))
    return float(TEMPERATURES[best[1]]) if best[0] > 0 else 1.0


def language_id(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs`` (doc_id, text, lang).

    Learns from rows whose crc32 of the id modulo ``modulus`` is not ``held``; the others, and rows with a null id, are
    held out. Only the text is an input of a prediction. Null texts and those without a letter are ``und`` with score 0,
    and so are all if nothing can be learnt. Repeated rows count as often as they come; texts are read whole.
    An empty table gives no rows; other columns are ignored.
    """
    own = only(docs, doc_id="doc_id", text="text", lang="lang")
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(True))
    model = fit(own.where(~out))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.predict(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "lang_pred": [f[0] for f in found],
                    "score": np.array([f[1] for f in found], float),
                }
            )

    scored = own.select("doc_id", "text").mapInPandas(scan, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", out.alias("held_out"), "lang_pred", "score")
