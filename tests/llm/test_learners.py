"""Held-out accuracy and edge rows of the language, toxicity and language-model operators."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlens.llm import language_id, lm_score, toxicity

SF = "/root/testdata/sf0.01"
EDGES = [(1001, None), (1002, ""), (1003, " \n "), (1004, "123 456"), (None, "the and of"), (1005, "the " * 100_000)]
EDGES += [(1006, "the and of"), (1006, "the and of")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language(spark, documents):
    edges = spark.createDataFrame([(i, t, "en", 1) for i, t in EDGES], "doc_id long, text string, lang string, score int")
    got = language_id.language_id(documents.select("doc_id", "text", "lang", F.lit(0).alias("score")).unionByName(edges)).collect()
    lang = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in got if r.held_out and r.doc_id in lang and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held) > 100
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    last = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in got if r.doc_id is None or r.doc_id > 1000}
    assert [last[i] for i in (1001, 1002, 1003, 1004)] == [("und", 0)] * 4
    assert last[None][0] == last[1005][0] == last[1006][0] == "en"
    assert all(0 <= r.score <= 1 for r in got) and len(got) == documents.count() + len(EDGES)


def test_language_without_labels(spark):
    rows = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language_id.language_id(rows).collect()] == [("und", 0.0)]
    assert language_id.language_id(rows.limit(0)).collect() == []


def test_ngrams_in_chunks_are_those_of_the_whole(monkeypatch):
    for text in ("½ ² Ⅷ", "²", "12 ٣ ४", "_ - \n", "①"):
        assert language_id.letters_of(text) == ""
    assert language_id.letters_of("a²b") == " a b "
    letters = language_id.letters_of("Ein Wort, noch EIN Wort und élève " * 50)
    whole = np.sort(np.concatenate(list(language_id.grams(letters))))
    monkeypatch.setattr(language_id, "CHUNK", 37)
    assert np.array_equal(np.sort(np.concatenate(list(language_id.grams(letters)))), whole)
    assert len(whole) == 3 * len(letters) - 3


def test_toxicity(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumn("score", F.lit(1))
    edges = spark.createDataFrame(EDGES, "doc_id long, text string").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    got = toxicity.toxicity(documents.select("doc_id", "text").unionByName(edges), labels).collect()
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    hits = sum(p and t for p, t in held)
    assert hits >= 0.85 * sum(t for _, t in held) and hits >= 0.85 * sum(p for p, _ in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(r.predicted == (r.score >= 0.5) for r in got) and len(got) == documents.count() + len(EDGES)
    assert len({r.score for r in got if r.doc_id in (1_001_001, 1_001_002, 1_001_003)}) == 1


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs([(1, "a b"), (None, None)]), labels).collect()
    assert [(r.predicted, r.held_out) for r in got] == [(0, False), (0, True)]
    assert toxicity.toxicity(docs([]), labels).collect() == []
    one = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs([(1, "a b"), (2, "c d"), (3, None)]), one).count() == 3
    kept = toxicity.without_toxic(docs([(1, "a b"), (None, None)]), labels)
    assert kept.count() == 2 and "fp" in kept.columns


def test_reversed_steps_keep_the_unlabelled_risk_from_sinking():
    """A positive that looks like nothing else must not be pushed to certainty by what is unlabelled."""
    rng = np.random.default_rng(0)
    positive = [np.unique(np.append(rng.integers(1, 50, 6), 0)) for _ in range(60)]
    unlabelled = [np.unique(rng.integers(1, 50, 6)) for _ in range(300)] + positive[:30]
    w, bias = toxicity.nnpu_fit(positive, unlabelled, 50, 0.1)
    score = lambda rows: np.array([w[r].sum() + bias for r in rows])
    assert (score(positive) > 0).mean() > 0.5 and (score(unlabelled[:300]) > 0).mean() < 0.05


def katz(pairs, modulus=5, held=1, k=5):
    """The model in plain dictionaries."""
    from collections import Counter

    def tokens(text):
        return [*(text or "").encode().lower().split(), "<end>"]

    out = lambda d: d is None or zlib.crc32(str(d).encode()) % modulus == held
    one, two, begins = Counter(), Counter(), 0
    for d, t in pairs:
        if not out(d):
            words = tokens(t)
            one.update(words)
            two.update(zip(["<begin>", *words[:-1]], words, strict=True))
            begins += 1
    total = sum(one.values())
    history = Counter(one)
    history["<begin>"] = begins

    def cuts(counts):
        n = [0, *[sum(c == r for c in counts.values()) for r in range(1, k + 2)]]
        found = {}
        for r in range(1, k + 1):
            cut = (k + 1) * n[k + 1] / n[1] if n[1] else 1
            d = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut) if n[r] and cut < 1 else 0
            found[r] = d if 0 < d < 1 else (r - 0.5) / r
        return found

    d1, d2 = cuts(one), cuts(two)
    lower = {w: c * d1.get(c, 1) / (total + 1) for w, c in one.items()}
    unknown = 1 - sum(lower.values())
    den = lambda h: history[h] + (history[h] > k)

    def p1(w):
        return lower.get(w, unknown)

    def p2(h, w):
        if not history[h]:
            return p1(w)
        if two[h, w]:
            return two[h, w] * d2.get(two[h, w], 1) / den(h)
        seen = [x for a, x in two if a == h]
        left = 1 - sum(two[h, x] * d2.get(two[h, x], 1) for x in seen) / den(h)
        return left / (1 - sum(p1(x) for x in seen)) * p1(w)

    return tokens, out, one, total, p1, p2


CORPUS = [(i, f"a b c a b d word{i % 7} a b é {'x y ' * (i % 4)}A  B\tc rare{i}") for i in range(60)]
CORPUS += [(60, None), (61, ""), (None, "a b zz a c"), (62, "a b c"), (62, "a b c"), (63, "never seen words é a"), (64, "a b " * 3000)]


@pytest.mark.parametrize("shard", [2_000_000, 100])
def test_katz_against_dictionaries(docs, shard):
    got = lm_score.lm_score(docs(CORPUS), shard_tokens=shard, bucket_tokens=shard).collect()
    tokens, out, one, total, _, p2 = katz(CORPUS)
    want = []
    for d, t in CORPUS:
        words = tokens(t)
        score = sum(np.log10(p2(h, w)) for h, w in zip(["<begin>", *words[:-1]], words, strict=True))
        base = sum(np.log10((one[w] + 0.5) / (total + 0.5 * (len(one) + 1))) for w in words)
        want.append((d, out(d), len(words), sum(one[w] > 0 for w in words), total, base, score))
    key = lambda r: (str(r[0]), r[2])
    for mine, theirs in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert mine[:5] == theirs[:5]
        assert mine[5:] == pytest.approx(theirs[5:], rel=1e-9)


def test_probabilities_sum_to_one():
    *_, one, _, p1, p2 = katz(CORPUS)
    for h in ("<begin>", b"a", b"rare3", b"x", b"not there"):
        assert sum(p2(h, w) for w in [*one, "unknown"]) == pytest.approx(1)


def test_lm_edges(docs):
    assert lm_score.lm_score(docs([])).collect() == []
    got = lm_score.lm_score(docs([(None, "nothing learnt"), (None, None)])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0, 0), (1, 0, 0, 0, 0)]


def test_lm_beats_words_alone_on_held_out_text(documents):
    got = [r for r in lm_score.lm_score(documents).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
