import math
import random

import pytest

from screenlens.llm.hamming_search import search, segments


def brute(vectors, k, every):
    bits = max((len(v) for _, v in vectors if v is not None), default=1)
    codes = {}
    for i, v in vectors:
        if i is not None and v is not None:
            v = [*v, *[0.0] * (bits - len(v))]
            codes.setdefault(i, set()).add(tuple(int(x is not None and not math.isnan(x) and x > 0) for x in v))
    codes = [(i, c) for i, cs in codes.items() for c in cs]
    out = []
    for q, qc in codes:
        if q % every == 0:
            found = sorted((sum(a != b for a, b in zip(qc, c)), i) for i, c in codes if i != q)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(found)]
    return sorted(out)


def run(spark, vectors, k, every):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, code int, id int")
    return sorted(tuple(r) for r in search(df, k=k, every=every).collect())


@pytest.mark.parametrize(("n", "bits", "k", "every", "spread"), [(400, 64, 10, 20, 0), (300, 70, 3, 30, 3), (150, 130, 5, 50, 40), (60, 5, 4, 7, 0)])
def test_matches_brute_force(spark, n, bits, k, every, spread):
    rng = random.Random(n)
    base = [rng.choice([-1.0, 1.0]) for _ in range(bits)]
    vectors = []
    for i in range(n):
        if spread:
            v = list(base)
            for _ in range(rng.randint(0, spread)):
                v[rng.randrange(bits)] *= -1
        else:
            v = [rng.choice([-1.0, 0.0, 1.0]) for _ in range(bits)]
        vectors.append((i, v))
    assert run(spark, vectors, k, every) == brute(vectors, k, every)


def test_edge_rows(spark):
    vectors = [(0, [1.0, -1.0]), (0, [1.0, -1.0]), (None, [1.0, 1.0]), (50, None), (7, []), (8, [float("nan"), None, 1.0])]
    vectors += [(100 + i, [1.0, -1.0, 0.0]) for i in range(200)]
    assert run(spark, vectors, 10, 50) == brute(vectors, 10, 50)
    assert run(spark, [], 10, 50) == []
    assert run(spark, [(0, [1.0])], 10, 50) == []


def test_segments_cover_all_bits():
    for bits in (1, 7, 64, 130):
        for n in (1, 2, 1000, 10**9):
            parts = segments(bits, n)
            assert [a for a, _ in parts] == [sum(w for _, w in parts[:i]) for i in range(len(parts))]
            assert sum(w for _, w in parts) == bits
