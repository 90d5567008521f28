import random

import numpy as np
import pytest
import xxhash

from screenlens.llm import bitslice, simhash

WHITE = " \t\n\x0b\x0c\r"


def plain_fingerprint(text):
    words = []
    for piece in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {ord(c): " " for c in WHITE}
    ).split(" "):
        if piece:
            words.append(piece)
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marked, radius=4):
    """marked: (doc_id, unsigned fingerprint); the smallest doc_id reachable of each."""
    n = len(marked)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (marked[i][1] ^ marked[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    out = []
    for i in range(n):
        ids = [marked[j][0] for j in range(n) if find(j) == find(i) and marked[j][0] is not None]
        out.append(min(ids, default=None))
    return out


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(simhash.simhash_dedup(docs)).collect()}
    marked = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    for (d, fp), component in zip(marked, plain_components(marked), strict=True):
        assert got[d] == (f"{fp:016x}", component)


def test_edge_rows(docs, rows):
    base = " ".join(f"w{i}" for i in range(400))
    cases = [
        (5, base),
        (3, base.upper()),
        (9, base + " one more"),
        (4, None),
        (8, "  \n"),
        (7, ""),
        (6, "two words"),
        (6, "two words"),
        (None, "two words"),
        (None, "alone here"),
        (10, "ÉCOLE école"),
        (11, "École ÉCOLE"),
        (12, "x " * 150_000),
        (13, "nbsp\u00a0is no break"),
    ]
    got = sorted(rows(simhash.simhash_dedup(docs(cases))), key=str)
    marked = [(d, plain_fingerprint(t)) for d, t in cases]
    want = [
        (d, fp - (1 << 64) if fp >> 63 else fp, c)
        for (d, fp), c in zip(marked, plain_components(marked), strict=True)
    ]
    assert got == sorted(want, key=str)
    assert rows(simhash.simhash_dedup(docs([]))) == []


@pytest.mark.parametrize(("tile", "n"), [(4096, 600), (50, 400)])
def test_links_join_all_components(spark, tile, n):
    """Chains and clusters of close words, in one block or over many tiles."""
    rng = random.Random(tile)
    words = {rng.getrandbits(64) for _ in range(40)}
    while len(words) < n:
        w = rng.choice(sorted(words))
        for _ in range(rng.randint(1, 5)):
            w ^= 1 << rng.randrange(40, 64)
        words.add(w)
    words = sorted(words)
    nodes = spark.createDataFrame(
        [(i, w - (1 << 64) if w >> 63 else w) for i, w in enumerate(words)], "node long, fp long"
    )
    from screenlens.llm.graph import components

    found = dict(components(simhash.links(nodes, tile=tile)).collect())
    want = plain_components(list(enumerate(words)))
    assert [found.get(i, i) for i in range(n)] == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5, 6, 7])
def test_bit_planes_against_counts(radius):
    rng = np.random.default_rng(radius)
    words = rng.integers(0, 2**63, 40).astype(np.uint64)
    words = np.concatenate([words, words[:30] ^ np.uint64(0b1011), words[:70] ^ np.uint64(1 << 50)])
    words = np.concatenate([words, rng.integers(0, 200, 150).astype(np.uint64)])
    starts = np.array([0, 3, 90, 91])
    got = set()
    for left, right in bitslice.close_pairs(words, starts, radius):
        got |= set(zip(left.tolist(), right.tolist(), strict=True))
    group = np.searchsorted(starts, np.arange(len(words)), side="right")
    want = {
        (i, j)
        for j in range(len(words))
        for i in range(j)
        if group[i] == group[j] and (int(words[i]) ^ int(words[j])).bit_count() <= radius
    }
    assert got == want


def test_parts_grow_with_the_table():
    assert [len(simhash.parts_for(n)) for n in (0, 10**6, 10**7, 10**9, 10**12)] == [5, 15, 15, 35, 70]


def test_keep_one_keeps_columns(docs):
    kept = simhash.keep_one(docs([(1, "a b c d e"), (2, "a b c d e"), (3, "quite another text of words"), (None, "x")]))
    assert "component_id" in kept.columns and kept.columns[:2] == ["doc_id", "text"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]
