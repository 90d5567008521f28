import hashlib
import time
from collections import defaultdict

from screenlens.llm.line_dedup import digest, line_dedup

WHITE = " \t\n\x0b\x0c\r"


def brute(pairs, min_chars=10, min_documents=2):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    holders = defaultdict(set)
    for d, t in pairs:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = []
    for d, t in pairs:
        lines = (t or "").split("\n")
        keep = [
            x
            for x in lines
            if d is None or len(holders[key(x)]) < min_documents or min(holders[key(x)]) == d
        ]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


CASES = [
    (1, "A shared line of text\nown line of one\nA shared line of text"),
    (2, "  a SHARED line of text\t\nshort\nown of two"),
    (3, None),
    (4, ""),
    (5, "\n\n"),
    (6, "short\nshort\n"),
    (2, "another text under a repeated id\nA shared line of text"),
    (2, "another text under a repeated id\nA shared line of text"),
    (None, "A shared line of text"),
    (7, "ÄÖÜ lines keep their case "),
    (8, "äöü lines keep their case "),
    (9, "A shared line of text"),
    (10, "x" * 200_000 + "\n" + "a shared line of text\n" * 3000 + "the end of it all"),
]


def test_matches_brute_force(docs, rows):
    got = sorted(rows(line_dedup(docs(CASES))), key=str)
    assert got == brute(CASES)


def test_threshold(docs, rows):
    got = sorted(rows(line_dedup(docs(CASES), min_documents=4, min_chars=5)), key=str)
    assert got == brute(CASES, 5, 4)


def test_digest_and_empty_table(docs, rows):
    row = [r for r in rows(digest(line_dedup(docs(CASES)))) if r[0] == 4][0]
    assert row == (4, 1, 0, hashlib.sha256(b"").hexdigest())
    assert rows(line_dedup(docs([]))) == []


def test_time_grows_with_the_lines(docs, rows):
    """Texts that share all lines but every third, up to 120,000 of them; a square would take hours."""
    text = "\n".join(f"shared line {i}" for i in range(80_000))
    other = "\n".join(f"shared line {i}" + ("\nown line number %d" % i if i % 2 else "") for i in range(80_000))
    pairs = [(1, text), (2, other), (3, text)]
    start = time.perf_counter()
    assert sorted(rows(line_dedup(docs(pairs))), key=str) == brute(pairs)
    assert time.perf_counter() - start < 60
