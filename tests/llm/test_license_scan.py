"""Licence scan against plain loops, and expressions against a recursive reading."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from screenlens.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    """n_words, n_base, first_word, last_word, base_labels: word by word."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    places, labels = [], set()
    for phrase, label in ls.BASE.items():
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None,
    "",
    " \n",
    "Licensed under CC BY-NC 4.0.",
    "gnu General\nPublic -- LICENSE, version 3; MIT License. mit license",
    "cc by cc by cc by",
    "ccc by, cc bye, émit license, mit licenseé, MIT\u00a0License",
    "The Apache\x00License and the apache_license and apache2 license",
    "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nmore",
    "gnu lesser general public license",
    "x " * 40_000 + "MIT License " * 500,
    "mit " * 20_000,
    "MIT License",
    "MIT License",
]


def test_base_equals_brute_force(docs):
    rows = [*enumerate(TEXTS), (None, "mit license"), (4, "cc by")]
    found = ls.digest(ls.license_scan(docs(rows).repartition(3))).collect()
    got = sorted(
        ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found), key=repr
    )
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    for r in found:
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_empty_table(docs):
    assert ls.digest(ls.license_scan(docs([]))).count() == 0


def test_sample_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in ls.digest(ls.license_scan(table)).collect()}
    rows = table.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for doc_id, text in rows:
        r = found[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
    assert {r.labels for r in found.values()} >= {"", "gpl", "mit", "apache", "cc-by,cc-by-nc"}


@pytest.mark.parametrize(
    "line, text, labels, level",
    [
        ("MIT", "MIT", {"mit"}, 0),
        ("mit or GPL-3.0-only and BSD-3-Clause", "(mit OR (GPL-3.0-only AND BSD-3-Clause))", {"mit", "gpl", "bsd"}, 0),
        ("(MIT OR GPL-2.0+) AND Apache-2.0", "((MIT OR GPL-2.0+) AND Apache-2.0)", {"mit", "gpl", "apache"}, 0),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "(GPL-2.0-only WITH Classpath-exception-2.0)", {"gpl"}, 1),
        ("GPL-2.0 AND CC-BY-NC-4.0", "(GPL-2.0 AND CC-BY-NC-4.0)", {"gpl", "cc-by-nc"}, 3),
        ("MIT/Apache-2.0", "(MIT OR Apache-2.0)", {"mit", "apache"}, 0),
        ("(MIT AND (", "MIT", {"mit"}, 0),
        ("((MIT OR ISC", "(MIT OR ISC)", {"mit", "isc"}, 0),
        ("MIT License text", "MIT", {"mit"}, 0),
        ("MIT) AND ISC", "MIT", {"mit"}, 0),
        ("Own-1.0 OR MIT", "(Own-1.0 OR MIT)", {"other", "mit"}, 0),
    ],
)
def test_expressions(line, text, labels, level):
    found = ls.evaluate(line.encode())
    assert (found.text, set(found.labels), found.level) == (text, labels, level)


def test_no_expression():
    assert ls.evaluate(b"") is None and ls.evaluate(b"AND MIT") is None and ls.evaluate(b"((") is None
    assert ls.evaluate(b"see the file", must_know=True) is None
    assert ls.evaluate(b"MIT and others", must_know=True).text == "MIT"


TREE = st.recursive(
    st.sampled_from(["MIT", "GPL-3.0-only", "LGPL-2.1", "CC-BY-NC-4.0", "Own"]),
    lambda inner: st.tuples(st.sampled_from(["AND", "OR"]), inner, inner),
    max_leaves=20,
)


@settings(max_examples=200, deadline=None)
@given(TREE)
def test_trees_evaluate_as_written(tree):
    def written(node):
        return node if isinstance(node, str) else f"({written(node[1])} {node[0]} {written(node[2])})"

    def level(node):
        if isinstance(node, str):
            return ls.terms_of(node)[1]
        return (max if node[0] == "AND" else min)(level(node[1]), level(node[2]))

    found = ls.evaluate(written(tree).encode())
    assert (found.text, found.level) == (written(tree), level(tree))


def test_tags_and_spans(docs):
    text = "é SPDX-License-Identifier: MIT OR GPL-2.0-only\nlicense = 'ISC'; licence: none given. CC BY-SA"
    row = ls.license_scan(docs([(1, text)])).first()
    raw = text.encode()
    got = [(f.kind, raw[f.start : f.end].decode(), f.expression, list(f.labels)) for f in row.findings]
    assert got == [
        ("tag", "SPDX-License-Identifier", "(MIT OR GPL-2.0-only)", ["gpl", "mit"]),
        ("tag", "license", "ISC", ["isc"]),
        ("phrase", "CC BY", None, ["cc-by"]),
        ("phrase", "CC BY-SA", None, ["cc-by-sa"]),
    ]
    assert row.labels == "cc-by,cc-by-sa,gpl,isc,mit" and row.terms == "copyleft"


def test_random_words(docs):
    rng = random.Random(3)
    pool = ["cc", "by", "CC", "mit", "License", "gnu", "general", "public", "apache", "-", "\n", "é", "nc"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    found = ls.digest(ls.license_scan(docs(rows))).collect()
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found}
    assert got == {(i, *brute(t)) for i, t in rows}
