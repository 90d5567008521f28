"""Licence notices and licence expressions: Aho-Corasick over words, then a shunting-yard evaluation of expressions.

One automaton holds the words of all notice phrases and of the tags that a licence expression follows. It runs once
over a document's words, joined by single spaces, so a phrase is found across line breaks and punctuation and phrases
may overlap. What follows a tag on its line is read as an expression of identifiers joined by WITH, AND and OR (binding
in this order) and parentheses. There is no shuffle: each document is finished where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlens.llm.common import only

# The phrases of the contract and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: More notice phrases.
PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "cc0": "cc0",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
#: Tags before an expression, and whether what follows must begin with an identifier we know.
TAGS = {"spdx license identifier": False, "license expression": True, "license": True, "licence": True}

#: How far terms bind, from 0; the last is for identifiers that we do not know.
CLASSES = ("free", "weak copyleft", "copyleft", "restricted", "unknown")
#: Identifier families: an identifier belongs to the longest one that it begins with, up to a hyphen or its end.
FAMILIES = {
    "0bsd": ("bsd", 0),
    "agpl": ("agpl", 2),
    "apache": ("apache", 0),
    "artistic": ("artistic", 1),
    "bsd": ("bsd", 0),
    "bsl": ("bsl", 0),
    "cc-by": ("cc-by", 0),
    "cc-by-nc": ("cc-by-nc", 3),
    "cc-by-nc-nd": ("cc-by-nc-nd", 3),
    "cc-by-nc-sa": ("cc-by-nc-sa", 3),
    "cc-by-nd": ("cc-by-nd", 3),
    "cc-by-sa": ("cc-by-sa", 2),
    "cc0": ("cc0", 0),
    "cddl": ("cddl", 1),
    "epl": ("epl", 1),
    "eupl": ("eupl", 2),
    "gpl": ("gpl", 2),
    "isc": ("isc", 0),
    "lgpl": ("lgpl", 1),
    "mit": ("mit", 0),
    "mpl": ("mpl", 1),
    "ofl": ("ofl", 1),
    "proprietary": ("proprietary", 3),
    "public-domain": ("public-domain", 0),
    "unlicense": ("unlicense", 0),
    "wtfpl": ("wtfpl", 0),
    "zlib": ("zlib", 0),
}
OTHER = ("other", len(CLASSES) - 1)
#: How sure one finding makes us that the text states a licence.
WEIGHT = {"tag": 0.95, "phrase": 0.8}

# Lower-cases A-Z; every other ASCII character that is no letter or digit becomes a space. Offsets stay.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_TOKEN = re.compile(rb"[ \t]*([()]|/|[A-Za-z0-9][A-Za-z0-9.+_:-]*)")
_ASSIGNED = re.compile(rb"[ \t]*[\"']?[ \t]*[:=][ \t]*[\"']?")
_BINDING = {"or": 1, "and": 2, "with": 3}


def terms_of(identifier: str) -> tuple[str, int]:
    """Label and class of a licence identifier."""
    name = identifier.lower().rstrip("+")
    while name:
        if name in FAMILIES:
            return FAMILIES[name]
        name = name.rpartition("-")[0]
    return OTHER


@dataclass(frozen=True)
class Expression:
    """An expression's text in full parentheses, its labels, and how far it binds."""

    text: str
    labels: frozenset[str]
    level: int


def _applied(operator: str, left: Expression, right: Expression) -> Expression:
    text = f"({left.text} {operator.upper()} {right.text})"
    if operator == "with":  # the right side names an exception, which frees strict copyleft for linking
        return Expression(text, left.labels, 1 if left.level == 2 else left.level)
    level = min(left.level, right.level) if operator == "or" else max(left.level, right.level)
    return Expression(text, left.labels | right.labels, level)


def evaluate(line: bytes, must_know: bool = False) -> Expression | None:
    """The longest expression at the start of ``line``, by a shunting-yard; None if there is none.

    WITH binds closer than AND, AND closer than OR; a slash is OR. It ends where an operand or an operator that would
    have to come does not; with ``must_know`` also before an identifier of no known family. Open parentheses are closed
    there, and an operator without a right side is left out. OR lets the reader choose the freer side, AND binds to the
    stricter one.
    """
    operands: list[Expression] = []
    operators: list[str] = []
    want, at, depth = True, 0, 0

    def reduce(until: int) -> None:
        while operators and operators[-1] != "(" and _BINDING[operators[-1]] >= until:
            right = operands.pop()
            operands.append(_applied(operators.pop(), operands.pop(), right))

    while found := _TOKEN.match(line, at):
        token = found[1].decode().rstrip(".:")
        word = "or" if token == "/" else token.lower()
        if want and word == "(":
            operators.append("(")
            depth += 1
        elif want and word not in _BINDING and word != ")" and token:
            label, level = terms_of(token)
            exception = bool(operators) and operators[-1] == "with"
            if must_know and label == OTHER[0] and not exception:
                break
            operands.append(Expression(token, frozenset([label]), level))
            want = False
        elif not want and word == ")" and depth:
            reduce(0)
            operators.pop()
            depth -= 1
        elif not want and word in _BINDING:
            reduce(_BINDING[word])
            operators.append(word)
            want = True
        else:
            break
        at = found.end()
    # Where an operand was still to come, what waits for it goes.
    while want and operators:
        want = operators.pop() == "("
    if not operands:
        return None
    while operators:
        reduce(0)
        if operators:
            operators.pop()
    return operands[-1]


def automaton(phrases: Iterable[str]):
    """An Aho-Corasick automaton of phrases as ` word word `, so that only whole words match."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def findings(text: str | None, machine, labels: dict[str, str], tags: dict[str, bool]) -> tuple[int, list[tuple]]:
    """Number of words, and (kind, phrase, labels, word, start, end, expression, level) of every place, in order.

    ``word`` counts words from 0, ``start`` and ``end`` are offsets into the text's UTF-8 bytes.
    """
    raw = (text or "").encode()
    spaced = raw.translate(_WORDS)
    words = spaced.split()
    line = f" {b' '.join(words).decode('latin-1')} "
    hits = list(machine.iter(line))
    if not hits:
        return len(words), []
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    solid = np.concatenate([[False], np.frombuffer(spaced, np.uint8) != 32, [False]])
    starts, ends = np.flatnonzero(~solid[:-1] & solid[1:]), np.flatnonzero(solid[:-1] & ~solid[1:])
    found = []
    for last, phrase in hits:
        first = int(np.searchsorted(spaces, last - len(phrase) - 1))
        final = first + phrase.count(" ")
        begin, end = int(starts[first]), int(ends[final])
        if phrase in labels:
            found.append(("phrase", phrase, [labels[phrase]], first, begin, end, None, None))
        if phrase in tags and (sign := _ASSIGNED.match(raw, end)):
            stop = raw.find(b"\n", sign.end())
            expression = evaluate(raw[sign.end() : stop if stop >= 0 else len(raw)], tags[phrase])
            if expression:
                found.append(
                    ("tag", phrase, sorted(expression.labels), first, begin, end, expression.text, expression.level)
                )
    return len(words), sorted(found, key=lambda f: (f[3], f[5], f[0]))


_SCHEMA = (
    "doc_id long, n_words long, findings array<struct<kind: string, phrase: string, labels: array<string>, word: long, "
    "start: long, end: long, expression: string, level: int>>, labels string, terms string, score double"
)


def license_scan(
    docs: DataFrame, phrases: dict[str, str] | None = None, tags: dict[str, bool] | None = None
) -> DataFrame:
    """doc_id, n_words, findings, labels, terms, score of every row of ``docs`` (doc_id, text), whole texts.

    ``phrases`` maps lower-case words parted by one space to a label, ``tags`` says what words an expression may follow
    (after ``:`` or ``=``, up to the end of the line). A finding has its kind (phrase or tag), the phrase, its labels,
    the number of its first word, its span in UTF-8 bytes, and of a tag the expression in full parentheses with the class
    it evaluates to. ``labels`` are all labels, sorted and joined by commas; ``terms`` the strictest class of all findings
    (null without one). ``score``: how sure it is that the text states a licence, 1 less the product of what each label's
    best kind of finding leaves open.

    A null text is empty; a text without words or findings has no labels and score 0. Rows with a null or repeated
    doc_id are documents of their own. Findings may overlap, and all count. An empty table gives no rows; other
    columns are ignored.
    """
    labels, tags = {**BASE, **PHRASES} if phrases is None else phrases, TAGS if tags is None else tags

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton({*labels, *tags})
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                n_words, found = findings(text, machine, labels, tags)
                best: dict[str, float] = {}
                level = -1
                for kind, _, names, *_, evaluated in found:
                    for name in names:
                        best[name] = max(best.get(name, 0.0), WEIGHT[kind])
                    level = max(level, evaluated if evaluated is not None else terms_of(names[0])[1])
                left = 1.0
                for name in sorted(best):
                    left *= 1 - best[name]
                out.append((doc_id, n_words, found, ",".join(sorted(best)), CLASSES[level] if found else None, 1 - left))
            yield pd.DataFrame(
                out, columns=["doc_id", "n_words", "findings", "labels", "terms", "score"]
            ).astype({"doc_id": "Int64"})

    return only(docs, doc_id="doc_id", text="text").mapInPandas(scan, _SCHEMA)


def digest(result: DataFrame, base: dict[str, str] = BASE) -> DataFrame:
    """Counts and places of the findings of ``base`` beside the labels of all."""
    hits = F.filter("findings", lambda f: (f["kind"] == "phrase") & f["phrase"].isin(list(base)))
    words = F.transform("base", lambda f: f["word"])
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("base", lambda f: f["labels"]))))
    return result.withColumn("base", hits).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(names, ",").alias("base_labels"),
        "labels",
        "score",
        "terms",
    )
