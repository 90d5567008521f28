"""Benchmark decontamination by canonical templates.

Numbers, units after numbers and names become typed placeholders, so a question asked anew with other values has the
same template. Windows of five canonical tokens of documents and of benchmark items are joined by hash; those on one
diagonal (document position minus item position) are one occurrence of the item. Its slots must be filled consistently:
equal values of the item are equal in the document. Diagonals that shift a little (words put in or left out) are taken
together, and an item is found where windows cover SIMILARITY of the tokens that its windows can cover.

Items whose every window is poor in words, or that are shorter than a window, are sought as they stand: a literal view
keeps numbers, units and names as their values, needs no words, and its window is the item where that is shorter.

Of a document only windows whose hash passes a bit table of the benchmark's windows leave the scan; the table has a
fixed size, its false hits fall out in the join. So the benchmark may be of any size, and no text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlens.llm.common import only
from screenlens.session import materialize

WINDOW = 5
SIMILARITY = 0.8
#: Tokens of a window that must be words: placeholders alone are no evidence.
LITERALS = 3
#: Diagonals that may be one occurrence: words put in or left out of it.
SHIFT = 8
#: Bits of the table that windows of documents are tested against (2 MB at most are collected and sent).
TABLE_BITS = 1 << 23

# Abbreviations and words of units, lower-case.
UNITS = """
% kg g mg km m cm mm l ml h min s ms kb mb gb tb w kw v a hz khz mhz ghz c f k j kj n pa
mile miles foot feet inch inches yard yards pound pounds ounce ounces gallon gallons
meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters gram grams kilogram kilograms
liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years
dollar dollars euro euros cent cents degree degrees percent
""".split()

#: Letters of scripts that put no spaces between words; each is a token.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"\d+(?:[.,:/]\d+)*|(?=[^\W\d_])[{_UNSPACED}]|[^\W\d_{_UNSPACED}]+|[%.!?:;\n\"“”¿¡]")
_BREAK, _WORD, _CAPITAL, _NUMBER, _UNIT = range(5)
_NAME = 5
_UNIT_WORDS = frozenset(UNITS)
#: Views of a text: names as words; names within sentences as slots; sentences' first names too; LITERAL plus the size of the window: as it stands.
_PLAIN, _NAMES, _FIRST_NAMES, _LITERAL = 0, 1, 2, 10


class _Vocabulary(dict):
    """Numbers for tokens as they come, with a hash and a kind each; forgets all once it is large."""

    def __init__(self):
        self.clear_all()

    def clear_all(self):
        self.clear()
        self.hashes, self.kinds = [], []

    def __missing__(self, token: str) -> int:
        self[token] = number = len(self.kinds)
        first = token[0]
        if first.isdigit():
            kind = _NUMBER
        elif token.lower() in _UNIT_WORDS:
            kind = _UNIT
        elif not first.isalpha():
            kind = _BREAK
        else:
            kind = _CAPITAL if token.istitle() else _WORD
        self.kinds.append(kind)
        self.hashes.append(xxhash.xxh64_intdigest(token.lower().encode()))
        return number


def _hash_of(kind: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(f"<{kind}>".encode(), 1))


_PLACEHOLDER = {_NUMBER: _hash_of("number"), _UNIT: _hash_of("unit"), _NAME: _hash_of("name")}
_FACTORS = np.array([xxhash.xxh64_intdigest(b"factor", i) | 1 for i in range(64)], np.uint64)


class Tokens:
    """The tokens of a text with their hashes and kinds, units told from words by the number before them."""

    def __init__(self, text: str | None, vocabulary: _Vocabulary):
        self.raw = _TOKEN.findall(text or "")
        if len(vocabulary) > 500_000:
            vocabulary.clear_all()
        ids = np.fromiter(map(vocabulary.__getitem__, self.raw), np.int64, len(self.raw))
        kinds, self.hashes = _kinds(vocabulary)[ids], _hashes(vocabulary)[ids]
        unit = (kinds == _UNIT) & (_before(kinds) != _NUMBER)
        self.kinds = np.where(unit, np.where(self.hashes == _PERCENT, _BREAK, _WORD), kinds)

    def has_names(self) -> bool:
        return bool(((self.kinds == _CAPITAL) & (_before(self.kinds) != _BREAK)).any())

    def has_first_capitals(self) -> bool:
        return bool(((self.kinds == _CAPITAL) & (_before(self.kinds) == _BREAK)).any())


def _before(kinds: np.ndarray) -> np.ndarray:
    """The kind of the token before each; a break before the first."""
    return np.concatenate([[_BREAK], kinds[:-1]])[: len(kinds)]


class Canonical:
    """Canonical tokens of a text: hash, kind (word or placeholder) and the value that filled each placeholder.

    ``names``: capitalised words within a sentence are names, and what follows of one name is part of its slot;
    with ``first``, so is a capitalised word that begins a sentence, which may be a name or not. Without ``names`` they
    are words like others, so that a question in capitals is still the same question. ``literal``: numbers and units
    are words too, and there is no slot.
    """

    def __init__(self, tokens: Tokens, names: bool, first: bool = False, literal: bool = False):
        kinds = tokens.kinds
        if literal:
            kinds = np.where(kinds == _BREAK, _BREAK, _WORD)
            more = np.zeros(len(kinds), bool)
        elif names:
            begins = (_before(kinds) == _BREAK) & (not first)
            kinds = np.where(kinds == _CAPITAL, np.where(begins, _WORD, _NAME), kinds)
            more = (kinds == _NAME) & (_before(kinds) == _NAME)
        else:
            kinds = np.where(kinds == _CAPITAL, _WORD, kinds)
            more = np.zeros(len(kinds), bool)
        stay = (kinds != _BREAK) & ~more
        self.raw, self._all_kinds = tokens.raw, kinds
        self.kinds, self.at, self.hashes = kinds[stay], np.nonzero(stay)[0], tokens.hashes[stay]
        for kind, value in _PLACEHOLDER.items():
            self.hashes[self.kinds == kind] = value

    def __len__(self) -> int:
        return len(self.kinds)

    def windows(self, size: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every window that has enough words."""
        n = len(self) - size + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        rolled = np.zeros(n, np.uint64)
        words = np.zeros(n, np.int8)
        for i in range(size):
            rolled += self.hashes[i : i + n] * _FACTORS[i]
            words += self.kinds[i : i + n] == _WORD
        start = np.nonzero(words >= literals)[0]
        return start, rolled[start]

    def value(self, i: int) -> str | None:
        """What filled slot ``i``, lower-case; None for a word."""
        if self.kinds[i] == _WORD:
            return None
        at = self.at[i]
        upto = at + 1
        while self.kinds[i] == _NAME and upto < len(self.raw) and self._all_kinds[upto] == _NAME:
            upto += 1
        return f"{self.kinds[i]}:" + " ".join(self.raw[at:upto]).lower()

    def slots(self, start: int, size: int) -> list[str]:
        return [self.value(i) for i in range(start, start + size) if self.kinds[i] != _WORD]


_PERCENT = np.uint64(xxhash.xxh64_intdigest(b"%"))


def _kinds(v: _Vocabulary) -> np.ndarray:
    return _cached(v, "kinds", np.int8)


def _hashes(v: _Vocabulary) -> np.ndarray:
    return _cached(v, "hashes", np.uint64)


def _cached(v: _Vocabulary, name: str, dtype) -> np.ndarray:
    """The vocabulary's list as an array with room to grow, filled up with what has come since."""
    values = getattr(v, name)
    of, filled, array = v.__dict__.get(f"{name}_array", (None, 0, np.zeros(1 << 12, dtype)))
    if of is not values:
        filled = 0
    if len(values) > len(array):
        array = np.concatenate([array, np.zeros(max(len(values), len(array)), dtype)])
    array[filled : len(values)] = values[filled:]
    v.__dict__[f"{name}_array"] = (values, len(values), array)
    return array


_WINDOWS = (
    "doc_id long, view int, n_tokens int, n_usable int, pos array<int>, hash array<long>, slots array<array<string>>"
)


def windows(
    docs: DataFrame, table: bytes | None, size: int, literals: int, literal_sizes: tuple[int, ...] = ()
) -> DataFrame:
    """Windows of every text of ``docs`` (doc_id, text): all, or those that ``table`` may hold.

    One row per text and view: with names as words, with names as slots, where these begin sentences too, and literal. Without ``table`` a text has the
    literal view if it has no other window with names as words; with it, in windows of ``literal_sizes``. n_usable
    counts the tokens that the row's windows cover.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = _Vocabulary()
        bits = np.unpackbits(np.frombuffer(table, np.uint8), bitorder="little").view(bool) if table else None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for view, width, of, start, hashes in views(Tokens(text, vocabulary), table is None):
                    if bits is not None:
                        found = bits[(hashes & np.uint64(len(bits) - 1)).view(np.int64)]
                        start, hashes = start[found], hashes[found]
                    if bits is not None and width < size:  # the window is the whole item: one place is enough
                        hashes, first = np.unique(hashes, return_index=True)
                        start = start[first]
                    if len(start):
                        slots = [of.slots(s, width) for s in start.tolist()]
                        usable = int(np.minimum(np.diff(start, append=start[-1] + width), width).sum())
                        hashes = hashes.view(np.int64).tolist()
                        out.append((doc_id, view, len(of), usable, start.tolist(), hashes, slots))
            names = ["doc_id", "view", "n_tokens", "n_usable", "pos", "hash", "slots"]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    def views(tokens: Tokens, every: bool) -> Iterator[tuple]:
        plain = Canonical(tokens, names=False)
        found = plain.windows(size, literals)
        yield _PLAIN, size, plain, *found
        # without names both views are the same, and whatever has the slot of a name is elsewhere
        if every or tokens.has_names():
            named = Canonical(tokens, names=True)
            yield _NAMES, size, named, *named.windows(size, literals)
        if every or tokens.has_first_capitals():
            named = Canonical(tokens, names=True, first=True)
            yield _FIRST_NAMES, size, named, *named.windows(size, literals)
        widths = literal_sizes
        if every:
            widths = (min(size, len(plain)),) if len(plain) and not len(found[0]) else ()
        if widths:
            literal = Canonical(tokens, names=False, literal=True)
            for width in widths:
                yield _LITERAL + width, width, literal, *literal.windows(width, 0)

    return docs.mapInPandas(scan, _WINDOWS)


def _exploded(rows: DataFrame) -> DataFrame:
    each = rows.select("doc_id", "view", F.explode(F.arrays_zip("pos", "hash", "slots")).alias("w"))
    return each.select("doc_id", "view", "w.pos", "w.hash", "w.slots")


def _templates(benchmark: DataFrame, size: int, literals: int) -> DataFrame:
    """Windows of the benchmark, once for each template: item_id (the smallest), n_items, n_tokens, n_usable, pos, hash, slots.

    Items with the same windows and the same pattern of equal slots cannot be told apart by values: they are one.
    """
    rows = windows(benchmark, None, size, literals)
    values = F.flatten("slots")
    pattern = F.transform(values, lambda v: F.array_position(values, v))
    return (
        rows.groupBy("view", "n_tokens", "n_usable", "pos", "hash", pattern.alias("pattern"))
        .agg(F.min("doc_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"), F.min("slots").alias("slots"))
        .select(
            "view", "item_id", "n_items", "n_tokens", "n_usable", F.explode(F.arrays_zip("pos", "hash", "slots")).alias("w")
        )
        .select(
            F.col("view").alias("item_view"),
            "item_id",
            "n_items",
            "n_tokens",
            "n_usable",
            F.col("w.pos").alias("item_pos"),
            F.col("w.hash").alias("item_hash"),
            F.col("w.slots").alias("item_slots"),
        )
    )


def _bit_table(hashes: DataFrame, column: str) -> bytes:
    """The table of the column's hashes; what is collected is at most TABLE_BITS / 64 rows."""
    rows = (
        hashes.select(F.pmod(F.col(column), F.lit(TABLE_BITS)).alias("place"))
        .select(F.expr("place div 64").alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )
    table = np.zeros(TABLE_BITS // 64, np.int64)
    for r in rows:
        table[r["word"]] = r["bits"]
    return table.tobytes()


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    similarity: float = SIMILARITY,
    literals: int = LITERALS,
) -> DataFrame:
    """doc_id, item_id, n_items, n_tokens, coverage: one row per document and template of the benchmark found in it.

    item_id is the smallest id of the items with that template, n_items their number, coverage the share of the
    template's tokens within usable windows that consistent windows of one occurrence cover (the best occurrence), at
    least ``similarity``.

    Every text is seen with names as words, with names within sentences as slots, and with what begins sentences as
    slots too; the best view counts.
    Case, punctuation and white space do not count. Windows with fewer than ``literals`` words are not usable. Items
    without a usable window, such as those with fewer than ``size`` tokens, are found where they stand with their own
    values; one of a single token is found wherever that token stands. Items without tokens, and null and empty texts,
    are never found. Repeated rows of a document are one. Rows with a null doc_id are searched together as one document with null doc_id. Either table empty: no
    rows. Other columns are ignored; texts are read whole.
    """
    items = only(benchmark, doc_id=item_col, text=item_text_col)
    wanted = materialize(_templates(items, size, literals), "benchmark-windows")
    table = _bit_table(wanted, "item_hash")
    own = only(docs, doc_id=id_col, text=text_col)
    literal = wanted.where(F.col("item_view") > _LITERAL).select("item_view").distinct().collect()  # at most ``size``
    sizes = tuple(sorted(r["item_view"] - _LITERAL for r in literal))
    met = _exploded(windows(own, table, size, literals, sizes))
    hits = met.join(wanted, (F.col("hash") == F.col("item_hash")) & (F.col("view") == F.col("item_view")))
    key = ["doc_id", "view", "item_id", "n_items", "n_tokens", "n_usable"]
    # two sets of overlapping bands, so that diagonals half a band apart always meet in one
    band = F.floor(F.col("diagonal") / SHIFT)
    shifted = F.floor((F.col("diagonal") + SHIFT // 2) / SHIFT)
    near = _consistent(hits, key).select(
        *key,
        "positions",
        F.explode(F.array(F.struct(F.lit(0), band.alias("b")), F.struct(F.lit(1), shifted.alias("b")))).alias("near"),
    )
    covered = F.size(
        F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + F.least(F.lit(size), "n_tokens") - 1))))
    )
    return (
        near.groupBy(*key, "near")
        .agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("starts"))
        .select(*key, (covered / F.col("n_usable")).alias("coverage"))
        .where(F.col("coverage") >= similarity)
        .groupBy("doc_id", "item_id")
        .agg(*[F.max_by(c, F.struct("coverage", "n_items")).alias(c) for c in ("n_items", "n_tokens", "coverage")])
    )


def _consistent(hits: DataFrame, key: list[str]) -> DataFrame:
    """key, diagonal, positions of the diagonals on which each value of the item has one value in the document."""
    pairs = F.zip_with("item_slots", "slots", lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    return (
        hits.select(*key, (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_pos", pairs.alias("pairs"))
        .groupBy(*key, "diagonal")
        .agg(
            F.collect_set("item_pos").alias("positions"),
            F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
        )
        .where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))))
        .select(*key, "diagonal", "positions")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and other columns) without the documents that hold a benchmark item.

    Rows with a null doc_id stay if none of them holds one.
    """
    found = find_leaks(docs, benchmark).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("__leak")), "left_anti")
