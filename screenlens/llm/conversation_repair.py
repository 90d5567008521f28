"""Repair of conversation structure by a rank-convergence parallel Viterbi search.

The cheapest edits that make a conversation's roles legal are a shortest path through four states (nothing said, system,
user, assistant), row by row. Rows are range-partitioned by (conversation, turn), so a conversation of any length is
spread over tasks, and cut into chunks of at most CHUNK rows. All chunks of a batch advance together as lanes of numpy
arrays. Costs are computed backward: a chunk starts from a speculative cost vector of its end, and hands the vector of
its first row to the chunk before it. A fix-up pass runs those chunks again whose true vector differs from the one used
by more than a constant; usually the vectors of long chunks agree after one pass. Chunks that still differ after FIX_UPS
passes (rows that all have to go, say, leave every difference as it is) get their answer for each state on its own, and
the answers are composed along the conversation. The stitched costs then drive the trace: from the entry state, always
the least letter that keeps the cost.

Whole conversations inside one partition, nearly all, need no pass beyond the first and no other shuffle. Texts are
shuffled once, and once more only for conversations that lie in several chunks or at a partition's edge. Only the last
step, a checksum over the whole repaired conversation and its audit, reads a conversation in one stream, chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlens.llm.common import WHITE, only
from screenlens.session import materialize

#: Rows and characters of a chunk (a longer text is a chunk of its own), fix-up passes, rows of lanes at once.
CHUNK = 1024
CHARACTERS = 4_000_000
FIX_UPS = 4
LANE_ROWS = 200_000

#: Costs: delete, reassign a role, insert, keep or reassign a truncated row.
DELETE, REROLE, INSERT, CUT = 2, 1, 5, 5
_FAR = 1 << 40
# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. From each, what user or assistant row may
# follow (as the class of a row's initial) and the state then.
_NEED = np.array([1, 1, 2, 1])
_NEXT = np.array([2, 2, 3, 2])
_END = np.array([0, 2 * INSERT, INSERT, 0])
_NAMES = {1: "user", 2: "assistant"}
# Codes of a row: class of the initial (s, u, a, other), then flags.
_CLASS, _TRUNCATED, _BLANK, _DUPLICATE = 3, 4, 8, 16

_PIECES = (
    "conv string, part long, piece long, closed boolean, low long, high long, turns long, codes binary, keys binary, "
    "roles array<string>, texts array<string>"
)
_CHUNKS = (
    "conv string, chunk_no long, closed boolean, low long, high long, turns long, blank long, duplicate long, "
    "truncated long, illegal long, first string, last string, cost long, audit string, roles array<string>, "
    "texts array<string>, edits array<string>"
)
_SUMMARY = (
    "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text: rows of conversations (conv_id, turn, role, text) after the contract's damage.

    Nulls are one space, but for a null turn, which stays and comes first.
    """
    rows = only(conversations, conv="conv_id", turn="turn", role="role", text="text").select(
        F.coalesce(F.col("conv").cast("string"), F.lit(" ")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    name = F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    return (
        rows.withColumn("kind", kind)
        .where("kind <> 0")
        .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "conv",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")).alias("text"),
        )
    )


def pieces(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Conversations cut into rows of at most ``chunk`` turns, in order of (part, piece); see _PIECES.

    ``closed``: the piece is a whole conversation. ``keys`` has 16 bytes per row, equal for equal role and text; what the
    partition saw earlier in the conversation is marked as a duplicate.
    """
    order = ["conv", "turn", "role", F.substring("text", 1, 200), F.xxhash64("text")]
    arranged = turns.repartitionByRange(*order, F.monotonically_increasing_id())
    arranged = arranged.sortWithinPartitions(*order[:3], "text")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, first = TaskContext.get().partitionId(), 0, True
        conv, cut, size, seen = None, 0, 0, set()
        rows: list[tuple] = []

        def piece(closed: bool) -> tuple:
            turns_, roles, texts, codes, keys = zip(*rows, strict=True)
            known = [t for t in turns_ if t is not None]
            low, high = (known[0], known[-1]) if known else (None, None)
            return conv, part, number, closed, low, high, len(set(known)), bytes(codes), b"".join(keys), roles, texts

        for batch in batches:
            out = []
            turns_of = batch["turn"].astype("Int64").astype(object).where(batch["turn"].notna(), None)
            for name, turn, role, text in zip(batch["conv"], turns_of, batch["role"], batch["text"], strict=True):
                if name != conv or len(rows) >= chunk or size >= CHARACTERS:
                    if rows:
                        out.append(piece(name != conv and not cut and not first))
                        number += 1
                    rows, size, cut = [], 0, cut + 1
                    if name != conv:
                        first = conv is None
                        conv, cut, seen = name, 0, set()
                code = "sua".find(role[:1]) if role else -1
                code = 3 if code < 0 else code
                key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                body = text.rstrip(WHITE)
                if not body:
                    code |= _BLANK
                elif key in seen:
                    code |= _DUPLICATE
                elif body[-1] not in ".!?":
                    code |= _TRUNCATED
                seen.add(key)
                rows.append((None if turn is None else int(turn), role, text, code, key))
                size += len(text)
            yield pd.DataFrame(out, columns=_columns(_PIECES)).astype({"low": "Int64", "high": "Int64"})
        if rows:
            last = pd.DataFrame([piece(False)], columns=_columns(_PIECES))
            yield last.astype({"low": "Int64", "high": "Int64"})

    return arranged.mapInPandas(scan, _PIECES)


def backward(codes: list[bytes], into: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs from every row on, of chunks as lanes that advance together.

    ``into`` has a cost vector of each chunk's end. Returns the rows' vectors (one more row per chunk, its end), where
    each chunk begins in them, and the chunks' codes in the same places.
    """
    length = np.array([len(c) for c in codes], np.int64)
    base = np.cumsum(length + 1) - (length + 1)
    costs = np.zeros((int((length + 1).sum()), 4), np.int64)
    code = np.zeros(len(costs), np.uint8)
    code[np.repeat(base, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = np.frombuffer(
        b"".join(codes), np.uint8
    )
    lanes = np.argsort(-length, kind="stable")
    ordered, v = length[lanes], into[lanes].astype(np.int64)
    costs[base[lanes] + ordered] = v
    for done in range(int(length.max(initial=0))):
        active = int(np.searchsorted(-ordered, -done))  # lanes longer than ``done`` come first
        row = base[lanes[:active]] + ordered[:active] - 1 - done
        v = v[:active]
        c = code[row]
        kept = np.where(c & _TRUNCATED, CUT, 0) + np.where(c & (_BLANK | _DUPLICATE), _FAR, 0)
        moved = v[:, _NEXT]
        same = (c & _CLASS)[:, None] == _NEED
        best = np.minimum(v + DELETE, moved + (REROLE + kept)[:, None])
        best = np.minimum(best, np.where(same, moved, _FAR) + kept[:, None])
        best[:, 0] = np.minimum(best[:, 0], np.where((c & _CLASS) == 0, v[:, 1], _FAR) + kept)
        best[:, 2] = np.minimum(best[:, 2], best[:, 3] + INSERT)
        for state in (0, 1, 3):
            best[:, state] = np.minimum(best[:, state], best[:, 2] + INSERT)
        costs[row] = v = best
    return costs, base, code


def trace(
    codes: list[bytes], costs: np.ndarray, base: np.ndarray, code: np.ndarray, entry: np.ndarray, last: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ASCII-least cheapest edits of every chunk from its entry state.

    Returns exit states, costs, and of all edits in order of chunk and place: chunk, letter, row (-1 for an insertion) and
    class of the role after it (-1 if the row goes, 0 if it stays as it is). ``last``: edits may follow the last row.
    """
    length = np.array([len(c) for c in codes], np.int64)
    state, at, spent = entry.astype(np.int64).copy(), np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    active = np.arange(len(codes))
    log = []
    while len(active):
        n, s, t = base[active], state[active], at[active]
        here = costs[n + t]
        now = here[np.arange(len(active)), s]
        over = t == length[active]
        stop = over & (~last[active] | (_END[s] == 0))
        if stop.any():
            going = ~stop
            active, n, s, t, here, now, over = active[going], n[going], s[going], t[going], here[going], now[going], over[going]
            if not len(active):
                break
        rows = np.arange(len(active))
        c = code[n + t]
        after = costs[np.where(over, n + t, n + t + 1)]
        kept = np.where(c & _TRUNCATED, CUT, 0)
        free = ~over & ((c & (_BLANK | _DUPLICATE)) == 0)
        delete = ~over & (after[rows, s] + DELETE == now)
        insert = ~delete & (here[rows, _NEXT[s]] + INSERT == now)
        system = (s == 0) & ((c & _CLASS) == 0)
        onward = np.where(system, 1, _NEXT[s])
        keep = ~delete & ~insert & free & (system | ((c & _CLASS) == _NEED[s])) & (after[rows, onward] + kept == now)
        letter = np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(keep, ord("K"), ord("R"))))
        role = np.where(delete, -1, np.where(keep, 0, _NEED[s]))
        log.append((active, letter, np.where(insert, -1, t), role))
        change = ~delete & ~insert & ~keep
        spent[active] += np.where(delete, DELETE, np.where(insert, INSERT, kept + np.where(change, REROLE, 0)))
        state[active] = np.where(delete, s, np.where(keep, onward, _NEXT[s]))
        at[active] = t + ~insert
    if not log:
        nothing = np.empty(0, np.int64)
        return state, spent, nothing, nothing, nothing, nothing
    lane, letter, row, role = (np.concatenate(x) for x in zip(*log, strict=True))
    order = np.argsort(lane, kind="stable")
    return state, spent, lane[order], letter[order], row[order], role[order]


def _parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The batch in parts of bounded rows."""
    total = batch["codes"].map(len).cumsum() // LANE_ROWS
    for _, part in batch.groupby(total, sort=False):
        yield part


def _vectors(column) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in column], np.int64).reshape(-1, 4)


def _passed(chunks: DataFrame) -> DataFrame:
    """``out``: the vector of the first row of chunks (conv, chunk_no, codes, into), less its smallest cost."""

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                costs, base, _ = backward(list(part["codes"]), _vectors(part["into"]))
                out = costs[base]
                yield part.assign(out=list(out - out.min(axis=1, keepdims=True)))

    return chunks.mapInPandas(run, "conv string, chunk_no long, n_chunks long, codes binary, into array<long>, out array<long>")


def stitched(chunks: DataFrame, fix_ups: int = FIX_UPS) -> DataFrame:
    """conv, chunk_no, n_chunks, codes, into: chunks (the first four) with the true cost vector of their end, but for a
    constant."""
    end = F.array(*[F.lit(int(x)).cast("long") for x in _END])
    guess = F.array(*[F.lit(0).cast("long")] * 4)
    final = F.col("chunk_no") == F.col("n_chunks") - 1
    state = materialize(_passed(chunks.withColumn("into", F.when(final, end).otherwise(guess))), "viterbi")

    def taught(state: DataFrame) -> DataFrame:
        later = state.select("conv", (F.col("chunk_no") - 1).alias("chunk_no"), F.col("out").alias("true"))
        both = state.join(later, ["conv", "chunk_no"], "left")
        lowest = F.array_min("into")
        used = F.transform("into", lambda x: x - lowest)
        return both.withColumn("wrong", F.coalesce(F.col("true") != used, F.lit(False)))

    kept = ["conv", "chunk_no", "n_chunks", "codes"]
    for _ in range(fix_ups):
        checked = taught(state)
        if checked.where("wrong").isEmpty():
            return state.select(*kept, "into")
        again = _passed(checked.where("wrong").select(*kept, F.col("true").alias("into")))
        state = materialize(checked.where("not wrong").select(*kept, "into", "out").unionByName(again), "viterbi")
    if taught(state).where("wrong").isEmpty():
        return state.select(*kept, "into")
    return _composed(chunks)


def _composed(chunks: DataFrame) -> DataFrame:
    """The same without speculation: each chunk's answer to each state of its end, composed from the last chunk back."""

    def answers(batches):
        for batch in batches:
            for part in _parts(batch):
                codes = list(part["codes"])
                outs = []
                for state in range(4):
                    into = np.full((len(codes), 4), _FAR // 4)
                    into[:, state] = 0
                    costs, base, _ = backward(codes, into)
                    outs.append(costs[base])
                yield part.assign(answer=list(np.stack(outs, 1).reshape(len(codes), 16)))

    def compose(batches):
        conv, vector = None, None
        for batch in batches:
            into = []
            for name, number, count, answer in zip(
                batch["conv"], batch["chunk_no"], batch["n_chunks"], batch["answer"], strict=True
            ):
                if name != conv:
                    assert number == count - 1
                    conv, vector = name, _END
                into.append(vector)
                vector = (vector[:, None] + np.asarray(answer, np.int64).reshape(4, 4)).min(axis=0)
                vector = vector - vector.min()
            yield batch.drop(columns="answer").assign(into=into)

    schema = "conv string, chunk_no long, n_chunks long, codes binary"
    answered = chunks.select(*_columns(schema)).mapInPandas(answers, f"{schema}, answer array<long>")
    ordered = answered.repartition("conv").sortWithinPartitions("conv", F.desc("chunk_no"))
    return materialize(ordered.mapInPandas(compose, f"{schema}, into array<long>"), "viterbi")


def entered(chunks: DataFrame) -> DataFrame:
    """conv, chunk_no, entry: the state in which the cheapest edits reach each chunk of a ``stitched`` table."""

    def exits(batches):
        for batch in batches:
            for part in _parts(batch):
                codes = list(part["codes"])
                last = (part["chunk_no"] == part["n_chunks"] - 1).to_numpy()
                costs, base, code = backward(codes, _vectors(part["into"]))
                found = [trace(codes, costs, base, code, np.full(len(codes), s), last)[0] for s in range(4)]
                yield part[["conv", "chunk_no"]].assign(exits=list(np.stack(found, 1)))

    def follow(batches):
        conv, state = None, 0
        for batch in batches:
            entry = []
            for name, leads in zip(batch["conv"], batch["exits"], strict=True):
                if name != conv:
                    conv, state = name, 0
                entry.append(state)
                state = int(leads[state])
            yield batch[["conv", "chunk_no"]].assign(entry=entry)

    found = chunks.mapInPandas(exits, "conv string, chunk_no long, exits array<long>")
    ordered = found.repartition("conv").sortWithinPartitions("conv", "chunk_no")
    return ordered.mapInPandas(follow, "conv string, chunk_no long, entry long")


def _seen_before(numbered: DataFrame) -> DataFrame:
    """conv, chunk_no, again: places of rows whose role and text an earlier chunk of the conversation has.

    A partition has marked what it saw itself, so a (conversation, key) has at most one row per partition here.
    """

    def keys(batches):
        for batch in batches:
            out = []
            for conv, number, codes, keys_ in zip(
                batch["conv"], batch["chunk_no"], batch["codes"], batch["keys"], strict=True
            ):
                out += [
                    (conv, number, place, keys_[16 * place : 16 * place + 16])
                    for place, code in enumerate(codes)
                    if not code & (_BLANK | _DUPLICATE)
                ]
            yield pd.DataFrame(out, columns=["conv", "chunk_no", "place", "key"])

    spread = numbered.where("parts > 1").select("conv", "chunk_no", "codes", "keys")
    rows = spread.mapInPandas(keys, "conv string, chunk_no long, place int, key binary")
    firsts = rows.groupBy("conv", "key").agg(F.min("chunk_no").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = rows.join(firsts.drop("n"), ["conv", "key"]).where("chunk_no > first")
    return later.groupBy("conv", "chunk_no").agg(F.collect_list("place").alias("again"))


def _marked(batch: pd.DataFrame) -> list[bytes]:
    """Codes with the rows in ``again`` as duplicates."""
    marked = []
    for codes, again in zip(batch["codes"], batch["again"], strict=True):
        if again is not None and len(again):
            changed = np.frombuffer(codes, np.uint8).copy()
            changed[np.asarray(again)] = (changed[np.asarray(again)] & _CLASS) | _DUPLICATE
            codes = changed.tobytes()
        marked.append(bytes(codes))
    return marked


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces with ``into``, ``entry``, ``codes`` -> repaired chunks; see _CHUNKS."""
    for batch in batches:
        for part in _parts(batch):
            codes = [bytes(c) for c in part["codes"]]
            last = (part["chunk_no"] == part["n_chunks"] - 1).to_numpy()
            costs, base, code = backward(codes, _vectors(part["into"]))
            _, spent, lane, letter, row, role = trace(codes, costs, base, code, part["entry"].to_numpy(), last)
            cuts = np.searchsorted(lane, np.arange(len(codes) + 1))
            out = []
            for n, one in enumerate(part.itertuples(index=False)):
                c = np.frombuffer(codes[n], np.uint8)
                kind = c & _CLASS
                legal = ((kind[:-1] == 0) & (kind[1:] == 1)) | (kind[:-1] + kind[1:] == 3) & (kind[:-1] != 0) & (kind[1:] != 0)
                edits = letter[cuts[n] : cuts[n + 1]].astype(np.uint8).tobytes().decode()
                roles, texts, marks = [], [], []
                for edit, place, new in zip(edits, row[cuts[n] : cuts[n + 1]].tolist(), role[cuts[n] : cuts[n + 1]].tolist(), strict=True):
                    if edit != "D":
                        roles.append(one.roles[place] if edit == "K" else _NAMES[new])
                        texts.append(one.texts[place] if place >= 0 else "")
                        marks.append(edit)
                out.append(
                    (
                        one.conv, one.chunk_no, one.closed, one.low, one.high, one.turns,
                        int((c & _BLANK > 0).sum()), int((c & _DUPLICATE > 0).sum()), int((c & _TRUNCATED > 0).sum()),
                        int((~legal).sum()), one.roles[0][:1], one.roles[-1][:1], int(spent[n]), edits, roles, texts, marks,
                    )
                )
            yield pd.DataFrame(out, columns=_columns(_CHUNKS)).astype({"low": "Int64", "high": "Int64"})


def _assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks in order of (conv, chunk_no) -> one row per conversation; see _SUMMARY. Only the audit is held whole."""
    conv, sha, state = None, None, None

    def result() -> tuple:
        gaps = 0 if state["high"] is None else state["high"] - state["low"] + 1 - state["turns"]
        sums = [state[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")]
        return conv, gaps, *sums, "".join(state["audit"]), sha.hexdigest()

    for batch in batches:
        out = []
        for one in batch.itertuples(index=False):
            low = None if pd.isna(one.low) else int(one.low)
            high = None if pd.isna(one.high) else int(one.high)
            if one.conv != conv:
                if conv is not None:
                    out.append(result())
                conv, sha, begun = one.conv, hashlib.sha256(), False
                state = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
                state |= {"low": None, "high": None, "audit": [], "before": None, "begun": False}
            state["turns"] += int(one.turns) - (low is not None and low == state["high"])
            if state["low"] is None:
                state["low"] = low
            state["high"] = state["high"] if high is None else high
            for name in ("blank", "duplicate", "truncated", "illegal", "cost"):
                state[name] += int(getattr(one, name))
            state["illegal"] += state["before"] is not None and state["before"] + one.first not in ("su", "ua", "au")
            state["before"] = one.last
            state["audit"].append(one.audit)
            for role, text in zip(one.roles, one.texts, strict=True):
                sha.update(f"{chr(10) if state['begun'] else ''}{role}:{text}".encode())
                state["begun"] = True
        yield pd.DataFrame(out, columns=_columns(_SUMMARY))
    if conv is not None:
        yield pd.DataFrame([result()], columns=_columns(_SUMMARY))


@dataclass(frozen=True)
class Repaired:
    """Repaired chunks: ``closed`` ones are whole conversations, ``open`` ones may have others before or after them."""

    closed: DataFrame
    open: DataFrame

    def turns(self) -> DataFrame:
        """conv, chunk_no, place, role, text, edit of every row of the repaired conversations, in this order."""
        rows = F.posexplode(F.arrays_zip("roles", "texts", "edits")).alias("place", "row")
        both = self.closed.unionByName(self.open).select("conv", "chunk_no", rows)
        return both.select(
            "conv", "chunk_no", "place", F.col("row.roles").alias("role"), F.col("row.texts").alias("text"),
            F.col("row.edits").alias("edit"),
        )

    def conversations(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
        whole = self.closed.mapInPandas(_assemble, _SUMMARY)
        ordered = self.open.repartition("conv").sortWithinPartitions("conv", "chunk_no")
        return whole.unionByName(ordered.mapInPandas(_assemble, _SUMMARY))


def repair(turns: DataFrame, chunk: int = CHUNK, fix_ups: int = FIX_UPS) -> Repaired:
    """The cheapest repair of every conversation of ``turns`` (conv string, turn long, role, text; no nulls but in turn).

    Rows stand in order of turn, nulls first, then role and text. Blank rows and rows whose role and text were seen earlier
    in the conversation go (2 each). Others stay (5 more if their text does not end in ``.!?``), become user or assistant
    (1 more), or go (2); empty user and assistant rows may come in anywhere (5). The roles' initials must then read
    ``(s?(ua)+)?``. Of the cheapest edits those are taken whose letters D, I, K, R come first. Equal rows of one turn are
    rows of their own, of which the first counts; roles other than system, user, assistant count by their initial. An
    empty table gives no rows; other columns are ignored.
    """
    cut = materialize(pieces(turns.select("conv", "turn", "role", "text"), chunk), "turns")
    unclosed = cut.where("not closed")
    along = "conv", "part", "piece"
    places = unclosed.select(*along).selectExpr(
        "*",
        "cast(row_number() over (partition by conv order by part, piece) - 1 as long) as chunk_no",
        "count(*) over (partition by conv) as n_chunks",
        "max(part) over (partition by conv) - min(part) over (partition by conv) + 1 as parts",
    )
    slim = unclosed.select("part", "piece", "codes", "keys").join(places, ["part", "piece"])
    again = _seen_before(slim)
    numbered = slim.join(again, ["conv", "chunk_no"], "left")

    def mark(batches):
        for batch in batches:
            yield batch.assign(codes=_marked(batch)).drop(columns="again")

    named = "conv string, part long, piece long, chunk_no long, n_chunks long, codes binary"
    columns = _columns(named)
    marked = materialize(numbered.select(*columns, "again").mapInPandas(mark, named), "marked")
    true = stitched(marked.drop("part", "piece"), fix_ups)
    states = entered(true)
    known = (
        marked.select("conv", "chunk_no", "part", "piece")
        .join(true, ["conv", "chunk_no"])
        .join(states, ["conv", "chunk_no"])
        .drop("conv")
    )
    whole = cut.where("closed").withColumns(
        {
            "chunk_no": F.lit(0).cast("long"),
            "n_chunks": F.lit(1).cast("long"),
            "into": F.array(*[F.lit(int(x)).cast("long") for x in _END]),
            "entry": F.lit(0).cast("long"),
        }
    )
    opened = unclosed.drop("codes", "keys").join(known, ["part", "piece"])
    return Repaired(whole.drop("keys").mapInPandas(_finish, _CHUNKS), opened.mapInPandas(_finish, _CHUNKS))


def digest(conversations: DataFrame, repaired: Repaired) -> DataFrame:
    """One row per conv_id of ``conversations``; one without any row after the damage has zeros and an empty audit."""
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    every = every.withColumn("name", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    found = every.join(repaired.conversations(), F.col("name") == F.col("conv"), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _columns(_SUMMARY)[1:7]]
    return found.select(
        "conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
