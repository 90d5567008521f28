"""Work along one ordered sequence per key when a single key may hold much of the table.

A plain ``Window.partitionBy(key)`` puts a whole video in one task. :func:`folded` works along sequences of any length
instead. A table that the optimizer takes for small is dealt by key, and every task walks through its sequences, with
no job before the query runs. Any other is range-partitioned by (keys, order), cut into chunks of equally many rows,
whatever the skew, and written once, so that both passes see the same chunks and nothing upstream runs twice: every chunk is
summarised, the
summaries (one small row per chunk) are composed in order, and each chunk is worked through with what reaches it. Both
ways share all code for a stretch of rows. Nothing is counted or collected.

:class:`Ordered` gives running sums and maxima, last and next values on top of it; :func:`asof`, :func:`neighbours` and
:func:`number_rows` are such scans. A task holds one chunk, or a batch of whole sequences.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlens.session import materialize

CHUNK, FIRST = "_chunk", "_first"
#: Rows handled at once where that is free to choose.
BATCH = 50_000
#: Bytes of stored input that a range partition stands for; a table made of less is not cut.
CHUNK_BYTES = 8 << 20
#: A chunk holds two to this power of rows, however large the table is: what a Python worker holds does not grow with it.
CHUNK_BITS = 17
_ENTRY = "chunk bigint, entry binary"


def chunks_for(df: DataFrame) -> int:
    """How many range partitions to cut ``df`` into: by the size of the tables it is made of, as many as shuffles have
    partitions at most. No job is needed for that, and every number gives the same result."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frame = getattr(df, "_jdf", None)
    if frame is None:
        return most
    # What the optimizer says of a join is the product of both sides, so the tables themselves are asked.
    leaves = frame.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return max(1, min(most, -(-size // CHUNK_BYTES)))


def cut(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, bool]:
    """``df`` ready for :func:`folded`, and whether it was cut: then CHUNK numbers stretches of its rows in order of (keys,
    order), and FIRST marks one row of each."""
    n = chunks_for(df)
    if n == 1:
        return df.repartition(*keys), False
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    chunk, leads = every_so_many()
    return materialize(ranged.withColumns({CHUNK: chunk, FIRST: leads}), "ordered").repartition(CHUNK), True


def every_so_many() -> tuple[Column, Column]:
    """The number of each row's chunk, rising along the sorted range partitions, and whether the row is the chunk's first."""
    place = F.monotonically_increasing_id()  # the partition above the lowest 33 bits, the row's place in it below
    return F.shiftright(place, CHUNK_BITS), place.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)) == 0


def folded(
    df: DataFrame,
    is_cut: bool,
    keys: list[str],
    order: list[str] | None,
    summarise: Callable[[pa.Table], object],
    compose: Callable[[list[object]], list[object]],
    apply: Callable[[pa.Table, object], pa.Table],
    schema: T.StructType,
) -> DataFrame:
    """Work through the sequences of ``df``, as :func:`cut` makes it, all at the same time.

    ``order``: by what sequences are sorted, None if they come so. ``summarise`` reduces a chunk, sorted by (keys, order),
    to a small object. ``compose`` gets the objects of all chunks in order and returns what
    reaches each of them. ``apply`` turns a chunk, or some whole sequences, and what reaches it into rows of ``schema``.
    The objects are pickled; they must not grow with the chunk.
    """

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        if not is_cut:
            yield from whole_groups(batches, keys)
            return
        for several in whole_groups(batches, [CHUNK], 1):
            runs = np.unique(Groups.by(several, [CHUNK]).first)
            for a, b in zip(runs, np.append(runs[1:], several.num_rows), strict=True):
                yield several.slice(int(a), int(b - a))

    def entries(rows: list[tuple[int, object]]) -> pa.RecordBatch:
        chunk, state = zip(*rows, strict=True)
        arrays = [pa.array(chunk, pa.int64()), pa.array([pickle.dumps(s) for s in state], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["chunk", "entry"])

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tables(batches):
            yield entries([(rows[CHUNK][0].as_py(), summarise(rows))])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r["chunk"], r["entry"]) for batch in batches for r in batch.to_pylist())
        if found:
            reached = compose([pickle.loads(state) for _, state in found])
            yield entries([(chunk, entry) for (chunk, _), entry in zip(found, reached, strict=True)])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tables(batches):
            if is_cut:
                at = pc.indices_nonzero(pc.is_valid(rows["_entry"]))[0].as_py()
                reached = pickle.loads(rows["_entry"][at].as_py())
                rows = rows.drop_columns(["_entry"])
            else:
                reached = compose([summarise(rows)])[0]
            yield from apply(rows, reached).combine_chunks().to_batches(max_chunksize=BATCH)

    def in_order(rows: DataFrame) -> DataFrame:
        return rows if order is None else rows.sortWithinPartitions(*([CHUNK] if is_cut else []), *keys, *order)

    if not is_cut:
        return in_order(df).mapInArrow(applied, schema)
    # At most one entry per chunk, so entries may go to one task and from there to all.
    entry = in_order(df).mapInArrow(summaries, _ENTRY).repartition(1).mapInArrow(composed, _ENTRY)
    named = entry.select(F.col("chunk").alias("_at"), F.col("entry").alias("_entry"))
    told = df.join(F.broadcast(named), F.when(F.col(FIRST), F.col(CHUNK)) == F.col("_at"), "left").drop("_at")
    # Sorted only here: a sort below a join may be dropped.
    return in_order(told).mapInArrow(applied, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = BATCH) -> Iterator[pa.Table]:
    """A sorted stream as tables of at least ``rows`` rows (but for the last one) that never part a group of equal keys."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows or all(held[0][k][0].as_py() == batch[k][-1].as_py() for k in keys):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        end = int(Groups.by(table, keys).first[-1])
        if end:
            yield table.slice(0, end)
            held = table.slice(end).to_batches()
            count = table.num_rows - end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


@dataclass(frozen=True)
class Groups:
    """Runs of equal keys in a sorted table: of each row its run and the run's first and last row."""

    of: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def by(cls, rows: pa.Table, keys: list[str]) -> Groups:
        n = rows.num_rows
        opens = np.zeros(n, bool)
        opens[0] = True
        for key in keys:
            column = rows[key]
            opens[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        of = np.cumsum(opens) - 1
        at = np.flatnonzero(opens)
        return cls(of, at[of], np.append(at[1:], n)[of] - 1)


def key_at(rows: pa.Table, keys: list[str], i: int) -> tuple:
    return tuple(rows[k][i].as_py() for k in keys)


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column
    inclusive: bool = True
    backward: bool = False


def running_sum(value, inclusive: bool = True) -> Scan:
    return Scan("sum", value, inclusive)


def running_max(value, inclusive: bool = True) -> Scan:
    return Scan("max", value, inclusive)


def latest(value, inclusive: bool = True) -> Scan:
    """Last non-null value up to this row (``inclusive=False``: before this row)."""
    return Scan("last", value, inclusive)


def upcoming(value, inclusive: bool = True) -> Scan:
    """First non-null value from this row on (``inclusive=False``: after this row)."""
    return Scan("last", value, inclusive, backward=True)


def _scanned(scan: Scan, values: pa.Array, of: np.ndarray) -> pa.Array:
    """The scan along runs ``of`` equal numbers; ``values`` in the scan's direction."""
    n = len(values)
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    first = np.repeat(begin, np.diff(np.append(begin, n)))
    if scan.kind == "sum":
        plain = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
        if plain.dtype.kind == "i":
            total = np.cumsum(plain)
            total = total - (total - plain)[first]
        else:
            total = pd.Series(plain).groupby(of).cumsum().to_numpy()
        return pa.array(total if scan.inclusive else total - plain)
    valid = pc.is_valid(values).to_numpy(zero_copy_only=False)
    place = np.arange(n)
    if scan.kind == "max":
        order = pc.sort_indices(values, null_placement="at_start").to_numpy().astype(np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = place
        best = np.maximum.accumulate(np.where(valid, rank, -1) + of * (n + 1)) - of * (n + 1)
        source = np.where(best >= 0, order[best], -1)
    else:
        source = np.maximum.accumulate(np.where(valid, place, -1))
        source = np.where(source >= first, source, -1)
    if not scan.inclusive:
        source = np.where(place > first, np.append(-1, source[:-1]), -1)
    return values.take(pa.array(np.maximum(source, 0), mask=source < 0))


class Ordered:
    """A table to be read along (keys, order). ``order`` must be unique within a key wherever a scan
    value is not null; keys must not be null."""

    def __init__(self, frame: DataFrame, keys: list[str], order: list[str], is_cut: bool, in_order: bool = False):
        self.frame = frame
        self.in_order = in_order
        self.keys = keys
        self.order = order
        self.is_cut = is_cut

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], order: list[str]) -> Ordered:
        frame, is_cut = cut(df, keys, order)
        return cls(frame, keys, order, is_cut)

    def with_columns(self, **columns: Column) -> Ordered:
        return Ordered(self.frame.withColumns(columns), self.keys, self.order, self.is_cut, self.in_order)

    def scan(self, **scans: Scan) -> Ordered:
        keys = self.keys
        staged = self.frame.withColumns({f"_v_{name}": s.value for name, s in scans.items()})
        sums = {f"_v_{name}" for name, s in scans.items() if s.kind == "sum"}
        whole_numbers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        staged = staged.withColumns(
            {c: F.col(c).cast("long" if isinstance(staged.schema[c].dataType, whole_numbers) else "double") for c in sums}
        )
        plain = {name: replace(s, value=None) for name, s in scans.items()}  # a Column cannot go to the workers
        kept = [c for c in self.frame.columns if c not in scans]
        schema = T.StructType(
            [staged.schema[c] for c in kept] + [T.StructField(name, staged.schema[f"_v_{name}"].dataType) for name in plain]
        )

        def along(rows: pa.Table, name: str, scan: Scan, reached: object, of: np.ndarray) -> pa.Array:
            """The scan with what reaches the first run it meets as a row before it; that row's result comes first."""
            column = rows[f"_v_{name}"].combine_chunks()
            column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
            if scan.backward:
                column, of = _reversed(column), of[-1] - of[::-1]
            column = pa.concat_arrays([pa.array([reached], column.type), column])
            return _scanned(scan, column, np.append(of[0], of))

        def summarise(rows: pa.Table) -> object:
            runs = Groups.by(rows, keys)
            n = rows.num_rows
            # What a run has for the partition after it (before it, for a backward scan).
            left = {}
            for name, scan in plain.items():
                a, b = (0, int(runs.last[0]) + 1) if scan.backward else (int(runs.first[-1]), n)
                edge = rows.slice(a, b - a)
                of = np.zeros(b - a, np.int64)
                left[name] = along(edge, name, replace(scan, inclusive=True), None, of)[-1].as_py()
            return key_at(rows, keys, 0), key_at(rows, keys, n - 1), left

        def compose(states: list[object]) -> list[object]:
            reached: list[dict] = [{} for _ in states]
            for name, scan in plain.items():
                at, key, carry = range(len(states)), None, None
                for i in reversed(at) if scan.backward else at:
                    first, last, left = states[i]
                    enters, leaves = (last, first) if scan.backward else (first, last)
                    carry = carry if enters == key else None
                    reached[i][name] = carry
                    carry = _joined(scan, carry if enters == leaves else None, left[name])
                    key = leaves
            return reached

        def apply(rows: pa.Table, reached: dict) -> pa.Table:
            of = Groups.by(rows, keys).of
            found = []
            for name, scan in plain.items():
                result = along(rows, name, scan, reached[name], of).slice(1)
                found.append(_reversed(result) if scan.backward else result)
            return pa.Table.from_arrays([*[rows[c] for c in kept], *found], names=[*kept, *plain])

        # A second scan finds the rows as the first one left them; the join that tells entries keeps their order.
        order = None if self.in_order else self.order
        done = folded(staged, self.is_cut, keys, order, summarise, compose, apply, schema)
        return Ordered(done, keys, self.order, self.is_cut, True)

    def rows(self) -> DataFrame:
        return self.frame.drop(CHUNK, FIRST)


def _reversed(values: pa.Array) -> pa.Array:
    return values.take(pa.array(np.arange(len(values) - 1, -1, -1)))


def _joined(scan: Scan, carry: object, left: object) -> object:
    if scan.kind == "sum":
        return (carry or 0) + (left or 0)
    if carry is None or left is None:
        return left if carry is None else carry
    return max(carry, left) if scan.kind == "max" else left


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str, first: int = 0):
    """Exact dense numbering per key in the given (unique) order."""
    numbered = Ordered.of(df, keys, order).scan(**{name: running_sum(F.lit(1).cast("long"))})
    return numbered.rows().withColumn(name, F.col(name) - 1 + first)


def neighbours(
    df: DataFrame,
    keys: list[str],
    ordinal: str,
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
) -> DataFrame:
    """Values of the row before and the row after along ``ordinal``, whatever numbers are missing.

    The row beyond a partition's edge reaches it from the next partition that holds rows of the key.
    """
    scans = {}
    for values, scan in ((before or {}, latest), (after or {}, upcoming)):
        scans |= {name: scan(F.struct(value.alias("v")), inclusive=False) for name, value in values.items()}
    near = Ordered.of(df, keys, [ordinal]).scan(**scans).rows()
    return near.withColumns({name: F.col(f"{name}.v") for name in scans})


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: Column,
    right_time: Column,
    take: dict[str, Column],
    tie: Column | None = None,
    forward: bool = False,
    strict: bool = False,
) -> DataFrame:
    """For each left row the last right row at or before its time (``forward``: the first right
    row at or after it; ``strict``: not at the same time). Among equal right times the highest
    ``tie`` wins backward and the lowest forward. Every left row is kept; without a match the
    taken columns are null."""
    right_side, left_side = (1, 0) if forward != strict else (0, 1)
    found = F.struct(*[value.alias(name) for name, value in take.items()])
    rows_right = right.select(
        *keys,
        right_time.cast("double").alias("_time"),
        F.lit(right_side).alias("_side"),
        (tie if tie is not None else F.lit(0)).cast("long").alias("_tie"),
        found.alias("_found"),
    )
    rows_left = left.select(
        *keys,
        left_time.cast("double").alias("_time"),
        F.lit(left_side).alias("_side"),
        F.lit(0).cast("long").alias("_tie"),
        F.struct(*left.columns).alias("_left"),
    )
    both = rows_left.unionByName(rows_right, allowMissingColumns=True)
    scanned = Ordered.of(both, keys, ["_time", "_side", "_tie"]).scan(
        _found=upcoming(F.col("_found")) if forward else latest(F.col("_found"))
    )
    return (
        scanned.rows()
        .filter(F.col("_left").isNotNull())
        .select("_left.*", *[F.col(f"_found.{name}").alias(name) for name in take])
    )


def around(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: Column,
    right_time: Column,
    take: dict[str, Column],
    tie: Column | None = None,
) -> DataFrame:
    """Each left row with ``_prev`` (last right row at or before it) and ``_next`` (first one after
    it) in one pass."""
    rows_right = right.select(
        *keys,
        right_time.cast("double").alias("_time"),
        F.lit(0).alias("_side"),
        (tie if tie is not None else F.lit(0)).cast("long").alias("_tie"),
        F.struct(*[value.alias(name) for name, value in take.items()]).alias("_found"),
    )
    rows_left = left.select(
        *keys,
        left_time.cast("double").alias("_time"),
        F.lit(1).alias("_side"),
        F.lit(0).cast("long").alias("_tie"),
        F.struct(*left.columns).alias("_left"),
    )
    both = rows_left.unionByName(rows_right, allowMissingColumns=True)
    return (
        Ordered.of(both, keys, ["_time", "_side", "_tie"])
        .scan(_prev=latest(F.col("_found")), _next=upcoming(F.col("_found")))
        .rows()
        .filter(F.col("_left").isNotNull())
        .select("_left.*", "_prev", "_next")
    )


def joined_text(
    df: DataFrame, keys: list[str], order: list[str], text: Column, separator: str
) -> DataFrame:
    """Ordered concatenation as one row (keys, text) per document, however long it is; null pieces are empty."""
    line = F.struct(F.struct(*order).alias("p"), F.coalesce(text, F.lit("")).alias("s"))
    pieces = F.array_sort(F.collect_list(line))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda x: x["s"]), separator).alias("text"))


def replayed(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    start: Callable[[], Callable[..., list[tuple]]],
    schema: str,
    at_end: bool = False,
) -> DataFrame:
    """Each group's rows in ``order``, one after the other through what ``start()`` returns: a function of a row's
    values without the keys, which keeps the group's state and gives result rows without the keys.

    Groups are streamed, so a group may be of any size; a task holds one batch and one state. ``at_end``: the function
    is called once more without values after the last row of a group.
    """
    kept = [c for c in df.columns if c not in keys]
    names = [part.strip().split(" ", 1)[0] for part in schema.split(",")]
    arranged = df.select(*keys, *kept).repartition(*keys).sortWithinPartitions(*keys, *order)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, take = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                key = row[: len(keys)]
                if key != group:
                    if take and at_end:
                        out += [group + r for r in take()]
                    group, take = key, start()
                out += [key + r for r in take(*row[len(keys) :])]
            yield pd.DataFrame(out, columns=names)
        if take and at_end:
            yield pd.DataFrame([group + r for r in take()], columns=names)

    return arranged.mapInPandas(stream, schema)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
