"""Per-key state machines, run over a stream or, in order, over a table.

A processor has ``state`` (its schema), ``start`` (the first state) and ``step(state, row)``, which returns the next
state and the verdict columns of the row. ``over_table`` puts a key's rows in order within one partition and
folds over them with one state at a time, so a key's length costs no memory; ``over_stream`` keeps the state between
micro-batches in Spark's state store. Rows keep their types: a null key is a key of its own, and integers stay exact.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FixedWindow:
    """``limit`` hits pass in a window of ``length`` that starts with the first hit after the last one ended."""

    limit: int
    length: int
    state = "began long, hits long"
    verdict = "allowed boolean"
    start = (None, 0)

    def step(self, state, row):
        began, hits = state
        if began is None or row.at - began >= self.length:
            began, hits = row.at, 0
        return (began, hits + 1), (hits < self.limit,)


@dataclass(frozen=True)
class TokenBucket:
    """Tokens come back at ``rate`` per unit of time up to ``burst``; a row takes one or is refused."""

    rate: float
    burst: float | None = None
    state = "tokens double, at long"
    verdict = "allowed boolean"
    start = (None, 0)

    def step(self, state, row):
        burst = max(10.0, 2 * self.rate) if self.burst is None else self.burst
        tokens, at = state
        tokens = burst if tokens is None else min(burst, tokens + max(0, row.at - at) * self.rate)
        ok = tokens >= 1
        return (tokens - 1 if ok else tokens, row.at), (ok,)


@dataclass(frozen=True)
class LogApply:
    """Ordered log pushes (epoch, gen, salt, pos, size): append in place, restart from 0, or refuse with the place expected.

    A boolean column ``known`` says whether a key's log has been opened here; without it all have. A push to
    another key is refused.
    """

    state = "epoch long, gen long, salt long, next long, torn boolean"
    verdict = "outcome string, expected long"
    start = (None, None, None, 0, False)

    def step(self, state, row):
        epoch, gen, salt, following, torn = state
        if epoch is None and not getattr(row, "known", True):
            return state, ("unknown_shard", 0)
        if epoch is not None and row.epoch < epoch:
            return state, ("stale_epoch", 0)
        another = epoch is None or row.epoch > epoch or row.salt != salt
        if not another and row.gen < gen:
            return state, ("stale_gen", 0)
        if another or row.gen > gen:
            if row.pos:
                return state, ("mismatch", 0)
            return (row.epoch, row.gen, row.salt, row.size, True), ("reset", row.size)
        if row.pos == following:
            return (epoch, gen, salt, following + row.size, torn), ("append", following + row.size)
        return state, ("mismatch", following)


@dataclass(frozen=True)
class Quorum:
    """Distinct acknowledgements of a write by ``n`` nodes: reached at ``q``, impossible once fewer than q can still come.

    A node that refused has refused, whatever it says later.
    """

    n: int
    q: int
    state = "acked array<string>, refused array<string>"
    verdict = "outcome string"
    start = ((), ())

    def __post_init__(self):
        if not 1 <= self.q < self.n:
            raise ValueError("1 <= q < n")

    def step(self, state, row):
        acked, refused = set(state[0]), set(state[1])
        (acked if row.ok else refused).add(row.node)
        outcome = "reached" if len(acked) >= self.q else "impossible" if self.n - len(refused) < self.q else "pending"
        return (sorted(acked), sorted(refused)), (outcome,)


@dataclass(frozen=True)
class Transactions:
    """Statements between explicit markers: a row's transaction number, and whether it takes effect by itself."""

    state = "number long, open boolean"
    verdict = "txn long, autocommit boolean"
    start = (0, False)

    def step(self, state, row):
        number, is_open = state
        if row.kind == "begin":
            return (number + 1, True), (number + 1, False)
        if row.kind in ("commit", "rollback"):
            return (number, False), (number, False)
        if is_open:
            return state, (number, False)
        return (number + 1, False), (number + 1, True)


def _fields(schema: str) -> list[str]:
    return [f.name for f in T._parse_datatype_string(schema).fields]


def _joined(df: DataFrame, verdict: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(verdict).fields])


def _same(a: object, b: object) -> bool:
    return a == b or (a != a and b != b)  # NaN is a key too


def over_table(df: DataFrame, key: str, order: list[str], processor) -> DataFrame:
    """The rows with their verdicts; a key's rows are taken in the order given, which must be total."""
    verdict = T._parse_datatype_string(processor.verdict)
    names = [f.name for f in verdict.fields]
    kinds = {"boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    types = [kinds[f.dataType.simpleString()] for f in verdict.fields]
    columns = df.columns
    at = columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Row = namedtuple("Row", columns, rename=True)
        now, state = object(), None
        for batch in batches:
            verdicts = []
            for row in map(Row._make, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if not _same(row[at], now):
                    now, state = row[at], processor.start
                state, verdict = processor.step(state, row)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([v[i] for v in verdicts], t) for i, t in enumerate(types))], names=[*columns, *names])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, _joined(df, processor.verdict))


def over_stream(df: DataFrame, key: str, order: list[str], processor) -> DataFrame:
    """The same over a stream; rows are put in order within a micro-batch."""
    names = _fields(processor.verdict)
    # integers pass as text, since pandas turns a column with a null into floats
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    text = df.select(*(F.col(c).cast("string").alias(c) if c in whole else F.col(c) for c in df.columns))

    def run(_, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else processor.start
        rows = pd.concat(list(parts), ignore_index=True)
        for c in whole:
            rows[c] = pd.Series([None if x is None or x != x else int(x) for x in rows[c]], dtype=object)
        rows = rows.sort_values(order)
        verdicts = []
        for row in rows.itertuples(index=False):
            state, verdict = processor.step(state, row)
            verdicts.append(verdict)
        held.update(tuple(state))
        for c in whole:
            rows[c] = [None if x is None else str(x) for x in rows[c]]
        yield rows.assign(**{n: [v[i] for v in verdicts] for i, n in enumerate(names)})

    found = text.groupBy(key).applyInPandasWithState(run, _joined(text, processor.verdict), processor.state, "append", "NoTimeout")
    return found.select(*(F.col(c).cast(df.schema[c].dataType).alias(c) if c in whole else F.col(c) for c in found.columns))
