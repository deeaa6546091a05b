"""Running totals along a global order: ranges in parallel, one carried row per range."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.session import stage_once


def _changes(batch: pa.RecordBatch, group: Sequence[str], last: list | None) -> np.ndarray:
    """Whether a row belongs to another group than the row before; NULL equals NULL."""
    out = np.zeros(batch.num_rows, dtype=bool)
    for at, name in enumerate(group):
        column = batch.column(name)
        if len(column) > 1:
            a, b = column.slice(1), column.slice(0, len(column) - 1)
            differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
            out[1:] |= differs.to_numpy(zero_copy_only=False)
        if last is not None:
            out[0] |= column[0].as_py() != last[at]
    out[0] |= last is None
    return out


def running(
    df: DataFrame, group: Sequence[str], order: Sequence[str], carry: Sequence[str],
    sums: Mapping[str, str] | None = None, xors: Mapping[str, str] | None = None,
) -> DataFrame:
    """Totals of every row and the rows before it in its group, ``order`` ascending with NULL first.

    ``sums`` and ``xors`` name a new column and the non-null BIGINT column it adds (or XORs) up; ``group`` must be
    part of ``carry``, the columns kept. Rows are dealt out by ranges of (group, order), so neither a group with most
    rows nor rows without a group (``group=[]``) meet in one task; equal rows are spread as well, in an order of their
    own. A range holds running totals; only its first group can go on from the range before, so one row per range is
    carried over: as many rows as shuffle partitions, however large the table.
    """
    sums, xors = dict(sums or {}), dict(xors or {})
    made = [*sums, *xors]
    sources = list(dict.fromkeys([*sums.values(), *xors.values()]))
    held = [*carry, *[s for s in sources if s not in carry]]
    keys = [*group, *order, "_tie"]
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).select(*held)
    schema = T.StructType(
        [placed.schema[c] for c in carry] + [T.StructField(m, T.LongType()) for m in made]
        + [T.StructField("_range", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_head", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, row, last, head = TaskContext.get().partitionId(), 0, None, True
        reached = {m: 0 for m in made}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _changes(batch, group, last)
            starts = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: still the group of the batch before
            columns = []
            for name in made:
                source = batch.column((sums | xors)[name]).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(source) if name in sums else np.bitwise_xor.accumulate(source)
                before = np.concatenate([[0], total])[np.maximum(starts, 0)]
                on = np.where(starts < 0, reached[name], 0)
                total = total - before + on if name in sums else total ^ before ^ on
                reached[name] = int(total[-1])
                columns.append(pa.array(total, pa.int64()))
            first = np.cumsum(new) == (1 if last is None else 0)
            heads, head = head & first, head and bool(first[-1])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carry], *columns, pa.array(np.full(n, here, np.int32)), pa.array(np.arange(row, row + n)), pa.array(heads)],
                names=schema.names,
            )
            row, last = row + n, [batch.column(g)[n - 1].as_py() for g in group]

    staged = stage_once(placed.mapInArrow(run, schema), "running")
    ends = staged.groupBy("_range").agg(
        F.min_by(F.struct(F.lit(0).alias("_"), *group), "_row").alias("first"), F.max_by(F.struct(F.lit(0).alias("_"), *group), "_row").alias("last"),
        F.max_by(F.struct(F.lit(0).alias("_"), *made), "_row").alias("reached"),
    ).orderBy("_range").collect()  # one row per range
    carried, open_, total = [], None, {m: 0 for m in made}
    for end in ends:
        goes_on = open_ is not None and end["first"] == open_
        start = dict(total) if goes_on else {m: 0 for m in made}
        if goes_on:
            carried.append((end["_range"], True, *[start[m] for m in made]))
        whole = end["first"] == end["last"]
        step = {m: end["reached"][m] for m in made}
        total = {m: (start[m] + step[m] if m in sums else start[m] ^ step[m]) if whole else step[m] for m in made}
        open_ = end["last"]
    before = df.sparkSession.createDataFrame(
        carried, T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_head", T.BooleanType()), *[T.StructField(f"_{m}", T.LongType()) for m in made]]),
    )
    add = lambda m: F.col(m) + F.coalesce(F.col(f"_{m}"), F.lit(0)) if m in sums else F.col(m).bitwiseXOR(F.coalesce(F.col(f"_{m}"), F.lit(0)))
    return staged.join(F.broadcast(before), ["_range", "_head"], "left").select(*carry, *[add(m).alias(m) for m in made])
