"""Mergeable bottom-k sketches: the k least rows of every group, without moving the others."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

#: Rows that a task reduces together, and shares among which a group's sketches are merged first.
HELD, SHARES = 200_000, 64


def bottom_k(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, place: str = "_place") -> DataFrame:
    """``keys, order`` of the ``k`` least rows of each group by ``order``, and their 1-based ``place``; NULL keys are a group.

    Each task keeps k rows of a group, these are merged in ``SHARES`` shares a group and then in one place: so a group
    costs at most ``SHARES`` * k rows there, however many rows or tasks hold it. Rows must differ in ``order``, or which of
    equal ones is left out is open.
    """
    names = [*keys, *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        share = (TaskContext.get().partitionId() if TaskContext.get() else 0) % SHARES

        def least() -> pa.Table:
            table = pa.Table.from_batches(held).combine_chunks().sort_by([(c, "ascending") for c in names])
            head = np.ones(len(table), bool)
            codes = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in keys]
            head[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            return table.filter(pa.array(np.arange(len(table)) - first < k))

        def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from table.append_column("_share", pa.repeat(pa.scalar(share, pa.int32()), len(table))).to_batches()

        for batch in batches:
            held.append(batch.select(names))
            size += len(batch)
            if size >= HELD:
                table = least()
                if len(table) > HELD // 2:  # many groups: nothing much to merge here
                    yield from told(table)
                    held, size = [], 0
                else:
                    held, size = table.to_batches(), len(table)
        if size:
            yield from told(least())

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    own = df.select(*names).mapInArrow(run, schema + ", _share int")
    merged = own.repartition(*keys, "_share").select(*names).mapInArrow(run, schema + ", _share int").select(*names)
    spot = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return merged.withColumn(place, spot).where(F.col(place) <= k)
