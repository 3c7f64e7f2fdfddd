"""What the Python workers share: small batches, and state that lives as long as a worker."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows in an Arrow batch of texts, where the session does not say: 10,000 long texts would fill an executor.
ARROW_ROWS = 1_000
#: Bytes of text that a task takes up at a time; one longer text is a batch of its own.
BATCH = 2_000_000


def with_texts(docs: DataFrame) -> DataFrame:
    """``docs``, whose session moves texts to Python in smaller Arrow batches from now on, unless it has a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if docs.sparkSession.conf.get(name, None) in (None, "10000"):
        docs.sparkSession.conf.set(name, str(ARROW_ROWS))
    return docs


def kept(key: tuple, make: Callable[[], object]) -> object:
    """The object made for ``key`` in this process; it must be a bounded cache, for it stays until the worker ends.

    Functions travel to the workers by value and bring new globals each time, hence the module of its own. Only the
    latest object of a kind (the first part of the key) is kept.
    """
    store = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    kind, rest = key[0], key[1:]
    found = store.__dict__.get(kind)
    if found is None or found[0] != rest:
        found = store.__dict__[kind] = (rest, make())
    return found[1]


def small(batches: Iterator[pa.RecordBatch], column: int, limit: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes in a string column, so few texts are Python objects at once."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, k = np.cumsum(sizes, dtype=np.int64), 0
        while k < len(ends):
            done = ends[k - 1] if k else 0
            j = max(k + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(k, j - k)
            k = j


class Remembered:
    """A map of bounded size in two generations: what the younger one lacks may come back from the older one."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that are not known; all others are in ``young`` afterwards, where they stay until the next call."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        new, old = keys.difference(self.young), self.old
        back = {k: old[k] for k in new if k in old}
        self.young |= back
        return new.difference(back)
