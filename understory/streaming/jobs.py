"""Incremental jobs with Structured Streaming.

Both run over a file source with ``availableNow``, keep their progress in a checkpoint in
the shared folder and write with executors, so nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from understory.session import new_path, written

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def file_stream(spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the files of a table, be it a folder of parts or a single file.

    A plain path has to be a folder, so the path is given as a pattern that fits just itself.
    """
    reader = spark.readStream.schema(schema)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = folder.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


START = datetime(1970, 1, 1)
MICRO = timedelta(microseconds=1)


def times_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key of a batch with all its times, so that few rows travel to the state; none is dropped."""
    for batch in batches:
        names = batch.schema.names
        grouped = pa.Table.from_batches([batch]).group_by(names[:1]).aggregate([(names[1], "list")])
        yield from grouped.select([names[0], f"{names[1]}_list"]).rename_columns(names).combine_chunks().to_batches()


class FirstSight(StatefulProcessor):
    """Per key: the first row in time comes out as new; rows behind the watermark come out as late and are no sighting.

    A row more than ``keep`` after the last sighting that came out is a new sighting again; where that is None, none is.
    A timer clears the state of a key once the watermark is past that. Times come in lists and go out one a row, as
    microseconds since 1970.
    """

    def __init__(self, key: str, ts: str, keep: timedelta | None) -> None:
        self.key, self.ts, self.keep = key, ts, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at timestamp")

    def handleInputRows(self, key, rows, timerValues):
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        state = self.seen.get()
        first, timeless, late = None, False, []
        for part in rows:
            for times in part[self.ts]:
                for at in times:
                    if at is None or at != at:
                        timeless = True
                    elif at < limit:
                        late.append(int(at))
                    elif state is None or (self.keep is not None and state[0] is not None and at > (state[0] - START + self.keep) // MICRO):
                        first = int(at) if first is None else min(first, int(at))
        new = first is not None or (timeless and state is None)
        if new:
            self.seen.update((None if first is None else START + first * MICRO,))
            if self.keep is not None and first is not None:
                self.handle.registerTimer((first + self.keep // MICRO) // 1000 + 1)
        if new or late:
            out = [*late, first] if new else late
            yield pd.DataFrame({self.key: pd.Series([key[0]] * len(out), dtype=object), self.ts: pd.array(out, "Int64"),
                                "late": [True] * len(late) + [False] * (len(out) - len(late))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self.seen.get()
        at = None if state is None else state[0]
        if at is not None and (at - START + self.keep) // MICRO < expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def new_items(stream: DataFrame, done: DataFrame, key: str, ts: str, delay: str, checkpoint: str | None = None,
              out: str | None = None, keep: timedelta | None = None) -> str:
    """Keys of arriving rows without an output yet, each once; returns the folder written (columns key, ``ts``, ``late``).

    ``delay`` only says which rows are late: they go to the part ``late=true`` of the folder, all of them, and do not count as
    a sighting. How long a key counts as seen is ``keep``, in event time and apart from ``delay``; for good without it. The
    state is keyed and kept with the checkpoint, so restarts give no key twice. A row without a time is never late.
    The keys of ``done`` are written once, for every batch reads them.
    """
    spark = stream.sparkSession
    out = out or new_path(spark, "new-items")
    marked = written(done.select(key).distinct(), "done-keys")
    packed = StructType([stream.schema[key], StructField(ts, ArrayType(LongType()))])
    # A computed time is no event time to the operator, which would drop late rows before the processor sees them.
    arriving = stream.select(key, ts).withWatermark(ts, delay).select(key, F.unix_micros(ts).alias(ts))
    fresh = arriving.mapInArrow(times_by_key, packed).join(marked, key, "left_anti")
    schema = StructType([stream.schema[key], StructField(ts, LongType()), StructField("late", BooleanType())])
    found = fresh.groupBy(key).transformWithStateInPandas(FirstSight(key, ts, keep), schema, "append", "EventTime").select(
        key, F.timestamp_micros(ts).alias(ts), "late")
    provider = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (found.writeStream.format("parquet").outputMode("append").option("path", out).partitionBy("late")
                 .option("checkpointLocation", checkpoint or new_path(spark, "checkpoint"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        if provider is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, provider)
    return out


def daily_sums(stream: DataFrame, key: str, ts: str, value: str, delay: str, checkpoint: str | None = None,
               out: str | None = None) -> str:
    """Running sum and count per key and day; each micro-batch writes the days it changed.

    A repeated batch overwrites its own folder, so the output is exactly once.
    """
    spark = stream.sparkSession
    out = out or new_path(spark, "daily-sums")
    sums = (stream.withWatermark(ts, delay).groupBy(key, F.window(ts, "1 day").alias("_day"))
            .agg(F.sum(value).alias("total"), F.count(value).alias("n"))
            .select(key, F.col("_day.start").alias("day"), "total", "n"))

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = (sums.writeStream.outputMode("update").foreachBatch(save)
             .option("checkpointLocation", checkpoint or new_path(spark, "checkpoint"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return out


def monthly_mean(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Monthly means from the newest state of every day."""
    days = (spark.read.parquet(folder).groupBy(key, "day")
            .agg(F.max_by(F.struct("total", "n"), "epoch").alias("s")))
    month = F.date_trunc("month", "day")
    return (days.groupBy(key, F.year(month).alias("year"), F.month(month).alias("month"))
            .agg((F.sum("s.total") / F.sum("s.n")).alias("mean"), F.sum("s.n").alias("n")))
