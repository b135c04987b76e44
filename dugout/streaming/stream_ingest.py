"""Streaming ingest of landed raw files into the table store."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dugout.operators.clean import PITCH_KEY
from dugout.plans import ingest
from dugout.sources.store import TableStore


#: Keys of a horizon's rows lie in files, not in the executors' heap, which some 300 bytes each would fill.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def state_in_files(spark: SparkSession) -> Iterator[None]:
    """Streams that start within the block keep their state in files; settings that the session names itself stay."""
    unset = [name for name in STATE if spark.conf.get(name, None) is None]
    for name in unset:
        spark.conf.set(name, STATE[name])
    try:
        yield
    finally:
        for name in unset:
            spark.conf.unset(name)


def landed_stream(
    spark: SparkSession, path: str, schema: T.StructType, *, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """New files of a landing folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def without_repeats(stream: DataFrame, horizon: str) -> DataFrame:
    """A stream of raw rows without those that came before, unchanged, within the horizon.

    Time is that of arrival, so no row is ever too late; a row of an old
    game passes like any other, and so does one that corrects an earlier delivery.
    The state holds a hash of each row for as long as the horizon, ``state_in_files``.
    """
    columns = stream.columns
    marked = stream.withColumns({"_print": F.xxhash64(*(F.col(f"`{c}`") for c in columns)), "_arrived": F.current_timestamp()})
    keys = [c for c in PITCH_KEY if c in columns]
    return marked.withWatermark("_arrived", horizon).dropDuplicatesWithinWatermark([*keys, "_print"]).select(*(F.col(f"`{c}`") for c in columns))


def stream_ingest(
    store: TableStore, stream: DataFrame, checkpoint: str, *, available_now: bool = True, refresh: bool = True, horizon: str | None = "2 days"
) -> StreamingQuery:
    """Start loading a stream of raw rows.

    Repeats within the horizon are dropped before anything is rewritten.  The rest
    is upserted by key, so late rows are never lost, copies that come after the horizon meet in the
    table, and a batch that is replayed after a failure changes nothing.  Tallies
    of the partitions that a batch touches are counted again within the batch, so summaries follow the
    pitches even across restarts; use a store partitioned by week to keep that small.
    """

    def load_batch(batch: DataFrame, batch_id: int) -> None:
        loaded = ingest.load(store, batch)
        if refresh and loaded.partitions:
            store.retally(loaded.partitions)
        store.unstage(loaded)

    fresh = without_repeats(stream, horizon) if horizon else stream
    writer = fresh.writeStream.option("checkpointLocation", checkpoint).foreachBatch(load_batch)
    with state_in_files(store.spark):
        return (writer.trigger(availableNow=True) if available_now else writer).start()
