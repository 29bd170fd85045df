"""Incremental ingestion as Structured Streaming.

A file stream's checkpoint replaces the reader's list of known keys; within a batch
and against the sink only new keys are appended, and a batch that is replayed writes
the same folder again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.threads import new_rows
from spanloom.sources.versioned import VersionedTable


def _batches(spark: SparkSession, sink: str) -> DataFrame | None:
    try:
        return spark.read.parquet(sink)
    except Exception as e:  # nothing has been written yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def append_new(sink: str, key: str, order_col: str, dead_letters: str | None = None, valid: str | None = None, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: rows with new keys go to ``sink/batch=N/bucket=H``, rows that are not valid to ``dead_letters/batch=N``.

    The bucket is the key's hash: a batch reads the known keys of its own buckets only, which are
    pruned as partitions. Take more buckets the smaller batches are beside the sink.
    """
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # the dead letters, the buckets and the rows that are written must be of one reading
        try:
            put(batch, number)
        finally:
            batch.unpersist()

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        good = batch.where(valid) if valid else batch
        if valid and dead_letters:
            batch.where(~F.coalesce(F.expr(valid), F.lit(False))).write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
        written = _batches(spark, sink)
        if written is None:
            known = spark.createDataFrame([], batch.select(key).schema)
        else:
            met = [r[0] for r in good.select(bucket).distinct().collect()]  # ``buckets`` numbers at most
            # A replayed batch must not see its own first attempt.
            known = written.where((F.col("batch") != number) & F.col("bucket").isin(met)).select(key)
        fresh = new_rows(good, known, key, order_col).withColumn("bucket", bucket)
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/batch={number}")

    return write


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str, order_col: str, form: str = "json", files_per_trigger: int = 100, every: str | None = None, **more) -> StreamingQuery:
    """Start ingestion of a folder; without ``every`` it stops when all that is there has been read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(form).load(source)
    writer = stream.writeStream.foreachBatch(append_new(sink, key, order_col, **more)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


#: The state store that keeps keys on the executors' disks, with changes in the checkpoint.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A keyed query's settings of its state: a batch's commit writes its changes only, not the store's files, and rows are
#: not counted, which would look each key up once more (so ``numRowsTotal`` of the progress says 0).
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def first_of_keys(stream: DataFrame, key: str, time_col: str | None = None, remember: str | None = None) -> DataFrame:
    """The rows of a stream whose key has not come before; null is a key.

    The keys are the stream's state: no batch reads the sink. With ``remember`` a key is forgotten when the event
    time ``time_col`` has moved on by that much, and rows that come later than that are left out; else keys are kept for good.
    Which of a key's rows in one batch is kept is left to Spark; a batch that is replayed gives the same keys.
    """
    if remember is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time_col, remember).dropDuplicatesWithinWatermark([key])


def start_keyed(rows: DataFrame, table: VersionedTable, name: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream with state to a versioned table, each batch once; the state is kept in RocksDB.

    Without ``every`` it stops when all that is there has been read. Stopped at any point and started again on its checkpoint, it goes on where the
    last whole batch ended: a batch that had been published is not published again.
    """
    conf = rows.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():  # a query takes the session's settings along when it starts
            conf.set(k, v)
        writer = rows.writeStream.foreachBatch(table.sink(name)).option("checkpointLocation", checkpoint).queryName(name)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        for k, v in before.items():
            if v is None:
                conf.unset(k)
            else:
                conf.set(k, v)


def counted(df: DataFrame, name: str, **counts: Column) -> DataFrame:
    """``df`` with counters that are filled while it is written, in one pass: of a batch by an ``Observation`` of
    that name, of a stream in its progress under ``observedMetrics``."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def progress(query: StreamingQuery) -> list[dict]:
    """Rows read by each batch so far."""
    reports = (p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress)
    return [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in reports]


def windowed_counts(events: DataFrame, ts_col: str, key_col: str, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Event counts by (tumbling or sliding) window and key; batch or stream, with a watermark for late rows."""
    w = F.window(ts_col, size, slide) if slide else F.window(ts_col, size)
    return events.withWatermark(ts_col, late).groupBy(w.alias("w"), key_col).agg(F.count("*").alias("n"))
