"""Structured Streaming jobs over the batch operators.

Sinks write each micro-batch below its own ``batch=<id>`` folder, replacing it when the
batch is delivered again, so a restarted job leaves every row exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from govgraph.operators.executions import HEAD_KEY, LEASE_SECONDS, moved_heads
from govgraph.operators.ingest import quarantine, split_quarantine
from govgraph.operators.verification import verification_runs
from govgraph.session import stored
from govgraph.sources.files import PACK
from govgraph.streaming.segments import active, lookup, merge, newest, segments, write_segment
from govgraph.streaming.state import LEASE_OUTPUT, LeaseProcessor, first_deliveries, use_rocksdb

# How long an execution is remembered after its last change.
KEEP_SECONDS = 30 * 24 * 3600
# How many buckets leases are dealt into: a batch pays for each bucket it touches and for the leases in it.
LEASE_BUCKETS = 512


def object_stream(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Arriving files as object rows, without reading their content."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _arrivals(reader.schema(schema).load(path))


def packed_object_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The objects of arriving packs as the same rows; a pack's column of contents is not read."""
    return _arrivals(table_stream(spark, path, PACK, files_per_batch))


def _arrivals(objects: DataFrame) -> DataFrame:
    return objects.select("path", "modificationTime", F.col("length").alias("size_bytes"))


def table_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """Rows appended to a Parquet folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_batches(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """All rows a batch sink holds; with a schema also when it is still empty."""
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
    except Exception as error:
        if schema is None or "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def stream_objects(objects: DataFrame, queue: str, rejected: str, checkpoint: str, max_bytes: int | None = None) -> StreamingQuery:
    """Route arriving objects to a queue table and a quarantine table; ``max_bytes`` bounds them where given."""

    def work(batch: DataFrame, number: int) -> None:
        queued, quarantined = split_quarantine(quarantine(batch, max_bytes))
        _write_batch(queued, queue, number)
        _write_batch(quarantined, rejected, number)

    return _start(objects, work, checkpoint)


def dedup_within(stream: DataFrame, key: list[str], event_time: str, ttl: str) -> DataFrame:
    """Drop repeated keys within a time bound; state older than the bound is freed."""
    return stream.withWatermark(event_time, ttl).dropDuplicatesWithinWatermark(key)


def stream_executions(
    deliveries: DataFrame, executed: str, key: list[str], order: str, checkpoint: str, completed: DataFrame | None = None
) -> StreamingQuery:
    """Keep the first delivery of every key ever, however late a repeat comes.

    Which keys were delivered is keyed state; ``completed`` has keys from before the stream. A batch reads its own rows only.
    """
    fresh = first_deliveries(deliveries, key, order, completed)
    return _start(fresh, lambda batch, number: _write_batch(batch, executed, number), checkpoint)


def _head_schema(observations: DataFrame) -> StructType:
    fields = [observations.schema[c] for c in HEAD_KEY] + [f for f in observations.schema.fields if f.name not in HEAD_KEY]
    return StructType(fields).add("previous_sha256", "string").add("content_changed", "boolean")


def stream_heads(observations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the profile heads as a log of segments.

    A batch looks up the heads of its own sources, and writes those that it moves; segments are merged as they
    get many. Batch n is made from what batches before n left and its own rows, so repeating it gives the same.
    """
    schema = _head_schema(observations)

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merge(spark, path, schema, HEAD_KEY, number)
        rows = stored(batch, "observations")
        heads = lookup(spark, path, schema, rows.select(*HEAD_KEY).distinct(), number)
        write_segment(moved_heads(heads, rows).select(*schema.names), path, number, number, HEAD_KEY)

    return _start(observations, work, checkpoint)


def latest_heads(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The heads after the last batch; ``schema`` is that of the observations."""
    wide = _head_schema(spark.createDataFrame([], schema))
    return newest(spark, path, wide, HEAD_KEY, active(segments(spark, path)))


def stream_verification(
    proposals: DataFrame, outcomes: DataFrame, runs: str, evaluated_at: str, checkpoint: str
) -> StreamingQuery:
    """Verify newly created pending proposals once; a run is never overwritten."""

    def work(batch: DataFrame, number: int) -> None:
        # The state behind the batch is advanced once, whatever the plan reads how often.
        _write_batch(verification_runs(stored(batch, "pending"), outcomes, evaluated_at), runs, number)

    pending = proposals.filter("status = 'PENDING_VERIFICATION'")
    return _start(first_deliveries(pending, ["tenant_id", "proposal_id"]), work, checkpoint)


def lease_stream(
    events: DataFrame,
    delay: str = "10 minutes",
    lease_seconds: int = LEASE_SECONDS,
    keep_seconds: int = KEEP_SECONDS,
    buckets: int = LEASE_BUCKETS,
) -> DataFrame:
    """Claim, completion and failure events to what each of them did, and leases that ran out.

    ``events`` has ``execution_id, seq, kind`` (CLAIM, COMPLETED or FAILED) and ``at``. Events later than
    ``delay`` behind the newest are dropped. When the watermark passes the end of a lease, a row LEASE_OVER says so
    without any event; ``keep_seconds`` after an execution's last change its state is freed. Executions are dealt into ``buckets``; a batch
    reads and writes the buckets of its own executions.
    """
    use_rocksdb(events)
    dealt = events.withColumn("bucket", F.pmod(F.xxhash64("execution_id"), F.lit(buckets)).cast("int"))
    return dealt.withWatermark("at", delay).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=LeaseProcessor(lease_seconds, keep_seconds),
        outputStructType=LEASE_OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
    )


def stream_leases(events: DataFrame, path: str, checkpoint: str, **bounds) -> StreamingQuery:
    writer = lease_stream(events, **bounds).writeStream.format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
