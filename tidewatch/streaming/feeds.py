"""The incremental path: deduplicated ingestion, debounced recomputation, and monotonic cursors."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.tables import Table


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Parquet files of (event_id, ts, user_id, event_type, value) as a stream in event time."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, key: str = "event_id", delay: str = "2 days") -> DataFrame:
    """Each key (an id, or the fingerprint of an event) once within the watermark: a repeated job or file adds nothing."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def debounced(events: DataFrame, quiet: str = "3 seconds", delay: str = "10 minutes") -> DataFrame:
    """One row for each burst of events of a user that ends with a quiet time: what to recompute, and when."""
    return (
        events.withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", quiet))
        .agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
        .select("user_id", "n", F.col("session_window.start").alias("start"), "last_ts")
    )


def cursor_updates(events: DataFrame) -> DataFrame:
    """The cursor of each user, in update mode: the greatest event time so far, which never goes back, and how many
    events were seen. The state is one row a user and stays in the JVM."""
    return events.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("n_events"))


def into(table: Table, on: list[str], stream: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that adds each row once: a batch that comes again after a crash is known by its number, and
    rows that another batch or job has brought are known by their key ``on``."""
    return lambda batch, number: table.insert_absent(batch, on, (stream, number)) and None


def restarted(start: Callable[[], StreamingQuery], tries: int = 3, wait: float = 30.0) -> StreamingQuery:
    """Run a query that ends by itself; one that fails is started again from its checkpoint, ``tries`` times in all, after
    ``wait`` seconds and twice as long each further time."""
    for attempt in range(tries):
        query = start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            if attempt + 1 == tries:
                raise
            time.sleep(wait * 2**attempt)
    raise ValueError("tries must be 1 or more")


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there now into an in-memory table and return it (tests and small results)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
