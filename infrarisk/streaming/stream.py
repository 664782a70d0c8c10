"""Structured Streaming versions of the batch jobs.

X1  continuous assessment: the rule / overlay / impact projections are stateless, so the batch
    ``assess`` function is applied unchanged to a stream.
X2  history append, exactly once per micro-batch: ``stream_history`` by the file sink's checkpointed commit log,
    ``commit_batches`` by replacing a batch's own folder, for sinks that do more than append.
X3  live labelling: ``stateful.live_labels``.  The stream-stream join here gives the (telemetry, incident) pairs
    themselves; ``labels_from_matches`` reduces them.
X4  trailing counts: ``stateful.live_counts`` is exact.  The sliding ``window(30 days, 1 day)`` here is the
    day-aligned aggregate of a dashboard.
X5  duplicate telemetry: ``dropDuplicatesWithinWatermark`` on (city, timestamp).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import normalize_system
from ..schema import SYSTEM_SYNONYMS, TARGET_COLUMNS
from ..sources.fixtures import VIEW_SQL


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """A file stream over the driver's ``events`` parquet (schema taken from the batch table)."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file source watches a folder or a glob; the glob also admits a single file
    glob = f"{sf_dir.rstrip('/')}/events*.parquet"
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(glob)
            .withColumn("ts", F.col("ts").cast("timestamp")))  # streaming event time must be TIMESTAMP


def replayed(spark: SparkSession, sf_dir: str, folder: str, slices: int = 4, rows_per_file: int = 250_000) -> DataFrame:
    """The given events as a folder of ``slices`` slices in order of time, and a last file of one ``close`` event, as a stream.

    Slices are cut at quantiles of time and written one after the other, as events would arrive, all in the same number of
    files, which is what a trigger takes; the closing event lies far behind the last one, so that the watermark passes everything.
    """
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(at, [k / slices for k in range(1, slices)], 10_000).alias("c"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).first()
    edges, files = [None, *(cuts["c"] or []), None], max(1, -(-cuts["n"] // (slices * rows_per_file)))
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        part = events if lo is None else events.where(at > lo)
        part = part if hi is None else part.where(at <= hi)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(folder)
        for _ in range(files * (k + 1) - len(spark.read.schema(events.schema).parquet(folder).inputFiles())):  # a part without rows has no file
            events.limit(0).coalesce(1).write.mode("append").parquet(folder)
    if cuts["last"] is not None:
        end = F.timestamp_micros(F.lit(cuts["last"] + 400 * 86_400_000_000)).cast(events.schema["ts"].dataType)
        spark.range(1).select(*[(end if c == "ts" else F.lit("close") if c == "event_type" else F.lit(None).cast(events.schema[c].dataType)).alias(c) for c in events.columns]).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def closing(events: DataFrame) -> DataFrame:
    """(at) of the ``close`` events."""
    return events.where("event_type = 'close'").select(F.col("ts").alias("at"))


def view_stream(events: DataFrame, name: str) -> DataFrame:
    """A fixture view over a stream of events."""
    return events.sparkSession.sql(VIEW_SQL[name], events=events)


def telemetry_stream(events: DataFrame) -> DataFrame:
    """The fixture telemetry view applied to a stream of events (same SQL; stateless)."""
    return events.sparkSession.sql(VIEW_SQL["telemetry"], events=events)


def incidents_stream(events: DataFrame) -> DataFrame:
    return events.sparkSession.sql(VIEW_SQL["incidents"], events=events)


def dedupe(telemetry: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """X5."""
    return telemetry.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["city", "timestamp"])


def live_label_matches(telemetry: DataFrame, incidents: DataFrame, horizon_hours: int = 72,
                       watermark: str = "1 hour") -> DataFrame:
    """(telemetry row, matching incident or null) pairs -- bounded state: each side is kept
    only until the other side's watermark passes the interval."""
    t = telemetry.withWatermark("timestamp", watermark).alias("t")
    i = (incidents.select(F.col("city").alias("i_city"), F.col("timestamp").alias("i_ts"),
                          normalize_system("system").alias("i_sys"))
         .withWatermark("i_ts", watermark))
    cond = F.expr(f"t.city = i_city AND i_ts >= t.timestamp AND i_ts <= t.timestamp + INTERVAL {horizon_hours} HOURS")
    return t.join(i, cond, "leftOuter")


def labels_from_matches(matches: DataFrame, id_col: str = "telemetry_id") -> DataFrame:
    """Reduce match rows to one labelled row per telemetry id (batch or per micro-batch)."""
    aggs = [F.max(F.when(F.col("i_ts").isNotNull(), 1).otherwise(0)).alias(TARGET_COLUMNS[0])]
    for t, names in SYSTEM_SYNONYMS.items():
        aggs.append(F.max(F.when(F.col("i_sys").isin(*names), 1).otherwise(0)).alias(t))
    return matches.groupBy(id_col).agg(*aggs)


def trailing_counts_stream(events: DataFrame, days: int = 30, slide: str = "1 day",
                           watermark: str = "1 day") -> DataFrame:
    """Per city and sliding day-aligned window, the number of events."""
    return (events.withWatermark("timestamp", watermark)
            .groupBy("city", F.window("timestamp", f"{days} days", slide))
            .agg(F.count(F.lit(1)).alias("n")))


def run_available_now(df: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet",
                      mode: str = "append") -> None:
    """Drive a stream to completion over everything available (file sink + checkpoint: exactly once)."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .option("path", out_path).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_history(assessed: DataFrame, path: str, checkpoint: str, request_cols: list[str],
                   response_cols: list[str], available_now: bool = True):
    """Append assessments to the history store exactly once per micro-batch.

    Ids are a hash of the row id, city and time, so a replayed batch rewrites the same ids; the file sink's
    commit log (under ``checkpoint``, on shared storage) makes each batch visible once.
    """
    from ..sources.io import to_history

    hist = to_history(assessed, request_cols, response_cols)
    w = (hist.writeStream.format("json").outputMode("append").partitionBy("date")
         .option("checkpointLocation", checkpoint).option("path", path))
    q = (w.trigger(availableNow=True) if available_now else w).start()
    if available_now:
        q.awaitTermination()
    return q


def commit_batches(df: DataFrame, path: str, checkpoint: str, name: str, after_write=None) -> None:
    """Runs the stream to its end; each micro-batch replaces ``path/query=<name>/batch=<id>``.

    A batch that was written but not committed to the checkpoint is replayed under its own id after a restart and
    overwrites what it had written, so no row is lost or doubled.  ``after_write(batch_id)`` runs between write and commit.
    """
    def commit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/query={name}/batch={batch_id}")
        if after_write is not None:
            after_write(batch_id)

    df.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
