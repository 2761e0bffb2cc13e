"""Incremental ingestion: resumable, idempotent landing of per-shot detections, and running states over a stream."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstat.sources.files import exists


def pending(shots: DataFrame, done: DataFrame) -> DataFrame:
    """Usable shots that are not landed yet."""
    return shots.where("usable").join(done.select("shot").distinct(), "shot", "left_anti")


def land_shots(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Lands each row once, in the target's partitions shot=<n>/batch=<k>.

    A batch that is replayed after a crash overwrites the partitions it had written (dynamic overwrite), so nothing is
    ever doubled; rows that earlier batches landed are left out, further rows of the same shot are added.
    """

    def land(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates()
        if exists(batch.sparkSession, f"{target}/rows"):
            columns = batch.columns
            seen = batch.sparkSession.read.schema(f"{schema}, batch long").parquet(f"{target}/rows").where(F.col("batch") < number)
            seen = seen.join(batch.select("shot").distinct(), "shot", "left_semi").select(*[F.col(c).alias(f"_{c}") for c in columns])
            same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), columns, F.lit(True))
            rows = rows.join(seen, same, "left_anti")
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shot", "batch").parquet(f"{target}/rows")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per window and type, late rows up to the watermark included. `ts` may lack a zone: it is read as the session's."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def _runs(key: tuple, batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
    """Closes a run when another holder shows up; keeps the open run (holder, first, last, rows) as state."""
    pid, start, end, n = state.get if state.exists else (None, 0, 0, 0)
    out = []
    for rows in batches:
        for frame, holder in rows.sort_values("event_id")[["event_id", "event_type"]].itertuples(index=False, name=None):
            if holder == pid:
                end, n = frame, n + 1
                continue
            if pid is not None:
                out.append((key[0], pid, start, end, n))
            pid, start, end, n = holder, frame, frame, 1
    state.update((pid, start, end, n))
    yield pd.DataFrame(out, columns=["user_id", "pid", "start", "end", "n"])


def streaming_runs(events: DataFrame) -> DataFrame:
    """Holding runs of a stream of (user_id, event_id, event_type), in the order the rows arrive, emitted as they close."""
    return events.groupBy("user_id").applyInPandasWithState(_runs, "user_id long, pid string, start long, end long, n long", "pid string, start long, end long, n long", "append", "NoTimeout")
