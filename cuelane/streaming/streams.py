"""The same jobs on streams: counters, pause sessions, pending segments.

Windows and sessions are appended once, when the watermark has passed them, and leave the state then. Rows go into a
table, one folder per batch id, so that a batch that runs again after a failure replaces its own rows. A stream is
closed by marks: rows of a second source whose time lies behind all windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Time of a closing mark, behind every event.
CLOSING = "9000-01-01 00:00:00"


def qc_counters(attempts: DataFrame, late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """Counts per recording and window of event time, each attempt (media_id, stem, attempt) once; later than the watermark is dropped."""
    once = attempts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["media_id", "stem", "attempt"])
    return once.groupBy(F.window("ts", window).alias("w"), "media_id").agg(F.count("*").alias("total"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed")).select("media_id", F.col("w.start").alias("from"), "total", "successful", "failed")


def pause_sessions(words: DataFrame, late: str = "1 day", max_pause_ms: int = 300) -> DataFrame:
    """Words (media_id, ts, duration_ms) as sessions that end after a pause over max_pause_ms; a gap of just that length does not end one."""
    gap = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, (duration_ms + {max_pause_ms}) / 1000.0)")
    return words.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "media_id").agg(F.count("*").alias("n_words"), F.max(F.unix_millis("ts") + F.col("duration_ms")).alias("end_ms")).select("media_id", F.unix_millis("s.start").alias("start_ms"), "end_ms", "n_words")


def _marks(spark: SparkSession, folder: str, times: list[str]) -> None:
    spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/marks")


def run_once(events: DataFrame, job: Callable[[DataFrame], DataFrame], folder: str, close: bool = False) -> DataFrame:
    """Runs job over the events (a stream with event time ts) that are there now and appends what the watermark has closed
    to `folder`/rows; gives the whole table. A later call with the same folder goes on where this one stopped, also after
    a failure. With `close` a mark then ends all windows and sessions that are still open; rows that come later are late.

    Nothing goes through the driver. State holds what is younger than the watermark, whatever the length of the stream.
    Where input comes in several batches, the job's lateness has to cover the disorder between them.
    """
    spark = events.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/marks")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        _marks(spark, folder, [])
    marks = spark.readStream.schema(T.StructType([T.StructField("ts", T.TimestampType())])).parquet(f"{folder}/marks")
    out = job(events.unionByName(marks, allowMissingColumns=True))

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    def drain() -> None:
        out.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()

    drain()
    if close:
        _marks(spark, folder, [CLOSING])
        drain()
    return appended(spark, folder, out.schema)


def appended(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows that run_once has stored."""
    return spark.read.schema(schema).parquet(f"{folder}/rows/batch=*")


def stream_pending(segments: DataFrame, done_path: str, checkpoint: str, translate) -> None:
    """Newly arrived segments that are not in the done table are handled once: translate maps rows to rows, results are
    appended keyed by (media_id, seg_idx); after a restart the checkpoint and the anti join skip what is done."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        try:
            have = spark.read.parquet(done_path).select("media_id", "seg_idx")
        except Exception as e:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            have = df.select("media_id", "seg_idx").limit(0)
        translate(df.dropDuplicates(["media_id", "seg_idx"]).join(have, ["media_id", "seg_idx"], "left_anti")).write.mode("append").parquet(done_path)

    segments.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
