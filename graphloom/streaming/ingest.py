"""Incremental maintenance by micro-batches: file changes and edges arrive as streams and are merged into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def merge_edges(stream: DataFrame, path: str, checkpoint: str, key: tuple[str, ...] = ("sourceId", "targetId", "type")) -> StreamingQuery:
    """Appends edges to the store below path, the first of each key only. A batch that is run again after a failure gives the
    same store, because what is there is left out."""

    def put(batch: DataFrame, number: int) -> None:
        first = batch.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy("emit_ord"))).filter("__rn = 1").drop("__rn")
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            first = first.join(spark.read.schema(batch.schema).parquet(path).select(*key), list(key), "left_anti")
        first.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_per_window(changes: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """start, path, changes: changes of files (ts, path) in tumbling windows; rows later than the watermark are left out."""
    w = changes.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "path").agg(F.count("*").alias("changes"))
    return w.select(F.col("w.start").alias("start"), "path", "changes")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, events: bursts of activity."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")
