"""Extension: the latest state of a log that grows, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from palimpsest.operators.resolve import VALUE, newest


def read_commits(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """New commit files of a log as a stream of versions."""
    return spark.readStream.schema(schema).parquet(path)


def latest(stream: DataFrame) -> DataFrame:
    """Newest version of each key, tombstones too: state is one row for each key; late versions lose by sequence."""
    top = stream.groupBy("k").agg(F.max(F.struct("seq", "op", "v")).alias("top"))
    return top.select("k", "top.seq", "top.op", "top.v")


def changes(stream: DataFrame, time: str, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Changes and deletions in each window of event time, closed by a watermark."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width))
    return w.agg(F.count("*").alias("changes"), F.sum((F.col("op") != VALUE).cast("long")).alias("deletions"))


def publish(view: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """The view kept up to date in the driver's memory under a name: for tests and small views only; ``publish_files`` has no such limit."""
    return view.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_files(view: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What each batch changes in the view, as Parquet of its own folder; a batch that runs again replaces its folder."""

    def put(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/epoch={number}")

    return view.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The view that ``publish_files`` keeps: the newest row of each key over all batches."""
    return newest(spark.read.parquet(path).drop("epoch"))
