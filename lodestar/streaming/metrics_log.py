"""Append-only logs as streams: training metrics whose keys carry the run's name, and resumable work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "value string"


def _long(lines: DataFrame, run_id: str) -> DataFrame:
    m = F.from_json("value", "map<string,string>")
    x = lines.select(m.alias("m")).select(F.try_element_at("m", F.lit("step")).cast("long").alias("step"), F.try_element_at("m", F.lit("epoch")).cast("double").alias("epoch"), F.explode("m").alias("k", "v"))
    metric = F.when(F.startswith("k", F.lit(run_id + "_")), F.substring("k", len(run_id) + 2, 10_000)).otherwise(F.col("k"))
    return x.filter("k NOT IN ('step', 'epoch')").select("step", "epoch", metric.alias("metric"), F.col("v").cast("double").alias("value"))


def read_metrics(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """step, epoch, metric, value from JSON lines; the run's prefix is cut from the keys."""
    return _long(spark.read.text(path), run_id)


def stream_metrics(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """read_metrics as a stream: new files in the folder are taken as they come."""
    return _long(spark.readStream.schema(SCHEMA).text(path), run_id)


def append_new(stream: DataFrame, id_col: str, out: str, checkpoint: str):
    """Starts a stream that appends rows with new ids to `out` as JSON, each id once over restarts.

    Every batch is held against the ids that are there, so no state grows with the log, and a batch that is tried again adds nothing.
    """
    schema = stream.schema

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        new = batch.dropDuplicates([id_col])
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            new = new.join(spark.read.schema(schema).json(out).select(id_col), id_col, "left_anti").select(*batch.columns)
        new.write.mode("append").json(out)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
