"""Structured Streaming versions of the windowed operators, with event time and watermarks."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.sources.storage import new_path, setting


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """events as a stream of Parquet files; ts as a timestamp, for the watermark."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    found = stream.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else stream.parquet(path)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and mean score per window and type; late rows beyond the watermark are dropped."""
    score = F.least(F.lit(1.0), F.col("value") / 100.0)
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sliding(events: DataFrame, size: str = "1 day", step: str = "12 hours", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events less than a gap apart."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_tiers(events: DataFrame) -> DataFrame:
    """Running count and mean per type and tier (update or complete mode)."""
    return events.groupBy("event_type", (F.col("user_id") % 3).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.least(F.lit(1.0), F.col("value") / 100.0)).alias("mean"))


def live_memory(events: DataFrame, hours: int = 48, late: str = "1 hour") -> DataFrame:
    """(user_id, event_type, event_id, begun, until): memories of each user and type, as they open.

    An event opens a memory that lives for ``hours``; those that come meanwhile
    belong to it, the first one after that opens the next. State is cleared by a
    timer when the watermark has passed its end; rows later than the watermark
    are dropped.
    """
    from mnemospark.streaming.state import Memory

    rows = events.select("user_id", "event_type", "event_id", "ts").withWatermark("ts", late)
    return rows.groupBy("user_id", "event_type").transformWithStateInPandas(Memory(hours), "user_id long, event_type string, event_id long, begun timestamp, until timestamp", "append", "eventTime")


def running_surprise(events: DataFrame) -> DataFrame:
    """Momentum surprise of each user as custom state: (user_id, n, promoted, momentum) whenever a user has new events. Null scores change nothing."""
    from mnemospark.streaming.state import Surprise

    scored = events.select("user_id", "ts", "event_id", F.least(F.lit(1.0), F.col("value") / 100.0).alias("score"))
    return scored.groupBy("user_id").transformWithStateInPandas(Surprise(), "user_id long, n long, promoted long, momentum double", "update", "none")


def run_once(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Drains what is there and returns the result: appended rows, the last complete one, or (update) the last row of each key.

    In update mode a micro-batch writes its own rows alone, as files of its
    number, so that it costs what its keys cost; a repeated batch writes the same
    files again, and a reader takes the rows of each key's last batch.
    """
    spark = stream.sparkSession
    base = new_path(spark, "stream")
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys by which rows replace each other")

    def replace(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out")

    def upsert(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    if mode == "append":
        w = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
    else:
        w = stream.writeStream.outputMode(mode).foreachBatch(upsert if mode == "update" else replace)
    custom = "TransformWithState" in stream._jdf.queryExecution().logical().toString()
    kept = setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider") if custom else nullcontext()
    with kept:  # custom state needs that store
        w.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/out")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in stream.columns])
