"""Event-time counts over a stream of wire records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomwire.operators.decode import decoded
from fathomwire.plans.types import DEFAULT, Options


def windowed_counts(stream: DataFrame, payload: str, schema: T.StructType, micros: str, key: str, width: str, delay: str, options: Options = DEFAULT, mode: str = "DROPMALFORMED") -> DataFrame:
    """(window_start, key, n): records by tumbling window of their event time, which is a field of microseconds."""
    rows = decoded(stream.select(payload), payload, schema, options, mode).select("record.*")
    rows = rows.withColumn("event_time", F.timestamp_micros(F.col(micros))).withWatermark("event_time", delay)
    return rows.groupBy(F.window("event_time", width).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def drained(counts: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The last count of each key after all that the stream has now; its state and result lie under ``path``.

    Each batch writes the rows that it changed to a folder of its own, which a repeated batch replaces; so windows that the
    watermark has passed leave the state, and no batch rewrites what others wrote.
    """
    spark: SparkSession = counts.sparkSession
    out = f"{path}/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*counts.schema.fields, T.StructField("batch", T.LongType())])
    spark.createDataFrame([], counts.schema).write.parquet(f"{out}/result/batch=-1")  # so that there is a table without any batch
    rows = spark.read.schema(schema).parquet(f"{out}/result")
    rest = [c for c in counts.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest]).select(*counts.columns)
