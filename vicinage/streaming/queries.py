"""Streams of new query entities: each micro-batch is retrieved and written as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vicinage.operators.retrieval import PoolConfig, in_blocks, query_rows
from vicinage.operators.universe import prepare, with_families

RECORD = T.StructType(
    [T.StructField("jid", T.StringType()), T.StructField("formula", T.StringType()), T.StructField("elements", T.ArrayType(T.StringType())), T.StructField("spacegroup_number", T.IntegerType()), T.StructField("arrived_at", T.TimestampType())]
)


def query_stream(spark: SparkSession, folder: str, schema: T.StructType = RECORD) -> DataFrame:
    """Records of new JSON files of a folder, each id once within a day of its arrival."""
    records = spark.readStream.schema(schema).json(folder)
    return records.filter(F.col("jid").isNotNull()).withWatermark("arrived_at", "1 day").dropDuplicatesWithinWatermark(["jid"])


def retrieve_stream(stream: DataFrame, universe: DataFrame, path: str, checkpoint: str, config: PoolConfig = PoolConfig()) -> StreamingQuery:
    """Writes the pools of every arriving query to ``path``, partitioned by batch.

    A batch that is run again after a failure replaces its own partition, so its
    rows are never doubled; finished batches are skipped by the checkpoint.
    """

    def run(batch: DataFrame, number: int) -> None:
        queries = query_rows(with_families(prepare(batch)))
        pools = in_blocks(universe, queries, config).drop("elements", "q_elements")
        pools.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, *, at: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per kind and window; on a stream, rows later than ``late`` are dropped. Works on tables alike."""
    source = events.withWatermark(at, late) if events.isStreaming else events
    return source.groupBy(F.window(at, width).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), "kind", "n", "total")
