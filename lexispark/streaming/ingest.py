"""Streams: ingestion by files, counts kept up to date, list states by version. The batch result is the definition; a finished stream equals it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens


def stream_parquet(spark: SparkSession, path: str, schema, *, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def live_term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents of each term so far: state is one row a term."""
    return docs.select(F.explode(F.array_distinct(tokens(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n_docs"))


def live_deltas(events: DataFrame, key: str, delta) -> DataFrame:
    """Signed changes summed by key, as triggers keep them."""
    return events.groupBy(key).agg(F.sum(delta).alias("total"))


def windowed_counts(events: DataFrame, *, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour", slide: str | None = None, by: str = "event_type") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are left out and closed windows leave the state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), by).agg(F.count("*").alias("n"))


def ingest(docs: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, *, cap: int | None = None) -> StreamingQuery:
    """Runs `write` on each micro-batch, once each after recovery; more rows than the cap in one batch are an error. Ends when the files there are have been read."""

    def step(batch: DataFrame, epoch: int) -> None:
        if cap is not None and batch.count() > cap:
            raise ValueError(f"more than {cap} documents in a batch")
        write(batch, epoch)

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is into an in-memory table, for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_files(df: DataFrame) -> DataFrame:
    """Runs an aggregating stream over the files there are and returns its complete result, which each batch writes anew to the folder of checkpoints."""
    import uuid

    from ..operators.graph import checkpoint_dir

    spark = df.sparkSession
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def step(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{epoch}")
        last[:] = [epoch]

    q = df.writeStream.foreachBatch(step).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/{last[0]}") if last else spark.createDataFrame([], df.schema)
