"""Streams of session events: projection, the state of turns in a batch, deduplication; what keeps state by key is in `state`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .state import TERMINAL, started


def project_rollouts(items: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append an item log (rollout, ordinal, …) to a projection. Each batch is a folder of its own that a replay overwrites, so a restart neither repeats nor loses rows."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return items.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def projection(spark: SparkSession, path: str, items_columns: list[str]) -> DataFrame:
    """The projected items, one per (rollout, ordinal): the last batch's."""
    rest = [c for c in items_columns if c not in ("rollout", "ordinal")]
    rows = spark.read.parquet(path)
    return rows.groupBy("rollout", "ordinal").agg(F.max_by(F.struct(*rest), "batch").alias("m")).select("rollout", "ordinal", "m.*")


def shrunk(projected: DataFrame, log: DataFrame) -> DataFrame:
    """Rollouts whose log (rollout, ordinal) ends before what was projected: the projection may lag, never lead."""
    a = projected.groupBy("rollout").agg(F.max("ordinal").alias("projected"))
    b = log.groupBy("rollout").agg(F.max("ordinal").alias("logged"))
    return a.join(b, "rollout", "left").filter("logged is null or logged < projected").withColumn("code", F.lit("ROLLOUT_LOG_SHRUNK"))


def reduce_turns_batch(events: DataFrame) -> DataFrame:
    """The batch twin: each turn's final status and the seq at which it was reached."""
    terminal = F.col("status").isin(*TERMINAL)
    out = events.groupBy("thread", "turn").agg(F.min_by(F.when(terminal, F.struct("seq", "status")), F.when(terminal, F.col("seq"))).alias("t"), F.min_by(F.struct("seq", "status"), "seq").alias("f"))
    return out.select("thread", "turn", F.coalesce("t.seq", "f.seq").alias("seq"), F.coalesce("t.status", "f.status").alias("status"))


def stream_dedupe(items: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows of overlapping pages, once each within the delay."""
    return items.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def finished(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now and read what it wrote."""
    started(stream, path, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
