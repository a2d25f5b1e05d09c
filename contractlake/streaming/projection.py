"""An item log projected incrementally: what is new behind a stored position, and errors where a log has shrunk.

A projection is a folder of runs. Each batch of the stream writes its new items, the positions that they move
and its errors as one run, named by the batch, and then a version: the list of runs that hold from then on. A
batch that is replayed writes the same run and version again; a reader takes the highest version, so it sees
a batch whole or not at all. Now and then the runs are rewritten as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

POSITIONS = "rollout {0}, next_ordinal long, next_offset long"
ERRORS = "rollout {0}, code string, projected_offset long, log_bytes long, batch long"


class Projection:
    """Where the runs are, and what the items look like. extra: the columns of items beside rollout, ordinal, offset and bytes."""

    def __init__(self, spark: SparkSession, path: str, items: T.StructType, compact_every: int = 16):
        self.spark, self.path, self.compact_every = spark, path, compact_every
        kind = items["rollout"].dataType.simpleString()
        self.items_schema = T.StructType([f for f in items if f.name != "log_bytes"])
        self.positions_schema, self.errors_schema = POSITIONS.format(kind), ERRORS.format(kind)

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def runs(self, before: int | None = None) -> list[str]:
        """The runs of the highest version (below `before`)."""
        if not self._exists(f"{self.path}/versions"):
            return []
        versions = self.spark.read.schema("version long, runs array<string>").parquet(f"{self.path}/versions")
        row = versions.filter("true" if before is None else f"version < {before}").agg(F.max_by("runs", "version").alias("runs")).first()
        return row["runs"] or []

    def _read(self, kind: str, schema: T.StructType | str, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/runs/{r}/{kind}" for r in runs]) if runs else self.spark.createDataFrame([], schema)

    def items(self) -> DataFrame:
        """The projected items, each (rollout, ordinal) once."""
        return self._read("items", self.items_schema, self.runs())

    def errors(self) -> DataFrame:
        return self._read("errors", self.errors_schema, self.runs())

    def positions(self, before: int | None = None) -> DataFrame:
        """Of each rollout the ordinal and the offset from which on nothing is projected."""
        rows = self._read("positions", self.positions_schema, self.runs(before))
        return rows.groupBy("rollout").agg(F.max("next_ordinal").alias("next_ordinal"), F.max("next_offset").alias("next_offset"))

    def _version(self, number: int, runs: list[str]) -> None:
        self.spark.createDataFrame([(number, runs)], "version long, runs array<string>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/v={number}")

    def put(self, batch: DataFrame, number: int) -> None:
        """One batch: rollout, ordinal, offset, bytes, log_bytes and the items' other columns.

        log_bytes is how long the log was when the row was read. A rollout whose longest reading in the batch is
        shorter than what is projected of it gives ROLLOUT_LOG_SHRUNK, one whose rows leave out an ordinal behind the position
        ROLLOUT_LOG_GAP; nothing more of either is taken from the batch, so the projection may lag but never
        leads. Rows before the position, and repeats, are taken for replays and left out.
        """
        runs = self.runs(number)
        known = self._read("positions", self.positions_schema, runs).groupBy("rollout").agg(F.max("next_ordinal").alias("next_ordinal"), F.max("next_offset").alias("next_offset"))
        batch = batch.persist()
        fresh = None
        try:
            seen = batch.groupBy("rollout").agg(F.max("log_bytes").alias("log_bytes")).join(known, "rollout", "left")
            shrunk = F.coalesce(F.col("log_bytes") < F.col("next_offset"), F.lit(False))
            names = [f.name for f in self.items_schema]
            # three outputs come from them
            fresh = batch.join(seen.select("rollout", "next_ordinal", shrunk.alias("shrunk")), "rollout").filter("not shrunk and (next_ordinal is null or ordinal >= next_ordinal)")
            fresh = fresh.select(*names, F.coalesce("next_ordinal", F.lit(0)).alias("next_ordinal")).dropDuplicates(["rollout", "ordinal"]).persist()
            # without a gap the rows of a rollout are as many as its ordinals reach beyond the position
            spans = fresh.groupBy("rollout").agg(F.count("*").alias("n"), F.max("ordinal").alias("last"), F.max(F.col("offset") + F.col("bytes")).alias("end"), F.first("next_ordinal").alias("next_ordinal"))
            whole = F.col("last") - F.col("next_ordinal") + 1 == F.col("n")
            run = f"{self.path}/runs/b{number}"
            taken = spans.filter(whole).select("rollout", (F.col("last") + 1).alias("next_ordinal"), F.col("end").alias("next_offset"))
            fresh.drop("next_ordinal").join(taken.select("rollout"), "rollout", "left_semi").select(*names).write.mode("overwrite").parquet(f"{run}/items")
            taken.write.mode("overwrite").parquet(f"{run}/positions")
            size = seen.select("rollout", F.col("next_offset").alias("projected_offset"), "log_bytes", shrunk.alias("shrunk"))
            wrong = size.filter("shrunk").withColumn("code", F.lit("ROLLOUT_LOG_SHRUNK")).unionByName(size.join(spans.filter(~whole).select("rollout"), "rollout", "left_semi").withColumn("code", F.lit("ROLLOUT_LOG_GAP")))
            wrong.select("rollout", "code", "projected_offset", "log_bytes", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{run}/errors")
        finally:
            batch.unpersist()
            if fresh is not None:
                fresh.unpersist()
        runs = [*runs, f"b{number}"]
        if len(runs) > self.compact_every:
            runs = [self._compacted(runs, number)]
        self._version(number, runs)

    def _compacted(self, runs: list[str], number: int) -> str:
        """The runs rewritten as one: positions one a rollout, items in the order of their rollouts."""
        name = f"c{number}"
        at = f"{self.path}/runs/{name}"
        items = self._read("items", self.items_schema, runs)
        items.repartitionByRange("rollout", "ordinal").sortWithinPartitions("rollout", "ordinal").write.mode("overwrite").parquet(f"{at}/items")
        positions = self._read("positions", self.positions_schema, runs)
        positions.groupBy("rollout").agg(F.max("next_ordinal").alias("next_ordinal"), F.max("next_offset").alias("next_offset")).write.mode("overwrite").parquet(f"{at}/positions")
        self._read("errors", self.errors_schema, runs).write.mode("overwrite").parquet(f"{at}/errors")
        return name

    def vacuum(self) -> None:
        """Delete the runs that the two highest versions don't name: no reader begins with them any more, and the last batch can still be replayed."""
        versions = self.spark.read.schema("version long, runs array<string>").parquet(f"{self.path}/versions").orderBy(F.desc("version")).limit(2).collect()
        kept = {r for v in versions for r in v["runs"]}
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(top):
            if status.getPath().getName() not in kept:
                fs.delete(status.getPath(), True)

    def follow(self, log: DataFrame, checkpoint: str) -> StreamingQuery:
        """Project all of the log that is there now. Called again with the same checkpoint it goes on where it ended."""
        return log.writeStream.foreachBatch(self.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
