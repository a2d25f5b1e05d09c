"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the ASCII controls \\t to \\r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).

    Where it is unset: a temporary folder for a local master, on a cluster the warehouse.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.startswith("local["):
            path = tempfile.mkdtemp(prefix="contractlake-")
        else:
            path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_contractlake"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again. codec: of the Parquet files, else the session's."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_column(text: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fold(key: Column, k: int) -> Column:
    """crc32 of the key as text, modulo k (null key: of the empty string)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % k


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let at most so many rows go to a Python worker at a time: texts are long, and both sides hold a batch whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into few rows each, so that only few texts become Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bounded_sample(df: DataFrame, key: Column, rows: int, seed: int = 17) -> DataFrame:
    """About `rows` rows of df, chosen by a hash of the key; all of them if df has no more.

    Whether a row is chosen depends on its key and the row count alone, so reruns agree. One
    count of df, no shuffle. The number is binomial about `rows`; a hard stop lies at twice that,
    which only many equal keys can reach.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * rows / total)).limit(2 * rows)


def grid(vectors: pa.ListArray, scale: int, size: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * component) of lists of doubles: which rows are sound, their lengths, and all their numbers in one row (int64).

    Unsound are null lists, those with a null or non-finite component and, where size is given, those of
    another length. What a long can't hold becomes the nearest long.
    """
    length = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(length >= 0 if size is None else length == size)
    flat = pc.list_flatten(vectors.take(pa.array(at))).cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(at)), length[at])
    broken = np.zeros(len(at), dtype=bool)
    broken[owner[~np.isfinite(flat)]] = True
    at, flat = at[~broken], np.floor(flat[~broken[owner]] * scale)
    inside = np.abs(flat) < 2.0**63
    whole = np.where(inside, flat, 0).astype(np.int64)
    whole[~inside] = np.where(flat[~inside] > 0, np.iinfo(np.int64).max, np.iinfo(np.int64).min)
    return at, length[at].astype(np.int64), whole


def folded(rows: DataFrame, parts: int, combine: Callable[[pd.DataFrame], pd.DataFrame], fan: int = 32) -> DataFrame:
    """Rows that partitions made, combined into one by a tree: `fan` rows meet in a task, then their results, and so on.

    rows: column part, the partition (0 to parts - 1), and what combine takes and gives, part excepted.
    """
    while True:
        groups = -(-parts // fan)
        rows = rows.withColumn("part", F.col("part") % groups).groupBy("part").applyInPandas(lambda g: combine(g).assign(part=g["part"].iloc[0]), rows.schema)
        if groups == 1:
            return rows
        parts = groups
