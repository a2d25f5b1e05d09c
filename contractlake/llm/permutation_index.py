"""Approximate nearest neighbours by a permutation index.

A vector is represented by the pivots in order of their nearness to it, of which the first `prefix` are
kept. It is posted in the inverted files of the first `posts`. A query orders all pivots, looks into the
files of its first ones, and ranks what it finds by footrule distance: over the found vector's prefix,
how far each pivot's place lies from its place in the query's order. The better part is measured exactly.

Pivots, files looked into and vectors measured grow with the table, as the square root, the fourth root
and the square root of its rows, so a query meets an ever smaller share of it. How small a footrule
distance is worth measuring is read off the pivots' own prefixes, which are a sample of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, written


def usable(vector: Column) -> Column:
    """No null, zero, or non-finite component-holding vector."""
    ends = F.lit(float("inf"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < ends))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(sound, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def choose_pivots(vectors: DataFrame, key: str, vector: str, pivots: int) -> np.ndarray:
    """Up to `pivots` different directions out of a sample of about twice as many vectors (never over four times)."""
    rows = bounded_sample(vectors, F.col(key), 2 * pivots).select(F.xxhash64(key, F.lit(3)).alias("h"), vector).collect()
    x = np.array([r[1] for r in sorted(rows)], dtype=np.float64)
    if not len(x):
        return np.zeros((0, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    _, first = np.unique(x.round(9), axis=0, return_index=True)
    return x[np.sort(first)[:pivots]]


def _nearness(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ((x / np.linalg.norm(x, axis=1)[:, None]) @ pivots.T).round(12)


def prefixes(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    near = -_nearness(x, pivots)
    if prefix < near.shape[1]:
        first = np.sort(np.argpartition(near, prefix - 1, axis=1)[:, :prefix], axis=1)
    else:
        first = np.broadcast_to(np.arange(near.shape[1]), near.shape)
    order = np.argsort(np.take_along_axis(near, first, 1), axis=1, kind="stable")
    return np.take_along_axis(first, order, 1).astype(np.int32)


def places(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The place of every pivot in each vector's order."""
    order = np.argsort(-_nearness(x, pivots), axis=1)
    out = np.empty(order.shape, dtype=np.int32)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int32)[None, :], 1)
    return out


def footrule(place: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Distances of queries (rows of place) and found vectors (rows of prefix)."""
    out = np.zeros((len(place), len(prefix)), dtype=np.int32)
    for j in range(prefix.shape[1]):
        out += np.abs(place[:, prefix[:, j]] - j)
    return out


def looks_and_limit(x: np.ndarray, pivots: np.ndarray, sample: np.ndarray, looks: int, worth: float) -> np.ndarray:
    """Of each query the files it looks into, nearest first, and the footrule distance within which lies the share `worth` of the sample's prefixes."""
    place = places(x, pivots)
    at = min(len(pivots) - 1, int(np.ceil(worth * len(pivots))))
    first = np.argsort(place, axis=1)[:, :looks]
    return np.column_stack([first, np.partition(footrule(place, sample), at, axis=1)[:, at]]).astype(np.int32)


def _mapped(vectors: DataFrame, key: str, vector: str, column: str, of) -> DataFrame:
    """id, v and an int array that `of` makes of each batch of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array(part.column("v").to_pylist(), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(of(x)), pa.list_(pa.int32()))], names=["id", "v", column])

    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"id long, v array<double>, {column} array<int>")


def _search(found: pd.DataFrame, asked: pd.DataFrame, pivots: np.ndarray, k: int, posts: int) -> pd.DataFrame:
    """One block of one inverted file against the queries that look into it: each query's k best of it."""
    none = pd.DataFrame({"query_id": pd.Series(dtype=np.int64), "vec_id": pd.Series(dtype=np.int64), "score": pd.Series(dtype=np.float64)})
    if not len(found) or not len(asked):
        return none
    found = found.sort_values("id")
    file = int(found["pivot"].iloc[0])
    ids, x, prefix = found["id"].to_numpy(), np.stack(found["v"].to_list()), np.stack(found["prefix"].to_list())
    norms = np.sqrt((x * x).sum(1))
    out = []
    for k0 in range(0, len(asked), 64):
        part = asked.iloc[k0 : k0 + 64]
        v = np.stack(part["v"].to_list())
        place = places(v, pivots)
        limit = part["limit"].to_numpy()
        # a vector is measured in the first of its files that the query looks into
        here = place[:, prefix[:, :posts]].min(axis=2) == place[:, file, None]
        here &= ids[None, :] != part["id"].to_numpy()[:, None]
        distance = np.where(here, footrule(place, prefix), np.iinfo(np.int32).max)
        least = np.partition(distance, k - 1, axis=1)[:, k - 1] if len(ids) > k else distance.max(axis=1)
        chosen = here & (distance <= np.maximum(limit, least)[:, None])
        for q, w, near in zip(part["id"], v, chosen, strict=True):
            c = np.flatnonzero(near)
            if not len(c):
                continue
            score = (x[c] * w).sum(1) / (norms[c] * np.sqrt((w * w).sum()))
            top = np.lexsort((ids[c], -score))[:k]
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[c][top], "score": score[top]}))
    return pd.concat(out) if out else none


def nearest(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, pivots: float = 4, most_pivots: int = 20_000, prefix: int = 16, posts: int = 6, looks: float = 8, worth: float = 16, block: int = 2048) -> DataFrame:
    """Each query's k nearest by cosine: query_id long, rank int, vec_id long, score double.

    queries: a condition on the columns of vectors. All other rows are candidates of a query; ties go
    to the smaller id. Rows whose vector is null, zero, holds a null or non-finite component or has
    another length than most take no part, nor do those with a null id; rows equal in id and vector
    are one. Of more than k + 1 rows with the same vector, only the k + 1 smallest ids can be among
    any query's k nearest, and they stand for the rest. An empty table gives no rows; other columns of
    vectors, whatever their names, are not looked at.

    Over n rows there are pivots * sqrt(n) pivots (at most `most_pivots`, which bounds what is
    broadcast), a query looks into looks * n ** 0.25 files and measures about worth * sqrt(n) vectors
    exactly, those nearest by footrule. A file is cut into blocks of about `block` rows; every query
    looks into all blocks of its files.
    """
    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(key, vector, queries.alias("asks"))
    length = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    if not length:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size(vector) == length["n"])
    total = length["count"]
    chosen = choose_pivots(rows, key, vector, min(most_pivots, int(np.ceil(pivots * total**0.5))))
    m = len(chosen)
    prefix, posts, looks = min(prefix, m), min(posts, m), min(int(np.ceil(looks * total**0.25)), m)
    share = min(1.0, worth / total**0.5)
    sample = np.concatenate([prefixes(chosen[at : at + 1024], chosen, prefix) for at in range(0, m, 1024)])
    shared, samples = (vectors.sparkSession.sparkContext.broadcast(x) for x in (chosen, sample))
    asked = _mapped(rows.filter("asks"), key, vector, "prefix", lambda x: looks_and_limit(x, shared.value, samples.value, looks, share)).dropDuplicates(["id", "v"])
    own = rows.select(key, vector).dropDuplicates([key, vector])
    stand = own.withColumn("copy", F.row_number().over(Window.partitionBy(vector).orderBy(key))).filter(F.col("copy") <= k + 1)
    index = written(_mapped(stand, key, vector, "prefix", lambda x: prefixes(x, shared.value, prefix)), "index")
    posted = index.select("*", F.explode(F.slice("prefix", 1, posts)).alias("pivot"))
    blocks = posted.groupBy("pivot").agg(F.ceil(F.count("*") / block).alias("blocks"))
    # one row per pivot, at most most_pivots
    posted = posted.join(F.broadcast(blocks), "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")
    looking = asked.select("id", "v", F.element_at("prefix", -1).alias("limit"), F.explode(F.slice("prefix", 1, looks)).alias("pivot")).join(F.broadcast(blocks.toDF("pivot", "each")), "pivot")
    looking = looking.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("each") - 1))).drop("each")
    found = (
        posted.groupBy("pivot", "block")
        .cogroup(looking.groupBy("pivot", "block"))
        .applyInPandas(lambda a, b: _search(a, b, shared.value, k, posts), "query_id long, vec_id long, score double")
    )
    # should rounding in two files order two pivots differently, a vector could be found in both
    found = found.dropDuplicates(["query_id", "vec_id"])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
