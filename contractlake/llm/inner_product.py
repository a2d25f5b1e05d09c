"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors are sparse rows: a term is a component's place, its weight the component as an integer. Queries and
candidates are dealt into blocks, and every block of the one meets every block of the other. There the
candidates become postings, a list of (row, weight) for each term. Terms are taken one at a time: a query's
weight times the term's postings is scattered into the query's dense array of scores. The best of an array
are found by partition selection, and those of all blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import grid, written


SIGN = np.uint64(1 << 63)


def packed(flat: np.ndarray, length: np.ndarray) -> pa.Array:
    """Rows of numbers as bytes, which sort as the rows do."""
    whole = (flat.view(np.uint64) ^ SIGN).astype(">u8").tobytes()
    ends = 8 * np.append(0, length.cumsum())
    return pa.array([whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def _sparse(rows: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, term and weight of every number that isn't 0."""
    length = np.array([len(x) // 8 for x in rows], dtype=np.int64)
    flat = (np.frombuffer(b"".join(rows), dtype=">u8").astype(np.uint64) ^ SIGN).view(np.int64)
    owner = np.repeat(np.arange(len(length)), length)
    term = np.arange(len(flat)) - np.repeat(length.cumsum() - length, length)
    there = flat != 0
    return owner[there], term[there], flat[there]


def _postings(owner: np.ndarray, term: np.ndarray, weight: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(term, kind="stable")
    terms, first = np.unique(term[order], return_index=True)
    return {int(t): (o, w) for t, o, w in zip(terms, np.split(owner[order], first[1:]), np.split(weight[order], first[1:]), strict=True)}


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, best first. Only what reaches the k-th score is sorted."""
    at = np.arange(len(scores))
    if len(scores) > k:
        least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k :]].min()
        at = np.flatnonzero(scores >= least)
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search_block(asked: pd.DataFrame, found: pd.DataFrame, k: int, width: int = 32) -> pd.DataFrame:
    """The k best rows of found (id, x bytes) for each row of asked, but those with its own id: query_id, vec_id, score.

    width queries hold their score arrays at a time.
    """
    ids = found["id"].to_numpy()
    q, c = _sparse(asked["x"]), _sparse(found["x"])
    postings = _postings(*c)
    terms = max(len(set(c[1])), 1)
    large = float(np.abs(q[2].astype(np.float64)).max(initial=0)) * float(np.abs(c[2].astype(np.float64)).max(initial=0)) * terms
    kind = np.int64 if large < 2.0**62 else object
    ends = np.iinfo(np.int64)
    queries = asked["id"].to_numpy()
    out = []
    for start in range(0, len(asked), width):
        stop = min(start + width, len(asked))
        mine = (q[0] >= start) & (q[0] < stop)
        scores = np.zeros((len(ids), stop - start), dtype=kind)
        for t, (owner, weight) in _postings(q[0][mine] - start, q[1][mine], q[2][mine]).items():
            rows, own = postings.get(t, (None, None))
            if rows is not None:
                weights = np.zeros(stop - start, dtype=kind)
                weights[owner] = weight
                scores[rows] += own.astype(kind)[:, None] * weights
        for j in range(stop - start):
            others = np.flatnonzero(ids != queries[start + j])
            s = scores[others, j]
            if kind is object:
                s = np.array([min(max(v, ends.min + 1), ends.max) for v in s], dtype=np.int64)
            best = select(s, ids[others], k)
            out.append(pd.DataFrame({"query_id": queries[start + j], "vec_id": ids[others][best], "score": s[best]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: pd.Series(dtype=np.int64) for c in ("query_id", "vec_id", "score")})


def top_k(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, block: int = 4096, query_block: int = 4096) -> DataFrame:
    """Each query's k highest integer inner products: query_id long, rank int (from 1), vec_id long, score long.

    queries: a condition on the columns of vectors. Components become floor(scale * component). Every
    other row is a candidate; ties go to the smaller id. Null vectors, those with a null or non-finite
    component, and rows with a null id take no part. Rows equal in id and vector are one; of different
    vectors under one id all are candidates, and the smallest that the condition takes is the query. Vectors of different
    lengths are filled up with zeros; an empty one has the score 0 with all. An empty table gives no rows.
    A score beyond a long becomes the nearest long (but one below). Other columns are not looked at.

    About n / block blocks of candidates meet all blocks of queries; a task holds one of each and
    `width` score arrays. The table is shuffled once for each query_block queries, nothing is broadcast,
    and at most k rows a query leave a block.
    """

    def whole(batches):
        for batch in batches:
            at, length, flat = grid(batch.column(1), scale)
            taken = [c.take(pa.array(at)) for c in (batch.column(0), batch.column(2))]
            yield pa.RecordBatch.from_arrays([taken[0], packed(flat, length), taken[1]], names=["id", "x", "asks"])

    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = written(rows.mapInArrow(whole, "id long, x binary, asks boolean").groupBy("id", "x").agg(F.bool_or("asks").alias("asks")), "sparse")
    counts = rows.agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("asks"), F.col("id"))).alias("q")).first()
    blocks, query_blocks = max(1, -(-counts["n"] // block)), max(1, -(-counts["q"] // query_block))
    asked = rows.filter("asks").groupBy("id").agg(F.min("x").alias("x")).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks)))
    found = rows.select("id", "x", F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).alias("cb"))
    asked = asked.withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = found.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    met = asked.groupBy("qb", "cb").cogroup(found.groupBy("qb", "cb")).applyInPandas(lambda a, b: search_block(a, b, k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


#: Of all candidates' products with every query. Vectors of one length, as the given ones are.
SQL = """WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score FROM (SELECT vec_id, min(x) AS x FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id) q, v c WHERE c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5"""
