"""Centroid clustering with an equal-average equal-variance search, in exact integers.

Of d numbers each, a vector x and a centroid c with sums s and scaled variances a = d * sum(x * x) - s * s satisfy

    d * |x - c|^2 >= (s(x) - s(c))^2 + (sqrt(a(x)) - sqrt(a(c)))^2.

Centroids are kept in order of their sums, that is of their means. A vector starts at the centroid whose sum
is next to its own and goes outward, the nearer side first. A side ends where the first term alone exceeds the
best distance found, a centroid is passed over where both terms do, and only the others are measured, in
integers. All rejections are strict, so equally near centroids are all measured and the smallest number wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grid, written

#: Squared distances stay in 64 bits while no entry of either side is larger.
SMALL = 2.0**26


class Search:
    """Centroids (rows of integers), made ready for searches."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.size = centroids.shape[1]
        self.sums, self.spread = self.features(centroids)
        self.order = np.lexsort((np.arange(len(centroids)), self.sums))
        self.sorted = self.sums[self.order]
        self.small = self.is_small(centroids)

    def is_small(self, x: np.ndarray) -> bool:
        return not x.size or float(np.abs(x.astype(np.float64)).max()) <= SMALL / max(1.0, np.sqrt(self.size))

    def features(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums as doubles, and the square roots of the scaled variances."""
        y = x.astype(np.float64)
        centred = y - y.mean(1, keepdims=True)
        return y.sum(1), np.sqrt((centred * centred).sum(1) * self.size)

    def distances(self, x: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the centroids with these numbers."""
        c = self.c[numbers]
        if not (self.small and self.is_small(x)):
            x, c = x.astype(object), c.astype(object)
        return ((x - c) ** 2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each row the nearest centroid (the smallest number of equally near ones), the squared distance, and how many distances were measured."""
        k = len(self.c)
        sums, spread = self.features(x)
        # what rounding can have added to the left sides below, relative to the numbers that enter
        slack = 1e-9 * (np.square(sums) + np.square(self.sorted).max() + np.square(spread) + np.square(self.spread).max() + 1)
        right = np.searchsorted(self.sorted, sums)
        left = right - 1
        ends = np.concatenate([[np.inf], self.sorted, [np.inf]])
        best = np.full(len(x), -1)
        far = np.full(len(x), np.inf)
        exact = np.zeros(len(x), dtype=np.int64 if self.small and self.is_small(x) else object)
        measured = 0
        live = np.arange(len(x))
        while len(live):
            down, up = np.abs(sums[live] - ends[left[live] + 1]), np.abs(ends[right[live] + 1] - sums[live])
            gap = np.minimum(down, up)
            # the nearer side is beyond the best: so is the other
            on = np.isfinite(gap) & (gap * gap <= self.size * far[live] + slack[live])
            live, goes_down = live[on], (down <= up)[on]
            gap = gap[on]
            number = self.order[np.where(goes_down, left[live], right[live])]
            left[live] -= goes_down
            right[live] += ~goes_down
            bound = gap * gap + np.square(spread[live] - self.spread[number])
            near = bound <= self.size * far[live] + slack[live]
            rows, number = live[near], number[near]
            d = self.distances(x[rows], number)
            measured += len(rows)
            better = (best[rows] < 0) | (d < exact[rows]) | ((d == exact[rows]) & (number < best[rows]))
            rows = rows[better]
            best[rows], exact[rows], far[rows] = number[better], d[better], d[better].astype(np.float64)
        assert k == 0 or (best >= 0).all()
        return best, exact, measured


def _assigned(batch: pa.RecordBatch, column: int, search: Search, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    for start in range(0, batch.num_rows, 4096):
        part = batch.slice(start, 4096)
        at, _, flat = grid(part.column(column), scale, search.size)
        x = flat.reshape(-1, search.size)
        number, distance, _ = search.nearest(x)
        yield at, x, number, distance, part


def _sums(rows: DataFrame, search: Search, scale: int) -> list[list[int]]:
    """Of each centroid that has vectors: its number, how many, and their componentwise sums. At most one row of each leaves a partition."""
    shared = rows.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        count = [0] * len(s.c)
        total = np.zeros(s.c.shape, dtype=object)
        for batch in batches:
            for _, x, number, _, _ in _assigned(batch, 0, s, scale):
                wide = x if not x.size or float(np.abs(x.astype(np.float64)).max()) * len(x) < 2.0**62 else x.astype(object)
                for j in np.unique(number):
                    mine = wide[number == j]
                    count[j] += len(mine)
                    total[j] += mine.sum(0)
        at = [j for j in range(len(count)) if count[j]]
        yield pa.RecordBatch.from_pydict({"cluster": at, "rows": [count[j] for j in at], "total": [[Decimal(int(v)) for v in total[j]] for j in at]}, schema=SUMS)

    parts = rows.select("v").mapInArrow(run, "cluster int, rows long, total array<decimal(38,0)>")
    cells = parts.select("cluster", "rows", F.posexplode("total").alias("i", "v")).groupBy("cluster", "i").agg(F.sum("rows").alias("rows"), F.sum("v").alias("v"))
    whole = cells.groupBy("cluster").agg(F.first("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("i", "v"))).alias("cells"))
    out = [[r["cluster"], r["rows"], *(int(c["v"]) for c in r["cells"])] for r in whole.collect()]
    shared.unpersist()
    return out


SUMS = pa.schema([("cluster", pa.int32()), ("rows", pa.int64()), ("total", pa.list_(pa.decimal128(38, 0)))])


def first_centroids(rows: DataFrame, k: int, size: int, scale: int, salt: str) -> np.ndarray:
    """The k vectors whose keys come first by the sha256 of salt and key, in that order; equal hashes by vector, null keys last."""

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _, flat = grid(batch.column(1), scale, size)
            x = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, size, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), x], names=["h", "x"])

    hashed = rows.select(F.sha2(F.concat(F.lit(salt), F.col("k").cast("string")), 256).alias("h"), "v")
    first = hashed.mapInArrow(sound, "h string, x array<long>").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([r["x"] for r in first], dtype=np.int64).reshape(-1, size)


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, size: int = 64, rounds: int = 5, scale: int = 256, salt: str = "2:") -> DataFrame:
    """Every sound vector with its cluster: key, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string.

    A vector of `size` components becomes integers floor(scale * component). Centroids 0 to k - 1 start as
    the vectors first by sha256 of salt and key. A round assigns every vector to its nearest centroid
    (squared Euclidean distance, ties to the smaller number) and moves each centroid that has vectors to
    their mean, rounded down; after the rounds vectors are assigned once more. k * size numbers a round
    pass through the driver; the vectors are read again each round and never shuffled.

    Vectors null, of another length, or with a null or non-finite component take no part. Repeated rows
    count as often as they stand; of rows with a null key the vectors take part and can be first centroids
    only if nothing else is left. Fewer vectors than k make as many centroids; an empty table gives no
    rows. Equal first centroids are kept: only the smallest number of them gets vectors. Other columns
    are not looked at. Components beyond a long become the nearest long; distances and sums of them
    beyond a long are null.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == size)
    centroids = first_centroids(rows, k, size, scale, salt)
    if not len(centroids):
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        moved = centroids.copy()
        for number, count, *total in _sums(rows, Search(centroids), scale):
            moved[number] = [v // count for v in total]
        centroids = moved
    shared = spark.sparkContext.broadcast(Search(centroids))
    most = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, number, distance, part in _assigned(batch, 1, shared.value, scale):
                d = pa.array([int(v) if v <= most else None for v in distance], pa.int64()) if distance.dtype == object else pa.array(distance)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(number.astype(np.int32)), d], names=[key, "cluster", "distance"])

    assigned = written(rows.mapInArrow(run, f"{key} {kind}, cluster int, distance long"), "assigned")
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    by = assigned.groupBy("cluster").agg(F.when(F.bool_and(F.col("distance").isNotNull()), wide(F.col("distance"))).alias("own"))
    inertias = {r["cluster"]: r["own"] for r in by.collect()}
    whole = None if None in inertias.values() else sum(inertias.values())
    fits = lambda v: int(v) if v is not None and v <= most else None
    # a row per centroid
    known = [(j, fits(inertias.get(j)), fits(whole), ",".join(map(str, c))) for j, c in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, text string").withColumn("centroid_sha256", F.sha2("text", 256)).drop("text")
    return assigned.join(F.broadcast(facts), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, size: int = 64, rounds: int = 5, scale: int = 256, salt: str = "2:") -> str:
    """DuckDB SQL for cluster() of embeddings: all distances, round by round."""
    square = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    down = "(s - ((s % n) + n) % n) // n"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id) NULLS LAST, x) - 1 AS j, x AS c FROM v ORDER BY j LIMIT {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, any_value(x) AS x, any_value(vec_id) AS vec_id, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT r, x, vec_id, j, {square} AS d FROM v, c{t}) GROUP BY r)")
        if t < rounds:
            mean = f"SELECT j, list({down} ORDER BY i) AS m FROM (SELECT j, i, sum(x[i]) AS s, count(*) AS n FROM a{t}, range(1, {size + 1}) AS g(i) GROUP BY j, i) GROUP BY j"
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c{t}.j, coalesce(m::BIGINT[], c) AS c FROM c{t} LEFT JOIN ({mean}) USING (j))")
    return f"WITH {', '.join(parts)} SELECT vec_id, j::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"
