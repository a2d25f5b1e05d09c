"""The operators on embeddings against brute force and odd tables."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from contractlake.llm import centroids, inner_product, whitening
from contractlake.llm import queries as Q
from contractlake.llm.whitening import Spectrum

SF = "/root/testdata/sf0.01"
#: columns with names that the operators use inside
WIDE = "vec_id long, embedding array<double>, k long, v string, x long, part int, cluster int, n string, id long, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", 2, 3, 4, "n", 5, 6) for i, v in rows], WIDE)


def ints(v):
    return [int(np.floor(256 * float(c))) for c in v]


def sound(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def given(spark, name="embeddings"):
    return [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def odd(size):
    r = np.random.default_rng(5)
    some = [(100 + i, r.normal(size=size).tolist()) for i in range(60)]
    bad = [(1, None), (2, [float("nan")] * size), (3, [float("inf")] + [0.0] * (size - 1)), (4, [None] + [1.0] * (size - 1)), (5, [1.0] * (size + 1)), (6, [])]
    return some + bad + [some[3], some[3], (None, some[4][1]), (150, some[5][1]), (50, [0.0] * size), (200, [0.25] * size)]


# --- whitening


def brute_whitening(rows, components=4):
    rows = [(i, ints(v)) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in rows}), dtype=np.float64)
    mean = fit.mean(0)
    e, u = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    n, s = len(fit), [sum(int(v) for v in c) for c in fit.T]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(x, s)) for _, x in rows]
    white = np.array([x for _, x in rows] - mean) @ u / np.sqrt(e)
    return n, deviation, white, e / ((fit - mean) ** 2).sum(1).mean()


def same_whitening(out, rows):
    n, deviation, white, explained = brute_whitening(rows)
    got = out.toPandas()
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    for c in range(4):
        mine = got[got["component"] == c + 1]
        assert np.allclose(mine["explained"], explained[c], rtol=1e-9)
        want = sorted(zip([-1 if i is None else i for i, _ in rows], deviation, np.round(white[:, c], 7)))
        sign = 1.0
        values = sorted(zip(mine["vec_id"].fillna(-1).astype(int), [int(d) for d in mine["deviation"]], mine["whitened"]))
        if values[0][2] * want[0][2] < 0:
            sign = -1.0
        values = sorted((i, d, w * sign) for i, d, w in values)
        assert [v[:2] for v in values] == [w[:2] for w in want]
        assert np.allclose([v[2] for v in values], [w[2] for w in want], atol=1e-6)


def test_whitening_of_the_table(spark):
    same_whitening(Q.op11_whiten(spark, SF), given(spark))


def test_whitening_odd_rows(spark):
    rows = odd(6)
    out = whitening.whiten(vectors(spark, rows).repartition(5))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same_whitening(out, [(i, v) for i, v in rows if sound(v) and len(v) == 6])
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0


def test_whitening_without_variance(spark):
    flat = whitening.whiten(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in flat] == [(c, 1, 0, None, 0.0, None) for _ in (1, 2) for c in (1, 2)]
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).toPandas()
    assert set(line["component"]) == {1, 2, 3} and line[line["component"] > 1]["whitened"].isna().all()
    assert np.allclose(line[line["component"] == 1]["explained"], 1) and line["identity_error"].max() < 1e-12
    huge = whitening.whiten(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])])).toPandas()
    assert len(huge) == 6 and huge[huge["component"] == 1]["whitened"].notna().all()


def random_rows(kind, r):
    if kind == "low rank":
        return r.integers(-3, 4, (400, 5)) @ r.integers(-2, 3, (5, 12))
    if kind == "equal eigenvalues":
        return np.eye(8)[r.integers(0, 8, 300)] * 4
    if kind == "far from the origin":
        return r.integers(-9, 9, (300, 7)) + 10**7
    return r.integers(-500, 500, (300, 20)) * r.integers(1, 40, 20)


@pytest.mark.parametrize("kind", ["low rank", "equal eigenvalues", "far from the origin", "plain"])
def test_rank_one_updates_give_the_spectrum(kind):
    """Updates, deflation and merges: in exact arithmetic the scatter matrix."""
    x = random_rows(kind, np.random.default_rng(3)).astype(np.float64)
    parts = []
    for rows in np.array_split(x, 3):
        parts.append(Spectrum.empty(x.shape[1]))
        for row in rows:
            parts[-1].add(row)
    for s in parts[1:]:
        parts[0].merge(s)
    s = parts[0]
    c = x - x.mean(0)
    want = c.T @ c
    assert s.n == len(x) and np.allclose(s.mean, x.mean(0), rtol=1e-12)
    assert np.abs(s.vectors * s.values @ s.vectors.T - want).max() < 1e-9 * np.abs(want).max()
    assert np.abs(s.vectors.T @ s.vectors - np.eye(s.vectors.shape[1])).max() < 1e-12


def test_secular_equation():
    r = np.random.default_rng(8)
    for k in (1, 2, 5, 40):
        d, w = np.sort(r.normal(size=k)) * 10.0 ** r.integers(-3, 4), r.normal(size=k) * 10.0 ** r.integers(-4, 2, k)
        roots, gap = whitening.secular(d, w)
        assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + np.outer(w, w)), rtol=1e-12, atol=1e-13 * np.abs(roots).max())
        assert (gap != 0).all() and gap.shape == (k, k)


# --- centroid clustering


def brute_clusters(rows, k=40, rounds=5, size=64):
    kept = [(i, np.array(ints(v), dtype=object)) for i, v in rows if sound(v) and len(v) == size]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", list(r[1]))
    c = [x for _, x in sorted(kept, key=key)[:k]]
    near = lambda x: min((int(((x - y) ** 2).sum()), j) for j, y in enumerate(c))
    for _ in range(rounds):
        mine = defaultdict(list)
        for _, x in kept:
            mine[near(x)[1]].append(x)
        c = [np.array([int(v) // len(mine[j]) for v in sum(mine[j])], dtype=object) if j in mine else y for j, y in enumerate(c)]
    last = [(i, *near(x)) for i, x in kept]
    total, by = sum(d for _, d, _ in last), defaultdict(int)
    for _, d, j in last:
        by[j] += d
    return sorted((-1 if i is None else i, j, d, by[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last)


def clusters(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, df.collect()))


def test_clusters_odd_rows(spark):
    rows = odd(64)
    out = centroids.cluster(vectors(spark, rows).repartition(3))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clusters(out) == brute_clusters(rows)
    few = [(i, v) for i, v in rows[:7]]
    assert clusters(centroids.cluster(vectors(spark, few))) == brute_clusters(few)
    assert centroids.cluster(vectors(spark, [])).count() == 0
    assert centroids.cluster(vectors(spark, [(1, None)])).count() == 0


def test_clusters_of_huge_components(spark):
    rows = [(i, [1e12 * (-1) ** i + i, 3.0 * i]) for i in range(9)]
    got = centroids.cluster(vectors(spark, rows), k=2, size=2)
    want = [(i, j, d, b, t, h) for i, j, d, b, t, h in brute_clusters(rows, k=2, size=2)]
    assert [r[:2] + r[5:] for r in clusters(got)] == [r[:2] + r[5:] for r in want]
    far = [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0])]
    assert centroids.cluster(vectors(spark, far), k=1, size=2).count() == 3


@pytest.mark.parametrize("spread", [0.02, 1.0, 300.0])
def test_search_rejects_no_nearest(spread):
    """Against all distances, ties included; fewer are measured."""
    r = np.random.default_rng(4)
    c = np.floor(r.normal(size=(40, 8)) * 5 * spread + r.normal(size=(40, 1)) * 50 * spread).astype(np.int64)
    c[7] = c[20]
    x = np.floor(r.normal(size=(3000, 8)) * 5 * spread + r.normal(size=(3000, 1)) * 50 * spread).astype(np.int64)
    x[:40] = c
    number, distance, measured = centroids.Search(c).nearest(x)
    every = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert spread < 1 or measured < 0.4 * every.size


# --- exact top-k


def brute_top(rows, k=5, step=50):
    rows = sorted({(i, tuple(ints(v))) for i, v in rows if i is not None and sound(v)})
    asked = {}
    for i, x in rows:
        if i % step == 0:
            asked.setdefault(i, x)
    out = []
    for q, x in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "query_block"), [(4096, 4096), (7, 1)])
def test_top_k(spark, block, query_block):
    rows = odd(5) + [(300 + i, [0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(40)] + [(400, None), (450, [1.0]), (50, [0.0, 1.0])]
    out = inner_product.top_k(vectors(spark, rows).repartition(4), F.col("vec_id") % 50 == 0, block=block, query_block=query_block)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect())) == brute_top(rows)


def test_top_k_small_and_empty(spark):
    asks = F.col("vec_id") % 50 == 0
    assert inner_product.top_k(vectors(spark, []), asks).count() == 0
    assert inner_product.top_k(vectors(spark, [(50, [1.0])]), asks).count() == 0
    assert inner_product.top_k(vectors(spark, [(51, [1.0]), (52, [1.0])]), asks).count() == 0
    few = [(50, [1.0, 2.0]), (1, [-1.0, 0.0]), (2, [0.0, 0.5])]
    assert sorted(map(tuple, inner_product.top_k(vectors(spark, few), asks).collect())) == brute_top(few)
    top = inner_product.top_k(vectors(spark, [(50, [1e15, 1e15]), (1, [1e15, 1e15]), (2, [-1e15, -1e15])]), asks).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in top] == [(1, 1, 2**63 - 1), (2, 2, -(2**63) + 1)]


def test_select_ties():
    r = np.random.default_rng(2)
    for n in (0, 3, 5, 6, 300):
        s, ids = r.integers(0, 6, n), r.permutation(n)
        want = sorted(range(n), key=lambda i: (-s[i], ids[i]))[:5]
        assert list(inner_product.select(s, ids, 5)) == want
