"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and their beginnings, hashed into buckets; a bucket's value is the logarithm
of its count. The machine adds a weight for each bucket present and an inner product for each pair of
buckets, so that a pair such as an insult and the mention of a group counts beyond its parts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, short_batches, slices, text_column

BITS = 20
PREFIXES = (3, 4, 5, 6, 7)
_WORDS = re.compile(r"[^\W\d_]+")


def _hash(term: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(term.encode("utf-8", "replace")) & ((1 << BITS) - 1)


def buckets(word: str) -> tuple[int, ...]:
    """Of the word itself and of its beginnings."""
    return (_hash(word), *(_hash(f"{word[:n]}-") for n in PREFIXES if len(word) > n))


class Terms:
    """Buckets of a text, ascending, and their counts; remembers words, up to a bound."""

    def __init__(self, wanted: dict[int, int] | None = None, most: int = 100_000) -> None:
        self.memory: dict[str, tuple[int, ...]] = {}
        self.wanted, self.most = wanted, most

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        memory = self.memory
        if len(memory) > self.most:
            memory.clear()
        found: dict[int, int] = {}
        for w, n in Counter(_WORDS.findall(text.lower())).items():
            of = memory.get(w)
            if of is None:
                of = buckets(w)
                if self.wanted is not None:
                    of = tuple(self.wanted[x] for x in of if x in self.wanted)
                memory[w] = of
            for x in of:
                found[x] = found.get(x, 0) + n
        names = sorted(found)
        return np.array(names, dtype=np.int32), np.array([found[x] for x in names], dtype=np.int64)


def logs(counts: np.ndarray) -> np.ndarray:
    """log2(1 + count) as the bits of a float16: Spark has no such type."""
    return np.log2(1 + counts).astype(np.float16).view(np.int16)


@dataclass
class Machine:
    """columns: bucket to column. logit = bias + sum of weights + sum of pairs' inner products."""

    columns: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, names: np.ndarray, counts: np.ndarray) -> float:
        x = np.log2(1 + counts.astype(np.float64))
        v = self.factors[names] * x[:, None]
        s = v.sum(axis=0)
        logit = self.bias + self.weights[names] @ x + 0.5 * (s @ s - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, most_columns: int = 1500, rank: int = 6, epochs: int = 14, batch: int = 128, rate: float = 0.03, decay: float = 2e-4, seed: int = 5) -> Machine:
    """rows: buckets of each text, values: log2(1 + count) of each bucket. Logistic loss, Adam, on the buckets that tell the labels apart best by chi-square."""
    y = np.asarray(labels, dtype=np.float32)
    n = len(rows)
    lengths = [len(r) for r in rows]
    flat = np.concatenate([np.zeros(0, np.int32), *rows])
    owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
    names, flat = np.unique(flat, return_inverse=True)
    df = np.bincount(flat, minlength=len(names)).astype(np.float64)
    pos = np.bincount(flat, weights=y[owner], minlength=len(names))
    total = max(1.0, float(y.sum()))
    a, b, c = pos, df - pos, total - pos
    d = n - a - b - c
    chi = n * (a * d - b * c) ** 2 / np.maximum(1e-9, (a + b) * (c + d) * (a + c) * (b + d))
    chi[df < 3] = 0
    chosen = np.argsort(-chi, kind="stable")[:most_columns]
    chosen = np.sort(chosen[chi[chosen] > 0])
    columns = {int(names[x]): k for k, x in enumerate(chosen)}
    m = len(columns)
    if m == 0 or y.min() == y.max():
        rate_of = float(np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3))
        return Machine({}, float(np.log(rate_of / (1 - rate_of))), np.zeros(0), np.zeros((0, rank)))
    at = np.searchsorted(chosen, flat)
    ok = (at < m) & (chosen[np.minimum(at, m - 1)] == flat)
    X = np.zeros((n, m), dtype=np.float32)
    X[owner[ok], at[ok]] = np.concatenate(values)[ok]
    rng = np.random.default_rng(seed)
    P = {"b": np.zeros(1, np.float32), "w": np.zeros(m, np.float32), "v": rng.normal(0, 0.01, (m, rank)).astype(np.float32)}
    M, S, t = {k: np.zeros_like(x) for k, x in P.items()}, {k: np.zeros_like(x) for k, x in P.items()}, 0
    P["b"][0] = np.log(max(1.0, total) / max(1.0, n - total))
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            take = order[k : k + batch]
            x = X[take]
            s, xx = x @ P["v"], x * x
            z = P["b"][0] + x @ P["w"] + 0.5 * ((s * s).sum(1) - xx @ (P["v"] ** 2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) / len(take)
            G = {"b": g.sum(keepdims=True), "w": x.T @ g + decay * P["w"], "v": x.T @ (g[:, None] * s) - P["v"] * (xx.T @ g)[:, None] + decay * P["v"]}
            t += 1
            for p in P:
                M[p] = 0.9 * M[p] + 0.1 * G[p]
                S[p] = 0.999 * S[p] + 0.001 * G[p] ** 2
                P[p] -= rate * (M[p] / (1 - 0.9**t)) / (np.sqrt(S[p] / (1 - 0.999**t)) + 1e-8)
    return Machine(columns, float(P["b"][0]), P["w"].astype(np.float64), P["v"].astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "toxic", key: str = "doc_id", text: str = "text", rows: int = 5000) -> Machine:
    """A machine from a sample of about `rows` labels (never over twice as many) and the documents with their ids.

    labels: columns key and label (0 or 1; null rows teach nothing). `train_rows` is a condition on
    the key column that decides which labels may be learned from. Without labels, the machine scores
    every text 0.001; with one class only, the rate of that class, kept off 0 and 1.
    """
    short_batches(docs.sparkSession)
    known = labels.filter(labels[label].isNotNull() & train_rows).select(F.col(key), F.col(label).cast("int").alias("y"))
    sample = bounded_sample(known, F.col(key), rows)
    texts = docs.select(docs[key], text_column(docs[text]).alias("body")).join(F.broadcast(sample), key).select("y", "body")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Terms()
        for batch in slices(batches):
            got = [of(t) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([logs(g[1]) for g in got], pa.list_(pa.int16()))], names=["y", "terms", "logs"])

    got = texts.mapInArrow(terms, "y int, terms array<int>, logs array<smallint>").toArrow().combine_chunks()
    y = got.column("y").to_numpy()
    bags = [x.values.to_numpy() for x in got.column("terms").combine_chunks()]
    values = [x.values.to_numpy().view(np.float16) for x in got.column("logs").combine_chunks()]
    order = sorted(range(len(bags)), key=lambda k: (int(y[k]), len(bags[k]), bags[k].tobytes()))
    return train([bags[k] for k in order], [values[k] for k in order], y[order])


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns (default doc_id) with score double (0 to 1) and predicted int (1 from `threshold` on).

    Every whole text is scored; a null text counts as empty and gets the machine's bias alone.
    Repeated rows are answered each, an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most most_columns columns
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)], *[] if text in keep else [docs[text].alias("body")])
    body = names[keep.index(text)] if text in keep else "body"  # a kept text goes to the worker once
    schema = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        of = Terms(m.columns)
        for batch in slices(batches):
            s = [m.score(*of(t or "")) for t in batch.column(body).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(s, pa.float64())], names=[*names, "score"])

    out = rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
