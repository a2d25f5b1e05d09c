"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (character classes and their successions,
repetition and word lengths, then one learned layer); a gated attention gives each passage a weight,
the weights sum to 1 over the document, and the weighted mean of the encodings is scored. Only the
document's label is known in training, so the attention itself is learned from it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, short_batches, slices, text_column

WORDS = 64
#: Character classes of the encoding, by byte; bytes of 128 and more are letters beyond ASCII.
GROUPS = [b" ", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!?", b"'\"()-", b"#*$%&", b"|<>{}[]", b"@/\\_=+~^`"]
CLASSES = len(GROUPS) + 2
_TABLE = bytes(next((k for k, g in enumerate(GROUPS) if bytes([b]) in g), len(GROUPS) if b >= 128 else len(GROUPS) + 1) for b in range(256))
FEATURES = CLASSES + CLASSES**2 + 6


def passages(text: str) -> np.ndarray:
    """One row of features for each run of WORDS words; an empty text is one passage of zeros."""
    words = text.split()
    if not words:
        return np.zeros((1, FEATURES), dtype=np.float32)
    out = np.zeros((-(-len(words) // WORDS), FEATURES), dtype=np.float32)
    for k in range(len(out)):
        w = words[k * WORDS : (k + 1) * WORDS]
        raw = " ".join(w).encode("utf-8", "replace")
        c = np.frombuffer(raw.translate(_TABLE), dtype=np.uint8)
        n = len(c)
        out[k, :CLASSES] = np.bincount(c, minlength=CLASSES) / n
        pairs = c[:-1].astype(np.int64) * CLASSES + c[1:]
        out[k, CLASSES : CLASSES + CLASSES**2] = np.bincount(pairs, minlength=CLASSES**2) / n
        counts = Counter(w)
        same = sum(a == b for a, b in zip(w, w[1:]))
        out[k, -6:] = (len(counts) / len(w), max(counts.values()) / len(w), same / len(w), min(n / len(w), 40) / 10, np.log1p(len(w)) / 4, np.log1p(len(words)) / 8)
    return out


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


@dataclass
class Model:
    """mean, scale: of the features. E encodes; V, U and w are the gated attention; o and b score."""

    mean: np.ndarray
    scale: np.ndarray
    P: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        P = self.P
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ P["E"] + P["e"])
        tv, su = np.tanh(h @ P["V"]), 1 / (1 + np.exp(-(h @ P["U"])))
        a = (tv * su) @ P["w"]
        a = np.exp(a - np.maximum.reduceat(a, starts)[owner])
        a /= _sums(a, starts)[owner]
        z = _sums(a[:, None] * h, starts)
        logit = z @ P["o"] + P["b"][0]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), {"x": x, "h": h, "tv": tv, "su": su, "a": a, "z": z, "owner": owner}

    def backward(self, g: np.ndarray, c: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        """g: slope of the loss for each bag's logit."""
        P = self.P
        dz = g[:, None] * P["o"]
        dzo = dz[c["owner"]]
        da = (dzo * c["h"]).sum(1)
        da = c["a"] * (da - _sums(c["a"] * da, starts)[c["owner"]])
        dg = da[:, None] * P["w"]
        dtv, dsu = dg * c["su"] * (1 - c["tv"] ** 2), dg * c["tv"] * c["su"] * (1 - c["su"])
        dh = c["a"][:, None] * dzo + dtv @ P["V"].T + dsu @ P["U"].T
        dx = dh * (1 - c["h"] ** 2)
        return {"E": c["x"].T @ dx, "e": dx.sum(0), "V": c["h"].T @ dtv, "U": c["h"].T @ dsu, "w": ((c["tv"] * c["su"]) * da[:, None]).sum(0), "o": c["z"].T @ g, "b": g.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, width: int = 24, gate: int = 12, epochs: int = 12, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 3) -> Model:
    y = np.asarray(labels, dtype=np.float32)
    rng = np.random.default_rng(seed)
    rows = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    normal = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
    P = {"E": normal(FEATURES, width), "e": np.zeros(width, np.float32), "V": normal(width, gate), "U": normal(width, gate), "w": np.zeros(gate, np.float32), "o": np.zeros(width, np.float32), "b": np.zeros(1, np.float32)}
    rate_of = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    P["b"][0] = np.log(rate_of / (1 - rate_of))
    model = Model(rows.mean(0), rows.std(0) + 1e-3, P)
    if not len(y) or y.min() == y.max():
        return model
    M, S, t = {k: np.zeros_like(x) for k, x in P.items()}, {k: np.zeros_like(x) for k, x in P.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            take = order[k : k + batch]
            starts = np.cumsum([0] + [len(bags[i]) for i in take[:-1]])
            p, cache = model.forward(np.concatenate([bags[i] for i in take]), starts)
            G = model.backward(((p - y[take]) / len(take)).astype(np.float32), cache, starts)
            t += 1
            for q in P:
                g = G[q] + decay * P[q]
                M[q] = 0.9 * M[q] + 0.1 * g
                S[q] = 0.999 * S[q] + 0.001 * g * g
                P[q] -= rate * (M[q] / (1 - 0.9**t)) / (np.sqrt(S[q] / (1 - 0.999**t)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = 4000) -> Model:
    """A model from a sample of about `rows` labels (never over twice as many) and the documents with their ids.

    Null labels teach nothing. Without labels every text scores 0.5; with one class only, the rate of
    that class, kept off 0 and 1.
    """
    short_batches(docs.sparkSession)
    known = labels.filter(labels[label].isNotNull() & train_rows).select(F.col(key), F.col(label).cast("int").alias("y"))
    sample = bounded_sample(known, F.col(key), rows)
    texts = docs.select(docs[key], text_column(docs[text]).alias("body")).join(F.broadcast(sample), key).select("y", "body")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([passages(t).astype(np.float16).tobytes() for t in batch.column("body").to_pylist()], pa.binary())], names=["y", "bag"])

    got = sorted((int(y), bytes(b)) for y, b in texts.mapInArrow(encode, "y int, bag binary").collect())
    return train([np.frombuffer(b, np.float16).reshape(-1, FEATURES).astype(np.float32) for _, b in got], np.array([y for y, _ in got]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns (default doc_id) with score double (0 to 1), predicted int (1 from `threshold` on), n_passages long and top_weight double (the largest attention weight).

    All passages of every whole text count; a null text counts as empty, one passage of zeros. Repeated
    rows are answered each, an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)], text_column(docs[text]).alias("body"))
    schema = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + ["score double, n_passages long, top_weight double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, 64):
            bags = [passages(t) for t in batch.column("body").to_pylist()]
            starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
            p, cache = m.forward(np.concatenate(bags), starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(p.astype(np.float64)), pa.array([len(b) for b in bags], pa.int64()), pa.array(np.maximum.reduceat(cache["a"], starts).astype(np.float64))],
                names=[*names, "score", "n_passages", "top_weight"],
            )

    out = rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "score", "n_passages", "top_weight")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
