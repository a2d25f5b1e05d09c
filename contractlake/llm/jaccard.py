"""N-gram Jaccard self join with a MinHash LSH forest.

Texts equal as strings are one text. A text's signature is cut into trees; in each tree its minhash
values, in order, are a path of a trie. The paths are sorted, so a node of a trie, all paths with one
prefix, is a run of rows, and its size is known at every depth from the shortest prefix on.

How far a text's prefixes are shortened depends on the text and on the tree. At first they are whole.
Then they are shortened where that brings the least company, up to a limit of company that grows until
the product of the chances to miss a partner at the threshold, over all trees, is at most 1 - recall:
prefixes become short where the trie is sparse and stay long where many texts crowd in a node. Two
texts are candidates if in some tree they share the prefix that one of them ended with.

Each candidate pair is verified exactly on its shingle sets, once. The texts of a node meet under its
least text, the hub; the nodes of one hub form one group, large groups are cut into blocks, and a pair
that meets in several trees belongs to the hub of the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import short_batches, slices, text_column, written
from .graph import components

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Values of a path, and of the shortest prefix; a value has 16 bits.
DEPTH, SHORTEST = 8, 4
DEPTHS = range(SHORTEST, DEPTH + 1)


class Shingles:
    """64-bit hashes of a text's distinct n-grams of words; a shorter text with a word has itself as its one n-gram.

    Takes the text's UTF-8 bytes. All words are hashed at once: each byte stands for a random number,
    these are weighted by place and summed over the word, and the sum is mixed.
    """

    LONG = 256  # a word of more bytes is hashed by itself

    def __init__(self, n: int, seed: int = 31) -> None:
        self.n = n
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 1 << 64, size=256, dtype=np.uint64)
        self.byte[[32, *range(9, 14)]] = 0  # white space adds nothing
        self.place = np.cumprod(np.full(self.LONG + 1, 0xD6E8FEB86659FD93, dtype=np.uint64))

    def words(self, raw: bytes) -> np.ndarray:
        of = self.byte[np.frombuffer(raw, dtype=np.uint8)]
        blank = np.ones(len(of) + 2, dtype=bool)
        blank[1:-1] = of == 0
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        of = of[starts[0] :]
        place = np.arange(len(of)) - np.repeat(starts - starts[0], np.diff(np.append(starts, starts[0] + len(of))))
        h = np.add.reduceat(of * self.place[np.minimum(place, self.LONG)], starts - starts[0])
        for k in np.flatnonzero(ends - starts > self.LONG):
            h[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8).digest(), "little")
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h ^ (h >> np.uint64(29))

    def __call__(self, raw: bytes) -> np.ndarray:
        h = self.words(raw)
        if not len(h):
            return h
        k = min(self.n, len(h))
        out = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for i in range(k):
            out ^= h[i : len(h) - k + 1 + i]
            out *= _MIX
            out ^= out >> np.uint64(29)
        out.sort()
        return out[np.append(True, out[1:] != out[:-1])]


def _seeds(count: int, seed: int = 29) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, size=(2, count, 1), dtype=np.uint32) | np.array([[[1]], [[0]]], dtype=np.uint32)


def paths(shingles: np.ndarray, seeds: np.ndarray, step: int = 512) -> np.ndarray:
    """Of each tree two 64-bit numbers: the first four values of its path, and the last four."""
    odd, flip = seeds
    s = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    least = np.full(odd.shape[0], 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, s.shape[1], step):
        x = s[:, k : k + step] ^ flip
        x *= odd
        np.minimum(least, x.min(axis=1), out=least)
    values = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint64).reshape(-1, 4)
    return ((values[:, 0] << np.uint64(48)) | (values[:, 1] << np.uint64(32)) | (values[:, 2] << np.uint64(16)) | values[:, 3]).view(np.int64)


def least_trees(threshold: float, recall: float) -> int:
    """So many trees reach the recall at the threshold if all prefixes are as short as they get."""
    miss = np.log1p(-(min(float(threshold), 1 - 1e-9) ** SHORTEST))
    return int(np.ceil(np.log1p(-recall) / miss))


def shorten(company: np.ndarray, owner: np.ndarray, texts: int, trees: int, threshold: float, recall: float) -> np.ndarray:
    """The depth at which each row's prefix ends.

    company: one row for each text and tree in which the text shares its shortest prefix; the numbers
    of texts that share the prefixes of each depth, from the shortest on. owner: the row's text. In
    trees without a row the prefix is shortened as far as it goes, at no cost. `trees` is at least least_trees.
    """
    miss = np.log1p(-(min(float(threshold), 1 - 1e-9) ** np.maximum(1, np.arange(DEPTH + 1))))
    goal = np.log1p(-recall)
    alone = (trees - np.bincount(owner, minlength=texts)) * miss[SHORTEST]
    depth = np.full(len(owner), -1)
    limit = 0
    while (depth < 0).any():
        fits = company <= limit
        at = np.where(fits.any(axis=1), SHORTEST + fits.argmax(axis=1), DEPTH)
        met = (alone + np.bincount(owner, weights=miss[at], minlength=texts) <= goal) | (limit > company.max())
        depth = np.where((depth < 0) & met[owner], at, depth)
        limit = max(1, limit * 2)
    return depth


def tries(texts: DataFrame, trees: int, threshold: float, recall: float) -> DataFrame:
    """texts: id, paths (two numbers a tree). Rows id, tree, hub (64 bits) for each text and tree in which it has company.

    Rows of one shortest prefix meet in one task: id and three numbers each, sorted outside memory if
    they are many. Nothing but their counts and the least id is taken of them.
    """
    tail = [F.shiftright("q", 16 * (DEPTH - d)).alias(f"q{d}") for d in DEPTHS[1:]]
    nodes = {d: ["tree", "p", *(f"q{k}" for k in range(SHORTEST + 1, d + 1))] for d in DEPTHS}
    rows = texts.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.get("paths", 2 * t).alias("p"), F.get("paths", 2 * t + 1).alias("q")))).alias("x")).select("id", "x.*")
    rows = rows.repartition("tree", "p").withColumn(f"n{SHORTEST}", F.count("*").over(Window.partitionBy("tree", "p"))).filter(f"n{SHORTEST} > 1").select("*", *tail)
    for d in reversed(DEPTHS[1:]):
        rows = rows.withColumn(f"n{d}", F.count("*").over(Window.partitionBy(*nodes[d])))
    # at most one entry a tree
    company = rows.groupBy("id").agg(F.collect_list(F.struct("tree", "p", "q", *(f"n{d}" for d in DEPTHS))).alias("met"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = batch.column("met")
            owner = np.repeat(np.arange(batch.num_rows), met.value_lengths().to_numpy())
            flat = pa.Table.from_batches([pa.RecordBatch.from_struct_array(met.flatten())]).combine_chunks()
            if not len(owner):
                continue
            counts = np.stack([flat.column(f"n{d}").to_numpy() for d in DEPTHS], axis=1) - 1
            ends = shorten(counts, owner, batch.num_rows, trees, threshold, recall)
            columns = [batch.column("id").take(pa.array(owner)), *(flat.column(c).combine_chunks() for c in ("tree", "p", "q")), pa.array(ends.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["id", "tree", "p", "q", "ends"])

    ended = company.mapInArrow(choose, "id binary, tree int, p long, q long, ends int").repartition("tree", "p").select("*", *tail)
    for d in reversed(DEPTHS):
        node = Window.partitionBy(*nodes[d])
        # a node at which one text's prefix ends brings all its texts together
        ended = ended.withColumn(f"at{d}", F.when(F.max(F.col("ends") == d).over(node), F.struct(F.count("*").over(node).alias("n"), F.min("id").over(node).alias("hub"))))
    first = F.coalesce(*(f"at{d}" for d in DEPTHS))
    return ended.select("id", "tree", first.alias("at")).filter("at.n > 1").select("id", "tree", F.xxhash64("at.hub").alias("hub"))


def similar(sets: list[np.ndarray], others: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, exactly: a boolean matrix of sets by others (by themselves: without the diagonal)."""
    rows = sets if others is None else sets + others
    sizes = np.array([len(s) for s in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    cut = len(sets)
    right = slice(0, cut) if others is None else slice(cut, len(rows))
    inter = np.zeros((cut, len(rows[right])), dtype=np.float32)
    if len(column):
        names, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        step = max(64, 8_000_000 // len(rows))
        for k in range(0, len(names), step):
            a, b = np.searchsorted(column, (k, k + step))
            x = np.zeros((len(rows), min(step, len(names) - k)), dtype=np.float32)
            x[owner[a:b], column[a:b] - k] = 1
            inter += x[:cut] @ x[right].T
    union = sizes[:cut, None] + sizes[right][None, :] - inter
    out = (inter >= threshold * union - 1e-6) & (union > 0)
    if others is None:
        np.fill_diagonal(out, False)
    return out


def candidates(own: np.ndarray, other: np.ndarray | None, group: int) -> np.ndarray:
    """Pairs (i, j) that belong to the group: the first tree in which both have the same hub has this one. own, other: hubs by tree, 0 for none; without other: pairs i < j of own."""
    right = own if other is None else other
    found = np.zeros((len(own), len(right)), dtype=bool)
    open_ = np.ones_like(found)
    if other is None:
        open_ = np.triu(open_, 1)
    for t in range(own.shape[1]):
        same = (own[:, t, None] == right[None, :, t]) & (own[:, t, None] != 0) & open_
        found |= same & (own[:, t, None] == group)
        open_ &= ~same
    return np.argwhere(found)


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the pairs that reach the threshold: one by one, or all by matrix products where they are many."""
    other = left if right is None else right
    m, n = np.array([len(s) for s in left])[pairs[:, 0]], np.array([len(s) for s in other])[pairs[:, 1]]
    pairs = pairs[np.minimum(m, n) >= threshold * np.maximum(m, n) - 1e-6]
    if len(pairs) > 8 * (len(left) + len(other)):
        return pairs[similar(left, right, threshold)[pairs[:, 0], pairs[:, 1]]]
    ok = np.zeros(len(pairs), dtype=bool)
    for k, (i, j) in enumerate(pairs):
        both = len(np.intersect1d(left[i], other[j], assume_unique=True))
        ok[k] = both >= threshold * (len(left[i]) + len(other[j]) - both) - 1e-6
    return pairs[ok]


def _roots(size: int, pairs: np.ndarray) -> np.ndarray:
    """The least index that each index reaches over the pairs."""
    root = np.arange(size)
    while True:
        least = root.copy()
        np.minimum.at(least, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(least, pairs[:, 1], root[pairs[:, 0]])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _verify(rows: pd.DataFrame, trees: int, threshold: float) -> pd.DataFrame:
    """Verify one block, or one pair of blocks, of each group that the rows hold."""
    out: list[tuple] = []
    for (hub, i, j), g in rows.groupby(["hub", "i", "j"], sort=False):
        if len(g) < 2:
            continue
        hubs = np.zeros((len(g), trees), dtype=np.int64)
        hubs[np.repeat(np.arange(len(g)), g["trees"].map(len)), np.concatenate(g["trees"].to_list())] = np.concatenate(g["hubs"].to_list())
        own = (g["block"] == i).to_numpy()
        sets, ids = g["shingles"].to_list(), g["id"].to_numpy()
        if i == j:
            pairs = _linked(sets, None, candidates(hubs, None, hub), threshold)
        else:
            a, b = np.flatnonzero(own), np.flatnonzero(~own)
            pairs = _linked([sets[k] for k in a], [sets[k] for k in b], candidates(hubs[a], hubs[b], hub), threshold)
            pairs = np.stack([a[pairs[:, 0]], b[pairs[:, 1]]], axis=1)
        if len(pairs):
            degree, root = np.bincount(pairs.ravel(), minlength=len(g)), _roots(len(g), pairs)
            out += [(ids[k], int(degree[k]), ids[root[k]]) for k in np.flatnonzero(degree)]
    return pd.DataFrame(out, columns=["id", "links", "root"])


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, trees: int | None = None, recall: float = 0.99999, block: int = 1024, block_shingles: int = 1_000_000) -> DataFrame:
    """One row per document: key, class_id, n_links long, n_copies long, first boolean.

    Linked are different texts with n-gram Jaccard similarity `threshold` or more; a text with fewer
    than n words, but one at least, is a single n-gram of all its words. class_id is the least key of
    the documents connected over links and equal texts. n_links counts the linked different texts,
    n_copies the other documents with the same text. first marks the document that stays: the one
    with the least (key, text hash) of its class; rows equal in key and text are all marked. Nulls
    sort last. A null text, and one without a word, links to nothing and is its own class; its
    n_copies is 0. No link is capped; at the threshold itself a pair is missed with a probability of
    at most 1 - recall, and less above it. trees: 32, or as many more as a low threshold takes (42 at
    0.7, 179 at 0.5); a number that can't hold the recall is refused. A text of any length is taken whole; blocks of a group hold
    about `block` texts and `block_shingles` shingles, or one text. An empty table gives no rows.
    """
    return _classes(docs, key, text, n, threshold, trees, recall, block, block_shingles).select(F.col("key").alias(key), "class_id", "n_links", "n_copies", "first")


def _classes(docs: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8, trees: int | None = None, recall: float = 0.99999, block: int = 1024, block_shingles: int = 1_000_000) -> DataFrame:
    """jaccard_classes with the columns kh and id, hashes of key and text."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError("threshold is above 0 and at most 1, recall between both")
    needed = least_trees(threshold, recall)
    trees = max(32, needed) if trees is None else trees
    if trees < needed:
        raise ValueError(f"a recall of {recall} at {threshold} takes {needed} trees or more")
    short_batches(docs.sparkSession)
    seeds = _seeds(trees * DEPTH)
    rows = docs.select(docs[key].alias("key"), text_column(docs[text]).alias("body"))
    identity: Column = F.unhex(F.md5("body"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in slices(batches):
            found = [shingles(t) for t in batch.column("body").cast(pa.binary()).to_pylist()]
            signed = pa.array([paths(s, seeds) if len(s) else None for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), signed, pa.array(map(len, found), pa.int64())], names=["key", "id", "paths", "size"])

    kind = docs.schema[key].dataType.simpleString()
    signed = written(rows.withColumn("id", identity).select("key", "id", "body").mapInArrow(sign, f"key {kind}, id binary, paths array<bigint>, size bigint"), "signed")
    # least key of each different text, and how often it occurs; nulls last
    least = F.min(F.struct(F.col("key").isNull().alias("no"), "key"))
    texts = written(signed.filter("size > 0").groupBy("id").agg(least.alias("least"), F.count("*").alias("copies"), F.first("paths").alias("paths"), F.first("size").alias("size")), "texts")
    # at most one entry a tree
    met = tries(texts, trees, threshold, recall).groupBy("id").agg(F.collect_list(F.struct("tree", "hub")).alias("met"))
    met = met.join(texts.select("id", "size", F.xxhash64("least.key").alias("kh")), "id").select("id", "kh", "size", F.col("met.tree").alias("trees"), F.col("met.hub").alias("hubs"))
    met = written(met, "met")

    # blocks of large groups; each text goes once to every block that its own is compared with
    members = met.select("id", F.explode(F.array_distinct("hubs")).alias("hub"), "size")
    sizes = members.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / block_shingles)).alias("blocks"), F.count("*").alias("members"))
    bodies = rows.select(F.xxhash64("key").alias("kh"), identity.alias("id"), "body").join(met, ["kh", "id"]).dropDuplicates(["kh", "id"]).select("id", "trees", "hubs", "body")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in slices(batches):
            found = pa.array([shingles(t).view(np.int64) for t in batch.column("body").cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "trees", "hubs")), found], names=["id", "trees", "hubs", "shingles"])

    sets = bodies.mapInArrow(cut, "id binary, trees array<int>, hubs array<bigint>, shingles array<bigint>")
    placed = sets.select("*", F.explode(F.array_distinct("hubs")).alias("hub")).join(sizes, "hub").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select("hub", "id", "trees", "hubs", "shingles", "blocks", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # small groups share a bin, so that no task starts for each of them
    bins = max(1, sizes.count() // 200)
    tasks = tasks.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("hub"), F.lit(bins))).otherwise(F.xxhash64("hub", "i", "j"))).drop("blocks")
    verified = written(tasks.groupBy("bin").applyInPandas(lambda g: _verify(g, trees, threshold), "id binary, links bigint, root binary"), "verified")

    linked = components(verified.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    links = verified.groupBy("id").agg(F.sum("links").alias("n_links"))
    known = texts.join(linked, "id", "left").join(links, "id", "left").select("id", "least", "copies", F.coalesce("root", "id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = written(known, "known")
    top = known.groupBy("root").agg(F.min(F.struct("least", "id")).alias("top"))
    of = known.join(top, "root").select("id", "copies", "n_links", "top")
    # a text that many documents share is split by Spark's skew join; its rows are small
    own = signed.select("key", "id", (F.col("size") > 0).alias("worded")).join(of, "id", "left")
    worded = F.col("worded")
    return own.select(
        "key",
        F.xxhash64("key").alias("kh"),
        "id",
        F.when(worded, F.col("top.least.key")).otherwise(F.col("key")).alias("class_id"),
        F.when(worded, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        F.when(worded, F.col("copies") - 1).otherwise(0).cast("long").alias("n_copies"),
        F.when(worded, (F.col("id") == F.col("top.id")) & F.col("key").eqNullSafe(F.col("top.least.key"))).otherwise(True).alias("first"),
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings: object) -> DataFrame:
    """docs with one document of each class, and all documents without a word. Rows equal in key and text are one document: one of them stays."""
    gone = _classes(docs, key, text, **settings).filter(~F.col("first")).select("kh", "id").distinct()
    rows = docs.select(F.xxhash64(docs[key]).alias("kh"), F.unhex(F.md5(text_column(docs[text]))).alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("d"))
    kept = rows.join(gone, ["kh", "id"], "left_anti").dropDuplicates(["kh", "id"])
    return kept.select(*[F.col("d")[c].alias(c) for c in docs.columns])


#: DuckDB twin at the default parameters, over the table documents: all pairs that share an n-gram.
SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
texts AS (SELECT text, min(doc_id) AS least, count(*) AS copies, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs GROUP BY text),
t AS (SELECT *, row_number() OVER (ORDER BY md5(text)) AS id FROM texts WHERE len(w) > 0),
grams AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM t),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM grams a JOIN grams b ON a.s = b.s AND a.id <> b.id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE c >= 0.8 * (x.n + y.n - c)),
reach(a, b) AS (SELECT id, id FROM t UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS id, min({'k': t.least, 'm': md5(t.text)}) AS top FROM reach JOIN t ON t.id = b GROUP BY a),
degrees AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, CASE WHEN t.id IS NULL THEN d.doc_id ELSE c.top.k END AS class_id, coalesce(g.n, 0)::BIGINT AS n_links, coalesce(t.copies - 1, 0)::BIGINT AS n_copies,
  t.id IS NULL OR (d.doc_id IS NOT DISTINCT FROM c.top.k AND md5(d.text) = c.top.m) AS first
FROM docs d LEFT JOIN t ON t.text = d.text LEFT JOIN classes c ON c.id = t.id LEFT JOIN degrees g ON g.id = t.id
"""
