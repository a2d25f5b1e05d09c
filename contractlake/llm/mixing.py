"""Mixing sources to target weights by Pareto order sampling.

A source's target, over its size, is the number of copies that each of its documents is due. The
whole part is certain: every document is taken so often. What remains, a fraction f of the source's
words, is a sample without replacement of unequal probabilities: longer documents, which say more per
document start and end, are likelier by f + f (1 - f) (r - m), where r rises from 0 to 1 with the size
and m is its mean over the source's words, so that the expected words are just those that are left.
Each document draws u from a hash of its id and is ranked by its random odds over its inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and the least ranks are taken, up to the size that is left of the target.

The cut is found without sorting a source in one place. Sizes are summed by rank interval, the
interval that holds the cut is divided again, and only documents of the last, narrow interval are
ordered among each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_column, written

#: Rank intervals of each of the two divisions.
INTERVALS = 1024
#: r, of STEPS steps, is half of them at a size of HALF words.
STEPS, HALF = 4096, 256
#: u is a hash of this many hexadecimal digits, so that it is exact in a double.
DIGITS = 12


def uniform(key: Column, seed: str = "mix") -> Column:
    """0 to 1, both excluded, from the md5 of the key as text (null: of the empty string)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**DIGITS))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """sizes: one row per source with source and source_size. Adds weight and target double.

    Sources by code point, null last, weigh `weights`, repeated. They share `percent` of all sizes; a
    target stops at `most` times its source's size and the excess is shared again by weight, until no
    target is above. That is: with sources in the order of size / weight, those are at their limit
    whose limit is not above their share of what the ones before have left.
    """
    every = Window.partitionBy(F.lit(0))  # one row per source
    ranked = sizes.withColumn("n", F.row_number().over(every.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))))
    cycle = F.array(*map(F.lit, weights))
    ranked = ranked.withColumn("weight", F.get(cycle, (F.col("n") - 1) % len(weights)).cast("long")).withColumn("words", F.col("source_size").cast("decimal(20,0)"))
    before = every.orderBy(F.col("source_size") / F.col("weight"), "n").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("words").over(every) * percent
    left = whole - 100 * most * F.coalesce(F.sum("words").over(before), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shared = ranked.withColumn("left", left).withColumn("open", weight)
    # a source is at its limit if limit * open weight <= left * weight
    full = F.col("words") * (100 * most) * F.col("open") <= F.col("left") * F.col("weight")
    capped = shared.withColumn("full", full)
    rest = F.max(F.when(~F.col("full"), F.col("left"))).over(every)
    open_weight = F.max(F.when(~F.col("full"), F.col("open"))).over(every)
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise((F.col("weight") * rest).cast("double") / (open_weight * 100).cast("double"))
    return capped.withColumn("target", target).select("source", "source_size", "weight", "target")


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """docs with the columns m_key, m_source, m_size and m_u before their own."""
    return docs.select(docs[key].alias("m_key"), docs[source].alias("m_source"), F.regexp_count(text_column(docs[text]), F.lit(WORD)).cast("long").alias("m_size"), uniform(docs[key]).alias("m_u"), F.struct(*[docs[c] for c in docs.columns]).alias("d"))


def _rise() -> Column:
    """r of a document in whole steps, so that sums are exact."""
    return F.expr(f"m_size * {STEPS} div (m_size + {HALF})")


def _due(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """Adds what each row is due, and its rank, the ranking ratio x as x / (1 + x).

    shares has one row per source. Spark broadcasts it while its file is under the broadcast
    threshold, and joins by shuffle beyond.
    """
    due = rows.join(shares, F.col("m_source").eqNullSafe(F.col("source")))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    due = due.withColumn("certain", F.floor(copies)).withColumn("f", copies - F.col("certain"))
    f, u, p = F.col("f"), F.col("m_u"), F.col("p")
    lean = (_rise().cast("double") - F.col("lift").cast("double") / F.col("source_size").cast("double")) / STEPS
    due = due.withColumn("p", F.when(f > 0, F.least(F.greatest(f + f * (1 - f) * lean, F.lit(1e-9)), F.lit(1 - 1e-9))))
    due = due.withColumn("odds", (u / (1 - u)) / (p / (1 - p))).withColumn("rank", F.col("odds") / (1 + F.col("odds")))
    scaled = F.col("rank") * INTERVALS
    return due.select(
        *rows.columns,
        *shares.columns,
        F.col("certain").cast("int").alias("certain"),
        (F.col("target") - F.col("certain") * F.col("source_size")).alias("rest"),
        "rank",
        F.floor(scaled).cast("int").alias("i"),
        F.floor((scaled - F.floor(scaled)) * INTERVALS).cast("int").alias("j"),
    )


def _first_over(sums: DataFrame, at: str) -> DataFrame:
    """Of each source the interval in which its rest is reached, and what lies before it."""
    w = Window.partitionBy("source").orderBy(at)
    run = sums.withColumn("upto", F.sum("words").over(w)).withColumn("before", F.col("upto") - F.col("words"))
    return run.filter((F.col("before") < F.col("rest")) & (F.col("upto") >= F.col("rest")))


def _place() -> Column:
    return F.struct("rank", F.col("m_key").isNull().alias("no"), F.col("m_key").alias("key"), F.col("m_size").alias("size"))


def _cuts(docs: DataFrame, key: str, text: str, source: str, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """One row per source: source, source_size, lift, target, cut_i, cut_j, bound (the last place that is taken in the cut interval), of_bound and with_bound (how many rows of that place are taken, and how many there are)."""
    sized = written(_sized(docs, key, text, source).drop("d"), "sized")
    sums = sized.groupBy(F.col("m_source").alias("source")).agg(F.sum("m_size").alias("source_size"), F.sum(F.col("m_size") * _rise()).alias("lift"))
    sums = written(sums, "sources")
    shares = written(targets(sums, weights, percent, most).join(sums.select(F.col("source").alias("s0"), "lift"), F.col("source").eqNullSafe(F.col("s0"))).select("source", "source_size", "lift", "target"), "targets")
    drawn = _due(sized, shares).filter("rank is not null")
    outer = _first_over(drawn.groupBy("source", "i").agg(F.sum("m_size").alias("words"), F.first("rest").alias("rest")), "i")
    outer = written(outer.select(F.col("source").alias("s1"), F.col("i").alias("cut_i"), F.col("before").alias("before_i")), "outer")
    inside = drawn.join(outer, F.col("source").eqNullSafe(F.col("s1")) & (F.col("i") == F.col("cut_i")))
    inner = _first_over(inside.groupBy("source", "j").agg(F.sum("m_size").alias("words"), F.first(F.col("rest") - F.col("before_i")).alias("rest")), "j")
    inner = written(inner.select(F.col("source").alias("s2"), F.col("j").alias("cut_j"), F.col("before").alias("before_j"), F.col("rest").alias("rest_j")), "inner")
    # rows of one place, equal in key and size, are one row with a number
    last = inside.join(inner, F.col("source").eqNullSafe(F.col("s2")) & (F.col("j") == F.col("cut_j"))).groupBy("source", _place().alias("place")).agg(F.count("*").alias("rows"), F.first(F.col("rest_j") - F.col("before_j")).alias("rest"))
    size = F.col("place.size")
    w = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    short = last.withColumn("short", F.col("rest") - F.coalesce(F.sum(size * F.col("rows")).over(w), F.lit(0)))
    # a document goes in while that brings the words nearer to the target
    fits = F.when(size == 0, F.col("rows")).otherwise(F.least(F.col("rows"), F.floor(F.col("short") / F.greatest(size, F.lit(1)) + 0.5).cast("long")))
    taken = short.filter("short > 0").withColumn("fits", fits).filter("fits > 0")
    bound = taken.groupBy(F.col("source").alias("s3")).agg(F.max(F.struct("place", "fits", "rows")).alias("b"))
    found = outer.join(inner, F.col("s1").eqNullSafe(F.col("s2")), "left").join(bound, F.col("s1").eqNullSafe(F.col("s3")), "left")
    found = shares.join(found, F.col("source").eqNullSafe(F.col("s1")), "left")
    return written(found.select(*shares.columns, "cut_i", "cut_j", F.col("b.place").alias("bound"), F.col("b.fits").alias("of_bound"), F.col("b.rows").alias("with_bound")), "cuts")


def _copies(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    due = _due(rows, cuts)
    at = F.coalesce(F.col("i").eqNullSafe(F.col("cut_i")) & F.col("j").eqNullSafe(F.col("cut_j")) & (_place() == F.col("bound")), F.lit(False))
    here = (F.col("i") == F.col("cut_i")) & ((F.col("j") < F.col("cut_j")) | ((F.col("j") == F.col("cut_j")) & F.col("bound").isNotNull() & (_place() <= F.col("bound"))))
    extra = F.when(F.col("rank").isNull(), 0).when(F.col("cut_i").isNull(), (F.col("rest") > 0).cast("int")).when(F.col("i") < F.col("cut_i"), 1).when(here, 1).otherwise(0)
    plain = due.withColumn("copies", F.col("certain") + extra)
    if cuts.filter("of_bound < with_bound").isEmpty():
        return plain
    # some of the equal rows at a cut go in: they are numbered file part by file part, so that many are no one task's work
    divided = at & (F.col("of_bound") < F.col("with_bound"))
    edge = written(due.filter(divided), "edge").withColumn("part", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id())
    parts = written(edge.groupBy("source", "part").agg(F.count("*").alias("n")), "edge-parts")
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("source").alias("s4"), F.col("part").alias("part4"), ahead.alias("ahead"))
    numbered = edge.withColumn("number", F.row_number().over(Window.partitionBy("source", "part").orderBy("line"))).join(parts, F.col("source").eqNullSafe(F.col("s4")) & (F.col("part") == F.col("part4")))
    split = numbered.withColumn("copies", F.col("certain") + (F.col("ahead") + F.col("number") <= F.col("of_bound")).cast("int"))
    return plain.filter(~divided).unionByName(split.select(*plain.columns))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """One row per document: key, size long, source_size long, target double, copies int, taken long.

    size is the number of words, 0 for a null text; such documents are taken with no words. copies is
    how often the mix holds the document, 0 to `most`; taken is copies times size. A source's taken
    words differ from its target by at most half the size of one document. Reruns agree: the draw
    depends on key and size alone; of rows that agree in both, as many are taken as the cut leaves
    room for, whichever they are. A very long text is one document like others. An empty table gives
    no rows.
    """
    rows = _copies(_sized(docs, key, text, source).drop("d"), _cuts(docs, key, text, source, weights, percent, most))
    return rows.select(F.col("m_key").alias(key), F.col("m_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("m_size")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """docs as the mix holds them: each document in as many rows as it has copies. No text is shuffled."""
    rows = _copies(_sized(docs, key, text, source), _cuts(docs, key, text, source, weights, percent, most)).filter("copies > 0")
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col("d")[c].alias(c) for c in docs.columns])


#: DuckDB twin at the default parameters, over the table documents.
SQL = r"""
WITH counted AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
sized AS (SELECT *, size * 4096 // (size + 256) AS r FROM counted),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * r)::BIGINT AS lift FROM sized GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS n FROM sources),
weighed AS (SELECT *, [5, 2, 1][((n - 1) % 3 + 1)::INT] AS weight FROM numbered),
run AS (SELECT *, 150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open_weight
  FROM weighed WINDOW b AS (ORDER BY source_size::DOUBLE / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, source_size * 200 * open_weight <= rest * weight AS at_limit FROM run),
targets AS (SELECT source, source_size, lift, CASE WHEN at_limit THEN (source_size * 2)::DOUBLE
    ELSE (weight * max(CASE WHEN NOT at_limit THEN rest END) OVER ())::DOUBLE / (100 * max(CASE WHEN NOT at_limit THEN open_weight END) OVER ())::DOUBLE END AS target FROM judged),
due AS (SELECT s.*, t.source_size, t.lift, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS copies
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
parts AS (SELECT *, floor(copies)::BIGINT AS certain, copies - floor(copies) AS f FROM due),
chances AS (SELECT *, CASE WHEN f > 0 THEN least(greatest(f + f * (1 - f) * ((r::DOUBLE - lift::DOUBLE / source_size::DOUBLE) / 4096), 1e-9::DOUBLE), 1::DOUBLE - 1e-9::DOUBLE) END AS p FROM parts),
odds AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS x, target - certain * source_size AS rest FROM chances),
ranks AS (SELECT *, x / (1 + x) AS o FROM odds),
ahead AS (SELECT *, rest - coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS short FROM ranks)
SELECT doc_id, size, source_size, target, (certain + CASE WHEN o IS NOT NULL AND short > 0 AND 2 * short >= size THEN 1 ELSE 0 END)::INT AS copies,
  ((certain + CASE WHEN o IS NOT NULL AND short > 0 AND 2 * short >= size THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM ahead
"""
