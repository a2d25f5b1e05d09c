"""Repeated runs of lines, found by winnowing over line hashes. DataFrame operations only.

A text is its sequence of lines with a word. From each line starts a gram, the shortest run of lines
with `gram_words` words. Of the grams that start within `window_words` words, the one with the least
hash is a fingerprint. A run of lines with gram_words + window_words - 1 words or more holds all
grams of one such window, so wherever the run repeats the same gram is chosen: equal runs of that
length always share a fingerprint.

Where a fingerprint occurs in more than one place, the runs around it are compared: the shortest run of
`min_words` words from each line on, and the shortest up to each line. A longer run is covered by those
in it. Of equal runs the first in the order (id, text hash, line) is no reason to delete; the lines of
all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import WORD, written

_LAST = (1 << 63) - 1


def line_hash(line: Column) -> Column:
    """60 bits of the md5."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def _keys(docs: DataFrame, key: str, text: str) -> list[Column]:
    """Order id (null: last), in the order of the key's own type, and text hash: rows that agree in both are one document."""
    whole = isinstance(docs.schema[key].dataType, IntegralType)
    order = F.coalesce(docs[key].cast("long"), F.lit(_LAST)) if whole else F.struct(docs[key].isNull().alias("none"), docs[key].alias("key"))
    return [order.alias("o"), F.xxhash64(docs[text]).alias("th")]


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line with a word: o, th, pos (from 0, blank lines counted), lno (from 1, not counted), h, words, before (words of the lines above)."""
    rows = docs.filter(docs[text].isNotNull()).select(*_keys(docs, key, text), docs[text].alias("t"))
    split = rows.select("o", "th", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    found = split.select("o", "th", "pos", line_hash(F.col("line")).alias("h"), F.regexp_count("line", F.lit(WORD)).alias("words")).filter("words > 0")
    w = Window.partitionBy("o", "th").orderBy("pos")
    return (
        found.repartition("o", "th")
        .dropDuplicates(["o", "th", "pos"])
        .withColumn("lno", F.row_number().over(w))
        .withColumn("before", F.sum("words").over(w) - F.col("words"))
    )


def fingerprints(table: DataFrame, gram_words: int, window_words: int) -> DataFrame:
    """table with g and mark (line): the fingerprint of the window that starts at each line; null where no gram is whole."""
    w = Window.partitionBy("o", "th").orderBy("before")
    gram = w.rangeBetween(0, gram_words - 1)
    grams = table.withColumn("total", F.sum("words").over(gram)).withColumn("g", F.when(F.col("total") >= gram_words, line_hash(F.concat_ws(",", F.collect_list("h").over(gram)))))
    least = F.min(F.when(F.col("g").isNotNull(), F.struct("g", "lno"))).over(w.rangeBetween(0, window_words - 1))
    return grams.select(*table.columns, least.alias("least")).select(*table.columns, "least.g", F.col("least.lno").alias("mark"))


def shared(prints: DataFrame) -> DataFrame:
    """o, th, marks: lines of a document's fingerprints that occur in more than one place."""
    found = prints.filter("g is not null").select("o", "th", "g", "mark").distinct()
    twice = found.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    return found.join(twice, "g").groupBy("o", "th").agg(F.collect_list("mark").alias("marks"))


def runs(prints: DataFrame, min_words: int) -> DataFrame:
    """o, th, start, end (lines), key: the least runs of min_words words from each line on and up to each line, where their first window's fingerprint is shared."""
    marked = prints.join(shared(prints), ["o", "th"]).withColumn("hit", F.coalesce(F.array_contains("marks", F.col("mark")), F.lit(False))).withColumn("upto", F.col("before") + F.col("words"))
    per = Window.partitionBy("o", "th")
    on, back = per.orderBy("before").rangeBetween(0, min_words - 1), per.orderBy("upto").rangeBetween(1 - min_words, 0)

    def run(w, start: Column, end: Column, ok: Column) -> Column:
        key = F.unhex(F.md5(F.concat_ws(",", F.collect_list("h").over(w))))
        return F.when(ok & (F.sum("words").over(w) >= min_words), F.struct(start.alias("start"), end.alias("end"), key.alias("key")))

    ahead = marked.withColumn("ahead", run(on, F.col("lno"), F.max("lno").over(on), F.col("hit")))
    start = F.min("lno").over(back)
    both = ahead.withColumn("behind", run(back, start, F.col("lno"), F.first("hit").over(back) & ~F.coalesce(F.first("ahead.end").over(back) == F.col("lno"), F.lit(False))))
    return both.select("o", "th", F.explode(F.array("ahead", "behind")).alias("run")).filter("run is not null").select("o", "th", "run.*")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50, gram_words: int = 40, window_words: int = 10) -> DataFrame:
    """Lines to delete: o, th, pos, words. See remove_repeated."""
    table = written(lines(docs, key, text), "lines")
    found = runs(fingerprints(table, gram_words, window_words), min_words)
    # counted per task before it shuffles, then written: its size is known to the join, which broadcasts it while
    # it is small and else can cut up the rows of a passage that many documents share
    first = found.groupBy("key").agg(F.min(F.struct("o", "th", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    first = written(first, "first")
    later = found.join(first, "key").filter(F.struct("o", "th", "start") != F.col("first")).select("o", "th", F.col("start").alias("lno"), "end")
    # a line goes if a run that starts at or above it ends at or below it
    every = table.select("o", "th", "lno", "pos", "words", F.lit(None).cast(later.schema["end"].dataType).alias("end")).unionByName(later, allowMissingColumns=True)
    reach = F.max("end").over(Window.partitionBy("o", "th").orderBy("lno").rangeBetween(Window.unboundedPreceding, 0))
    return every.withColumn("reach", reach).filter("pos is not null and reach >= lno").select("o", "th", "pos", "words")


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50, gram_words: int = 40, window_words: int = 10) -> DataFrame:
    """docs with each text freed of repeated runs, and n_lines, n_deleted_lines, n_deleted_words long.

    A run is deleted if it has `min_words` words or more and occurs before, in a document with a
    smaller id (of any type that has an order; null: last; equal ids: smaller text hash) or further up in the same text. Only equal
    lines match; blank lines are looked through and stay. A null text stays null, a text of which all
    lines go becomes empty or blank lines. Rows equal in id and text are one document given more than
    once and are answered alike. Other columns are carried along, whatever their names.
    """
    if gram_words + window_words - 1 > min_words:
        raise ValueError("runs of min_words words would not always share a fingerprint")
    gone = repeated(docs, key, text, min_words, gram_words, window_words).groupBy("o", "th").agg(F.collect_list("pos").alias("gone"), F.sum("words").alias("gone_words"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), *_keys(docs, key, text))
    both = rows.join(gone, ["o", "th"], "left")
    split = F.split(F.col("d")[text], "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone")), lambda i: F.get(split, i))
    cleaned = F.when(F.col("gone").isNull(), F.col("d")[text]).otherwise(F.array_join(left, "\n"))
    return both.select(
        *[(cleaned if c == text else F.col("d")[c]).alias(c) for c in docs.columns],
        F.when(F.col("d")[text].isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted_lines"),
        F.coalesce("gone_words", F.lit(0)).cast("long").alias("n_deleted_words"),
    )


#: DuckDB by brute force at the default parameters, over the table documents: every run of 50 words with all others, no fingerprints.
SQL = """
WITH docs AS (SELECT doc_id, text, coalesce(doc_id, 9223372036854775807) AS o FROM documents),
split AS (SELECT o, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM (SELECT DISTINCT o, text FROM docs WHERE text IS NOT NULL)),
counted AS (SELECT o, md5(text) AS th, pos, md5(line) AS h, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM split),
lines AS (SELECT *, row_number() OVER w AS lno, sum(words) OVER w AS upto FROM counted WHERE words > 0 WINDOW w AS (PARTITION BY o, th ORDER BY pos)),
runs AS (
  SELECT o, th, lno AS s, max(lno) OVER w AS e, sum(words) OVER w AS total, list(h) OVER w AS hs FROM lines WINDOW w AS (PARTITION BY o, th ORDER BY upto - words RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT o, th, min(lno) OVER w, lno, sum(words) OVER w, list(h) OVER w FROM lines WINDOW w AS (PARTITION BY o, th ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
keyed AS (SELECT o, th, s, e, md5(array_to_string(hs, ',')) AS k FROM runs WHERE total >= 50),
firsts AS (SELECT k, min({'o': o, 'th': th, 's': s}) AS f FROM keyed GROUP BY k),
later AS (SELECT DISTINCT o, th, s, e FROM keyed JOIN firsts USING (k) WHERE {'o': o, 'th': th, 's': s} <> f),
gone AS (SELECT DISTINCT l.o, l.th, l.pos, l.words FROM lines l JOIN later r ON l.o = r.o AND l.th = r.th AND l.lno BETWEEN r.s AND r.e),
per AS (SELECT o, th, list(pos) AS ps, sum(words)::BIGINT AS ws FROM gone GROUP BY ALL)
SELECT d.doc_id,
  CASE WHEN p.o IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(range(len(string_split(d.text, chr(10)))), lambda i: NOT list_contains(p.ps, i)), lambda i: string_split(d.text, chr(10))[i + 1]), chr(10)) END AS text,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
  coalesce(len(p.ps), 0)::BIGINT AS n_deleted_lines, coalesce(p.ws, 0)::BIGINT AS n_deleted_words
FROM docs d LEFT JOIN per p ON d.o = p.o AND md5(d.text) = p.th
"""
