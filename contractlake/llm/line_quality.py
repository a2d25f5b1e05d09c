"""Quality rules: rules on a text alone, then line frequency across documents.

Lines are normalised (lower case, white space to single spaces, ends trimmed) and hashed. For each
host the documents that hold a line are counted, copies included; lines held by more than the limit are
boilerplate and are removed, and a document of which too little remains is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, short_batches, slices, text_column, written

_WORD = re.compile(WORD)
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = _WORD.findall(text)
    lines = Counter(line for line in text.split("\n") if _WORD.search(line))
    repeat = 0
    if len(words) > 3:
        grams = list(zip(words, words[1:], words[2:]))
        often = Counter(grams)
        if len(often) < len(grams):
            end = 0  # words before it are counted
            for k, g in enumerate(grams):
                if often[g] > 1:
                    repeat += k + 3 - max(end, k)
                    end = k + 3
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), sum(lines.values()) - len(lines), repeat


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 50, repeat_percent: int = 50, line_limit: int = 20, keep_percent: int = 50) -> DataFrame:
    """One row per document: key, the five counts long, base_failed, n_removed_words long, kept boolean.

    base_failed: fewer than `min_words` words, or more than `repeat_percent` % of them repeated. A line
    is removed if more than `line_limit` documents of the host hold it; repeated rows and copies are
    documents, a line repeated within one counts once. A document that passed the base rules is kept if at least `keep_percent` % of its words remain. A null text
    has no word and fails; a null host is a host of its own. A text of any length is read whole, an empty
    table gives no rows.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(docs[key].alias("key"), docs[host].alias("host"), text_column(docs[text]).alias("body"))
    identity = F.unhex(F.md5("body")).alias("id")
    kind = docs.schema[key].dataType.simpleString()
    hosts = docs.schema[host].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [base_counts(t) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "host", "id")), *(pa.array([g[k] for g in got], pa.int64()) for k in range(5))], names=["key", "host", "id", *_FIELDS])

    counted = rows.select("key", "host", identity, "body").mapInArrow(count, f"key {kind}, host {hosts}, id binary, " + ", ".join(f"{f} long" for f in _FIELDS))

    line = F.explode(F.split("body", "\n")).alias("line")
    normal = F.trim(F.regexp_replace(F.lower("line"), r"[\x20\x09-\x0D]+", " "))
    words = rows.select("host", identity, line).select("host", "id", normal.alias("line")).filter("line != ''")
    words = words.select("host", "id", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(" ")).alias("blanks"))
    # one row per host, text and line: copies of a text fall together before the shuffle, and their number is the documents'
    held = words.groupBy("host", "id", "h").agg(F.max(F.col("blanks") + 1).alias("words"), F.count("*").alias("times"))
    copies = rows.groupBy("host", identity).agg(F.count("*").alias("copies"))
    same = lambda a, b, column: F.col(f"{a}.host").eqNullSafe(F.col(f"{b}.host")) & (F.col(f"{a}.{column}") == F.col(f"{b}.{column}"))
    held = written(held.alias("l").join(copies.alias("k"), same("l", "k", "id")).select("l.host", "l.id", "h", "words", "times", "copies"), "lines")
    common = held.groupBy("host", "h").agg(F.sum("copies").alias("documents")).filter(F.col("documents") > line_limit)
    lost = held.alias("l").join(common.alias("c"), same("l", "c", "h")).select("l.host", "l.id", "words", "times", "copies")
    # a repeated text's lines were counted once for each copy; the share is of copies alike
    removed = lost.groupBy("host", "id").agg(F.expr("sum(words * times) div max(copies)").alias("removed")).select(F.col("host").alias("h2"), F.col("id").alias("id2"), "removed")
    both = counted.join(removed, F.col("host").eqNullSafe(F.col("h2")) & (F.col("id") == F.col("id2")), "left")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    gone = F.coalesce("removed", F.lit(0)).cast("long")
    return both.select(F.col("key").alias(key), *_FIELDS, failed.alias("base_failed"), gone.alias("n_removed_words"), (~failed & ((F.col("n_words") - gone) * 100 >= F.col("n_words") * keep_percent)).alias("kept"))


#: DuckDB twin at the default parameters, over the table documents.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, w.word, w.pos FROM (SELECT r, unnest(list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda x, i: {'word': x, 'pos': i})) AS w FROM docs)),
per AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY r),
grams AS (SELECT r, pos, word, lead(word, 1) OVER w AS w2, lead(word, 2) OVER w AS w3 FROM words WINDOW w AS (PARTITION BY r ORDER BY pos)),
often AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, word, w2, w3) AS c FROM grams WHERE w3 IS NOT NULL) WHERE c > 1),
repeats AS (SELECT r, count(*) AS n FROM (SELECT r, pos FROM often UNION SELECT r, pos + 1 FROM often UNION SELECT r, pos + 2 FROM often) GROUP BY r),
lines AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
normal AS (SELECT r, source, text, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM lines),
common AS (SELECT source, line FROM normal WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT r) > 20),
removed AS (SELECT n.r, sum(len(string_split(n.line, ' '))) AS n FROM normal n JOIN common c ON n.line = c.line AND n.source IS NOT DISTINCT FROM c.source GROUP BY n.r),
every AS (SELECT d.doc_id, coalesce(p.n_words, 0)::BIGINT AS n_words, coalesce(p.word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(x.n, 0)::BIGINT AS n_repeat_words, coalesce(m.n, 0)::BIGINT AS n_removed_words
  FROM docs d LEFT JOIN per p USING (r) LEFT JOIN dups u USING (r) LEFT JOIN repeats x USING (r) LEFT JOIN removed m USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM every)
SELECT *, NOT base_failed AND (n_words - n_removed_words) * 100 >= n_words * 50 AS kept FROM failed
"""
