"""Headers across surfaces: an index of all that is said of them, overlaps, groups, and what nobody declared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a header's occurrences say of it; each is a column of the occurrences.
FACTS = ("name", "category", "origin", "value_shape", "condition", "source_ref")


def header_index(rows: DataFrame, keys: list[str], facts: tuple[str, ...] = FACTS) -> DataFrame:
    """All different facts of each header, one a row: keys, direction, header (lower case), fact, value, surface and row where it stands first, occurrences.

    rows: keys, direction, surface, row (the occurrence's place, ordered), and the facts. Null facts are
    none, but the condition: a header without one is unconditional, value null. A fact's order is that of its first
    occurrence. A header that stands everywhere is as many rows as it has facts, never one set.
    """
    told = F.array(*[F.struct(F.lit(f).alias("fact"), F.col(f).cast("string").alias("value")) for f in facts])
    wide = rows.select(*keys, "direction", F.lower("name").alias("header"), "surface", "row", F.inline(told)).filter("value is not null or fact = 'condition'")
    first = wide.groupBy(*keys, "direction", "header", "fact", "value").agg(F.min(F.struct("surface", "row")).alias("first"), F.count("*").alias("occurrences"))
    return first.select(*keys, "direction", "header", "fact", "value", "first.surface", "first.row", "occurrences")


def header_overlap(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str, str] = ("shared", "http_only", "ws_only")) -> DataFrame:
    """left, right: keys, name. Which side has a header: keys, name (the least of its spellings), side. Case does not count."""
    both = left.select(*keys, "name", F.lit(1).alias("side")).unionByName(right.select(*keys, "name", F.lit(2).alias("side")))
    seen = both.groupBy(*keys, F.lower("name").alias("header")).agg(F.min("name").alias("name"), F.max((F.col("side") == 1).cast("int")).alias("l"), F.max((F.col("side") == 2).cast("int")).alias("r"))
    return seen.select(*keys, "name", F.when(F.col("l") + F.col("r") == 2, names[0]).when(F.col("l") == 1, names[1]).otherwise(names[2]).alias("side"))


def by_category(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: keys, category, name, optional, sensitive, direction, origin, continuation, seq. The same with what is left out filled in.

    Null: uncategorized, optional, not sensitive, a request header of the client, no continuation. In order of keys,
    category and seq each category's headers stand as given, for a comparison of endpoints.
    """
    filled = {"category": F.lit("uncategorized"), "optional": F.lit(True), "sensitive": F.lit(False), "direction": F.lit("request"), "origin": F.lit("client"), "continuation": F.lit(False)}
    return rows.select(*keys, *[F.coalesce(c, v).alias(c) for c, v in filled.items()], "name", "seq")


def undeclared(candidates: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """candidates, declared: keys, direction, name. Candidates that no declaration of the same direction names, without case: keys, direction, header."""
    of = lambda d: d.select(*keys, "direction", F.lower("name").alias("header")).distinct()
    return of(candidates).join(of(declared), [*keys, "direction", "header"], "left_anti")
