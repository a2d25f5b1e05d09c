"""Versioned keys, version selection and leaf differences of JSON entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contractlake.functions.canonical import json_changes


def key_timeline(states: DataFrame, keys: list[str], version: str = "version", state: str = "state") -> DataFrame:
    """Where a key's state changes: keys, state, valid_from, valid_to (the next change; null: still)."""
    w = Window.partitionBy(*keys).orderBy(version)
    changed = states.withColumn("before", F.lag(state).over(w)).filter(~F.col("before").eqNullSafe(F.col(state)))
    return changed.select(*keys, state, F.col(version).alias("valid_from"), F.lead(version).over(w).alias("valid_to"))


def version_view(states: DataFrame, keys: list[str], at: Column, version: str = "version", state: str = "state") -> DataFrame:
    """Each key's state as of a version."""
    return states.filter(F.col(version) <= at).groupBy(*keys).agg(F.max_by(state, version).alias(state), F.max(version).alias(version))


def ordinal_gaps(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Rows whose ordinal is not their place from 0 on."""
    expected = F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal)) - 1
    return rows.withColumn("expected", expected).filter(F.col(ordinal) != F.col("expected"))


def select_version(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """asked: request, catalog, version, commit; versions: catalog, version, commit, current. The version that answers: the explicit one, else that of the commit, else the current one; basis says which, unknown_version where an explicit one is not there or is bound to another commit."""
    v = versions.select("catalog", "version", "commit", "current")
    explicit = v.select("catalog", F.col("version").alias("asked_version"), F.col("commit").alias("its_commit"))
    exact = v.select("catalog", F.col("commit").alias("asked_commit"), F.col("version").alias("exact"))
    current = v.filter("current").select("catalog", F.col("version").alias("now"))
    a = asked.withColumnRenamed("version", "asked_version").withColumnRenamed("commit", "asked_commit")
    j = a.join(explicit, ["catalog", "asked_version"], "left").join(exact, ["catalog", "asked_commit"], "left").join(current, "catalog", "left")
    named = F.col("asked_version").isNotNull()
    found = F.col("its_commit").isNotNull() & (F.col("asked_commit").isNull() | (F.col("asked_commit") == F.col("its_commit")))
    version = F.when(named, F.when(found, F.col("asked_version"))).otherwise(F.coalesce("exact", "now"))
    basis = F.when(named, F.when(found, "explicit_version").otherwise("unknown_version")).when(F.col("exact").isNotNull(), "exact_commit").otherwise("current_forward_canary")
    return j.select("request", version.alias("version"), basis.alias("basis"))


def entity_diff(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """What differs between two versions of JSON entities: key, pointer, before, after (canonical JSON, null where missing).

    Objects are compared member by member, arrays whole. A member that one side lacks, or that changes
    its kind, is one change with all it holds; so is an entity that one side lacks, at the root. Only
    entities whose texts differ are parsed, both sides in one row, so only what differs is written or shuffled.
    """
    j = before.select(key, F.col(text).alias("b")).join(after.select(key, F.col(text).alias("a")), key, "full_outer").filter(~F.col("b").eqNullSafe(F.col("a")))
    return json_changes(j, key, "b", "a")
