"""Differences between two snapshots of a contract and the release that follows from them.

Before and after always share a `pair` column, so one job compares any number of snapshot pairs and
no snapshot is ever crossed with another. Rows whose fingerprints agree leave before any detail is
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlake.functions.ids import fingerprint

CHANGE = "pair, kind, entity_id, severity, before, after"


def _sides(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join; all other columns as structs b and a, null where a side has no row."""
    side = lambda df, name: df.select(*keys, F.struct(*[df[c] for c in df.columns if c not in keys]).alias(name))
    return side(before, "b").join(side(after, "a"), keys, "full_outer")


def _change(kind: str, severity: str, before: Column, after: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), before.cast("string").alias("before"), after.cast("string").alias("after"))


def _exploded(joined: DataFrame, entity: Column, changes: Column) -> DataFrame:
    out = joined.select("pair", entity.alias("entity_id"), F.explode(changes).alias("c")).select("pair", "c.kind", "entity_id", "c.severity", "c.before", "c.after")
    return out.withColumn("id", fingerprint("change.", 24, F.col("kind"), F.col("entity_id"), F.col("before"), F.col("after")))


def _null() -> Column:
    return F.lit(None).cast("string")


def diff_gates(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns: pair, name, predicate, semantic_fingerprint. Added or removed: attention; another predicate: breaking."""
    j = _sides(before, after, ["pair", "name"])
    b, a = F.col("b"), F.col("a")
    j = j.filter(~b["semantic_fingerprint"].eqNullSafe(a["semantic_fingerprint"]) | b.isNull() | a.isNull())
    changes = F.when(b.isNull(), F.array(_change("gate_added", "attention", _null(), a["semantic_fingerprint"]))).when(a.isNull(), F.array(_change("gate_removed", "attention", b["semantic_fingerprint"], _null()))).otherwise(F.array(_change("gate_predicate_changed", "breaking", b["predicate"], a["predicate"])))
    return _exploded(j, F.concat(F.lit("turn_metadata.gate."), F.col("name")), changes)


def diff_fields(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns: pair, name, kind, value_expression, gate_refs, identity_domain, emission_fingerprint, semantic_fingerprint.

    Added: attention; removed: breaking. A field with the same full fingerprint has no change, nor has
    one whose emission fingerprint is known and the same: there only its gate changed, which the gate
    reports. Otherwise one change for each of gate, kind, value and domain that differs, or, if none
    of these does, one for the semantics.
    """
    j = _sides(before, after, ["pair", "name"])
    b, a = F.col("b"), F.col("a")
    same = b["semantic_fingerprint"].eqNullSafe(a["semantic_fingerprint"]) | (b["emission_fingerprint"].isNotNull() & b["emission_fingerprint"].eqNullSafe(a["emission_fingerprint"]))
    j = j.filter(b.isNull() | a.isNull() | ~same)

    def part(column: str, kind: str, severity: str) -> Column:
        return F.when(~b[column].eqNullSafe(a[column]), _change(kind, severity, b[column], a[column]))

    fine = F.array_compact(
        F.array(
            part("gate_refs", "field_gate_changed", "breaking"),
            part("kind", "field_emission_kind_changed", "breaking"),
            part("value_expression", "field_value_expression_changed", "attention"),
            part("identity_domain", "field_identity_domain_changed", "breaking"),
        )
    )
    changes = (
        F.when(b.isNull(), F.array(_change("field_added", "attention", _null(), a["semantic_fingerprint"])))
        .when(a.isNull(), F.array(_change("field_removed", "breaking", b["semantic_fingerprint"], _null())))
        .when(F.size(fine) > 0, fine)
        .otherwise(F.array(_change("field_semantics_changed", "attention", b["semantic_fingerprint"], a["semantic_fingerprint"])))
    )
    return _exploded(j, F.concat(F.lit("turn_metadata.field."), F.col("name")), changes)


def diff_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns: pair, name, path_candidates. Added and another path list: info; removed: attention."""
    j = _sides(before, after, ["pair", "name"])
    b, a = F.col("b"), F.col("a")
    j = j.filter(b.isNull() | a.isNull() | ~b["path_candidates"].eqNullSafe(a["path_candidates"]))
    changes = F.when(b.isNull(), F.array(_change("source_spec_added", "info", _null(), a["path_candidates"]))).when(a.isNull(), F.array(_change("source_spec_removed", "attention", b["path_candidates"], _null()))).otherwise(F.array(_change("source_path_candidates_changed", "info", b["path_candidates"], a["path_candidates"])))
    return _exploded(j, F.col("name"), changes)


def contract_diff(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """All changes of gates, fields and sources: pair, kind, entity_id, severity, before, after, id."""
    return diff_gates(before["gates"], after["gates"]).unionByName(diff_fields(before["fields"], after["fields"])).unionByName(diff_sources(before["sources"], after["sources"]))


def extractor_evolution(before: DataFrame, after: DataFrame, classified: tuple[str, ...] = ("extractor.turn_metadata",)) -> DataFrame:
    """Columns: pair, name, semantic_complete, digest. Rows (pair, kind, extractor_id, severity).

    An extractor in `classified` has its own compatibility rules, so that another digest is no change here.
    """
    j = _sides(before, after, ["pair", "name"])
    b, a = F.col("b"), F.col("a")
    change = lambda kind, severity: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    was, now = F.coalesce(b["semantic_complete"], F.lit(False)), F.coalesce(a["semantic_complete"], F.lit(False))
    both = F.array_compact(
        F.array(
            F.when(was & ~now, change("extractor_completeness_regressed", "major")).when(~was & now, change("extractor_completeness_completed", "minor")),
            F.when(~b["digest"].eqNullSafe(a["digest"]) & ~F.col("name").isin(*classified), change("extractor_semantics_changed", "major")),
        )
    )
    changes = F.when(b.isNull(), F.array(change("extractor_added", "minor"))).when(a.isNull(), F.array(change("extractor_removed", "major"))).otherwise(both)
    return j.select("pair", F.col("name").alias("extractor_id"), F.explode(changes).alias("c")).select("pair", "c.kind", "extractor_id", "c.severity")


def severity_counts(rows: DataFrame, keys: list[str], levels: tuple[str, ...], severity: str = "severity") -> DataFrame:
    """One row per key with a count for each level, total, and highest (levels run from the highest; `none` without a row)."""
    counts = [F.count_if(F.col(severity) == s).alias(s) for s in levels]
    out = rows.groupBy(*keys).agg(*counts, F.count("*").alias("total"))
    highest = F.coalesce(*[F.when(F.col(s) > 0, F.lit(s)) for s in levels], F.lit("none"))
    return out.withColumn("highest", highest)


def release_level(pairs: DataFrame, changes: DataFrame, extractors: DataFrame) -> DataFrame:
    """The release that each pair of snapshots calls for: pair, level, version, reasons.

    pairs: pair, previous_version, commit, schema_version and coverage_profile of both sides (with the
    suffixes _before and _after). Equal commits call for no release and give no row. Breaking changes,
    another schema or profile, and extractors removed, regressed or changed are major; attention, and
    extractors added or completed, minor; anything else is a patch.
    """
    counts = severity_counts(changes, ["pair"], ("breaking", "attention", "info"))
    moved = extractors.groupBy("pair").agg(F.bool_or(F.col("severity") == "major").alias("x_major"), F.bool_or(F.col("severity") == "minor").alias("x_minor"))
    p = pairs.filter("commit_before is distinct from commit_after").join(counts, "pair", "left").join(moved, "pair", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    schema = ~F.col("schema_version_before").eqNullSafe(F.col("schema_version_after"))
    profile = ~F.col("coverage_profile_before").eqNullSafe(F.col("coverage_profile_after"))
    sure = n("breaking") | schema | profile
    level = F.when(sure | yes("x_major"), F.lit("major")).when(n("attention") | yes("x_minor"), F.lit("minor")).otherwise(F.lit("patch"))
    first = F.when(n("breaking"), F.lit("semantic_diff_breaking")).when(n("attention"), F.lit("semantic_diff_attention")).when(n("info"), F.lit("semantic_diff_info")).otherwise(F.lit("exact_source_changed"))
    reasons = F.array(
        first,
        F.when(schema, F.lit("contract_schema_changed")),
        F.when(profile, F.lit("coverage_profile_changed")),
        F.when(yes("x_major"), F.lit("canonical_extractor_changed")).when(yes("x_minor") & ~sure, F.lit("canonical_extractor_added_or_completed")),
    )
    v = F.transform(F.split("previous_version", r"\."), lambda x: x.cast("int"))
    version = F.when(F.col("level") == "major", F.concat((v[0] + 1).cast("string"), F.lit(".0.0"))).when(F.col("level") == "minor", F.concat_ws(".", v[0].cast("string"), (v[1] + 1).cast("string"), F.lit("0"))).otherwise(F.concat_ws(".", v[0].cast("string"), v[1].cast("string"), (v[2] + 1).cast("string")))
    return p.withColumn("level", level).select("pair", "level", version.alias("version"), F.array_sort(F.array_compact(reasons)).alias("reasons"))


def version_diff(states: DataFrame, baseline: Column, candidate: Column) -> DataFrame:
    """Keys whose state differs between two versions. states: catalog, version, key, state; the columns pick the two versions of a catalog."""
    side = lambda c, name: states.filter(F.col("version") == c).select("catalog", "key", F.col("state").alias(name))
    j = side(baseline, "before").join(side(candidate, "after"), ["catalog", "key"], "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    return j.withColumn("id", fingerprint("history-change.", 20, F.col("key"), F.col("before"), F.col("after")))


def field_set_delta(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two field lists by wire name (columns: keys, wire_name, type, optional): side shared, left_only or right_only, and whether types agree."""
    j = _sides(left, right, [*keys, "wire_name"])
    b, a = F.col("b"), F.col("a")
    side = F.when(a.isNull(), F.lit("left_only")).when(b.isNull(), F.lit("right_only")).otherwise(F.lit("shared"))
    return j.select(*keys, "wire_name", side.alias("side"), b["type"].alias("left_type"), a["type"].alias("right_type"), F.when(side == "shared", b["type"].eqNullSafe(a["type"])).alias("same_type"), b["optional"].alias("left_optional"), a["optional"].alias("right_optional"))
