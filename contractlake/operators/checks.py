"""Checks that give one coded row for each failure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unresolved(references: DataFrame, known: DataFrame, code: str, keys: list[str]) -> DataFrame:
    """References (keys, source_id, target_id) whose target is no known id (keys, id) of the same report: keys, code, source_id, target_id.

    A reference to null is unresolved. The known ids are made distinct before the join.
    """
    ids = known.select(*keys, F.col("id").alias("target_id")).distinct()
    return references.join(ids, [*keys, "target_id"], "left_anti").select(*keys, F.lit(code).alias("code"), "source_id", "target_id")


def referential_integrity(edges: DataFrame, nodes: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """edges: keys, id, from_id, to_id; nodes: keys, id; owners: keys, id, owner_id (a field's schema). One row per broken end."""
    start = unresolved(edges.select(*keys, F.col("id").alias("source_id"), F.col("from_id").alias("target_id")), nodes, "EDGE_SOURCE_UNRESOLVED", keys)
    end = unresolved(edges.select(*keys, F.col("id").alias("source_id"), F.col("to_id").alias("target_id")), nodes, "EDGE_TARGET_UNRESOLVED", keys)
    owner = unresolved(owners.select(*keys, F.col("id").alias("source_id"), F.col("owner_id").alias("target_id")), nodes, "OWNER_UNRESOLVED", keys)
    return start.unionByName(end).unionByName(owner)


def reference_integrity(references: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """References of all kinds in one join. references: keys, kind, source_id, target_id; known: keys, kind, id. Rows keys, code (the kind and _UNRESOLVED), source_id, target_id.

    kind names what the target must be (schema, field, source, status, entity, …): an id of another
    kind resolves nothing, nor does a null one.
    """
    ids = known.select(*keys, "kind", F.col("id").alias("target_id")).distinct()
    lost = references.join(ids, [*keys, "kind", "target_id"], "left_anti")
    return lost.select(*keys, F.concat(F.upper("kind"), F.lit("_UNRESOLVED")).alias("code"), "source_id", "target_id")


def duplicates(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Keys that occur more than once: keys, n, conflicting (their contents differ)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.min(content) != F.max(content)).alias("conflicting")).filter("n > 1")


def source_coverage(specs: DataFrame, files: DataFrame) -> DataFrame:
    """specs: snapshot, spec_id, path, required, symbols; files: snapshot, path, text. Rows snapshot, spec_id, code, severity, symbols.

    Missing required source: error; missing optional one: warning; symbols absent from the text: warning that lists them.
    """
    j = specs.join(files, ["snapshot", "path"], "left")
    absent = F.filter("symbols", lambda s: ~F.contains(F.col("text"), s))
    code = F.when(F.col("text").isNull(), F.when(F.col("required"), F.lit("REQUIRED_SOURCE_UNAVAILABLE")).otherwise(F.lit("OPTIONAL_SOURCE_UNAVAILABLE"))).when(F.size(absent) > 0, F.lit("EXPECTED_SYMBOL_ABSENT"))
    severity = F.when(F.col("text").isNull() & F.col("required"), F.lit("error")).otherwise(F.lit("warning"))
    return j.select("snapshot", "spec_id", code.alias("code"), severity.alias("severity"), F.when(F.col("text").isNotNull(), F.array_sort(absent)).alias("symbols")).filter("code is not null")


def select_candidate(specs: DataFrame, files: DataFrame) -> DataFrame:
    """For each spec (snapshot, spec_id, path_candidates) the first candidate that is a file (snapshot, path): path, candidate_index (null: unavailable), fallback."""
    wide = specs.select("snapshot", "spec_id", F.posexplode("path_candidates").alias("i", "path"))
    found = wide.join(files.select("snapshot", "path").distinct(), ["snapshot", "path"]).groupBy("snapshot", "spec_id").agg(F.min(F.struct("i", "path")).alias("m"))
    return specs.select("snapshot", "spec_id").join(found, ["snapshot", "spec_id"], "left").select("snapshot", "spec_id", F.col("m.path").alias("path"), F.col("m.i").alias("candidate_index"), F.coalesce(F.col("m.i") > 0, F.lit(False)).alias("fallback"))


def marker_checks(rules: DataFrame, texts: DataFrame) -> DataFrame:
    """rules: source_id, entity_id, code, token; texts: source_id, text. One row per entity: complete, and the sorted codes whose token is missing.

    A rule whose source has no text is missed too. Rules are few, texts are read once.
    """
    j = rules.join(texts, "source_id", "left")
    present = F.coalesce(F.contains(F.col("text"), F.col("token")), F.lit(False))
    return j.groupBy("source_id", "entity_id").agg(F.bool_and(present).alias("complete"), F.array_sort(F.collect_set(F.when(~present, F.col("code")))).alias("missing_codes"))


def variant(texts: DataFrame, variants: dict[str, tuple[str, ...]], text: str = "text") -> Column:
    """Name of the first variant all of whose markers the text holds, else unknown."""
    t = F.col(text)
    tests = [F.when(reduce(lambda a, b: a & b, [t.contains(m) for m in markers]), F.lit(name)) for name, markers in variants.items()]
    return F.coalesce(*tests, F.lit("unknown"))


def verify_manifest(declared: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Both: keys, path, byte_length, sha256. Rows keys, path, code: MEMBER_MISSING, SIZE_MISMATCH, HASH_MISMATCH, DUPLICATE_MEMBER, MEMBER_UNDECLARED, UNSAFE_PATH."""
    from contractlake.functions.classify import is_safe_path

    on = [*keys, "path"]
    d = declared.groupBy(*on).agg(F.count("*").alias("times"), F.min("byte_length").alias("d_size"), F.min("sha256").alias("d_sha"))
    a = actual.select(*on, F.col("byte_length").alias("a_size"), F.col("sha256").alias("a_sha"), F.lit(True).alias("there"))
    j = d.join(a, on, "full_outer")
    both = F.col("times").isNotNull() & F.col("there").isNotNull()
    codes = F.array(
        F.when(F.col("there").isNull(), F.lit("MEMBER_MISSING")),
        F.when(F.col("times").isNull(), F.lit("MEMBER_UNDECLARED")),
        F.when(F.col("times") > 1, F.lit("DUPLICATE_MEMBER")),
        F.when(both & (F.col("d_size") != F.col("a_size")), F.lit("SIZE_MISMATCH")),
        F.when(both & (F.col("d_sha") != F.col("a_sha")), F.lit("HASH_MISMATCH")),
        F.when(~is_safe_path(F.col("path")), F.lit("UNSAFE_PATH")),
    )
    return j.select(*on, F.explode(F.array_compact(codes)).alias("code"))


def check_listing(members: DataFrame, nfc: Column, max_members: int = 50_000, max_total: int = 1 << 30, max_file: int = 1 << 26, max_ratio: float = 200.0, max_depth: int = 40, max_name: int = 512) -> DataFrame:
    """members: archive, path, size, compressed_size; nfc: the path in Unicode normal form C. Rows archive, path (null: of the archive), code."""
    from contractlake.functions.classify import is_safe_path

    m = members.withColumn("nfc", nfc).withColumn("folded", F.lower("path"))
    own = F.array(
        F.when((F.length("path") == 0) | (F.length("path") > max_name), F.lit("NAME_LENGTH")),
        F.when(~is_safe_path(F.col("path")), F.lit("UNSAFE_PATH")),
        F.when(F.size(F.split("path", "/")) > max_depth, F.lit("PATH_DEPTH")),
        F.when(F.col("size") > max_file, F.lit("FILE_SIZE")),
        F.when(F.col("size") > F.col("compressed_size") * max_ratio, F.lit("COMPRESSION_RATIO")),
    )
    single = m.select("archive", "path", F.explode(F.array_compact(own)).alias("code"))
    again = m.groupBy("archive", "path").count().filter("count > 1").select("archive", "path", F.lit("DUPLICATE_PATH").alias("code"))

    def met(key: str, code: str) -> DataFrame:
        groups = m.groupBy("archive", key).agg(F.count_distinct("path").alias("n"), F.min("path").alias("path"))
        return groups.filter("n > 1").select("archive", "path", F.lit(code).alias("code"))

    whole = m.groupBy("archive").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    limits = F.array_compact(F.array(F.when(F.col("n") > max_members, F.lit("MEMBER_COUNT")), F.when(F.col("total") > max_total, F.lit("TOTAL_SIZE"))))
    total = whole.select("archive", F.lit(None).cast("string").alias("path"), F.explode(limits).alias("code"))
    return reduce(DataFrame.unionByName, [single, again, met("folded", "CASE_COLLISION"), met("nfc", "UNICODE_COLLISION"), total])


def provenance_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest: snapshot, path, byte_length, sha256, blob_sha1; files: snapshot, path, content. Rows snapshot, path, code for what does not agree or is missing."""
    from contractlake.functions.ids import blob_sha1

    f = files.select("snapshot", "path", F.octet_length("content").alias("n"), F.sha2("content", 256).alias("s"), blob_sha1(F.col("content")).alias("b"))
    j = manifest.join(f, ["snapshot", "path"], "left")
    codes = F.when(F.col("n").isNull(), F.array(F.lit("SOURCE_MISSING"))).otherwise(
        F.array_compact(F.array(F.when(F.col("n") != F.col("byte_length"), F.lit("BYTE_LENGTH_MISMATCH")), F.when(F.col("s") != F.col("sha256"), F.lit("SHA256_MISMATCH")), F.when(F.col("b") != F.col("blob_sha1"), F.lit("BLOB_MISMATCH"))))
    )
    return j.select("snapshot", "path", F.explode(codes).alias("code"))


def count_consistency(declared: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """declared: keys, kind, n; items: keys, kind. Rows keys, kind, declared, actual where they differ."""
    actual = items.groupBy(*keys, "kind").agg(F.count("*").alias("actual"))
    j = declared.withColumnRenamed("n", "declared").join(actual, [*keys, "kind"], "full_outer")
    j = j.withColumn("declared", F.coalesce("declared", F.lit(0))).withColumn("actual", F.coalesce("actual", F.lit(0)))
    return j.filter("declared != actual").select(*keys, "kind", "declared", "actual")


def field_order_bijection(order: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """order, fields: keys, field. Owners (keys) whose order does not name every field exactly once: keys, code, missing, extra, repeated (numbers of fields).

    Owners with fields and no order at all are left out: nothing was declared.
    """
    both = order.select(*keys, "field", F.lit(1).alias("o"), F.lit(0).alias("f")).unionByName(fields.select(*keys, "field", F.lit(0).alias("o"), F.lit(1).alias("f")))
    each = both.groupBy(*keys, "field").agg(F.sum("o").alias("o"), F.max("f").alias("f"))
    out = each.groupBy(*keys).agg(F.count_if(F.col("o") == 0).alias("missing"), F.count_if(F.col("f") == 0).alias("extra"), F.count_if(F.col("o") > 1).alias("repeated"), F.sum("o").alias("said"))
    return out.filter("said > 0 and missing + extra + repeated > 0").select(*keys, F.lit("FIELD_ORDER_NOT_BIJECTIVE").alias("code"), "missing", "extra", "repeated")


def evidence_codes(scenarios: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """One row per evidence: its sorted codes, the required scenarios that did not pass, and the status recomputed.

    scenarios: keys, id, status, assertions array<string> of statuses, n_artifacts, declared_status,
    report_bound, source_bound; required: id. A scenario that passed has passed assertions only; a
    failed or blocked one has such an assertion; each has an assertion and an artifact; ids don't
    repeat. complete: all scenarios passed, and the required ones are among them.
    """
    s = F.col("status")
    wrong = F.array(
        F.when((F.size("assertions") == 0), F.lit("SCENARIO_WITHOUT_ASSERTION")),
        F.when(F.col("n_artifacts") == 0, F.lit("SCENARIO_WITHOUT_ARTIFACT")),
        F.when((s == "passed") & F.exists("assertions", lambda a: a != "passed"), F.lit("PASSED_WITH_FAILURE")),
        F.when((s == "failed") & ~F.array_contains("assertions", "failed"), F.lit("FAILED_WITHOUT_FAILURE")),
        F.when((s == "blocked") & ~F.array_contains("assertions", "blocked"), F.lit("BLOCKED_WITHOUT_BLOCK")),
        F.when(~F.col("report_bound"), F.lit("REPORT_MISMATCH")),
        F.when(~F.col("source_bound"), F.lit("SOURCE_MISMATCH")),
    )
    own = scenarios.withColumn("codes", F.array_compact(wrong))
    per = own.groupBy(*keys).agg(
        F.flatten(F.collect_set("codes")).alias("codes"),
        F.count("*").alias("n"),
        F.count_distinct("id").alias("different"),
        F.bool_and(s == "passed").alias("all_passed"),
        F.collect_set(F.when(s == "passed", F.col("id"))).alias("passed"),
        F.first("declared_status").alias("declared_status"),
    )
    # the required scenarios are a handful of ids of one profile
    need = required.agg(F.array_sort(F.collect_set("id")).alias("need"))
    j = per.join(F.broadcast(need))
    missing = F.array_except("need", "passed")
    status = F.when((F.size(missing) == 0) & F.col("all_passed"), F.lit("complete")).otherwise(F.lit("partial"))
    j = j.withColumn("missing", F.array_sort(missing)).withColumn("calculated_status", status)
    more = F.array_compact(F.array(F.when(F.col("different") < F.col("n"), F.lit("DUPLICATE_SCENARIO")), F.when(F.size("missing") > 0, F.lit("SCENARIO_MISSING")), F.when(F.col("declared_status") != F.col("calculated_status"), F.lit("STATUS_DISAGREES"))))
    return j.select(*keys, F.array_sort(F.array_union("codes", more)).alias("codes"), "missing", "calculated_status")


def assertion_check(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """expected and observed: version, key, assertion, values array<string>; lists compare as sets. Rows version, key, assertion, code: ASSERTION_UNOBSERVED or ASSERTION_MISMATCH."""
    j = expected.join(observed.withColumnRenamed("values", "seen"), ["version", "key", "assertion"], "left")
    same = F.array_sort(F.array_distinct("values")).eqNullSafe(F.array_sort(F.array_distinct("seen")))
    code = F.when(F.col("seen").isNull(), F.lit("ASSERTION_UNOBSERVED")).when(~same, F.lit("ASSERTION_MISMATCH"))
    return j.select("version", "key", "assertion", code.alias("code")).filter("code is not null")


def policy_gate(counts: DataFrame, policy: Column) -> Column:
    """Whether a report (columns error, warning, breaking, total, complete) passes a policy: never, warning, error, incomplete, breaking, any."""
    fails = (
        F.when(policy == "warning", (F.col("error") + F.col("warning")) > 0)
        .when(policy == "error", F.col("error") > 0)
        .when(policy == "incomplete", ~F.col("complete"))
        .when(policy == "breaking", F.col("breaking") > 0)
        .when(policy == "any", F.col("total") > 0)
        .otherwise(F.lit(False))
    )
    return ~fails


def history_integrity(keys: DataFrame, states: DataFrame, versions: DataFrame) -> DataFrame:
    """keys: id, current_state, state_refs; states: id, owner; versions: version, key, state. Rows entity_id, code.

    STATE_UNRESOLVED, STATE_OWNER_MISMATCH, CURRENT_NOT_DECLARED, VERSION_STATE_UNRESOLVED, VERSION_KEY_UNKNOWN.
    """
    refs = keys.select(F.col("id").alias("key"), F.explode("state_refs").alias("ref"))
    joined = refs.join(states.select(F.col("id").alias("ref"), "owner"), "ref", "left")
    bad = joined.select(F.col("key").alias("entity_id"), F.when(F.col("owner").isNull(), F.lit("STATE_UNRESOLVED")).when(F.col("owner") != F.col("key"), F.lit("STATE_OWNER_MISMATCH")).alias("code"))
    current = keys.filter(~F.array_contains("state_refs", F.col("current_state"))).select(F.col("id").alias("entity_id"), F.lit("CURRENT_NOT_DECLARED").alias("code"))
    lost = versions.join(states.select(F.col("id").alias("state")), "state", "left_anti").select(F.col("version").alias("entity_id"), F.lit("VERSION_STATE_UNRESOLVED").alias("code"))
    unknown = versions.join(keys.select(F.col("id").alias("key")), "key", "left_anti").select(F.col("version").alias("entity_id"), F.lit("VERSION_KEY_UNKNOWN").alias("code"))
    return bad.filter("code is not null").unionByName(current).unionByName(lost).unionByName(unknown)


def transition_integrity(keys: DataFrame, declared: DataFrame, members: DataFrame, transitions: DataFrame, references: DataFrame, evidence: DataFrame) -> DataFrame:
    """keys: id, replaced_by (null: by none); declared: version, key; members: version, key, state; transitions: id, version, key, state; references: entity, ref; evidence: ref. Rows entity_id, code.

    REPLACEMENT_UNRESOLVED, KEY_SET_MISMATCH (once a version), TRANSITION_TARGET_INACTIVE, EVIDENCE_UNRESOLVED.
    """

    def lost(rows: DataFrame, among: DataFrame, on: list[str], entity: str, code: str) -> DataFrame:
        return rows.join(among.select(*on).distinct(), on, "left_anti").select(F.col(entity).alias("entity_id"), F.lit(code).alias("code"))

    replaced = keys.filter("replaced_by is not null").select("id", F.col("replaced_by").alias("key"))
    pair = ["version", "key"]
    sets = lost(members, declared, pair, "version", "KEY_SET_MISMATCH").unionByName(lost(declared, members, pair, "version", "KEY_SET_MISMATCH")).distinct()
    return (
        lost(replaced, keys.select(F.col("id").alias("key")), ["key"], "id", "REPLACEMENT_UNRESOLVED")
        .unionByName(sets)
        .unionByName(lost(transitions, members, [*pair, "state"], "id", "TRANSITION_TARGET_INACTIVE"))
        .unionByName(lost(references, evidence, ["ref"], "entity", "EVIDENCE_UNRESOLVED"))
    )
