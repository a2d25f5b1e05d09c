"""Aggregations: diagnostics, registries, graphs and status."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ["category", "code", "source_id", "field_id", "location"]
_RANKS = ("info", "warning", "error", "critical")


def _rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, _RANKS)), severity), F.lit(0))


def merge_diagnostics(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per identity (IDENTITY, null ids as empty): the highest severity, strict if any is, recoverable if all are, distinct messages sorted and joined.

    details map: a key with one value keeps it, with several it holds all, sorted. The order of rows does not matter.
    """
    keys = keys or []
    flat = rows.select(*keys, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in IDENTITY], "severity", "message", "strict_failure", "recoverable", "details")
    pairs = flat.select(*keys, *IDENTITY, F.explode("details").alias("k", "v"))
    values = pairs.groupBy(*keys, *IDENTITY, "k").agg(F.array_join(F.array_sort(F.collect_set("v")), " | ").alias("v"))
    details = values.groupBy(*keys, *IDENTITY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("details"))
    merged = flat.groupBy(*keys, *IDENTITY).agg(
        F.max(_rank(F.col("severity"))).alias("r"),
        F.array_join(F.array_sort(F.collect_set("message")), " | ").alias("message"),
        F.bool_or("strict_failure").alias("strict_failure"),
        F.bool_and("recoverable").alias("recoverable"),
    )
    severity = F.coalesce(F.get(F.array(*map(F.lit, _RANKS)), (F.col("r") - 1).cast("int")), F.lit("unknown"))
    return merged.join(details, [*keys, *IDENTITY], "left").withColumn("severity", severity).drop("r")


def collect_diagnostics(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Per id the last row by `order`."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*keys, "last.*")


def warnings_to_diagnostics(warnings: DataFrame, keys: list[str]) -> DataFrame:
    """warnings: keys, pointer, message, source_ref. One row per different message with its sorted pointers and references."""
    return warnings.groupBy(*keys, "message").agg(F.array_sort(F.collect_set("pointer")).alias("pointers"), F.array_sort(F.collect_set("source_ref")).alias("source_refs"))


def unavailable_sources(warnings: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Warnings with the sources that they name, and a diagnostic for each unavailable source that none names: keys, code, severity, message, pointers, source_refs.

    warnings: keys, pointer, message, source_ref; manifest: keys, source_id, path, available (null: yes),
    required. A warning names a source if the source's path stands in its message as a word of its own, which
    makes it a join on words and not a search of all paths in all messages. Warnings have the code WARNING.
    """
    own = warnings_to_diagnostics(warnings, keys)
    word = F.explode(F.array_distinct(F.regexp_extract_all("message", F.lit(r"([^\s'\"`,;()]+)"), F.lit(1)))).alias("word")
    words = own.select(*keys, "message", word).withColumn("path", F.regexp_replace("word", r"[.:]+$", ""))
    named = words.join(manifest.filter("path != ''").select(*keys, "source_id", "path"), [*keys, "path"])
    refs = named.groupBy(*keys, "message").agg(F.collect_set("source_id").alias("more"))
    told = own.join(refs, [*keys, "message"], "left")
    more = F.array_sort(F.array_distinct(F.concat("source_refs", F.coalesce("more", F.array().cast("array<string>")))))
    warned = told.select(*keys, F.lit("WARNING").alias("code"), F.lit("warning").alias("severity"), "message", "pointers", more.alias("source_refs"))
    lost = manifest.filter("not coalesce(available, true)").join(named.select(*keys, "source_id").distinct(), [*keys, "source_id"], "left_anti")
    required = F.coalesce("required", F.lit(False))
    escaped = F.replace(F.replace("source_id", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    absent = lost.select(
        *keys,
        F.when(required, "REQUIRED_SOURCE_UNAVAILABLE").otherwise("OPTIONAL_SOURCE_UNAVAILABLE").alias("code"),
        F.when(required, "error").otherwise("warning").alias("severity"),
        F.concat(F.lit("expected source unavailable: "), F.coalesce("path", F.lit(""))).alias("message"),
        F.array(F.concat(F.lit("/source_manifest/files/"), escaped)).alias("pointers"),
        F.array("source_id").alias("source_refs"),
    )
    return warned.unionByName(absent)


def header_registry(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: keys, direction, name, category, origin, continuation. One row per direction and lower-cased name."""
    return rows.groupBy(*keys, "direction", F.lower("name").alias("header")).agg(
        F.array_sort(F.collect_set("name")).alias("names"),
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.array_sort(F.collect_set("origin")).alias("origins"),
        F.bool_or("continuation").alias("continuation"),
        F.count("*").alias("occurrences"),
    )


def schema_registry(fields: DataFrame, schemas: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fields merged over their occurrences, with the wire shapes that conflict; and referenced schemas that are defined nowhere.

    fields: keys, schema_id, wire_name, wire_schema, ref (the schema of its type, or null); schemas: keys, schema_id.
    """
    merged = fields.groupBy(*keys, "schema_id", "wire_name").agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_set("wire_schema")).alias("shapes"))
    merged = merged.withColumn("conflicting", F.size("shapes") > 1)
    opaque = fields.filter("ref is not null").select(*keys, F.col("ref").alias("schema_id")).distinct().join(schemas.select(*keys, "schema_id"), [*keys, "schema_id"], "left_anti")
    return merged, opaque


def merge_schema_paths(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: keys, path, location, required, digest. Per path: sorted locations, required if any is, the first location's digest and the other variants."""
    out = rows.groupBy(*keys, "path").agg(F.array_sort(F.collect_set("location")).alias("locations"), F.bool_or("required").alias("required"), F.min_by("digest", "location").alias("digest"), F.array_sort(F.collect_set("digest")).alias("all"))
    return out.withColumn("variants", F.array_except("all", F.array("digest"))).withColumn("variant_count", F.size("all")).drop("all")


def set_digest(files: DataFrame, keys: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """One digest per set of files: sha256 over path, NUL, the file's bytes, NUL, in path order (by UTF-8 bytes): keys, set_sha256, files.

    The files of a set are sorted in one task, outside memory if they are large, and flow through the
    digest one by one. Null paths and contents count as empty.
    """
    bare = lambda c: F.coalesce(F.col(c).cast("binary"), F.lit(b""))
    rows = files.select(F.struct(*keys).alias("of"), bare(path).alias("path"), bare(content).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays([last]), pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], names=["of", "set_sha256", "files"])

        last, digest, n = None, hashlib.sha256(), 0
        for batch in batches:
            for i in range(batch.num_rows):
                of = batch.column("of").slice(i, 1)
                if last is None or of[0] != last[0]:
                    if last is not None:
                        yield ended()
                    last, digest, n = of, hashlib.sha256(), 0
                for part in (batch.column("path")[i].as_buffer(), b"\0", batch.column("content")[i].as_buffer(), b"\0"):
                    digest.update(part)
                n += 1
        if last is not None:
            yield ended()

    of = rows.schema["of"].dataType.simpleString()
    return rows.repartition("of").sortWithinPartitions("of", "path").mapInArrow(run, f"of {of}, set_sha256 string, files long").select("of.*", "set_sha256", "files")


def group_counts(rows: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Counts by category within each key, and over each key and all (category null)."""
    return rows.rollup(*keys, category).agg(F.count("*").alias("n"))


def compose_graph(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """nodes: keys, id, kind, label, priority. The definition with the highest priority stays for each id (ties: the greater kind, then label)."""
    return nodes.groupBy(*keys, "id").agg(F.max(F.struct("priority", "kind", "label")).alias("m")).select(*keys, "id", "m.kind", "m.label")


def compose_edges(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """edges: keys, family, from_id, to_id, relation; nodes: keys, id. keys, id, from_id, to_id, relation of edges whose both ends are nodes, once each; id is the family and a hash of the ends."""
    known = nodes.select(*keys, F.col("id")).distinct()
    whole = edges.distinct().join(known.withColumnRenamed("id", "from_id"), [*keys, "from_id"], "left_semi").join(known.withColumnRenamed("id", "to_id"), [*keys, "to_id"], "left_semi")
    mark = F.substring(F.sha2(F.concat_ws(":", "from_id", "to_id"), 256), 1, 16)
    return whole.select(*keys, F.concat_ws(".", "family", mark).alias("id"), "from_id", "to_id", "relation")


def identity_groups(fields: DataFrame, keys: list[str], domain: str = "identity_domain", field: str = "name") -> DataFrame:
    """Per identity domain its fields, one a row, with how many the domain has: keys, domain, field, fields. Null domains are other."""
    own = fields.select(*keys, F.coalesce(F.col(domain), F.lit("other")).alias("domain"), F.col(field).alias("field")).distinct()
    return own.join(own.groupBy(*keys, "domain").agg(F.count("*").alias("fields")), [*keys, "domain"])


def graph_views(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Per edge source: its sorted targets, and those that are no node."""
    known = nodes.select(*keys, F.col("id").alias("to_id"), F.lit(True).alias("known")).distinct()
    j = edges.join(known, [*keys, "to_id"], "left")
    return j.groupBy(*keys, "from_id").agg(F.array_sort(F.collect_set("to_id")).alias("targets"), F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("to_id")))).alias("unresolved"))


def edge_views(edges: DataFrame, keys: list[str]) -> DataFrame:
    """edges: keys, id, from_id, to_id, feature (null: none). The index of edges by what they touch: keys, kind (source, target, feature), member, edge_id.

    Rows stay rows: the edges of a member that most of them touch need not fit in one task.
    """
    touched = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("member")) for kind, c in (("source", "from_id"), ("target", "to_id"), ("feature", "feature"))])
    return edges.select(*keys, F.col("id").alias("edge_id"), F.inline(touched)).filter("member is not null").distinct()


def graph_coverage(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each report (keys, one at least): nodes, linked (nodes that an edge touches), unresolved (ids at an edge that are no node) and edges."""
    ends = edges.select(*keys, F.explode(F.array("from_id", "to_id")).alias("id")).filter("id is not null").distinct()
    known = nodes.select(*keys, "id").distinct().withColumn("known", F.lit(True))
    j = known.join(ends.withColumn("used", F.lit(True)), [*keys, "id"], "full_outer")
    counts = j.groupBy(*keys).agg(F.count("known").alias("nodes"), F.count_if(F.col("known") & F.col("used")).alias("linked"), F.count_if(F.col("known").isNull()).alias("unresolved"))
    made = edges.groupBy(*keys).agg(F.count_distinct("id").alias("edges"))
    return counts.join(made, keys, "left").fillna(0, "edges")


def build_edges(rows: DataFrame) -> DataFrame:
    """rows: from_id, to_id, relation, seq. One edge per id, a hash of the three; the last seq stays."""
    from contractlake.functions.ids import fingerprint

    made = rows.withColumn("id", fingerprint("edge.", 16, F.col("from_id"), F.col("relation"), F.col("to_id")))
    return made.groupBy("id").agg(F.max_by(F.struct("from_id", "to_id", "relation"), "seq").alias("e"), F.max("seq").alias("seq")).select("id", "e.*", "seq")


def location_concepts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per wire path the sorted different concepts."""
    return rows.groupBy(*keys, "path").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))


def status_rollup(dimensions: DataFrame, keys: list[str]) -> DataFrame:
    """dimensions: keys, dimension, required, complete, strict_failures. Per report: what is required but incomplete, and whether the report is complete."""
    out = dimensions.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("required") & ~F.col("complete"), F.col("dimension")))).alias("incomplete"), F.sum("strict_failures").alias("strict_failures"))
    return out.withColumn("complete", (F.size("incomplete") == 0) & (F.col("strict_failures") == 0))


def domain_permission(rules: DataFrame, keys: list[str]) -> DataFrame:
    """rules: keys, pattern, permission. Of equal patterns deny wins over allow, allow over none."""
    ranks = F.array(F.lit("none"), F.lit("allow"), F.lit("deny"))
    return rules.groupBy(*keys, "pattern").agg(F.max(F.array_position(ranks, F.col("permission"))).alias("r")).select(*keys, "pattern", F.get(ranks, (F.col("r") - 1).cast("int")).alias("permission"))


#: Rows of one piece where rows are dealt by key, so that what a task holds does not grow with the input.
PIECE = 500_000


def location_index(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """anchors: report, path, line, symbol; files: report, path. One row per different anchor with stable ids; state loaded or referenced_but_not_loaded.

    Both are dealt by report and path once, to as many pieces as their rows take, and made distinct and joined there.
    """
    from contractlake.functions.ids import fingerprint, stable_id

    anchors = anchors.select("report", "path", "line", "symbol")
    pieces = max(anchors.sparkSession.sparkContext.defaultParallelism, 1 + (anchors.count() + files.count()) // PIECE)
    loaded = files.select("report", "path", F.lit("loaded").alias("state")).repartition(pieces, "report", "path").distinct()
    # merge: a small file may hold many rows, and is not to be broadcast by its bytes
    a = anchors.repartition(pieces, "report", "path").distinct().join(loaded.hint("merge"), ["report", "path"], "left")
    return a.select("report", "path", "line", "symbol", stable_id("source", F.col("path")).alias("source_id"), fingerprint("location.", 16, F.col("path"), F.col("line"), F.col("symbol")).alias("location_id"), F.coalesce("state", F.lit("referenced_but_not_loaded")).alias("state"))


def setting_effects(settings: DataFrame) -> DataFrame:
    """settings: setting, status, effects array<struct<location, condition>>. One edge per effect with its index and the operation of its condition."""
    from contractlake.functions.classify import condition_predicate

    e = settings.select("setting", "status", F.posexplode("effects").alias("index", "effect"))
    return e.select("setting", "index", F.col("effect.location").alias("target"), condition_predicate(F.col("effect.condition"))["op"].alias("op"), F.when(F.col("status").isin("legacy", "rejected"), F.col("status")).otherwise(F.lit("accepted")).alias("input_status"))


def layered(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """leaves: keys, path, layer (rank, higher wins), value. The winning value of each path."""
    return leaves.groupBy(*keys, "path").agg(F.max_by("value", "layer").alias("value"), F.max("layer").alias("layer"))


def first_errors(rows: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """The first `most` errors of each record by path and code, with their total. The limit is the report's."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("n", F.row_number().over(w.orderBy("path", "code"))).withColumn("total", F.count("*").over(w)).filter(F.col("n") <= most)


def ordered_position(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Deterministic order of changes in each report: severity rank, kind, entity, id; as a column position from 1."""
    ranks = F.array(F.lit("breaking"), F.lit("attention"), F.lit("info"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(F.array_position(ranks, F.col("severity")), "kind", "entity_id", "id")))
