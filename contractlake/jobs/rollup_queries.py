"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contractlake.operators import checks, headers, rollups

from . import diff_queries
from .registry import query, table

_SEVERITIES = ("info", "warning", "error", "critical")


def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.lit("events").alias("category"), F.upper("event_type").alias("code"), F.col("user_id").cast("string").alias("source_id"), F.lit(None).cast("string").alias("field_id"),
        F.when(F.col("event_id") % 3 == 0, F.lit("$.a")).alias("location"), F.get(F.array(*map(F.lit, _SEVERITIES)), F.floor(v % 4).cast("int")).alias("severity"),
        F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string")).alias("message"), (F.col("event_id") % 50 == 0).alias("strict_failure"), (F.col("event_id") % 60 != 0).alias("recoverable"),
        F.create_map(F.lit("k"), (F.col("event_id") % 2).cast("string")).alias("details"), "event_id",
    )


_DIAGNOSTICS = """d AS (SELECT 'events' AS category, upper(event_type) AS code, user_id::VARCHAR AS source_id, '' AS field_id, CASE WHEN event_id % 3 = 0 THEN '$.a' ELSE '' END AS location, floor(value % 4)::INT AS r, ['info', 'warning', 'error', 'critical'][floor(value % 4)::INT + 1] AS severity,
  'm' || event_id % 5 AS message, event_id % 50 = 0 AS strict_failure, event_id % 60 <> 0 AS recoverable, (event_id % 2)::VARCHAR AS k, event_id FROM events)"""


@query(
    "a1_merge_diagnostics",
    f"WITH {_DIAGNOSTICS} SELECT category, code, source_id, field_id, location, ['info', 'warning', 'error', 'critical'][max(r) + 1] AS severity, array_to_string(list_sort(list(DISTINCT message)), ' | ') AS message, bool_or(strict_failure) AS strict_failure, bool_and(recoverable) AS recoverable, array_to_string(list_sort(list(DISTINCT k)), ' | ') AS k FROM d GROUP BY ALL",
)
def a1(spark: SparkSession, sf: str) -> DataFrame:
    out = rollups.merge_diagnostics(diagnostics(spark, sf).drop("event_id"))
    return out.withColumn("k", F.element_at("details", "k")).drop("details")


@query("a3_collect_diagnostics", f"WITH {_DIAGNOSTICS} SELECT code, source_id, arg_max(severity, event_id) AS severity, arg_max(message, event_id) AS message, max(event_id) AS seq FROM d GROUP BY ALL")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    rows = diagnostics(spark, sf).select("code", "source_id", "severity", "message", F.col("event_id").alias("seq"))
    return rollups.collect_diagnostics(rows, ["code", "source_id"])


@query("a5_warnings_to_diagnostics", f"WITH {_DIAGNOSTICS} SELECT code, message, list_sort(list(DISTINCT location)) AS pointers, list_sort(list(DISTINCT source_id)) AS source_refs FROM d GROUP BY ALL")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    rows = diagnostics(spark, sf).select("code", F.coalesce("location", F.lit("")).alias("pointer"), "message", F.col("source_id").alias("source_ref"))
    return rollups.warnings_to_diagnostics(rows, ["code"])


@query(
    "a6_header_registry",
    """WITH h AS (SELECT p_size % 2 AS direction, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_type, p_brand, p_partkey % 30 = 0 AS c FROM part)
SELECT CASE direction WHEN 0 THEN 'request' ELSE 'response' END AS direction, lower(name) AS header, list_sort(list(DISTINCT name)) AS names, list_sort(list(DISTINCT p_type)) AS categories, list_sort(list(DISTINCT p_brand)) AS origins, bool_or(c) AS continuation, count(*) AS occurrences FROM h GROUP BY ALL""",
)
def a6(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.when(F.col("p_size") % 2 == 0, "request").otherwise("response").alias("direction"), F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("origin"), (k % 30 == 0).alias("continuation"))
    return rollups.header_registry(rows, [])


_FIELDS = """f AS (SELECT l_suppkey % 10 AS report, 'schema' || l_partkey % 50 AS schema_id, 'f' || l_linenumber AS wire_name, CASE WHEN l_tax > 0.07 THEN 'number' ELSE l_returnflag END AS wire_schema, CASE WHEN l_linestatus = 'O' THEN 'schema' || l_orderkey % 80 END AS ref FROM lineitem)"""


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("report"), name("schema", F.col("l_partkey") % 50).alias("schema_id"), name("f", F.col("l_linenumber")).alias("wire_name"),
        F.when(F.col("l_tax") > 0.07, F.lit("number")).otherwise(F.col("l_returnflag")).alias("wire_schema"), F.when(F.col("l_linestatus") == "O", name("schema", F.col("l_orderkey") % 80)).alias("ref"),
    )


@query("a7_schema_registry", f"WITH {_FIELDS} SELECT report, schema_id, wire_name, count(*) AS occurrences, list_sort(list(DISTINCT wire_schema)) AS shapes, count(DISTINCT wire_schema) > 1 AS conflicting FROM f GROUP BY ALL")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    f = _fields(spark, sf)
    return rollups.schema_registry(f, f.select("report", "schema_id").distinct(), ["report"])[0]


@query("a7_opaque_schemas", f"WITH {_FIELDS} SELECT DISTINCT report, ref AS schema_id FROM f WHERE ref IS NOT NULL AND (report, ref) NOT IN (SELECT report, schema_id FROM f)")
def a7_opaque(spark: SparkSession, sf: str) -> DataFrame:
    f = _fields(spark, sf)
    return rollups.schema_registry(f, f.select("report", "schema_id").distinct(), ["report"])[1]


@query(
    "a9_merge_schema_paths",
    """WITH r AS (SELECT p_brand AS report, p_name AS path, lpad(p_partkey::VARCHAR, 9, '0') AS location, p_size = 50 AS required, md5(p_type) AS digest FROM part),
g AS (SELECT report, path, list_sort(list(DISTINCT location)) AS locations, bool_or(required) AS required, arg_min(digest, location) AS digest, list_sort(list(DISTINCT digest)) AS al FROM r GROUP BY ALL)
SELECT report, path, locations, required, digest, list_filter(al, lambda x: x <> digest) AS variants, len(al)::INT AS variant_count FROM g""",
)
def a9(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("report"), F.col("p_name").alias("path"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("location"), (F.col("p_size") == 50).alias("required"), F.md5("p_type").alias("digest"))
    return rollups.merge_schema_paths(rows, ["report"])


@query("a2_source_set_digest", "WITH f AS (SELECT doc_id // 160 AS snapshot, 'f' || lpad(doc_id::VARCHAR, 9, '0') AS path, coalesce(text, '') AS t FROM documents) SELECT snapshot, sha256(string_agg(path || chr(0) || t || chr(0), '' ORDER BY path)) AS set_sha256, count(*) AS files FROM f GROUP BY ALL")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    """Sets of 160 files, as many as a snapshot has."""
    files = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 160).alias("snapshot"), F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.col("text").alias("content"))
    return rollups.set_digest(files, ["snapshot"])


@query("a8_group_counts", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.group_counts(table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment")


@query(
    "a11_compose_graph",
    """WITH n AS (SELECT 'c' || c_custkey AS id, 'config' AS kind, c_name AS label, 1 AS priority FROM customer UNION ALL SELECT 'c' || o_custkey, 'feature', o_orderpriority, 2 FROM orders UNION ALL SELECT 'n' || n_nationkey, 'surface', n_name, 1 FROM nation), m AS (SELECT id, max({'p': priority, 'k': kind, 'l': label}) AS m FROM n GROUP BY id) SELECT id, m.k AS kind, m.l AS label FROM m""",
)
def a11(spark: SparkSession, sf: str) -> DataFrame:
    def nodes(name: str, prefix: str, key: str, kind: str, label: str, priority: int) -> DataFrame:
        return table(spark, sf, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"), F.lit(priority).alias("priority"))

    all_ = nodes("customer", "c", "c_custkey", "config", "c_name", 1).unionByName(nodes("orders", "c", "o_custkey", "feature", "o_orderpriority", 2)).unionByName(nodes("nation", "n", "n_nationkey", "surface", "n_name", 1))
    return rollups.compose_graph(all_, [])


@query(
    "a12_graph_views",
    "WITH e AS (SELECT o_custkey AS f, o_orderkey % 400 AS t FROM orders), k AS (SELECT DISTINCT c_custkey AS t FROM customer WHERE c_acctbal >= 0) SELECT f AS from_id, list_sort(list(DISTINCT t)) AS targets, coalesce(list_sort(list(DISTINCT t) FILTER (t NOT IN (SELECT t FROM k))), []) AS unresolved FROM e GROUP BY f",
)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "orders").select(F.col("o_custkey").alias("from_id"), (F.col("o_orderkey") % 400).alias("to_id"))
    return rollups.graph_views(edges, table(spark, sf, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id")), [])


_EDGES = "e AS (SELECT l_returnflag AS report, l_orderkey || '-' || l_linenumber AS id, 'p' || l_partkey AS f, 's' || l_suppkey AS t, CASE WHEN l_tax > 0.04 THEN l_linestatus END AS x FROM lineitem)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    feature = F.when(F.col("l_tax") > 0.04, F.col("l_linestatus")).alias("feature")
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("report"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), name("p", "l_partkey").alias("from_id"), name("s", "l_suppkey").alias("to_id"), feature, "l_discount")


@query("a12_edge_views", f"WITH {_EDGES} SELECT report, 'source' AS kind, f AS member, id AS edge_id FROM e UNION SELECT report, 'target', t, id FROM e UNION SELECT report, 'feature', x, id FROM e WHERE x IS NOT NULL")
def a12_views(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.edge_views(_edges(spark, sf), ["report"])


@query(
    "a12_graph_coverage",
    f"""WITH {_EDGES}, n AS (SELECT l_returnflag AS report, 'p' || l_partkey AS id FROM lineitem WHERE l_discount > 0.06 UNION SELECT l_returnflag, 's' || l_suppkey FROM lineitem WHERE l_discount > 0.06 UNION SELECT 'N', 'c' || c_custkey FROM customer), u AS (SELECT report, f AS id FROM e UNION SELECT report, t FROM e),
j AS (SELECT coalesce(n.report, u.report) AS report, n.id IS NOT NULL AS known, u.id IS NOT NULL AS used FROM n FULL JOIN u ON n.report = u.report AND n.id = u.id), c AS (SELECT report, count(*) FILTER (known) AS nodes, count(*) FILTER (known AND used) AS linked, count(*) FILTER (NOT known) AS unresolved FROM j GROUP BY report), m AS (SELECT report, count(DISTINCT id) AS edges FROM e GROUP BY report)
SELECT report, nodes, linked, unresolved, coalesce(edges, 0) AS edges FROM c LEFT JOIN m USING (report)""",
)
def a12_coverage(spark: SparkSession, sf: str) -> DataFrame:
    edges = _edges(spark, sf)
    nodes = edges.filter("l_discount > 0.06").select("report", F.explode(F.array("from_id", "to_id")).alias("id"))
    alone = table(spark, sf, "customer").select(F.lit("N").alias("report"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return rollups.graph_coverage(edges, nodes.unionByName(alone), ["report"])


@query(
    "a13_build_edges",
    """WITH r AS (SELECT 'p' || l_partkey AS f, 's' || l_suppkey AS t, l_returnflag AS relation, l_orderkey * 10 + l_linenumber AS seq FROM lineitem) SELECT 'edge.' || substr(sha256(concat_ws('|', f, relation, t)), 1, 16) AS id, f AS from_id, t AS to_id, relation, max(seq) AS seq FROM r GROUP BY ALL""",
)
def a13(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = table(spark, sf, "lineitem").select(name("p", "l_partkey").alias("from_id"), name("s", "l_suppkey").alias("to_id"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return rollups.build_edges(rows)


@query("a14_location_concepts", "SELECT l_suppkey AS path, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS concepts FROM lineitem GROUP BY 1")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.location_concepts(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), F.concat("l_returnflag", "l_linestatus").alias("concept")), [])


@query(
    "a15_status_rollup",
    """WITH d AS (SELECT o_custkey AS report, o_orderpriority AS dimension, o_orderkey % 3 <> 0 AS required, o_orderstatus <> 'P' AS c, (o_orderkey % 10 = 0)::INT AS s FROM orders), g AS (SELECT report, coalesce(list_sort(list(DISTINCT dimension) FILTER (required AND NOT c)), []) AS incomplete, sum(s)::BIGINT AS strict_failures FROM d GROUP BY 1) SELECT *, len(incomplete) = 0 AND strict_failures = 0 AS complete FROM g""",
)
def a15(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("report"), F.col("o_orderpriority").alias("dimension"), (k % 3 != 0).alias("required"), (F.col("o_orderstatus") != "P").alias("complete"), (k % 10 == 0).cast("int").alias("strict_failures"))
    return rollups.status_rollup(rows, ["report"])


@query("a18_identity_groups", "SELECT p_type AS domain, list_sort(list(DISTINCT p_name)) AS fields FROM part GROUP BY 1")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("domain")).agg(F.array_sort(F.collect_set("p_name")).alias("fields"))


@query("a19_domain_permission", "SELECT l_suppkey AS account, 'd' || l_partkey % 40 AS pattern, ['none', 'allow', 'deny'][max(l_orderkey % 3) + 1] AS permission FROM lineitem GROUP BY ALL")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(F.lit("none"), F.lit("allow"), F.lit("deny"))
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("account"), F.concat(F.lit("d"), (F.col("l_partkey") % 40).cast("string")).alias("pattern"), F.get(kinds, (F.col("l_orderkey") % 3).cast("int")).alias("permission"))
    return rollups.domain_permission(rows, ["account"])


@query(
    "a21_location_index",
    """WITH a AS (SELECT DISTINCT l_suppkey % 5 AS report, 'src_' || l_partkey AS path, l_linenumber AS line, l_returnflag AS symbol FROM lineitem)
SELECT report, path, line, symbol, 'source.' || path AS source_id, 'location.' || substr(sha256(concat_ws('|', path, line, symbol)), 1, 16) AS location_id, CASE WHEN substr(path, 5)::INT % 4 = 0 THEN 'referenced_but_not_loaded' ELSE 'loaded' END AS state FROM a""",
)
def a21(spark: SparkSession, sf: str) -> DataFrame:
    path = lambda c: F.concat(F.lit("src_"), F.col(c).cast("string")).alias("path")
    anchors = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("report"), path("l_partkey"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("symbol"))
    files = table(spark, sf, "part").filter("p_partkey % 4 != 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("report"), path("p_partkey"))
    return rollups.location_index(anchors, files)


@query(
    "a22_setting_effects",
    """WITH e AS (SELECT o_orderkey AS setting, o_orderstatus AS st, unnest([{'l': 'a' || o_custkey, 'c': 'always'}, {'l': 'b', 'c': CASE WHEN o_orderkey % 2 = 0 THEN 'when X_Y is set' ELSE 'if odd' END}]) AS e, unnest(range(2)) AS i FROM orders)
SELECT setting, i::INT AS index, e.l AS target, CASE WHEN e.c = 'always' THEN 'const' WHEN e.c LIKE 'when%' THEN 'env_exists' ELSE 'source_condition' END AS op, CASE st WHEN 'F' THEN 'legacy' WHEN 'P' THEN 'rejected' ELSE 'accepted' END AS input_status FROM e""",
)
def a22(spark: SparkSession, sf: str) -> DataFrame:
    effect = lambda l, c: F.struct(l.alias("location"), c.alias("condition"))
    status = F.when(F.col("o_orderstatus") == "F", "legacy").when(F.col("o_orderstatus") == "P", "rejected").otherwise("current")
    effects = F.array(effect(F.concat(F.lit("a"), F.col("o_custkey").cast("string")), F.lit("always")), effect(F.lit("b"), F.when(F.col("o_orderkey") % 2 == 0, "when X_Y is set").otherwise("if odd")))
    return rollups.setting_effects(table(spark, sf, "orders").select(F.col("o_orderkey").alias("setting"), status.alias("status"), effects.alias("effects")))


@query("w13_first_errors", "WITH e AS (SELECT l_suppkey AS record, l_partkey AS path, l_returnflag AS code, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_returnflag, l_orderkey) AS n, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem) SELECT record, path, code, n::INT AS n, total FROM e WHERE n <= 20")
def w13(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("record"), F.col("l_partkey").alias("path"), F.col("l_returnflag").alias("code"))
    return rollups.first_errors(rows, ["record"])


@query("w14_deterministic_order", f"WITH {diff_queries.CHANGES} SELECT *, row_number() OVER (PARTITION BY pair ORDER BY CASE severity WHEN 'breaking' THEN 1 WHEN 'attention' THEN 2 ELSE 3 END, kind, entity_id, id)::INT AS position FROM changes")
def w14(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.ordered_position(diff_queries.changes(spark, sf), ["pair"])


@query(
    "g1_header_overlap",
    "WITH h AS (SELECT DISTINCT p_brand AS surface, p_name AS name FROM part WHERE p_size % 2 = 0), w AS (SELECT DISTINCT p_brand AS surface, p_name AS name FROM part WHERE p_size % 3 = 0) SELECT surface, name, CASE WHEN w.name IS NULL THEN 'http_only' WHEN h.name IS NULL THEN 'ws_only' ELSE 'shared' END AS side FROM (SELECT * FROM h) h FULL JOIN w USING (surface, name)".replace(
        "CASE WHEN w.name IS NULL THEN 'http_only' WHEN h.name IS NULL THEN 'ws_only' ELSE 'shared' END AS side FROM (SELECT * FROM h) h FULL JOIN w USING (surface, name)",
        "CASE WHEN b IS NULL THEN 'http_only' WHEN a IS NULL THEN 'ws_only' ELSE 'shared' END AS side FROM (SELECT *, 1 AS a FROM h) FULL JOIN (SELECT *, 1 AS b FROM w) USING (surface, name)",
    ),
)
def g1(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_brand").alias("surface"), F.col("p_name").alias("name"), "p_size")
    seen = p.groupBy("surface", "name").agg(F.bool_or(F.col("p_size") % 2 == 0).alias("http"), F.bool_or(F.col("p_size") % 3 == 0).alias("ws")).filter("http or ws")
    return seen.select("surface", "name", F.when(F.col("http") & F.col("ws"), "shared").when(F.col("http"), "http_only").otherwise("ws_only").alias("side"))


_OCCURRENCES = """h AS (SELECT p_brand AS surface, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row, CASE WHEN p_size > 25 THEN 'request' ELSE 'response' END AS direction, CASE WHEN p_retailprice > 1200 THEN upper(p_type) ELSE p_type END AS name, CASE WHEN p_size > 10 THEN p_brand END AS category, p_name AS origin, CASE WHEN p_size % 2 = 0 THEN 'text' ELSE 'number' END AS value_shape, CASE WHEN p_size < 40 THEN 'when ' || p_size // 10 END AS condition, NULL AS source_ref, p_size FROM part)"""


def _occurrences(spark: SparkSession, sf: str) -> DataFrame:
    row = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("surface"), row.alias("row"), F.when(size > 25, "request").otherwise("response").alias("direction"), F.when(F.col("p_retailprice") > 1200, F.upper("p_type")).otherwise(F.col("p_type")).alias("name"), F.when(size > 10, F.col("p_brand")).alias("category"),
        F.col("p_name").alias("origin"), F.when(size % 2 == 0, "text").otherwise("number").alias("value_shape"), F.when(size < 40, F.concat(F.lit("when "), F.floor(size / 10).cast("string"))).alias("condition"), F.lit(None).cast("string").alias("source_ref"), "p_size",
    )


@query(
    "a6_header_index",
    f"""WITH {_OCCURRENCES}, f AS (SELECT direction, lower(name) AS header, surface, row, unnest([{{'fact': 'name', 'value': name}}, {{'fact': 'category', 'value': category}}, {{'fact': 'origin', 'value': origin}}, {{'fact': 'value_shape', 'value': value_shape}}, {{'fact': 'condition', 'value': condition}}]) AS u FROM h)
SELECT direction, header, u.fact AS fact, u.value AS value, min({{'s': surface, 'r': row}}).s AS surface, min({{'s': surface, 'r': row}}).r::INT AS row, count(*) AS occurrences FROM f WHERE u.value IS NOT NULL OR u.fact = 'condition' GROUP BY ALL""",
)
def a6_index(spark: SparkSession, sf: str) -> DataFrame:
    return headers.header_index(_occurrences(spark, sf), [])


@query("k16_undeclared_headers", f"WITH {_OCCURRENCES} SELECT DISTINCT surface, direction, lower(name) AS header FROM h WHERE (surface, direction, lower(name)) NOT IN (SELECT surface, direction, lower(name) FROM h WHERE p_size % 3 = 0)")
def k16_undeclared(spark: SparkSession, sf: str) -> DataFrame:
    rows = _occurrences(spark, sf)
    return headers.undeclared(rows, rows.filter("p_size % 3 = 0"), ["surface"])


@query("g1_header_sides", f"WITH {_OCCURRENCES}, g AS (SELECT surface, min(name) AS name, bool_or(direction = 'request') AS a, bool_or(direction = 'response') AS b FROM h GROUP BY surface, lower(name)) SELECT surface, name, CASE WHEN a AND b THEN 'shared' WHEN a THEN 'http_only' ELSE 'ws_only' END AS side FROM g")
def g1_sides(spark: SparkSession, sf: str) -> DataFrame:
    rows = _occurrences(spark, sf)
    return headers.header_overlap(rows.filter("direction = 'request'"), rows.filter("direction = 'response'"), ["surface"])


@query("a18_headers_by_category", f"WITH {_OCCURRENCES} SELECT surface, coalesce(category, 'uncategorized') AS category, true AS optional, p_size > 45 AS sensitive, direction, coalesce(origin, 'client') AS origin, false AS continuation, name, row AS seq FROM h")
def a18_categories(spark: SparkSession, sf: str) -> DataFrame:
    rows = _occurrences(spark, sf).withColumn("optional", F.lit(None).cast("boolean")).withColumn("sensitive", F.when(F.col("p_size") > 45, True)).withColumn("continuation", F.lit(None).cast("boolean")).withColumn("seq", F.col("row").cast("long"))
    return headers.by_category(rows, ["surface"])


@query("a18_identity_fields", "SELECT p_brand AS report, CASE WHEN p_size > 10 THEN p_type ELSE 'other' END AS domain, p_name AS field, count(*) OVER (PARTITION BY p_brand, CASE WHEN p_size > 10 THEN p_type ELSE 'other' END) AS fields FROM (SELECT DISTINCT p_brand, p_name, CASE WHEN p_size > 10 THEN p_type END AS p_type, CASE WHEN p_size > 10 THEN 11 ELSE 1 END AS p_size FROM part)")
def a18_fields(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.identity_groups(table(spark, sf, "part").select(F.col("p_brand").alias("report"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("identity_domain"), F.col("p_name").alias("name")), ["report"])


@query(
    "a5_unavailable_sources",
    """WITH m AS (SELECT c_nationkey AS report, 's' || c_custkey AS source_id, 'src/' || c_custkey || '.rs' AS path, c_acctbal >= 0 AS available, c_mktsegment = 'BUILDING' AS required FROM customer), w AS (SELECT DISTINCT c_nationkey AS report, 'o' || o_orderpriority AS pointer, 'could not read src/' || o_custkey || '.rs: ' || o_orderstatus AS message, o_orderstatus AS source_ref, 's' || o_custkey AS named FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice < 30000)
SELECT report, 'WARNING' AS code, 'warning' AS severity, message, list_sort(list(DISTINCT pointer)) AS pointers, list_sort(list_distinct(list_concat(list(DISTINCT source_ref), list(DISTINCT named)))) AS source_refs FROM w GROUP BY report, message
UNION ALL SELECT report, CASE WHEN required THEN 'REQUIRED' ELSE 'OPTIONAL' END || '_SOURCE_UNAVAILABLE', CASE WHEN required THEN 'error' ELSE 'warning' END, 'expected source unavailable: ' || path, ['/source_manifest/files/' || source_id], [source_id] FROM m WHERE NOT available AND (report, source_id) NOT IN (SELECT report, named FROM w)""",
)
def a5_sources(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    path = lambda k: F.concat(F.lit("src/"), F.col(k).cast("string"), F.lit(".rs"))
    manifest = c.select(F.col("c_nationkey").alias("report"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("source_id"), path("c_custkey").alias("path"), (F.col("c_acctbal") >= 0).alias("available"), (F.col("c_mktsegment") == "BUILDING").alias("required"))
    o = table(spark, sf, "orders").filter("o_totalprice < 30000").join(c, F.col("o_custkey") == F.col("c_custkey"))
    warnings = o.select(F.col("c_nationkey").alias("report"), F.concat(F.lit("o"), F.col("o_orderpriority")).alias("pointer"), F.concat(F.lit("could not read "), path("o_custkey"), F.lit(": "), F.col("o_orderstatus")).alias("message"), F.col("o_orderstatus").alias("source_ref"))
    return rollups.unavailable_sources(warnings, manifest, ["report"])


@query(
    "a11_compose_edges",
    """WITH n AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal >= 0 UNION SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey > 0), e AS (SELECT DISTINCT 'home' AS family, 'c' || c_custkey AS from_id, 'n' || c_nationkey AS to_id, 'lives_in' AS relation FROM customer UNION SELECT DISTINCT 'order', 'c' || o_custkey, 'c' || (o_custkey + 1), 'orders_before' FROM orders)
SELECT family || '.' || substr(sha256(from_id || ':' || to_id), 1, 16) AS id, from_id, to_id, relation FROM e WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n)""",
)
def a11_edges(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    c, n, o = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "orders")
    nodes = c.filter("c_acctbal >= 0").select(name("c", F.col("c_custkey")).alias("id")).unionByName(n.filter("n_regionkey > 0").select(name("n", F.col("n_nationkey")).alias("id")))
    home = c.select(F.lit("home").alias("family"), name("c", F.col("c_custkey")).alias("from_id"), name("n", F.col("c_nationkey")).alias("to_id"), F.lit("lives_in").alias("relation"))
    orders = o.select(F.lit("order").alias("family"), name("c", F.col("o_custkey")).alias("from_id"), name("c", F.col("o_custkey") + 1).alias("to_id"), F.lit("orders_before").alias("relation"))
    return rollups.compose_edges(home.unionByName(orders), nodes, [])


@query(
    "a17_field_order",
    """WITH f AS (SELECT DISTINCT o_custkey AS owner, o_orderpriority AS field FROM orders), o AS (SELECT o_custkey AS owner, CASE WHEN o_totalprice < 20000 THEN 'unknown' ELSE o_orderpriority END AS field FROM orders WHERE o_orderstatus <> 'P'),
e AS (SELECT owner, field, count(*) FILTER (k = 'o') AS o, count(*) FILTER (k = 'f') AS f FROM (SELECT owner, field, 'o' AS k FROM o UNION ALL SELECT owner, field, 'f' FROM f) GROUP BY ALL) SELECT owner, 'FIELD_ORDER_NOT_BIJECTIVE' AS code, count(*) FILTER (o = 0) AS missing, count(*) FILTER (f = 0) AS extra, count(*) FILTER (o > 1) AS repeated FROM e GROUP BY owner HAVING sum(o) > 0 AND bool_or(o <> 1 OR f = 0)""",
)
def a17_order(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("owner", F.col("o_custkey"))
    fields = o.select("owner", F.col("o_orderpriority").alias("field")).distinct()
    order = o.filter("o_orderstatus <> 'P'").select("owner", F.when(F.col("o_totalprice") < 20000, "unknown").otherwise(F.col("o_orderpriority")).alias("field"))
    return checks.field_order_bijection(order, fields, ["owner"])
