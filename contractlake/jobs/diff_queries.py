"""Queries of the diffs and of the release level (K6, K8, K9, K12, A4, A16, K7 leaves)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlake.operators import diffs

from .registry import query, table

PAIRS = 40


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The parts as a contract, before and after made-up edits by key; pair: the key modulo PAIRS."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    k = F.col("p_partkey")
    added = p.filter(k % 19 == 0).withColumn("p_partkey", k + 1_000_000)
    edited = p.filter(k % 17 != 0).select("p_partkey", "p_name", F.when(k % 7 == 0, F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_brand")).alias("p_brand"), F.when(k % 10 == 0, F.concat("p_type", F.lit("x"))).otherwise(F.col("p_type")).alias("p_type"), F.when(k % 13 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    pair = (k % PAIRS).alias("pair")
    return p.select("*", pair), edited.unionByName(added).select("*", pair)


_PARTS = f"""b0 AS (SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, p_partkey % {PAIRS} AS pair FROM part),
a0 AS (SELECT k, p_name, CASE WHEN k % 7 = 0 THEN p_brand || 'x' ELSE p_brand END AS p_brand, CASE WHEN k % 10 = 0 THEN p_type || 'x' ELSE p_type END AS p_type, CASE WHEN k % 13 = 0 THEN p_size + 1 ELSE p_size END AS p_size, pair FROM b0 WHERE k % 17 <> 0
  UNION ALL SELECT k + 1000000, p_name, p_brand, p_type, p_size, (k + 1000000) % {PAIRS} FROM b0 WHERE k % 19 = 0)"""


def _sha(*columns: str):
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)


def _contract(p: DataFrame) -> dict[str, DataFrame]:
    k = F.col("p_partkey")
    name = F.concat(F.lit("n"), k.cast("string")).alias("name")
    fields = p.select(
        "pair", name, F.col("p_type").alias("kind"), F.col("p_name").alias("value_expression"), F.col("p_brand").alias("gate_refs"), F.col("p_size").cast("string").alias("identity_domain"),
        F.when(k % 11 != 0, _sha("p_type", "p_name", "p_size")).alias("emission_fingerprint"), _sha("p_type", "p_name", "p_brand", "p_size").alias("semantic_fingerprint"),
    )
    gates = p.filter(k % 3 == 0).select("pair", name, F.col("p_type").alias("predicate"), _sha("p_type").alias("semantic_fingerprint"))
    sources = p.filter(k % 5 == 0).select("pair", name, F.col("p_brand").alias("path_candidates"))
    return {"fields": fields, "gates": gates, "sources": sources}


def changes(spark: SparkSession, sf: str) -> DataFrame:
    before, after = _parts(spark, sf)
    return diffs.contract_diff(_contract(before), _contract(after))


def _side(x: str) -> str:
    return f"""{x}f AS (SELECT pair, 'n' || k AS name, p_type AS kind, p_name AS v, p_brand AS g, p_size::VARCHAR AS d, CASE WHEN k % 11 <> 0 THEN sha256(concat_ws('|', p_type, p_name, p_size)) END AS e, sha256(concat_ws('|', p_type, p_name, p_brand, p_size)) AS s FROM {x}0),
{x}g AS (SELECT pair, 'n' || k AS name, p_type AS p, sha256(p_type) AS s FROM {x}0 WHERE k % 3 = 0), {x}s AS (SELECT pair, 'n' || k AS name, p_brand AS p FROM {x}0 WHERE k % 5 = 0)"""


CHANGES = f"""{_PARTS}, {_side('b')}, {_side('a')},
jf AS (SELECT coalesce(b.pair, a.pair) AS pair, coalesce(b.name, a.name) AS name, b, a FROM bf b FULL JOIN af a ON b.pair = a.pair AND b.name = a.name),
df AS (SELECT * FROM jf WHERE b.s IS NULL OR a.s IS NULL OR (b.s <> a.s AND NOT (b.e IS NOT NULL AND b.e = a.e))),
jg AS (SELECT coalesce(b.pair, a.pair) AS pair, coalesce(b.name, a.name) AS name, b, a FROM bg b FULL JOIN ag a ON b.pair = a.pair AND b.name = a.name),
js AS (SELECT coalesce(b.pair, a.pair) AS pair, coalesce(b.name, a.name) AS name, b, a FROM bs b FULL JOIN as_ a ON b.pair = a.pair AND b.name = a.name),
c0 AS (
  SELECT pair, 'field_added' AS kind, 'turn_metadata.field.' || name AS entity_id, 'attention' AS severity, NULL AS before, a.s AS after FROM df WHERE b.s IS NULL
  UNION ALL SELECT pair, 'field_removed', 'turn_metadata.field.' || name, 'breaking', b.s, NULL FROM df WHERE a.s IS NULL
  UNION ALL SELECT pair, 'field_gate_changed', 'turn_metadata.field.' || name, 'breaking', b.g, a.g FROM df WHERE b.g <> a.g
  UNION ALL SELECT pair, 'field_emission_kind_changed', 'turn_metadata.field.' || name, 'breaking', b.kind, a.kind FROM df WHERE b.kind <> a.kind
  UNION ALL SELECT pair, 'field_value_expression_changed', 'turn_metadata.field.' || name, 'attention', b.v, a.v FROM df WHERE b.v <> a.v
  UNION ALL SELECT pair, 'field_identity_domain_changed', 'turn_metadata.field.' || name, 'breaking', b.d, a.d FROM df WHERE b.d <> a.d
  UNION ALL SELECT pair, 'gate_added', 'turn_metadata.gate.' || name, 'attention', NULL, a.s FROM jg WHERE b.s IS NULL
  UNION ALL SELECT pair, 'gate_removed', 'turn_metadata.gate.' || name, 'attention', b.s, NULL FROM jg WHERE a.s IS NULL
  UNION ALL SELECT pair, 'gate_predicate_changed', 'turn_metadata.gate.' || name, 'breaking', b.p, a.p FROM jg WHERE b.s <> a.s
  UNION ALL SELECT pair, 'source_spec_added', name, 'info', NULL, a.p FROM js WHERE b.p IS NULL
  UNION ALL SELECT pair, 'source_spec_removed', name, 'attention', b.p, NULL FROM js WHERE a.p IS NULL
  UNION ALL SELECT pair, 'source_path_candidates_changed', name, 'info', b.p, a.p FROM js WHERE b.p <> a.p),
changes AS (SELECT *, 'change.' || substr(sha256(concat_ws('|', kind, entity_id, coalesce(before, 'null'), coalesce(after, 'null'))), 1, 24) AS id FROM c0)""".replace("as AS (", "as_ AS (")


@query("k6_contract_diff", f"WITH {CHANGES} SELECT * FROM changes")
def k6(spark: SparkSession, sf: str) -> DataFrame:
    return changes(spark, sf)


@query(
    "a4_severity_summary",
    f"WITH {CHANGES} SELECT pair, count(*) FILTER (severity = 'breaking') AS breaking, count(*) FILTER (severity = 'attention') AS attention, count(*) FILTER (severity = 'info') AS info, count(*) AS total, CASE WHEN bool_or(severity = 'breaking') THEN 'breaking' WHEN bool_or(severity = 'attention') THEN 'attention' ELSE 'info' END AS highest FROM changes GROUP BY pair",
)
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return diffs.severity_counts(changes(spark, sf), ["pair"], ("breaking", "attention", "info"))


def _extractors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    base = s.select((k % PAIRS).alias("pair"), F.col("s_name").alias("name"), (k % 3 == 0).alias("semantic_complete"), F.sha2(k.cast("string"), 256).alias("digest"), k.alias("k"))
    after = base.filter("k % 23 != 0").withColumn("digest", F.when(F.col("k") % 29 == 0, F.sha2("name", 256)).otherwise(F.col("digest"))).withColumn("semantic_complete", F.when(F.col("k") % 31 == 0, ~F.col("semantic_complete")).otherwise(F.col("semantic_complete")))
    return base.filter("k % 37 != 0").drop("k"), after.drop("k")


EXTRACTORS = f"""xb AS (SELECT s_suppkey AS k, s_suppkey % {PAIRS} AS pair, s_name AS name, s_suppkey % 3 = 0 AS c, sha256(s_suppkey::VARCHAR) AS d FROM supplier WHERE s_suppkey % 37 <> 0),
xa AS (SELECT s_suppkey AS k, s_suppkey % {PAIRS} AS pair, s_name AS name, CASE WHEN s_suppkey % 31 = 0 THEN s_suppkey % 3 <> 0 ELSE s_suppkey % 3 = 0 END AS c, CASE WHEN s_suppkey % 29 = 0 THEN sha256(s_name) ELSE sha256(s_suppkey::VARCHAR) END AS d FROM supplier WHERE s_suppkey % 23 <> 0),
xj AS (SELECT coalesce(b.pair, a.pair) AS pair, coalesce(b.name, a.name) AS extractor_id, b, a FROM xb b FULL JOIN xa a ON b.k = a.k),
extractors AS (SELECT pair, 'extractor_added' AS kind, extractor_id, 'minor' AS severity FROM xj WHERE b.d IS NULL UNION ALL SELECT pair, 'extractor_removed', extractor_id, 'major' FROM xj WHERE a.d IS NULL
  UNION ALL SELECT pair, 'extractor_completeness_regressed', extractor_id, 'major' FROM xj WHERE b.c AND NOT a.c UNION ALL SELECT pair, 'extractor_completeness_completed', extractor_id, 'minor' FROM xj WHERE NOT b.c AND a.c
  UNION ALL SELECT pair, 'extractor_semantics_changed', extractor_id, 'major' FROM xj WHERE b.d <> a.d AND extractor_id <> 'Supplier#000000029')"""


@query("k8_extractor_evolution", f"WITH {EXTRACTORS} SELECT * FROM extractors")
def k8(spark: SparkSession, sf: str) -> DataFrame:
    return diffs.extractor_evolution(*_extractors(spark, sf), classified=("Supplier#000000029",))


@query(
    "a16_release_level",
    f"""WITH {CHANGES}, {EXTRACTORS}, pairs AS (SELECT DISTINCT p_partkey % {PAIRS} AS pair FROM part),
n AS (SELECT p.pair, (SELECT count(*) FROM changes c WHERE c.pair = p.pair AND severity = 'breaking') AS b, (SELECT count(*) FROM changes c WHERE c.pair = p.pair AND severity = 'attention') AS t, (SELECT count(*) FROM changes c WHERE c.pair = p.pair AND severity = 'info') AS i,
  (SELECT count(*) FROM extractors c WHERE c.pair = p.pair AND severity = 'major') AS xj, (SELECT count(*) FROM extractors c WHERE c.pair = p.pair AND severity = 'minor') AS xn FROM pairs p WHERE p.pair % 9 <> 0),
m AS (SELECT *, pair % 8 = 0 AS schema, CASE WHEN b > 0 OR pair % 8 = 0 OR xj > 0 THEN 'major' WHEN t > 0 OR xn > 0 THEN 'minor' ELSE 'patch' END AS level FROM n)
SELECT pair, level, CASE level WHEN 'major' THEN (pair + 1) || '.0.0' WHEN 'minor' THEN pair || '.3.0' ELSE pair || '.2.4' END AS version,
  list_sort(list_filter([CASE WHEN b > 0 THEN 'semantic_diff_breaking' WHEN t > 0 THEN 'semantic_diff_attention' WHEN i > 0 THEN 'semantic_diff_info' ELSE 'exact_source_changed' END, CASE WHEN schema THEN 'contract_schema_changed' END,
    CASE WHEN xj > 0 THEN 'canonical_extractor_changed' WHEN xn > 0 AND NOT (b > 0 OR schema) THEN 'canonical_extractor_added_or_completed' END], lambda x: x IS NOT NULL)) AS reasons FROM m""",
)
def a16(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs divisible by 9 have the same commit twice and give no row; those divisible by 8 change the schema version."""
    pair = F.col("pair")
    pairs = table(spark, sf, "part").select((F.col("p_partkey") % PAIRS).alias("pair")).distinct()
    pairs = pairs.select(
        "pair", F.concat(pair.cast("string"), F.lit(".2.3")).alias("previous_version"), F.lit("c0").alias("commit_before"), F.when(pair % 9 == 0, F.lit("c0")).otherwise(F.lit("c1")).alias("commit_after"),
        F.lit("v1").alias("schema_version_before"), F.when(pair % 8 == 0, F.lit("v2")).otherwise(F.lit("v1")).alias("schema_version_after"), F.lit("p").alias("coverage_profile_before"), F.lit("p").alias("coverage_profile_after"),
    )
    return diffs.release_level(pairs, changes(spark, sf), diffs.extractor_evolution(*_extractors(spark, sf), classified=("Supplier#000000029",)))


HISTORY = "states AS (SELECT c_nationkey AS catalog, year(o_orderdate) * 12 + month(o_orderdate) AS version, o_orderpriority AS key, max(o_orderstatus) AS state FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Per nation (catalog) and month (version): each priority (key) has a state."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    version = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("version")
    return j.groupBy(F.col("c_nationkey").alias("catalog"), version, F.col("o_orderpriority").alias("key")).agg(F.max("o_orderstatus").alias("state"))


@query(
    "k9_version_diff",
    f"""WITH {HISTORY}, b AS (SELECT catalog, key, state AS before FROM states WHERE version = 1996 * 12 + 1), a AS (SELECT catalog, key, state AS after FROM states WHERE version = 1998 * 12 + 6),
j AS (SELECT catalog, key, before, after FROM b FULL JOIN a USING (catalog, key) WHERE before IS DISTINCT FROM after)
SELECT *, 'history-change.' || substr(sha256(concat_ws('|', key, coalesce(before, 'null'), coalesce(after, 'null'))), 1, 20) AS id FROM j""",
)
def k9(spark: SparkSession, sf: str) -> DataFrame:
    return diffs.version_diff(history(spark, sf), F.lit(1996 * 12 + 1), F.lit(1998 * 12 + 6))


@query(
    "k12_field_set_delta",
    """WITH l AS (SELECT p_brand AS k, p_name AS wire_name, max(p_type) AS t, bool_or(p_size > 40) AS o FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), r AS (SELECT p_brand AS k, p_name AS wire_name, max(p_type) AS t, bool_or(p_size > 40) AS o FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL)
SELECT k, wire_name, CASE WHEN r.t IS NULL THEN 'left_only' WHEN l.t IS NULL THEN 'right_only' ELSE 'shared' END AS side, l.t AS left_type, r.t AS right_type, CASE WHEN l.t IS NOT NULL AND r.t IS NOT NULL THEN l.t = r.t END AS same_type, l.o AS left_optional, r.o AS right_optional FROM l FULL JOIN r USING (k, wire_name)""",
)
def k12(spark: SparkSession, sf: str) -> DataFrame:
    def fields(condition: str) -> DataFrame:
        return table(spark, sf, "part").filter(condition).groupBy(F.col("p_brand").alias("k"), F.col("p_name").alias("wire_name")).agg(F.max("p_type").alias("type"), F.bool_or(F.col("p_size") > 40).alias("optional"))

    return diffs.field_set_delta(fields("p_partkey % 2 = 0"), fields("p_partkey % 3 = 0"), ["k"])
