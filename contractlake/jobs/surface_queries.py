"""Queries of text extraction, coverage, sources and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contractlake.functions import canonical
from contractlake.operators import conformance, coverage, lineage
from contractlake.operators.extractors import ExtractorRegistry
from contractlake.sources import records as S
from contractlake.streaming import state
from contractlake.streaming import turns as T
from contractlake.streaming.projection import Projection

from .registry import query, table


def _name(prefix: str, column):
    return F.concat(F.lit(prefix), column.cast("string"))


def _rust(spark: SparkSession, sf: str) -> DataFrame:
    """A source text around each part's name: two constants, of which one's name begins the other's, headers, and a map that is none."""
    k = F.col("p_partkey")
    n = lambda m: (k % m).cast("string")
    text = F.concat(
        F.lit("pub mod "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(";\npub(crate) const H_"), n(40), F.lit('X: &str = "other";\n  const   H_'), n(40), F.lit(': &str = "x-head-'), n(40),
        F.lit('";\nfn f() { headers.insert("X-Lit-'), n(7), F.lit('", v); map.insert("plain-key", 1); insert_header(req, "x-real-'), n(5), F.lit('"); response_headers.get(H_'), n(50), F.lit('); kind("response.'), F.col("p_type"), F.lit('-Item_1.done"); kind("session.done"); kind("other.x"); }\n  pub(in crate::x) mod '), F.col("p_type"), F.lit(";\nstruct HttpClient; // a FooClient\npub use client::Part"), F.col("p_type"), F.lit("Client;\n use inner::OtherClient;")
    )
    return table(spark, sf, "part").select(k.alias("file"), F.col("p_brand").alias("snapshot"), text.alias("text"))


_RUST = """t AS (SELECT p_partkey AS k, p_brand AS snapshot, 'pub mod ' || replace(p_name, ' ', '_') || ';' || chr(10) || 'pub(crate) const H_' || p_partkey % 40 || 'X: &str = "other";' || chr(10) || '  const   H_' || p_partkey % 40 || ': &str = "x-head-' || p_partkey % 40 || '";' AS head FROM part)"""


@query(
    "p2_const_definitions",
    f"""WITH {_RUST} SELECT k AS file, 'H_' || k % 40 || 'X' AS name, 'other' AS value, strpos(head, 'const H_')::INT AS offset FROM t UNION ALL SELECT k, 'H_' || k % 40, 'x-head-' || k % 40, strpos(head, 'const   H_')::INT FROM t""",
)
def p2(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.const_definitions(_rust(spark, sf), ["file"])


@query(
    "p3_header_candidates",
    f"""WITH {_RUST}, c AS (SELECT DISTINCT snapshot, k % 40 AS n FROM t) SELECT k AS file, snapshot, 'written' AS direction, 'x-lit-' || k % 7 AS header, 'X-Lit-' || k % 7 AS name FROM t UNION ALL SELECT k, snapshot, 'written', 'x-real-' || k % 5, 'x-real-' || k % 5 FROM t
UNION ALL SELECT k, t.snapshot, 'read', 'x-head-' || n, 'x-head-' || n FROM t JOIN c ON c.snapshot = t.snapshot AND c.n = t.k % 50""",
)
def p3(spark: SparkSession, sf: str) -> DataFrame:
    files = _rust(spark, sf)
    keys = ["file", "snapshot"]
    return coverage.header_candidates(files, coverage.const_definitions(files, keys), keys, ["snapshot"])


@query("p4_event_kinds", "SELECT p_partkey AS file, ['response.' || p_type || '-Item_1.done', 'session.done'] AS names FROM part")
def p4(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.literals(_rust(spark, sf), ["file"], coverage.event_kinds("response", "session"))


@query("p5_module_inventory", "SELECT p_partkey AS file, list_sort([replace(p_name, ' ', '_'), p_type]) AS modules, ['Part' || p_type || 'Client'] AS clients FROM part")
def p5(spark: SparkSession, sf: str) -> DataFrame:
    files = _rust(spark, sf)
    modules = coverage.literals(files, ["file"], coverage.MODULES).withColumnRenamed("names", "modules")
    return modules.join(coverage.literals(files, ["file"], coverage.CLIENTS).withColumnRenamed("names", "clients"), "file")


@query(
    "j2_key_collisions",
    r"""WITH w AS (SELECT doc_id AS doc, unnest(list_distinct(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS word FROM documents),
n AS (SELECT doc, word AS name FROM w UNION SELECT doc, replace(replace(word, 'e', chr(233)), 'o', 'o' || chr(776)) FROM w WHERE length(word) > 6 UNION SELECT doc, replace(replace(word, 'e', 'e' || chr(769)), 'o', chr(246)) FROM w WHERE word LIKE '%s')
SELECT doc, '/o' AS object, nfc_normalize(name) AS normal, count(DISTINCT name) AS spellings FROM n GROUP BY ALL HAVING count(DISTINCT name) > 1""",
)
def j2(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's words as member names, long ones and those in -s with accents in two spellings."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    accents = lambda e, o: lambda w: F.replace(F.replace(w, F.lit("e"), F.lit(e)), F.lit("o"), F.lit(o))

    def names(words: Column) -> Column:
        long = F.transform(F.filter(words, lambda w: F.length(w) > 6), accents("\u00e9", "o\u0308"))
        plural = F.transform(F.filter(words, lambda w: w.endswith("s")), accents("e\u0301", "\u00f6"))
        return F.array_distinct(F.concat(words, long, plural))

    # a lambda's argument is made once, however often it is used
    once = lambda column, made: F.transform(F.array(column), made)[0]
    text = once(once(words, names), lambda n: F.to_json(F.struct(F.map_from_arrays(n, F.transform(n, lambda _: F.lit(1))).alias("o"))))
    return coverage.key_collisions(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), text.alias("t")), "doc", "t")


RULES = [
    ("/kind", "enum", "click,view"), ("/k", "type", "integer"), ("/k", "max", "80"), ("/user", "pattern", "^u[0-9]+$"), ("/need", "required", None), ("", "closed", "kind,k,user,need,more,score,lang,tags"),
    ("/score", "max", "80.5"), ("/score", "min", "3"), ("/lang", "enum", "\u00e9,b"), ("/tags", "max_properties", "2"), ("/tags", "members", "string"), ("", "not_required", "need,odd"), ("", "one_of", "kind|click:need,k|view:"),
]


@query(
    "j15_schema_conformance",
    """WITH e AS (SELECT event_id, event_type AS kind, event_id % 20 = 0 AS broken, json_extract(props, '$.k')::INT AS k, event_id % 4 <> 0 AS need, event_id % 5 = 0 AS odd, 1.5 + event_id % 100 AS score FROM events),
r AS (SELECT event_id, CASE WHEN broken THEN [{'p': '', 'r': 'parse'}] ELSE list_filter([CASE WHEN kind NOT IN ('click', 'view') THEN {'p': '/kind', 'r': 'enum'} END, CASE WHEN k > 80 THEN {'p': '/k', 'r': 'max'} END,
  CASE WHEN event_id % 3 = 0 THEN {'p': '/user', 'r': 'pattern'} END, CASE WHEN NOT need THEN {'p': '/need', 'r': 'required'} END, CASE WHEN odd THEN {'p': '/odd', 'r': 'closed'} END,
  CASE WHEN score > 80.5 THEN {'p': '/score', 'r': 'max'} END, CASE WHEN score < 3 THEN {'p': '/score', 'r': 'min'} END, CASE WHEN event_id % 7 = 0 THEN {'p': '/lang', 'r': 'enum'} END,
  CASE WHEN event_id % 6 = 0 THEN {'p': '/tags', 'r': 'max_properties'} END, CASE WHEN event_id % 6 = 0 THEN {'p': '/tags', 'r': 'members'} END,
  CASE WHEN need AND odd THEN {'p': '', 'r': 'not_required'} END, CASE WHEN NOT (kind = 'view' OR (kind = 'click' AND need AND k IS NOT NULL)) THEN {'p': '', 'r': 'one_of'} END], lambda x: x IS NOT NULL) END AS e FROM e)
SELECT event_id, u.p AS pointer, u.r AS rule FROM (SELECT event_id, unnest(e) AS u FROM r)""",
)
def j15(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    tags = F.struct(F.lit("x").alias("a"), F.lit("y").alias("b"), F.when(k % 6 == 0, 1).alias("c"))
    doc = F.to_json(
        F.struct(
            F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.concat(F.when(k % 3 == 0, "x").otherwise("u"), F.col("user_id").cast("string")).alias("user"), F.when(k % 4 != 0, 1).alias("need"), F.when(k % 5 == 0, 1).alias("odd"),
            (k % 100 + F.lit(1.5)).cast("double").alias("score"), F.when(k % 7 == 0, "\u00e8").otherwise("\u00e9").alias("lang"), tags.alias("tags"),
        )
    )
    docs = table(spark, sf, "events").select("event_id", F.when(k % 20 == 0, "{").otherwise(doc).alias("t"))
    return coverage.schema_conformance(docs, spark.createDataFrame(RULES, "pointer string, rule string, arg string"), "event_id", "t")


_SCHEMA = """{"type":"object","required":["orders"],"properties":{"key":{"type":"integer","maximum":%s},"bal":{"exclusiveMinimum":0},"orders":{"minItems":4,"items":{"$ref":"#/$defs/order"},"contains":{"properties":{"s":{"const":"P"}},"required":["s"]}},"by":{"additionalProperties":{"type":"integer"},"propertyNames":{"pattern":"^[FO]$"}}},"oneOf":[{"properties":{"bal":{"minimum":5000}}},{"properties":{"key":{"minimum":%s}}}],"$defs":{"order":{"required":["p"],"properties":{"s":{"enum":["O","F",7]},"p":{"maximum":%s}}}}}"""


@query(
    "j15_compiled_schemas",
    f"""WITH s AS (SELECT c_mktsegment AS schema, format('{_SCHEMA.replace("{", "{{").replace("}", "}}").replace("%s", "{}")}', max(c_custkey) - 50, max(c_custkey) // 2, 100000 + 1000 * length(c_mktsegment))::JSON AS j FROM customer GROUP BY 1),
r AS (SELECT schema, json_extract(j, '$.properties.key.maximum')::BIGINT AS most, json_extract(j, '$.properties.bal.exclusiveMinimum')::DOUBLE AS over, json_extract(j, '$.properties.orders.minItems')::INT AS least, json_extract_string(j, '$.properties.orders.contains.properties.s.const') AS one, json_extract_string(j, '$.properties.by.propertyNames.pattern') AS pattern,
  json_extract(j, '$."$defs".order.properties.s.enum')::JSON[] AS listed, json_extract(j, '$."$defs".order.properties.p.maximum')::DOUBLE AS price, json_extract(j, '$.oneOf[0].properties.bal.minimum')::DOUBLE AS bal0, json_extract(j, '$.oneOf[1].properties.key.minimum')::BIGINT AS key1 FROM s),
c AS (SELECT *, c_custkey AS doc, c_mktsegment AS schema FROM customer), o AS (SELECT *, o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_totalprice >= 20000 AS priced FROM orders),
n AS (SELECT doc, count(*) AS n, bool_or(o_orderstatus = 'P') AS p FROM o GROUP BY 1), e AS (
SELECT doc, '/key' AS pointer, 'maximum' AS keyword FROM c JOIN r USING (schema) WHERE doc > most UNION ALL SELECT doc, '/bal', 'exclusiveMinimum' FROM c JOIN r USING (schema) WHERE c_acctbal <= over
UNION ALL SELECT doc, '', 'required' FROM c WHERE doc NOT IN (SELECT doc FROM n) UNION ALL SELECT doc, '', 'oneOf' FROM c JOIN r USING (schema) WHERE (c_acctbal >= bal0) = (doc >= key1)
UNION ALL SELECT doc, '/orders', 'minItems' FROM c JOIN r USING (schema) JOIN n USING (doc) WHERE n < least UNION ALL SELECT doc, '/orders', 'contains' FROM n WHERE NOT p
UNION ALL SELECT doc, '/orders/' || i || '/s', 'enum' FROM o JOIN c USING (doc) JOIN r USING (schema) WHERE NOT list_contains(listed, to_json(o_orderstatus)) UNION ALL SELECT doc, '/orders/' || i, 'required' FROM o WHERE NOT priced
UNION ALL SELECT doc, '/orders/' || i || '/p', 'maximum' FROM o JOIN c USING (doc) JOIN r USING (schema) WHERE priced AND o_totalprice > price
UNION ALL SELECT doc, '/by', 'pattern' FROM (SELECT DISTINCT doc, o_orderstatus FROM o) JOIN c USING (doc) JOIN r USING (schema) WHERE NOT regexp_matches(o_orderstatus, pattern) UNION ALL SELECT doc, '/by/' || o_orderstatus, 'type' FROM o GROUP BY doc, o_orderstatus HAVING count(*) % 2 = 1)
SELECT DISTINCT doc, pointer, keyword FROM e""",
)
def j15_compiled(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their orders as records, a schema for each segment with limits of that segment's own rows."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    schemas = c.groupBy(F.col("c_mktsegment").alias("schema")).agg(F.format_string(_SCHEMA, (F.max(k) - 50).cast("string"), F.floor(F.max(k) / 2).cast("string"), (100000 + 1000 * F.length("c_mktsegment")).cast("string")).alias("text"))
    order = F.struct("o_orderkey", F.col("o_orderstatus").alias("s"), F.when(F.col("o_totalprice") >= 20000, F.col("o_totalprice")).alias("p"))
    o = table(spark, sf, "orders")
    orders = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(x["s"].alias("s"), x["p"].alias("p"))).alias("orders"))
    by = o.groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderstatus").agg((F.count("*") / 2).alias("n")).groupBy("c_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("by"))
    text = F.to_json(F.struct(k.alias("key"), F.col("c_acctbal").alias("bal"), "orders", "by"))
    docs = c.join(orders, "c_custkey", "left").join(by, "c_custkey", "left").select(k.alias("doc"), F.col("c_mktsegment").alias("schema"), text.alias("t"))
    return conformance.conformance(docs, schemas, "doc", "t", most=1 << 30).select("doc", "pointer", "keyword")


@query(
    "j16_schema_paths",
    """SELECT p_partkey AS doc, u.p AS path, u.r AS required, CASE WHEN u.t <> '' THEN [u.t] ELSE [] END AS types FROM (SELECT p_partkey, unnest([{'p': '', 'r': true, 't': ''}, {'p': 'a', 'r': true, 't': 'object'}, {'p': 'a.b', 'r': false, 't': 'string'}, {'p': 'a.*', 'r': false, 't': 'number'}, {'p': 'l', 'r': false, 't': 'array'}, {'p': 'l[]', 'r': false, 't': 'integer'},
  {'p': 'r', 'r': false, 't': ''}, {'p': 'r', 'r': false, 't': 'boolean'}, {'p': 'r', 'r': false, 't': ''}, {'p': 'r.' || replace(p_name, ' ', '_'), 'r': true, 't': ''}, {'p': 'any', 'r': false, 't': ''}]) AS u FROM part)""",
)
def j16(spark: SparkSession, sf: str) -> DataFrame:
    """The definition r refers to itself below, which stops there; a member stands beside a reference, and one schema is only true."""
    schema = '{"required":["a"],"properties":{"a":{"type":"object","properties":{"b":{"type":"string"}},"additionalProperties":{"type":"number"}},"l":{"type":"array","items":{"type":"integer"}},"any":true,"r":{"$ref":"#/d/r","additionalProperties":false,"required":["NAME"],"properties":{"NAME":true}}},"d":{"r":{"type":"boolean","allOf":[{"$ref":"#/d/r"}]}}}'
    text = F.replace(F.lit(schema), F.lit("NAME"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return canonical.schema_paths(table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), text.alias("t")), "doc", "t").select("doc", "path", "required", "types")


@query(
    "k13_frame_mapping",
    """WITH f AS (SELECT DISTINCT p_brand AS k, p_size AS frame FROM part WHERE p_size <= 25), h AS (SELECT DISTINCT p_brand AS k, p_size AS h FROM part WHERE p_partkey % 3 = 0), p AS (SELECT range AS frame, range AS h FROM range(20)), j AS (SELECT f.k, f.frame, p.h, h.h IS NOT NULL AS hit FROM f LEFT JOIN p USING (frame) LEFT JOIN h ON h.k = f.k AND h.h = p.h)
SELECT k, 'f' || frame AS name, CASE WHEN hit THEN 'paired' ELSE 'ws_only' END AS status FROM j UNION ALL SELECT k, 'h' || h, 'http_only' FROM h WHERE (k, h) NOT IN (SELECT k, h FROM j WHERE hit)""",
)
def k13(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    frames = p.filter("p_size <= 25").select(F.col("p_brand").alias("k"), _name("f", F.col("p_size")).alias("frame")).distinct()
    headers = p.filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("k"), _name("h", F.col("p_size")).alias("header"))
    pairs = spark.range(20).select(_name("f", F.col("id")).alias("frame"), _name("h", F.col("id")).alias("header"))
    return coverage.frame_mapping(frames, headers, pairs, ["k"])


@query("k14_feature_crosswalk", """WITH f AS (SELECT c_custkey AS x FROM customer WHERE c_acctbal >= 0), p AS (SELECT DISTINCT o_custkey AS x FROM orders WHERE o_totalprice < 100000) SELECT 'f' || coalesce(f.x, p.x) AS feature, CASE WHEN f.x IS NULL THEN 'schema_only' WHEN p.x IS NOT NULL THEN 'direct' WHEN f.x % 7 = 0 THEN 'embedded' WHEN f.x % 7 = 1 THEN 'intentionally_omitted' ELSE 'missing' END AS representation FROM f FULL JOIN p ON f.x = p.x""")
def k14(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k, "c_acctbal", _name("f", k).alias("feature"))
    policy = c.filter("c_custkey % 7 < 2").select("feature", F.when(k % 7 == 0, "embed").otherwise("omit").alias("action"))
    return coverage.feature_crosswalk(c.filter("c_acctbal >= 0").select("feature"), table(spark, sf, "orders").filter("o_totalprice < 100000").select(_name("f", F.col("o_custkey")).alias("feature")), policy)


@query("k15_effect_links", """WITH e AS (SELECT o_orderkey AS effect, unnest(['p' || o_custkey, 'q' || o_orderkey % 10]) AS asked FROM orders), x AS (SELECT 'p' || c_custkey AS path FROM customer WHERE c_acctbal >= 3000 UNION SELECT 'profiles.*.p' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
h AS (SELECT effect, asked, path, true AS found FROM e JOIN x ON path = asked OR path = 'profiles.*.' || asked) SELECT * FROM h UNION ALL SELECT effect, asked, asked, false FROM e WHERE (effect, asked) NOT IN (SELECT effect, asked FROM h)""")
def k15(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    effects = table(spark, sf, "orders").select(F.col("o_orderkey").alias("effect"), F.array(_name("p", F.col("o_custkey")), _name("q", F.col("o_orderkey") % 10)).alias("paths"))
    customers = table(spark, sf, "customer")
    paths = customers.filter("c_acctbal >= 3000").select(_name("p", c).alias("path")).unionByName(customers.filter("c_mktsegment = 'BUILDING'").select(_name("profiles.*.p", c).alias("path")))
    return coverage.effect_links(effects, paths)


@query("k16_surface_coverage", """WITH x AS (SELECT o_custkey AS module, bool_and(o_totalprice >= 30000) AS a FROM orders GROUP BY 1) SELECT c_custkey AS module, CASE WHEN c_acctbal < 0 THEN 'excluded' WHEN a IS NULL THEN 'unclassified' WHEN a THEN 'classified' ELSE 'incomplete' END AS state FROM customer LEFT JOIN x ON module = c_custkey""")
def k16(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    surface = F.col("o_orderkey").alias("surface")
    return coverage.surface_coverage(c.select(F.col("c_custkey").alias("module")), o.select(F.col("o_custkey").alias("module"), surface), o.filter("o_totalprice >= 30000").select(surface), c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("module")))


@query("k17_event_catalog", """WITH d AS (SELECT DISTINCT 'k' || l_partkey AS kind FROM lineitem WHERE l_quantity > 45), p AS (SELECT 'k' || p_partkey AS kind, p_type AS disposition FROM part WHERE p_size < 25) SELECT coalesce(d.kind, p.kind) AS kind, coalesce(disposition, 'discovered_not_classified') AS disposition, d.kind IS NOT NULL AS discovered FROM d FULL JOIN p ON d.kind = p.kind""")
def k17(spark: SparkSession, sf: str) -> DataFrame:
    discovered = table(spark, sf, "lineitem").filter("l_quantity > 45").select(_name("k", F.col("l_partkey")).alias("kind"))
    return coverage.event_catalog(discovered, table(spark, sf, "part").filter("p_size < 25").select(_name("k", F.col("p_partkey")).alias("kind"), F.col("p_type").alias("disposition")))


@query(
    "k20_profile_evaluation",
    """WITH r AS (SELECT o_custkey AS report, list(DISTINCT o_orderpriority) AS o, c_acctbal < 0 AS legacy, c_mktsegment AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
m AS (SELECT *, list_sort(list_filter(CASE p WHEN 'BUILDING' THEN ['1-URGENT', '2-HIGH'] WHEN 'MACHINERY' THEN ['3-MEDIUM', '5-LOW'] ELSE [] END, lambda x: NOT list_contains(o, x))) AS missing FROM r),
c AS (SELECT *, CASE WHEN p NOT IN ('BUILDING', 'MACHINERY') THEN 'PROFILE_UNKNOWN' WHEN len(missing) > 0 THEN 'REQUIRED_MISSING' WHEN legacy AND p = 'BUILDING' THEN 'LEGACY_NOT_ALLOWED' END AS code FROM m) SELECT report, missing, code IS NULL AS complete, code FROM c""",
)
def k20(spark: SparkSession, sf: str) -> DataFrame:
    """Segments are profiles, of which two are known; an account below zero is legacy input."""
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    r = j.groupBy(F.col("o_custkey").alias("report"), F.col("c_mktsegment").alias("profile"), (F.col("c_acctbal") < 0).alias("legacy")).agg(F.collect_set("o_orderpriority").alias("observed"))
    profiles = spark.createDataFrame([("BUILDING", ["1-URGENT", "2-HIGH"], False), ("MACHINERY", ["3-MEDIUM", "5-LOW"], True)], "profile string, required array<string>, allow_legacy boolean")
    return coverage.profile_evaluation(r, profiles)


@query("s2_read_records", """SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'MALFORMED_JSON' WHEN 1 THEN 'ROOT_NOT_OBJECT' END AS code, CASE WHEN event_id % 10 > 1 THEN json_extract(props, '$.k')::INT END AS k FROM events""")
def s2(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    lines = table(spark, sf, "events").select("event_id", F.when(k % 10 == 0, "{oops").when(k % 10 == 1, "[1]").otherwise(F.col("props")).alias("value"))
    return S.parse_records(lines, "value", "k int").select("event_id", "code", "record.k")


def _report(spark: SparkSession, sf: str) -> DataFrame:
    c, n, o, r = (table(spark, sf, t) for t in ("customer", "nation", "orders", "region"))
    js = lambda *names: F.to_json(F.struct(*names)).alias("value")
    entities = c.select(F.col("c_mktsegment").alias("category"), _name("c", F.col("c_custkey")).alias("id"), js("c_name", "c_nationkey"))
    edges = o.select(_name("o", F.col("o_orderkey")).alias("id"), js("o_custkey"))
    return S.flatten_report(entities, edges, n.select(_name("n", F.col("n_nationkey")).alias("id"), js("n_name")), r.select(_name("r", F.col("r_regionkey")).alias("id"), js("r_name")))


@query(
    "s3_flatten_report",
    """SELECT 'entity' AS record_type, c_mktsegment AS entity_category, 'c' || c_custkey AS id, '{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS value FROM customer UNION ALL SELECT 'edge', NULL, 'o' || o_orderkey, '{"o_custkey":' || o_custkey || '}' FROM orders
UNION ALL SELECT 'diagnostic', NULL, 'n' || n_nationkey, '{"n_name":"' || n_name || '"}' FROM nation UNION ALL SELECT 'report_metadata', NULL, 'r' || r_regionkey, '{"r_name":"' || r_name || '"}' FROM region""",
)
def s3(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf)


@query("s4_write_split", "SELECT 'entity' AS record_type, count(*) AS n FROM customer UNION ALL SELECT 'edge', count(*) FROM orders UNION ALL SELECT 'diagnostic', count(*) FROM nation UNION ALL SELECT 'report_metadata', count(*) FROM region")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    return S.write_split(_report(spark, sf), lineage.scratch(spark, "split"), "record_type")


@query("s5_file_manifest")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    files = S.read_source_files(spark, sf, "*.parquet")
    return S.file_digests(files).withColumn("path", F.regexp_extract("path", "[^/]+$", 0))


@query("u1_extractor_registry", """SELECT source AS snapshot, 'chars' AS extractor_id, sum(length(text))::VARCHAR AS data, count(*) > 0 AS complete FROM documents WHERE lang IS DISTINCT FROM 'fr' GROUP BY 1 UNION ALL SELECT source, 'lines', sum(len(string_split(text, chr(10))))::VARCHAR, true FROM documents WHERE lang = 'fr' GROUP BY 1""")
def u1(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select(F.col("source").alias("snapshot"), F.coalesce("lang", F.lit("unknown")).alias("source"), "text")
    registry = ExtractorRegistry()
    summed = lambda c: lambda d: d.groupBy("snapshot").agg(F.sum(c).cast("string").alias("data"), F.lit(True).alias("complete"))
    registry.register("lines", ("fr",), summed(F.size(F.split("text", "\n"))))
    registry.register("chars", ("en", "de", "es", "unknown"), summed(F.length("text")))
    return registry.run(files)


@query(
    "u1_extractor_diagnostics",
    """WITH s AS (SELECT DISTINCT source AS snapshot FROM documents), w AS (SELECT snapshot, e.id AS extractor_id, unnest(e.w) AS wanted FROM s, (VALUES ('chars', ['en', 'de', 'es', 'unknown']), ('lines', ['fr', 'it']), ('none', ['xx'])) e(id, w)), d AS (SELECT DISTINCT source AS snapshot, coalesce(lang, 'unknown') AS lang FROM documents),
g AS (SELECT w.snapshot, extractor_id, list_sort(list(wanted) FILTER (d.lang IS NOT NULL)) AS present, list_sort(list(wanted) FILTER (d.lang IS NULL)) AS missing FROM w LEFT JOIN d ON w.snapshot IS NOT DISTINCT FROM d.snapshot AND d.lang = wanted GROUP BY w.snapshot, extractor_id)
SELECT snapshot, extractor_id, coalesce(present, []) AS present, missing, CASE WHEN present IS NULL THEN 'SOURCES_ABSENT' ELSE 'SOURCES_PARTIAL' END AS code FROM g WHERE missing IS NOT NULL""",
)
def u1_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select(F.col("source").alias("snapshot"), F.coalesce("lang", F.lit("unknown")).alias("source"))
    registry = ExtractorRegistry()
    for name, sources in (("lines", ("fr", "it")), ("chars", ("en", "de", "es", "unknown")), ("none", ("xx",))):
        registry.register(name, sources, lambda d: d)
    return registry.diagnostics(files)


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of files."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    return _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def _in_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The events of every five days as a batch, so that the watermark moves and state is forgotten."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.staged(e, F.floor((F.dayofmonth("ts") - 1) / 5), 7, lineage.scratch(spark, "pieces")).withWatermark("ts", "1 hour")


_STATUS = {"view": "InProgress", "click": "InProgress", "purchase": "Completed", "signup": "Interrupted", "error": "Failed"}


#: Longer than the given events: nothing is forgotten in between.
_MONTH = 31 * 86_400_000


def _turn_events(e: DataFrame, turn: Column | None = None) -> DataFrame:
    status = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _STATUS.items()])
    return e.select("ts", F.col("user_id").alias("thread"), (F.floor(F.col("event_id") / 500) if turn is None else turn).alias("turn"), F.col("event_id").alias("seq"), status.alias("status"))


@query("t1_project_rollouts", "SELECT user_id AS rollout, event_id AS ordinal, event_type AS item FROM events")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    items = _stream(spark, sf).select(F.col("user_id").alias("rollout"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("item"))
    out = lineage.scratch(spark, "projection")
    T.project_rollouts(items, out, lineage.scratch(spark, "state")).awaitTermination()
    return T.projection(spark, out, items.columns)


@query(
    "t1_incremental_projection",
    """WITH e AS (SELECT user_id AS rollout, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal, event_type AS item, dayofmonth(ts) AS day FROM events), f AS (SELECT rollout, arg_min(item, ordinal) = 'signup' AS lost, arg_min(item, ordinal) = 'error' AS gapped FROM e GROUP BY 1),
p AS (SELECT rollout, max(ordinal) + 1 AS n FROM e WHERE day <= 24 GROUP BY 1),
g AS (SELECT rollout, any_value(lost) AS lost, any_value(gapped) AND count(*) > 1 AS gapped FROM e JOIN f USING (rollout) WHERE day > 24 GROUP BY rollout)
SELECT rollout, ordinal, item, NULL AS code FROM e LEFT JOIN g USING (rollout) WHERE day <= 24 OR NOT (lost AND rollout IN (SELECT rollout FROM p) OR gapped)
UNION ALL SELECT rollout, NULL, NULL, 'ROLLOUT_LOG_SHRUNK' FROM g JOIN p USING (rollout) WHERE lost UNION ALL SELECT rollout, NULL, NULL, 'ROLLOUT_LOG_GAP' FROM g WHERE gapped""",
)
def t1_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """A log in four batches, of which the third repeats rows of the second; after each the stream is stopped and taken up again.

    In the fourth, logs that began with a signup are read as empty, and those that began with an error lack an item.
    """
    by = Window.partitionBy("user_id").orderBy("event_id")
    bytes_ = F.length("event_type").cast("long") + 1
    offset = F.coalesce(F.sum(bytes_).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.first("event_type").over(by)
    e = table(spark, sf, "events").select(F.col("user_id").alias("rollout"), (F.row_number().over(by) - 1).cast("long").alias("ordinal"), offset.alias("offset"), bytes_.alias("bytes"), F.col("event_type").alias("item"), F.dayofmonth("ts").alias("day"), first.alias("began"))
    last = Window.partitionBy("rollout", F.col("day") > 24).orderBy("ordinal")
    e = e.withColumn("n", F.row_number().over(last)).withColumn("of", F.count("*").over(Window.partitionBy("rollout", F.col("day") > 24)))
    e = e.withColumn("log_bytes", F.when((F.col("day") > 24) & (F.col("began") == "signup"), 0).otherwise(F.col("offset") + F.col("bytes")).cast("long"))
    missing = (F.col("day") > 24) & (F.col("began") == "error") & (F.col("of") > 1) & (F.col("n") == 1)
    names = ["rollout", "ordinal", "offset", "bytes", "item", "log_bytes"]
    # the windows are made once, not by each batch
    rows = lineage.written(e.filter(~missing).select(*names, "day"))
    log, out, at = lineage.scratch(spark, "log"), lineage.scratch(spark, "projection"), lineage.scratch(spark, "state")
    p = Projection(spark, out, rows.select(*names).schema, compact_every=2)
    # a batch is all that is new in the log, in as many files as wrote it
    for condition in ("day <= 8", "day > 8 and day <= 16", "day > 12 and day <= 24", "day > 24"):
        rows.filter(condition).select(*names).write.mode("append").parquet(log)
        p.follow(spark.readStream.schema(rows.select(*names).schema).parquet(log), at).awaitTermination()
    none = F.lit(None)
    errors = p.errors().select("rollout", none.cast("long").alias("ordinal"), none.cast("string").alias("item"), "code")
    return p.items().select("rollout", "ordinal", "item", none.cast("string").alias("code")).unionByName(errors)


_TURNS = "e AS (SELECT user_id AS thread, event_id // 500 AS turn, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'signup' THEN 'Interrupted' WHEN 'error' THEN 'Failed' ELSE 'InProgress' END AS status FROM events), t AS (SELECT thread, turn, min(seq) FILTER (status <> 'InProgress') AS ts, arg_min(status, seq) FILTER (status <> 'InProgress') AS st, min(seq) AS fs FROM e GROUP BY ALL)"


@query("t2_reduce_turns", f"WITH {_TURNS} SELECT thread, turn, coalesce(ts, fs) AS seq, coalesce(st, 'InProgress') AS status FROM t")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    changes = T.finished(state.reduce_turns(_turn_events(_timed(spark, sf)), "ts", keep_ms=_MONTH), lineage.scratch(spark, "turns"), lineage.scratch(spark, "state"))
    return changes.groupBy("thread", "turn").agg(F.max(F.struct("seq", "status")).alias("m")).select("thread", "turn", "m.*")


@query("t2_reduce_items", "WITH e AS (SELECT user_id AS thread, event_id // 500 AS turn, value < 50 AS item, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'signup' THEN 'Interrupted' WHEN 'error' THEN 'Failed' ELSE 'InProgress' END AS status FROM events), t AS (SELECT thread, turn, item, min(seq) FILTER (status <> 'InProgress') AS ts, arg_min(status, seq) FILTER (status <> 'InProgress') AS st, min(seq) AS fs FROM e GROUP BY ALL) SELECT thread, turn, item, coalesce(ts, fs) AS seq, coalesce(st, 'InProgress') AS status FROM t")
def t2_items(spark: SparkSession, sf: str) -> DataFrame:
    """The items of turns."""
    s = _timed(spark, sf)
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "Completed").when(kind == "signup", "Interrupted").when(kind == "error", "Failed").otherwise("InProgress")
    e = s.select(F.col("user_id").alias("thread"), F.floor(F.col("event_id") / 500).alias("turn"), (F.col("value") < 50).alias("item"), F.col("event_id").alias("seq"), status.alias("status"), "ts")
    keys = ("thread", "turn", "item")
    changes = T.finished(state.reduce_turns(e, "ts", keys, _MONTH), lineage.scratch(spark, "items"), lineage.scratch(spark, "state"))
    return changes.groupBy(*keys).agg(F.max(F.struct("seq", "status")).alias("m")).select(*keys, "m.*")


@query("t2_reduce_turns_batch", f"WITH {_TURNS} SELECT thread, turn, coalesce(ts, fs) AS seq, coalesce(st, 'InProgress') AS status FROM t")
def t2_batch(spark: SparkSession, sf: str) -> DataFrame:
    return T.reduce_turns_batch(_turn_events(table(spark, sf, "events")))


@query("t3_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.stream_dedupe(_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type")
    return T.finished(rows, lineage.scratch(spark, "dedupe"), lineage.scratch(spark, "state"))


@query("t4_stream_model_changes", "WITH m AS (SELECT user_id AS stream, event_id AS seq, event_type AS model FROM events WHERE event_id % 3 <> 0), k AS (SELECT *, lag(model) OVER (PARTITION BY stream ORDER BY seq) AS previous FROM m) SELECT * FROM k WHERE model IS DISTINCT FROM previous")
def t4(spark: SparkSession, sf: str) -> DataFrame:
    e = _timed(spark, sf).select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("model"), "ts")
    return T.finished(state.model_changes(e, "ts", _MONTH), lineage.scratch(spark, "models"), lineage.scratch(spark, "state"))


@query(
    "t2_turn_sessions",
    """WITH e AS (SELECT user_id AS thread, floor(value / 25)::BIGINT AS turn, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'signup' THEN 'Interrupted' WHEN 'error' THEN 'Failed' ELSE 'InProgress' END AS status, epoch_ms(ts) AS ms FROM events),
b AS (SELECT *, max(ms) OVER (PARTITION BY thread, turn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e), r AS (SELECT *, sum(CASE WHEN ms - before > 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY thread, turn ORDER BY seq) AS run FROM b),
w AS (SELECT *, lag(status) OVER p AS was, coalesce(max((status <> 'InProgress')::INT) OVER (PARTITION BY thread, turn, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM r WINDOW p AS (PARTITION BY thread, turn, run ORDER BY seq)) SELECT thread, turn, seq, status FROM w WHERE ended = 0 AND status IS DISTINCT FROM was""",
)
def t2_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that are forgotten after a day without an event."""
    e = _turn_events(_in_pieces(spark, sf), F.floor(F.col("value") / 25))
    return T.finished(state.reduce_turns(e, "ts", keep_ms=86_400_000), lineage.scratch(spark, "turns"), lineage.scratch(spark, "state"))


@query("t3_dedupe_sessions", "SELECT user_id, event_type, event_id AS seq FROM (SELECT *, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NULL OR gap > 43200000")
def t3_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Repeats within half a day go; one that comes after a longer silence is back."""
    rows = state.dedupe(_in_pieces(spark, sf), ["user_id", "event_type"], "event_id", "ts", 43_200_000)
    return T.finished(rows, lineage.scratch(spark, "dedupe"), lineage.scratch(spark, "state"))


@query(
    "t4_model_sessions",
    """WITH m AS (SELECT user_id AS stream, event_id AS seq, CASE WHEN value >= 30 THEN event_type END AS model, epoch_ms(ts) AS ms FROM events), g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY stream ORDER BY ms, seq) AS gap FROM m), r AS (SELECT *, sum(CASE WHEN gap > 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY ms, seq) AS run FROM g),
k AS (SELECT *, last_value(model IGNORE NULLS) OVER (PARTITION BY stream, run ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM r) SELECT stream, seq, model, previous FROM k WHERE model IS NOT NULL AND model IS DISTINCT FROM previous""",
)
def t4_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Models that are forgotten after a day without an event."""
    e = _in_pieces(spark, sf).select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.when(F.col("value") >= 30, F.col("event_type")).alias("model"), "ts")
    return T.finished(state.model_changes(e, "ts", 86_400_000), lineage.scratch(spark, "models"), lineage.scratch(spark, "state"))
