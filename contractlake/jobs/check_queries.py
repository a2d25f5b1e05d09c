"""Queries of the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contractlake.functions.canonical import nfc, walk_json
from contractlake.functions.ids import blob_sha1
from contractlake.operators import checks, coverage, documents

from .registry import query, table


@query(
    "k18_referential_integrity",
    """WITH nodes AS (SELECT o_orderpriority AS r, 'o' || o_orderkey AS id FROM orders WHERE o_totalprice >= 20000), e AS (SELECT o_orderpriority AS r, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, 'o' || l_orderkey AS f, 'o' || (l_orderkey + l_linenumber) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT r, 'EDGE_SOURCE_UNRESOLVED' AS code, id AS source_id, f AS target_id FROM e WHERE (r, f) NOT IN (SELECT r, id FROM nodes) UNION ALL SELECT r, 'EDGE_TARGET_UNRESOLVED', id, t FROM e WHERE (r, t) NOT IN (SELECT r, id FROM nodes)
UNION ALL SELECT r, 'OWNER_UNRESOLVED', id, 'o' || (substr(id, 2)::BIGINT - 1) FROM nodes WHERE (r, 'o' || (substr(id, 2)::BIGINT - 1)) NOT IN (SELECT r, id FROM nodes)""",
)
def k18(spark: SparkSession, sf: str) -> DataFrame:
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    name = lambda c: F.concat(F.lit("o"), c.cast("string"))
    nodes = o.filter("o_totalprice >= 20000").select(F.col("o_orderpriority").alias("r"), name(F.col("o_orderkey")).alias("id"), name(F.col("o_orderkey") - 1).alias("owner_id"))
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"])
    edges = j.select(F.col("o_orderpriority").alias("r"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), name(F.col("l_orderkey")).alias("from_id"), name(F.col("l_orderkey") + F.col("l_linenumber")).alias("to_id"))
    return checks.referential_integrity(edges, nodes, nodes, ["r"])


@query(
    "k18_reference_kinds",
    """WITH l AS (SELECT l_linestatus AS report, l_orderkey || '-' || l_linenumber AS s, 'p' || l_partkey AS p, 's' || l_suppkey AS u, l_returnflag AS f, l_quantity AS q FROM lineitem), r AS (SELECT report, 'schema' AS kind, s, p AS t FROM l UNION ALL SELECT report, 'source', s, u FROM l UNION ALL SELECT report, 'status', s, f FROM l),
k AS (SELECT report, 'schema' AS kind, p AS t FROM l WHERE q > 45 UNION SELECT report, 'source', u FROM l WHERE q > 49 UNION SELECT report, 'status', f FROM l WHERE report = 'F')
SELECT report, upper(kind) || '_UNRESOLVED' AS code, s AS source_id, t AS target_id FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.report = r.report AND k.kind = r.kind AND k.t = r.t)""",
)
def k18_kinds(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").withColumn("report", F.col("l_linestatus"))
    ids = {"schema": F.concat(F.lit("p"), F.col("l_partkey").cast("string")), "source": F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), "status": F.col("l_returnflag")}
    there = {"schema": F.col("l_quantity") > 45, "source": F.col("l_quantity") > 49, "status": F.col("l_linestatus") == "F"}
    wide = l.select("report", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_id"), F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("target_id"), there[k].alias("there")) for k, c in ids.items()])))
    return checks.reference_integrity(wide.drop("there"), wide.filter("there").select("report", "kind", F.col("target_id").alias("id")), ["report"])


_MEMBERS = {"source": "node", "target": "node", "x-entity-ref": "segment", "refs": "node"}
_PLACES = {"node": "/nodes/*", "dropped": "/dropped/*", "segment": "/segments/*"}


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    """A report a customer: its orders as nodes or dropped ones, edges from each order to the next, references, counts and the extractors that it names."""
    o = table(spark, sf, "orders").withColumn("n", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
    after = F.lead("n").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = o.withColumn("after", after).withColumn("node", F.col("o_totalprice") >= 60000).withColumn("gone", (F.col("o_totalprice") < 60000) | (F.col("o_orderstatus") == "P"))
    entry = lambda c, i: F.map_from_entries(F.array_sort(F.collect_list(F.when(c, F.struct("n", F.struct(i.alias("id")).alias("v"))))))
    edge = F.struct("n", F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "e").otherwise(F.col("n")).alias("id"), F.col("n").alias("source"), F.col("after").alias("target")).alias("v"))
    r = o.groupBy("o_custkey").agg(
        entry(F.col("node"), F.when(F.col("o_orderstatus") == "P", "x").otherwise(F.col("n"))).alias("nodes"), entry(F.col("gone"), F.col("n")).alias("dropped"), F.transform(F.array_sort(F.collect_list(edge)), lambda e: e["v"]).alias("edges"), F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "O", F.col("n")))).alias("refs"), F.count("*").alias("all"), F.min("o_orderpriority").alias("first"), F.collect_set("o_orderstatus").alias("states"),
    )
    c = table(spark, sf, "customer").join(r, F.col("c_custkey") == F.col("o_custkey"))
    segments = F.from_json(F.lit('{"BUILDING": {}, "MACHINERY": {}}'), "map<string,struct<id:string>>")
    found = F.transform(F.array_sort("states"), lambda s: F.struct(F.concat(F.lit("extractor."), s).alias("extractor_id")))
    report = F.struct("nodes", "dropped", "edges", segments.alias("segments"), F.struct(F.col("c_mktsegment").alias("x-entity-ref")).alias("about"), F.struct("refs", F.struct(F.col("all").alias("nodes")).alias("counts"), F.create_map(F.concat(F.lit("extractor."), F.col("first")), F.lit(1)).alias("seen")).alias("status"), found.alias("found"))
    text = F.when(F.col("c_acctbal") < -900, "{").otherwise(F.to_json(report))
    return c.select(F.col("c_custkey").alias("report"), text.alias("t"))


@query(
    "k18_document_references",
    """WITH o AS (SELECT *, 'o' || o_orderkey AS n, lead('o' || o_orderkey) OVER w AS after, row_number() OVER w - 1 AS i, o_totalprice >= 60000 AS node, o_totalprice < 60000 OR o_orderstatus = 'P' AS gone FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
c AS (SELECT c_custkey AS o_custkey, c_mktsegment, c_acctbal < -900 AS bad FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)), g AS (SELECT o.* , row_number() OVER (PARTITION BY o_custkey ORDER BY n) - 1 AS k FROM o JOIN c USING (o_custkey) WHERE NOT bad), s AS (SELECT o_custkey, n FROM g WHERE node),
r AS (SELECT o_custkey, '/edges/' || k || '/source' AS p, n AS t FROM g UNION ALL SELECT o_custkey, '/edges/' || k || '/target', after FROM g WHERE after IS NOT NULL UNION ALL SELECT o_custkey, '/status/refs/' || (row_number() OVER (PARTITION BY o_custkey ORDER BY n) - 1), n FROM g WHERE o_orderstatus = 'O')
SELECT o_custkey AS report, 'NODE_UNRESOLVED' AS code, p AS pointer, t AS target FROM r WHERE (o_custkey, t) NOT IN (SELECT o_custkey, n FROM s) UNION ALL SELECT o_custkey, 'SEGMENT_UNRESOLVED', '/about/x-entity-ref', c_mktsegment FROM c WHERE NOT bad AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT o_custkey, 'MAP_KEY_MISMATCH', '/nodes/' || n, 'x' FROM g WHERE node AND o_orderstatus = 'P' UNION ALL SELECT o_custkey, 'CONTRADICTORY_ID', '/nodes/' || n, n FROM g WHERE node AND gone
UNION ALL SELECT o_custkey, 'COUNT_MISMATCH', '/status/counts/nodes', count(*) FILTER (node)::VARCHAR FROM g GROUP BY 1 HAVING bool_or(NOT node) UNION ALL SELECT o_custkey, 'DUPLICATE_ID', '/edges/*/id', 'e' FROM g WHERE o_orderpriority = '1-URGENT' GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT o_custkey, 'DOCUMENT_REFUSED', '', 'no JSON' FROM c WHERE bad""",
)
def k18_documents(spark: SparkSession, sf: str) -> DataFrame:
    nodes = walk_json(_reports(spark, sf), "report", "t")
    return documents.document_checks(nodes, "report", _MEMBERS, _PLACES, exclusive=(("node", "dropped"),), counts={"/status/counts/nodes": "node"}, unique=("/edges/*/id",))


@query(
    "k20_observed_extractors",
    """WITH o AS (SELECT o_custkey AS report, min(o_orderpriority) AS first, list(DISTINCT o_orderstatus) AS states FROM orders GROUP BY 1), c AS (SELECT report, CASE WHEN c_acctbal < -900 THEN [] ELSE list_sort(list_distinct(list_transform(list_append(states, first), lambda x: 'extractor.' || x))) END AS observed, c_mktsegment AS p FROM o JOIN customer ON report = c_custkey),
m AS (SELECT *, list_filter(['extractor.1-URGENT', 'extractor.F', 'extractor.P'], lambda x: NOT list_contains(observed, x)) AS missing FROM c) SELECT report, CASE WHEN p = 'BUILDING' THEN missing ELSE [] END AS missing, p = 'BUILDING' AND len(missing) = 0 AS complete, CASE WHEN p <> 'BUILDING' THEN 'PROFILE_UNKNOWN' WHEN len(missing) > 0 THEN 'REQUIRED_MISSING' END AS code FROM m""",
)
def k20_observed(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles held against the extractors that reports name anywhere."""
    observed = documents.observed_extractors(walk_json(_reports(spark, sf), "report", "t"), "report")
    reports = observed.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("report"), F.col("c_mktsegment").alias("profile")), "report").withColumn("legacy", F.lit(False))
    profiles = spark.createDataFrame([("BUILDING", ["extractor.1-URGENT", "extractor.F", "extractor.P"], False)], "profile string, required array<string>, allow_legacy boolean")
    return coverage.profile_evaluation(reports, profiles)


@query(
    "k19_transition_integrity",
    """WITH keys AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'c' || (c_custkey * 2) END AS r FROM customer), o AS (SELECT 't' || o_orderkey AS id, 'v' || o_custkey AS version, o_orderpriority AS key, o_orderstatus AS state, 'e' || o_orderkey AS ref, o_totalprice AS p FROM orders),
d AS (SELECT version, key FROM o WHERE p >= 50000), t AS (SELECT id, version, key, CASE WHEN p > 200000 THEN 'F' ELSE state END AS state FROM o), e AS (SELECT 'e' || l_orderkey AS ref FROM lineitem WHERE l_quantity > 45)
SELECT id AS entity_id, 'REPLACEMENT_UNRESOLVED' AS code FROM keys WHERE r IS NOT NULL AND r NOT IN (SELECT id FROM keys)
UNION ALL SELECT DISTINCT version, 'KEY_SET_MISMATCH' FROM o WHERE (version, key) NOT IN (SELECT version, key FROM d)
UNION ALL SELECT id, 'TRANSITION_TARGET_INACTIVE' FROM t WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.version = t.version AND o.key = t.key AND o.state = t.state)
UNION ALL SELECT id, 'EVIDENCE_UNRESOLVED' FROM o WHERE ref NOT IN (SELECT ref FROM e)""",
)
def k19_transitions(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    k = F.col("c_custkey")
    keys = table(spark, sf, "customer").select(name("c", k).alias("id"), F.when(F.col("c_acctbal") < 0, name("c", k * 2)).alias("replaced_by"))
    o = table(spark, sf, "orders").select(name("t", F.col("o_orderkey")).alias("id"), name("v", F.col("o_custkey")).alias("version"), F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("state"), name("e", F.col("o_orderkey")).alias("ref"), "o_totalprice")
    transitions = o.withColumn("state", F.when(F.col("o_totalprice") > 200000, "F").otherwise(F.col("state")))
    evidence = table(spark, sf, "lineitem").filter("l_quantity > 45").select(name("e", F.col("l_orderkey")).alias("ref"))
    return checks.transition_integrity(keys, o.filter("o_totalprice >= 50000"), o, transitions, o.select(F.col("id").alias("entity"), "ref"), evidence)


@query("a10_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) <> max(l_partkey) AS conflicting FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return checks.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"))


@query(
    "k3_source_coverage",
    """WITH s AS (SELECT doc_id % 4 AS snapshot, 'spec' || doc_id AS spec_id, 'p' || doc_id AS path, doc_id % 2 = 0 AS required, ['the', 'der ', 'zzz'] AS symbols FROM documents), f AS (SELECT doc_id % 4 AS snapshot, 'p' || doc_id AS path, text FROM documents WHERE length(text) >= 300),
j AS (SELECT s.*, f.text, list_sort(list_filter(symbols, lambda x: NOT contains(f.text, x))) AS absent FROM s LEFT JOIN f USING (snapshot, path))
SELECT snapshot, spec_id, CASE WHEN text IS NULL AND required THEN 'REQUIRED_SOURCE_UNAVAILABLE' WHEN text IS NULL THEN 'OPTIONAL_SOURCE_UNAVAILABLE' ELSE 'EXPECTED_SYMBOL_ABSENT' END AS code, CASE WHEN text IS NULL AND required THEN 'error' ELSE 'warning' END AS severity, CASE WHEN text IS NOT NULL THEN absent END AS symbols
FROM j WHERE text IS NULL OR len(absent) > 0""",
)
def k3(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    path = F.concat(F.lit("p"), k.cast("string")).alias("path")
    specs = d.select((k % 4).alias("snapshot"), F.concat(F.lit("spec"), k.cast("string")).alias("spec_id"), path, (k % 2 == 0).alias("required"), F.array(F.lit("the"), F.lit("der "), F.lit("zzz")).alias("symbols"))
    return checks.source_coverage(specs, d.filter("length(text) >= 300").select((k % 4).alias("snapshot"), path, "text"))


@query(
    "k1_select_candidate",
    """WITH s AS (SELECT page_id % 5 AS snapshot, 's' || page_id AS spec_id, ['a' || (page_id * 3), 'b' || page_id, 'a' || page_id] AS c FROM pages), f AS (SELECT page_id % 5 AS snapshot, 'a' || page_id AS path FROM pages WHERE page_id % 3 <> 0),
w AS (SELECT snapshot, spec_id, unnest(c) AS path, unnest(range(3)) AS i FROM s), m AS (SELECT snapshot, spec_id, min(i) AS i FROM w JOIN f USING (snapshot, path) GROUP BY ALL)
SELECT snapshot, spec_id, c[i + 1] AS path, i AS candidate_index, coalesce(i > 0, false) AS fallback FROM s LEFT JOIN m USING (snapshot, spec_id)""",
)
def k1(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    k = F.col("page_id")
    name = lambda x, c: F.concat(F.lit(x), c.cast("string"))
    specs = p.select((k % 5).alias("snapshot"), name("s", k).alias("spec_id"), F.array(name("a", k * 3), name("b", k), name("a", k)).alias("path_candidates"))
    return checks.select_candidate(specs, p.filter("page_id % 3 != 0").select((k % 5).alias("snapshot"), name("a", k).alias("path")))


@query(
    "k4_marker_checks",
    """WITH r AS (SELECT d.doc_id, e.* FROM documents d, (VALUES ('x', 'THE_MISSING', 'the '), ('x', 'AND_MISSING', 'and '), ('y', 'LICENSE_MISSING', 'icense')) e(entity_id, code, token))
SELECT r.doc_id AS source_id, entity_id, bool_and(coalesce(contains(text, token), false)) AS complete, list_sort(list(DISTINCT code) FILTER (NOT coalesce(contains(text, token), false))) AS missing_codes FROM r LEFT JOIN documents d ON d.doc_id = r.doc_id GROUP BY ALL""".replace("AS missing_codes", "AS m").replace("SELECT r.doc_id AS source_id", "SELECT source_id, entity_id, complete, coalesce(m, []) AS missing_codes FROM (SELECT r.doc_id AS source_id") + ")",
)
def k4(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    tokens = F.array(*[F.struct(F.lit(a).alias("entity_id"), F.lit(b).alias("code"), F.lit(c).alias("token")) for a, b, c in (("x", "THE_MISSING", "the "), ("x", "AND_MISSING", "and "), ("y", "LICENSE_MISSING", "icense"))])
    rules = d.select(F.col("doc_id").alias("source_id"), F.explode(tokens).alias("r")).select("source_id", "r.*")
    return checks.marker_checks(rules, d.select(F.col("doc_id").alias("source_id"), "text"))


@query(
    "k5_implementation_variant",
    "SELECT doc_id, CASE WHEN contains(text, 'MIT License') THEN 'mit' WHEN contains(text, ' the ') AND contains(text, ' and ') THEN 'english' WHEN contains(text, ' der ') THEN 'german' ELSE 'unknown' END AS variant FROM documents",
)
def k5(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", checks.variant(d, {"mit": ("MIT License",), "english": (" the ", " and "), "german": (" der ",)}).alias("variant"))


@query(
    "s6_verify_manifest",
    """WITH a AS (SELECT doc_id % 6 AS archive, CASE WHEN doc_id % 40 = 0 THEN '../' ELSE '' END || 'f' || doc_id AS path, octet_length(encode(text)) AS n, sha256(text) AS s, doc_id FROM documents),
d0 AS (SELECT archive, path, CASE WHEN doc_id % 11 = 0 THEN n + 1 ELSE n END AS n, CASE WHEN doc_id % 13 = 0 THEN sha256(s) ELSE s END AS s FROM a WHERE doc_id % 17 <> 0), d AS (SELECT * FROM d0 UNION ALL SELECT archive, path, n, s FROM a WHERE doc_id % 19 = 0 AND doc_id % 17 <> 0),
g AS (SELECT archive, path, count(*) AS t, min(n) AS n, min(s) AS s FROM d GROUP BY ALL), x AS (SELECT archive, path, n, s FROM a WHERE doc_id % 23 <> 0),
j AS (SELECT coalesce(g.archive, x.archive) AS archive, coalesce(g.path, x.path) AS path, g.t, g.n AS dn, g.s AS ds, x.n AS xn, x.s AS xs FROM g FULL JOIN x ON g.archive = x.archive AND g.path = x.path)
SELECT archive, path, unnest(list_filter([CASE WHEN xs IS NULL THEN 'MEMBER_MISSING' END, CASE WHEN t IS NULL THEN 'MEMBER_UNDECLARED' END, CASE WHEN t > 1 THEN 'DUPLICATE_MEMBER' END, CASE WHEN dn <> xn THEN 'SIZE_MISMATCH' END, CASE WHEN ds <> xs THEN 'HASH_MISMATCH' END, CASE WHEN path LIKE '../%' THEN 'UNSAFE_PATH' END], lambda c: c IS NOT NULL)) AS code FROM j""",
)
def s6(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    path = F.concat(F.when(k % 40 == 0, F.lit("../")).otherwise(F.lit("")), F.lit("f"), k.cast("string")).alias("path")
    actual = d.select("doc_id", (k % 6).alias("archive"), path, F.octet_length("text").alias("byte_length"), F.sha2("text", 256).alias("sha256"))
    declared = actual.filter("doc_id % 17 != 0").withColumn("byte_length", F.when(k % 11 == 0, F.col("byte_length") + 1).otherwise(F.col("byte_length"))).withColumn("sha256", F.when(k % 13 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    declared = declared.unionByName(actual.filter("doc_id % 19 = 0 and doc_id % 17 != 0"))
    return checks.verify_manifest(declared.drop("doc_id"), actual.filter("doc_id % 23 != 0").drop("doc_id"), ["archive"])


@query(
    "s7_check_listing",
    """WITH m AS (SELECT o_custkey % 200 AS archive, ['A/b', 'a/B', 'caf' || chr(233), 'cafe' || chr(769), 'x/' || o_orderkey, '../up', repeat('d/', 40) || 'f'][o_orderkey % 7 + 1] AS path, floor(o_totalprice * 1000)::BIGINT AS size, floor(o_totalprice)::BIGINT * (o_orderkey % 11) AS c FROM orders),
r AS (SELECT archive, path, unnest(list_filter([CASE WHEN path = '' OR length(path) > 512 THEN 'NAME_LENGTH' END, CASE WHEN path = '../up' THEN 'UNSAFE_PATH' END, CASE WHEN len(string_split(path, '/')) > 40 THEN 'PATH_DEPTH' END, CASE WHEN size > 67108864 THEN 'FILE_SIZE' END, CASE WHEN size > c * 200 THEN 'COMPRESSION_RATIO' END], lambda x: x IS NOT NULL)) AS code FROM m)
SELECT * FROM r UNION ALL SELECT archive, path, 'DUPLICATE_PATH' FROM m GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT archive, min(path), 'CASE_COLLISION' FROM m GROUP BY archive, lower(path) HAVING count(DISTINCT path) > 1
UNION ALL SELECT archive, min(path), 'UNICODE_COLLISION' FROM m GROUP BY archive, nfc_normalize(path) HAVING count(DISTINCT path) > 1 UNION ALL SELECT archive, NULL, 'MEMBER_COUNT' FROM m GROUP BY archive HAVING count(*) > 80 UNION ALL SELECT archive, NULL, 'TOTAL_SIZE' FROM m GROUP BY archive HAVING sum(size) > 1073741824""",
)
def s7(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    names = F.array(F.lit("A/b"), F.lit("a/B"), F.lit("café"), F.lit("café"), F.concat(F.lit("x/"), k.cast("string")), F.lit("../up"), F.lit("d/" * 40 + "f"))
    m = o.select((F.col("o_custkey") % 200).alias("archive"), F.get(names, (k % 7).cast("int")).alias("path"), F.floor(F.col("o_totalprice") * 1000).alias("size"), (F.floor("o_totalprice") * (k % 11)).alias("compressed_size"))
    return checks.check_listing(m, nfc(F.col("path")), max_members=80)


@query(
    "k22_provenance_check",
    """WITH f AS (SELECT source AS snapshot, 'f' || doc_id AS path, coalesce(text, '') AS t, CASE lang WHEN 'de' THEN lower(text) WHEN 'fr' THEN text || chr(10) WHEN 'es' THEN CASE WHEN length(text) >= 300 THEN text END ELSE coalesce(text, '') END AS c FROM documents WHERE source IS NOT NULL)
SELECT snapshot, path, unnest(CASE WHEN c IS NULL THEN ['SOURCE_MISSING'] ELSE list_filter([CASE WHEN octet_length(encode(c)) <> octet_length(encode(t)) THEN 'BYTE_LENGTH_MISMATCH' END, CASE WHEN sha256(c) <> sha256(t) THEN 'SHA256_MISMATCH' END, CASE WHEN c <> t THEN 'BLOB_MISMATCH' END], lambda x: x IS NOT NULL) END) AS code FROM f""",
)
def k22(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest is of the texts; found are files in lower case (de), with a line end more (fr), or not at all (short ones in es)."""
    d = table(spark, sf, "documents").filter("source is not null").select(F.col("source").alias("snapshot"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "lang", "text")
    t = F.coalesce("text", F.lit("")).cast("binary")
    found = F.when(F.col("lang") == "de", F.lower("text")).when(F.col("lang") == "fr", F.concat("text", F.lit("\n"))).when(F.col("lang") == "es", F.when(F.length("text") >= 300, F.col("text"))).otherwise(F.coalesce("text", F.lit("")))
    manifest = d.select("snapshot", "path", F.octet_length(t).alias("byte_length"), F.sha2(t, 256).alias("sha256"), blob_sha1(t).alias("blob_sha1"))
    return checks.provenance_check(manifest, d.select("snapshot", "path", found.cast("binary").alias("content")).filter("content is not null"))


@query(
    "a17_count_consistency",
    """WITH i AS (SELECT c_nationkey AS report, c_mktsegment AS kind FROM customer), n AS (SELECT report, kind, count(*) AS n FROM i GROUP BY ALL), d AS (SELECT report, kind, n + CASE WHEN report % 4 = 0 THEN 1 ELSE 0 END AS declared FROM n WHERE report % 5 <> 0)
SELECT report, kind, coalesce(declared, 0) AS declared, coalesce(n, 0) AS actual FROM d FULL JOIN n USING (report, kind) WHERE coalesce(declared, 0) <> coalesce(n, 0)""",
)
def a17(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "customer").select(F.col("c_nationkey").alias("report"), F.col("c_mktsegment").alias("kind"))
    declared = items.groupBy("report", "kind").agg(F.count("*").alias("n")).filter("report % 5 != 0").withColumn("n", F.col("n") + (F.col("report") % 4 == 0).cast("int"))
    return checks.count_consistency(declared, items, ["report"])


@query(
    "k21_evidence_validation",
    """WITH s AS (SELECT o_custkey AS evidence, 's' || o_orderkey % 7 AS id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'passed' ELSE 'blocked' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN [] WHEN o_orderkey % 3 = 0 THEN ['failed', 'passed'] WHEN o_orderkey % 3 = 1 THEN ['passed'] ELSE ['blocked'] END AS a, o_orderkey % 4 AS n,
  CASE WHEN o_custkey % 2 = 0 THEN 'complete' ELSE 'partial' END AS ds, o_custkey % 6 <> 0 AS rb, o_custkey % 7 <> 0 AS sb FROM orders),
c AS (SELECT *, list_filter([CASE WHEN len(a) = 0 THEN 'SCENARIO_WITHOUT_ASSERTION' END, CASE WHEN n = 0 THEN 'SCENARIO_WITHOUT_ARTIFACT' END, CASE WHEN status = 'passed' AND (list_contains(a, 'failed') OR list_contains(a, 'blocked')) THEN 'PASSED_WITH_FAILURE' END, CASE WHEN status = 'failed' AND NOT list_contains(a, 'failed') THEN 'FAILED_WITHOUT_FAILURE' END,
  CASE WHEN status = 'blocked' AND NOT list_contains(a, 'blocked') THEN 'BLOCKED_WITHOUT_BLOCK' END, CASE WHEN NOT rb THEN 'REPORT_MISMATCH' END, CASE WHEN NOT sb THEN 'SOURCE_MISMATCH' END], lambda x: x IS NOT NULL) AS codes FROM s),
g AS (SELECT evidence, flatten(list(codes)) AS codes, count(*) AS n, count(DISTINCT id) AS k, bool_and(status = 'passed') AS ok, coalesce(list(DISTINCT id) FILTER (status = 'passed'), []) AS passed, any_value(ds) AS ds FROM c GROUP BY evidence),
m AS (SELECT *, list_filter(['s0', 's1'], lambda x: NOT list_contains(passed, x)) AS missing FROM g), t AS (SELECT *, CASE WHEN len(missing) = 0 AND ok THEN 'complete' ELSE 'partial' END AS cs FROM m)
SELECT evidence, list_sort(list_distinct(list_concat(codes, list_filter([CASE WHEN k < n THEN 'DUPLICATE_SCENARIO' END, CASE WHEN len(missing) > 0 THEN 'SCENARIO_MISSING' END, CASE WHEN ds <> cs THEN 'STATUS_DISAGREES' END], lambda x: x IS NOT NULL)))) AS codes, missing, cs AS calculated_status FROM t""",
)
def k21(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "passed").otherwise("blocked")
    scenarios = table(spark, sf, "orders").select(
        c.alias("evidence"), F.concat(F.lit("s"), (k % 7).cast("string")).alias("id"), status.alias("status"),
        F.when(k % 5 == 0, words()).when(k % 3 == 0, words("failed", "passed")).when(k % 3 == 1, words("passed")).otherwise(words("blocked")).alias("assertions"),
        (k % 4).alias("n_artifacts"), F.when(c % 2 == 0, "complete").otherwise("partial").alias("declared_status"), (c % 6 != 0).alias("report_bound"), (c % 7 != 0).alias("source_bound"),
    )
    return checks.evidence_codes(scenarios, spark.createDataFrame([("s0",), ("s1",)], "id string"), ["evidence"])


@query(
    "k11_assertion_check",
    """WITH e AS (SELECT c_nationkey AS version, c_custkey AS key, c_mktsegment AS assertion, ['b', 'a', 'a'] AS v FROM customer), o AS (SELECT version, key, assertion, CASE WHEN key % 3 = 0 THEN ['a', 'b'] ELSE ['a'] END AS v FROM e WHERE key % 4 <> 0)
SELECT e.version, e.key, e.assertion, CASE WHEN o.key IS NULL THEN 'ASSERTION_UNOBSERVED' ELSE 'ASSERTION_MISMATCH' END AS code FROM e LEFT JOIN o ON e.key = o.key WHERE o.key IS NULL OR e.key % 3 <> 0""",
)
def k11(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("version"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("assertion"))
    a, b = F.lit("a"), F.lit("b")
    observed = c.filter("key % 4 != 0").withColumn("values", F.when(F.col("key") % 3 == 0, F.array(a, b)).otherwise(F.array(a)))
    return checks.assertion_check(c.withColumn("values", F.array(b, a, a)), observed)


@query(
    "p21_policy_gate",
    """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 95) AS error, count(*) FILTER (event_type = 'error') AS warning, count(*) FILTER (value > 99.9) AS breaking, count(*) AS total, bool_and(value < 99) AS complete FROM events GROUP BY 1), p AS (SELECT *, unnest(['never', 'warning', 'error', 'incomplete', 'breaking', 'any']) AS policy FROM c)
SELECT user_id, policy, NOT CASE policy WHEN 'warning' THEN error + warning > 0 WHEN 'error' THEN error > 0 WHEN 'incomplete' THEN NOT complete WHEN 'breaking' THEN breaking > 0 WHEN 'any' THEN total > 0 ELSE false END AS passed FROM p""",
)
def p21(spark: SparkSession, sf: str) -> DataFrame:
    v, kind = F.col("value"), F.col("event_type")
    counts = table(spark, sf, "events").groupBy("user_id").agg(F.count_if((kind == "error") & (v > 95)).alias("error"), F.count_if(kind == "error").alias("warning"), F.count_if(v > 99.9).alias("breaking"), F.count("*").alias("total"), F.bool_and(v < 99).alias("complete"))
    p = counts.withColumn("policy", F.explode(F.array(*map(F.lit, ("never", "warning", "error", "incomplete", "breaking", "any")))))
    return p.select("user_id", "policy", checks.policy_gate(p, F.col("policy")).alias("passed"))


@query(
    "k19_history_integrity",
    """WITH keys AS (SELECT c_custkey AS id, ['s' || c_custkey, 's' || (c_custkey + 1)] AS refs, CASE WHEN c_custkey % 9 = 0 THEN 's0x' ELSE 's' || c_custkey END AS cur FROM customer WHERE c_acctbal >= 0), states AS (SELECT 's' || c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey - c_custkey % 2 END AS owner FROM customer WHERE c_mktsegment <> 'BUILDING'),
v AS (SELECT o_orderkey AS version, o_custkey AS key, 's' || o_custkey AS state FROM orders), r AS (SELECT id, unnest(refs) AS ref FROM keys)
SELECT r.id AS entity_id, CASE WHEN owner IS NULL THEN 'STATE_UNRESOLVED' ELSE 'STATE_OWNER_MISMATCH' END AS code FROM r LEFT JOIN states s ON s.id = ref WHERE owner IS NULL OR owner <> r.id
UNION ALL SELECT id, 'CURRENT_NOT_DECLARED' FROM keys WHERE NOT list_contains(refs, cur) UNION ALL SELECT version, 'VERSION_STATE_UNRESOLVED' FROM v WHERE state NOT IN (SELECT id FROM states) UNION ALL SELECT version, 'VERSION_KEY_UNKNOWN' FROM v WHERE key NOT IN (SELECT id FROM keys)""",
)
def k19(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    s = lambda x: F.concat(F.lit("s"), x.cast("string"))
    keys = c.filter("c_acctbal >= 0").select(k.alias("id"), F.array(s(k), s(k + 1)).alias("state_refs"), F.when(k % 9 == 0, F.lit("s0x")).otherwise(s(k)).alias("current_state"))
    states = c.filter("c_mktsegment != 'BUILDING'").select(s(k).alias("id"), F.when(k % 5 == 0, k).otherwise(k - k % 2).alias("owner"))
    versions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("version"), F.col("o_custkey").alias("key"), s(F.col("o_custkey")).alias("state"))
    return checks.history_integrity(keys, states, versions)
