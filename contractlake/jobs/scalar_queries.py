"""Queries of the scalar operators (P), ids and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlake.functions import classify as C
from contractlake.functions import ids

from .registry import query, table

# names that the events stand for, by event_id
NAMES = ["Authorization", "x-session-id", "attestation-ticket", "turn-metadata", "cwd_path", "workspace_root", "installation_id", "request_kind", "window_number", "user-agent", "x-model", "Bearer hint"]
SCHEMAS = ["schema.turn_metadata", "schema.response.event", "schema.response_request", "schema.config.root", "schema.client"]
_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_SCHEMAS_SQL = "[" + ", ".join(f"'{n}'" for n in SCHEMAS) + "]"


def _pick(values: list[str], key: str):
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", _pick(NAMES, "event_id").alias("name"), _pick(["auth", "metadata", "misc"], "user_id").alias("category"), _pick(SCHEMAS, "user_id").alias("schema_id"))


_NAMED = f"named AS (SELECT event_id, {_NAMES_SQL}[event_id % 12 + 1] AS name, ['auth', 'metadata', 'misc'][user_id % 3 + 1] AS category, {_SCHEMAS_SQL}[user_id % 5 + 1] AS schema_id FROM events)"


@query(
    "p6_sensitivity",
    f"""WITH {_NAMED}, c AS (SELECT *, lower(name) AS l FROM named), k AS (SELECT event_id, name, CASE
  WHEN l = 'authorization' OR contains(l, 'bearer') OR contains(l, 'credential') THEN 'credential'
  WHEN contains(l, 'ticket') OR contains(l, 'attestation') THEN 'opaque_secret'
  WHEN regexp_matches(l, 'session|thread|request-id|window-id|turn-id|account-id') THEN 'identifier'
  WHEN contains(l, 'metadata') OR contains(l, 'workspace') OR category = 'metadata' THEN 'operational'
  WHEN contains(l, 'path') OR contains(l, 'cwd') THEN 'filesystem_path'
  WHEN category IN ('auth', 'attestation', 'security') THEN 'security_decision' ELSE 'public_protocol' END AS sensitivity FROM c)
SELECT *, CASE sensitivity WHEN 'credential' THEN 'redact' WHEN 'opaque_secret' THEN 'redact' WHEN 'identifier' THEN 'hash_or_redact' WHEN 'operational' THEN 'review_before_logging'
  WHEN 'filesystem_path' THEN 'redact_or_relativize' WHEN 'security_decision' THEN 'redact' ELSE 'allow' END AS logging_policy FROM k""",
)
def p6(spark: SparkSession, sf: str) -> DataFrame:
    k = C.sensitivity(F.col("name"), F.col("category"))
    return _named(spark, sf).select("event_id", "name", k.alias("sensitivity")).withColumn("logging_policy", C.logging_policy(F.col("sensitivity")))


@query(
    "p7_lifetime",
    f"""WITH {_NAMED} SELECT event_id, CASE WHEN contains(lower(name), 'installation') THEN 'installation' WHEN contains(lower(name), 'session') THEN 'session' WHEN contains(lower(name), 'thread') THEN 'thread'
  WHEN contains(lower(name), 'turn') THEN 'turn' WHEN contains(lower(name), 'request') THEN 'request' WHEN contains(lower(name), 'window') THEN 'context_window' ELSE 'message_or_configuration' END AS lifetime FROM named""",
)
def p7(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).select("event_id", C.lifetime(F.col("name")).alias("lifetime"))


@query(
    "p8_field_authority",
    f"""WITH {_NAMED} SELECT event_id, CASE WHEN contains(schema_id, 'turn_metadata') OR lower(name) IN ('session_id', 'thread_id', 'turn_id', 'request_kind', 'tool_namespaces_info') THEN 'core'
  WHEN contains(schema_id, 'response') AND NOT contains(schema_id, 'request') THEN 'server_or_provider' WHEN contains(schema_id, 'config') THEN 'configuration' ELSE 'client_request_builder' END AS authority FROM named""",
)
def p8(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).select("event_id", C.field_authority(F.col("schema_id"), F.col("name")).alias("authority"))


SKIPS = ["", "Option::is_none", "Vec::is_empty", "std::ops::Not::not", "skip_default"]


@query(
    "p9_presence",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 5 <> 0 AS serialized, l_suppkey % 7 = 0 AS flattened, ['', 'Option::is_none', 'Vec::is_empty', 'std::ops::Not::not', 'skip_default'][l_partkey % 5 + 1] AS skip_if, l_partkey % 2 = 0 AS optional FROM lineitem),
m AS (SELECT *, CASE WHEN NOT serialized THEN 'never' WHEN flattened THEN 'flattened' WHEN skip_if <> '' THEN 'conditional' WHEN optional THEN 'present_nullable' ELSE 'present' END AS mode FROM f)
SELECT mode, mode IN ('present', 'present_nullable') AS required, mode = 'present_nullable' AS nullable,
  CASE skip_if WHEN '' THEN NULL WHEN 'Option::is_none' THEN 'is_null' WHEN 'Vec::is_empty' THEN 'is_empty' WHEN 'std::ops::Not::not' THEN 'eq' ELSE 'custom_predicate' END AS omitted_when, count(*) AS n
FROM m GROUP BY ALL""",
)
def p9(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    f = l.select((F.col("l_linenumber") % 5 != 0).alias("s"), (F.col("l_suppkey") % 7 == 0).alias("f"), _pick(SKIPS, "l_partkey").alias("k"), (F.col("l_partkey") % 2 == 0).alias("o"))
    p = f.select(C.presence(F.col("s"), F.col("f"), F.col("k"), F.col("o")).alias("p"), C.omission_predicate(F.col("k")).alias("omitted_when"))
    return p.groupBy("p.mode", "p.required", "p.nullable", "omitted_when").agg(F.count("*").alias("n"))


CONDITIONS = ["always", "Responses Lite only", "when turn.id exists", "when APP_HOME is set", "FedRAMP only", "when account id exists", "after server turn state", "when parent thread exists", "request_kind is present", "if the moon is full", "required"]


@query(
    "p10_condition_predicate",
    "WITH c AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ["
    + ", ".join(f"'{c}'" for c in CONDITIONS)
    + """][event_id % 11 + 1] END AS c FROM events), r AS (SELECT event_id, c, lower(trim(c)) AS l,
  regexp_extract(trim(c), '(?i)^when\\s+([a-zA-Z0-9_.-]+)\\s+exists$', 1) AS x, regexp_extract(trim(c), '(?i)^when\\s+([A-Z0-9_]+)\\s+is set$', 1) AS v FROM c),
k AS (SELECT *, CASE WHEN c IS NULL THEN 0 WHEN l IN ('always', 'required', 'unconditional') OR l LIKE 'always %' THEN 1 WHEN contains(l, 'responses lite') THEN 2 WHEN contains(l, 'request_kind') AND contains(l, 'present') THEN 3
  WHEN x <> '' THEN 4 WHEN v <> '' THEN 5 WHEN contains(l, 'fedramp only') THEN 6 WHEN contains(l, 'when account') AND contains(l, 'exists') THEN 7 WHEN contains(l, 'after server') AND contains(l, 'turn state') THEN 8 WHEN contains(l, 'when parent thread exists') THEN 9 ELSE 10 END AS k FROM r)
SELECT event_id, ['unspecified', 'const', 'eq', 'exists', 'exists', 'env_exists', 'eq', 'exists', 'exists', 'exists', 'source_condition'][k + 1] AS op,
  CASE k WHEN 2 THEN 'model.use_responses_lite' WHEN 3 THEN 'turn_metadata.request_kind' WHEN 4 THEN x WHEN 5 THEN v WHEN 6 THEN 'auth.fedramp' WHEN 7 THEN 'auth.account_id' WHEN 8 THEN 'continuation.turn_state' WHEN 9 THEN 'turn.parent_thread_id' WHEN 10 THEN c END AS path,
  CASE WHEN k IN (1, 2, 6) THEN 'true' END AS value, k NOT IN (0, 10) AS machine_evaluable FROM k""",
)
def p10(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 13 != 0, _pick(CONDITIONS, "event_id")).alias("c"))
    return e.select("event_id", C.condition_predicate(F.col("c")).alias("p")).select("event_id", "p.*")


EXPRESSIONS = ["gate_a.then_some(self.x)", "gate_b.then_some(self.y).flatten()", "&self.extra", "non_empty_tags(&self.tags)", "self.name.as_deref()", "&self.kind", "local_value", "compaction", "weird(self)", "gate_a.then_some(x).unwrap_or(y)", 'gate_a.then_some(f("(", x))']
_EXPRESSIONS_SQL = "[" + ", ".join(f"'{c}'" for c in EXPRESSIONS) + "]"


@query(
    "p11_emission_kind",
    f"""WITH e AS (SELECT o_orderkey, {_EXPRESSIONS_SQL}[o_orderkey % 11 + 1] AS e FROM orders)
SELECT o_orderkey, CASE WHEN contains(e, 'unwrap_or') THEN 'unclassified' WHEN regexp_matches(e, '^\\w+\\.then_some\\(.*\\)\\.flatten\\(\\)$') THEN 'conditional_option_passthrough' WHEN regexp_matches(e, '^\\w+\\.then_some\\(.*\\)$') THEN 'conditional_value' WHEN e = '&self.extra' THEN 'flattened_extra'
  WHEN e LIKE 'non_empty%' THEN 'non_empty_projection' WHEN regexp_matches(e, '^self\\.\\w+\\.as_(deref|ref)\\(\\)$') THEN 'option_passthrough' WHEN regexp_matches(e, '^&?self\\.\\w+$') THEN 'value_passthrough' WHEN e IN ('local_value', 'compaction') THEN 'derived_local' ELSE 'unclassified' END AS kind,
  CASE WHEN contains(e, 'then_some') AND NOT contains(e, 'unwrap_or') THEN split_part(e, '.', 1) END AS gate, NOT (e LIKE 'gate_b%' OR e LIKE 'weird%' OR contains(e, 'unwrap_or')) AS machine_evaluable FROM e""",
)
def p11(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    kind = C.emission_kind(_pick(EXPRESSIONS, "o_orderkey"), F.array(F.lit("gate_a")), F.array(F.lit("local_value")))
    return o.select("o_orderkey", kind.alias("k")).select("o_orderkey", "k.*")


# a gate's expression, from an order's status, priority and customer
_GATES_SQL = """SELECT o_orderkey, 'g_' || lower(o_orderstatus) AS s, 'p_' || regexp_replace(lower(o_orderpriority), '[^a-z]+', '_', 'g') || o_custkey AS c, CASE o_orderkey % 5 WHEN 0 THEN s || '.is_none_or(|k| ' || c || '(k))' WHEN 1 THEN s || '.is_some_and(' || c || '::is_root)' WHEN 2 THEN ' true' WHEN 3 THEN 'false' ELSE s || ' && ' || c END AS e FROM orders"""


@query(
    "p12_gate_predicate",
    f"""WITH g AS (SELECT o_orderkey, replace(e, ' ', '') AS e FROM ({_GATES_SQL})),
m AS (SELECT o_orderkey, e, regexp_matches(e, '^\\w+\\.is_none_or\\(.+\\)$') AS none_, regexp_matches(e, '^\\w+\\.is_some_and\\(.+\\)$') AS some_, e IN ('true', 'false') AS const_ FROM g)
SELECT o_orderkey, CASE WHEN none_ THEN 'any' WHEN some_ THEN 'all' WHEN const_ THEN 'const' ELSE 'rust_expression' END AS op, CASE WHEN none_ OR some_ THEN split_part(e, '.', 1) ELSE e END AS subject,
  CASE WHEN none_ OR some_ THEN regexp_extract(e, '^[^(]*\\((.*)\\)$', 1) END AS function, none_ OR some_ OR const_ AS machine_evaluable FROM m""",
)
def p12(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("g_"), F.lower("o_orderstatus")).alias("s"), F.concat(F.lit("p_"), F.regexp_replace(F.lower("o_orderpriority"), "[^a-z]+", "_"), F.col("o_custkey").cast("string")).alias("c"))
    forms = [F.concat("s", F.lit(".is_none_or(|k| "), "c", F.lit("(k))")), F.concat("s", F.lit(".is_some_and("), "c", F.lit("::is_root)")), F.lit(" true"), F.lit("false"), F.concat("s", F.lit(" && "), "c")]
    e = F.get(F.array(*forms), (F.col("o_orderkey") % 5).cast("int"))
    return o.select("o_orderkey", C.gate_predicate(e).alias("p")).select("o_orderkey", "p.*")


FIELDS = sorted(f for names in C.IDENTITY_DOMAINS.values() for f in names) + ["anything", "Session_id", ""]
_FIELDS_SQL = "[" + ", ".join(f"'{f}'" for f in FIELDS) + "]"


@query(
    "p13_identity_domain",
    f"""WITH f AS (SELECT p_partkey, {_FIELDS_SQL}[p_partkey % {len(FIELDS)} + 1] AS f FROM part)
SELECT p_partkey, f AS field, CASE WHEN f IN ('installation_id', 'request_kind') OR contains(f, 'window') THEN 'request_identity' WHEN f IN ('session_id', 'thread_id', 'agent_name') THEN 'thread_identity' WHEN f = 'turn_id' THEN 'turn_identity'
  WHEN regexp_matches(f, '^(forked_from|parent|root_turn|subagent)_|^thread_source$|^turn_trigger$') THEN 'lineage' WHEN regexp_matches(f, '^(sandbox|auto_review|node_repl)|^workspaces$') THEN 'execution_context' WHEN f LIKE 'tool%' THEN 'tool_inventory'
  WHEN regexp_matches(f, '^turn_started_at|^history_ingest') THEN 'timing_and_history' WHEN f = 'compaction' THEN f WHEN f = 'extra' THEN 'flattened_extra' ELSE 'other' END AS domain FROM f""",
)
def p13(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "part").select("p_partkey", _pick(FIELDS, "p_partkey").alias("field"))
    return f.withColumn("domain", C.identity_domain(F.col("field")))


PATHS = ["work/core-api/src/client/mod.rs", "work/core/src/lib.rs", "docs/readme.md", ""]


@query(
    "p15_qualified_schema_id",
    """WITH s AS (SELECT p_partkey, ['work/core-api/src/client/mod.rs', 'work/core/src/lib.rs', 'docs/readme.md', ''][p_partkey % 4 + 1] AS path, replace(p_name, ' ', '') || '<T>' AS name, replace(p_name, ' ', '') AS leaf FROM part),
q AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'core_api::client::' || leaf WHEN 1 THEN 'core::' || leaf WHEN 2 THEN 'path_' || substr(sha256(path), 1, 12) || '::' || leaf ELSE 'unknown_source::' || leaf END AS qualified_name FROM s)
SELECT *, 'schema.rust.' || replace(qualified_name, '::', '.') AS schema_id FROM q""",
)
def p15(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    name = C.qualified_schema_name(_pick(PATHS, "p_partkey"), F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("<T>")))
    return p.select("p_partkey", name.alias("qualified_name")).withColumn("schema_id", C.schema_id(F.col("qualified_name")))


@query(
    "p16_scan_secrets",
    """SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, 'sk-(?:proj-)?[A-Za-z0-9_-]{24,}') THEN 'api_key' END, CASE WHEN regexp_matches(text, '(?:token|secret|key) = "[0-9a-f]{40}"') THEN 'assigned_hex' END,
  CASE WHEN regexp_matches(text, 'github_pat_[A-Za-z0-9_]{30,}') THEN 'forge_fine_grained_token' END, CASE WHEN regexp_matches(text, 'gh[pousr]_[A-Za-z0-9]{30,}') THEN 'forge_token' END,
  CASE WHEN regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----') THEN 'private_key' END], lambda x: x IS NOT NULL) AS kinds FROM documents WHERE len(kinds) > 0""",
)
def p16(spark: SparkSession, sf: str) -> DataFrame:
    patterns = C.SECRET_PATTERNS | {"assigned_hex": '(?:token|secret|key) = "[0-9a-f]{40}"'}
    return table(spark, sf, "documents").select("doc_id", C.secret_kinds(F.col("text"), patterns).alias("kinds")).filter(F.size("kinds") > 0)


@query(
    "p17_safe_path",
    r"""WITH u AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages),
p AS (SELECT page_id, unnest([url, p, '/' || p, p || '/', replace(p, '/', '/../'), replace(p, '/', '/./'), replace(p, '/', '//'), replace(p, '/', chr(92)), p || '/.Git/config', p || '/.gitignore', '']) AS path FROM u)
SELECT page_id, path, path <> '' AND NOT contains(path, ':') AND NOT contains(path, chr(92)) AND NOT contains('/' || path || '/', '//') AND NOT contains('/' || path || '/', '/./') AND NOT contains('/' || path || '/', '/../') AND NOT contains('/' || lower(path) || '/', '/.git/') AS safe FROM p""",
)
def p17(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "pages").select("page_id", "url", F.regexp_replace("url", "^[a-z]+://", "").alias("p"))
    swapped = [F.replace("p", F.lit("/"), F.lit(x)) for x in ("/../", "/./", "//", "\\")]
    forms = F.array("url", "p", F.concat(F.lit("/"), "p"), F.concat("p", F.lit("/")), *swapped, F.concat("p", F.lit("/.Git/config")), F.concat("p", F.lit("/.gitignore")), F.lit(""))
    return u.select("page_id", F.explode(forms).alias("path")).withColumn("safe", C.is_safe_path(F.col("path")))


MESSAGES = ["Optional source unavailable", "required file missing", "unclassified event kind", "unclassified header seen", "mcp anchor changed", "config anchor changed", "anchor check failed", "symbol not found", "event odd", "header odd", "config odd", "plain words"]
ENDINGS = ["", "in the MCP server", "of the response", "absent upstream", "anchor failed", "optional, missing"]


@query(
    "p18_diagnostic_code",
    "WITH m AS (SELECT event_id, lower(["
    + ", ".join(f"'{m}'" for m in MESSAGES)
    + "][event_id % 12 + 1] || ' ' || ["
    + ", ".join(f"'{m}'" for m in ENDINGS)
    + """][user_id % 6 + 1]) AS m FROM events), c AS (SELECT event_id, m, CASE WHEN regexp_matches(m, 'source|unavailable|not found') THEN 'source_coverage' WHEN contains(m, 'event') THEN 'event_coverage' WHEN contains(m, 'header') THEN 'header_coverage'
  WHEN contains(m, 'config') THEN 'config_coverage' WHEN contains(m, 'mcp') THEN 'mcp_coverage' WHEN contains(m, 'response') THEN 'responses_coverage' ELSE 'coverage' END AS category,
  regexp_matches(m, 'unavailable|missing') AS gone, regexp_matches(m, 'anchor changed') OR (contains(m, 'anchor') AND contains(m, 'failed')) AS anchor FROM m)
SELECT event_id, category, CASE WHEN gone AND contains(m, 'optional') THEN 'OPTIONAL_SOURCE_UNAVAILABLE' WHEN gone AND contains(m, 'required') THEN 'REQUIRED_SOURCE_UNAVAILABLE'
  WHEN contains(m, 'unclassified') AND contains(m, 'event') THEN 'RESPONSE_EVENT_UNCLASSIFIED' WHEN contains(m, 'unclassified') AND contains(m, 'header') THEN 'HEADER_CANDIDATE_UNCLASSIFIED'
  WHEN anchor THEN CASE WHEN category IN ('mcp_coverage', 'config_coverage', 'responses_coverage') THEN upper(split_part(category, '_', 1)) || '_' ELSE '' END || 'SOURCE_ANCHOR_CHANGED'
  WHEN regexp_matches(m, 'not found|absent upstream') THEN 'SOURCE_SYMBOL_NOT_FOUND' WHEN category = 'coverage' THEN 'COVERAGE_WARNING' WHEN category = 'event_coverage' THEN 'RESPONSE_EVENT_COVERAGE_WARNING'
  ELSE upper(split_part(category, '_', 1)) || '_COVERAGE_WARNING' END AS code FROM c""",
)
def p18(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.concat_ws(" ", _pick(MESSAGES, "event_id"), _pick(ENDINGS, "user_id")).alias("m"))
    e = e.withColumn("category", C.warning_category(F.lit("/contract/"), F.col("m")))
    return e.select("event_id", "category", C.diagnostic_code(F.col("category"), F.col("m")).alias("code"))


_UUID = "lpad(lower(hex({k})), 8, '0') || '-0000-7000-8000-' || lpad(lower(hex({k})), 12, '0')"


def _uuid(key: str):
    h = F.lower(F.hex(key))
    return F.concat(F.lpad(h, 8, "0"), F.lit("-0000-7000-8000-"), F.lpad(h, 12, "0"))


@query(
    "p19_rollout_name",
    f"""WITH u AS (SELECT o_orderkey, o_orderdate, format('{{:08x}}', o_orderkey) || '-0000-7000-8000-' || format('{{:012x}}', o_orderkey) AS t, format('{{:08x}}', o_custkey) || '-0000-7000-8000-' || format('{{:012x}}', o_custkey) AS r FROM orders)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S') AS ts, t AS thread_id, CASE WHEN o_orderkey % 3 = 0 THEN r ELSE t END AS rollout_id, o_orderkey % 2 = 0 AS compressed,
  CASE WHEN o_orderkey % 5 = 0 THEN 'archived_sessions/' ELSE 'sessions/' || strftime(o_orderdate, '%Y/%m/%d') || '/' END || 'rollout-' || strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S') || '-' || t || CASE WHEN o_orderkey % 3 = 0 THEN '_' || r ELSE '' END || '.jsonl' || CASE WHEN o_orderkey % 2 = 0 THEN '.zst' ELSE '' END AS path
FROM u WHERE o_orderkey % 7 <> 0""",
)
def p19_p20(spark: SparkSession, sf: str) -> DataFrame:
    """Names with a broken prefix are no rollout and give no row."""
    key = F.col("o_orderkey")
    name = F.concat(F.when(key % 7 == 0, F.lit("log-")).otherwise(F.lit("rollout-")), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH-mm-ss"), F.lit("-"), _uuid("o_orderkey"), F.when(key % 3 == 0, F.concat(F.lit("_"), _uuid("o_custkey"))).otherwise(F.lit("")), F.lit(".jsonl"), F.when(key % 2 == 0, F.lit(".zst")).otherwise(F.lit("")))
    o = table(spark, sf, "orders").select("o_orderkey", name.alias("name")).withColumn("r", C.rollout_name(F.col("name"))).filter("r is not null")
    return o.select("o_orderkey", "r.ts", "r.thread_id", "r.rollout_id", "r.compressed", C.rollout_path(F.col("name"), key % 5 == 0).alias("path"))


@query(
    "p22_entity_change_class",
    """WITH c AS (SELECT l_orderkey, l_linenumber, ['turn.gate.a', 'source.core', 'schema.x', 'field.name', 'surface.y'][l_partkey % 5 + 1] AS e, ['predicate.op', 'sha256', 'wire_schema', 'status', 'note'][l_suppkey % 5 + 1] AS p, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END AS b, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS a FROM lineitem)
SELECT CASE WHEN b IS NULL THEN 'entity_value_added' WHEN a IS NULL THEN 'entity_value_removed' WHEN contains(e, 'gate') OR contains(p, 'predicate') THEN 'gate_semantics_changed' WHEN contains(e, 'source') AND p = 'sha256' THEN 'source_identity_changed'
  WHEN contains(p, 'schema') THEN 'schema_changed' WHEN contains(p, 'status') THEN 'status_changed' WHEN contains(e, 'field') THEN 'field_semantics_changed' ELSE 'entity_semantics_changed' END AS class, count(*) AS n FROM c GROUP BY ALL""",
)
def p22(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select(_pick(["turn.gate.a", "source.core", "schema.x", "field.name", "surface.y"], "l_partkey").alias("e"), _pick(["predicate.op", "sha256", "wire_schema", "status", "note"], "l_suppkey").alias("p"), F.when(F.col("l_linenumber") != 1, F.col("l_tax")).alias("b"), F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("a"))
    return l.groupBy(C.entity_change_class(F.col("e"), F.col("p"), F.col("b"), F.col("a")).alias("class")).agg(F.count("*").alias("n"))


@query(
    "p23_scope_tokens",
    """SELECT o_orderkey, list_sort(list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'SCOPE_COMMIT_INVALID' END, CASE WHEN o_orderkey % 6 = 0 THEN 'SCOPE_BUILD_INVALID' END, CASE WHEN o_orderstatus = 'P' THEN 'SCOPE_STATUS_INVALID' END, CASE WHEN contains(o_orderpriority, ' ') THEN 'SCOPE_LABEL_INVALID' END], lambda x: x IS NOT NULL)) AS codes FROM orders""",
)
def p23(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    commit = F.when(key % 4 == 0, F.lit("HEAD")).otherwise(F.sha1(key.cast("string").cast("binary")))
    build = F.when(key % 6 != 0, F.sha2(key.cast("string"), 256))
    checks = [("commit", commit, "commit"), ("build", build, "hex64"), ("status", F.col("o_orderstatus"), ("F", "O")), ("label", F.col("o_orderpriority"), "safe_token")]
    return table(spark, sf, "orders").select("o_orderkey", C.scope_codes(checks).alias("codes"))


@query("j7_stable_id", """WITH s AS (SELECT p_partkey, p_brand, lower(p_brand) AS o, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug, p_type FROM part)
SELECT p_partkey, slug, 'field.' || lower(p_type) || '.' || slug || '_' || substr(sha256(o), 1, 10) AS id FROM s""")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", ids.slug(F.col("p_brand")).alias("slug"), ids.stable_id("field", F.col("p_type"), F.col("p_brand")).alias("id"))


@query("j8_fingerprint", "SELECT p_partkey, 'change.' || substr(sha256(concat_ws('|', p_name, p_brand, coalesce(p_size::VARCHAR, 'null'))), 1, 24) AS id FROM part")
def j8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", ids.fingerprint("change.", 24, F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("id"))


@query(
    "p1_file_facts",
    r"""SELECT doc_id, octet_length(encode(text)) AS byte_length, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END)::INT AS line_count, sha256(text) AS sha256,
  sha1(encode('blob ' || octet_length(encode(text))) || '\x00'::BLOB || encode(text)) AS blob_sha1 FROM documents""",
)
def p1(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.octet_length(t).cast("long").alias("byte_length"), ids.line_count(t).alias("line_count"), F.sha2(t, 256).alias("sha256"), ids.blob_sha1(t).alias("blob_sha1"))
