"""Queries on recorded traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlake.functions import canonical as CJ
from contractlake.operators import forks, lineage, records

from . import diff_queries
from .registry import query, table

def _k() -> Column:
    return F.col("event_id")


def _request(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata maps whose one value is JSON in a string; ids divisible by 10 hold text that is no JSON."""
    inner = F.to_json(F.struct(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("request_kind"), _k().cast("string").alias("extra_a")))
    return table(spark, sf, "events").select("event_id", F.create_map(F.lit("x-turn-metadata"), F.when(_k() % 10 == 0, F.lit("oops")).otherwise(inner), F.lit("other"), F.lit("1")).alias("m"))


@query(
    "j9_decode_turn_metadata",
    "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN user_id::VARCHAR END AS session_id, CASE WHEN event_id % 10 <> 0 THEN event_type END AS request_kind, CASE WHEN event_id % 10 <> 0 THEN event_id::VARCHAR END AS extra_a, event_id % 10 <> 0 AS valid FROM events",
)
def j9(spark: SparkSession, sf: str) -> DataFrame:
    d = _request(spark, sf).select("event_id", records.decode_turn_metadata(F.col("m")).alias("d"))
    return d.select("event_id", "d.session_id", "d.request_kind", F.element_at("d.extras", "extra_a").alias("extra_a"), "d.valid")


def _maps(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("user_id").cast("string")
    client = F.create_map(F.lit("session_id"), v, F.lit("a"), F.lit("client"), F.col("event_type"), v)
    config = F.create_map(F.lit("turn_id"), v, F.when(_k() % 2 == 0, F.lit("a")).otherwise(F.lit("b")), F.lit("config"))
    return table(spark, sf, "events").select("event_id", "event_type", client.alias("client"), config.alias("config"))


@query(
    "j10_merge_extra_metadata",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'config' ELSE 'client' END AS a, CASE WHEN event_id % 2 = 1 THEN 'config' END AS b, user_id::VARCHAR AS own, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 3 END AS n FROM events",
)
def j10(spark: SparkSession, sf: str) -> DataFrame:
    m = _maps(spark, sf).withColumn("m", records.merge_extra(F.col("client"), F.col("config")))
    return m.select("event_id", F.element_at("m", "a").alias("a"), F.element_at("m", "b").alias("b"), F.element_at("m", F.col("event_type")).alias("own"), F.size("m").alias("n"))


@query(
    "j11_validate_extra_metadata",
    """SELECT event_id, list_sort(list_filter([CASE WHEN event_id % 4 = 0 THEN 'EXTRA_METADATA_KEY_PATTERN' END, CASE WHEN event_id % 5 = 0 THEN 'EXTRA_METADATA_KEY_TOO_LONG' END, CASE WHEN event_id % 7 = 0 THEN 'EXTRA_METADATA_VALUE_TOO_LONG' END, CASE WHEN event_id % 3 = 0 THEN 'EXTRA_METADATA_RESERVED_KEY' END], lambda x: x IS NOT NULL)) AS codes FROM events""",
)
def j11(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda n, bad, good: F.when(_k() % n == 0, F.lit(bad)).otherwise(F.lit(good))
    m = F.create_map(pick(4, "1 bad", "good.key"), F.lit("v"), pick(5, "k" * 65, "k5"), pick(7, "é" * 65, "short"), pick(3, "turn_id", "t"), F.lit("v"))
    return table(spark, sf, "events").select("event_id", records.extra_codes(m).alias("codes"))


@query("j12_project_for_tool_call", "SELECT event_id, 'tool' AS kind, CASE WHEN event_id % 2 = 0 THEN 'client' END AS a, 2 + (event_id % 2 = 0)::INT AS n FROM events")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    m = _maps(spark, sf)
    removed = F.when(_k() % 2 == 0, F.col("client")).otherwise(F.map_filter("client", lambda k, v: k != "a"))
    p = records.project_for_tool(removed, ("session_id",), F.create_map(F.lit("request_kind"), F.lit("tool")))
    return m.select("event_id", p.alias("p")).select("event_id", F.element_at("p", "request_kind").alias("kind"), F.element_at("p", "a").alias("a"), F.size("p").alias("n"))


@query("j12_shadowed_extras", "SELECT event_id, list_sort(list_filter(['kind', event_type, CASE WHEN value < 50 THEN NULL ELSE 'a' END, 'session_id'], lambda x: x IS NOT NULL AND (x <> event_type OR value >= 20))) AS keys FROM events")
def j12_shadowed(spark: SparkSession, sf: str) -> DataFrame:
    """Configuration names shadow the client's own, which are not sent to tools; a fixed field of that name stays."""
    v = F.col("value")
    s = F.lit
    client = F.create_map(s("session_id"), s("s"), s("a"), s("1"), F.col("event_type"), s("2"))
    none = F.create_map().cast("map<string,string>")
    config = F.map_concat(F.when(v < 50, F.create_map(s("a"), s("x"), s("session_id"), s("y"))).otherwise(none), F.when(v < 20, F.create_map(F.col("event_type"), s("z"))).otherwise(none))
    p = records.project_for_tool(client, (), F.create_map(s("kind"), s("tool")), config)
    return table(spark, sf, "events").select("event_id", F.array_sort(F.map_keys(p)).alias("keys"))


@query(
    "j13_build_env_map",
    """SELECT event_id, list_sort(list_filter([CASE WHEN event_id % 3 = 0 OR event_id % 3 = 1 THEN 'PATH' END, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'API_KEY' END, CASE WHEN event_id % 3 = 0 THEN 'LANG' END, CASE WHEN event_id % 3 = 0 THEN 'AXB' END, 'EXTRA', CASE WHEN event_id % 5 = 0 THEN 'THREAD_ID' END], lambda x: x IS NOT NULL)) AS names FROM events""",
)
def j13(spark: SparkSession, sf: str) -> DataFrame:
    s = F.lit
    parent = F.create_map(s("PATH"), s("/bin"), s("API_KEY"), s("k"), s("LANG"), s("C"), s("TMPDIR"), s("/t"), s("NOISE"), s("n"), s("A.B"), s("1"), s("AXB"), s("2"))
    inherit = F.when(_k() % 3 == 0, "all").when(_k() % 3 == 1, "core").otherwise("none")
    env = records.env_map(parent, inherit, _k() % 2 == 0, F.array(s("tmp*"), s("a.b")), F.create_map(s("EXTRA"), s("1"), s("NOISE"), s("2")), F.array().cast("array<string>"), F.when(_k() % 5 == 0, F.col("user_id").cast("string")), ("PATH",), ("NOISE",))
    return table(spark, sf, "events").select("event_id", F.array_sort(F.map_keys(env)).alias("names"))




_ATTEMPTS = """x AS (SELECT event_id, user_id, ts, CASE WHEN value < 10 THEN ['context_length_exceeded', 'slow_down', 'odd_code', 'server_is_overloaded'][length(event_type) % 4 + 1] WHEN value < 12 THEN 'websocket_connection_limit_reached' END AS error_code,
  CASE event_type WHEN 'click' THEN 429 WHEN 'view' THEN 500 WHEN 'error' THEN 503 WHEN 'signup' THEN 418 ELSE CASE WHEN value < 60 THEN 500 ELSE 200 END END AS http_status, CASE WHEN value BETWEEN 12 AND 16 THEN 'io' WHEN value BETWEEN 16 AND 20 THEN 'idle_timeout' WHEN value BETWEEN 20 AND 22 THEN 'unheard' END AS socket_error FROM events),
c AS (SELECT *, CASE WHEN error_code IS NULL AND socket_error IS NULL AND http_status < 400 THEN NULL ELSE coalesce(CASE error_code WHEN 'context_length_exceeded' THEN 'ContextWindowExceeded' WHEN 'slow_down' THEN 'RateLimitExceeded' WHEN 'server_is_overloaded' THEN 'ServerOverloaded' WHEN 'websocket_connection_limit_reached' THEN 'Retryable' END,
  CASE socket_error WHEN 'io' THEN 'Transport::Network' WHEN 'idle_timeout' THEN 'Stream' END, CASE http_status WHEN 429 THEN 'RetryLimit' WHEN 500 THEN 'InternalServerError' WHEN 503 THEN 'ServerOverloaded' END, 'Retryable') END AS api_error FROM x),
r AS (SELECT *, CASE api_error WHEN 'Retryable' THEN 'Stream' WHEN 'Transport::Network' THEN 'ConnectionFailed' ELSE api_error END AS domain_error FROM c), d AS (SELECT *, domain_error IN ('Stream', 'RateLimitExceeded', 'InternalServerError', 'ConnectionFailed') AS retryable FROM r)"""


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    v, kind = F.col("value"), F.col("event_type")
    codes = F.array(*map(F.lit, ("context_length_exceeded", "slow_down", "odd_code", "server_is_overloaded")))
    code = F.when(v < 10, F.get(codes, F.length(kind) % 4)).when(v < 12, "websocket_connection_limit_reached")
    status = F.when(kind == "click", 429).when(kind == "view", 500).when(kind == "error", 503).when(kind == "signup", 418).when(v < 60, 500).otherwise(200)
    socket = F.when(v.between(12, 16), "io").when(v.between(16, 20), "idle_timeout").when(v.between(20, 22), "unheard")
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "value", code.alias("error_code"), status.alias("http_status"), socket.alias("socket_error"))


@query("k23_classify_errors", f"WITH {_ATTEMPTS} SELECT event_id, error_code, http_status, socket_error, api_error, domain_error, retryable FROM d")
def k23(spark: SparkSession, sf: str) -> DataFrame:
    return records.classify_errors(_attempts(spark, sf)).select("event_id", "error_code", "http_status", "socket_error", "api_error", "domain_error", "retryable")


@query(
    "w10_retry_plan",
    f"""WITH RECURSIVE {_ATTEMPTS}, n AS (SELECT event_id, user_id || '/' || dayofmonth(ts) // 11 AS request, retryable OR api_error IN ('RetryLimit', 'ServerOverloaded') AS retryable, CASE WHEN http_status = 503 THEN 1234 END AS d, coalesce(domain_error = 'ConnectionFailed', false) AS f, row_number() OVER (PARTITION BY user_id, dayofmonth(ts) // 11 ORDER BY ts, event_id) AS attempt FROM d),
a AS (SELECT *, CASE WHEN retryable IS NULL THEN 'done' WHEN NOT retryable OR attempt >= 8 THEN 'stop' WHEN attempt = 4 THEN 'fallback' ELSE 'retry' END AS action FROM n),
s AS (SELECT *, false AS over, action IN ('done', 'stop') AS ended FROM a WHERE attempt = 1 UNION ALL SELECT a.*, s.ended, s.ended OR a.action IN ('done', 'stop') FROM s JOIN a ON a.request = s.request AND a.attempt = s.attempt + 1),
t AS (SELECT *, attempt - CASE WHEN attempt > 4 THEN 4 ELSE 0 END AS own FROM s)
SELECT event_id, attempt::INT AS attempt, CASE WHEN NOT over THEN CASE WHEN attempt > 4 THEN 'fallback' ELSE 'primary' END END AS transport, CASE WHEN NOT over THEN action END AS action,
  CASE WHEN NOT over AND action = 'retry' THEN CASE WHEN f THEN least(5000 * pow(2, own - 1), 60000) ELSE coalesce(d, 200 * pow(2, own - 1)) END::BIGINT END AS delay_ms, CASE WHEN over THEN 'ATTEMPT_AFTER_END' WHEN attempt >= 8 AND retryable THEN 'RETRIES_EXHAUSTED' END AS code FROM t""",
)
def w10(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of a user in a third of a month; limits and overload are retried here as well, so that chains grow long."""
    a = records.classify_errors(_attempts(spark, sf))
    a = a.withColumn("request", F.concat_ws("/", "user_id", F.floor(F.dayofmonth("ts") / 11))).withColumn("retryable", F.col("retryable") | F.col("api_error").isin("RetryLimit", "ServerOverloaded"))
    a = a.withColumn("retry_delay_ms", F.when(F.col("http_status") == 503, 1234)).withColumn("connection_failed", F.coalesce(F.col("domain_error") == "ConnectionFailed", F.lit(False)))
    return records.retry_plan(a, "request", ["ts", "event_id"], budget=3).select("event_id", "attempt", "transport", "action", "delay_ms", "code")


@query(
    "k24_fork_history",
    """WITH RECURSIVE i AS (SELECT o_custkey AS rollout, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal, o_orderkey AS item FROM orders), f AS (SELECT c_custkey AS rollout, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey // 2 END AS base, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 7 END AS cut FROM customer),
c AS (SELECT rollout, base AS node, 1 AS hops, cut FROM f WHERE base IS NOT NULL UNION ALL SELECT c.rollout, f.base, c.hops + 1, CASE WHEN c.cut IS NULL OR f.cut < c.cut THEN f.cut ELSE c.cut END FROM c JOIN f ON f.rollout = c.node WHERE f.base IS NOT NULL)
SELECT c.rollout, hops, ordinal, item FROM c JOIN i ON i.rollout = c.node WHERE cut IS NULL OR ordinal < cut UNION ALL SELECT f.rollout, 0, ordinal, item FROM f JOIN i ON i.rollout = f.rollout""",
)
def k24(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf, "orders")
    items = o.select(F.col("o_custkey").alias("rollout"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("ordinal"), F.col("o_orderkey").alias("item"))
    c = F.col("c_custkey")
    forks = table(spark, sf, "customer").select(c.alias("rollout"), F.when(c % 4 != 0, F.floor(c / 2)).alias("base"), F.when(c % 3 != 0, c % 7).alias("cut"))
    return records.fork_history(forks, items)


_DEPTHS = 9
#: A conversation goes back to the one of a third of its number; its boundary follows from the lengths of its first texts.
_FORKS = """i AS (SELECT conv_id, turn, role, text, (CASE WHEN conv_id = 0 THEN 0 ELSE floor(ln(conv_id + 0.5) / ln(3))::INT + 1 END) AS depth FROM conversations),
n AS (SELECT conv_id AS rollout, depth, depth * 1000 + turn AS ordinal, 't' || turn // 2 AS turn, role = 'assistant' AS ends, (depth * 1000 + turn) * 10 AS at, length(text) AS size FROM i),
f AS (SELECT rollout, any_value(depth) AS depth, CASE WHEN rollout > 0 THEN rollout // 3 END AS base, max(size) % 5 AS k, min(size) % 5 AS m FROM n GROUP BY 1),
b AS (SELECT rollout, depth, base, CASE WHEN k = 0 AND base IS NOT NULL THEN (depth - 1) * 10000 + m * 10 + 5 END AS at, CASE WHEN k IN (1, 3) AND base IS NOT NULL THEN 't' || m END AS last_turn, CASE WHEN k IN (2, 3) AND base IS NOT NULL THEN 't' || m END AS before_turn FROM f),
t AS (SELECT rollout AS node, turn, min(ordinal) AS first, max(ordinal) AS last, bool_or(ends) AS completed FROM n GROUP BY ALL),
o AS (SELECT rollout AS base, min(ordinal) AS low FROM n GROUP BY 1), l AS (SELECT b.rollout, coalesce(max(ordinal) + 1, any_value(low)) AS cut FROM b JOIN o USING (base) LEFT JOIN n ON n.rollout = b.base AND n.at <= b.at WHERE b.at IS NOT NULL GROUP BY b.rollout),
h0 AS MATERIALIZED (SELECT rollout, rollout AS node, 0 AS hops, NULL::BIGINT AS cut FROM b WHERE base IS NULL), r0 AS (SELECT rollout, base, NULL AS boundary, NULL::BIGINT AS cut, NULL AS code FROM b WHERE base IS NULL)"""


def _fork_level(d: int) -> str:
    return f"""q{d} AS (SELECT b.rollout, arg_min({{'first': t.first, 'last': t.last, 'whole': completed AND (h.cut IS NULL OR t.last < h.cut)}}, hops) AS t FROM b JOIN h{d - 1} h ON h.rollout = b.base JOIN t ON t.node = h.node AND t.turn = coalesce(b.last_turn, b.before_turn) WHERE b.depth = {d} AND (h.cut IS NULL OR t.first < h.cut) GROUP BY 1),
r{d} AS MATERIALIZED (SELECT rollout, base, CASE WHEN last_turn IS NOT NULL AND before_turn IS NOT NULL THEN NULL WHEN last_turn IS NOT NULL THEN 'through_turn' WHEN before_turn IS NOT NULL THEN 'before_turn' ELSE 'latest' END AS boundary, CASE WHEN code IS NULL THEN CASE WHEN last_turn IS NOT NULL THEN q.t.last + 1 WHEN before_turn IS NOT NULL THEN q.t.first ELSE l.cut END END::BIGINT AS cut, code
 FROM (SELECT *, CASE WHEN last_turn IS NOT NULL AND before_turn IS NOT NULL THEN 'BOUNDARY_CONFLICT' WHEN coalesce(last_turn, before_turn) IS NOT NULL AND q.t IS NULL THEN 'TURN_NOT_IN_HISTORY' WHEN last_turn IS NOT NULL AND NOT q.t.whole THEN 'TURN_NOT_COMPLETED' END AS code FROM b LEFT JOIN q{d} q USING (rollout) WHERE depth = {d}) q LEFT JOIN l USING (rollout)),
h{d} AS MATERIALIZED (SELECT rollout, rollout AS node, 0 AS hops, NULL::BIGINT AS cut FROM b WHERE depth = {d} UNION ALL SELECT r.rollout, h.node, h.hops + 1, CASE WHEN h.cut IS NULL OR r.cut < h.cut THEN r.cut ELSE h.cut END FROM r{d} r JOIN h{d - 1} h ON h.rollout = r.base WHERE r.code IS NULL)"""


_RESOLVED = "WITH " + ", ".join([_FORKS, *(_fork_level(d) for d in range(1, _DEPTHS + 1))])


def _forks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "conversations")
    k, size = F.col("conv_id"), F.length("text")
    depth = F.when(k == 0, 0).otherwise(F.floor(F.ln(k + F.lit(0.5)) / F.ln(F.lit(3))).cast("int") + 1)
    ordinal = depth * 1000 + F.col("turn")
    items = c.select(k.alias("rollout"), depth.alias("depth"), ordinal.alias("ordinal"), F.concat(F.lit("t"), F.floor(F.col("turn") / 2).cast("string")).alias("turn"), (F.col("role") == "assistant").alias("ends"), (ordinal * 10).alias("at"), size.alias("size"))
    f = items.groupBy("rollout", "depth").agg((F.max("size") % 5).alias("k"), (F.min("size") % 5).alias("m")).withColumn("base", F.when(F.col("rollout") > 0, F.floor(F.col("rollout") / 3)))
    turn = F.concat(F.lit("t"), F.col("m").cast("string"))
    has = F.col("base").isNotNull()
    forks = f.select("rollout", "base", F.when(has & (F.col("k") == 0), (F.col("depth") - 1) * 10000 + F.col("m") * 10 + 5).alias("at"), F.when(has & F.col("k").isin(1, 3), turn).alias("last_turn"), F.when(has & F.col("k").isin(2, 3), turn).alias("before_turn"))
    return forks, items


@query("k24_fork_boundaries", _RESOLVED + " " + " UNION ALL ".join(f"SELECT * FROM r{d}" for d in range(_DEPTHS + 1)))
def k24_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return forks.resolve_boundaries(*_forks(spark, sf))


@query(
    "k24_bounded_history",
    _RESOLVED + f", h AS ({' UNION ALL '.join(f'SELECT * FROM h{d}' for d in range(_DEPTHS + 1))}) SELECT h.rollout, hops, ordinal, turn AS item FROM h JOIN n ON n.rollout = h.node WHERE cut IS NULL OR ordinal < cut",
)
def k24_history(spark: SparkSession, sf: str) -> DataFrame:
    """The whole history of each conversation, however many forks deep; its SQL is written out for nine."""
    given, items = _forks(spark, sf)
    found = forks.resolve_boundaries(given, items)
    sound = found.select("rollout", F.when(F.col("code").isNull(), F.col("base")).alias("base"), "cut")
    return records.fork_history(sound, items.select("rollout", "ordinal", F.col("turn").alias("item")))


@query(
    "k25_steer_check",
    """WITH e AS (SELECT user_id AS thread, ts, event_id AS seq, CASE event_type WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'steer' END AS kind, 't' || event_id // 4 AS turn FROM events WHERE event_type IN ('view', 'purchase', 'click')),
s AS (SELECT *, last_value(CASE kind WHEN 'started' THEN turn WHEN 'completed' THEN '' END IGNORE NULLS) OVER (PARTITION BY thread ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS a FROM e)
SELECT thread, seq AS steer, turn AS expected_turn, nullif(a, '') AS active_turn, coalesce(nullif(a, '') = turn, false) AS valid FROM s WHERE kind = 'steer'""",
)
def k25(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.concat(F.lit("t"), F.floor(_k() / 4).cast("string"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("thread"), "ts", _k().alias("seq"), "event_type", turn.alias("turn"))
    turns = e.filter("event_type in ('view', 'purchase')").select("thread", "ts", "seq", "turn", F.when(F.col("event_type") == "view", "started").otherwise("completed").alias("kind"))
    steers = e.filter("event_type = 'click'").select("thread", "ts", "seq", F.col("seq").alias("steer"), F.col("turn").alias("expected_turn"))
    return records.steer_check(steers, turns)


@query(
    "k26_relation_check",
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, max(l_returnflag) AS a, max(l_linestatus) AS b, CASE WHEN count(*) > 1 THEN NULL ELSE max(l_returnflag) END AS c FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS record, a, b, c FROM v)
SELECT record, 'flag' AS concept, 'b' AS node, a AS expected, b AS found FROM r WHERE a IS DISTINCT FROM b UNION ALL SELECT record, 'flag', 'c', a, c FROM r WHERE a IS DISTINCT FROM c""",
)
def k26(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_returnflag").alias("a"), F.max("l_linestatus").alias("b"), F.when(F.count("*") == 1, F.max("l_returnflag")).alias("c"))
    rows = l.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("record"), F.expr("stack(3, 'a', a, 'b', b, 'c', c) as (location, value)"))
    relations = spark.createDataFrame([("flag", "a", "b"), ("flag", "a", "c")], "concept string, canonical string, node string")
    return records.relation_check(rows, relations)


@query("w1_key_timeline", f"WITH {diff_queries.HISTORY}, l AS (SELECT *, lag(state) OVER (PARTITION BY catalog, key ORDER BY version) AS p FROM states), c AS (SELECT * FROM l WHERE p IS DISTINCT FROM state) SELECT catalog, key, state, version AS valid_from, lead(version) OVER (PARTITION BY catalog, key ORDER BY version) AS valid_to FROM c")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    from contractlake.operators.timelines import key_timeline

    return key_timeline(diff_queries.history(spark, sf), ["catalog", "key"])


@query("w2_version_view", f"WITH {diff_queries.HISTORY} SELECT catalog, arg_max(state, version) AS state, max(version) AS version, key FROM states WHERE version <= 1997 * 12 GROUP BY catalog, key")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    from contractlake.operators.timelines import version_view

    return version_view(diff_queries.history(spark, sf), ["catalog", "key"], F.lit(1997 * 12))


@query("w3_ordinal_contiguity", "WITH v AS (SELECT conv_id, turn FROM conversations WHERE length(text) >= 60), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS expected FROM v) SELECT conv_id, turn, expected::INT AS expected FROM n WHERE turn <> expected")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    from contractlake.operators.timelines import ordinal_gaps

    return ordinal_gaps(table(spark, sf, "conversations").filter("length(text) >= 60").select("conv_id", "turn"), ["conv_id"], "turn")


@query("k10_select_version", """WITH v AS (SELECT n_nationkey AS catalog, 'v' || i AS version, 'c' || (n_nationkey * 10 + i) AS commit, i = 4 AS current FROM nation, range(5) t(i)), q AS (SELECT c_custkey AS request, c_nationkey AS catalog, CASE WHEN c_custkey % 3 = 0 THEN 'v' || c_custkey % 6 END AS version, CASE WHEN c_custkey % 3 = 1 THEN 'c' || (c_nationkey * 10 + c_custkey % 8) END AS commit FROM customer)
SELECT request, CASE WHEN q.version IS NOT NULL THEN e.version ELSE coalesce(x.version, u.version) END AS version, CASE WHEN q.version IS NOT NULL THEN CASE WHEN e.version IS NULL THEN 'unknown_version' ELSE 'explicit_version' END WHEN x.version IS NOT NULL THEN 'exact_commit' ELSE 'current_forward_canary' END AS basis
FROM q LEFT JOIN v e ON e.catalog = q.catalog AND e.version = q.version LEFT JOIN v x ON x.catalog = q.catalog AND x.commit = q.commit AND q.version IS NULL LEFT JOIN v u ON u.catalog = q.catalog AND u.current""")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    from contractlake.operators.timelines import select_version

    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("catalog"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    versions = n.select("catalog", F.concat(F.lit("v"), F.col("i").cast("string")).alias("version"), F.concat(F.lit("c"), (F.col("catalog") * 10 + F.col("i")).cast("string")).alias("commit"), (F.col("i") == 4).alias("current"))
    k = F.col("c_custkey")
    asked = table(spark, sf, "customer").select(k.alias("request"), F.col("c_nationkey").alias("catalog"), F.when(k % 3 == 0, F.concat(F.lit("v"), (k % 6).cast("string"))).alias("version"), F.when(k % 3 == 1, F.concat(F.lit("c"), (F.col("c_nationkey") * 10 + k % 8).cast("string"))).alias("commit"))
    return select_version(asked, versions)


@query("w4_effective_model_changes", "WITH m AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 3 <> 0 THEN event_type END AS model FROM events), k AS (SELECT *, lag(model) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM m WHERE model IS NOT NULL) SELECT user_id, event_id, model, previous FROM k WHERE model IS DISTINCT FROM previous")
def w4(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", F.create_map(F.when(_k() % 3 == 0, F.lit("date")).otherwise(F.lit("X-Model")), F.col("event_type")).alias("headers"))
    named = F.map_filter("headers", lambda k, v: F.lower(k).isin("model", "x-model"))
    return records.model_changes(e, "user_id", ["ts", "event_id"], F.get(F.map_values(named), 0)).select("user_id", "event_id", "model", "previous")


@query("w5_catalog_refresh", "WITH s AS (SELECT user_id, event_id, (value > 50)::INT AS identity, event_type AS etag, lag((value > 50)::INT) OVER w AS pi, lag(event_type) OVER w AS pe FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, CASE WHEN pi = identity AND pe = etag THEN 'renew' ELSE 'refetch' END AS action FROM s")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("value") > 50).cast("int").alias("identity"), F.col("event_type").alias("etag"))
    return records.catalog_refresh(s, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "action")


@query("w6_latest_name", "SELECT o_custkey, arg_max(o_orderpriority, {'d': o_orderdate, 'k': o_orderkey}) AS name, count(*) AS entries FROM orders GROUP BY 1")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    return records.latest_name(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"])


@query("w8_history_mutation_kind", "WITH r AS (SELECT event_id, user_id, event_type AS rollout, CASE WHEN user_id % 2 = 0 THEN 1 END AS f, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT event_id, CASE WHEN p IS NULL THEN CASE WHEN f IS NOT NULL THEN 'fork' ELSE 'create' END WHEN p = rollout THEN 'resume' ELSE 'revert' END AS kind FROM r")
def w8(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("rollout"), F.when(F.col("user_id") % 2 == 0, 1).alias("forked_from"))
    return records.mutation_kind(r, "user_id", ["ts", "event_id"]).select("event_id", "kind")


@query("w9_page_items", "WITH i AS (SELECT DISTINCT l_suppkey AS thread, l_partkey AS item FROM lineitem), n AS (SELECT *, row_number() OVER w AS n, lead(item) OVER w AS nx FROM i WINDOW w AS (PARTITION BY thread ORDER BY item)), p AS (SELECT *, (n - 1) // 25 AS page FROM n) SELECT thread, item, page, CASE WHEN max(CASE WHEN n % 25 = 0 THEN nx IS NOT NULL END) OVER (PARTITION BY thread, page) THEN max(item) OVER (PARTITION BY thread, page) END AS next_cursor FROM p")
def w9(spark: SparkSession, sf: str) -> DataFrame:
    return records.page_items(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("thread"), F.col("l_partkey").alias("item")), ["thread"], "item", 25)


@query(
    "w9_page_after",
    """WITH q AS (SELECT s_suppkey * 2 + b AS request, s_suppkey AS thread, CASE WHEN s_acctbal >= 0 THEN floor(s_acctbal / 50)::BIGINT END AS cur, 10 + s_nationkey AS size, b = 1 AS backward FROM supplier, range(2) t(b)), i AS (SELECT DISTINCT l_suppkey AS thread, l_partkey AS item FROM lineitem),
n AS (SELECT request, size, item, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN backward THEN -item ELSE item END) AS position FROM q JOIN i USING (thread) WHERE cur IS NULL OR CASE WHEN backward THEN item < cur ELSE item > cur END),
c AS (SELECT request, max(item) FILTER (position = size) AS last_item, max(position) > max(size) AS more FROM n GROUP BY request)
SELECT request, position::INT AS position, item, CASE WHEN more THEN last_item END AS next_cursor FROM n JOIN c USING (request) WHERE position <= size""",
)
def w9_after(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").withColumn("b", F.explode(F.array(F.lit(0), F.lit(1))))
    cursor = F.when(F.col("s_acctbal") >= 0, F.floor(F.col("s_acctbal") / 50))
    requests = s.select((F.col("s_suppkey") * 2 + F.col("b")).alias("request"), F.col("s_suppkey").alias("thread"), cursor.alias("cursor"), (F.col("s_nationkey") + 10).alias("size"), (F.col("b") == 1).alias("backward"))
    return records.page_after(requests, table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "thread"), ["thread"], "l_partkey")


@query(
    "w11_redirect_hops",
    """WITH b AS (SELECT page_id // 14 AS chain, page_id % 14 AS hop, CASE WHEN url LIKE '%page=%' THEN replace(url, '://', '://u:p@') WHEN url LIKE '%example.net/%' THEN replace(url, 'example.net/', 'example.net:8443/') ELSE url END AS u,
  CASE WHEN length(html) < 3000 THEN 301 WHEN length(html) < 6000 THEN 302 WHEN length(html) < 9000 THEN 303 ELSE 307 END AS status, CASE WHEN url LIKE '%/fr/%' THEN 'POST' WHEN url LIKE '%/en/%' THEN 'GET' ELSE 'HEAD' END AS m FROM pages WHERE url IS NOT NULL),
x AS (SELECT *, split_part(u, '://', 1) AS s, regexp_extract(u, '^[a-z]+://(?:[^/@]*@)?([^/?#]*)', 1) AS h FROM b),
o AS (SELECT *, s || '://' || h || CASE WHEN h LIKE '%:%' THEN '' WHEN s = 'https' THEN ':443' ELSE ':80' END AS o, s || '://' || h || split_part(substr(u, strpos(u, h) + length(h)), '#', 1) AS bare, s || '://' || h || '/' AS root FROM x),
p AS (SELECT *, lag(s) OVER w AS ps, lag(o) OVER w AS po, lag(bare) OVER w AS pb, lag(root) OVER w AS pr, lag(status) OVER w AS pst, first(m) OVER w AS fm FROM o WINDOW w AS (PARTITION BY chain ORDER BY hop)),
d AS (SELECT *, max(coalesce((pst IN (301, 302) AND fm = 'POST') OR (pst = 303 AND fm <> 'HEAD'), false)::INT) OVER (PARTITION BY chain ORDER BY hop) = 1 AS drops_body FROM p)
SELECT chain, hop, CASE WHEN drops_body THEN 'GET' ELSE fm END AS method, drops_body, po <> o AS cross_origin, list_sort(list_filter([CASE WHEN po = o THEN 'Cookie' END, CASE WHEN NOT drops_body THEN 'Content-Type' END, 'Accept'], lambda x: x IS NOT NULL)) AS headers,
  CASE WHEN ps = 'https' AND s = 'http' THEN NULL WHEN po <> o THEN pr ELSE pb END AS referer, hop > 10 AS too_many FROM d WHERE po IS NOT NULL""",
)
def w11(spark: SparkSession, sf: str) -> DataFrame:
    """The pages' own addresses, some with a user or a port; the method by language, the status by length."""
    k, u, n = F.col("page_id"), F.col("url"), F.length("html")
    url = F.when(u.contains("page="), F.replace(u, F.lit("://"), F.lit("://u:p@"))).when(u.contains("example.net/"), F.replace(u, F.lit("example.net/"), F.lit("example.net:8443/"))).otherwise(u)
    status = F.when(n < 3000, 301).when(n < 6000, 302).when(n < 9000, 303).otherwise(307)
    method = F.when(u.contains("/fr/"), "POST").when(u.contains("/en/"), "GET").otherwise("HEAD")
    headers = F.create_map(F.lit("Cookie"), F.lit("c"), F.lit("Content-Type"), F.lit("t"), F.lit("Accept"), F.lit("a"))
    hops = table(spark, sf, "pages").filter("url is not null").select(F.floor(k / 14).alias("chain"), (k % 14).alias("hop"), url.alias("url"), status.alias("status"), method.alias("method"), headers.alias("headers"))
    return records.redirect_hops(hops, "chain", "hop").withColumn("headers", F.array_sort(F.map_keys("headers")))


@query(
    "w12_tool_names",
    """WITH t AS (SELECT DISTINCT p_brand AS server, replace(p_name, ' ', CASE WHEN p_size % 2 = 0 THEN '.' ELSE '/' END) AS raw_name FROM part WHERE p_name NOT LIKE 'red%'), b AS (SELECT *, regexp_replace(raw_name, '[^A-Za-z0-9_-]', '_', 'g') AS base FROM t)
SELECT server, raw_name, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '_' || substr(sha256(server || '|' || raw_name), 1, 12) ELSE base END AS model_name FROM b""",
)
def w12(spark: SparkSession, sf: str) -> DataFrame:
    sep = F.when(F.col("p_size") % 2 == 0, ".").otherwise("/")
    tools = table(spark, sf, "part").select(F.col("p_brand").alias("server"), F.replace("p_name", F.lit(" "), sep).alias("raw_name"))
    return records.tool_names(tools, F.lit(True), F.col("raw_name").startswith("red"))


@query("w15_thread_clock", "SELECT o_orderkey, o_orderdate AS created, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 3 DAY AS expired FROM orders")
def w15(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.lpad(F.lower(F.hex(F.unix_millis("o_orderdate"))), 12, "0")
    id_ = F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7abc-8000-000000000000"))
    o = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).select("o_orderkey", records.thread_clock(id_).alias("created"))
    return o.select("o_orderkey", F.col("created").cast("timestamp_ntz").alias("created"), F.date_format("created", "yyyy-MM-dd").alias("day"), (F.col("created") < F.expr("timestamp '1998-01-01' - interval 3 days")).alias("expired"))


_THREADS = "t AS (SELECT DISTINCT conv_id AS n, CASE WHEN conv_id > 0 AND conv_id % 11 <> 0 THEN conv_id // 2 END AS p FROM conversations)"


def _threads(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("conv_id")
    return table(spark, sf, "conversations").select(k.alias("thread"), F.when((k > 0) & (k % 11 != 0), F.floor(k / 2)).alias("parent")).distinct()


@query("g2_session_tree", f"WITH RECURSIVE {_THREADS}, r AS (SELECT n, n AS root, 0 AS depth FROM t WHERE p IS NULL OR p NOT IN (SELECT n FROM t) UNION ALL SELECT t.n, r.root, r.depth + 1 FROM t JOIN r ON t.p = r.n) SELECT n AS thread, root, depth::BIGINT AS depth FROM r")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.roots(_threads(spark, sf), "thread", "parent")


@query("g3_rollout_ancestors", f"WITH RECURSIVE {_THREADS}, r AS (SELECT n AS start, n AS node, 0 AS hops FROM t UNION ALL SELECT r.start, t.p, r.hops + 1 FROM r JOIN t ON t.n = r.node WHERE t.p IS NOT NULL) SELECT start, node, hops FROM r")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    t = _threads(spark, sf)
    return lineage.closure(t.filter("parent is not null").select(F.col("thread").alias("from_id"), F.col("parent").alias("to_id")), t.select(F.col("thread").alias("id")))


@query(
    "g3_rollout_kinds",
    """WITH RECURSIVE e AS (SELECT c_custkey AS f, c_custkey // 3 AS t, 'fork' AS label FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey >= 3 UNION ALL SELECT c_custkey, c_custkey // 4, 'parent' FROM customer WHERE c_acctbal >= 0 AND c_custkey >= 4),
m(state, label, next) AS (VALUES ('fork', 'fork', 'fork'), ('fork', 'parent', 'parent of a fork'), ('parent', 'parent', 'parent')), r AS (SELECT c_custkey AS start, s AS from_state, s AS state, c_custkey AS node, 0 AS hops FROM customer, (VALUES ('fork'), ('parent')) AS x(s) UNION SELECT r.start, r.from_state, m.next, e.t, r.hops + 1 FROM r JOIN m ON m.state = r.state JOIN e ON e.f = r.node AND e.label = m.label)
SELECT start, from_state, state, node, min(hops) AS hops FROM r GROUP BY ALL""",
)
def g3_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Forks, parents, and the parents of forks, each reached by its own kind of way."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    edge = lambda condition, n, label: c.filter(condition).select(k.alias("from_id"), F.floor(k / n).alias("to_id"), F.lit(label).alias("label"))
    edges = edge("c_mktsegment <> 'BUILDING' and c_custkey >= 3", 3, "fork").unionByName(edge("c_acctbal >= 0 and c_custkey >= 4", 4, "parent"))
    moves = spark.createDataFrame([("fork", "fork", "fork"), ("fork", "parent", "parent of a fork"), ("parent", "parent", "parent")], "state string, label string, to_state string")
    return lineage.labelled_closure(edges, c.select(k.alias("id"), F.explode(F.array(F.lit("fork"), F.lit("parent"))).alias("state")), moves)


@query("g4_delete_safety", f"WITH {_THREADS}, d AS (SELECT n % 10 AS set_id, n AS rollout FROM t WHERE n % 30 < 12), i AS (SELECT DISTINCT d.set_id, t.n AS rollout FROM t JOIN d ON t.p = d.rollout), o AS (SELECT set_id, list_sort(list(rollout)) AS b FROM i WHERE (set_id, rollout) NOT IN (SELECT set_id, rollout FROM d) GROUP BY 1) SELECT s.set_id, coalesce(b, []) AS blockers, b IS NULL AS safe FROM (SELECT DISTINCT set_id FROM d) s LEFT JOIN o USING (set_id)")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    t = _threads(spark, sf)
    doomed = t.filter("thread % 30 < 12").select((F.col("thread") % 10).alias("set_id"), F.col("thread").alias("rollout"))
    return lineage.delete_safety(t.select(F.col("thread").alias("rollout"), F.col("parent").alias("base")), doomed)


@query("g5_config_reach", """WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS f, 'n' || c_nationkey AS t FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'n' || r_regionkey FROM region), x AS (SELECT DISTINCT f, t FROM e),
r AS (SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS node, 0 AS hops FROM customer UNION SELECT r.start, x.t, r.hops + 1 FROM r JOIN x ON x.f = r.node WHERE r.hops < 12) SELECT start, node, min(hops) AS hops FROM r GROUP BY ALL""")
def g5(spark: SparkSession, sf: str) -> DataFrame:
    """The edges hold cycles: a region leads back to a nation."""
    def edge(t: str, p: str, a: str, q: str, b: str) -> DataFrame:
        return table(spark, sf, t).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("from_id"), F.concat(F.lit(q), F.col(b).cast("string")).alias("to_id"))

    edges = edge("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(edge("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(edge("region", "r", "r_regionkey", "n", "r_regionkey"))
    return lineage.closure(edges, table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")))


@query(
    "w7_pointer_cas",
    """WITH RECURSIVE u AS (SELECT user_id AS thread, event_id AS seq, CASE WHEN value < 50 THEN NULL ELSE event_type END AS expected, event_type AS new, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT thread, seq, n, CASE WHEN expected IS NULL THEN 'accepted' ELSE 'conflict' END AS outcome, CASE WHEN expected IS NULL THEN new END AS pointer FROM u WHERE n = 1
UNION ALL SELECT u.thread, u.seq, u.n, CASE WHEN u.expected IS NOT DISTINCT FROM r.pointer THEN 'accepted' ELSE 'conflict' END, CASE WHEN u.expected IS NOT DISTINCT FROM r.pointer THEN u.new ELSE r.pointer END FROM r JOIN u ON u.thread = r.thread AND u.n = r.n + 1)
SELECT thread, seq, outcome, pointer FROM r""",
)
def w7(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), F.when(F.col("value") < 50, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("expected"), F.col("event_type").alias("new"))
    return CJ.cas_fold(e)


@query("j1_canonical_json", """SELECT event_id, '{"a":' || user_id || ',"k":"' || event_type || '"}' AS json, sha256('{"a":' || user_id || ',"k":"' || event_type || '"}') AS sha256, NULL::VARCHAR AS error FROM events""")
def j1_j3(spark: SparkSession, sf: str) -> DataFrame:
    """The seal is dropped before the digest."""
    text = F.concat(F.lit('{ "k" : "'), F.col("event_type"), F.lit('", "integrity": 5, "a": '), F.col("user_id").cast("string"), F.lit(" }"))
    return table(spark, sf, "events").select("event_id", CJ.canonical_json(text, "utf8", drop=("integrity",)).alias("c")).select("event_id", "c.*")


@query(
    "j3_verify_seal",
    """WITH s AS (SELECT event_id, event_type, value, sha256('{"a":' || user_id || ',"k":"' || event_type || '"}') AS sha256 FROM events), c AS (SELECT event_id, CASE WHEN event_type = 'click' THEN NULL WHEN value < 50 THEN sha256(event_type) ELSE sha256 END AS claimed, sha256 FROM s)
SELECT event_id, claimed, sha256, CASE WHEN claimed IS NULL THEN 'SEAL_MISSING' WHEN claimed <> sha256 THEN 'SEAL_MISMATCH' END AS code FROM c""",
)
def j3_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Seals of other texts where the value is small, and none on clicks."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    own = F.sha2(F.concat(F.lit('{"a":'), user, F.lit(',"k":"'), kind, F.lit('"}')), 256)
    seal = F.concat(F.lit(', "integrity": {"sha256": "'), F.when(F.col("value") < 50, F.sha2(kind, 256)).otherwise(own), F.lit('"}'))
    text = F.concat(F.lit('{ "k" : "'), kind, F.lit('"'), F.when(kind == "click", F.lit("")).otherwise(seal), F.lit(', "a": '), user, F.lit(" }"))
    return table(spark, sf, "events").select("event_id", CJ.verify_seal(text, "utf8").alias("s")).select("event_id", "s.*")


@query(
    "j4_duplicate_json_keys",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n FROM lineitem)
SELECT l_orderkey, CASE WHEN sum(q) > 200 THEN 'no JSON' ELSE 'duplicate key ' || first(f ORDER BY l_linenumber, f) FILTER (n = 2) END AS error FROM l GROUP BY 1""",
)
def j4(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines as members named by their flags; large orders lack the closing brace."""
    member = F.concat(F.lit('"'), F.col("l_returnflag"), F.lit('":'), F.col("l_linenumber").cast("string"))
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", member.alias("m")))).alias("l"), F.sum("l_quantity").alias("q"))
    text = F.concat(F.lit("{"), F.array_join(F.col("l.m"), ","), F.when(F.col("q") > 200, "").otherwise("}"))
    return o.select("l_orderkey", CJ.canonical_json(text, "ascii").alias("c")).select("l_orderkey", "c.error")


def _doc() -> Column:
    return F.to_json(F.struct(F.col("o_orderstatus").alias("s"), F.struct(F.col("o_custkey").alias("c"), F.array(F.lit(1), F.col("o_orderkey")).alias("l")).alias("a/b")))


@query("j5_walk_json", """SELECT o_orderkey, u.p AS pointer, u.k AS kind, u.v AS value FROM (SELECT o_orderkey, unnest([{'p': '', 'k': 'object', 'v': NULL}, {'p': '/s', 'k': 'string', 'v': '"' || o_orderstatus || '"'}, {'p': '/a~1b', 'k': 'object', 'v': NULL}, {'p': '/a~1b/c', 'k': 'number', 'v': o_custkey::VARCHAR}, {'p': '/a~1b/l', 'k': 'array', 'v': '[1,' || o_orderkey || ']'}, {'p': '/a~1b/l/0', 'k': 'number', 'v': '1'}, {'p': '/a~1b/l/1', 'k': 'number', 'v': o_orderkey::VARCHAR}]) AS u FROM orders)""")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    return CJ.walk_json(table(spark, sf, "orders").select("o_orderkey", _doc().alias("t")), "o_orderkey", "t").select("o_orderkey", "pointer", "kind", "value")


@query("j6_json_pointer_get", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query(
    "k7_entity_leaf_diff",
    """WITH v AS (SELECT o_orderkey AS k, o_orderkey % 9 <> 0 AS hb, o_orderkey % 10 <> 0 AS ha, '"' || o_orderstatus || '"' AS s1, CASE WHEN o_orderkey % 6 = 0 THEN '"X"' ELSE '"' || o_orderstatus || '"' END AS s2, o_custkey AS c1, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey + 1 ELSE o_custkey END AS c2,
  '{"x":' || o_custkey || '}' AS m1, CASE WHEN o_orderkey % 5 = 0 THEN '1' WHEN o_orderkey % 7 = 0 THEN '{"x":[]}' ELSE '{"x":' || o_custkey || '}' END AS m2, o_orderkey % 8 = 0 AS e FROM orders),
t AS (SELECT *, CASE WHEN hb THEN '{"c":' || c1 || ',"m":' || m1 || ',"s":' || s1 || '}' END AS b, CASE WHEN ha THEN '{"c":' || c2 || CASE WHEN e THEN ',"e":{}' ELSE '' END || ',"m":' || m2 || ',"s":' || s2 || '}' END AS a FROM v)
SELECT k AS entity, '' AS pointer, b AS before, a AS after FROM t WHERE hb <> ha UNION ALL SELECT k, '/s', s1, s2 FROM t WHERE hb AND ha AND s1 <> s2 UNION ALL SELECT k, '/c', c1::VARCHAR, c2::VARCHAR FROM t WHERE hb AND ha AND c1 <> c2
UNION ALL SELECT k, '/e', NULL, '{}' FROM t WHERE hb AND ha AND e UNION ALL SELECT k, '/m', m1, '1' FROM t WHERE hb AND ha AND m2 = '1' UNION ALL SELECT k, '/m/x', c1::VARCHAR, '[]' FROM t WHERE hb AND ha AND m2 = '{"x":[]}'""",
)
def k7(spark: SparkSession, sf: str) -> DataFrame:
    from contractlake.operators.timelines import entity_diff

    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    o = table(spark, sf, "orders")
    plain = F.concat(F.lit('{"x":'), c, F.lit("}"))
    m = F.when(k % 5 == 0, "1").when(k % 7 == 0, '{"x":[]}').otherwise(plain)
    status = F.when(k % 6 == 0, "X").otherwise(F.col("o_orderstatus"))
    c2 = F.when(k % 4 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).cast("string")
    text = lambda c, e, m, s: F.concat(F.lit('{"s":"'), s, F.lit('","m":'), m, F.lit(',"c":'), c, e, F.lit("}")).alias("json")
    before = o.filter(k % 9 != 0).select(k.alias("entity"), text(c, F.lit(""), plain, F.col("o_orderstatus")))
    after = o.filter(k % 10 != 0).select(k.alias("entity"), text(c2, F.when(k % 8 == 0, ',"e":{}').otherwise(""), m, status))
    return entity_diff(before, after, "entity", "json")


@query("a20_layered_config", "WITH l AS (SELECT l_suppkey AS config, 'p' || l_partkey % 30 AS path, l_linenumber AS layer, max(l_returnflag) AS value FROM lineitem GROUP BY ALL) SELECT config, path, arg_max(value, layer) AS value, max(layer) AS layer FROM l GROUP BY ALL")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    from contractlake.operators.rollups import layered

    l = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("config"), F.concat(F.lit("p"), (F.col("l_partkey") % 30).cast("string")).alias("path"), F.col("l_linenumber").alias("layer")).agg(F.max("l_returnflag").alias("value"))
    return layered(l, ["config"])
