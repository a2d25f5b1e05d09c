"""Operators on recorded traffic: requests, threads, turns, retries, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: keys that the core owns, and the limits on extra entries
RESERVED = ("installation_id", "request_kind", "session_id", "thread_id", "turn_id", "x-turn-metadata")
MAX_ENTRIES, MAX_KEY_BYTES, MAX_VALUE_BYTES = 16, 64, 128
KEY_PATTERN = r"^[A-Za-z][A-Za-z0-9._-]*$"
METADATA_KEY = "x-turn-metadata"
KNOWN = ("session_id", "thread_id", "turn_id", "request_kind")


def decode_turn_metadata(client_metadata: Column, known: tuple[str, ...] = KNOWN, metadata_key: str = METADATA_KEY) -> Column:
    """struct(known fields…, extras map, valid) of the JSON object that a value of the metadata map holds as text. valid is false where the text is no object."""
    inner = F.from_json(F.element_at(client_metadata, metadata_key), T.MapType(T.StringType(), T.StringType()))
    fields = [F.element_at(inner, F.lit(k)).alias(k) for k in known]
    return F.struct(*fields, F.map_filter(inner, lambda k, v: ~k.isin(*known)).alias("extras"), inner.isNotNull().alias("valid"))


def merge_extra(client: Column, config: Column, reserved: tuple[str, ...] = RESERVED) -> Column:
    """Extra metadata: reserved keys go from both maps, config shadows the client's keys. Null maps are empty."""
    empty = F.from_json(F.lit("{}"), T.MapType(T.StringType(), T.StringType()))
    own = F.map_filter(F.coalesce(config, empty), lambda k, v: ~k.isin(*reserved))
    theirs = F.map_filter(F.coalesce(client, empty), lambda k, v: ~k.isin(*reserved) & ~F.map_contains_key(own, k))
    return F.map_concat(theirs, own)


def extra_codes(extra: Column, pattern: str = KEY_PATTERN, reserved: tuple[str, ...] = RESERVED) -> Column:
    """Sorted codes of the limits that a map of extra entries breaks."""
    entries = F.map_entries(extra)
    some = lambda f: F.exists(entries, f)
    codes = F.array(
        F.when(F.size(entries) > MAX_ENTRIES, F.lit("EXTRA_METADATA_TOO_MANY_ENTRIES")),
        F.when(some(lambda e: ~e["key"].rlike(pattern)), F.lit("EXTRA_METADATA_KEY_PATTERN")),
        F.when(some(lambda e: F.octet_length(e["key"]) > MAX_KEY_BYTES), F.lit("EXTRA_METADATA_KEY_TOO_LONG")),
        F.when(some(lambda e: F.octet_length(e["value"]) > MAX_VALUE_BYTES), F.lit("EXTRA_METADATA_VALUE_TOO_LONG")),
        F.when(some(lambda e: e["key"].isin(*reserved)), F.lit("EXTRA_METADATA_RESERVED_KEY")),
    )
    return F.array_sort(F.array_compact(codes))


def project_for_tool(metadata: Column, removed: tuple[str, ...], overrides: Column, config: Column | None = None, fixed: tuple[str, ...] = KNOWN) -> Column:
    """Metadata for a tool call: the removed fields go, the overrides are added and win.

    config: keys of it shadow the client's extras of the same name, which go, but its values are not copied.
    The fixed fields are no extras. Null maps are empty.
    """
    empty = F.from_json(F.lit("{}"), T.MapType(T.StringType(), T.StringType()))
    over, shadow = F.coalesce(overrides, empty), F.coalesce(config, empty) if config is not None else empty
    left = F.map_filter(F.coalesce(metadata, empty), lambda k, v: ~k.isin(*removed) & ~F.map_contains_key(over, k) & (k.isin(*fixed) | ~F.map_contains_key(shadow, k)))
    return F.map_concat(left, over)


def env_map(parent: Column, inherit: Column, ignore_default_excludes: Column, exclude: Column, overrides: Column, include_only: Column, thread_id: Column, core: tuple[str, ...], not_inheritable: tuple[str, ...], thread_variable: str = "THREAD_ID") -> Column:
    """A process's environment, in seven steps: inherit all, core or none; drop *KEY*, *SECRET*, *TOKEN* unless ignored; excludes; overrides; include_only if not empty; the thread id; launch variables.

    exclude and include_only are arrays of patterns with * for any characters, matched without case.
    ignore_default_excludes counts as true where null.
    """
    empty = F.from_json(F.lit("{}"), T.MapType(T.StringType(), T.StringType()))

    def like_any(name: Column, patterns: Column) -> Column:
        literal = lambda p: F.regexp_replace(F.upper(p), r"([^\p{L}\p{N}_*])", r"\\$1")
        return F.exists(patterns, lambda p: F.rlike(F.upper(name), F.concat(F.lit("(?s)^"), F.replace(literal(p), F.lit("*"), F.lit(".*")), F.lit("$"))))

    base = F.when(inherit == "all", parent).when(inherit == "core", F.map_filter(parent, lambda k, v: k.isin(*core))).otherwise(empty)
    secret = F.array(F.lit("*KEY*"), F.lit("*SECRET*"), F.lit("*TOKEN*"))
    kept = F.when(F.coalesce(ignore_default_excludes, F.lit(True)), base).otherwise(F.map_filter(base, lambda k, v: ~like_any(k, secret)))
    kept = F.map_filter(kept, lambda k, v: ~like_any(k, exclude))
    kept = F.map_concat(F.map_filter(kept, lambda k, v: ~F.map_contains_key(overrides, k)), overrides)
    kept = F.when(F.size(include_only) > 0, F.map_filter(kept, lambda k, v: like_any(k, include_only))).otherwise(kept)
    kept = F.when(thread_id.isNotNull(), F.map_concat(F.map_filter(kept, lambda k, v: k != thread_variable), F.create_map(F.lit(thread_variable), thread_id))).otherwise(kept)
    return F.map_filter(kept, lambda k, v: ~k.isin(*not_inheritable))


# fixed values: API errors by code, by status and code, by code of a wrapped message, by status and by socket error; their domain errors where the names differ; which of those are retried
API_ERRORS = {
    "context_length_exceeded": "ContextWindowExceeded",
    "insufficient_quota": "QuotaExceeded",
    "usage_not_included": "UsageNotIncluded",
    "cyber_policy": "CyberPolicy",
    "misalignment_policy_violation": "MisalignmentPolicyViolation",
    "invalid_prompt": "InvalidRequest",
    "bio_policy": "InvalidRequest",
    "server_is_overloaded": "ServerOverloaded",
    "rate_limit_exceeded": "RateLimitExceeded",
    "slow_down": "RateLimitExceeded",
    "previous_response_not_found": "Retryable",
    "websocket_connection_limit_reached": "Retryable",
}
STATUS_ERRORS = {500: "InternalServerError", 503: "ServerOverloaded", 429: "RetryLimit"}
SOCKET_ERRORS = {"closed": "Stream", "already_closed": "Stream", "idle_timeout": "Stream", "io": "Transport::Network", "other": "Transport::Network"}
DOMAIN_ERRORS = {"Retryable": "Stream", "Transport::Network": "ConnectionFailed"}
RETRIED = ("Stream", "RateLimitExceeded", "InternalServerError", "ConnectionFailed")


def classify_errors(attempts: DataFrame) -> DataFrame:
    """attempts with error_code, http_status and, if there is one, socket_error: adds api_error, domain_error and retryable.

    The most specific rule wins: a known code, then the socket error, then the status. Where none is known a
    code, a socket error or a status of 400 or more is Retryable. A row with none of them has no error: all
    three are null. One rule table is joined to the row's own keys, once a row.
    """
    spark = attempts.sparkSession
    rules = [("code", k, v) for k, v in API_ERRORS.items()] + [("socket", k, v) for k, v in SOCKET_ERRORS.items()] + [("status", str(k), v) for k, v in STATUS_ERRORS.items()]
    r = F.broadcast(spark.createDataFrame(rules, "of string, sign string, error string"))  # the literals above
    has_socket = "socket_error" in attempts.columns
    socket = F.col("socket_error") if has_socket else F.lit(None).cast("string")
    j = attempts
    for of, sign in (("code", F.col("error_code")), ("socket", socket), ("status", F.col("http_status").cast("string"))):
        j = j.join(r.filter(F.col("of") == of).select(F.col("sign").alias(f"_{of}"), F.col("error").alias(f"_by_{of}")), sign == F.col(f"_{of}"), "left")
    failed = F.col("error_code").isNotNull() | socket.isNotNull() | F.coalesce(F.col("http_status") >= 400, F.lit(False))
    j = j.withColumn("api_error", F.when(failed, F.coalesce("_by_code", "_by_socket", "_by_status", F.lit("Retryable"))))
    domain = F.coalesce(*[F.when(F.col("api_error") == k, F.lit(v)) for k, v in DOMAIN_ERRORS.items()], F.col("api_error"))
    return j.withColumn("domain_error", domain).withColumn("retryable", F.col("domain_error").isin(*RETRIED)).drop(*[f"_{x}{of}" for of in ("code", "socket", "status") for x in ("", "by_")])


def relation_check(records: DataFrame, relations: DataFrame) -> DataFrame:
    """records: record, location, value; relations: concept, canonical, node. Rows record, concept, node where the node's value is not the canonical location's (a value that is missing on one side counts)."""
    r = F.broadcast(relations)  # a literal table of rules
    left = records.join(r.select("concept", "node", F.col("canonical").alias("location")), "location").select("record", "concept", "node", F.col("value").alias("expected"))
    right = records.join(r.select("concept", "node", F.col("node").alias("location")), "location").select("record", "concept", "node", F.col("value").alias("found"))
    j = left.join(right, ["record", "concept", "node"], "full_outer")
    return j.filter(~F.col("expected").eqNullSafe(F.col("found")))


def model_changes(events: DataFrame, stream: str, order: list[str], value: Column) -> DataFrame:
    """Rows of a stream whose value is known and differs from the last known one before."""
    known = events.withColumn("model", value).filter("model is not null")
    before = F.lag("model").over(Window.partitionBy(stream).orderBy(*order))
    return known.withColumn("previous", before).filter(~F.col("model").eqNullSafe(F.col("previous")))


def catalog_refresh(signals: DataFrame, stream: str, order: list[str]) -> DataFrame:
    """signals: identity, etag. action renew if both are those of the signal before, else refetch."""
    w = Window.partitionBy(stream).orderBy(*order)
    same = F.lag(F.struct("identity", "etag")).over(w) == F.struct("identity", "etag")
    return signals.withColumn("action", F.when(F.coalesce(same, F.lit(False)), F.lit("renew")).otherwise(F.lit("refetch")))


def latest_name(entries: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """The last name of each key."""
    return entries.groupBy(key).agg(F.max_by(name, F.struct(*order)).alias("name"), F.count("*").alias("entries"))


def mutation_kind(rows: DataFrame, thread: str, order: list[str]) -> DataFrame:
    """rows: rollout, forked_from. kind create, fork, resume or revert: what each row does to the thread's history."""
    before = F.lag("rollout").over(Window.partitionBy(thread).orderBy(*order))
    kind = F.when(F.col("before").isNull(), F.when(F.col("forked_from").isNotNull(), F.lit("fork")).otherwise(F.lit("create"))).when(F.col("before") == F.col("rollout"), F.lit("resume")).otherwise(F.lit("revert"))
    return rows.withColumn("before", before).withColumn("kind", kind).drop("before")


def page_items(items: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Keyset pages of each key's different items: page and the cursor after it (null on the last page)."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = items.dropDuplicates([*keys, order]).withColumn("n", F.row_number().over(w)).withColumn("next", F.lead(order).over(w))
    paged = numbered.withColumn("page", F.floor((F.col("n") - 1) / size))
    last = F.max(order).over(Window.partitionBy(*keys, "page"))
    more = F.max(F.when(F.col("n") % size == 0, F.col("next").isNotNull())).over(Window.partitionBy(*keys, "page"))
    return paged.withColumn("next_cursor", F.when(F.coalesce(more, F.lit(False)), last)).drop("n", "next")


def page_after(requests: DataFrame, items: DataFrame, keys: list[str], order: str, block: int = 256) -> DataFrame:
    """requests: request, keys, cursor (null: from that end), size, backward. A page each: request, position (from 1), item, next_cursor (null where nothing lies beyond).

    Forward takes the next different items after the cursor, backward those before it, the nearest
    first. Null items are on no page. Cursors are placed among the items of their key by ranges, which
    makes a page a run of ordinals; a request meets the blocks of `block` ordinals that its page touches
    and no other items, and a key with very many items is many ranges and blocks.
    """
    from .lineage import written

    back = F.coalesce(F.col("backward"), F.lit(False))
    turn = F.col("turn")  # a cursor that goes backward stands before its equal, one that goes forward after it
    cursors = requests.filter("cursor is not null").select(*keys, F.col("cursor").alias("value"), F.when(back, 0).otherwise(2).alias("turn"), "request", "size")
    own = items.select(*keys, F.col(order).alias("value"), F.lit(1).alias("turn")).filter("value is not null").distinct()
    ranged = own.unionByName(cursors, allowMissingColumns=True).repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id())
    is_item = (turn == 1).cast("int")
    upto = Window.partitionBy("part", *keys).orderBy("value", "turn").rowsBetween(Window.unboundedPreceding, 0)
    placed = written(ranged.withColumn("upto", F.sum(is_item).over(upto)))
    # of each key as many rows as it has ranges
    per = Window.partitionBy(*keys)
    parts = placed.groupBy(*keys, "part").agg(F.sum(is_item).alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(per.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(per)).drop("n")
    at = placed.join(parts, [*keys, "part"]).withColumn("rank", F.col("before") + F.col("upto"))
    numbered = at.filter(turn == 1).select(*keys, "rank", F.floor(F.col("rank") / block).alias("block"), F.col("value").alias("item"))
    starts = at.filter(turn != 1).select("request", *keys, "size", (turn == 0).alias("backward"), F.col("rank").alias("start"), "total")
    ends = requests.filter("cursor is null").join(parts.select(*keys, "total").distinct(), keys)
    ends = ends.select("request", *keys, "size", back.alias("backward"), F.when(back, F.col("total")).otherwise(0).alias("start"), "total")
    start, size, total = F.col("start"), F.col("size"), F.col("total")
    low = F.when(F.col("backward"), F.greatest(start - size + 1, F.lit(1))).otherwise(start + 1)
    high = F.when(F.col("backward"), start).otherwise(F.least(start + size, total))
    more = F.when(F.col("backward"), start > size).otherwise(start + size < total)
    asked = starts.unionByName(ends).select("request", *keys, "size", "backward", "start", low.alias("low"), high.alias("high"), more.alias("more")).filter("low <= high")
    asked = asked.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor(F.col("high") / block))))
    page = asked.join(numbered, [*keys, "block"]).filter("rank between low and high")
    page = page.withColumn("position", F.when(F.col("backward"), start - F.col("rank") + 1).otherwise(F.col("rank") - start).cast("int"))
    cursor = F.max(F.when(F.col("more") & (F.col("position") == size), F.col("item"))).over(Window.partitionBy("request"))
    return page.withColumn("next_cursor", cursor).select("request", "position", "item", "next_cursor")


def retry_plan(attempts: DataFrame, request: str, order: list[str], budget: int = 5, base_ms: int = 200) -> DataFrame:
    """attempts: retryable (null: the attempt succeeded), retry_delay_ms, connection_failed. Adds attempt (from 1), transport, action, delay_ms and code.

    action: done, stop (not retryable), retry, or, at the failure after `budget` retries, fallback: the other
    transport is taken, with a budget of its own; when that is used up too, stop with RETRIES_EXHAUSTED. What
    was recorded after a request was done or stopped should not have been sent: ATTEMPT_AFTER_END, without action.
    A server's delay wins over the local back-off, which doubles with each retry of a transport; connection
    failures wait 5 s, doubling up to 60 s.
    """
    w = Window.partitionBy(request).orderBy(*order)
    n = attempts.withColumn("attempt", F.row_number().over(w))
    each = F.col("attempt") - F.when(F.col("attempt") > budget + 1, budget + 1).otherwise(0)
    last = F.col("attempt") >= 2 * (budget + 1)
    ends = F.col("retryable").isNull() | ~F.col("retryable") | last
    over = F.coalesce(F.max(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    n = n.withColumn("_over", over).withColumn("_each", each)
    action = F.when(F.col("retryable").isNull(), "done").when(~F.col("retryable") | last, "stop").when(F.col("attempt") == budget + 1, "fallback").otherwise("retry")
    n = n.withColumn("action", F.when(~F.col("_over"), action)).withColumn("transport", F.when(~F.col("_over"), F.when(F.col("attempt") > budget + 1, "fallback").otherwise("primary")))
    wait = F.when(F.col("connection_failed"), F.least(F.lit(5000) * F.pow(F.lit(2), F.least(F.col("_each") - 1, F.lit(30))), F.lit(60000))).otherwise(F.coalesce("retry_delay_ms", F.lit(base_ms) * F.pow(F.lit(2), F.least(F.col("_each") - 1, F.lit(30)))))
    code = F.when(F.col("_over"), "ATTEMPT_AFTER_END").when(last & F.col("retryable"), "RETRIES_EXHAUSTED")
    return n.withColumn("delay_ms", F.when(F.col("action") == "retry", wait.cast("long"))).withColumn("code", code).drop("_over", "_each")


SENSITIVE_HEADERS = ("authorization", "cookie", "cookie2", "proxy-authorization", "www-authenticate")
BODY_HEADERS = ("content-type", "content-length", "content-encoding", "transfer-encoding")


def origin(url: Column) -> Column:
    """scheme://host:effective port."""
    scheme, host = F.lower(F.parse_url(url, F.lit("PROTOCOL"))), F.lower(F.parse_url(url, F.lit("HOST")))
    port = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    port = F.when(port != "", port).when(scheme == "https", F.lit("443")).otherwise(F.lit("80"))
    return F.concat(scheme, F.lit("://"), host, F.lit(":"), port)


def redirect_hops(hops: DataFrame, chain: str, hop: str, most: int = 10) -> DataFrame:
    """hops: url, status (of the answer that led to the next hop), method (of the first request), headers map. What each hop after the first sends: method, drops_body, cross_origin, headers, referer, too_many.

    The method follows the whole chain: a switch to GET stays.
    """
    w = Window.partitionBy(chain).orderBy(hop)
    before = F.struct(F.lag("url").over(w).alias("url"), F.lag("status").over(w).alias("status"))
    h = hops.withColumn("p", before)
    switches = h["p"]["status"].isin(301, 302) & (F.first("method").over(w) == "POST") | (h["p"]["status"] == 303) & (F.first("method").over(w) != "HEAD")
    h = h.withColumn("drops_body", F.coalesce(F.max(switches.cast("int")).over(w), F.lit(0)) == 1)
    h = h.withColumn("method_sent", F.when(F.col("drops_body"), F.lit("GET")).otherwise(F.first("method").over(w))).filter("p.url is not null")
    old, new = F.col("p.url"), F.col("url")
    cross = origin(old) != origin(new)
    down = F.lower(old).startswith("https://") & F.lower(new).startswith("http://")
    bare = F.regexp_replace(F.regexp_replace(old, r"#.*$", ""), r"^([A-Za-z]+://)[^/?#]*@", "$1")
    root = F.concat(F.regexp_extract(bare, r"^([A-Za-z]+://[^/?#]*)", 1), F.lit("/"))
    headers = F.map_filter("headers", lambda k, v: ~(cross & F.lower(k).isin(*SENSITIVE_HEADERS)) & ~(F.col("drops_body") & F.lower(k).isin(*BODY_HEADERS)))
    return h.select(chain, hop, F.col("method_sent").alias("method"), "drops_body", cross.alias("cross_origin"), headers.alias("headers"), F.when(~down, F.when(cross, root).otherwise(bare)).alias("referer"), (F.col(hop) > most).alias("too_many"))


def tool_names(tools: DataFrame, allow: Column, deny: Column) -> DataFrame:
    """tools: server, raw_name. Allowed and not denied, by raw name; one row per raw identity with its model name, which a collision marks with a hash."""
    kept = tools.filter(allow & ~deny).dropDuplicates(["server", "raw_name"])
    kept = kept.withColumn("base", F.regexp_replace("raw_name", "[^A-Za-z0-9_-]", "_"))
    n = F.count("*").over(Window.partitionBy("base"))
    mark = F.substring(F.sha2(F.concat_ws("|", "server", "raw_name"), 256), 1, 12)
    return kept.withColumn("n", n).select("server", "raw_name", F.when(F.col("n") > 1, F.concat_ws("_", F.substring("base", 1, 115), mark)).otherwise(F.substring("base", 1, 128)).alias("model_name"))


def thread_clock(thread_id: Column) -> Column:
    """Creation time in a version 7 UUID, null for another id."""
    digits = F.replace(thread_id, F.lit("-"), F.lit(""))
    return F.when(thread_id.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-"), F.timestamp_millis(F.conv(F.substring(digits, 1, 12), 16, 10).cast("long")))


def fork_history(forks: DataFrame, items: DataFrame, width: int = 1024) -> DataFrame:
    """forks: rollout, base, cut (ordinals of the base's history from it on are not taken; null: all); items: rollout, ordinal, item. Each fork's effective items: rollout, hops (0: its own, 1: its base's, and so on), ordinal, item.

    A base that is a fork itself hands on its own effective history, so the chain of bases is followed
    and the smallest cut on the way holds. A range join on runs of `width` ordinals: a fork meets only the
    runs that begin before its cut, and the items of a base with many forks are many keys.
    """
    from .lineage import chains

    above = chains(forks.select(F.col("rollout").alias("start"), F.col("base").alias("node"), "cut"))
    i = items.select(F.col("rollout").alias("node"), "ordinal", "item", F.floor(F.col("ordinal") / width).alias("run"))
    ends = i.groupBy("node").agg(F.min("run").alias("first"), F.max("run").alias("last"))
    reach = above.join(ends, "node").withColumn("last", F.least("last", F.floor((F.col("cut") - 1) / width))).filter("first <= last")
    runs = reach.select("start", "node", "hops", "cut", F.explode(F.sequence("first", "last")).alias("run"))
    taken = runs.join(i, ["node", "run"]).filter("cut is null or ordinal < cut").select(F.col("start").alias("rollout"), "hops", "ordinal", "item")
    own = forks.select("rollout").distinct().join(items, "rollout").select("rollout", F.lit(0).alias("hops"), "ordinal", "item")
    return taken.unionByName(own)


def steer_check(steers: DataFrame, turns: DataFrame) -> DataFrame:
    """As-of join. turns: thread, ts, seq, turn, kind (started, completed); steers: thread, ts, seq, steer, expected_turn. A steer is valid if its turn is the one that is active then."""
    all_ = turns.select("thread", "ts", "seq", "turn", "kind", F.lit(None).cast("string").alias("expected_turn"), F.lit(None).cast("long").alias("steer")).unionByName(
        steers.select("thread", "ts", "seq", F.lit(None).cast("string").alias("turn"), F.lit("steer").alias("kind"), "expected_turn", "steer")
    )
    state = F.when(F.col("kind") == "started", F.col("turn")).when(F.col("kind") == "completed", F.lit(""))
    active = F.last(state, ignorenulls=True).over(Window.partitionBy("thread").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = all_.withColumn("active_turn", F.nullif(active, F.lit(""))).filter("kind = 'steer'")
    return out.select("thread", "steer", "expected_turn", "active_turn", F.coalesce(F.col("active_turn") == F.col("expected_turn"), F.lit(False)).alias("valid"))
