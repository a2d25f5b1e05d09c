"""Classification of names, conditions, expressions and messages: column in, column out.

All are ordered rules; the first that holds decides. Null text gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rules(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    (first, value), *rest = rules
    return reduce(lambda c, r: c.when(r[0], F.lit(r[1])), rest, F.when(first, F.lit(value))).otherwise(F.lit(otherwise))


def _any(text: Column, tokens: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in tokens])


def _kept(text: Column, value: Column) -> Column:
    return F.when(text.isNotNull(), value)


# fixed values: tokens and classes of the sensitivity rules
IDENTIFIER_TOKENS = ("session", "thread", "request-id", "window-id", "turn-id", "account-id")
SECURITY_CATEGORIES = ("auth", "attestation", "security")
LOGGING = {
    "credential": "redact",
    "opaque_secret": "redact",
    "identifier": "hash_or_redact",
    "operational": "review_before_logging",
    "filesystem_path": "redact_or_relativize",
    "security_decision": "redact",
    "public_protocol": "allow",
}


def sensitivity(name: Column, category: Column | None = None) -> Column:
    low, cat = F.lower(name), F.coalesce(F.lower(category), F.lit("")) if category is not None else F.lit("")
    rules = [
        ((low == "authorization") | _any(low, ("bearer", "credential")), "credential"),
        (_any(low, ("ticket", "attestation")), "opaque_secret"),
        (_any(low, IDENTIFIER_TOKENS), "identifier"),
        (_any(low, ("metadata", "workspace")) | (cat == "metadata"), "operational"),
        (_any(low, ("path", "cwd")), "filesystem_path"),
        (cat.isin(*SECURITY_CATEGORIES), "security_decision"),
    ]
    return _kept(name, _rules(rules, "public_protocol"))


def logging_policy(of: Column) -> Column:
    """The logging policy of a sensitivity class."""
    return _rules([(of == k, v) for k, v in LOGGING.items() if v != "allow"], "allow")


def lifetime(name: Column) -> Column:
    low = F.lower(name)
    rules = [(low.contains(t), t) for t in ("installation", "session", "thread", "turn", "request")]
    return _kept(name, _rules([*rules, (low.contains("window"), "context_window")], "message_or_configuration"))


# fixed values: fields that the core owns
CORE_FIELDS = ("session_id", "thread_id", "turn_id", "request_kind", "tool_namespaces_info")


def field_authority(schema_id: Column, wire_name: Column, core: str = "core") -> Column:
    """Who sets a field; `core` names the product's own core."""
    schema, name = F.lower(schema_id), F.lower(wire_name)
    return _rules(
        [
            (schema.contains("turn_metadata") | name.isin(*CORE_FIELDS), core),
            (schema.contains("response") & ~schema.contains("request"), "server_or_provider"),
            (_any(schema, ("config", "mcpserverconfig")), "configuration"),
        ],
        "client_request_builder",
    )


def presence(serialized: Column, flattened: Column, skip_if: Column, optional: Column) -> Column:
    """struct(mode, required, nullable, accepts): how a field appears on the wire. Null flags count as false."""
    off = lambda c: ~F.coalesce(c, F.lit(False))
    skips = F.coalesce(skip_if, F.lit("")) != ""
    mode = _rules([(off(serialized), "never"), (~off(flattened), "flattened"), (skips, "conditional"), (~off(optional), "present_nullable")], "present")
    return F.struct(mode.alias("mode"), mode.isin("present", "present_nullable").alias("required"), (mode == "present_nullable").alias("nullable"))


def omission_predicate(skip_if: Column) -> Column:
    """Operation of the predicate under which a field is left out; null without a skip function."""
    s = F.trim(skip_if)
    return F.when(
        F.coalesce(skip_if, F.lit("")) != "",
        _rules([(s.endswith("Option::is_none"), "is_null"), (s.endswith("::is_empty"), "is_empty"), (s.endswith("Not::not"), "eq")], "custom_predicate"),
    )


def condition_predicate(condition: Column) -> Column:
    """struct(op, path, value, machine_evaluable) of a condition in words; null text is unspecified."""
    text = F.trim(condition)
    low = F.lower(text)
    exists = F.regexp_extract(text, r"(?i)^when\s+([a-zA-Z0-9_.-]+)\s+exists$", 1)
    env = F.regexp_extract(text, r"(?i)^when\s+([A-Z0-9_]+)\s+is set$", 1)

    def made(op: str, path: Column | str | None = None, value: str | None = None, evaluable: bool = True) -> Column:
        return F.struct(F.lit(op).alias("op"), (path if isinstance(path, Column) else F.lit(path).cast("string")).alias("path"), F.lit(value).cast("string").alias("value"), F.lit(evaluable).alias("machine_evaluable"))

    return (
        F.when(condition.isNull(), made("unspecified", evaluable=False))
        .when(low.isin("always", "required", "unconditional") | low.startswith("always "), made("const", value="true"))
        .when(low.contains("responses lite only") | (low == "responses lite"), made("eq", "model.use_responses_lite", "true"))
        .when(low.contains("request_kind") & _any(low, ("present", "exists")), made("exists", "turn_metadata.request_kind"))
        .when(exists != "", made("exists", exists))
        .when(env != "", made("env_exists", env))
        .when(low.contains("fedramp only"), made("eq", "auth.fedramp", "true"))
        .when(low.contains("when account") & low.contains("exists"), made("exists", "auth.account_id"))
        .when(low.contains("after server") & low.contains("turn state"), made("exists", "continuation.turn_state"))
        .when(low.contains("when parent thread exists"), made("exists", "turn.parent_thread_id"))
        .otherwise(made("source_condition", text, evaluable=False))
    )


_NAME = r"[A-Za-z_][A-Za-z0-9_]*"


def _after_call(text: Column) -> Column:
    """What follows the parenthesis that matches the first character, an opening one; null if none does."""
    step = lambda s, c: F.struct((s["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("depth"), (s["at"] + 1).alias("at"), F.when(s["end"] > 0, s["end"]).when((c == ")") & (s["depth"] == 1), s["at"] + 1).otherwise(0).alias("end"))
    end = F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")), step)["end"]
    return F.when(end > 0, F.substring(text, end + 1, F.length(text)))


def emission_kind(expression: Column, gates: Column, locals_: Column) -> Column:
    """struct(kind, gate, machine_evaluable) of a field's value expression, white space squeezed out.

    gates, locals_: arrays of the known gate and local names.
    """
    e = F.regexp_replace(F.trim(expression), r"\s+", "")
    # parentheses in string and character literals don't count
    bare = F.regexp_replace(F.regexp_replace(e, r'"(?:[^"\\]|\\.)*"', '""'), r"'(?:[^'\\]|\\.)'", "''")
    called = F.regexp_extract(bare, rf"^{_NAME}\.then_some(\(.*)$", 1)
    after = _after_call(called)
    gated = (called != "") & after.isin("", ".flatten()")
    gate = F.when(gated, F.regexp_extract(e, rf"^({_NAME})\.", 1))
    option = after == ".flatten()"

    def made(kind: str, evaluable: Column | bool = True, of: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (of if of is not None else F.lit(None).cast("string")).alias("gate"), (evaluable if isinstance(evaluable, Column) else F.lit(evaluable)).alias("machine_evaluable"))

    known = F.array_contains(gates, gate)
    return F.when(
        expression.isNotNull(),
        F.when(gated & option, made("conditional_option_passthrough", known, gate))
        .when(gated, made("conditional_value", known, gate))
        .when(e.isin("&self.extra", "self.extra", "self.extra.as_ref()"), made("flattened_extra"))
        .when(e.rlike(r"^non_empty_[A-Za-z0-9_]+\(&self\.[A-Za-z0-9_]+\)$"), made("non_empty_projection"))
        .when(e.rlike(rf"^self\.{_NAME}\.(?:as_deref|as_ref)\(\)$"), made("option_passthrough"))
        .when(e.rlike(rf"^&?self\.{_NAME}$"), made("value_passthrough"))
        .when(F.array_contains(locals_, e) | e.isin("request_kind_value", "compaction"), made("derived_local"))
        .otherwise(made("unclassified", False)),
    )


def gate_predicate(expression: Column) -> Column:
    """struct(op, subject, function, machine_evaluable) of a gate's expression."""
    e = F.regexp_replace(F.trim(expression), r"\s+", "")
    call = lambda method: (F.regexp_extract(e, rf"^({_NAME})\.{method}\((.+)\)$", 1), F.regexp_extract(e, rf"^({_NAME})\.{method}\((.+)\)$", 2))
    (none, none_call), (some, some_call) = call("is_none_or"), call("is_some_and")

    def made(op: str, subject: Column | None, function: Column | None, evaluable: bool = True) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(F.lit(op).alias("op"), (null if subject is None else subject).alias("subject"), (null if function is None else function).alias("function"), F.lit(evaluable).alias("machine_evaluable"))

    return F.when(
        expression.isNotNull(),
        F.when(none != "", made("any", none, none_call)).when(some != "", made("all", some, some_call)).when(e.isin("true", "false"), made("const", e, None)).otherwise(made("rust_expression", e, None, False)),
    )


# fixed values: fields of each identity domain
IDENTITY_DOMAINS = {
    "request_identity": ("installation_id", "window_id", "window_number", "context_window_id", "request_kind"),
    "thread_identity": ("session_id", "thread_id", "agent_name"),
    "turn_identity": ("turn_id",),
    "lineage": ("forked_from_thread_id", "forked_from_ordinal_exclusive", "parent_thread_id", "parent_turn_id", "root_turn_id", "subagent_kind", "thread_source", "turn_trigger"),
    "execution_context": ("sandbox", "sandbox_mode", "auto_review_enabled", "node_repl_auto_review_required", "node_repl_disabled", "workspaces"),
    "tool_inventory": ("tool_namespaces_info",),
    "timing_and_history": ("turn_started_at_unix_ms", "history_ingest_requested"),
    "compaction": ("compaction",),
    "flattened_extra": ("extra",),
}


def identity_domain(field_name: Column) -> Column:
    return _kept(field_name, _rules([(field_name.isin(*names), domain) for domain, names in IDENTITY_DOMAINS.items()], "other"))


def warning_category(pointer: Column, message: Column) -> Column:
    low = F.lower(F.concat_ws(" ", pointer, message))
    tokens = [("event", "event_coverage"), ("header", "header_coverage"), ("config", "config_coverage"), ("mcp", "mcp_coverage"), ("response", "responses_coverage")]
    return _rules([(_any(low, ("source", "unavailable", "not found")), "source_coverage"), *[(low.contains(t), c) for t, c in tokens]], "coverage")


def diagnostic_code(category: Column, message: Column) -> Column:
    low = F.lower(message)
    has = lambda *t: _any(low, t)
    anchor = has("anchor changed") | (has("anchor") & has("failed"))
    by_category = {"event_coverage": "RESPONSE_EVENT", "header_coverage": "HEADER", "config_coverage": "CONFIG", "mcp_coverage": "MCP", "responses_coverage": "RESPONSES", "source_coverage": "SOURCE"}
    coverage = [(category == c, f"{t}_COVERAGE_WARNING") for c, t in by_category.items()]
    anchors = [(anchor & (category == c), f"{t}_SOURCE_ANCHOR_CHANGED") for c, t in by_category.items() if t in ("MCP", "CONFIG", "RESPONSES")]
    rules = [
        (has("optional") & has("unavailable", "missing"), "OPTIONAL_SOURCE_UNAVAILABLE"),
        (has("required") & has("unavailable", "missing"), "REQUIRED_SOURCE_UNAVAILABLE"),
        (has("unclassified") & has("event"), "RESPONSE_EVENT_UNCLASSIFIED"),
        (has("unclassified") & has("header"), "HEADER_CANDIDATE_UNCLASSIFIED"),
        *anchors,
        (anchor, "SOURCE_ANCHOR_CHANGED"),
        (has("not found", "absent upstream"), "SOURCE_SYMBOL_NOT_FOUND"),
        *coverage,
    ]
    return _kept(message, _rules(rules, "COVERAGE_WARNING"))


def entity_change_class(entity_id: Column, path: Column, before: Column, after: Column) -> Column:
    entity, joined = F.lower(entity_id), F.lower(path)
    return _rules(
        [
            (before.isNull(), "entity_value_added"),
            (after.isNull(), "entity_value_removed"),
            (entity.contains("gate") | _any(joined, ("gate", "predicate")), "gate_semantics_changed"),
            (entity.contains("source") & _any(joined, ("sha", "digest", "blob", "path")), "source_identity_changed"),
            (joined.contains("schema"), "schema_changed"),
            (_any(joined, ("status", "complete")), "status_changed"),
            (entity.contains("field") | joined.contains("field"), "field_semantics_changed"),
        ],
        "entity_semantics_changed",
    )


#: Secret-like tokens by name.
SECRET_PATTERNS = {
    "forge_token": r"gh[pousr]_[A-Za-z0-9]{30,}",
    "forge_fine_grained_token": r"github_pat_[A-Za-z0-9_]{30,}",
    "api_key": r"sk-(?:proj-)?[A-Za-z0-9_-]{24,}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}


def secret_kinds(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """Sorted names of the patterns that match; the match itself is never returned."""
    found = [F.when(text.rlike(p), F.lit(k)) for k, p in sorted((patterns or SECRET_PATTERNS).items())]
    return F.array_compact(F.array(*found))


def is_safe_path(path: Column) -> Column:
    """A normalised path inside the repository: relative, no drive, no backslash, no empty, '.', '..' or '.git' part."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", "..") | (F.lower(p) == ".git"))
    return F.coalesce(path, F.lit("")).rlike(r"^[^\\:\x00]+$") & ~F.coalesce(bad, F.lit(True))


#: Scope tokens by name.
TOKEN_PATTERNS = {"hex64": r"^[0-9a-f]{64}$", "commit": r"^(?:[0-9a-f]{40}|[0-9a-f]{64})$", "safe_token": r"^[A-Za-z0-9][A-Za-z0-9._:/+-]{0,127}$"}


def scope_codes(checks: list[tuple[str, Column, str | tuple[str, ...]]]) -> Column:
    """Sorted codes SCOPE_<NAME>_INVALID of the values that fail; a check is a pattern's name or a set of values. Null fails."""
    codes = []
    for name, value, rule in checks:
        ok = value.rlike(TOKEN_PATTERNS[rule]) if isinstance(rule, str) else value.isin(*rule)
        codes.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"SCOPE_{name.upper()}_INVALID")))
    return F.array_sort(F.array_compact(F.array(*codes)))


def rollout_name(basename: Column) -> Column:
    """struct(ts string, thread_id, rollout_id, compressed, plain_name) of a session log's file name, null if it is none.

    rollout-<date>T<time>-<thread>[_<rollout>].jsonl[.zst]; without a suffix the rollout is the thread's own.
    """
    uuid = "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    pattern = rf"^rollout-(\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}-\d{{2}}-\d{{2}})-({uuid})(?:_({uuid}))?\.jsonl(\.zst)?$"
    part = lambda k: F.regexp_extract(basename, pattern, k)
    return F.when(
        basename.rlike(pattern),
        F.struct(part(1).alias("ts"), part(2).alias("thread_id"), F.when(part(3) != "", part(3)).otherwise(part(2)).alias("rollout_id"), (part(4) != "").alias("compressed"), F.regexp_replace(basename, r"\.zst$", "").alias("plain_name")),
    )


def rollout_path(name: Column, archived: Column) -> Column:
    """Where a session log lies: sessions/YYYY/MM/DD/<name>, or flat in archived_sessions/. Null for other names."""
    ts = rollout_name(name)["ts"]
    day = F.concat_ws("/", F.substring(ts, 1, 4), F.substring(ts, 6, 2), F.substring(ts, 9, 2))
    return F.when(ts.isNotNull(), F.when(archived, F.concat(F.lit("archived_sessions/"), name)).otherwise(F.concat_ws("/", F.lit("sessions"), day, name)))


def qualified_schema_name(source_path: Column, name: Column, top: str = "[^/]+") -> Column:
    """crate::module::Name from a path <top folder>/crate/src/module.rs; path_<digest>::Name for another path; unknown_source::Name without one."""
    leaf = F.split(name, "<")[0]
    pattern = rf"^{top}/([^/]+)/src/(.+)\.rs$"
    crate, module = F.regexp_extract(source_path, pattern, 1), F.regexp_extract(source_path, pattern, 2)
    modules = F.filter(F.split(module, "/"), lambda p: ~p.isin("lib", "mod", "main"))
    inside = F.concat_ws("::", safe_component(crate), F.transform(modules, safe_component), leaf)
    return (
        F.when(F.coalesce(source_path, F.lit("")) == "", F.concat(F.lit("unknown_source::"), leaf))
        .when(crate != "", inside)
        .otherwise(F.concat(F.lit("path_"), F.substring(F.sha2(source_path, 256), 1, 12), F.lit("::"), leaf))
    )


def safe_component(value: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    c = F.when(c == "", F.lit("unknown")).otherwise(c)
    return F.when(c.rlike("^[0-9]"), F.concat(F.lit("n_"), c)).otherwise(c)


def schema_id(qualified_name: Column) -> Column:
    return F.concat_ws(".", F.lit("schema.rust"), F.transform(F.split(qualified_name, "::"), safe_component))
