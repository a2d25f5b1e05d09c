"""Golden cases of the operators' rules on small tables."""

from __future__ import annotations

import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from contractlake.functions import canonical, classify, ids
from contractlake.operators import checks, coverage, diffs, documents, forks, lineage, records, rollups, timelines
from contractlake.streaming import state, turns


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "kind"), [("Authorization", "credential"), ("x-turn-id", "identifier"), ("cwd", "filesystem_path"), ("plain", "public_protocol")])
def test_sensitivity(spark, name, kind):
    assert one(spark, classify.sensitivity(F.lit(name))) == kind


def test_four_secret_patterns(spark):
    texts = {"forge_token": "ghp_" + "a" * 30, "forge_fine_grained_token": "github_pat_" + "b" * 30, "api_key": "sk-proj-" + "c" * 24, "private_key": "-----BEGIN RSA PRIVATE KEY-----"}
    for kind, text in texts.items():
        assert one(spark, classify.secret_kinds(F.lit(f"x {text} y"))) == [kind]
    assert one(spark, classify.secret_kinds(F.lit("sk-short"))) == []


def test_stable_components_never_meet(spark):
    a, b = one(spark, ids.component(F.lit("x-a-b"))), one(spark, ids.component(F.lit("x_a_b")))
    assert a != b and b == "x_a_b" and a.startswith("x_a_b_")


def test_canonical_dialects(spark):
    text = '{"b": "é", "a": [1, 2.5]}'
    assert one(spark, canonical.canonical_json(F.lit(text), "ascii")["json"]) == '{"a":[1,2.5],"b":"\\u00e9"}'
    assert one(spark, canonical.canonical_json(F.lit(text), "utf8")["json"]) == '{"a":[1,2.5],"b":"é"}'
    assert one(spark, canonical.canonical_json(F.lit('{"a":"é"}'), "nfc")["json"]) == '{"a":"é"}\n'
    assert one(spark, canonical.canonical_json(F.lit('{"a":NaN}'), "ascii")["error"]) == "NaN is no JSON number"
    assert one(spark, canonical.canonical_json(F.lit('{"é":1,"é":2}'), "nfc")["error"].startswith("keys collide"))


def _field(pair, name, kind="k", value="v", gate="g", domain="d", emission="e", semantic="s"):
    return (pair, name, kind, value, gate, domain, emission, semantic)


FIELD = "pair int, name string, kind string, value_expression string, gate_refs string, identity_domain string, emission_fingerprint string, semantic_fingerprint string"


def test_field_rules(spark):
    before = spark.createDataFrame([_field(1, n) for n in ("same", "gate_only", "gate_old", "fine", "coarse", "gone")], FIELD)
    after = spark.createDataFrame(
        [_field(1, "same"), _field(1, "gate_only", gate="h", semantic="t"), _field(1, "gate_old", gate="h", emission=None, semantic="t"), _field(1, "fine", kind="q", domain="r", emission="x", semantic="t"), _field(1, "coarse", emission="x", semantic="t"), _field(1, "new")],
        FIELD,
    )
    got = {(r["entity_id"].rsplit(".", 1)[1], r["kind"], r["severity"]) for r in diffs.diff_fields(before, after).collect()}
    assert got == {
        ("gate_old", "field_gate_changed", "breaking"),
        ("fine", "field_emission_kind_changed", "breaking"),
        ("fine", "field_identity_domain_changed", "breaking"),
        ("coarse", "field_semantics_changed", "attention"),
        ("gone", "field_removed", "breaking"),
        ("new", "field_added", "attention"),
    }


@pytest.mark.parametrize(
    ("severities", "extractors", "schema", "level", "version"),
    [
        ([], [], "v1", "patch", "1.2.4"),
        (["info"], [], "v1", "patch", "1.2.4"),
        (["attention"], [], "v1", "minor", "1.3.0"),
        (["breaking", "info"], [], "v1", "major", "2.0.0"),
        ([], ["minor"], "v1", "minor", "1.3.0"),
        ([], ["major"], "v1", "major", "2.0.0"),
        ([], [], "v2", "major", "2.0.0"),
    ],
)
def test_release_levels(spark, severities, extractors, schema, level, version):
    pairs = spark.createDataFrame([(1, "1.2.3", "a", "b", "v1", schema, "p", "p"), (2, "1.2.3", "a", "a", "v1", schema, "p", "p")], "pair int, previous_version string, commit_before string, commit_after string, schema_version_before string, schema_version_after string, coverage_profile_before string, coverage_profile_after string")
    changes = spark.createDataFrame([(1, s) for s in severities], "pair int, severity string")
    moved = spark.createDataFrame([(1, s) for s in extractors], "pair int, severity string")
    rows = diffs.release_level(pairs, changes, moved).collect()
    assert [(r["pair"], r["level"], r["version"]) for r in rows] == [(1, level, version)]


def test_merge_keeps_the_strongest_in_any_order(spark):
    schema = "category string, code string, source_id string, field_id string, location string, severity string, message string, strict_failure boolean, recoverable boolean, details map<string,string>"
    rows = [("c", "X", None, None, None, "error", "b", True, False, {"k": "1"}), ("c", "X", None, None, None, "info", "a", False, True, {"k": "2"})]
    for order in (rows, rows[::-1]):
        r = rollups.merge_diagnostics(spark.createDataFrame(order, schema)).first()
        assert (r["severity"], r["message"], r["strict_failure"], r["recoverable"], r["details"]) == ("error", "a | b", True, False, {"k": "1 | 2"})


def test_each_manifest_fault_gives_one_code(spark):
    s = "path string, byte_length long, sha256 string"
    declared = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x"), ("d", 1, "x"), ("ok", 1, "x")], s)
    actual = spark.createDataFrame([("b", 2, "x"), ("c", 1, "y"), ("d", 1, "x"), ("ok", 1, "x"), ("e", 1, "x"), ("../f", 1, "x")], s)
    got = sorted((r["path"], r["code"]) for r in checks.verify_manifest(declared, actual, []).collect())
    assert got == [("../f", "MEMBER_UNDECLARED"), ("../f", "UNSAFE_PATH"), ("a", "MEMBER_MISSING"), ("b", "SIZE_MISMATCH"), ("c", "HASH_MISMATCH"), ("d", "DUPLICATE_MEMBER"), ("e", "MEMBER_UNDECLARED")]


def test_steering_follows_the_active_turn(spark):
    t = spark.createDataFrame([("t", 1, 1, "A", "started"), ("t", 5, 2, "A", "completed"), ("t", 6, 3, "B", "started")], "thread string, ts int, seq int, turn string, kind string")
    s = spark.createDataFrame([("t", 2, 9, 1, "A"), ("t", 5, 9, 2, "A"), ("t", 7, 9, 3, "B"), ("t", 7, 10, 4, "A")], "thread string, ts int, seq int, steer long, expected_turn string")
    assert {r["steer"]: r["valid"] for r in records.steer_check(s, t).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_redirects(spark):
    rows = [("c", 0, "https://a/x#f", 302, "POST", {"Cookie": "1", "Content-Type": "t"}), ("c", 1, "https://b/y", 307, "POST", {"Cookie": "1", "Content-Type": "t"}), ("c", 2, "http://b/z", 200, "POST", {"Cookie": "1"})]
    got = {r["hop"]: r for r in records.redirect_hops(spark.createDataFrame(rows, "chain string, hop int, url string, status int, method string, headers map<string,string>"), "chain", "hop").collect()}
    assert got[1]["method"] == "GET" and got[1]["headers"] == {} and got[1]["referer"] == "https://a/"
    assert got[2]["method"] == "GET" and got[2]["referer"] is None and got[2]["cross_origin"]


def test_cycles_have_no_root(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "lost")]
    got = {r["n"]: (r["root"], r["depth"]) for r in lineage.roots(spark.createDataFrame(rows, "n string, p string"), "n", "p").collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "x": (None, None), "y": (None, None), "z": ("z", 0)}


def test_pointer_updates(spark):
    rows = [("t", 1, None, "a"), ("t", 2, None, "b"), ("t", 3, "a", "c")]
    got = [(r["seq"], r["outcome"], r["pointer"]) for r in canonical.cas_fold(spark.createDataFrame(rows, "thread string, seq long, expected string, new string")).orderBy("seq").collect()]
    assert got == [(1, "accepted", "a"), (2, "conflict", "a"), (3, "accepted", "c")]


def test_schema_paths_stop_at_a_reference_to_itself(spark):
    doc = '{"properties":{"n":{"$ref":"#/d"}},"d":{"type":"object","properties":{"n":{"$ref":"#/d"}},"required":["n"]}}'
    got = {r["path"] for r in canonical.schema_paths(spark.createDataFrame([(1, doc), (2, "{"), (3, None)], "k int, t string"), "k", "t").collect()}
    assert got == {"", "n", "n.n"}


def test_constants_are_found_where_they_stand(spark):
    text = 'const AB: &str = "x";\n  pub const   A: &str = "y";\nlet z = headers.get(A); cache.insert("plain-key", 1); insert_header(req, "x-real"); client.header("X-H", v)'
    files = spark.createDataFrame([("s", 1, text), ("t", 2, "response_headers.get(A)")], "snapshot string, file int, text string")
    constants = coverage.const_definitions(files, ["snapshot", "file"])
    assert sorted((r["name"], r["offset"]) for r in constants.collect()) == [("A", text.index("const   A") + 1), ("AB", 1)]
    got = sorted((r["file"], r["direction"], r["name"]) for r in coverage.header_candidates(files, constants, ["snapshot", "file"], ["snapshot"]).collect())
    assert got == [(1, "read", "y"), (1, "written", "X-H"), (1, "written", "x-real")]


@pytest.mark.parametrize(
    ("text", "kind"),
    [("g.then_some(x)", "conditional_value"), ("g.then_some(f(x)).flatten()", "conditional_option_passthrough"), ("g.then_some(x).unwrap_or(y)", "unclassified"), ('g.then_some(")")', "conditional_value"), ("g.then_some(x", "unclassified"), ("g.then_some(')', x).flatten()", "conditional_option_passthrough")],
)
def test_what_follows_the_call_decides(spark, text, kind):
    got = one(spark, classify.emission_kind(F.lit(text), F.array(F.lit("g")), F.array().cast("array<string>")))
    assert got["kind"] == kind and got["machine_evaluable"] == (kind != "unclassified")


def test_conformance(spark):
    rules = [("/n", "max", "80"), ("/n", "min", "1.5"), ("/e", "enum", "é,b"), ("/o", "max_properties", "1"), ("/o", "members", "number"), ("", "not_required", "x,y"), ("", "one_of", "t|a:n|b:"), ("/o/r", "required", None)]
    docs = [(1, '{"n": 1.5, "e": "é", "o": {"r": 2}, "t": "a"}'), (2, '{"n": 80.5, "e": "è", "o": {"r": "s", "q": 1}, "t": "c"}'), (3, '{"x": 1, "y": 2, "t": "a", "o": {}}'), (4, "{"), (5, '{"n": 1, "t": "b"}'), (6, None)]
    got = sorted(map(tuple, coverage.schema_conformance(spark.createDataFrame(docs, "k int, t string"), spark.createDataFrame(rules, "pointer string, rule string, arg string"), "k", "t").collect()))
    assert got == [(2, "", "one_of"), (2, "/e", "enum"), (2, "/n", "max"), (2, "/o", "max_properties"), (2, "/o", "members"), (3, "", "not_required"), (3, "", "one_of"), (3, "/o/r", "required"), (4, "", "parse"), (5, "/n", "min")]


def test_entity_changes(spark):
    def diff(a, b):
        s = "k int, t string"
        return sorted(tuple(r)[1:] for r in timelines.entity_diff(spark.createDataFrame([(1, a)], s), spark.createDataFrame([(1, b)] if b else [], s), "k", "t").collect())

    assert diff('{"a": 1}', '{"a": {"b": 1}}') == [("/a", "1", '{"b":1}')]
    assert diff('{"a": 1}', '{"a": 1, "b": {}}') == [("/b", None, "{}")]
    assert diff('{"a": [1, {"x": 1}]}', '{"a": [1, {"x": 2}]}') == [("/a", '[1,{"x":1}]', '[1,{"x":2}]')]
    assert diff('{"a": {"b": {"c": 1}, "d": 1}}', '{"a": {"b": {"c": true}}}') == [("/a/b/c", "1", "true"), ("/a/d", "1", None)]
    assert diff('{"a": 1}', None) == [("", '{"a":1}', None)]


def test_exclude_patterns_are_no_regular_expressions(spark):
    s = F.lit
    env = records.env_map(F.create_map(s("A.B"), s("1"), s("AXB"), s("2"), s("C+"), s("3"), s("CC"), s("4"), s("PREFIX_X"), s("5")), s("all"), s(True), F.array(s("a.b"), s("c+"), s("prefix*")), F.from_json(s("{}"), "map<string,string>"), F.array().cast("array<string>"), s(None).cast("string"), (), ())
    assert one(spark, F.array_sort(F.map_keys(env))) == ["AXB", "CC"]


def test_a_fork_of_a_fork_has_its_bases_history(spark):
    forks = spark.createDataFrame([("r0", None, None), ("r1", "r0", 2), ("r2", "r1", None), ("r3", "r2", 3), ("x", "y", 1), ("y", "x", None)], "rollout string, base string, cut int")
    items = spark.createDataFrame([("r0", i, c) for i, c in enumerate("abz")] + [("r1", 2, "c"), ("r1", 3, "d"), ("r2", 4, "e"), ("r3", 3, "f")], "rollout string, ordinal int, item string")
    got = records.fork_history(forks, items).orderBy("rollout", F.desc("hops"), "ordinal").groupBy("rollout").agg(F.collect_list("item").alias("i"))
    assert {r["rollout"]: "".join(r["i"]) for r in got.collect()} == {"r0": "abz", "r1": "abcd", "r2": "abcde", "r3": "abcf"}


def test_closure_has_no_silent_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 35)], "from_id int, to_id int")
    start = spark.createDataFrame([(0,)], "id int")
    got = {r["node"]: r["hops"] for r in lineage.closure(edges, start).collect()}
    assert got == {i: i for i in range(41)}
    with pytest.raises(RuntimeError, match="hops"):
        lineage.closure(edges, start, most_hops=20)


def test_set_digest_is_that_of_the_bytes(spark):
    import hashlib

    rows = [("s", "b", b"2"), ("s", "a", b"\xff\x00"), ("t", "x", None), (None, "n", b"")]
    got = {r["s"]: (r["set_sha256"], r["files"]) for r in rollups.set_digest(spark.createDataFrame(rows, "s string, path string, content binary"), ["s"]).collect()}
    want = lambda *parts: hashlib.sha256(b"".join(p + b"\0" for p in parts)).hexdigest()
    assert got == {"s": (want(b"a", b"\xff\x00", b"b", b"2"), 2), "t": (want(b"x", b""), 1), None: (want(b"n", b""), 1)}


def test_turn_state_is_terminal(spark):
    rows = [(1, 1, 1, "InProgress"), (1, 1, 2, "Failed"), (1, 1, 3, "Completed"), (1, 2, 4, "InProgress")]
    got = {(r["turn"], r["seq"], r["status"]) for r in turns.reduce_turns_batch(spark.createDataFrame(rows, "thread long, turn long, seq long, status string")).collect()}
    assert got == {(1, 2, "Failed"), (2, 4, "InProgress")}


def test_listing_collisions(spark):
    rows = [("z", p, 1, 1) for p in ("A/b", "a/B", "café", "café", "ok")]
    got = sorted(r["code"] for r in checks.check_listing(spark.createDataFrame(rows, "archive string, path string, size long, compressed_size long"), canonical.nfc(F.col("path"))).collect())
    assert got == ["CASE_COLLISION", "UNICODE_COLLISION"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], FIELD)
    assert diffs.diff_fields(none, none).count() == 0
    assert coverage.key_collisions(spark.createDataFrame([], "k int, t string"), "k", "t").count() == 0
    assert lineage.roots(spark.createDataFrame([], "n string, p string"), "n", "p").count() == 0


def test_order_of_rows_does_not_matter(spark):
    rows = [(1, f"n{i}", "k", str(i), "g", "d", str(i), str(i)) for i in range(50)]
    a = spark.createDataFrame(rows, FIELD)
    b = spark.createDataFrame([(*r[:3], r[3] + "x", *r[4:6], r[6] + "x", r[7] + "x") for r in rows[::-1]], FIELD)
    one_way = sorted(map(tuple, diffs.diff_fields(a, b).collect()))
    other = sorted(map(tuple, diffs.diff_fields(a.repartition(7), b.repartition(3)).collect()))
    assert one_way == other


def test_ended_turns_are_forgotten_behind_the_watermark(spark, tmp_path):
    schema = "thread long, turn long, seq long, status string, ts timestamp"
    hour = lambda h: f"timestamp'2024-01-01 {h:02d}:00:00'"
    batches = [
        [(1, 1, 1, "InProgress", 1), (1, 1, 2, "Completed", 1)],
        [(2, 2, 3, "InProgress", 9)],
        [(2, 2, 4, "InProgress", 9)],
        [(1, 1, 5, "InProgress", 2), (2, 2, 6, "InProgress", 9)],
    ]
    for rows in batches:
        values = ", ".join(f"({t}L, {u}L, {s}L, '{x}', {hour(h)})" for t, u, s, x, h in rows)
        spark.sql(f"SELECT * FROM VALUES {values} AS t(thread, turn, seq, status, ts)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    changes = state.reduce_turns(events, "ts")
    q = state.started(changes, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    got = {(r["turn"], r["seq"], r["status"]) for r in spark.read.schema(changes.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 1, "InProgress"), (1, 2, "Completed"), (2, 3, "InProgress")}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_seals(spark):
    body = '{"a":1}'
    sha = hashlib.sha256(body.encode()).hexdigest()
    texts = ['{"a": 1, "integrity": {"sha256": "%s"}}' % sha, '{"a": 2, "integrity": {"sha256": "%s"}}' % sha, body, "{", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["c"] for r in df.select("i", canonical.verify_seal(df["t"], "utf8")["code"].alias("c")).orderBy("i").collect()]
    assert got == [None, "SEAL_MISMATCH", "SEAL_MISSING", "no JSON", None]


def test_pages_go_both_ways(spark):
    items = spark.createDataFrame([(1, x) for x in [1, 2, 2, 3, 4, 5]], "k int, x int")
    requests = spark.createDataFrame([(1, 1, None, 2, False), (2, 1, 3, 9, False), (3, 1, 4, 2, True), (4, 1, None, 5, True)], "request int, k int, cursor int, size int, backward boolean")
    got = {}
    for r in records.page_after(requests, items, ["k"], "x").orderBy("request", "position").collect():
        got.setdefault((r["request"], r["next_cursor"]), []).append(r["item"])
    assert got == {(1, 2): [1, 2], (2, None): [4, 5], (3, 2): [3, 2], (4, None): [5, 4, 3, 2, 1]}


@pytest.mark.parametrize("block", [1, 7, 256])
def test_pages_of_a_hot_key(spark, block):
    """One key with most of the items and requests, repeated items, cursors between, at and beyond them."""
    items = [(1, v * 3) for v in range(500)] + [(1, 30)] * 20 + [(2, 5), (None, 4), (1, None)]
    asked = [(r, 1 if r % 9 else 2, None if r % 7 == 0 else (r * 37) % 1600 - 50, r % 13, r % 2 == 0) for r in range(200)] + [(900, 3, 1, 5, False), (901, None, None, 5, True)]
    got = {}
    df = records.page_after(spark.createDataFrame(asked, "request int, k int, cursor int, size int, backward boolean"), spark.createDataFrame(items, "k int, x int"), ["k"], "x", block)
    for r in df.orderBy("request", "position").collect():
        got.setdefault(r["request"], []).append((r["position"], r["item"], r["next_cursor"]))
    want = {}
    for request, k, cursor, size, back in asked:
        own = sorted({x for key, x in items if key == k and x is not None}, reverse=back) if k is not None else []
        rest = [x for x in own if cursor is None or (x < cursor if back else x > cursor)]
        page = rest[:size]
        if page:
            want[request] = [(i, x, page[-1] if len(rest) > size else None) for i, x in enumerate(page, 1)]
    assert got == want


def test_rules_compare_by_kind(spark):
    rules = [("/c", "const", "5"), ("/e", "enum", 'true,1,x,"2"'), ("/m", "max", "9007199254740992")]
    docs = [(1, '{"c": 5.0, "e": true, "m": 9007199254740992}'), (2, '{"c": "5", "e": "true", "m": 9007199254740993}'), (3, '{"e": 1.0}'), (4, '{"e": "1"}'), (5, '{"e": "2"}'), (6, '{"e": 2}')]
    got = sorted(map(tuple, coverage.schema_conformance(spark.createDataFrame(docs, "k int, t string"), spark.createDataFrame(rules, "pointer string, rule string, arg string"), "k", "t").collect()))
    assert got == [(2, "/c", "const"), (2, "/e", "enum"), (2, "/m", "max"), (4, "/e", "enum"), (6, "/e", "enum")]


def test_refused_json_is_a_row(spark):
    deep = "[" * 60_000 + "]" * 60_000
    half = "[" * 3_000 + "]" * 3_000
    texts = ['{"a":1e999}', deep, '{"\\ud800":1}', '{"a":"\\ud800"}', '{"a":1}', "1" * 5_000, half, '{"\\ud800":1,"\\ud800":2}']
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    walked = {r["k"]: r["error"] for r in canonical.walk_json(docs, "k", "t").collect()}
    assert [walked[i] for i in (0, 1, 2, 3, 4, 5, 7)] == ["number out of range", "nested too deep", "lone surrogate", None, None, "number out of range", "duplicate key \\ud800"]
    for dialect, surrogate in (("ascii", None), ("utf8", "lone surrogate"), ("nfc", "lone surrogate")):
        rows = {r["k"]: r["c"]["error"] for r in docs.select("k", canonical.canonical_json(F.col("t"), dialect).alias("c")).collect()}
        assert [rows[i] for i in (0, 1, 2, 3, 4, 5)] == ["number out of range", "nested too deep", surrogate, surrogate, None, "number out of range"]
    assert {r["k"] for r in canonical.schema_paths(docs, "k", "t").collect()} >= {4}


def test_seals_leave_out_nested_members(spark):
    def sealed(claim, at, status):
        return f'{{"a": 1, "generated_at": "{at}", "status": {{"ok": true, "validated_at": "{status}"}}, "integrity": {{"sha256": "{claim}"}}}}'

    claim = hashlib.sha256(b'{"a":1,"status":{"ok":true}}').hexdigest()
    seal = lambda text: one(spark, canonical.verify_seal(F.lit(text), "ascii", unsealed=("generated_at", "/status/validated_at"))["code"])
    assert seal(sealed(claim, "now", "then")) is None and seal(sealed(claim, "x", "y")) is None
    assert seal(sealed("0", "now", "then")) == "SEAL_MISMATCH"


def test_text_patterns(spark):
    text = 'x("response.Output-Item"); y("codex.A_b.c"); z("other.x");\npub(in crate::x) mod foo;\nmod A1;\n// mod no\nstruct HttpClient;\n// FooClient\npub use a::BarClient;\nuse b::BazClient;'
    files = spark.createDataFrame([(1, text)], "k int, text string")
    found = lambda p: coverage.literals(files, ["k"], p).first()["names"]
    assert found(coverage.event_kinds("response", "codex")) == ["codex.A_b.c", "response.Output-Item"]
    assert found(coverage.MODULES) == ["A1", "foo"] and found(coverage.CLIENTS) == ["BarClient"]


def test_profiles(spark):
    reports = spark.createDataFrame([(1, "p", ["a"], False), (2, "p", None, None), (3, "q", ["a"], False), (4, None, [], True), (5, "p", ["a"], True)], "report int, profile string, observed array<string>, legacy boolean")
    profiles = spark.createDataFrame([("p", ["a"], None)], "profile string, required array<string>, allow_legacy boolean")
    got = sorted(map(tuple, coverage.profile_evaluation(reports, profiles).collect()))
    assert got == [(1, [], True, None), (2, ["a"], False, "REQUIRED_MISSING"), (3, [], False, "PROFILE_UNKNOWN"), (4, [], False, "PROFILE_UNKNOWN"), (5, [], False, "LEGACY_NOT_ALLOWED")]


def fork_tables(spark, given, items):
    f = spark.createDataFrame(given, "rollout string, base string, at int, last_turn string, before_turn string")
    return f, spark.createDataFrame(items, "rollout string, ordinal long, turn string, ends boolean, at int")


def test_boundaries(spark):
    items = [("r", i, f"t{i // 2}", i % 2 == 1 and i < 6, i) for i in range(8)] + [("r", 8, None, None, 8)] + [("a", 4, "t9", True, 20), ("a", 5, "t2", True, 21)]
    given = [
        ("r", None, None, None, None), ("a", "r", None, "t1", None), ("b", "a", None, "t1", None), ("c", "a", None, "t2", None), ("d", "a", None, None, "t0"), ("e", "a", None, None, "t3"), ("f", "r", None, "t3", None), ("g", "r", None, "t1", "t2"),
        ("h", "r", 3, None, None), ("i", "r", -1, None, None), ("j", "r", None, None, None), ("k", "d", None, "t0", None), ("l", "k", None, "t0", None), ("m", "h", None, "t1", None), ("n", "none", 5, None, None), ("o", "a", 20, None, None), ("p", "i", None, None, "t0"),
    ]
    got = {r["rollout"]: (r["boundary"], r["cut"], r["code"]) for r in forks.resolve_boundaries(*fork_tables(spark, given, items)).collect()}
    lost = "TURN_NOT_IN_HISTORY"
    assert got == {
        "r": (None, None, None), "a": ("through_turn", 4, None), "b": ("through_turn", 4, None), "c": ("through_turn", 6, None), "d": ("before_turn", 0, None), "e": ("before_turn", None, lost), "f": ("through_turn", None, "TURN_NOT_COMPLETED"), "g": (None, None, "BOUNDARY_CONFLICT"),
        "h": ("latest", 4, None), "i": ("latest", 0, None), "j": ("latest", None, None), "k": ("through_turn", None, lost), "l": ("through_turn", None, lost), "m": ("through_turn", 4, None), "n": ("latest", None, None), "o": ("latest", 5, None), "p": ("before_turn", None, lost),
    }


def test_a_turn_cut_in_the_middle_is_not_complete(spark):
    items = [("r", i, "t", i == 3, i) for i in range(4)]
    given = [("r", None, None, None, None), ("a", "r", 1, None, None), ("b", "a", None, "t", None), ("c", "b", None, None, "t")]
    got = {r["rollout"]: (r["cut"], r["code"]) for r in forks.resolve_boundaries(*fork_tables(spark, given, items)).collect()}
    assert got == {"r": (None, None), "a": (2, None), "b": (None, "TURN_NOT_COMPLETED"), "c": (None, "TURN_NOT_IN_HISTORY")}


@pytest.mark.parametrize("width", [1, 3, 1024])
def test_history_by_runs_of_ordinals(spark, width):
    links = spark.createDataFrame([("r", None, None), ("a", "r", 7), ("b", "a", None), ("c", "b", 3), ("d", "r", 0)], "rollout string, base string, cut long")
    items = spark.createDataFrame([("r", i, i) for i in range(2, 12)] + [("a", i, -i) for i in range(7, 10)], "rollout string, ordinal long, item int")
    got = {}
    for r in records.fork_history(links, items, width).collect():
        got.setdefault(r["rollout"], []).append(r["item"])
    assert {k: sorted(v) for k, v in got.items()} == {"r": list(range(2, 12)), "a": [-9, -8, -7, 2, 3, 4, 5, 6], "b": [-9, -8, -7, 2, 3, 4, 5, 6], "c": [2]}


def test_one_mutation_one_row(spark):
    sound = {"nodes": {"a/b": {"id": "a/b"}, "c": {}}, "gone": {}, "edges": [{"id": "e1", "source": "a/b", "target": "c"}, {"id": "e2", "source": "c", "target": "c"}], "refs": ["c", "a/b"], "n": 2}
    change = lambda **c: json.dumps({**sound, **c})
    docs = [
        (0, json.dumps(sound)), (1, change(edges=[{"source": "z"}])), (2, change(nodes={"a/b": {"id": "q"}, "c": {}})), (3, change(gone={"c": {}})), (4, change(n=3)),
        (5, change(edges=[{"id": "e1", "source": "c"}, {"id": "e1", "source": "c"}])), (6, "{"), (7, change(refs=["c", "d", 5, None])), (8, change(refs="z")), (9, None),
    ]
    nodes = canonical.walk_json(spark.createDataFrame(docs, "k int, t string"), "k", "t")
    got = documents.document_checks(nodes, "k", {"source": "node", "target": "node", "refs": "node"}, {"node": "/nodes/*", "gone": "/gone/*"}, (("node", "gone"),), {"/n": "node"}, ("/edges/*/id",))
    assert sorted(map(tuple, got.collect())) == [
        (1, "NODE_UNRESOLVED", "/edges/0/source", "z"), (2, "MAP_KEY_MISMATCH", "/nodes/a~1b", "q"), (3, "CONTRADICTORY_ID", "/nodes/c", "c"), (4, "COUNT_MISMATCH", "/n", "2"),
        (5, "DUPLICATE_ID", "/edges/*/id", "e1"), (6, "DOCUMENT_REFUSED", "", "no JSON"), (7, "NODE_UNRESOLVED", "/refs/1", "d"), (8, "NODE_UNRESOLVED", "/refs", "z"),
    ]


def test_observed_extractors(spark):
    docs = [(1, '{"a": {"extractor.x": 1}, "b": [{"extractor_id": "extractor.y"}, {"id": "other"}, {"name": "extractor.no"}], "diagnostics": [{"id": "extractor.z"}], "required_extractors": {"extractor.w": 1}}'), (2, "{}")]
    nodes = canonical.walk_json(spark.createDataFrame(docs, "k int, t string"), "k", "t")
    assert {r["k"]: r["observed"] for r in documents.observed_extractors(nodes, "k").collect()} == {1: ["extractor.x", "extractor.y"], 2: []}


def test_error_chain(spark):
    rows = [(1, "slow_down", 503, "io"), (2, None, 503, "io"), (3, None, 503, None), (4, None, 200, "idle_timeout"), (5, "new", 200, None), (6, None, 404, None), (7, None, 200, None), (8, None, None, None), (9, "usage_not_included", 429, None)]
    got = {r["i"]: (r["api_error"], r["domain_error"], r["retryable"]) for r in records.classify_errors(spark.createDataFrame(rows, "i int, error_code string, http_status int, socket_error string")).collect()}
    assert got == {
        1: ("RateLimitExceeded", "RateLimitExceeded", True), 2: ("Transport::Network", "ConnectionFailed", True), 3: ("ServerOverloaded", "ServerOverloaded", False), 4: ("Stream", "Stream", True), 5: ("Retryable", "Stream", True),
        6: ("Retryable", "Stream", True), 7: (None, None, None), 8: (None, None, None), 9: ("UsageNotIncluded", "UsageNotIncluded", False),
    }


def test_what_follows_an_end_is_flagged(spark):
    def plan(*retryable, budget=2):
        rows = [(1, i, r, None, False) for i, r in enumerate(retryable)]
        out = records.retry_plan(spark.createDataFrame(rows, "q int, i int, retryable boolean, retry_delay_ms int, connection_failed boolean"), "q", ["i"], budget)
        return [(r["transport"], r["action"], r["delay_ms"], r["code"]) for r in out.orderBy("i").collect()]

    after = (None, None, None, "ATTEMPT_AFTER_END")
    assert plan(True, None, True, None) == [("primary", "retry", 200, None), ("primary", "done", None, None), after, after]
    assert plan(False, True) == [("primary", "stop", None, None), after]
    assert plan(*[True] * 7) == [("primary", "retry", 200, None), ("primary", "retry", 400, None), ("primary", "fallback", None, None), ("fallback", "retry", 200, None), ("fallback", "retry", 400, None), ("fallback", "stop", None, "RETRIES_EXHAUSTED"), after]


def bfs(edges, starts):
    out = {}
    for s in starts:
        hops, now = {s: 0}, [s]
        while now:
            now = [b for a in now for x, b in edges if x == a and b not in hops and not hops.update({b: hops[a] + 1})]
        out |= {(s, n): h for n, h in hops.items()}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_closure_equals_breadth_first_search(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(30), r.randrange(30)) for _ in range(r.choice([15, 28, 45]))}
    edges |= {(100 + i, 101 + i) for i in range(9)} | {(109, 3), (4, 100), (200, 201), (201, 202), (202, 200)} | {(300 + i, 300 + (i + 1) % 5) for i in range(5)} | {(105, 400)} if seed % 2 else {(100 + i, 101 + i) for i in range(9)} | {(109, 100), (5, 5)}
    starts = [0, 3, 4, 103, 201, 303, 999]
    got = {(x["start"], x["node"]): x["hops"] for x in lineage.closure(spark.createDataFrame(list(edges), "from_id int, to_id int"), spark.createDataFrame([(s,) for s in starts], "id int")).collect()}
    assert got == bfs([e for e in edges if e[0] != e[1]], starts)


def test_pairs_of_a_closure_are_not_written_again_each_round(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(lineage, "scratch", lambda s, name, n=iter(range(1000)): f"{tmp_path}/{name}-{next(n)}")
    # ways of different lengths meet, a run of single ways hangs below, and a ring below that
    edges = {(i, i // k) for k in (2, 3) for i in range(k, 200) if i % 7 != k} | {(-i, -i - 1) for i in range(6)} | {(-6, -8), (-8, -9), (-9, -6), (-9, -20)} | {(1, 0)}
    starts = [*range(200), -3, -8, -20, 999]
    got = {(x["start"], x["node"]): x["hops"] for x in lineage.closure(spark.createDataFrame(list(edges), "from_id int, to_id int"), spark.createDataFrame([(s,) for s in starts], "id int")).collect()}
    assert got == bfs(edges, starts)
    files = [pq.ParquetFile(f) for f in tmp_path.rglob("*.parquet")]
    rows = sum(f.metadata.num_rows for f in files if "start" in f.schema_arrow.names and "hops" in f.schema_arrow.names)
    assert rows < 4 * len(got), (rows, len(got))


def test_long_chains_take_few_rounds(spark, monkeypatch):
    tables = []
    real = lineage.written
    monkeypatch.setattr(lineage, "written", lambda df: tables.append(1) or real(df))
    edges = spark.range(3000).select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"))
    got = lineage.closure(edges, spark.createDataFrame([(0,), (2990,)], "id long"))
    rows = {(x["start"], x["node"]): x["hops"] for x in got.collect()}
    assert rows == {(0, i): i for i in range(3001)} | {(2990, i): i - 2990 for i in range(2990, 3001)} and len(tables) < 30


def test_kinds_of_edges_are_not_merged(spark):
    edges = spark.createDataFrame([("a", "b", "fork"), ("b", "c", "parent"), ("b", "d", "fork"), ("c", "e", "fork"), ("a", "c", "parent")], "from_id string, to_id string, label string")
    kinds = spark.createDataFrame([(k, k, k) for k in ("fork", "parent")], "state string, label string, to_state string")
    starts = spark.createDataFrame([("a", "fork"), ("a", "parent")], "id string, state string")
    got = sorted((r["state"], r["node"], r["hops"]) for r in lineage.labelled_closure(edges, starts, kinds).collect())
    assert got == [("fork", "a", 0), ("fork", "b", 1), ("fork", "d", 2), ("parent", "a", 0), ("parent", "c", 1)]
    # any number of forks, then one parent
    moves = spark.createDataFrame([("f", "fork", "f"), ("f", "parent", "p")], "state string, label string, to_state string")
    got = sorted((r["state"], r["node"], r["hops"]) for r in lineage.labelled_closure(edges, spark.createDataFrame([("a", "f")], "id string, state string"), moves).collect())
    assert got == [("f", "a", 0), ("f", "b", 1), ("f", "d", 2), ("p", "c", 1)]


def test_changes_of_odd_texts(spark):
    pairs = [(1, None, "{}"), (2, "{", '{"a":1}'), (3, "{", "["), (4, '{"a/b":{"~":1}}', '{"a/b":{"~":2}}'), (5, '{"a":1}', '{"a":1.0}'), (6, "[1]", "[1]"), (7, '{"a":null}', "{}"), (8, "[" * 60_000, "1")]
    got = sorted(map(tuple, canonical.json_changes(spark.createDataFrame(pairs, "k int, b string, a string"), "k", "b", "a").collect()))
    assert got == [(1, "", None, "{}"), (2, "", None, '{"a":1}'), (4, "/a~1b/~0", "1", "2"), (5, "/a", "1", "1.0"), (7, "/a", "null", None), (8, "", None, "1")]


def test_json_rows_go_out_in_short_batches(spark, monkeypatch):
    """A worker never holds the rows of a whole batch of texts: they leave in pieces of at most ROWS, and none is lost."""
    sizes = []
    monkeypatch.setattr(canonical, "ROWS", 50)
    frame = spark.createDataFrame([(i,) for i in range(200)], "k long")

    class Rows:
        columns = ["k"]

        def mapInArrow(self, run, schema):
            sizes.extend(b.num_rows for b in run(iter(frame.toArrow().to_batches())))

    canonical.each_text(Rows(), lambda k: [(k, str(i)) for i in range(7)], "k long, name string")
    assert sum(sizes) == 1400 and max(sizes) <= 50
    docs = spark.range(300).select(F.col("id").alias("k"), F.to_json(F.create_map(F.lit("a"), F.col("id"))).alias("t"))
    assert canonical.walk_json(docs, "k", "t").count() == 600


def test_file_digests_read_no_content_column(spark, tmp_path):
    """The manifest by blocks equals the one of whole contents, also for an empty file and names with spaces, and Spark's rows hold no content."""
    from contractlake.sources import records as sources

    for name, content in (("a.bin", b"x" * 100_001), ("empty.bin", b""), ("with space%.bin", bytes(range(256)))):
        (tmp_path / name).write_bytes(content)
    files = sources.read_source_files(spark, str(tmp_path))
    blocks = sources.file_digests(files, block=1000)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, sources.file_manifest(files).collect()))
    assert "content" not in blocks._jdf.queryExecution().executedPlan().toString()


def test_location_index_pieces_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(rollups, "PIECE", 10)
    anchors = spark.range(200).selectExpr("id % 2 report", "concat('p', id % 20) path", "cast(if(id % 3 = 0, null, id % 5) as int) line", "'s' symbol").repartition(1)
    files = spark.range(20).selectExpr("id % 2 report", "concat('p', id) path").filter("path != 'p3'").repartition(1)
    out = rollups.location_index(anchors, files.unionByName(files))
    # made distinct and joined in pieces of PIECE rows, however few bytes they are
    assert out.rdd.getNumPartitions() == 1 + (200 + 2 * 19) // 10
    got = [(r["report"], r["path"], r["line"], r["state"]) for r in out.collect()]
    want = {(i % 2, f"p{i % 20}", None if i % 3 == 0 else i % 5, "referenced_but_not_loaded" if i % 20 == 3 else "loaded") for i in range(200)}
    assert len(got) == len(want) and set(got) == want


def test_texts_of_one_file_are_many_tasks(spark, tmp_path):
    spark.range(100).selectExpr("id", """'{"type":"object","properties":{"a":true}}' t""").coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert docs.rdd.getNumPartitions() == 1
    for rows, each in ((canonical.schema_paths(docs, "id", "t"), 2), (canonical.walk_json(docs, "id", "t"), 4)):
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
        assert rows.count() == each * 100 and rows.select("id").distinct().count() == 100


def test_key_collisions_are_found_where_texts_are_read(spark, monkeypatch):
    """No name but those that collide becomes a row, and none is lost: signs whose normal form is ASCII, nested objects, odd names."""
    texts = [
        '{"caf\\u00e9":1,"cafe\\u0301":2,"K":{"\\u00e9/~":{},"e\\u0301/~":[]},"\\u212a":[[{"\\u212b":1,"A\\u030a":1,"\\u00c5":1}]]}',
        '{"K":1,"k":1,"\\u00e9":1,"l":["\\u00e9","e\\u0301"]}', '{"\\u00e9":1,"e\\u0301":1,"\\ud800":1}', '{"\\u00e9":1,"\\u00e9":1}', "[", None, '{"":{"\\u00e9\\n":1,"e\\u0301\\n":1}}',
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    want = [(0, "", "K", 2), (0, "", "caf\u00e9", 2), (0, "/K", "\u00e9/~", 2), (0, "/\u212a/0/0", "\u00c5", 3), (6, "/", "\u00e9\n", 2)]
    with monkeypatch.context() as m:
        m.setattr(coverage, "walk_json", lambda *a: pytest.fail("all names became rows"))
        assert sorted(map(tuple, coverage.key_collisions(docs, "k", "t").collect())) == want
    # texts of one key, null too, are one document
    more = docs.unionByName(spark.createDataFrame([(1, '{"\\u212a":1,"k":2}'), (1, '{"e\\u0301":1}'), (None, '{"\\u00e9":1}'), (None, '{"e\\u0301":1}'), (7, '{"\\u00e9":1}')], docs.schema))
    got = coverage.key_collisions(more, "k", "t")
    assert got.columns == ["k", "object", "normal", "spellings"]
    assert sorted(map(tuple, got.filter("k is not null").collect())) == sorted([*want, (1, "", "K", 2), (1, "", "\u00e9", 2)])
    assert list(map(tuple, got.filter("k is null").collect())) == [(None, "", "\u00e9", 2)]


def test_key_collision_texts_are_made_once(spark):
    from contractlake.jobs import queries as core

    plan = core.queries()["j2_key_collisions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_schema_conformance_moves_errors_alone(spark, monkeypatch):
    """Rules are settled where the record is walked: no node is written or joined with others, and only those at rules' pointers become rows."""
    monkeypatch.setattr(lineage, "written", lambda df: pytest.fail("nodes were written"))
    texts = ['{"a~b":{"x":1},"l":[1,"y"],"other":{"deep":{"deep":1}}}', '{"a~b":{},"l":7}', "[", '{"a~b":5,"l":[]}']
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rules = [("/a~0b/x", "required", None), ("/l", "closed", "0"), ("/l/1", "type", "integer"), ("", "required", None), ("/odd", "required", None)]
    out = coverage.schema_conformance(docs, spark.createDataFrame(rules, "pointer string, rule string, arg string"), "k", "t")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    want = [(0, "/l/1", "closed"), (0, "/l/1", "type"), (0, "/odd", "required"), (1, "/a~0b/x", "required"), (1, "/odd", "required"), (2, "", "parse"), (3, "/odd", "required")]
    assert sorted(map(tuple, out.collect())) == want
    nodes = canonical.walk_places(docs, "k", "t", frozenset({"", "/l"})).collect()
    assert sorted((r["k"], r["pointer"]) for r in nodes) == [(0, ""), (0, "/l"), (1, ""), (1, "/l"), (2, ""), (3, ""), (3, "/l")]
