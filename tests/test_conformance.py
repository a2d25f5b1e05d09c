"""Schema conformance against a plain recursive evaluation, and its golden cases."""

from __future__ import annotations

import json
import random
import re

import pytest

from pyspark.sql import functions as F

from contractlake.operators import conformance as C


def kind_is(v, t):
    if t in ("number", "integer"):
        return isinstance(v, (int, float)) and not isinstance(v, bool) and (t == "number" or v == int(v))
    return {"null": v is None, "boolean": isinstance(v, bool), "string": isinstance(v, str), "array": isinstance(v, list), "object": isinstance(v, dict)}[t]


def equal(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    return type(a) is type(b) and a == b or kind_is(a, "number") and kind_is(b, "number") and a == b


def brute(s, v, root, at="", depth=0):
    """Failures (pointer, keyword) of a value, straight from the rules of the schema language."""
    if s is True or depth > 60:
        return set()
    if s is False:
        return {(at, "false")}
    bad, go = set(), lambda sub, value, where: brute(sub, value, root, where, depth + 1)
    number, text, lst, obj = kind_is(v, "number"), isinstance(v, str), isinstance(v, list), isinstance(v, dict)
    for w, a in s.items():
        ok = True
        if w == "type":
            ok = any(kind_is(v, t) for t in ([a] if isinstance(a, str) else a))
        elif w in ("const", "enum"):
            ok = any(equal(v, x) for x in ([a] if w == "const" else a))
        elif w == "pattern":
            ok = not text or re.search(a, v)
        elif w in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
            ok = not number or {"minimum": lambda: v >= a, "maximum": lambda: v <= a, "exclusiveMinimum": lambda: v > a, "exclusiveMaximum": lambda: v < a}[w]()
        elif w[:3] in ("min", "max") and w[3:] in ("Length", "Items", "Properties"):
            mine = {"Length": text, "Items": lst, "Properties": obj}[w[3:]]
            ok = not mine or (len(v) >= a if w[:3] == "min" else len(v) <= a)
        elif w == "required":
            ok = not obj or set(a) <= set(v)
        elif w == "uniqueItems":
            ok = not (a and lst) or not any(equal(v[i], v[j]) for i in range(len(v)) for j in range(i))
        elif w == "properties" and obj:
            for k in a.keys() & v.keys():
                bad |= go(a[k], v[k], f"{at}/{k}")
        elif w == "additionalProperties" and obj:
            for k in v.keys() - s.get("properties", {}).keys():
                bad |= go(a, v[k], f"{at}/{k}")
        elif w == "propertyNames" and obj:
            for k in v:
                bad |= {(at, x) for _, x in go(a, k, at)}
        elif w == "items" and lst:
            for i, x in enumerate(v):
                bad |= go(a, x, f"{at}/{i}")
        elif w == "contains" and lst:
            n = sum(not go(a, x, at) for x in v)
            ok = s.get("minContains", 1) <= n <= s.get("maxContains", n)
        elif w == "allOf":
            for x in a:
                bad |= go(x, v, at)
        elif w in ("anyOf", "oneOf"):
            n = sum(not go(x, v, at) for x in a)
            ok = n > 0 if w == "anyOf" else n == 1
        elif w == "not":
            ok = bool(go(a, v, at))
        elif w == "if":
            bad |= go(s.get("else", True) if go(a, v, at) else s.get("then", True), v, at)
        elif w == "$ref":
            bad |= go(root["$defs"][a.rsplit("/", 1)[1]] if a != "#" else root, v, at)
        if not ok:
            bad.add((at, w))
    return bad


VALUES = [None, True, False, 0, 1, -3, 2.5, 1.0, 7, "", "ab", "u12", [], [1, "ab"], [1, 1.0], {}, {"a": 1}, {"b": "ab", "c": None}]


def some_value(r, depth=0):
    if depth > 2 or r.random() < 0.35:
        return r.choice(VALUES)
    if r.random() < 0.4:
        return [some_value(r, depth + 1) for _ in range(r.randrange(4))]
    return {k: some_value(r, depth + 1) for k in r.sample("abcd", r.randrange(5))}


def some_schema(r, depth=0):
    if r.random() < 0.08:
        return r.random() < 0.7
    sub = lambda: some_schema(r, depth + 1)
    leaves = {
        "type": lambda: r.choice(["integer", "number", "string", "object", "array", ["null", "string"], ["object", "number", "array"]]), "const": lambda: r.choice(VALUES), "enum": lambda: r.sample(VALUES, 5),
        "pattern": lambda: r.choice(["^u[0-9]+$", "b"]), "minimum": lambda: r.choice([0, 1.5]), "maximum": lambda: r.choice([1, 2.5]), "exclusiveMinimum": lambda: 1, "exclusiveMaximum": lambda: 7, "maxLength": lambda: 2, "minItems": lambda: 1,
        "maxItems": lambda: 2, "minProperties": lambda: 1, "maxProperties": lambda: 2, "required": lambda: r.sample("abc", 1), "uniqueItems": lambda: True, "$ref": lambda: r.choice(["#/$defs/x", "#/$defs/y"]),
    }
    deep = {
        "properties": lambda: {k: sub() for k in r.sample("abcd", 2)}, "additionalProperties": sub, "items": sub, "contains": sub, "allOf": lambda: [sub(), sub()], "anyOf": lambda: [sub(), sub()],
        "oneOf": lambda: [sub(), sub(), sub()], "not": sub, "if": sub, "propertyNames": sub,
    }
    out = {k: leaves[k]() for k in r.sample(sorted(leaves), r.randrange(3))}
    if depth < 3:
        out |= {k: deep[k]() for k in r.sample(sorted(deep), r.randrange(4))}
        if "if" in out:
            out |= {"then": sub(), "else": sub()}
        if "contains" in out and r.random() < 0.5:
            out |= {"minContains": r.randrange(3)}
    return out


def ref_free(s):
    return {k: v for k, v in s.items() if k != "$ref"} if isinstance(s, dict) else s


def run(spark, schemas, docs, **options):
    s = spark.createDataFrame(schemas, "schema string, text string")
    d = spark.createDataFrame(docs, "doc int, schema string, text string")
    return C.conformance(d, s, "doc", "text", **options)


def test_random_schemas(spark):
    r = random.Random(11)
    schemas, docs, want = {}, [], {}
    for i in range(120):
        s = some_schema(r)
        while not isinstance(s, dict):
            s = some_schema(r)
        # y has no reference beside its members, so nothing refers to itself without a step into the record
        s["$defs"] = {"x": ref_free(some_schema(r, 3)), "y": {"properties": {"a": {"$ref": "#/$defs/y"}}, "items": {"anyOf": [{"$ref": "#/$defs/y"}, {"$ref": "#/$defs/x"}]}, "required": ["b"]}}
        schemas[f"s{i}"] = s
        for _ in range(6):
            v = some_value(r)
            want[len(docs)] = brute(s, v, s)
            docs.append((len(docs), f"s{i}", json.dumps(v)))
    got = {i: set() for i in want}
    for x in run(spark, [(k, json.dumps(v)) for k, v in schemas.items()], docs, most=10**6).collect():
        got[x["doc"]].add((x["pointer"], x["keyword"]))
    wrong = [(docs[i], schemas[docs[i][1]], got[i], want[i]) for i in want if got[i] != want[i]]
    assert not wrong, wrong[:2]
    assert sum(map(len, want.values())) > 500 and sum(not w for w in want.values()) > 50


def failures(spark, schema, *texts, **options):
    out = {i: [] for i in range(len(texts))}
    for r in run(spark, [("s", json.dumps(schema) if not isinstance(schema, str) else schema)], [(i, "s", t) for i, t in enumerate(texts)], **options).orderBy("doc").collect():
        out[r["doc"]].append((r["pointer"], r["keyword"]))
    return [sorted(out[i]) for i in range(len(texts))]


def test_values_are_compared_by_kind_and_exactly(spark):
    assert failures(spark, {"const": 5}, "5", "5.0", "50e-1", '"5"', "true") == [[], [], [], [("", "const")], [("", "const")]]
    assert failures(spark, {"enum": [True, 1, "x"]}, "true", "1.0", '"true"', '"1"', "0") == [[], [], [("", "enum")], [("", "enum")], [("", "enum")]]
    assert failures(spark, {"maximum": 9007199254740992}, "9007199254740993", "9007199254740992", "1e400", "-1e400") == [[("", "maximum")], [], [("", "maximum")], []]
    assert failures(spark, {"minimum": -0.1, "type": "integer"}, "-0.10", "-0.100000000000000000001", "0", "1e2") == [[("", "type")], [("", "minimum"), ("", "type")], [], []]


def test_items_and_map_values_have_rules(spark):
    schema = {"properties": {"l": {"items": {"enum": [1, "a"]}}, "m": {"additionalProperties": {"items": {"type": "string"}}}}}
    assert failures(spark, schema, '{"l": [1, "b", "a", 2], "m": {"p": ["x"], "q/r": ["x", 3]}}') == [[("/l/1", "enum"), ("/l/3", "enum"), ("/m/q~1r/1", "type")]]


def test_recursive_predicates(spark):
    leaf = {"type": "object", "required": ["path"], "properties": {"op": {"enum": ["exists", "equals"]}}}
    node = {"type": "object", "required": ["args"], "properties": {"op": {"enum": ["all", "any"]}, "args": {"type": "array", "minItems": 1, "items": {"$ref": "#"}}}}
    ok = '{"op": "all", "args": [{"op": "exists", "path": "a"}, {"op": "any", "args": [{"op": "equals", "path": "b"}]}]}'
    deep = '{"op": "all", "args": [{"op": "any", "args": [{"op": "any", "args": [{"op": "equals"}]}]}]}'
    assert failures(spark, {"oneOf": [leaf, node]}, ok, deep) == [[], [("", "oneOf")]]


def test_references_between_schemas(spark):
    a = {"$id": "urn:a", "properties": {"inner": {"$ref": "urn:b#/$defs/t"}, "lost": {"$ref": "urn:none"}}}
    b = {"$id": "urn:b", "$defs": {"t": {"$ref": "urn:c"}}}
    c = {"$id": "urn:c", "type": "string"}
    schemas = [(x["$id"][-1], json.dumps(x)) for x in (a, b, c)]
    docs = [(1, "a", '{"inner": 1}'), (2, "a", '{"inner": "x", "lost": 1}'), (3, "none", "{}"), (4, "a", "{"), (5, "a", None), (6, "a", "[" * 70_000), (7, "a", '{"\\ud800": 1}'), (8, "a", '{"a": 1, "a": 2}')]
    got = sorted((r["doc"], r["pointer"], r["keyword"]) for r in run(spark, schemas, docs).collect())
    assert got == [(1, "/inner", "type"), (2, "/lost", "$ref"), (3, "", "schema"), (4, "", "parse"), (6, "", "parse"), (8, "", "parse")]


def test_broken_schemas_and_no_records(spark):
    got = run(spark, [("a", "{"), ("b", None), ("c", '{"pattern": "("}'), ("d", "3")], [(1, "a", "{}"), (2, "b", "{}"), (3, "c", '"x"'), (4, "d", "1")]).collect()
    assert sorted((r["doc"], r["keyword"], r["location"]) for r in got) == [(1, "schema", "schema refused"), (2, "schema", "schema refused")]
    assert run(spark, [("a", "{}")], []).count() == 0
    assert run(spark, [], [(1, "a", "1")]).count() == 1


def test_first_failures_by_path(spark):
    text = json.dumps(list(range(30)))
    assert failures(spark, {"items": {"maximum": -1}}, text) == [sorted((f"/{i}", "maximum") for i in range(20))]


@pytest.mark.parametrize("most_bytes", [0, 1 << 20])
def test_schemas_beyond_the_broadcast(spark, most_bytes):
    s = spark.createDataFrame([("s", '{"type": "string"}')], "schema string, text string")
    d = spark.createDataFrame([(1, "s", "1"), (2, "t", "1"), (3, "s", '"x"')], "doc int, schema string, text string")
    nodes = C.place_nodes(d, C.bundles(s), "doc", "text", most_bytes).collect()
    assert sorted((r["doc"], r["kind"], r["error"]) for r in nodes) == [(1, "integer", None), (2, None, "schema unknown"), (3, "string", None)]


def test_records_of_one_file_are_many_tasks(spark, tmp_path):
    spark.range(100).selectExpr("id doc", "'s' schema", "to_json(struct(id)) t").coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    schemas = spark.createDataFrame([("s", '{"type":"object","properties":{"id":{"maximum":50}}}')], "schema string, text string")
    nodes = C.place_nodes(docs, C.bundles(schemas), "doc", "t")
    assert docs.rdd.getNumPartitions() == 1
    assert nodes.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
    assert sorted(r["doc"] for r in C.conformance(docs, schemas, "doc", "t").collect()) == list(range(51, 100))
