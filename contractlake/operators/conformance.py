"""Conformance of records to JSON Schemas that are themselves rows of a table.

A schema is compiled to places (a place is where a schema stands, numbered) and to rules at places. Walking a
record, the places of a node follow from those of its parent by the member's name or index, references and
combined schemas included, so recursive schemas need no expansion and every record is walked once. A node
and a place with rules make a row; the rules are joined to it and checked by column expressions.

What stands under anyOf, oneOf, not, contains or if fails in a branch only. Such rows carry the way of
branches that leads to them, and are resolved from the innermost branch outward by one grouping a level.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contractlake.functions.canonical import REFUSALS, dealt, encodable, encodable_error, parse

from .lineage import closure, written

# fixed values: keywords of the schema language by what they need, and those that assert something but are not evaluated here
COUNTED = {"maxLength": "string", "minLength": "string", "maxItems": "array", "minItems": "array", "maxProperties": "object", "minProperties": "object"}
ORDERED = ("maximum", "minimum", "exclusiveMaximum", "exclusiveMinimum")
COMBINED = ("anyOf", "oneOf")
NOT_EVALUATED = ("multipleOf", "dependentRequired", "dependentSchemas", "unevaluatedItems", "unevaluatedProperties", "$dynamicRef", "contentSchema")

RULES = "schema string, rule int, place int, location string, keyword string, text string, names array<string>, number long, most long"
BRANCH = "struct<rule:int,branch:int,at:string>"
NODES = f"schema string, pointer string, path array<string>, place int, way array<{BRANCH}>, kind string, value string, size int, text string, names array<string>, repeated boolean, error string"


def number(text: str) -> Any:
    """A JSON number with a fraction or exponent, exactly."""
    try:
        value = Decimal(text)
    except InvalidOperation:
        value = None
    if value is None or not value.is_finite() or abs(value.adjusted()) > 10**8:
        raise ValueError("number out of range")
    return value


def exact(value: Any) -> str:
    """Canonical JSON in which equal values are equal texts: 1, 1.0 and 10e-1 are one number, true and 1 are not."""
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, (int, Decimal)):
        sign, digits, exponent = Decimal(value).as_tuple()
        body = "".join(map(str, digits)).lstrip("0")
        short = body.rstrip("0")
        return f"{'-' if sign else ''}{short}E{exponent + len(body) - len(short)}" if short else "0E0"
    if isinstance(value, list):
        return "[" + ",".join(map(exact, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{exact(v)}" for k, v in sorted(value.items())) + "}"
    return json.dumps(value)


def rank(value: Any) -> str:
    """A text that sorts as the number does: sign, magnitude and digits, complemented where it is negative."""
    d = Decimal(value)
    if not d:
        return "1"
    text = f"{d.adjusted() + 5 * 10**8:010d}" + "".join(map(str, d.as_tuple().digits)).rstrip("0")
    return f"2{text}" if d > 0 else "0" + "".join(str(9 - int(c)) for c in text) + "~"


def kind(value: Any) -> str:
    """integer is any number without a fraction."""
    if value is None or isinstance(value, bool):
        return "null" if value is None else "boolean"
    if isinstance(value, Decimal):
        return "integer" if value == value.to_integral_value() else "number"
    return {int: "integer", str: "string", list: "array", dict: "object"}[type(value)]


@dataclass
class Place:
    members: dict[str, int] = field(default_factory=dict)
    patterns: list[tuple[re.Pattern, int]] = field(default_factory=list)
    others: int | None = None
    prefix: list[int] = field(default_factory=list)
    items: int | None = None
    names: int | None = None
    contains: tuple[int, int] | None = None
    same: list[int] = field(default_factory=list)
    branches: list[tuple[int, int, int]] = field(default_factory=list)
    ruled: bool = False
    whole: bool = False
    unique: bool = False


class Compiled:
    """Places and rules of a schema; others are the documents that it may refer to, by their $id."""

    def __init__(self, root: Any, others: dict[str, Any]):
        self.documents = {"": root, **others}
        if isinstance(root, dict) and isinstance(root.get("$id"), str):
            self.documents[root["$id"]] = root
        self.places: list[Place] = []
        self.waiting: list[tuple[str, str]] = []
        self.done = 0
        self.rules: list[tuple] = []
        self.numbers: dict[tuple[str, str], int] = {}
        self.root = self.at("", "")
        while len(self.waiting) > self.done:
            self.compile(self.done, *self.waiting[self.done])
            self.done += 1

    def at(self, document: str, pointer: str) -> int:
        key = (document, pointer)
        if key not in self.numbers:
            self.numbers[key] = len(self.places)
            self.places.append(Place())
            self.waiting.append(key)
        return self.numbers[key]

    def resolve(self, document: str, reference: str) -> tuple[str, str] | None:
        name, _, fragment = reference.partition("#")
        name = name or document
        if name not in self.documents or fragment and not fragment.startswith("/") or self.node(name, fragment) is None:
            return None
        return name, fragment

    def node(self, document: str, pointer: str) -> Any:
        node = self.documents[document]
        for part in pointer.split("/")[1:]:
            part = part.replace("~1", "/").replace("~0", "~")
            if isinstance(node, list) and part.isdigit() and int(part) < len(node):
                node = node[int(part)]
            else:
                node = node.get(part) if isinstance(node, dict) else None
        return node

    def rule(self, place: int, where: str, keyword: str, text: str | None = None, names: list[str] | None = None, count: int | None = None, most: int | None = None) -> int:
        self.places[place].ruled = True
        self.rules.append((len(self.rules), place, where, keyword, text, names, count, most))
        return len(self.rules) - 1

    def compile(self, place: int, document: str, pointer: str) -> None:
        node, here, p = self.node(document, pointer), f"{document}#{pointer}", self.places[place]
        if node is False:
            self.rule(place, here, "false")
        if not isinstance(node, dict):
            return
        below = lambda *parts: self.at(document, pointer + "".join("/" + str(x).replace("~", "~0").replace("/", "~1") for x in parts))
        is_schema = lambda x: isinstance(x, (dict, bool))
        counted = lambda x: int(x) if kind(x) == "integer" and abs(x) < 2**62 else None
        for word, arg in node.items():
            where = f"{here}/{word}"
            if word == "type" and isinstance(arg, (str, list)):
                kinds = [arg] if isinstance(arg, str) else [x for x in arg if isinstance(x, str)]
                self.rule(place, where, word, names=sorted({*kinds, *(["integer"] if "number" in kinds else [])}))
            elif word == "const":
                p.whole = True
                self.rule(place, where, word, names=[exact(arg)])
            elif word == "enum" and isinstance(arg, list):
                p.whole = True
                self.rule(place, where, word, names=sorted({exact(x) for x in arg}))
            elif word == "pattern" and isinstance(arg, str):
                self.pattern(place, where, word, arg)
            elif word in ORDERED and kind(arg) in ("integer", "number"):
                self.rule(place, where, word, text=rank(arg))
            elif word in COUNTED and counted(arg) is not None:
                self.rule(place, where, word, count=counted(arg))
            elif word == "required" and isinstance(arg, list):
                self.rule(place, where, word, names=sorted({x for x in arg if isinstance(x, str)}))
            elif word == "uniqueItems" and arg is True:
                p.unique = True
                self.rule(place, where, word)
            elif word == "properties" and isinstance(arg, dict):
                p.members = {k: below(word, k) for k, v in arg.items() if is_schema(v)}
            elif word == "patternProperties" and isinstance(arg, dict):
                for k, v in arg.items():
                    try:
                        p.patterns.append((re.compile(k), below(word, k)))
                    except re.error:
                        self.rule(place, where, "unsupported", text=word)
            elif word == "additionalProperties" and is_schema(arg):
                p.others = below(word)
            elif word == "propertyNames" and is_schema(arg):
                p.names = below(word)
            elif word == "prefixItems" and isinstance(arg, list):
                p.prefix = [below(word, i) for i in range(len(arg))]
            elif word == "items" and is_schema(arg):
                p.items = below(word)
            elif word == "contains" and is_schema(arg):
                least, most = counted(node.get("minContains", 1)), counted(node.get("maxContains", 2**62 - 1))
                p.contains = (self.rule(place, where, word, count=1 if least is None else least, most=most), below(word))
            elif word == "allOf" and isinstance(arg, list):
                p.same += [below(word, i) for i, x in enumerate(arg) if is_schema(x)]
            elif word in COMBINED and isinstance(arg, list):
                r = self.rule(place, where, word, count=len(arg))
                p.branches += [(r, i, below(word, i)) for i, x in enumerate(arg) if is_schema(x)]
            elif word == "not" and is_schema(arg):
                p.branches.append((self.rule(place, where, word, count=1), 0, below(word)))
            elif word == "if" and is_schema(arg):
                r = self.rule(place, where, word)
                p.branches += [(r, i, below(w)) for i, w in enumerate(("if", "then", "else")) if is_schema(node.get(w))]
            elif word == "$ref" and isinstance(arg, str):
                found = self.resolve(document, arg)
                if found is None:
                    self.rule(place, where, "$ref", text=arg)
                else:
                    p.same.append(self.at(*found))
            elif word in NOT_EVALUATED:
                self.rule(place, where, "unsupported", text=word)

    def pattern(self, place: int, where: str, word: str, arg: str) -> None:
        try:
            re.compile(arg)
            sound = "(?P" not in arg
        except re.error:
            sound = False
        self.rule(place, where, word if sound else "unsupported", text=arg if sound else word)

    def spread(self, starts: list[tuple[int, tuple]], pointer: str) -> Iterator[tuple[int, tuple]]:
        """The places of a node and the way of branches to each, from those that its parent gave it."""
        stack = [(place, way, ()) for place, way in reversed(starts)]
        seen = set()
        while stack:
            place, way, chain = stack.pop()
            # a schema that leads to itself without a step into the record stops
            if (place, way) in seen or place in chain:
                continue
            seen.add((place, way))
            yield place, way
            p = self.places[place]
            chain = (*chain, place)
            stack += [(s, way, chain) for s in p.same]
            stack += [(s, (*way, (r, b, pointer)), chain) for r, b, s in p.branches]


def _step(c: Compiled, place: int, name: str) -> list[int]:
    p = c.places[place]
    found = [p.members[name]] if name in p.members else []
    found += [s for pattern, s in p.patterns if pattern.search(name)]
    return found or ([] if p.others is None else [p.others])


def _walk(c: Compiled, root: Any) -> Iterator[tuple]:
    """NODES of a record, without schema and error."""
    stack = [(root, "", (), [(c.root, ())])]
    while stack:
        value, pointer, path, starts = stack.pop()
        down: dict[Any, list[tuple[int, tuple]]] = {}
        k = kind(value)
        for place, way in c.spread(starts, pointer):
            p = c.places[place]
            if p.ruled:
                text = exact(value) if p.whole or k not in ("array", "object") else None
                order = rank(value) if k in ("integer", "number") else value if k == "string" else None
                names = list(value) if k == "object" else None
                size = len(value) if k in ("string", "array", "object") else None
                repeated = p.unique and k == "array" and len({exact(x) for x in value}) < len(value)
                yield pointer, list(path), place, way, k, order, size, text, names, repeated
            if k == "object":
                for name in value:
                    if p.names is not None:
                        # a member's name, as a value of its own at the object
                        for at, on in c.spread([(p.names, way)], pointer):
                            if c.places[at].ruled:
                                yield pointer, list(path), at, on, "string", name, len(name), exact(name), None, False
                    for s in _step(c, place, name):
                        down.setdefault(name, []).append((s, way))
            if k == "array":
                for i in range(len(value)):
                    s = p.prefix[i] if i < len(p.prefix) else p.items
                    if s is not None:
                        down.setdefault(i, []).append((s, way))
                    if p.contains is not None:
                        down.setdefault(i, []).append((p.contains[1], (*way, (p.contains[0], i, pointer))))
        for name, starts_below in down.items():
            part = str(name).replace("~", "~0").replace("/", "~1")
            stack.append((value[name], f"{pointer}/{part}", (*path, f"{name:010d}" if isinstance(name, int) else name), starts_below))


@lru_cache(maxsize=256)
def _compiled(bundle: str) -> Compiled | str:
    """The bundle compiled, or what it is refused for."""
    try:
        both = parse(bundle, number)
        return Compiled(parse(both["root"], number), {k: parse(v, number) for k, v in both["others"].items()})
    except REFUSALS as e:
        return encodable_error(e)


def bundles(schemas: DataFrame) -> DataFrame:
    """schemas: schema, text. schema, bundle: its text and those of all schemas that it refers to by their $id, over any number of references."""

    def references(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for schema, text in zip(batch["schema"], batch["text"], strict=True):
                try:
                    stack = [parse(text, number)]
                except REFUSALS:
                    continue
                while stack:
                    node = stack.pop()
                    if isinstance(node, dict) and isinstance(node.get("$ref"), str) and node["$ref"].partition("#")[0]:
                        rows.append((schema, node["$ref"].partition("#")[0].encode("utf-8", "replace").decode()))
                    stack += node.values() if isinstance(node, dict) else node if isinstance(node, list) else []
            yield pd.DataFrame(rows, columns=["from_id", "id"]).drop_duplicates()

    known = schemas.select("schema", "text", F.get_json_object("text", "$['$id']").alias("id"))
    links = known.select("schema", "text").filter("text is not null").mapInPandas(references, "from_id string, id string")
    owners = known.filter("id is not null").groupBy("id").agg(F.min("schema").alias("to_id"))
    edges = links.join(owners, "id").select("from_id", "to_id")
    reached = closure(edges, known.select(F.col("schema").alias("id")))
    named = known.select(F.col("schema").alias("node"), "id", F.col("text").alias("other"))
    others = reached.filter("hops > 0").join(named, "node").groupBy(F.col("start").alias("schema")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("id", "other")))).alias("others"))
    empty = F.create_map().cast("map<string,string>")
    return known.join(others, "schema", "left").select("schema", F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("root"), F.coalesce("others", empty).alias("others"))).alias("bundle"))


def compile_rules(bundled: DataFrame) -> DataFrame:
    """schema, rule, place, location (document#pointer of the keyword), keyword, text, names, number, most: the rules of bundled schemas. A schema that is no JSON has the rule -1, keyword `schema`, and why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for schema, bundle in zip(batch["schema"], batch["bundle"], strict=True):
                c = _compiled(bundle)
                rows += [(schema, -1, -1, "#", "schema", c, None, None, None)] if isinstance(c, str) else [(schema, *r) for r in c.rules]
            out = pd.DataFrame(rows, columns=["schema", "rule", "place", "location", "keyword", "text", "names", "number", "most"])
            yield out.astype({"number": "Int64", "most": "Int64"})

    return bundled.mapInPandas(run, RULES)


def place_nodes(docs: DataFrame, bundled: DataFrame, key: str, text: str, most_bytes: int = 32 << 20) -> DataFrame:
    """docs: key, schema, text. A row for each node of a record and each place with rules that it stands at: key and NODES.

    Bundles of together up to most_bytes are broadcast; beyond, each record is joined with its own.
    """
    kind_of = docs.schema[key].dataType.simpleString()
    total = bundled.agg(F.coalesce(F.sum(F.octet_length("bundle")), F.lit(0)).alias("n")).first()["n"]
    rows = docs.select(docs[key].alias("k"), "schema", docs[text].alias("t")).filter("t is not null")
    shared = None
    if total <= most_bytes:
        shared = docs.sparkSession.sparkContext.broadcast({r["schema"]: r["bundle"] for r in bundled.collect()})
        rows = rows.withColumn("bundle", F.lit(None).cast("string"))
    else:
        rows = rows.join(bundled, "schema", "left").select("k", "schema", "t", "bundle")
    columns = ["k", "schema", "pointer", "path", "place", "way", "kind", "value", "size", "text", "names", "repeated", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, schema, t, bundle in zip(batch["k"], batch["schema"], batch["t"], batch["bundle"], strict=True):
                bundle = shared.value.get(schema) if shared else bundle
                failed = lambda e, k=k, schema=schema: (k, schema, "", [], -1, [], None, None, None, None, None, False, e)
                if bundle is None:
                    out.append(failed("schema unknown"))
                    continue
                c = _compiled(bundle)
                if isinstance(c, str):
                    out.append(failed("schema refused"))
                    continue
                try:
                    found = []
                    for pointer, path, place, way, what, value, *rest, names, repeated in _walk(c, parse(t, number)):
                        encodable(pointer + (value or "") + "".join(names or ()))
                        found.append((k, schema, pointer, path, place, [{"rule": r, "branch": b, "at": a} for r, b, a in way], what, value, *rest, names, repeated, None))
                    out += found
                except REFUSALS as e:
                    out.append(failed("number out of range" if str(e) == "number out of range" else encodable_error(e)))
                if len(out) > 2000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    return dealt(rows).mapInPandas(run, f"k {kind_of}, {NODES}").withColumnRenamed("k", key)


def _holds(node_names):
    """Whether a node keeps a rule that looks at the node alone; null for the combining ones."""
    k, v, n, word = F.col("kind"), F.col("value"), F.col("size"), F.col("keyword")
    numeric = k.isin("integer", "number")
    cases = [
        (word == "type", F.array_contains("rule_names", k)),
        (word.isin("const", "enum"), F.array_contains("rule_names", F.col("text"))),
        (word == "pattern", (k != "string") | F.rlike(v, F.col("rule_text"))),
        (word == "maximum", ~numeric | (v <= F.col("rule_text"))),
        (word == "minimum", ~numeric | (v >= F.col("rule_text"))),
        (word == "exclusiveMaximum", ~numeric | (v < F.col("rule_text"))),
        (word == "exclusiveMinimum", ~numeric | (v > F.col("rule_text"))),
        (word == "required", (k != "object") | (F.size(F.array_except("rule_names", node_names)) == 0)),
        (word == "uniqueItems", ~F.col("repeated")),
        (word.isin("false", "$ref"), F.lit(False)),
        (word == "unsupported", F.lit(True)),
    ]
    cases += [(word == w, (k != of) | ((n <= F.col("number")) if w.startswith("max") else (n >= F.col("number")))) for w, of in COUNTED.items()]
    out = F.when(*cases[0])
    for case in cases[1:]:
        out = out.when(*case)
    return out


def conformance(docs: DataFrame, schemas: DataFrame, key: str, text: str, most: int = 20) -> DataFrame:
    """The first `most` failures of each record: key, schema, pointer, keyword, location.

    docs: key, schema (which one holds for the record), text; schemas: schema, text, at most one row
    each. Failures come by their path in the record (indices as numbers) and then by location, the place
    of the keyword in the schema. Values are compared by kind and exactly: 5 and 5.0 are equal, 5 and "5"
    are not, and numbers have as many digits as they are written with. A failing anyOf, oneOf, not or
    contains is one failure; under if, those of then or else are.

    A text that is no strict JSON fails parse, one whose schema is not in the table or no JSON fails
    schema; location then says why. A reference that leads nowhere fails $ref wherever it is reached.
    Keywords that assert something but are not evaluated (NOT_EVALUATED, patterns that don't compile) are
    in compile_rules, keyword `unsupported`. Null texts have no rows.
    """
    bundled = written(bundles(schemas))
    rules = written(compile_rules(bundled)).filter("rule >= 0")
    nodes = written(place_nodes(docs.select(key, "schema", text), bundled, key, text))
    refused = nodes.filter("error is not null").select(key, "schema", "pointer", "path", F.when(F.col("error").startswith("schema "), "schema").otherwise("parse").alias("keyword"), F.col("error").alias("location"))
    r = rules.select("schema", "place", "rule", "keyword", "location", "number", "most", F.col("names").alias("rule_names"), F.col("text").alias("rule_text"))
    # as large as the schemas: Spark broadcasts it while it is under the threshold for that
    at = nodes.filter("error is null").join(r, ["schema", "place"]).withColumn("holds", _holds(F.col("names")))
    way = ["pointer", "path", "rule", "way", "keyword", "location"]
    failed = written(at.filter("holds = false").select(key, "schema", *way))
    combining = at.filter("holds is null").withColumn("branches", F.when(F.col("keyword") == "contains", F.col("size").cast("long")).otherwise(F.col("number")))
    combining = written(combining.filter("keyword != 'contains' or kind = 'array'").select(key, "schema", *way, "branches", "number", "most"))
    deepest = failed.select(F.size("way").alias("d")).unionByName(combining.select((F.size("way") + 1).alias("d"))).agg(F.max("d").alias("d")).first()["d"] or 0
    for depth in range(deepest, 0, -1):
        last = F.element_at("way", -1)
        deep = failed.filter(F.size("way") == depth).withColumn("g", last["rule"]).withColumn("b", last["branch"]).withColumn("a", last["at"]).withColumn("way", F.slice("way", 1, depth - 1))
        on = [key, "schema", "g", "a", "way"]
        by = deep.select(*on, "b").distinct().groupBy(*on).agg(F.count("*").alias("lost"), F.bool_or(F.col("b") == 0).alias("if_lost"))
        level = combining.filter(F.size("way") == depth - 1).withColumnRenamed("rule", "g").withColumnRenamed("pointer", "a")
        verdict = level.join(by, on, "left").withColumn("kept", F.col("branches") - F.coalesce("lost", F.lit(0)))
        word = F.col("keyword")
        wrong = F.when(word == "anyOf", F.col("kept") == 0).when(word == "oneOf", F.col("kept") != 1).when(word == "not", F.col("kept") > 0).when(word == "contains", (F.col("kept") < F.col("number")) | (F.col("kept") > F.col("most"))).otherwise(F.lit(False))
        groups = verdict.filter(wrong).select(key, "schema", F.col("a").alias("pointer"), "path", F.col("g").alias("rule"), "way", "keyword", "location")
        choosing = rules.filter("keyword = 'if'").select("schema", F.col("rule").alias("g"))
        taken = deep.join(choosing, ["schema", "g"]).join(by.select(*on, "if_lost"), on).filter(F.col("b") == F.when(F.col("if_lost"), 2).otherwise(1)).select(key, "schema", *way)
        failed = written(failed.filter(F.size("way") < depth).unionByName(groups).unionByName(taken))
    top = failed.select(key, "schema", "pointer", "path", "keyword", "location").unionByName(refused).distinct()
    n = F.row_number().over(Window.partitionBy(key, "schema").orderBy("path", "location", "keyword"))
    return top.withColumn("n", n).filter(F.col("n") <= most).select(key, "schema", "pointer", "keyword", "location")
