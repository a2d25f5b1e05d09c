"""Coverage of surfaces, features and events; text extraction by pattern; schema conformance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlake.functions.canonical import colliding_names, nfc, walk_json, walk_places

# fixed values: how a string constant is declared, and where header names are written and read, literally or by a constant
CONST = r'(?ms)^\s*(?:pub(?:\([^)]*\))?\s+)?const\s+([A-Z][A-Z0-9_]*)\s*:\s*&str\s*=\s*"([^"]+)"\s*;'
BEFORE_CONST = r"^\s*(?:pub(?:\([^)]*\))?\s+)?"
WRITTEN = (
    r'insert_header\([^,]+,\s*"([A-Za-z0-9_-]+)"',
    r'\.(?:header)\(\s*"([A-Za-z0-9_-]+)"',
    r'\b(?:headers|extra_headers|default_headers|provider_headers)\.insert\(\s*"([A-Za-z0-9_-]+)"',
)
WRITTEN_BY_NAME = (
    r"insert_header\([^,]+,\s*(?:http::header::)?([A-Z][A-Z0-9_]*)",
    r"\b(?:headers|extra_headers|default_headers|provider_headers)\.insert\(\s*(?:http::header::)?([A-Z][A-Z0-9_]*)",
    r"HeaderName::from_static\(\s*([A-Z][A-Z0-9_]*)",
)
READ = (
    r'\b(?:headers|response_headers)\.(?:get|contains_key)\(\s*"([A-Za-z0-9_-]+)"',
    r'\b(?:parse_header_str|extract_header|upload_response_header)\([^\n,]+,\s*"([A-Za-z0-9_-]+)"',
    r'\.headers\(\)\.get\(\s*"([A-Za-z0-9_-]+)"',
)
READ_BY_NAME = (
    r"\b(?:headers|response_headers)\.(?:get|contains_key)\(\s*(?:http::header::)?([A-Z][A-Z0-9_]*)",
    r"\b(?:parse_header_str|extract_header)\([^\n,]+,\s*(?:http::header::)?([A-Z][A-Z0-9_]*)",
    r"\.headers\(\)\.get\(\s*(?:http::header::)?([A-Z][A-Z0-9_]*)",
)


def const_definitions(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Every string constant that the files define: keys, name, value, offset (of its `const`, from 1).

    What lies before a definition is what the text splits into there, and the definitions before it.
    """
    whole, names, values = (F.regexp_extract_all(text, F.lit(CONST), F.lit(i)) for i in (0, 1, 2))
    found = files.select(*keys, F.split(text, CONST, -1).alias("between"), whole.alias("whole"), names.alias("names"), values.alias("values"))
    out = found.select(*keys, "between", "whole", F.posexplode(F.arrays_zip("names", "values")).alias("i", "c"))
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))
    before = length(F.slice("between", 1, F.col("i") + 1)) + length(F.slice("whole", 1, F.col("i")))
    lead = F.length(F.regexp_extract(F.get("whole", "i"), BEFORE_CONST, 0))
    return out.select(*keys, F.col("c.names").alias("name"), F.col("c.values").alias("value"), (before + lead + 1).alias("offset"))


def header_candidates(files: DataFrame, constants: DataFrame, keys: list[str], scope: list[str], text: str = "text") -> DataFrame:
    """Header names that the files write or read, literally or by a constant's name: keys, direction, header (lower case), name. Distinct without case.

    scope: those of the keys that a constant must share with the file, such as the snapshot. Inserts
    into maps of other names are no headers. Of a constant defined more than once every value counts.
    """
    t = F.col(text)
    known = constants.select(*scope, F.col("name").alias("constant"), F.col("value").alias("name")).distinct()

    def matches(patterns: tuple[str, ...]) -> Column:
        return F.explode(F.flatten(F.array(*(F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in patterns))))

    def found(direction: str, literal: tuple[str, ...], by_name: tuple[str, ...]) -> DataFrame:
        plain = files.select(*keys, F.lit(direction).alias("direction"), matches(literal).alias("name"))
        named = files.select(*keys, F.lit(direction).alias("direction"), matches(by_name).alias("constant")).join(known, [*scope, "constant"])
        return plain.unionByName(named.select(*keys, "direction", "name"))

    both = found("written", WRITTEN, WRITTEN_BY_NAME).unionByName(found("read", READ, READ_BY_NAME))
    return both.groupBy(*keys, "direction", F.lower("name").alias("header")).agg(F.min("name").alias("name"))


def literals(files: DataFrame, keys: list[str], pattern: str, text: str = "text") -> DataFrame:
    """Per file the sorted distinct matches of a pattern's first group."""
    return files.select(*keys, F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("names"))


# fixed values: module declarations of any visibility, and the clients that a file exports from another
MODULES = r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z_][A-Za-z0-9_]*)\s*;"
CLIENTS = r"(?m)^\s*pub\s+use\s+[A-Za-z_][A-Za-z0-9_]*::([A-Z][A-Za-z0-9_]*Client)\s*;"


def event_kinds(*families: str) -> str:
    """The pattern of quoted event names in families such as response."""
    return rf'"((?:{"|".join(map(re.escape, families))})\.[A-Za-z0-9_.-]+)"'


def frame_mapping(frames: DataFrame, headers: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """frames: keys, frame; headers: keys, header; pairs: frame, header. Rows keys, name, status: paired, ws_only (frame without its header), http_only."""
    known = headers.select(*keys, F.col("header"), F.lit(True).alias("there")).distinct()
    f = frames.join(pairs, "frame", "left").join(known, [*keys, "header"], "left")
    status = F.when(F.col("there"), F.lit("paired")).otherwise(F.lit("ws_only"))
    used = f.filter("there").select(*keys, "header").distinct()
    rest = headers.select(*keys, "header").distinct().join(used, [*keys, "header"], "left_anti")
    return f.select(*keys, F.col("frame").alias("name"), status.alias("status")).unionByName(rest.select(*keys, F.col("header").alias("name"), F.lit("http_only").alias("status")))


def feature_crosswalk(features: DataFrame, paths: DataFrame, policy: DataFrame) -> DataFrame:
    """features: feature; paths: feature (of a configuration path); policy: feature, action. representation: direct, embedded, intentionally_omitted, missing; features that only the paths have are schema_only."""
    p = paths.select("feature", F.lit(True).alias("direct")).distinct()
    j = features.select("feature", F.lit(True).alias("known")).distinct().join(p, "feature", "full_outer").join(policy, "feature", "left")
    kind = F.when(F.col("known").isNull(), "schema_only").when(F.col("direct"), "direct").when(F.col("action") == "embed", "embedded").when(F.col("action") == "omit", "intentionally_omitted").otherwise("missing")
    return j.select("feature", kind.alias("representation"))


def effect_links(effects: DataFrame, paths: DataFrame) -> DataFrame:
    """effects: effect, paths array; paths: path. One row per effect and path that exists, as it is or below profiles.*; found is false where neither does."""
    e = effects.select("effect", F.explode("paths").alias("asked"))
    wide = e.select("effect", "asked", F.explode(F.array(F.col("asked"), F.concat(F.lit("profiles.*."), F.col("asked")))).alias("path"))
    hit = wide.join(paths.select("path").distinct(), "path").select("effect", "asked", "path", F.lit(True).alias("found"))
    lost = e.join(hit, ["effect", "asked"], "left_anti").select("effect", "asked", F.col("asked").alias("path"), F.lit(False).alias("found"))
    return hit.unionByName(lost)


def surface_coverage(modules: DataFrame, expected: DataFrame, present: DataFrame, excluded: DataFrame) -> DataFrame:
    """modules: module; expected: module, surface; present: surface; excluded: module. state: excluded, classified (all its surfaces are there), incomplete, unclassified (no surface expected)."""
    there = expected.join(present.select("surface", F.lit(True).alias("there")).distinct(), "surface", "left").groupBy("module").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("all"))
    j = modules.join(there, "module", "left").join(excluded.select("module", F.lit(True).alias("out")).distinct(), "module", "left")
    state = F.when(F.col("out"), "excluded").when(F.col("all").isNull(), "unclassified").when(F.col("all"), "classified").otherwise("incomplete")
    return j.select("module", state.alias("state"))


def event_catalog(discovered: DataFrame, dispatched: DataFrame) -> DataFrame:
    """discovered: kind; dispatched: kind, disposition. All kinds; those that are only discovered are discovered_not_classified."""
    d = discovered.select("kind", F.lit(True).alias("seen")).distinct()
    return d.join(dispatched, "kind", "full_outer").select("kind", F.coalesce("disposition", F.lit("discovered_not_classified")).alias("disposition"), F.coalesce("seen", F.lit(False)).alias("discovered"))


def profile_evaluation(reports: DataFrame, profiles: DataFrame) -> DataFrame:
    """reports: report, profile, observed array, legacy; profiles: profile, required array, allow_legacy. Per report: what is missing, whether it is complete (nothing missing, and no legacy input unless allowed), and code.

    A report whose profile is null or unknown is not complete: PROFILE_UNKNOWN. Else code is
    REQUIRED_MISSING, then LEGACY_NOT_ALLOWED, or null. Null arrays are empty; a null legacy is no legacy input,
    a null allow_legacy allows none.
    """
    j = reports.join(profiles.withColumn("known", F.lit(True)), "profile", "left")
    none = F.array().cast("array<string>")
    missing = F.array_sort(F.array_except(F.coalesce("required", none), F.coalesce("observed", none)))
    legacy = F.coalesce("legacy", F.lit(False)) & ~F.coalesce("allow_legacy", F.lit(False))
    code = F.when(F.col("known").isNull(), "PROFILE_UNKNOWN").when(F.size(missing) > 0, "REQUIRED_MISSING").when(legacy, "LEGACY_NOT_ALLOWED")
    return j.select("report", missing.alias("missing"), code.isNull().alias("complete"), code.alias("code"))


def key_collisions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Members of one object whose names differ but agree in normal form C: key, object pointer, name, spellings.

    A text is settled where it is read, and what collides alone becomes rows. Texts of one key are one document; only of
    keys with several texts do all names become rows, which meet by object and normal form.
    """
    from .lineage import written

    again = written(docs.groupBy(docs[key].alias("again")).count().filter("count > 1").select("again"))
    if again.isEmpty():
        return colliding_names(docs, key, text)
    known = docs[key].eqNullSafe(again["again"])
    nodes = walk_json(docs.join(again, known, "left_semi"), key, text).filter("name is not null").withColumn("object", F.regexp_replace("pointer", "/[^/]*$", ""))
    met = nodes.groupBy(key, "object", nfc(F.col("name")).alias("normal")).agg(F.count_distinct("name").alias("spellings")).filter("spellings > 1")
    return colliding_names(docs.join(again, known, "left_anti"), key, text).unionByName(met)


# fixed values: the rules of schema_conformance that look at an object's members, and all of them
_OF_OBJECTS = ("required", "max_properties", "members", "not_required", "one_of")
_RULES = (*_OF_OBJECTS, "closed", "type", "const", "enum", "pattern", "min", "max")


def schema_conformance(docs: DataFrame, rules: DataFrame, key: str, text: str, most: int = 20) -> DataFrame:
    """Records against rules (pointer, rule, arg); key, pointer, rule of the first `most` errors of each record by pointer.

    Rules written by hand, for exact pointers; schemas in tables are compiled by `conformance`. Of values:
    type, const, enum (comma list), pattern, min, max. An argument of const and enum that is a JSON number,
    true, false, null or a quoted string stands for that value, any other for the string; numbers are compared
    exactly (up to 38 digits, ten of them behind the point). Of objects: required (the pointer must
    be there if its object is), closed (comma list of the members there may be), max_properties, members
    (the type of every member), not_required (comma list of members that must not all be there), one_of
    (`tag|value:members|value:members`: the member tag has one of the values, and the members listed
    for it are there). A text that is no strict JSON has one error, rule parse. A record is parsed once, and
    only nodes that a rule looks at become rows, with their members: each rule is settled in such a row.
    """
    from .rollups import first_errors

    # a literal rule table; what is required of a pointer is looked for in its object
    at = rules.withColumn("wanted", F.col("pointer")).withColumn("pointer", F.when(F.col("rule") == "required", F.regexp_replace("pointer", "/[^/]*$", "")).otherwise(F.col("pointer")))
    none = F.lit(None).cast("string")
    at = at.filter(F.col("rule").isin(*_RULES)).unionByName(rules.sparkSession.range(1).select(F.lit("").alias("pointer"), F.lit("parse").alias("rule"), none.alias("arg"), none.alias("wanted")))
    pointers = frozenset(x["pointer"] for x in at.select("pointer").distinct().collect())
    nodes = walk_places(docs, key, text, pointers).join(F.broadcast(at), "pointer")
    v, arg = F.col("value"), F.col("arg")

    def as_plain(kind: Column, value: Column) -> Column:
        return F.when(kind == "string", F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)

    plain = as_plain(F.col("kind"), v)
    number = F.when(F.col("kind") == "number", v.try_cast("double"))
    whole = F.when(F.col("kind") == "number", v.try_cast("decimal(38,10)"))
    kind = F.when(arg == "integer", (F.col("kind") == "number") & (number == F.floor(number))).otherwise(F.col("kind") == arg)

    def is_value(x: Column) -> Column:
        """Whether the node is the value that an argument stands for."""
        literal = F.rlike(x, F.lit(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"))
        return (
            F.when(literal, (F.col("kind") == "number") & F.coalesce(whole == x.try_cast("decimal(38,10)"), number == x.try_cast("double")))
            .when(x.isin("true", "false"), (F.col("kind") == "boolean") & (v == x))
            .when(x == "null", F.col("kind") == "null")
            .when(F.rlike(x, F.lit('^".*"$')), (F.col("kind") == "string") & (plain == F.substring(x, F.lit(2), F.length(x) - 2)))
            .otherwise((F.col("kind") == "string") & (plain == x))
        )

    def against(at_least: bool) -> Column:
        limit, rough = arg.try_cast("decimal(38,10)"), arg.try_cast("double")
        return F.coalesce(whole >= limit, number >= rough) if at_least else F.coalesce(whole <= limit, number <= rough)
    ok = (
        F.when(F.col("rule") == "type", kind)
        .when(F.col("rule") == "const", is_value(arg))
        .when(F.col("rule") == "enum", F.exists(F.split(arg, ","), is_value))
        .when(F.col("rule") == "pattern", (F.col("kind") != "string") | F.rlike(plain, arg))
        .when(F.col("rule") == "min", (F.col("kind") != "number") | against(True))
        .when(F.col("rule") == "max", (F.col("kind") != "number") | against(False))
    )
    below = lambda m: F.concat("pointer", F.lit("/"), F.replace(F.replace(m["name"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
    names, listed = F.col("members.name"), F.split(arg, ",")
    cases = F.split(arg, r"\|")
    tagged = F.get(F.filter("members", lambda m: m["name"] == F.get(cases, 0)), 0)
    tag = as_plain(tagged["kind"], tagged["value"])
    chosen = F.get(F.filter(F.slice(cases, 2, F.size(cases) - 1), lambda c: F.substring_index(c, ":", 1) == tag), 0)
    needed = F.array_remove(F.split(F.substring_index(chosen, ":", -1), ","), "")
    fits = (
        F.when(F.col("rule") == "required", (F.col("wanted") == F.col("pointer")) | F.exists("members", lambda m: below(m) == F.col("wanted")))
        .when(F.col("rule") == "max_properties", F.size("members") <= arg.cast("int"))
        .when(F.col("rule") == "members", F.forall("members", lambda m: m["kind"] == arg))
        .when(F.col("rule") == "not_required", F.size(F.array_except(listed, names)) > 0)
        .when(F.col("rule") == "one_of", F.size(F.array_except(needed, names)) == 0)
    )
    error = lambda path: F.struct(path.alias("path"), F.col("rule").alias("code"))
    extra = F.transform(F.filter("members", lambda m: ~F.array_contains(listed, m["name"])), lambda m: error(below(m)))
    one = lambda holds: F.when(~F.coalesce(holds, F.lit(False)), F.array(error(F.col("wanted"))))
    wrong = (
        F.when(F.col("error").isNotNull() | (F.col("rule") == "parse"), F.when(F.col("error").isNotNull() & (F.col("rule") == "parse"), F.array(error(F.col("pointer")))))
        .when(F.col("rule") == "closed", extra)
        .when(F.col("rule").isin(*_OF_OBJECTS), F.when(F.col("kind") == "object", one(fits)))
        .otherwise(one(ok))
    )
    # outer: for a plain explode Spark filters first, by the same cases once more
    every = nodes.select(key, F.explode_outer(wrong).alias("e")).filter("e is not null").select(key, "e.path", "e.code")
    return first_errors(every, [key], most).select(key, F.col("path").alias("pointer"), F.col("code").alias("rule"))
