"""References, ids and counts read out of report documents, by their place in the walked JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import duplicates
from .lineage import written

# fixed values: how ids of extractors begin, the members that name one, and the members below which none counts as observed
EXTRACTOR = "extractor."
EXTRACTOR_MEMBERS = ("id", "extractor_id", "extractor")
NOT_OBSERVED = ("required_extractors", "missing_extractors", "coverage_profile", "profile_evaluation", "proof_profile", "profile_manifest", "diagnostics", "description")


def _parent(pointer: Column) -> Column:
    return F.regexp_replace(pointer, "/[^/]*$", "")


def _name(pointer: Column) -> Column:
    """The last part of a pointer, unescaped."""
    return F.replace(F.replace(F.regexp_extract(pointer, "([^/]*)$", 1), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def _text(value: Column) -> Column:
    """A canonical JSON string's text."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def place(pattern: str) -> str:
    """The regular expression of a pointer pattern, in which * stands for any one part."""
    return "^" + "/".join("[^/]*" if part == "*" else re.escape(part) for part in pattern.split("/")) + "$"


def references(nodes: DataFrame, key: str, members: dict[str, str]) -> DataFrame:
    """nodes: walked JSON (see walk_json); members: the kind of what a member of that name refers to. Rows key, kind, source_id (the pointer of the reference), target_id.

    A member's string is a reference, and so is each string of its array. Other values refer to nothing.
    """
    kinds = F.coalesce(*[F.when(F.col("member") == m, F.lit(k)) for m, k in members.items()])
    strings = nodes.filter("kind = 'string'").select(key, "pointer", "value", F.col("name"))
    listed = F.rlike("name", F.lit("^[0-9]+$"))
    member = F.when(listed, _name(_parent(F.col("pointer")))).otherwise(F.col("name"))
    own = strings.select(key, "pointer", "value", F.explode(F.array_distinct(F.array("name", member))).alias("member")).withColumn("refers", kinds).filter("refers is not null")
    return own.select(key, F.col("refers").alias("kind"), F.col("pointer").alias("source_id"), _text(F.col("value")).alias("target_id"))


def declared(nodes: DataFrame, key: str, places: dict[str, str]) -> DataFrame:
    """places: by kind the pattern of the maps' members that declare ids, such as /nodes/*. Rows key, kind, id (the member's name), pointer."""
    kind = F.coalesce(*[F.when(F.rlike("pointer", F.lit(place(p))), F.lit(k)) for k, p in places.items()])
    return nodes.select(key, kind.alias("kind"), _name(F.col("pointer")).alias("id"), "pointer").filter("kind is not null")


def observed_extractors(nodes: DataFrame, key: str, skipped: tuple[str, ...] = NOT_OBSERVED) -> DataFrame:
    """key, observed: the sorted ids of extractors that a document names, as a member or in id, extractor_id or extractor; what stands below the members `skipped` is not looked at."""
    named = nodes.withColumn("member", F.explode(F.array("name", F.when((F.col("kind") == "string") & F.col("name").isin(*EXTRACTOR_MEMBERS), _text(F.col("value"))))))
    if skipped:
        named = named.filter(~F.rlike("pointer", F.lit("/(" + "|".join(map(re.escape, skipped)) + ")(/|$)")))
    ids = named.filter(F.startswith("member", F.lit(EXTRACTOR))).groupBy(key).agg(F.array_sort(F.collect_set("member")).alias("observed"))
    return nodes.select(key).distinct().join(ids, key, "left").select(key, F.coalesce("observed", F.array().cast("array<string>")).alias("observed"))


def document_checks(nodes: DataFrame, key: str, members: dict[str, str], places: dict[str, str], exclusive: tuple[tuple[str, str], ...] = (), counts: dict[str, str] | None = None, unique: tuple[str, ...] = ()) -> DataFrame:
    """Coded rows of walked report documents: key, code, pointer, target.

    members and places as in references and declared. exclusive: pairs of kinds that may not declare the
    same id. counts: by the pointer of a number the kind whose declarations it counts. unique: patterns of
    values that may stand once in a document. A document that is no JSON has the one code DOCUMENT_REFUSED.

    Codes: kind_UNRESOLVED, MAP_KEY_MISMATCH (a declared member holds another id), CONTRADICTORY_ID,
    COUNT_MISMATCH, DUPLICATE_ID. References are made distinct by their targets before the anti join, so a
    target that everything refers to is looked up once a document.
    """
    nodes = written(nodes)
    refused = nodes.filter("error is not null").select(key, F.lit("DOCUMENT_REFUSED").alias("code"), "pointer", F.col("error").alias("target"))
    sound = nodes.filter("error is null")
    known = declared(sound, key, places)
    asked = references(sound, key, members)
    lost = asked.select(key, "kind", F.col("target_id").alias("id")).distinct().join(known.select(key, "kind", "id").distinct(), [key, "kind", "id"], "left_anti")
    broken = asked.join(lost.withColumnRenamed("id", "target_id"), [key, "kind", "target_id"]).select(key, F.concat(F.upper("kind"), F.lit("_UNRESOLVED")).alias("code"), F.col("source_id").alias("pointer"), F.col("target_id").alias("target"))
    own = sound.filter("name = 'id' and kind = 'string'").select(key, _parent(F.col("pointer")).alias("pointer"), _text(F.col("value")).alias("target"))
    mismatched = known.join(own, [key, "pointer"]).filter("id != target").select(key, F.lit("MAP_KEY_MISMATCH").alias("code"), "pointer", "target")
    out = refused.unionByName(broken).unionByName(mismatched)
    for one, other in exclusive:
        both = known.filter(F.col("kind") == one).join(known.filter(F.col("kind") == other).select(key, "id"), [key, "id"], "left_semi")
        out = out.unionByName(both.select(key, F.lit("CONTRADICTORY_ID").alias("code"), "pointer", F.col("id").alias("target")))
    if counts:
        kind = F.coalesce(*[F.when(F.col("pointer") == p, F.lit(k)) for p, k in counts.items()])
        said = sound.withColumn("counted", kind).filter("counted is not null and kind = 'number'").select(key, "pointer", "value", F.col("counted").alias("kind"))
        wrong = said.join(known.groupBy(key, "kind").agg(F.count("*").alias("n")), [key, "kind"], "left").filter(F.coalesce(F.col("value").try_cast("double"), F.lit(-1.0)) != F.coalesce("n", F.lit(0)))
        out = out.unionByName(wrong.select(key, F.lit("COUNT_MISMATCH").alias("code"), "pointer", F.coalesce("n", F.lit(0)).cast("string").alias("target")))
    for pattern in unique:
        values = sound.filter(F.rlike("pointer", F.lit(place(pattern)))).select(key, "value")
        again = duplicates(values, [key, "value"], F.col("value"))
        out = out.unionByName(again.select(key, F.lit("DUPLICATE_ID").alias("code"), F.lit(pattern).alias("pointer"), _text(F.col("value")).alias("target")))
    return out
