"""Stable ids, fingerprints and file digests. ASCII text needs no Unicode normalisation; see canonical.nfc for other text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(value: Column, most: int = 80) -> Column:
    """Lower case, runs of other characters to one underscore; over-long slugs end in 12 digits of a hash of the value."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    s = F.when(s == "", F.lit("unnamed")).otherwise(s)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most - 13), F.lit("_"), F.substring(F.sha2(value, 256), 1, 12)))


def component(value: Column, most: int = 80) -> Column:
    """The slug; a value that was changed on the way carries 10 digits of its hash, so that two of them never meet."""
    original = F.lower(F.trim(value))
    safe = original.rlike("^[a-z0-9_]+$") & (F.length(original) <= most)
    marked = F.concat(F.substring(slug(original, most), 1, most - 11), F.lit("_"), F.substring(F.sha2(original, 256), 1, 10))
    return F.when(safe, slug(original, most)).otherwise(marked)


def stable_id(kind: str, *parts: Column) -> Column:
    """kind.part.part…; dotted safe parts stay as they are."""
    made = []
    for p in parts:
        original = F.lower(F.trim(p))
        made.append(F.when(original.rlike(r"^[a-z0-9_]+(?:\.[a-z0-9_]+)*$"), original).otherwise(component(p)))
    return F.concat_ws(".", F.lit(kind), *made)


def fingerprint(prefix: str, digits: int, *parts: Column) -> Column:
    """prefix and so many digits of the sha256 of the parts, joined by a bar; null parts count as the text null."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, digits))


def line_count(text: Column) -> Column:
    """Newlines, and one more for a last line without one."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return breaks + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)


def blob_sha1(content: Column) -> Column:
    """The id that git gives a file's content."""
    head = F.concat(F.lit("blob ").cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, content.cast("binary")))
