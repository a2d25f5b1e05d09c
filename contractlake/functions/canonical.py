"""Canonical JSON, Unicode normalisation and JSON walks: the vectorised helpers that Spark has no expression for."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ascii: escaped to ASCII; nfc: keys and values in normal form C, UTF-8, a newline at the end; utf8: UTF-8.
DIALECTS = ("ascii", "nfc", "utf8")


class _Refused(ValueError):
    pass


def _pairs(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) < len(pairs):
        seen: set[str] = set()
        for k, _ in pairs:
            if k in seen:
                raise _Refused(f"duplicate key {k}")
            seen.add(k)
    return out


def _number(text: str) -> Any:
    raise _Refused(f"{text} is no JSON number")


#: Digits of a number, and of a whole number's text, beyond which it is refused.
MOST_DIGITS = 4000


def _float(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise _Refused("number out of range")
    return value


def _int(text: str) -> int:
    if len(text) > MOST_DIGITS:
        raise _Refused("number out of range")
    return int(text)


def parse(text: str, number: Callable[[str], Any] = _float) -> Any:
    """Strict: repeated keys, NaN, infinities and numbers that no double holds are refused. number: makes those with a fraction or exponent."""
    return json.loads(text, object_pairs_hook=_pairs, parse_constant=_number, parse_float=number, parse_int=_int)


def refusal(error: Exception) -> str:
    """What a text is refused for."""
    if isinstance(error, _Refused):
        return str(error)
    if isinstance(error, RecursionError):
        return "nested too deep"
    return "lone surrogate" if isinstance(error, UnicodeEncodeError) else "no JSON"


#: What parsing and writing JSON raise on texts that are none, are nested too deep, or hold what UTF-8 can't.
REFUSALS = (ValueError, RecursionError)


def encodable_error(error: Exception) -> str:
    """refusal() with what UTF-8 hasn't written as escapes."""
    return refusal(error).encode("utf-8", "backslashreplace").decode()


def encodable(text: str) -> str:
    """The text, if UTF-8 has it."""
    text.encode()
    return text


def _normal(value: Any) -> Any:
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, list):
        return [_normal(v) for v in value]
    if isinstance(value, dict):
        out: dict[str, Any] = {}
        for k, v in value.items():
            n = _normal(k)
            if n in out:
                raise _Refused(f"keys collide at {n}")
            out[n] = _normal(v)
        return out
    return value


#: One encoder for all texts: json.dumps makes one a call.
_ENCODERS = {ascii_: json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_, allow_nan=False) for ascii_ in (True, False)}


def canonical(value: Any, dialect: str) -> str:
    if dialect == "nfc":
        value = _normal(value)
    out = _ENCODERS[dialect == "ascii"].encode(value)
    return out + "\n" if dialect == "nfc" else out


def _leaf(value: Any) -> str | None:
    """canonical() of what was parsed, quick for numbers; None for objects."""
    if isinstance(value, dict):
        return None
    return repr(value) if type(value) in (int, float) else canonical(value, "ascii")


def _without(value: Any, path: list[str]) -> Any:
    """The value without the member at the path, if objects lead there."""
    if not isinstance(value, dict) or path[0] not in value:
        return value
    rest = {k: v for k, v in value.items() if k != path[0]}
    return rest if len(path) == 1 else {**rest, path[0]: _without(value[path[0]], path[1:])}


def canonical_json(text: Column, dialect: str, drop: tuple[str, ...] = ()) -> Column:
    """struct(json, sha256, error) of a JSON text. drop: members of objects left out, such as its own seal, each named (a member of the root) or by its pointer. Null text gives nulls."""
    paths = [[part.replace("~1", "/").replace("~0", "~") for part in d[1:].split("/")] if d.startswith("/") else [d] for d in drop]
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect}")

    @F.pandas_udf("json string, sha256 string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, None, None))
                continue
            try:
                value = parse(t)
                for path in paths:
                    value = _without(value, path)
                out = canonical(value, dialect)
                rows.append((out, hashlib.sha256(out.encode()).hexdigest(), None))
            except REFUSALS as e:
                rows.append((None, None, encodable_error(e)))
        return pd.DataFrame(rows, columns=["json", "sha256", "error"])

    return run(text)


def verify_seal(text: Column, dialect: str, seal: str = "integrity", claim: str = "sha256", unsealed: tuple[str, ...] = ()) -> Column:
    """struct(claimed, sha256, code) of a sealed JSON text: its digest without the member `seal` and the unsealed members (names or pointers), and the one that `seal` claims.

    code: null where they agree, SEAL_MISSING, SEAL_MISMATCH, or why the text is no JSON. Null text gives nulls.
    """
    made = canonical_json(text, dialect, drop=(seal, *unsealed))
    claimed = F.get_json_object(text, f"$.{seal}.{claim}")
    code = F.when(made["error"].isNotNull(), made["error"]).when(text.isNotNull() & claimed.isNull(), F.lit("SEAL_MISSING")).when(claimed != made["sha256"], F.lit("SEAL_MISMATCH"))
    return F.struct(claimed.alias("claimed"), made["sha256"].alias("sha256"), code.alias("code"))


def nfc(text: Column) -> Column:
    """Unicode normal form C."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return run(text)


def _kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


def _walk(value: Any, pointer: str, key: str | None, arrays: bool) -> Iterator[tuple[str, str | None, Any]]:
    stack = [(value, pointer, key)]
    while stack:
        v, p, k = stack.pop()
        yield p, k, v
        children = v.items() if isinstance(v, dict) else ((str(i), x) for i, x in enumerate(v)) if arrays and isinstance(v, list) else ()
        stack += [(x, f"{p}/{c.replace('~', '~0').replace('/', '~1')}", c) for c, x in children]


#: So many texts are Python objects at a time, and what they become goes out as soon as it has so many rows.
TEXTS, ROWS = 64, 4096


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt by hash to two pieces a core. Texts are costlier than their bytes in a file tell, so that splits by bytes, or one small file, leave most cores idle."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *rows.columns)


def each_text(rows: DataFrame, made: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """The rows that `made` makes of each row of `rows`, by column: a worker holds the rows of one text and ROWS others, however many texts come in a batch."""
    out_schema = to_arrow_schema(T._parse_datatype_string(schema))
    columns = rows.columns

    def sent(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), out_schema, strict=True)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                for row in zip(*(part.column(c).to_pylist() for c in columns), strict=True):
                    out += made(*row)
                    while len(out) >= ROWS:
                        yield sent(out[:ROWS])
                        out = out[ROWS:]
        if out:
            yield sent(out)

    return rows.mapInArrow(run, schema)


def walk_json(docs: DataFrame, key: str, text: str, arrays: bool = True) -> DataFrame:
    """One row per JSON node: key, pointer (RFC 6901; the root's is empty), name (of the member or index), kind, value (canonical, of leaves and whole arrays), error.

    arrays: whether what stands in arrays has rows of its own.

    A text that is no strict JSON, is nested too deep to be read, or names a member by a lone surrogate
    gives one row with its error and no other.
    """
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).filter("t is not null")

    def nodes(k: Any, t: str) -> list[tuple]:
        try:
            return [(k, encodable(p), n, _kind(v), None if isinstance(v, dict) else canonical(v, "ascii"), None) for p, n, v in _walk(parse(t), "", None, arrays)]
        except REFUSALS as e:
            return [(k, "", None, None, None, encodable_error(e))]

    kind = docs.schema[key].dataType.simpleString()
    return each_text(dealt(rows), nodes, f"k {kind}, pointer string, name string, kind string, value string, error string").withColumnRenamed("k", key)


def walk_places(docs: DataFrame, key: str, text: str, pointers: frozenset[str]) -> DataFrame:
    """The nodes of walk_json at the given pointers alone, with what is in them: key, pointer, kind, value, members (name, kind, value; null of leaves), error. Errors are those of the whole text."""
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).filter("t is not null")

    def nodes(k: Any, t: str) -> list[tuple]:
        out: list[tuple] = []
        try:
            for p, _, v in _walk(parse(t), "", None, True):
                encodable(p)
                # arrays are written in any case: one may be nested too deep for that
                value = _leaf(v) if isinstance(v, list) or p in pointers else None
                if p in pointers:
                    inside = v.items() if isinstance(v, dict) else ((str(i), x) for i, x in enumerate(v)) if isinstance(v, list) else None
                    members = None if inside is None else [(n, _kind(x), _leaf(x)) for n, x in inside]
                    out.append((k, p, _kind(v), value, members, None))
            return out
        except REFUSALS as e:
            return [(k, "", None, None, None, encodable_error(e))]

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, pointer string, kind string, value string, members array<struct<name:string,kind:string,value:string>>, error string"
    return each_text(dealt(rows), nodes, schema).withColumnRenamed("k", key)


def colliding_names(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Members of one object of a text whose names differ but agree in normal form C: key, object (its pointer), normal, spellings (how many names). Texts without any, and those that walk_json refuses, have no rows."""
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t"))

    def clashes(k: Any, t: str | None) -> list[tuple]:
        # a filter on texts that a column expression makes would make each twice
        if t is None:
            return []
        out: list[tuple] = []
        try:
            stack = [(parse(t), "", False)]
            while stack:
                v, p, sound = stack.pop()
                if isinstance(v, list) and not sound:
                    # one may be nested too deep to be written; what is inside is written with it
                    canonical(v, "ascii")
                    sound = True
                elif isinstance(v, dict):
                    # names in ASCII are their own normal form
                    found = Counter(unicodedata.normalize("NFC", encodable(n)) for n in v if not n.isascii())
                    for n, spellings in found.items():
                        if n.isascii() and n in v:
                            spellings += 1
                        if spellings > 1:
                            out.append((k, p, n, spellings))
                inside = v.items() if isinstance(v, dict) else ((str(i), x) for i, x in enumerate(v)) if isinstance(v, list) else ()
                stack += [(x, f"{p}/{c.replace('~', '~0').replace('/', '~1')}", sound) for c, x in inside if isinstance(x, (dict, list))]
            return out
        except REFUSALS:
            return []

    kind = docs.schema[key].dataType.simpleString()
    return each_text(dealt(rows), clashes, f"k {kind}, object string, normal string, spellings long").withColumnRenamed("k", key)


#: What stands where a side has nothing; a singleton in every process.
_ABSENT = ...


def _differences(before: Any, after: Any) -> Iterator[tuple[str, str | None, str | None]]:
    """Pointers at which two values differ, with what is there (canonical; None: nothing). Every node is looked at once and what is equal is written nowhere."""
    stack = [("", before, after)]
    while stack:
        pointer, b, a = stack.pop()
        if isinstance(b, dict) and isinstance(a, dict):
            stack += [(f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", b.get(k, _ABSENT), a.get(k, _ABSENT)) for k in {**b, **a}]
            continue
        x, y = (None if v is _ABSENT else canonical(v, "ascii") for v in (b, a))
        if x != y:
            yield encodable(pointer), x, y


def json_changes(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """pairs: key and two JSON texts. What differs: key, pointer, before, after (canonical, null where missing).

    Objects are compared member by member, anything else whole and by kind (1, 1.0 and true differ). A null
    text, or one that is refused, is a side with nothing; of a pair with a name that UTF-8 hasn't, the
    differences found before it remain.
    """
    rows = pairs.select(pairs[key].alias("k"), pairs[before].alias("b"), pairs[after].alias("a"))

    def side(text: str | None) -> Any:
        try:
            return _ABSENT if text is None else parse(text)
        except REFUSALS:
            return _ABSENT

    def changes(k: Any, b: str | None, a: str | None) -> list[tuple]:
        out: list[tuple] = []
        try:
            out += ((k, *d) for d in _differences(side(b), side(a)))
        except REFUSALS:
            pass
        return out

    kind = pairs.schema[key].dataType.simpleString()
    return each_text(dealt(rows), changes, f"k {kind}, pointer string, before string, after string").withColumnRenamed("k", key)


def schema_paths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row per schema node of each JSON Schema: key, path (a.b member, a.* map value, a[] item; the root's is empty), location, required, types, digest.

    Nodes are objects and booleans. A local reference is a node itself; its target follows at the same
    path, then what stands beside it. allOf, anyOf, oneOf are followed; a reference that is being
    followed stops. A reference that leads nowhere ends there. A schema that is no JSON or nested too deep
    has no rows.
    """
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).filter("t is not null")

    def target(root: Any, ref: str) -> Any:
        node = root
        for part in ref[1:].lstrip("/").split("/") if ref != "#" else []:
            name = part.replace("~1", "/").replace("~0", "~")
            node = node.get(name) if isinstance(node, dict) else None
        return node

    def below(node: dict, path: str, location: str, required: bool) -> Iterator[tuple[Any, str, str, bool]]:
        """The nodes of a node, with path, location and whether they are required."""
        for word in ("allOf", "anyOf", "oneOf"):
            branches = node.get(word)
            yield from ((b, path, f"{location}/{word}/{i}", required) for i, b in enumerate(branches if isinstance(branches, list) else []))
        need = node.get("required") if isinstance(node.get("required"), list) else []
        members = node.get("properties")
        for name, child in sorted(members.items()) if isinstance(members, dict) else []:
            yield child, f"{path}.{name}" if path else name, f"{location}/properties/{name.replace('~', '~0').replace('/', '~1')}", name in need
        if node.get("additionalProperties") is not False:
            yield node.get("additionalProperties"), f"{path}.*" if path else "*", f"{location}/additionalProperties", False
        yield node.get("items"), f"{path}[]", f"{location}/items", False

    def visit(root: Any, node: Any, path: str, location: str, required: bool, seen: tuple[str, ...], out: list) -> None:
        if not isinstance(node, (dict, bool)):
            return
        kinds = node.get("type") if isinstance(node, dict) else None
        kinds = sorted(kinds) if isinstance(kinds, list) else [kinds] if isinstance(kinds, str) else []
        out.append((path, location, required, kinds, hashlib.sha256(canonical(node, "utf8").encode()).hexdigest()))
        if isinstance(node, dict):
            ref = node.get("$ref")
            if isinstance(ref, str) and ref.startswith("#") and ref not in seen:
                visit(root, target(root, ref), path, ref, required, (*seen, ref), out)
            for child, p, at, need in below(node, path, location, required):
                visit(root, child, p, at, need, seen, out)

    def paths(k: Any, t: str) -> list[tuple]:
        found: list = []
        try:
            root = parse(t)
            visit(root, root, "", "#", True, (), found)
            return [(k, encodable(path), encodable(at), *rest) for path, at, *rest in found]
        except REFUSALS:
            return []

    kind = docs.schema[key].dataType.simpleString()
    return each_text(dealt(rows), paths, f"k {kind}, path string, location string, required boolean, types array<string>, digest string").withColumnRenamed("k", key)


def cas_fold(updates: DataFrame, thread: str = "thread") -> DataFrame:
    """updates: thread, seq, expected, new. In order of seq each update is accepted if its expectation is the current pointer (null at first), else a conflict.

    The fold needs a thread's updates in order in one task; they are small rows.
    """
    kind = updates.schema[thread].dataType.simpleString()

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        now, rows = None, []
        for r in group.sort_values("seq").itertuples(index=False):
            expected = None if pd.isna(r.expected) else r.expected
            ok = expected == now
            now = r.new if ok else now
            rows.append((getattr(r, thread), r.seq, "accepted" if ok else "conflict", now))
        return pd.DataFrame(rows, columns=[thread, "seq", "outcome", "pointer"])

    return updates.select(thread, "seq", "expected", "new").groupBy(thread).applyInPandas(fold, f"{thread} {kind}, seq long, outcome string, pointer string")
