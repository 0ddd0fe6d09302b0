"""JSON functions over string columns, on Spark's Variant where it has the semantics.

Strict validation, byte-exact minifying, prettifying, statistics and
MessagePack need a parser of their own; they are Arrow-batched.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._udf import arrow


def pointer_path(pointer: str) -> str:
    """A JSON Pointer as a Variant path: ``/a/0/b~1c`` -> ``$['a'][0]['b/c']``."""
    if pointer == "":
        return "$"
    if not pointer.startswith("/"):
        raise ValueError("a pointer is empty or starts with /")
    out = "$"
    for part in pointer[1:].split("/"):
        if re.search(r"~(?![01])", part):
            raise ValueError("~ stands before 0 or 1")
        part = part.replace("~1", "/").replace("~0", "~")
        out += f"[{part}]" if re.fullmatch(r"0|[1-9][0-9]*", part) else "['" + part.replace("'", "\\'") + "']"
    return out


def at_pointer(text: Column, pointer: str, kind: str = "string") -> Column:
    """The value at a pointer as ``kind``; null if it is missing, of another type or the text is not JSON."""
    return F.try_variant_get(F.try_parse_json(text), pointer_path(pointer), kind)


def field(text: Column, key: str, kind: str = "string") -> Column:
    return at_pointer(text, "/" + key.replace("~", "~0").replace("/", "~1"), kind)


def first_field(text: Column, key: str) -> Column:
    """The first value of a key, duplicates allowed, as text."""
    return F.get_json_object(text, f"$['{key}']")


def field_any_case(text: Column, key: str) -> Column:
    """The first key that equals ``key`` but for case, as text."""
    keys = F.json_object_keys(text)
    name = F.element_at(F.filter(keys, lambda k: F.lower(k) == key.lower()), 1)
    return F.get(F.transform(F.array(name), lambda k: F.get(F.map_values(F.map_filter(F.from_json(text, "map<string,string>"), lambda a, _: a == k)), F.lit(0))), F.lit(0))


def element(text: Column, i: int, kind: str = "string") -> Column:
    if i < 0:
        raise ValueError("no negative index")
    return F.try_variant_get(F.try_parse_json(text), f"$[{i}]", kind)


def keys(text: Column) -> Column:
    return F.json_object_keys(text)


def n_fields(text: Column) -> Column:
    return F.size(F.json_object_keys(text))


def n_elements(text: Column) -> Column:
    return F.json_array_length(text)


def type_tag(text: Column) -> Column:
    """array, object, int64, double, string, bool or null of the text's first value; null for invalid text. What follows the value is ``is_valid``'s concern."""
    v = F.try_parse_json(text)
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None).when(F.is_variant_null(v), "null").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string").when(s == "BOOLEAN", "bool").when(s == "BIGINT", "int64").otherwise("double")
    )


def number_in_string(value: Column, kind: str = "double") -> Column:
    return value.try_cast(kind)


def is_valid_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data)


# --- own parser ------------------------------------------------------------------


def _no_constant(_: str):
    raise ValueError("not JSON")


def strict(text: str):
    """The value of a whole text under RFC 8259; ValueError otherwise."""
    return json.loads(text, parse_constant=_no_constant)


@arrow("boolean")
def is_valid(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether the whole text is one JSON value; null for null."""
    for s in batches:
        yield s.map(lambda t: None if t is None else _ok(t))


def _ok(text: str) -> bool:
    try:
        strict(text)
    except (ValueError, RecursionError):
        return False
    return True


def minify_py(text: str) -> str:
    """The text without white space outside strings, everything else byte for byte."""
    return "".join(x if x[0] == '"' else re.sub(r"[ \t\r\n]+", "", x) for x in re.findall(r'"(?:[^"\\]|\\.)*"?|[^"]+', text, re.S))


@arrow("string")
def minify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None or not _ok(t) else minify_py(t))


@arrow("string")
def prettify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None or not _ok(t) else json.dumps(strict(t), indent=4, ensure_ascii=False))


def stats_py(text: str) -> dict:
    """Counts by type, depth, keys and their bytes, string bytes, repeated keys."""
    out = dict.fromkeys(("objects", "arrays", "strings", "integers", "floats", "trues", "falses", "nulls", "depth", "keys", "key_bytes", "string_bytes", "repeated_keys"), 0)

    def pairs(items):
        out["repeated_keys"] += len(items) - len({k for k, _ in items})
        return items if items else [("", _EMPTY)]

    def walk(v, depth: int) -> None:
        out["depth"] = max(out["depth"], depth)
        if isinstance(v, list) and v and isinstance(v[0], tuple):
            out["objects"] += 1
            for k, x in v:
                if x is _EMPTY:
                    continue
                out["keys"] += 1
                out["key_bytes"] += len(k.encode("utf-8", "surrogatepass"))
                walk(x, depth + 1)
        elif isinstance(v, list):
            out["arrays"] += 1
            for x in v:
                walk(x, depth + 1)
        elif isinstance(v, str):
            out["strings"] += 1
            out["string_bytes"] += len(v.encode("utf-8", "surrogatepass"))
        else:
            out["nulls" if v is None else "trues" if v is True else "falses" if v is False else "integers" if isinstance(v, int) else "floats"] += 1

    walk(json.loads(text, object_pairs_hook=pairs, parse_constant=_no_constant), 1)
    return out


_EMPTY = object()
STATS_DDL = ", ".join(f"{k} long" for k in ("objects", "arrays", "strings", "integers", "floats", "trues", "falses", "nulls", "depth", "keys", "key_bytes", "string_bytes", "repeated_keys"))


@arrow(STATS_DDL)
def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A struct of counts; nulls for text that is not JSON."""
    names = [x.split()[0] for x in STATS_DDL.split(", ")]
    for s in batches:
        rows = [stats_py(t) if t is not None and _ok(t) else dict.fromkeys(names) for t in s]
        yield pd.DataFrame({n: pd.array([r[n] for r in rows], dtype="Int64") for n in names})


def msgpack_py(v) -> bytes:
    """MessagePack of a parsed value."""
    if v is None:
        return b"\xc0"
    if isinstance(v, bool):
        return b"\xc3" if v else b"\xc2"
    if isinstance(v, int):
        if 0 <= v < 128:
            return bytes([v])
        if -32 <= v < 0:
            return struct.pack("b", v)
        if v >= 0:
            return b"\xcf" + struct.pack(">Q", v)
        return b"\xd3" + struct.pack(">q", v)
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        raw = v.encode("utf-8", "surrogatepass")
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else b"\xdb" + struct.pack(">I", len(raw))) + raw
    if isinstance(v, list):
        return (bytes([0x90 | len(v)]) if len(v) < 16 else b"\xdd" + struct.pack(">I", len(v))) + b"".join(map(msgpack_py, v))
    return (bytes([0x80 | len(v)]) if len(v) < 16 else b"\xdf" + struct.pack(">I", len(v))) + b"".join(msgpack_py(k) + msgpack_py(x) for k, x in v.items())


@arrow("binary")
def to_msgpack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None or not _ok(t) else msgpack_py(strict(t)))


def split_stream_py(text: str) -> list[tuple[int, str | None, str]]:
    """(index, document, error) of concatenated or comma-separated JSON documents in one text."""
    decoder, out, at, n = json.JSONDecoder(parse_constant=_no_constant), [], 0, 0
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text):
            return out
        try:
            _, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError) as e:
            out.append((n, None, str(e)[:200]))
            return out
        out.append((n, text[at:end], ""))
        at, n = end, n + 1


@arrow("array<struct<pos: int, doc: string, error: string>>")
def split_stream(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: [] if t is None else [{"pos": i, "doc": d, "error": e} for i, d, e in split_stream_py(t)])
