"""JSON functions over Columns.

Reading one path or a length stays native where Spark's own reader agrees;
everything that must give text back exactly goes through the codec in
Arrow-batched functions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lakequill.functions import json_codec as C

EACH = "array<struct<key:string,value:string,type:string,atom:string,id:bigint,parent:bigint,fullkey:string,path:string>>"


def _plain(x):
    """A Python value of a pandas cell; arrays become lists."""
    if isinstance(x, np.ndarray):
        return [_plain(y) for y in x.tolist()]
    if isinstance(x, (list, str, bytes, bytearray)):
        return x
    return None if pd.isna(x) else x.item() if hasattr(x, "item") else x


def _apply(kind: str, fn: Callable, *cols: Column, strict_null: int = 1) -> Column:
    """fn over rows; null where one of the first `strict_null` arguments is."""

    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        out = []
        for row in zip(*series):
            row = [_plain(x) for x in row]
            out.append(None if any(x is None for x in row[:strict_null]) else fn(*row))
        return pd.Series(out, dtype=object)

    return run(*cols)


def _text(v) -> str | None:
    v = C.to_sql(v)
    return None if v is None else v if isinstance(v, str) else str(v)


def json(doc: Column) -> Column:
    """Minified text; an error for text that is not JSON."""
    return _apply("string", lambda d: C.dump(C.parse(d)), doc)


def jsonb(doc: Column) -> Column:
    return _apply("binary", lambda d: C.to_blob(C.parse(d)), doc)


def json_valid(doc: Column, flags: int = 1) -> Column:
    """1 or 0. Flags: 1 strict text, 2 text with extensions, 4 and 8 the binary form."""

    def valid(d) -> int:
        try:
            if isinstance(d, (bytes, bytearray)):
                return int(bool(flags & 12) and C.from_blob(bytes(d)) is not C.MISSING)
            if not flags & 3:
                return 0
            C.parse(d, strict=not flags & 2)
            return 1
        except (C.JsonError, UnicodeDecodeError, IndexError):
            return 0

    return _apply("int", valid, doc)


def json_error_position(doc: Column) -> Column:
    return _apply("int", C.error_position, doc)


def json_extract(doc: Column, *paths: str, blob: bool = False) -> Column:
    """The SQL value at one path as text, or an array of the values at several."""

    def one(d):
        v = C.parse(d)
        found = [C.find(v, p) for p in paths]
        if len(found) == 1:
            v = None if found[0] is C.MISSING else found[0]
            return (C.to_blob(v) if isinstance(v, list) else None) if blob else _text(v)
        v = [None if f is C.MISSING else f for f in found]
        return C.to_blob(v) if blob else C.dump(v)

    return _apply("binary" if blob else "string", one, doc)


def arrow(doc: Column, path: str | int) -> Column:
    """`->`: the value as JSON text."""

    def one(d):
        v = C.find(C.parse(d), C.arrow_path(path))
        return None if v is C.MISSING else C.dump(v)

    return _apply("string", one, doc)


def arrow_text(doc: Column, path: str | int) -> Column:
    """`->>`: the value as SQL text; a plain member path is read natively."""
    if isinstance(path, str) and path.isidentifier():
        return F.get_json_object(doc, f"$.{path}")
    return json_extract(doc, C.arrow_path(path))


def json_type(doc: Column, path: str = "$") -> Column:
    def one(d):
        v = C.find(C.parse(d), path)
        return None if v is C.MISSING else C.kind(v)

    return _apply("string", one, doc)


def json_array_length(doc: Column, path: str = "$") -> Column:
    """0 for what is no array, null for a path that leads nowhere."""

    def one(d):
        v = C.find(C.parse(d), path)
        return None if v is C.MISSING else len(v) if isinstance(v, list) and not isinstance(v, C.Obj) else 0

    return _apply("int", one, doc)


def json_quote(x: Column, is_json: bool = False) -> Column:
    return _apply("string", lambda v: C.dump(C.of_sql(v, is_json)), x, strict_null=0)


def json_array(*cols: Column, is_json: tuple[int, ...] = (), blob: bool = False) -> Column:
    """`is_json`: numbers of the arguments that are JSON themselves and are embedded."""
    pack = C.to_blob if blob else C.dump
    return _apply("binary" if blob else "string", lambda *v: pack([C.of_sql(x, i in is_json) for i, x in enumerate(v)]), *cols, strict_null=0)


def json_object(*pairs: Column, is_json: tuple[int, ...] = (), blob: bool = False) -> Column:
    def one(*v):
        if any(k is None for k in v[::2]):
            raise C.JsonError("json_object() labels must be TEXT")
        out = C.Obj((C.quoted(k), C.of_sql(x, 2 * i + 1 in is_json)) for i, (k, x) in enumerate(zip(v[::2], v[1::2])))
        return C.to_blob(out) if blob else C.dump(out)

    return _apply("binary" if blob else "string", one, *pairs, strict_null=0)


def _edits(doc: Column, pairs: tuple, step: Callable, is_json: tuple[int, ...], blob: bool) -> Column:
    paths = pairs[::2]

    def one(d, *values):
        v = C.parse(d)
        for i, (p, x) in enumerate(zip(paths, values)):
            v = step(v, p, C.of_sql(x, i in is_json))
        return C.to_blob(v) if blob else C.dump(v)

    return _apply("binary" if blob else "string", one, doc, *pairs[1::2])


def json_insert(doc: Column, *pairs, is_json: tuple[int, ...] = (), blob: bool = False) -> Column:
    """path, value pairs: sets values where nothing is."""
    return _edits(doc, pairs, lambda v, p, x: C.edit(v, p, x, True, False), is_json, blob)


def json_replace(doc: Column, *pairs, is_json: tuple[int, ...] = (), blob: bool = False) -> Column:
    return _edits(doc, pairs, lambda v, p, x: C.edit(v, p, x, False, True), is_json, blob)


def json_set(doc: Column, *pairs, is_json: tuple[int, ...] = (), blob: bool = False) -> Column:
    return _edits(doc, pairs, lambda v, p, x: C.edit(v, p, x, True, True), is_json, blob)


def json_array_insert(doc: Column, *pairs, is_json: tuple[int, ...] = (), blob: bool = False) -> Column:
    return _edits(doc, pairs, C.array_insert, is_json, blob)


def json_remove(doc: Column, *paths: str, blob: bool = False) -> Column:
    def one(d):
        v = C.parse(d)
        for p in paths:
            v = C.remove(v, p)
            if v is C.MISSING:
                return None
        return C.to_blob(v) if blob else C.dump(v)

    return _apply("binary" if blob else "string", one, doc)


def json_patch(doc: Column, change: Column, blob: bool = False) -> Column:
    pack = C.to_blob if blob else C.dump
    return _apply("binary" if blob else "string", lambda d, c: pack(C.patch(C.parse(d), C.parse(c))), doc, change, strict_null=2)


def json_pretty(doc: Column, indent: str = "    ") -> Column:
    return _apply("string", lambda d: C.pretty(C.parse(d), indent), doc)


def _rows(doc: Column, root: str, deep: bool) -> Column:
    def one(d):
        text = lambda v: None if v is None else v if isinstance(v, str) else str(v)
        return [{**r, "key": text(r["key"]), "value": text(r["value"]), "atom": text(r["atom"])} for r in C.walk(C.parse(d), root, deep)]

    return _apply(EACH, one, doc)


def json_each(doc: Column, root: str = "$") -> Column:
    """An array of rows for `inline` or `explode`; values as text."""
    return _rows(doc, root, False)


def json_tree(doc: Column, root: str = "$") -> Column:
    return _rows(doc, root, True)


def _typed(text: str | None, kind: str, is_json: bool):
    """A JSON value from a Spark value's text and its type's name."""
    if text is None:
        return None
    if is_json:
        return C.parse(text)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return C.Num(text)
    if kind == "boolean":
        return text == "true"
    if kind in ("float", "double") or kind.startswith("decimal"):
        return C.of_sql(float(text))
    return C.quoted(text)


def jsonb_each(doc: Column, root: str = "$", deep: bool = False) -> Column:
    """As json_each (json_tree with `deep`), containers also in binary form in the field `blob`."""

    def one(d):
        text = lambda v: None if v is None else v if isinstance(v, str) else str(v)
        out = []
        for r in C.walk(C.parse(d), root, deep, blob=True):
            box = isinstance(r["value"], bytes)
            out.append({**r, "key": text(r["key"]), "value": None if box else text(r["value"]), "blob": r["value"] if box else None, "atom": text(r["atom"])})
        return out

    return _apply(EACH.replace("path:string>>", "path:string,blob:binary>>"), one, doc)


def json_group_array(x: Column, order: list[Column] | None = None, is_json: bool = False, blob: bool = False) -> Column:
    """Aggregate: all values, nulls included, in the order of `order`."""
    key = F.struct(*order) if order else F.lit(0)
    items = F.array_sort(F.collect_list(F.struct(key.alias("k"), x.cast("string").alias("v"))))
    pack = C.to_blob if blob else C.dump
    one = lambda v, kind: pack([_typed(y, kind, is_json) for y in v])
    return _apply("binary" if blob else "string", one, F.transform(items, lambda i: i["v"]), F.coalesce(F.max(F.typeof(x)), F.lit("string")))


def json_group_object(key: Column, x: Column, order: list[Column] | None = None, is_json: bool = False, blob: bool = False) -> Column:
    """Aggregate: an object of all pairs with a key, repeated keys kept."""
    by = F.struct(*order) if order else F.lit(0)
    items = F.array_sort(F.collect_list(F.struct(by.alias("o"), key.cast("string").alias("k"), x.cast("string").alias("v"))))
    pairs = F.filter(items, lambda p: p["k"].isNotNull())
    pack = C.to_blob if blob else C.dump
    one = lambda k, v, kind: pack(C.Obj((C.quoted(a), _typed(b, kind, is_json)) for a, b in zip(k, v)))
    return _apply("binary" if blob else "string", one, F.transform(pairs, lambda p: p["k"]), F.transform(pairs, lambda p: p["v"]), F.coalesce(F.max(F.typeof(x)), F.lit("string")))
