"""A JSON codec that keeps what text says: member order, repeated keys, number and string spelling.

Values are Python objects: None, True, False, Num (number text), Str (string
body as written), list for arrays and Obj (list of pairs) for objects. Beyond
strict JSON the parser takes comments, unquoted and single-quoted keys, single
quotes, trailing commas, hex numbers, leading + and bare decimal points,
Infinity and NaN.
"""

from __future__ import annotations

import json
import re
import sys
from functools import lru_cache

DEPTH = 1000
# each level of nesting takes a few frames
sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * DEPTH))


class Num(str):
    """Number as written."""


class Str(str):
    """String body as written, with its escapes."""

    def plain(self) -> str:
        try:
            return json.loads(f'"{self}"', strict=False)
        except ValueError:
            return str(self)


class Obj(list):
    """Pairs of (Str, value)."""


class JsonError(ValueError):
    def __init__(self, message: str, at: int = 0):
        super().__init__(message)
        self.at = at


_SPACE = re.compile(r"(?:[ \t\n\r\f\x0b ﻿  ]+|//[^\n]*|/\*.*?\*/)*", re.S)
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_NUMBER5 = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_STRING = re.compile(r'"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"')
_STRING5 = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'", re.S)
_NAME = re.compile(r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*")
_WORDS = {"null": None, "true": True, "false": False}


def quoted(text: str) -> Str:
    """The body of a string that stands for text."""
    return Str(json.dumps(text, ensure_ascii=False)[1:-1])


def _tidy5(body: str) -> Str:
    """A string body with JSON5 escapes, rewritten with JSON escapes."""
    def one(m: re.Match) -> str:
        c = m[0]
        if c == '"':
            return '\\"'
        if c[0] != "\\":
            return json.dumps(c)[1:-1]
        if re.fullmatch(r'\\(["\\/bfnrt]|u[0-9a-fA-F]{4})', c):
            return c
        if c[1] == "x":
            return "\\u00" + c[2:]
        return {"'": "'", "v": "\\u000b", "0": "\\u0000", "\n": ""}.get(c[1], c[1])

    return Str(re.sub(r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[\"\x00-\x1f]", one, body, flags=re.S))


class _Parser:
    def __init__(self, text: str, strict: bool):
        self.s, self.strict, self.k = text, strict, 0

    def fail(self, at: int | None = None):
        raise JsonError("malformed JSON", (self.k if at is None else at) + 1)

    def space(self) -> None:
        if self.strict:
            while self.k < len(self.s) and self.s[self.k] in " \t\n\r":
                self.k += 1
        else:
            self.k = _SPACE.match(self.s, self.k).end()

    def whole(self):
        v = self.value(0)
        self.space()
        if self.k < len(self.s):
            self.fail()
        return v

    def string(self) -> Str | None:
        m = _STRING.match(self.s, self.k)
        if m:
            self.k = m.end()
            return Str(m[1])
        if not self.strict and (m := _STRING5.match(self.s, self.k)):
            self.k = m.end()
            return _tidy5(m[1] if m[1] is not None else m[2])
        return None

    def value(self, depth: int):
        self.space()
        if depth > DEPTH or self.k >= len(self.s):
            self.fail()
        c = self.s[self.k]
        if c in "\"'":
            v = self.string()
            if v is None:
                self.fail()
            return v
        if c == "{":
            return self.members(depth)
        if c == "[":
            return self.items(depth)
        m = _NUMBER.match(self.s, self.k)
        if m and not (not self.strict and (n := _NUMBER5.match(self.s, self.k)) and n.end() > m.end()):
            self.k = m.end()
            return Num(m[0])
        if m := _NAME.match(self.s, self.k):
            if m[0] in _WORDS:
                self.k = m.end()
                return _WORDS[m[0]]
        if not self.strict:
            for word, number in (("-Infinity", "-9.0e+999"), ("+Infinity", "9.0e+999"), ("Infinity", "9.0e+999")):
                if self.s.startswith(word, self.k):
                    self.k += len(word)
                    return Num(number)
            if self.s.startswith("NaN", self.k):
                self.k += 3
                return None
            if m := _NUMBER5.match(self.s, self.k):
                self.k = m.end()
                t = m[0].lstrip("+")
                if "x" in t.lower():
                    return Num(str(int(t, 16)))
                t = re.sub(r"^(-?)\.", r"\g<1>0.", t)
                return Num(re.sub(r"\.(?=$|[eE])", ".0", t))
        self.fail()

    def items(self, depth: int) -> list:
        self.k += 1
        out: list = []
        self.space()
        while self.s[self.k : self.k + 1] != "]":
            out.append(self.value(depth + 1))
            self.space()
            c = self.s[self.k : self.k + 1]
            if c == ",":
                self.k += 1
                self.space()
                if self.strict and self.s[self.k : self.k + 1] == "]":
                    self.fail()
            elif c != "]":
                self.fail()
        self.k += 1
        return out

    def members(self, depth: int) -> Obj:
        self.k += 1
        out = Obj()
        self.space()
        while self.s[self.k : self.k + 1] != "}":
            key = self.string()
            if key is None and not self.strict and (m := _NAME.match(self.s, self.k)):
                self.k, key = m.end(), Str(m[0])
            if key is None:
                self.fail()
            self.space()
            if self.s[self.k : self.k + 1] != ":":
                self.fail()
            self.k += 1
            out.append((key, self.value(depth + 1)))
            self.space()
            c = self.s[self.k : self.k + 1]
            if c == ",":
                self.k += 1
                self.space()
                if self.strict and self.s[self.k : self.k + 1] == "}":
                    self.fail()
            elif c != "}":
                self.fail()
        self.k += 1
        return out


@lru_cache(4096)
def _parsed(text: str, strict: bool):
    return _Parser(text, strict).whole()


def parse(text: str | bytes, strict: bool = False):
    """The value of JSON text or of the binary form. Values are never changed in place, so short texts are kept parsed."""
    if isinstance(text, (bytes, bytearray)):
        return from_blob(bytes(text))
    return _parsed(text, strict) if len(text) <= 512 else _Parser(text, strict).whole()


def error_position(text: str) -> int:
    """0 for well-formed text, else the 1-based place of the first fault."""
    try:
        parse(text)
        return 0
    except JsonError as e:
        return max(e.at, 1)


def dump(v) -> str:
    if v is None:
        return "null"
    if v is True or v is False:
        return "true" if v else "false"
    if isinstance(v, Num):
        return str(v)
    if isinstance(v, Str):
        return f'"{v}"'
    if isinstance(v, Obj):
        return "{" + ",".join(f'"{k}":{dump(x)}' for k, x in v) + "}"
    return "[" + ",".join(map(dump, v)) + "]"


def pretty(v, indent: str = "    ", level: int = 0) -> str:
    pad = "\n" + indent * (level + 1)
    if isinstance(v, Obj) and v:
        return "{" + ",".join(f'{pad}"{k}": {pretty(x, indent, level + 1)}' for k, x in v) + "\n" + indent * level + "}"
    if isinstance(v, list) and not isinstance(v, Obj) and v:
        return "[" + ",".join(pad + pretty(x, indent, level + 1) for x in v) + "\n" + indent * level + "]"
    return dump(v)


def of_sql(v, is_json: bool = False):
    """A value of SQL as JSON; text with `is_json` is embedded."""
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return Num(v)
    if isinstance(v, float):
        if v != v:
            return None
        if v in (float("inf"), float("-inf")):
            return Num("9.0e+999" if v > 0 else "-9.0e+999")
        text = repr(v)
        return Num(text if re.search(r"[.e]", text) else text + ".0")
    if isinstance(v, (bytes, bytearray)):
        if is_json:
            return from_blob(bytes(v))
        raise JsonError("JSON cannot hold BLOB values")
    return parse(v) if is_json else quoted(v)


def to_sql(v):
    """The SQL value of a JSON value; containers become text."""
    if v is None:
        return None
    if v is True or v is False:
        return int(v)
    if isinstance(v, Num):
        if re.fullmatch(r"-?\d+", v):
            n = int(v)
            return n if -(2**63) <= n < 2**63 else float(n)
        return float(v)
    return v.plain() if isinstance(v, Str) else dump(v)


def kind(v) -> str:
    if v is None:
        return "null"
    if v is True or v is False:
        return "true" if v else "false"
    if isinstance(v, Num):
        return "integer" if re.fullmatch(r"-?\d+", v) else "real"
    return "text" if isinstance(v, Str) else "object" if isinstance(v, Obj) else "array"


# --- paths

_STEP = re.compile(r'\."((?:[^"\\]|\\.)*)"|\.([^.\[]+)|\[(\d+)\]|\[#(?:-(\d+))?\]')


def steps(path: str) -> list[tuple[str, object]]:
    """('key', name) or ('at', n) or ('end', n) for each step; an error for a path that is none."""
    if not path.startswith("$"):
        raise JsonError(f"bad JSON path: '{path}'")
    out: list[tuple[str, object]] = []
    k = 1
    while k < len(path):
        m = _STEP.match(path, k)
        if not m:
            raise JsonError(f"bad JSON path: '{path}'")
        if m[1] is not None:
            out.append(("key", Str(m[1]).plain()))
        elif m[2] is not None:
            out.append(("key", m[2]))
        elif m[3] is not None:
            out.append(("at", int(m[3])))
        else:
            out.append(("end", int(m[4] or 0)))
        k = m.end()
    return out


def arrow_path(arg) -> str:
    """The path that the right side of -> means: a path, a member name or an array place."""
    if isinstance(arg, int):
        return f"$[{arg}]" if arg >= 0 else f"$[#{arg}]"
    if arg.startswith("$"):
        return arg
    if re.fullmatch(r"\[.*\]", arg):
        return "$" + arg
    return f'$."{arg}"'


MISSING = object()


def _place(v, step) -> int | None:
    """Index of a step's target in v, its length for one place past the end, None if it has none."""
    how, arg = step
    if how == "key":
        if not isinstance(v, Obj):
            return None
        return next((i for i, (k, _) in enumerate(v) if k.plain() == arg), len(v))
    if not isinstance(v, list) or isinstance(v, Obj):
        return None
    at = arg if how == "at" else len(v) - arg
    return at if 0 <= at <= len(v) else None


def find(v, path: str):
    for step in steps(path):
        at = _place(v, step)
        if at is None or at >= len(v):
            return MISSING
        v = v[at][1] if step[0] == "key" else v[at]
    return v


def edit(v, path: str, new, insert: bool, replace: bool):
    """v with the value at path set: existing ones only with `replace`, absent ones only with `insert`."""
    todo = steps(path)
    if not todo:
        return new if replace else v

    def go(v, k: int):
        step = todo[k]
        at = _place(v, step)
        last = k == len(todo) - 1
        if at is None:
            return v
        if at == len(v):
            if not insert:
                return v
            if last:
                fresh = new
            else:
                empty = Obj() if todo[k + 1][0] == "key" else []
                fresh = go(empty, k + 1)
                if not fresh:
                    return v
            pair = (quoted(step[1]), fresh) if step[0] == "key" else fresh
            return type(v)([*v, pair])
        old = v[at][1] if step[0] == "key" else v[at]
        if last:
            if not replace:
                return v
            fresh = new
        else:
            fresh = go(old, k + 1)
        out = type(v)(v)
        out[at] = (v[at][0], fresh) if step[0] == "key" else fresh
        return out

    return go(v, 0)


def array_insert(v, path: str, new):
    """v with `new` before the array element at path (or at the array's end)."""
    todo = steps(path)
    if not todo or todo[-1][0] == "key":
        raise JsonError(f"not an array element: '{path}'")

    def go(v, k: int):
        at = _place(v, todo[k])
        if at is None:
            return v
        if k == len(todo) - 1:
            return [*v[:at], new, *v[at:]]
        if at == len(v):
            return v
        out = type(v)(v)
        out[at] = (v[at][0], go(v[at][1], k + 1)) if todo[k][0] == "key" else go(v[at], k + 1)
        return out

    return go(v, 0)


def remove(v, path: str):
    todo = steps(path)
    if not todo:
        return MISSING

    def go(v, k: int):
        at = _place(v, todo[k])
        if at is None or at >= len(v):
            return v
        out = type(v)(v)
        if k == len(todo) - 1:
            del out[at]
        else:
            out[at] = (v[at][0], go(v[at][1], k + 1)) if todo[k][0] == "key" else go(v[at], k + 1)
        return out

    return go(v, 0)


def patch(target, change):
    """RFC 7396 merge patch; order of the target's members is kept."""
    if not isinstance(change, Obj):
        return change
    out = Obj(target) if isinstance(target, Obj) else Obj()
    for k, v in change:
        at = next((i for i, (x, _) in enumerate(out) if x.plain() == k.plain()), None)
        if v is None:
            if at is not None:
                del out[at]
        elif at is None:
            out.append((k, patch(None, v) if isinstance(v, Obj) else v))
        else:
            out[at] = (out[at][0], patch(out[at][1], v))
    return out


# --- rows of json_each and json_tree


def _member(name: Str) -> str:
    plain = name.plain()
    return f".{plain}" if re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", plain) else f'."{name}"'


def walk(v, root: str, deep: bool, blob: bool = False) -> list[dict]:
    """Rows of json_each (or json_tree with `deep`) over the value at `root`. Ids number the values in order."""
    start = find(v, root)
    if start is MISSING:
        return []
    rows: list[dict] = []

    def row(key, x, parent, full, path) -> int:
        box = isinstance(x, list)
        value = (to_blob(x) if blob else dump(x)) if box else to_sql(x)
        rows.append({"key": key, "value": value, "type": kind(x), "atom": None if box else to_sql(x), "id": len(rows), "parent": parent, "fullkey": full, "path": path})
        return len(rows) - 1

    def inside(x, at, full, deeper):
        pairs = [(k.plain(), y, full + _member(k)) for k, y in x] if isinstance(x, Obj) else [(i, y, f"{full}[{i}]") for i, y in enumerate(x)]
        for key, y, name in pairs:
            here = row(key, y, at, name, full)
            if deeper and isinstance(y, list):
                inside(y, here, name, True)

    if deep or not isinstance(start, list):
        top = row(None, start, None, root, root if root == "$" else root)
        if deep and isinstance(start, list):
            inside(start, top, root, True)
    else:
        inside(start, None, root, False)
    return rows


# --- binary form: a header byte with type (low half) and size (high half), then the payload

_TYPES = {"null": 0, "true": 1, "false": 2, "integer": 3, "real": 5, "array": 11, "object": 12}


def _element(code: int, payload: bytes) -> bytes:
    n = len(payload)
    if n <= 11:
        return bytes([n << 4 | code]) + payload
    for nibble, width in ((12, 1), (13, 2), (14, 4), (15, 8)):
        if n < 1 << (8 * width):
            return bytes([nibble << 4 | code]) + n.to_bytes(width, "big") + payload
    raise JsonError("too large")


def to_blob(v) -> bytes:
    name = kind(v)
    if isinstance(v, Str):
        return _element(8 if "\\" in v else 7, str(v).encode())
    if isinstance(v, Obj):
        return _element(12, b"".join(to_blob(k) + to_blob(x) for k, x in v))
    if isinstance(v, list):
        return _element(11, b"".join(map(to_blob, v)))
    return _element(_TYPES[name], str(v).encode() if isinstance(v, Num) else b"")


def from_blob(b: bytes):
    def one(k: int):
        if k >= len(b):
            raise JsonError("malformed JSON", k)
        code, nibble = b[k] & 15, b[k] >> 4
        k += 1
        if nibble > 11:
            width = 1 << (nibble - 12)
            n, k = int.from_bytes(b[k : k + width], "big"), k + width
        else:
            n = nibble
        end = k + n
        if end > len(b):
            raise JsonError("malformed JSON", k)
        body = b[k:end]
        if code in (0, 1, 2):
            return (None, True, False)[code], end
        if code in (3, 5):
            return Num(body.decode()), end
        if code in (4, 6):
            return parse(body.decode()), end
        if code in (7, 8):
            return Str(body.decode()), end
        if code == 9:
            return _tidy5(body.decode()), end
        if code == 10:
            return quoted(body.decode()), end
        if code not in (11, 12):
            raise JsonError("malformed JSON", k)
        items = []
        while k < end:
            item, k = one(k)
            items.append(item)
        return (items if code == 11 else Obj(zip(items[::2], items[1::2]))), end

    v, end = one(0)
    if end != len(b):
        raise JsonError("malformed JSON", end)
    return v
