"""Reading JSON as models write it: fences, surrounding prose, JSON inside strings, cut-off text."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator
from typing import Any

_DECODER = json.JSONDecoder()
_OPEN = re.compile(r"[{\[]")
_MAY_OPEN = frozenset("{[ \t\r\n\ufeff")
_TYPES = {str: "string", dict: "object", list: "array", bool: "boolean", int: "number", float: "number", type(None): "null"}


def _looks_started(text: str, at: int) -> bool:
    rest = text[at + 1 : at + 40].lstrip()
    if not rest:
        return True
    return rest[0] in '"}' if text[at] == "{" else rest[0] in '[{"]-0123456789tfn'


_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_BLANK = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}


def decode_deep(text: str, at: int = 0) -> tuple[Any, int]:
    """(value, place after it) of the JSON at ``at``, nested as deep as it may be; ValueError if there is none.

    Containers still open stand on a list, not on the interpreter's stack.
    """
    holder: list = []  # the value found goes here
    stack: list[tuple[Any, str | None]] = [(holder, None)]

    def skip(i: int) -> int:
        return _BLANK.match(text, i).end()

    i = skip(at)
    while True:
        # a value begins at i
        ch = text[i : i + 1]
        opened = None
        if ch == '"':
            value, i = json.decoder.scanstring(text, i + 1, True)
        elif ch == "{" or ch == "[":
            value = opened = {} if ch == "{" else []
            i += 1
        elif (word := next((w for w in _WORDS if text.startswith(w, i)), None)) is not None:
            value, i = _WORDS[word], i + len(word)
        elif m := _NUMBER.match(text, i):
            value, i = (float(m[0]) if m[1] or m[2] else int(m[0])), m.end()
        else:
            raise ValueError(f"no value at {i}")
        inside, key = stack[-1]
        if isinstance(inside, list):
            inside.append(value)
        else:
            inside[key] = value
        fresh = opened is not None
        if fresh:
            stack.append((opened, None))
        # what follows: more of the open container, or its end
        while len(stack) > 1:
            inside, _ = stack[-1]
            i = skip(i)
            ch = text[i : i + 1]
            if ch == ("}" if isinstance(inside, dict) else "]"):
                stack.pop()
                i, fresh = i + 1, False
                continue
            if not fresh:
                if ch != ",":
                    raise ValueError(f"no delimiter at {i}")
                i = skip(i + 1)
                ch = text[i : i + 1]
            if isinstance(inside, dict):
                if ch != '"':
                    raise ValueError(f"no key at {i}")
                key, i = json.decoder.scanstring(text, i + 1, True)
                i = skip(i)
                if text[i : i + 1] != ":":
                    raise ValueError(f"no colon at {i}")
                stack[-1] = (inside, key)
                i = skip(i + 1)
            break
        else:
            return holder[0], i


def _loads(text: str) -> Any:
    try:
        return json.loads(text)
    except RecursionError:
        got, end = decode_deep(text)
        if text[end:].strip():
            raise ValueError("text after the JSON") from None
        return got


def _raw_decode(text: str, at: int) -> Any:
    try:
        return _DECODER.raw_decode(text, at)[0]
    except RecursionError:
        return decode_deep(text, at)[0]


def read_document(text: str | None) -> Any | None:
    """The JSON object or array that a text holds, or None.

    Text before and after it is ignored. JSON that stops before its end gives None: a part of a
    record must not pass for the record. A string that itself holds JSON is opened. Any depth is read.
    """
    if not text:
        return None
    try:
        got = _loads(text)
    except ValueError:
        got = None
        for m in _OPEN.finditer(text):
            if not _looks_started(text, m.start()):
                continue
            try:
                got = _raw_decode(text, m.start())
            except ValueError:
                got = None
            break
    if isinstance(got, str):
        got = open_string(got)
    return got if isinstance(got, (dict, list)) else None


def open_string(text: str) -> Any:
    """What a string holds: an object or array if it is one, else the string."""
    if text[:1] not in _MAY_OPEN:
        return text
    head = text.lstrip()[:1]
    if head == "{" or head == "[":
        try:
            got = _loads(text)
        except ValueError:
            return text
        if isinstance(got, (dict, list)):
            return got
    return text


def json_type(v: Any) -> str:
    return _TYPES[type(v)]


def scalar_text(v: Any) -> str | None:
    """A scalar as text; JSON spelling for booleans."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    return v if isinstance(v, str) else repr(v) if isinstance(v, float) else str(v)


def value_key(v: Any) -> str | None:
    """A form in which equal values agree whatever their type: 14.90, "14.9" and 14.9 are one."""
    if v is None or isinstance(v, (dict, list)):
        return None
    t = unicodedata.normalize("NFKC", scalar_text(v)).strip()
    if not t:
        return None
    try:
        f = float(t)
    except ValueError:
        return t
    return f"{f:.10g}" if math.isfinite(f) else t


def path_values(doc: Any) -> dict[str, tuple[dict[str, int], list]]:
    """The path-value map of a record: label -> (counts of the JSON types met there, the scalars there).

    A label is the path of keys joined by dots, without element numbers. The scalars of an array stand at its
    label, which counts as an array; scalars are in document order. JSON in a string counts as what it holds.
    """
    out: dict[str, tuple[dict[str, int], list]] = {}
    stack: list[tuple[str, Any]] = [("", doc)]
    while stack:
        path, v = stack.pop()
        if type(v) is list:
            inner = []
            for x in v:
                if type(x) is str and x[:1] in _MAY_OPEN:
                    x = open_string(x)
                inner.append(x)
            if any(type(x) is dict or type(x) is list for x in inner):
                if path and not all(type(x) is dict for x in inner):  # scalars between containers keep their place
                    stack.extend((path, x if type(x) is dict or type(x) is list else _Scalar(x)) for x in reversed(inner))
                else:
                    stack.extend((path, x) for x in reversed(inner) if type(x) is dict or type(x) is list)
            elif path:
                out[path][1].extend(inner)
            continue
        if type(v) is _Scalar:
            out[path][1].append(v.value)
            continue
        prefix = path + "." if path else ""
        later = []
        for k, x in v.items():
            p = prefix + k
            if type(x) is str and x[:1] in _MAY_OPEN:
                x = open_string(x)
            kind = _TYPES[type(x)]
            met = out.get(p)
            if met is None:
                met = out[p] = ({}, [])
            met[0][kind] = met[0].get(kind, 0) + 1
            if kind == "object" or kind == "array":
                later.append((p, x))
            else:
                met[1].append(x)
        later.reverse()
        stack.extend(later)
    return out


class _Scalar:
    __slots__ = ("value",)

    def __init__(self, value: Any):
        self.value = value


def leaves_below(v: Any) -> Iterator[Any]:
    stack = [v]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            x = open_string(x)
        if isinstance(x, dict):
            stack.extend(x.values())
        elif isinstance(x, list):
            stack.extend(x)
        elif x is not None:
            yield x


def values_at(doc: Any, wanted: set[str]) -> dict[str, list[str]]:
    """Value keys of all leaves at or below each wanted label."""
    out: dict[str, list[str]] = {}
    stack: list[tuple[str, Any]] = [("", doc)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, str):
            v = open_string(v)
        if isinstance(v, dict):
            for k, x in v.items():
                p = f"{path}.{k}" if path else k
                if p in wanted:
                    out.setdefault(p, []).extend(t for y in leaves_below(x) if (t := value_key(y)))
                if isinstance(x, (dict, list, str)):
                    stack.append((p, x))
        elif isinstance(v, list):
            stack.extend((path, x) for x in v if isinstance(x, (dict, list, str)))
    return out
