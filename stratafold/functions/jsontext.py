"""JSON texts of any depth: reading, writing and comparing without recursion limits, and batches bounded by bytes.

The readers of the standard library are used where they can; documents nested deeper than they allow are read and written
with an explicit stack, to the same result. A text is one JSON value with nothing behind it; the constants NaN and Infinity
are no JSON. Of repeated keys the last holds. Whole numbers of more digits than Python converts are read as floats.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"null": None, "true": True, "false": False}
#: Digits of a whole number that Python converts exactly.
MOST_DIGITS = 4_000


class NotJson(ValueError):
    """The text is not one complete JSON value."""


def _reject(token: str) -> None:
    raise NotJson(token)


def _scalar(text: str, at: int) -> tuple[object, int]:
    if text.startswith('"', at):
        try:
            return scanstring(text, at + 1, True)
        except ValueError as error:
            raise NotJson(str(error)) from None
    for word, value in _WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    found = _NUMBER.match(text, at)
    if found is None:
        raise NotJson(f"no value at {at}")
    whole, fraction, exponent = found.groups()
    exact = fraction is None and exponent is None and len(whole) <= MOST_DIGITS
    return int(whole) if exact else float(found.group()), found.end()


def _load_deep(text: str) -> object:
    skip = lambda at: _SPACE.match(text, at).end()

    def key_at(at: int) -> tuple[str, int]:
        if not text.startswith('"', at):
            raise NotJson(f"no key at {at}")
        key, at = _scalar(text, at)
        at = skip(at)
        if not text.startswith(":", at):
            raise NotJson(f"no colon at {at}")
        return key, skip(at + 1)

    #: Open containers, each with the key its next value belongs to.
    opened: list[list] = []
    at = skip(0)
    while True:
        sign = text[at : at + 1]
        if sign == "{" or sign == "[":
            node: dict | list = {} if sign == "{" else []
            at = skip(at + 1)
            if not text.startswith("}" if sign == "{" else "]", at):
                key, at = key_at(at) if sign == "{" else (None, at)
                opened.append([node, key])
                continue
            value: object = node
            at += 1
        else:
            value, at = _scalar(text, at)
        while opened:
            node, key = opened[-1]
            if isinstance(node, list):
                node.append(value)
            else:
                node[key] = value
            at = skip(at)
            sign = text[at : at + 1]
            at += 1
            if sign == ",":
                at = skip(at)
                if isinstance(node, dict):
                    opened[-1][1], at = key_at(at)
                break
            if sign != ("]" if isinstance(node, list) else "}"):
                raise NotJson(f"no end at {at}")
            opened.pop()
            value = node
        else:
            if skip(at) != len(text):
                raise NotJson(f"more text at {at}")
            return value


def load(text: str) -> object:
    """The value of a JSON text; raises ``NotJson`` where it is none."""
    try:
        return json.loads(text, parse_constant=_reject)
    except (NotJson, json.JSONDecodeError) as error:
        raise NotJson(str(error)) from None
    except (RecursionError, ValueError):
        return _load_deep(text)


def load_object(text: str | None) -> dict | None:
    """The object that ``text`` holds, or None."""
    if text is None:
        return None
    try:
        value = load(text)
    except NotJson:
        return None
    return value if isinstance(value, dict) else None


def _number(value: object) -> object:
    return int(value) if isinstance(value, float) and value.is_integer() else value


class _Sign(str):
    """A piece of text that is written as it is."""


def _write(value: object, same: bool, compact: bool = False) -> str:
    comma, colon = (",", ":") if compact else (", ", ": ")
    out: list[str] = []
    todo: list[object] = [value]
    while todo:
        node = todo.pop()
        if isinstance(node, _Sign):
            out.append(node)
        elif isinstance(node, (dict, list)):
            entries = list(node.items()) if isinstance(node, dict) else [(None, x) for x in node]
            if same and isinstance(node, dict):
                entries = sorted(((k, x) for k, x in node.items() if x is not None), key=lambda e: e[0])
            parts: list[object] = [_Sign("{" if isinstance(node, dict) else "[")]
            for i, (key, x) in enumerate(entries):
                parts.append(_Sign((comma if i else "") + (json.dumps(key, ensure_ascii=same) + colon if key is not None else "")))
                parts.append(x)
            parts.append(_Sign("}" if isinstance(node, dict) else "]"))
            todo.extend(reversed(parts))
        else:
            out.append(json.dumps(_number(node) if same else node, ensure_ascii=same))
    return "".join(out)


def dump(value: object, compact: bool = False) -> str:
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":") if compact else None)
    except RecursionError:
        return _write(value, False, compact)


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return _number(value)


def canonical_text(value: object) -> str:
    """One text for all equal values: key order and null members of objects do not matter, and 1.0 equals 1."""
    try:
        return json.dumps(_plain(value), sort_keys=True)
    except RecursionError:
        return _write(value, True)


def clean(text: str) -> str:
    """``text`` without lone surrogates, which JSON escapes can spell and UTF-8 cannot."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def by_bytes(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices that hold at most ``limit`` bytes of a text column, and one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
