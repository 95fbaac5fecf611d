"""Nodes of constrained-output schemas, read from the JSON text of a whole document at once."""

from __future__ import annotations

import json
import re

#: A node: its path, its kind, and what it constrains.
Node = tuple[tuple[str, ...], str, tuple[str | None, ...]]

_ABSENT = object()
#: Beyond these, Spark's JSON reader has limits of its own.
_MOST_LEVELS, _LONG_NAME = 400, re.compile(r'"[^"]{40000}')
_MOST_INT = 10 ** 15


def _unique(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a key comes twice")
    return found


def _refuse(text: str):
    raise ValueError(text)


_DECODER = json.JSONDecoder(object_pairs_hook=_unique, parse_float=_refuse, parse_constant=_refuse)


def _levels(value) -> int:
    """How deep a parsed document is, followed only as far as needed."""
    n, level = 0, [value]
    while level and n <= _MOST_LEVELS:
        n += 1
        level = [c for v in level if isinstance(v, (dict, list)) for c in (v.values() if isinstance(v, dict) else v)]
    return n


def _parsed(text: str | None) -> dict | None:
    if text is None or "\\" in text or len(text) > 40_000 and _LONG_NAME.search(text):
        return None
    try:
        found = _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None
    if type(found) is not dict or text.count("{") + text.count("[") > _MOST_LEVELS and _levels(found) > _MOST_LEVELS:
        return None
    return found


def _members(enum: list) -> tuple[str, ...] | None:
    """The sorted set of members as JSON texts."""
    found = set()
    for v in enum:
        if type(v) is str:
            found.add(f'"{v}"')
        elif type(v) is int and -_MOST_INT < v < _MOST_INT:
            found.add(str(v))
        else:
            return None
    return tuple(sorted(found))


def _type(value) -> str | None:
    """The text of a type; empty where it is none of the usual ones."""
    if type(value) is str:
        return value
    if type(value) is list and value and all(type(v) is str for v in value):
        return "[" + ",".join(f'"{v}"' for v in value) + "]"
    return ""


def plain_nodes(text: str | None, max_depth: int | None = None) -> list[Node] | None:
    """All nodes of a schema, or None where its text is no plain schema.

    Plain is a JSON object without escapes, fractions or repeated keys, whose
    nodes are objects with a list as ``enum``, objects as ``properties`` and
    ``items``, and a type by name; with *max_depth*, also one not deeper.  Readers
    agree on such a text.  What others make of the rest is theirs to say.
    """
    root = _parsed(text)
    if root is None:
        return None
    out: list[Node] = []
    todo: list[tuple[tuple[str, ...], dict]] = [((), root)]
    for path, node in todo:  # grows on the way
        if type(node) is not dict:
            return None
        get = node.get
        named = get("type", _ABSENT)
        if len(node) == 1 and type(named) is str and named:  # most nodes
            out.append((path, "type", (named,)))
            continue
        enum, props, items = get("enum", _ABSENT), get("properties", _ABSENT), get("items", _ABSENT)
        if enum is not _ABSENT and type(enum) is not list or props is not _ABSENT and type(props) is not dict or (
                items is not _ABSENT and type(items) is not dict):
            return None
        named = None if named is _ABSENT else _type(named)
        if named == "":
            return None
        if enum is not _ABSENT:
            members = _members(enum)
            if members is None:
                return None
            out.append((path, "enum", members))
        elif props is not _ABSENT or items is not _ABSENT:
            if max_depth is not None and len(path) >= max_depth:
                return None
            if props is not _ABSENT:
                out.append((path, "properties", tuple(props)))
                todo.extend([((*path, k), v) for k, v in props.items()])
            else:
                out.append((path, "items", ()))
                todo.append(((*path, "[]"), items))
        else:
            out.append((path, "type", (named,)))
    return out


def differences(found: dict[tuple, tuple[set, set, set]], versions: int, topmost: bool) -> list[tuple[tuple, str]]:
    """Paths whose nodes differ, from the versions, kinds and payloads each path has.

    With *topmost*, nothing below a path that differs.
    """
    bad: dict[tuple, str] = {}
    for path, (names, kinds, payloads) in found.items():
        if len(names) < versions:
            bad[path] = "absent in some version"
        elif len(kinds) > 1:
            bad[path] = "enum in some version only" if "enum" in kinds else "kind differs"
        elif len(payloads) > 1:
            kind = next(iter(kinds))
            bad[path] = {"enum": "enum members differ", "properties": "names or order differ"}.get(kind, "type differs")
    return [(p, why) for p, why in bad.items() if not (topmost and any(p[:n] in bad for n in range(len(p))))]
