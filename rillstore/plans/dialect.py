"""Query texts of the embedded dialect in Spark's: names in double quotes, GLOB, and functions that differ.

The text is cut into quoted parts, names and marks; only what stands outside quotes changes. Reading
statements only: anything else is refused.
"""

from __future__ import annotations

import re

_PART = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|\w+|\s+|.", re.S)
# What a query may begin with.
READING = ("select", "with", "values", "explain", "describe", "show", "from", "table")


def glob(pattern: str) -> str:
    """A GLOB pattern (``*``, ``?``, ``[...]``, ``[^...]``; case counts) as a regular expression."""
    out, at = [], 0
    while at < len(pattern):
        c, end = pattern[at], pattern.find("]", at + 2)
        if c == "[" and end > 0:
            body = pattern[at + 1 : end]
            mark, body = ("^", body[1:]) if body[:1] == "^" else ("", body)
            out.append(f"[{mark}{re.sub(r'([\\[\\]&^])', r'\\\\\1', body)}]")
            at = end
        else:
            out.append({"*": r"[\s\S]*", "?": r"[\s\S]"}.get(c) or re.escape(c))
        at += 1
    return "^" + "".join(out) + "$"


def _arguments(parts: list[str], at: int) -> tuple[list[str], int]:
    """The arguments of the call whose bracket opens at ``at``, and the place after it."""
    depth, out, i = 0, [[]], at
    while i < len(parts):
        p = parts[i]
        if p == "(":
            depth += 1
        elif p == ")":
            depth -= 1
            if not depth:
                return ["".join(x).strip() for x in out], i + 1
        if p == "," and depth == 1:
            out.append([])
        elif not (p == "(" and depth == 1):
            out[-1].append(p)
        i += 1
    raise ValueError("a bracket is not closed")


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Each takes a call's arguments, already translated.
CALLS = {
    "total": lambda x: f"coalesce(CAST(sum({x}) AS DOUBLE), 0D)",
    "group_concat": lambda x, sep="','": f"listagg({x}, {sep})",
    "json_group_array": lambda x: f"to_json(collect_list({x}))",
    "json_group_object": lambda k, v: f"to_json(map_from_entries(collect_list(struct({k}, {v}))))",
    "iif": lambda c, a, b="NULL": f"CASE WHEN {c} THEN {a} ELSE {b} END",
    "typeof": lambda x: f"CASE WHEN ({x}) IS NULL THEN 'null' WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' WHEN typeof({x}) IN ('float', 'double') OR typeof({x}) LIKE 'decimal%' THEN 'real' WHEN typeof({x}) = 'binary' THEN 'blob' ELSE 'text' END",
    "json_extract": lambda s, path: f"get_json_object({s}, {path})",
}


def translate(sql: str) -> str:
    """The text for Spark; raises on statements that do not only read."""
    parts = _PART.findall(sql)
    first = next((p.lower() for p in parts if re.match(r"\w", p)), "")
    if first not in READING:
        raise ValueError(f"only queries are read here, not {first.upper() or 'an empty text'}")
    return _walk(parts)


def _walk(parts: list[str]) -> str:
    out, i = [], 0
    while i < len(parts):
        p = parts[i]
        low = p.lower()
        after = i + 1
        while after < len(parts) and parts[after].isspace():
            after += 1
        if p[0] == '"' and len(p) > 1:
            out.append("`" + p[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif low in CALLS and after < len(parts) and parts[after] == "(":
            arguments, i = _arguments(parts, after)
            out.append(CALLS[low](*[_walk(_PART.findall(a)) for a in arguments]))
            continue
        elif low == "glob" and after < len(parts) and parts[after][0] == "'":
            out.append("RLIKE " + _text(glob(parts[after][1:-1].replace("''", "'"))))
            i = after + 1
            continue
        else:
            out.append(p)
        i += 1
    return "".join(out)
