"""JSON functions that change a document, Arrow-batched: set, insert, replace, remove, patch; and tree walks.

Paths are ``$.key[0].key``; ``[#]`` is one past an array's end, ``[#-1]`` its last item. Text that is not JSON gives null.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import functions as F

#: Stands before a value that is JSON, as ``json(...)`` gives it.
MARK = "\x00json:"
_STEP = re.compile(r'\.(?:"([^"]*)"|([^.\[\]]+))|\[(#?-?\d*)\]')


def steps(path: str) -> list[str | int | tuple[int]]:
    """Keys as text, places as numbers, places from the end as one-number tuples."""
    if not path.startswith("$"):
        raise ValueError(f"bad path {path!r}")
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if m is None:
            raise ValueError(f"bad path {path!r}")
        if m[3] is None:
            out.append(m[1] if m[1] is not None else m[2])
        else:
            out.append((int(m[3][1:] or 0),) if m[3].startswith("#") else int(m[3]))
        at = m.end()
    return out


def _change(doc: Any, path: list, value: Any, make: bool, overwrite: bool) -> Any:
    if not path:
        return value if overwrite else doc
    step, rest = path[0], path[1:]
    if isinstance(step, str):
        if not isinstance(doc, dict):
            return doc
        if step in doc:
            doc[step] = _change(doc[step], rest, value, make, overwrite)
        elif make:
            doc[step] = _change(*_blank(rest), value, make, True) if rest else value
        return doc
    if not isinstance(doc, list):
        return doc
    i = len(doc) + step[0] if isinstance(step, tuple) else step
    if 0 <= i < len(doc):
        doc[i] = _change(doc[i], rest, value, make, overwrite)
    elif i == len(doc) and make:
        doc.append(_change(*_blank(rest), value, make, True) if rest else value)
    return doc


def _blank(rest: list) -> tuple[Any, list]:
    return ({} if isinstance(rest[0], str) else []), rest


def _remove(doc: Any, path: list) -> Any:
    if not path:
        return None
    step, rest = path[0], path[1:]
    key = len(doc) + step[0] if isinstance(step, tuple) and isinstance(doc, list) else step
    there = isinstance(doc, dict) and isinstance(key, str) and key in doc or isinstance(doc, list) and isinstance(key, int) and 0 <= key < len(doc)
    if there:
        if rest:
            doc[key] = _remove(doc[key], rest)
        else:
            del doc[key]
    return doc


def patch(doc: Any, change: Any) -> Any:
    """A merge patch: objects merge, null removes, anything else replaces."""
    if not isinstance(change, dict):
        return change
    doc = dict(doc) if isinstance(doc, dict) else {}
    for k, v in change.items():
        if v is None:
            doc.pop(k, None)
        else:
            doc[k] = patch(doc.get(k), v)
    return doc


def tree(doc: Any, path: str = "$") -> list[tuple[str, str | None, str]]:
    """``(path, key, value)`` of every node, parents first."""
    out = [(path, None, json.dumps(doc, separators=(",", ":"), ensure_ascii=False))]
    items = doc.items() if isinstance(doc, dict) else enumerate(doc) if isinstance(doc, list) else ()
    for k, v in items:
        sub = tree(v, f"{path}.{k}" if isinstance(doc, dict) else f"{path}[{k}]")
        out += [(sub[0][0], str(k), sub[0][2]), *sub[1:]]
    return out


def _load(s: str | None) -> Any:
    return json.loads(s)


def _dump(x: Any) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def _safe(f, *args):
    try:
        return None if any(a is None for a in args) else f(*args)
    except ValueError:
        return None


def set_(s: str, path: str, value: str, make: bool = True, overwrite: bool = True) -> str:
    """Text is set as text, unless marked as JSON (by ``json(...)`` in SQL); numbers are set as numbers."""
    if not isinstance(value, str):
        own = value.item() if hasattr(value, "item") else value
        return _dump(_change(_load(s), steps(path), own, make, overwrite))
    own = _load(value.removeprefix(MARK)) if value.startswith(MARK) else value
    return _dump(_change(_load(s), steps(path), own, make, overwrite))


def register(spark) -> None:
    """``json(value)``, ``json_set/insert/replace(doc, path, text or json(value))``, ``json_remove(doc, path)``, ``json_patch(doc, change)``, ``json_tree(doc)``."""
    def three(make: bool, overwrite: bool):
        @F.pandas_udf("string")
        def run(s: pd.Series, p: pd.Series, v: pd.Series) -> pd.Series:
            return pd.Series([_safe(lambda *a: set_(*a, make, overwrite), *x) for x in zip(s, p, v, strict=True)])

        return run

    @F.pandas_udf("string")
    def remove(s: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([_safe(lambda a, b: _dump(_remove(_load(a), steps(b))), *x) for x in zip(s, p, strict=True)])

    @F.pandas_udf("string")
    def merge(s: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([_safe(lambda a, b: _dump(patch(_load(a), _load(b))), *x) for x in zip(s, c, strict=True)])

    @F.pandas_udf("array<struct<path:string,key:string,value:string>>")
    def walk(s: pd.Series) -> pd.Series:
        return pd.Series([_safe(lambda a: [{"path": p, "key": k, "value": v} for p, k, v in tree(_load(a))], x) for x in s])

    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION json(s STRING) RETURNS STRING RETURN concat('\\u0000json:', s)")
    spark.udf.register("json_set", three(True, True))
    spark.udf.register("json_insert", three(True, False))
    spark.udf.register("json_replace", three(False, True))
    spark.udf.register("json_remove", remove)
    spark.udf.register("json_patch", merge)
    spark.udf.register("json_tree", walk)
