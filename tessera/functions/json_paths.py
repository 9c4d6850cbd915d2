"""Values and leaf paths of JSON text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_path(document: Column, path: str | Column) -> Column:
    """The value at a dotted path (fixed or a column) with optional ``[i]`` after a name; null if
    it isn't there or the path is empty."""
    p = path if isinstance(path, Column) else F.lit(path)
    return F.when(p != "", F.call_function("get_json_object", document, F.concat(F.lit("$."), p)))


def leaf_paths(value, depth: int = 6) -> list[str]:
    """Paths of all scalars, following the first element of each list, down to ``depth`` levels."""
    found: list[str] = []
    stack = [(value, "", depth)]
    while stack:
        v, path, left = stack.pop()
        if isinstance(v, dict):
            inner = [(x, f"{path}.{k}" if path else k) for k, x in v.items()]
        elif isinstance(v, list):
            inner = [(x, f"{path}[0]") for x in v[:1]]
        else:
            if path:
                found.append(path)
            continue
        if left > 0:
            stack += [(x, p, left - 1) for x, p in reversed(inner)]
    return found


def json_leaf_paths(documents: Column | str, depth: int = 6) -> Column:
    """As :func:`leaf_paths`, by columns over VARIANT values, the names of an object in their
    order as strings; malformed or null text has none."""
    text = F.col(documents) if isinstance(documents, str) else documents
    names = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    items = lambda v: F.try_variant_get(v, "$", "array<variant>")
    node = lambda path, v: F.struct(path.alias("path"), v.alias("v"))

    def inner(n: Column) -> Column:
        under = lambda key: F.when(n["path"] == "", key).otherwise(F.concat(n["path"], F.lit("."), key))
        first = F.transform(F.slice(items(n["v"]), 1, 1), lambda x: node(F.concat(n["path"], F.lit("[0]")), x))
        inside = F.transform(F.map_entries(names(n["v"])), lambda e: node(under(e["key"]), e["value"]))
        return F.coalesce(inside, first, F.array(n))

    level = F.array(node(F.lit(""), F.try_parse_json(text)))
    for _ in range(depth):
        level = F.flatten(F.transform(level, inner))
    leaves = F.filter(level, lambda n: (n["path"] != "") & names(n["v"]).isNull() & items(n["v"]).isNull())
    return F.transform(leaves, lambda n: n["path"])


def json_object_in(text: Column) -> Column:
    """The part from the first ``{`` to the last ``}``, for parsing noisy answers; null if none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def safe_name(text: str) -> str:
    return re.sub(r"[\\/]+", "_", text)
