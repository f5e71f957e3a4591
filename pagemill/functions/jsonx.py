"""Rows and fields from JSON columns, by typed steps over VARIANT values.

A selection is an ARRAY<VARIANT>; steps map every hit to its next hits, as paths do.
"""

from __future__ import annotations

import itertools
import json
import sys
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Key:
    name: str


@dataclass(frozen=True)
class Index:
    i: int


@dataclass(frozen=True)
class Each:
    """All items of an array, or all values of an object (in key order)."""


@dataclass(frozen=True)
class Deep:
    """Values under this name at any depth, in document order; a hit is searched too. For :func:`find` and :func:`find_each` only."""

    name: str


def kind(v: Column) -> Column:
    """'array', 'object', 'string', 'number', 'boolean' or 'null'."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .otherwise("number")
    )


def truthy(v: Column) -> Column:
    """Present, and neither null, false, zero nor the empty string."""
    k = kind(v)
    s = F.try_variant_get(v, "$", "string")
    ok = (
        F.when(k == "string", s != "")
        .when(k == "boolean", s == "true")
        .when(k == "number", F.try_variant_get(v, "$", "double") != 0)
        .otherwise(k != "null")
    )
    return F.coalesce(v.isNotNull() & ok, F.lit(False))


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, "$['" + name + "']", "variant")


def _path(steps) -> str:
    return "$" + "".join(f"['{s.name}']" if isinstance(s, Key) else f"[{s.i}]" for s in steps)


def _fixed(step) -> bool:
    """A step that leads to one place only, so a native path can take it."""
    return isinstance(step, Key) or (isinstance(step, Index) and step.i >= 0)


def _fan_out(cur: Column, step) -> Column:
    if isinstance(step, Index):
        return F.transform(cur, lambda v: F.try_element_at(as_list(v), F.lit(step.i)))
    return F.flatten(
        F.transform(
            cur,
            lambda v: F.coalesce(
                as_list(v),
                F.map_values(F.try_variant_get(v, "$", "map<string,variant>")),
                F.array().cast("array<variant>"),
            ),
        )
    )


def _one(v: Column, steps) -> Column:
    return F.try_variant_get(v, _path(steps), "variant") if steps else v


def walk(v: Column, *steps) -> Column:
    """All hits of a path; runs of plain steps become one native path."""
    head = list(itertools.takewhile(_fixed, steps))
    cur = F.array_compact(F.array(_one(v, head)))
    rest = list(steps[len(head) :])
    while rest:
        cur = _fan_out(cur, rest.pop(0))
        run = list(itertools.takewhile(_fixed, rest))
        rest = rest[len(run) :]
        if run:
            cur = F.transform(cur, _follow(run))
        cur = F.filter(cur, lambda x: x.isNotNull())
    return cur


def _follow(run):
    return lambda x: _one(x, run)


def items(v: Column, *steps) -> Column:
    """List form: a single hit that is an array stands for its own items."""
    def pick(hits: Column) -> Column:
        one = F.get(hits, F.lit(0))
        none = F.array().cast("array<variant>")
        own = F.when(F.is_variant_null(one), none).otherwise(F.coalesce(as_list(one), hits))
        return F.when(F.size(hits) == 1, own).otherwise(hits)

    if all(map(_fixed, steps)):
        one = _one(v, steps)
        none = F.array().cast("array<variant>")
        return F.when(one.isNull() | F.is_variant_null(one), none).otherwise(F.coalesce(as_list(one), F.array(one)))
    return let(walk(v, *steps), pick)


def to_text(v: Column) -> Column:
    """'' for missing or null, plain text for scalars, JSON text for the rest."""
    return F.coalesce(F.when(~F.is_variant_null(v), v.cast("string")), F.lit(""))


def value(v: Column, *steps) -> Column:
    """Scalar form: one hit as text, several as a JSON list."""
    def pick(hits: Column) -> Column:
        many = F.concat(F.lit("["), F.array_join(F.transform(hits, lambda x: F.to_json(x)), ","), F.lit("]"))
        return F.when(F.size(hits) > 1, many).otherwise(to_text(F.get(hits, F.lit(0))))

    if all(map(_fixed, steps)):
        return to_text(_one(v, steps))
    return let(walk(v, *steps), pick)


def _deep(node, key: str) -> list:
    """Values under ``key`` in ``node``, in document order, without recursion."""
    found, todo = [], [node]
    while todo:
        v = todo.pop()
        if type(v) is tuple:  # a hit, which is searched too
            v = v[0]
            found.append(v)
        if type(v) is dict:
            for name in reversed(v):
                own = v[name]
                if name == key:
                    todo.append((own,))
                elif type(own) is dict or type(own) is list:
                    todo.append(own)
        elif type(v) is list:
            todo += [own for own in reversed(v) if type(own) is dict or type(own) is list]
    return found


_ENCODER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))


def _dump(v) -> str:
    return str(v) if type(v) is int else "null" if v is None else _ENCODER.encode(v)


def _hits(node, steps) -> list:
    """What a path leads to in a parsed document."""
    found = [node]
    for step in steps:
        onward: list = []
        for v in found:
            if isinstance(step, Deep):
                onward += _deep(v, step.name)
            elif isinstance(step, Key):
                onward += [v[step.name]] if isinstance(v, dict) and step.name in v else []
            elif isinstance(step, Index):
                onward += [v[step.i]] if isinstance(v, list) and -len(v) <= step.i < len(v) else []
            else:
                onward += v if isinstance(v, list) else v.values() if isinstance(v, dict) else []
        found = onward
    return found


def find_each(text: Column, paths: dict[str, tuple]) -> Column:
    """A struct with one field per path: JSON texts of all its hits, as an array in document order.

    The paths may go to any depth. VARIANT keeps the members of an object in key order, and a depth that is not known
    when the plan is made cannot be unfolded there, so these paths run over the text, in Arrow batches. A text is parsed
    once for all paths; one that is no JSON has no hits.
    """
    names, steps = [f"p{i}" for i in range(len(paths))], list(paths.values())

    def run(col: pd.Series) -> pd.DataFrame:
        def one(doc) -> list[list[str]]:
            try:
                node = json.loads(doc)
            except (TypeError, ValueError, RecursionError):
                return [[] for _ in steps]
            return [texts(node, path) for path in steps]

        def texts(node, path) -> list[str]:
            try:
                found = _hits(node, path)
            except (TypeError, ValueError, RecursionError):
                return []
            return [_dump(v) for v in found]

        return pd.DataFrame([one(doc) for doc in col], columns=names)

    found = F.pandas_udf(run, ", ".join(f"{n} array<string>" for n in names))(text)
    return found.cast("struct<" + ", ".join(f"`{n.replace('`', '``')}`: array<string>" for n in paths) + ">")


def find(text: Column, *steps) -> Column:
    """JSON texts of all hits of one path of :func:`find_each`, as an array in document order."""
    return find_each(text, {"hits": steps})["hits"]


def find_items(hits: Column) -> Column:
    """List form of :func:`find`: VARIANT items; a single hit that is an array stands for its own items."""
    none = F.array().cast("array<variant>")
    many = F.transform(hits, lambda x: F.parse_json(x))
    one = F.parse_json(F.get(hits, F.lit(0)))
    own = F.when(F.is_variant_null(one), none).otherwise(F.coalesce(as_list(one), many))
    return F.when(F.size(hits) == 1, own).otherwise(many)


def find_value(hits: Column) -> Column:
    """Scalar form of :func:`find`: one hit as text, several as a JSON list."""
    many = F.concat(F.lit("["), F.array_join(hits, ","), F.lit("]"))
    return F.when(F.size(hits) > 1, many).otherwise(to_text(F.parse_json(F.get(hits, F.lit(0)))))


def deep_find(text: Column, key: str) -> Column:
    """JSON text of every value stored under ``key`` at any depth, in document order."""
    return find(text, Deep(key))
