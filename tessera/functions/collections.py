"""Array, map and JSON operators as expressions on array, map and text columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import partial
from itertools import groupby
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import all_of, any_of, col


# arrays
def element(a: str | Column, i: int) -> Column:
    """The i-th element from 1; null beyond the ends."""
    return F.get(col(a), F.lit(i - 1))


def piece(a: str | Column, first: int, last: int) -> Column:
    """Elements first to last, both included, from 1."""
    return F.slice(col(a), first, last - first + 1)


def contains(a: str | Column, b: Column) -> Column:
    """Whether every element of b is in a."""
    return F.size(F.array_except(b, col(a))) == 0


def length(a: str | Column, dimension: int = 1) -> Column:
    """The number of elements in a dimension, by the first element of each one above; null where there is none."""
    a = col(a)
    for _ in range(dimension - 1):
        a = F.get(a, F.lit(0))
    return F.when(F.size(a) > 0, F.size(a))


def compares_all(value: Any, how: Callable[[Column, Column], Column], a: str | Column) -> Column:
    """value how ALL (a), with how from ``operator``: true for no element, null if only a null stands against it."""
    return F.forall(col(a), lambda x: how(value if isinstance(value, Column) else F.lit(value), x))


def compares_any(value: Any, how: Callable[[Column, Column], Column], a: str | Column) -> Column:
    """value how ANY (a): false for no element, null if only a null might fit."""
    return F.exists(col(a), lambda x: how(value if isinstance(value, Column) else F.lit(value), x))


def dimensions(a: str | Column, depth: int) -> Column:
    """The lengths of an array nested to this depth, from the outside, such as [2][3]."""
    return F.concat(*(F.concat(F.lit("["), length(a, d + 1).cast("string"), F.lit("]")) for d in range(depth)))


def replaced(a: str | Column, old: Any, new: Any) -> Column:
    return F.transform(col(a), lambda x: F.when(x.eqNullSafe(F.lit(old)), F.lit(new)).otherwise(x))


def sorted_by(a: str | Column, descending: bool = False, nulls_first: bool = False) -> Column:
    """Sorted, with the nulls where they are wanted."""
    known = F.sort_array(F.filter(col(a), lambda x: x.isNotNull()), asc=not descending)
    nulls = F.filter(col(a), lambda x: x.isNull())
    return F.concat(nulls, known) if nulls_first else F.concat(known, nulls)


# maps
def merged(a: str | Column, b: str | Column) -> Column:
    """Both maps; where both have a key, the right one's value."""
    mine = F.map_filter(col(a), lambda k, v: ~F.map_contains_key(col(b), k))
    return F.map_concat(mine, col(b))


def without_keys(m: str | Column, *keys: str) -> Column:
    return F.map_filter(col(m), lambda k, v: ~k.isin(*keys))


def only_keys(m: str | Column, *keys: str) -> Column:
    return F.map_filter(col(m), lambda k, v: k.isin(*keys))


def has_all(m: str | Column, *keys: str) -> Column:
    return all_of(F.map_contains_key(col(m), k) for k in keys)


def has_any(m: str | Column, *keys: str) -> Column:
    return any_of(F.map_contains_key(col(m), k) for k in keys)


def map_contains(a: str | Column, b: str | Column) -> Column:
    """Whether each entry of b is in a."""
    return F.forall(F.map_entries(col(b)), lambda e: F.element_at(F.map_filter(col(a), lambda k, v: k == e.key), e.key).eqNullSafe(e.value))


def defined(m: str | Column, key: str) -> Column:
    """Whether the key is there with a value that is not null."""
    return F.exists(F.map_entries(col(m)), lambda e: (e.key == key) & e.value.isNotNull())


def flat(m: str | Column) -> Column:
    """Keys and values in turn."""
    return F.flatten(F.transform(F.map_entries(col(m)), lambda e: F.array(e.key, e.value)))


def matrix(m: str | Column) -> Column:
    """An array of key and value for each entry."""
    return F.transform(F.map_entries(col(m)), lambda e: F.array(e.key, e.value))


def record(m: str | Column, **types: str) -> Column:
    """A struct of these members, cast to their types; null where the key is missing or does not fit."""
    return F.struct(*(F.try_element_at(col(m), F.lit(k)).try_cast(kind).alias(k) for k, kind in types.items()))


def pairs(keys: str | Column, values: str | Column) -> Column:
    """A map from an array of keys and one of values."""
    return F.map_from_arrays(col(keys), col(values))


# JSON texts: values keep their types, for what is changed passes as variants
def json_path(*keys: str | int) -> str:
    """Names that are no plain words are quoted."""
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f".{k}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", k) else f"['{k}']" for k in keys)


def json_text(j: str | Column, *keys: str | int) -> Column:
    return F.get_json_object(col(j), json_path(*keys))


def json_exists(j: str | Column, *keys: str | int) -> Column:
    return F.try_variant_get(F.try_parse_json(col(j)), json_path(*keys), "variant").isNotNull()


def json_value(value: Any) -> Column:
    """A variant from a column of a simple type or from a Python value."""
    return value.cast("variant") if isinstance(value, Column) else F.parse_json(F.lit(json.dumps(value)))


def json_members(j: str | Column) -> Column:
    """The members of an object as a map to variants."""
    return F.from_json(col(j), "map<string,variant>")


def json_elements(j: str | Column) -> Column:
    """The elements of an array as an array of variants."""
    return F.from_json(col(j), "array<variant>")


def json_set(j: str | Column, **values: Any) -> Column:
    """The object with members put in or replaced."""
    return F.to_json(merged(json_members(j), F.create_map(*(x for k, v in values.items() for x in (F.lit(k), json_value(v))))))


def json_remove(j: str | Column, *keys: str) -> Column:
    return F.to_json(without_keys(json_members(j), *keys))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _applied(held: Column, steps: list[tuple]) -> Column:
    """A map or an array of variants after steps (path, change), one after another.

    change(old variant, or null if there is none) gives the new one; null takes it out.  Steps into the same member are
    made together, so that it is opened once; members don't meet, but indices move, so steps into an array are made alone.
    """
    last = {path[0]: i for i, (path, _) in enumerate(steps)}
    if all(isinstance(key, str) for key in last):
        steps = sorted(steps, key=lambda step: last[step[0][0]])
        runs = [list(run) for _, run in groupby(steps, lambda step: step[0][0])]
    else:
        runs = [[step] for step in steps]
    for run in runs:
        held = _let(held, partial(_put, run[0][0][0], [(path[1:], change) for path, change in run]))
    return held


def _put(key: str | int, steps: list[tuple], held: Column) -> Column:
    """A map or an array with steps made in the value at a key."""
    new = F.get(held, F.lit(key)) if isinstance(key, int) else F.try_element_at(held, F.lit(key))
    for kind, run in groupby(steps, lambda step: type(step[0][0]) if step[0] else None):
        if kind is None:
            for _, change in run:
                new = change(new)
        else:
            inner = F.try_variant_get(new, "$", "array<variant>") if kind is int else _members(new)
            new = F.to_variant_object(_applied(inner, list(run)))
    if isinstance(key, int):
        head, tail = F.slice(held, F.lit(1), F.lit(key)), F.slice(held, F.lit(key + 2), F.greatest(F.size(held), F.lit(1)))
        made = _let(new, lambda x: F.when(x.isNull(), F.concat(head, tail)).otherwise(F.concat(head, F.array(x), tail)))
        return F.when(F.size(held) <= key, held).otherwise(made)
    others = without_keys(held, key)
    return _let(new, lambda x: F.when(x.isNull(), others).otherwise(F.map_concat(others, F.create_map(F.lit(key), x))))


def json_changes(j: str | Column, *steps: tuple) -> Column:
    """Steps one after another: ("set" | "insert" | "replace", path, value) or ("delete", path); the text is read and written once."""

    def change(how: str, value: Any = None) -> Callable[[Column], Column]:
        new = None if how == "delete" else json_value(value)
        return {
            "set": lambda old: new,
            "insert": lambda old: F.coalesce(old, new),
            "replace": lambda old: F.when(old.isNotNull(), new),
            "delete": lambda old: F.lit(None).cast("variant"),
        }[how]

    opened = json_elements(j) if isinstance(steps[0][1][0], int) else json_members(j)
    return F.to_json(_applied(opened, [(tuple(path), change(how, *value)) for how, path, *value in steps]))


def json_set_path(j: str | Column, path: list[str | int], value: Any) -> Column:
    """The value at a path put in or replaced; what leads there must exist."""
    return json_changes(j, ("set", path, value))


def json_insert(j: str | Column, path: list[str | int], value: Any) -> Column:
    """A value put in where there is none."""
    return json_changes(j, ("insert", path, value))


def json_replace(j: str | Column, path: list[str | int], value: Any) -> Column:
    """A value replaced where there is one."""
    return json_changes(j, ("replace", path, value))


def json_delete_path(j: str | Column, path: list[str | int]) -> Column:
    return json_changes(j, ("delete", path))


def json_concat(a: str | Column, b: str | Column) -> Column:
    """Both objects' members; where both have a name, the right one's."""
    return F.to_json(merged(json_members(a), json_members(b)))


def json_patch(j: str | Column, patch: dict) -> Column:
    """Merge patch: nulls take members out, objects change members within, anything else replaces them."""

    def merged_into(members: Column, new: dict) -> Column:
        return _applied(F.coalesce(members, F.create_map().cast("map<string,variant>")), [((key,), partial(patched, value)) for key, value in new.items()])

    def patched(new: Any, old: Column) -> Column:
        if new is None:
            return F.lit(None).cast("variant")
        return F.to_variant_object(merged_into(_members(old), new)) if isinstance(new, dict) else json_value(new)

    if not isinstance(patch, dict):
        out = F.lit(json.dumps(patch))
    elif patch:
        out = F.to_json(merged_into(json_members(j), patch))
    else:
        out = F.when(col(j).rlike(r"^\s*\{"), col(j)).otherwise("{}")
    return F.when(is_json(j), out)


def json_contains(a: str | Column, b: str | Column) -> Column:
    """Whether every member of b is a member of a with the same value (values are compared whole)."""
    texts = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e.key.alias("k"), F.to_json(e.value).alias("v")))
    return F.size(F.array_except(texts(json_members(b)), texts(json_members(a)))) == 0


def json_keys(j: str | Column) -> Column:
    return F.json_object_keys(col(j))


def json_has_all(j: str | Column, *keys: str) -> Column:
    return all_of(F.array_contains(json_keys(j), k) for k in keys)


def json_has_any(j: str | Column, *keys: str) -> Column:
    return any_of(F.array_contains(json_keys(j), k) for k in keys)


def json_contained_by(a: str | Column, b: str | Column) -> Column:
    return json_contains(b, a)


def json_array_length(j: str | Column) -> Column:
    return F.json_array_length(col(j))


def json_strip_nulls(j: str | Column) -> Column:
    """The object without members that are null."""
    return F.to_json(F.map_filter(json_members(j), lambda k, v: ~F.is_variant_null(v)))


def json_query(j: str | Column, path: str) -> Column:
    """What a path with wildcards ($.a[*].b) finds, as JSON text."""
    return F.get_json_object(col(j), path)


def json_path_exists(j: str | Column, path: str) -> Column:
    return json_query(j, path).isNotNull()


def json_table(df: DataFrame, column: str, path: str, **types: str) -> DataFrame:
    """A row for each element of the array at a path, with members of the given types; what does not fit is null."""
    items = df.select("*", F.explode(json_elements(json_query(column, path))).alias("_item"))
    return items.select(*df.columns, *(F.try_variant_get("_item", json_path(name), kind).alias(name) for name, kind in types.items()))


def json_pretty(j: str | Column) -> Column:
    return F.to_json(F.try_parse_json(col(j)), {"pretty": "true"})


def is_json(j: str | Column) -> Column:
    return col(j).isNotNull() & F.try_parse_json(col(j)).isNotNull()


def json_type(j: str | Column, *keys: str | int) -> Column:
    """object, array, string, number, boolean or null of what a path leads to."""
    v = F.try_variant_get(F.try_parse_json(col(j)), json_path(*keys), "variant")
    kind = F.schema_of_variant(v)
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )
