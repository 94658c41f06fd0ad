"""Nested JSON columns: paths, pointers, patches, records, CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators import graph


def pointer_path(pointer: str) -> str:
    """A JSON pointer as a path that Spark reads."""
    out = "$"
    for part in pointer.split("/")[1:]:
        name = part.replace("~1", "/").replace("~0", "~")
        out += f"[{name}]" if name.isdigit() else f"['{name}']"
    return out


def at_pointer(json: str | Column, pointer: str) -> Column:
    return F.get_json_object(json, pointer_path(pointer))


def has_pointer(json: str | Column, pointer: str) -> Column:
    return F.try_variant_get(F.parse_json(json), pointer_path(pointer), "variant").isNotNull()


def sliced(items: str | Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """[start:stop:step] of an array: places from 0, or from the end where negative; a negative step goes backwards."""
    if step == 0:
        raise ValueError("a slice has no step 0")
    items = F.col(items) if isinstance(items, str) else items
    n = F.size(items)
    low, high = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)

    def place(at: int | None, default: Column) -> Column:
        return default if at is None else F.least(F.greatest(F.lit(at) + (n if at < 0 else F.lit(0)), low), high)

    first, last = place(start, low if step > 0 else high), place(stop, high if step > 0 else low)
    last = last - (1 if step > 0 else -1)
    some = first <= last if step > 0 else first >= last
    places = F.when(some, F.sequence(first, F.when(some, last).otherwise(first), F.lit(step))).otherwise(F.slice(F.array(F.lit(0)), 1, 0))
    return F.transform(places, lambda i: F.get(items, i))


def picked(items: str | Column, *places: int) -> Column:
    """[a,b,...] of an array, without the places that it doesn't have; negative ones count from the end."""
    items = F.col(items) if isinstance(items, str) else items
    at = F.array(*(F.lit(p) + (F.size(items) if p < 0 else F.lit(0)) for p in places))
    return F.transform(F.filter(at, lambda i: (i >= 0) & (i < F.size(items))), lambda i: F.get(items, i))


def descendants(rows: DataFrame, document: str, name: str) -> DataFrame:
    """rows without the document, and value: each member of that name (``..name``) of a JSON text, at any depth, as JSON.

    Objects and arrays are taken apart one level in each round, until no row holds any; a null or broken text has no rows.
    """
    others = [c for c in rows.columns if c != document]
    at = rows.select(*others, F.try_parse_json(document).alias("_v"))
    found = []
    while True:
        spark = rows.sparkSession
        level = at.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(*others, "key", F.col("value").alias("_v"))
        level = graph._cut(level.select(*others, "key", F.to_json("_v").alias("value")))
        found.append(level.filter(F.col("key") == name).select(*others, "value"))
        inner = level.filter(F.substring("value", 1, 1).isin("{", "["))
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, found)
        at = inner.select(*others, F.parse_json("value").alias("_v"))


def patched(document: Column, operations: Column) -> Column:
    """A flat document (map of strings) after operations (array of struct op, path, from, value), or null if one fails.

    add, remove, replace, move, copy and test, on members of the top level; the fold stops counting at the first failure.
    """

    def without(m: Column, key: Column) -> Column:
        return F.map_filter(m, lambda k, _: k != key)

    def put(m: Column, key: Column, value: Column) -> Column:
        return F.map_concat(without(m, key), F.map_from_arrays(F.array(key), F.array(value)))

    def step(m: Column, o: Column) -> Column:
        key, origin, value = F.regexp_replace(o["path"], "^.", ""), F.regexp_replace(o["from"], "^.", ""), o["value"]
        has, has_origin = F.map_contains_key(m, key), F.map_contains_key(m, origin)
        failed = F.lit(None).cast("map<string,string>")
        return (
            F.when(m.isNull(), failed)
            .when(o["op"] == "add", put(m, key, value))
            .when((o["op"] == "replace") & has, put(m, key, value))
            .when((o["op"] == "remove") & has, without(m, key))
            .when((o["op"] == "move") & has_origin, put(without(m, origin), key, F.try_element_at(m, origin)))
            .when((o["op"] == "copy") & has_origin, put(m, key, F.try_element_at(m, origin)))
            .when((o["op"] == "test") & (F.try_element_at(m, key) == value), m)
            .otherwise(failed)
        )

    return F.aggregate(operations, document, step)


def differences(before: Column, after: Column) -> Column:
    """Operations that turn one flat document to another."""
    kind = lambda op, k, v: F.struct(F.lit(op).alias("op"), F.concat(F.lit("/"), k).alias("path"), v.alias("value"))
    gone = F.transform(F.array_sort(F.array_except(F.map_keys(before), F.map_keys(after))), lambda k: kind("remove", k, F.lit(None).cast("string")))
    new = F.transform(F.array_sort(F.array_except(F.map_keys(after), F.map_keys(before))), lambda k: kind("add", k, F.try_element_at(after, k)))
    common = F.filter(
        F.array_sort(F.array_intersect(F.map_keys(before), F.map_keys(after))), lambda k: F.try_element_at(before, k) != F.try_element_at(after, k)
    )
    return F.concat(gone, F.transform(common, lambda k: kind("replace", k, F.try_element_at(after, k))), new)
