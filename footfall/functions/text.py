"""Small string and number functions of the domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def station_number(name: str | Column) -> Column:
    """The number after the last dash, or in brackets at the end; null without one."""
    found = F.coalesce(
        F.nullif(F.regexp_extract(name, r"-(\d+)$", 1), F.lit("")),
        F.nullif(F.regexp_extract(name, r"\((\d+)\)", 1), F.lit("")),
    )
    return found.cast("int")


def split_any(text: str | Column, separators: str, keep_empty: bool = False) -> Column:
    parts = F.split(text, "[" + "".join("\\" + c for c in separators) + "]")
    return parts if keep_empty else F.filter(parts, lambda p: p != "")


def numbers(text: str | Column, separators: str) -> Column:
    return F.transform(split_any(text, separators), lambda p: p.cast("double"))


def before_last(text: str | Column, mark: str = "_") -> Column:
    """The text before its last mark, or all of it."""
    return F.regexp_replace(text, f"{mark}[^{mark}]*$", "")


def direction(tag: str | Column) -> Column:
    tag = F.col(tag) if isinstance(tag, str) else tag
    return F.when(tag.contains("_OUT"), "TF").otherwise("FT")


def collapsed(text: str | Column) -> Column:
    """Runs of one character as one."""
    return F.regexp_replace(text, r"(.)\1+", "$1")


def first_time(text: str | Column, formats: Sequence[str]) -> Column:
    """The time by the first format that fits."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def stop_probability(x: Column, kind: str, *params: float) -> Column:
    if kind == "none":
        return F.lit(1.0)
    if kind == "exp":
        return F.exp(-x / params[0])
    if kind == "logistic":
        return 1 - 1 / (1 + F.exp(-params[0] * (x - params[1])))
    raise ValueError(f"no such distribution: {kind}")


def trip_length_density(x: Column, a: float = 7.5, b: float = 0.84, scale: float = 0.5) -> Column:
    """Density of trip lengths in km: exponential decay with a logistic start."""
    rise = F.exp(F.lit(a * scale)) + 1
    return b * F.exp(-b * x) * F.pow(rise / (1 + F.exp(-a * (x - scale))), b / a + 1) / rise


def binomial(n: Column, k: Column) -> Column:
    return (F.factorial(n) / F.factorial(k) / F.factorial(n - k)).cast("bigint")


def lower_bound(values: str | Column, x: Column) -> Column:
    """Place, from 0, of the first element that is x or more; null if there is none."""
    at = F.array_position(F.transform(values, lambda v: v >= x), F.lit(True))
    return F.when(at > 0, at - 1)


def inverted(mapping: str | Column) -> Column:
    """A map from one to many turned around: each member to its key."""
    return F.map_from_entries(
        F.flatten(
            F.transform(F.map_entries(mapping), lambda e: F.transform(e["value"], lambda v: F.struct(v, e["key"])))
        )
    )


def permutations(items: str | Column, most: int) -> Column:
    """All orders of 1 to ``most`` of an array's items, each a text joined by blanks; for short arrays."""
    items = F.col(items) if isinstance(items, str) else items
    every = last = F.transform(items, lambda x: F.array(x))
    for _ in range(most - 1):
        last = F.flatten(F.transform(last, lambda done: F.transform(F.filter(items, lambda x: ~F.array_contains(done, x)), lambda x: F.array_append(done, x))))
        every = F.concat(every, last)
    return F.transform(every, lambda x: F.array_join(x, " "))
