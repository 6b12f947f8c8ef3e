"""Array expressions that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_by_first(rows: Column, key: Callable[[Column], Column], order: Callable[[Column], Column]) -> Column:
    """Distinct keys of an array of structs, by their least order, then by key."""
    seen = F.array_distinct(F.transform(rows, key))
    least = F.transform(seen, lambda k: F.struct(F.array_min(F.transform(F.filter(rows, lambda r: key(r) == k), order)).alias("o"), k.alias("k")))
    return F.transform(F.array_sort(least), lambda s: s["k"])


def without(values: Column, unwanted: Column) -> Column:
    """``values`` without members of ``unwanted``; duplicates and order stay, unlike array_except."""
    return F.filter(values, lambda x: ~F.array_contains(unwanted, x))


def contained_in(values: Column, allowed: Column) -> Column:
    """Whether every element is allowed; true for an empty array."""
    return F.forall(values, lambda x: F.array_contains(allowed, x))


def canonical(items: Column, evolved: dict[int, int]) -> Column:
    """From the first evolved item on, items become their base form and those
    that are there already are dropped; arrays without one stay as they are."""
    table = F.create_map(*[F.lit(x) for kv in evolved.items() for x in kv])
    base = F.transform(items, lambda i: F.coalesce(F.try_element_at(table, i), i))
    first = F.array_min(F.transform(F.array(*[F.array_position(items, F.lit(e)) for e in evolved]), lambda p: F.when(p > 0, p)))
    head, tail = F.slice(items, 1, (first - 1).cast("int")), F.slice(base, first.cast("int"), F.size(items))
    kept = F.aggregate(tail, head, lambda acc, i: F.when(F.array_contains(acc, i), acc).otherwise(F.array_append(acc, i)))
    return F.when(F.arrays_overlap(items, F.array(*[F.lit(e) for e in evolved])), kept).otherwise(items)


def pairs(codes: Column) -> Column:
    """Structs (a, b) with a < b of all unordered pairs of different codes of one array."""
    return F.flatten(F.transform(codes, lambda x: F.transform(F.filter(codes, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
