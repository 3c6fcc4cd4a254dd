"""Folds over arrays that give something for every item, in linear time and inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being worked out once, however often use mentions it, in lambdas too."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], out: str) -> Column:
    """The array of what step gives for each item: step(state, item) returns struct(state AS s, output AS o); out is the output's type.

    An array that grows by one item is copied whole each time, so outputs are gathered in parts of 128 and joined at the end.
    Null items give null, an empty array an empty one.
    """
    none = F.array().cast(f"array<{out}>")

    def part(state: Column, some: Column) -> Column:
        return F.aggregate(some, F.struct(state.alias("s"), none.alias("o")), lambda a, x: let(step(a["s"], x), lambda r: F.struct(r["s"].alias("s"), F.array_append(a["o"], r["o"]).alias("o"))))

    def whole(all_items: Column) -> Column:
        count = F.size(all_items)
        starts = F.when(count > 0, F.sequence(F.lit(1), count, F.lit(PART))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda k: F.slice(all_items, k, F.lit(PART)))
        first = F.struct(start.alias("s"), F.array().cast(f"array<array<{out}>>").alias("o"))
        return F.flatten(F.aggregate(parts, first, lambda a, some: let(part(a["s"], some), lambda r: F.struct(r["s"].alias("s"), F.array_append(a["o"], r["o"]).alias("o"))), lambda a: a["o"]))

    return let(items, lambda i: F.when(i.isNotNull(), whole(i)))


def splice(text: Column, spans: Column, replacement: str = "") -> Column:
    """The text with each of the spans (a sorted array of structs with start and stop, code points) replaced; what two spans share is
    replaced once. The text is taken apart once, so the work is linear in it."""
    gap = lambda at, m: F.struct(F.greatest(at, m["stop"].cast("int")).alias("s"), F.struct(at.alias("start"), F.greatest(at, m["start"].cast("int")).alias("stop")).alias("o"))
    between = lambda letters, a, b: F.array_join(F.slice(letters, a + 1, b - a), "")

    def put(letters: Column) -> Column:
        def joined(gaps: Column) -> Column:
            last = F.coalesce(F.array_max(F.transform(spans, lambda m: m["stop"].cast("int"))), F.lit(0))
            kept = F.transform(gaps, lambda g: F.concat(between(letters, g["start"], g["stop"]), F.lit(replacement)))
            return F.array_join(F.concat(kept, F.array(F.array_join(F.slice(letters, last + 1, F.greatest(F.size(letters) - last, F.lit(0))), ""))), "")

        return let(scan(spans, F.lit(0), gap, "struct<start: int, stop: int>"), joined)

    return F.when(text.isNotNull(), let(F.split(text, ""), put))
