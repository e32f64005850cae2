"""Long cells to dense station vectors, and vector text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dense(entries: Column, size: int, kind: str = "double") -> Column:
    """``ARRAY<STRUCT<station, value>>`` (any order, one entry a station, null allowed) to a vector of length ``size``.

    Linear: the entries in order, each behind the zeros of its gap. A station outside 0..size-1 fails."""
    none = F.array().cast(f"array<struct<station:int,value:{kind}>>")

    def fill(known: Column) -> Column:
        zero = F.lit(0).cast(kind)
        before = lambda i: F.when(i > 0, F.get(known, i - 1)["station"]).otherwise(F.lit(-1))
        runs = F.transform(
            known, lambda e, i: F.concat(F.array_repeat(zero, e["station"] - before(i) - 1), F.array(F.coalesce(e["value"], zero)))
        )
        last = F.coalesce(F.try_element_at(known, F.lit(-1))["station"], F.lit(-1))
        first = F.coalesce(F.get(known, F.lit(0))["station"], F.lit(0))
        tail = F.when((first >= 0) & (last < size), F.array_repeat(zero, F.lit(size - 1) - last)).otherwise(
            F.raise_error(F.lit(f"a station code is outside 0..{size - 1}"))
        )
        return F.concat(F.flatten(runs), tail)

    ordered = F.array_sort(F.coalesce(entries.cast(f"array<struct<station:int,value:{kind}>>"), none))
    return F.transform(F.array(ordered), fill)[0]


def vector_text(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda v: v.cast("string")), ",")


def parse_vector(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda v: v.cast("double"))

