"""Set similarities of arrays; 0 where either set is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column, over: Column) -> Column:
    hits = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(hits / over)


def jaccard(a: Column, b: Column) -> Column:
    return _ratio(a, b, F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """The share of a's distinct entries that b has."""
    return _ratio(a, b, F.greatest(F.size(F.array_distinct(a)), F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; entries beyond the shorter vector count 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
