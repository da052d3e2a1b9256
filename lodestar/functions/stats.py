"""Aggregates with the exact rank rules of the reports: nearest rank by floor, exclusive quartiles, share with a guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / F.when(whole != 0, whole), digits))


def rank_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, p10, p50, p90, p99 (the entry at floor(n p) from 0), max and mean of a value by keys; nulls are left out.

    Equal values are counted first, in every task before the shuffle, so a key of any number of rows comes to the
    window as its distinct values only. The exclusive quartiles q1, median and q3 (the quartiles null below four values)
    take the neighbours at (n + 1) p.
    """
    d = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v")).groupBy(*keys, "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    d = d.withColumn("to", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    here = lambda i: (F.col("to") - F.col("c") <= i) & (i < F.col("to"))
    at = lambda i: F.max(F.when(here(i), F.col("v")))

    def exclusive(p: float) -> Column:
        # place (n + 1) p counted from 1, kept between the first and the last pair
        lo = F.least(F.greatest(F.floor((F.col("n") + 1) * p), F.lit(1)), F.col("n") - 1)
        frac = (F.col("n") + 1) * p - lo
        weight = F.when(here(lo - 1), 1 - frac).otherwise(0.0) + F.when(here(lo), frac).otherwise(0.0)
        return F.when(F.max("n") >= 4, F.sum(weight * F.col("v")))

    middle = (at(F.floor((F.col("n") - 1) / 2).cast("long")) + at(F.floor(F.col("n") / 2).cast("long"))) / 2
    out = d.groupBy(*keys) if keys else d
    return out.agg(
        F.max("n").alias("n"), *[at(F.floor(F.col("n") * p).cast("long")).alias(name) for name, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p99", 0.99))],
        F.max("v").alias("max"), F.min("v").alias("min"), (F.sum(F.col("v") * F.col("c")) / F.max("n")).alias("mean"), exclusive(0.25).alias("q1"), middle.alias("median"), exclusive(0.75).alias("q3"),
    )
