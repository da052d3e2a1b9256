"""Seeded samples and splits. Order comes from a hash of seed and id, so that it is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.stats import percent


def seeded_key(id_col: str, seed: str = "20260521"):
    return F.md5(F.concat(F.lit(seed + "|"), F.col(id_col).cast("string")))


def smallest(df: DataFrame, group: str, key: str, id_col: str, takes: DataFrame, take: str) -> DataFrame:
    """Of each group the rows with the `take` smallest hexadecimal keys, ties by id; takes: group (null-safe), take.

    The first three digits make 4,096 buckets: their counts tell which are taken whole, and only the one where the
    number is reached is ranked, so that a group of any size is spread over many tasks.
    """
    b = F.conv(F.substring(key, 1, 3), 16, 10).cast("int")
    d = df.withColumn("_b", b)
    per = d.groupBy(group, "_b").agg(F.count("*").alias("_m"))
    t = takes.select(F.col(group).alias("_g"), F.col(take).alias("_take"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", before).join(t, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_room", F.col("_take") - F.col("_before")).filter("_room > 0")
    per = per.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), "_room")
    x = d.join(per, d[group].eqNullSafe(per["_g"]) & (d["_b"] == per["_c"]))
    w = Window.partitionBy(group, "_b").orderBy(key, id_col)
    return x.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.col("_room")).drop("_b", "_g", "_c", "_room", "_rn")


def fraction_per_stratum(df: DataFrame, id_col: str, stratum: str, fraction: float = 0.05, seed: str = "20260521") -> DataFrame:
    """The same share of every stratum, rounded half to even; small strata may give no row."""
    n = df.groupBy(stratum).agg(F.bround(F.count("*") * F.lit(fraction)).cast("long").alias("_n"))
    return smallest(df.withColumn("_key", seeded_key(id_col, seed)), stratum, "_key", id_col, n, "_n").drop("_key")


def proportional_sample(df: DataFrame, id_col: str, stratum: str, total: int, seed: str = "20260521") -> DataFrame:
    """About `total` rows in proportion to the strata, at least one of each, cut to `total` at random if over; never filled up."""
    d = df.withColumn("_s", F.coalesce(F.col(stratum), F.lit("unclassified"))).withColumn("_key", seeded_key(id_col, seed))
    n = d.groupBy("_s").agg(F.count("*").alias("_n"))
    n = n.withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(1))))
    n = n.select("_s", F.greatest(F.lit(1), F.bround(F.lit(float(total)) * F.col("_n") / F.col("_all"))).cast("long").alias("_want"))
    picked = smallest(d, "_s", "_key", id_col, n, "_want")
    return picked.orderBy(F.md5(F.col("_key")), id_col).limit(total).drop("_s", "_key")


def prefix(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(*order).limit(n)


def drift(df: DataFrame, in_sample: str, dims: list[str]) -> DataFrame:
    """dimension, value, n_all, n_sample and their percentages: how a sample's make-up differs from the whole."""
    flat = df.select(F.col(in_sample).alias("s"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")) for d in dims])).alias("x"))
    g = flat.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n_all"), F.count_if("s").alias("n_sample"))
    w = Window.partitionBy("dimension")
    pct = lambda c: percent(F.col(c), F.sum(c).over(w))
    return g.select("dimension", "value", "n_all", "n_sample", pct("n_all").alias("pct_all"), pct("n_sample").alias("pct_sample"))
