"""Comparing runs query by query, and rollups over trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deltas(per_query: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """query_id, a, b, delta = b - a of two runs' metric; queries of only one run are left out."""
    x = join_runs(per_query, [a, b], metric).filter("missing = 0")
    return x.select("query_id", F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).withColumn("delta", F.col("b") - F.col("a"))


def join_runs(per_query: DataFrame, runs: list[str], metric: str) -> DataFrame:
    """query_id, one column of the metric per run (null where it lacks the query) and how many runs lack it. One pass over the runs."""
    cells = [F.max(F.when(F.col("run_id") == r, F.col(metric))).alias(r) for r in runs]
    x = per_query.filter(F.col("run_id").isin(runs)).groupBy("query_id").agg(*cells, F.countDistinct("run_id").alias("_n"))
    return x.withColumn("missing", (F.lit(len(runs)) - F.col("_n")).cast("int")).drop("_n")


def filtered_mean(delta_rows: DataFrame, queries: DataFrame, col: str, value: str) -> DataFrame:
    """n and the means of a, b and delta over the queries with a value of one column, such as one topic."""
    x = delta_rows.join(queries.filter(F.col(col) == value).select("query_id"), "query_id")
    return x.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("a", "b", "delta")])


def wins(delta_rows: DataFrame, queries: DataFrame, dims: list[str], margin: float = 0.05) -> DataFrame:
    """group_kind, group, n, wins, losses, flat, mean_delta overall and by each dimension. A change of the margin itself is a win or loss; flat lies strictly within."""
    kinds = F.array(F.struct(F.lit("overall").alias("kind"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("kind"), F.coalesce(F.col(d), F.lit("")).alias("value")) for d in dims])
    x = delta_rows.join(queries.select("query_id", *dims), "query_id").withColumn("g", F.explode(kinds))
    d = F.round("delta", 9)
    return x.groupBy(F.col("g.kind").alias("group_kind"), F.col("g.value").alias("group")).agg(
        F.count("*").alias("n"), F.count_if(d >= margin).alias("wins"), F.count_if(d <= -margin).alias("losses"), F.count_if(F.abs(d) < margin).alias("flat"), F.round(F.avg("delta"), 6).alias("mean_delta")
    )


def largest(delta_rows: DataFrame, n: int = 20) -> DataFrame:
    """The n queries with the largest absolute change, ties by query, with a mark for rise, fall or neither."""
    d = F.round("delta", 9)
    return delta_rows.orderBy(F.desc(F.abs(d)), "query_id").limit(n).withColumn("mark", F.when(d > 0, "+").when(d < 0, "-").otherwise("="))


def oracle_mean(per_query: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """n and the mean of the better of two runs per query."""
    return deltas(per_query, a, b, metric).agg(F.count("*").alias("n"), F.round(F.avg(F.greatest("a", "b")), 6).alias("oracle"))


def best_trial(groups: DataFrame, metric: str, trials: list[str]) -> DataFrame:
    """run_id and metric of the best overall row; of equal ones the first in the order of the trials. One row per trial comes to the window."""
    w = Window.orderBy(F.desc(metric), F.array_position(F.array(*map(F.lit, trials)), F.col("run_id")))
    return groups.filter("group_kind = 'overall'").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("run_id", metric)


def side_by_side(ranking: DataFrame, qrels: DataFrame, runs: list[str], k: int = 10) -> DataFrame:
    """query_id, rank and each run's document with its judgment ('' if none), for the first k ranks."""
    r = ranking.filter(F.col("rank") <= k).join(qrels, ["query_id", "doc_id"], "left")
    cells = [F.max(F.when(F.col("run_id") == run, F.concat_ws("|", "doc_id", F.coalesce(F.col("score_").cast("string"), F.lit(""))))).alias(run) for run in runs]
    return r.withColumn("score_", qrels["score"]).groupBy("query_id", "rank").agg(*cells)


def pivot_metric(groups: DataFrame, metric: str, runs: list[str]) -> DataFrame:
    """group_kind, group and one column per run; groups that only some runs have show null for the others."""
    return groups.groupBy("group_kind", "group").pivot("run_id", runs).agg(F.max(metric))
