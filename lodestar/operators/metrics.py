"""Ranking metrics: graded (MRR, nDCG, precision, recall) and binary (accuracy, MAP), per query and in groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def graded(run: DataFrame, qrels: DataFrame, runs: list[str] | None = None) -> DataFrame:
    """One row per run_id and judged query: mrr (first document of score 2), ndcg_5, ndcg_10 (linear gain, log2 discount, ideal of all
    judgments), p_5, p_10, r_10, r_20 (score 1 and above). Judged queries without results have zeros in every run.

    run: run_id, query_id, rank, doc_id; qrels: query_id, doc_id, score. runs: the labels, if known; else the run is made twice to learn
    them. Per-query sums only; no list of results is built.
    """
    qrels = qrels.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ideal = qrels.withColumn("i", F.row_number().over(w))
    gain = lambda c, at, k: F.sum(F.when(F.col(at) <= k, F.col(c) / F.log2(F.col(at) + 1)).otherwise(0.0))
    ideals = ideal.groupBy("query_id").agg(gain("score", "i", 5).alias("idcg_5"), gain("score", "i", 10).alias("idcg_10"), F.count_if(F.expr("score >= 1")).alias("relevant"))
    hit = lambda k: F.count_if((F.col("rank") <= k) & (F.col("score") >= 1))
    per = run.select("run_id", "query_id", "rank", "doc_id").join(qrels, ["query_id", "doc_id"]).groupBy("run_id", "query_id").agg(
        F.min(F.when(F.col("score") == 2, F.col("rank"))).alias("first"), gain("score", "rank", 5).alias("dcg_5"), gain("score", "rank", 10).alias("dcg_10"),
        hit(5).alias("h_5"), hit(10).alias("h_10"), hit(20).alias("h_20"),
    )
    if runs is None:
        every = run.select("run_id").distinct().withColumn("_k", F.lit(1)).join(ideals.withColumn("_k", F.lit(1)), "_k").drop("_k")
    else:
        every = ideals.withColumn("run_id", F.explode(F.array(*map(F.lit, runs))))
    x = every.join(per, ["run_id", "query_id"], "left")
    safe = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b)).otherwise(0.0)
    z = lambda c, k: F.coalesce(F.col(c), F.lit(0)) / F.lit(float(k))
    return x.select(
        "run_id", "query_id", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), safe("dcg_5", "idcg_5").alias("ndcg_5"), safe("dcg_10", "idcg_10").alias("ndcg_10"),
        z("h_5", 5).alias("p_5"), z("h_10", 10).alias("p_10"), safe("h_10", "relevant").alias("r_10"), safe("h_20", "relevant").alias("r_20"),
    )


METRICS = ("mrr", "ndcg_5", "ndcg_10", "p_5", "p_10", "r_10", "r_20")


def grouped(per_query: DataFrame, queries: DataFrame, dims: list[str]) -> DataFrame:
    """Mean metrics per run overall and by each dimension: run_id, group_kind, group, n, metrics. queries: query_id and the dimensions."""
    kinds = F.array(F.struct(F.lit("overall").alias("kind"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("kind"), F.coalesce(F.col(d), F.lit("")).alias("value")) for d in dims])
    x = per_query.join(queries.select("query_id", *dims), "query_id").withColumn("g", F.explode(kinds))
    return x.groupBy("run_id", F.col("g.kind").alias("group_kind"), F.col("g.value").alias("group")).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def report(run: DataFrame, qrels: DataFrame, queries: DataFrame, dims: list[str], runs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(means overall and by each dimension, metrics per query with its dimensions): a scored model's whole report."""
    per = graded(run, qrels, runs).persist()
    return grouped(per, queries, dims), per.join(queries.select("query_id", *dims), "query_id")


def val_rows(pairs: DataFrame, positive: str, id_col: str = "opinion_id", order: str = "pair_id") -> DataFrame:
    """doc_id, question, positive of the validation slice, which is its own corpus: rows without the positive column are left out; of an opinion delivered again the last row counts."""
    w = Window.partitionBy(id_col).orderBy(F.desc(order))
    p = pairs.filter(F.col(id_col).isNotNull() & (F.length(F.coalesce(F.col(positive), F.lit(""))) > 0))
    return p.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(F.col(id_col).alias("doc_id"), "question", F.col(positive).alias("positive"))


def binary(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Mean accuracy at 1, 3, 5, precision and recall at 5, 10, nDCG and MRR at 5, 10 and MAP at 100 of a run over all judged queries.

    run: query_id, rank, doc_id; qrels: query_id, doc_id of the relevant documents.
    """
    rel = qrels.select("query_id", "doc_id").distinct()
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query_id").orderBy("rank")
    hits = run.join(rel, ["query_id", "doc_id"]).withColumn("i", F.row_number().over(w))
    per = hits.join(n_rel, "query_id").groupBy("query_id", "n").agg(
        F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"h_{k}") for k in (5, 10)], *[F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}") for k in (5, 10)],
        F.sum(F.when(F.col("rank") <= 100, F.col("i") / F.col("rank")).otherwise(0.0)).alias("ap"),
    )
    x = n_rel.join(per.drop("n"), "query_id", "left")
    first = F.coalesce("first", F.lit(10**9))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return x.agg(
        F.count("*").alias("n_queries"), *[mean((first <= k).cast("double"), f"accuracy_{k}") for k in (1, 3, 5)], *[mean(z(f"h_{k}") / k, f"precision_{k}") for k in (5, 10)], *[mean(z(f"h_{k}") / F.col("n"), f"recall_{k}") for k in (5, 10)],
        *[mean(z(f"dcg_{k}") / ideal(k), f"ndcg_{k}") for k in (5, 10)], *[mean(F.when(first <= k, 1 / first).otherwise(0.0), f"mrr_{k}") for k in (5, 10)], mean(z("ap") / F.least(F.col("n"), F.lit(100)), "map_100"),
    )


def gold_ranks(run: DataFrame, qrels: DataFrame, missing: int = 99999) -> DataFrame:
    """Per query: best rank of a score-2 document, score-2 documents within 100, judged ones (1 and above) within 100 and 1000. Unranked ones count as `missing`."""
    x = qrels.filter("score >= 1").join(run.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left").withColumn("rank", F.coalesce("rank", F.lit(missing)))
    return x.groupBy("query_id").agg(
        F.coalesce(F.min(F.when(F.col("score") == 2, F.col("rank"))), F.lit(missing)).alias("best_rank"), F.count_if(F.expr("score = 2 AND rank <= 100")).alias("gold2_100"),
        F.count_if(F.expr("rank <= 100")).alias("any_100"), F.count_if(F.expr("rank <= 1000")).alias("any_1000"),
    )
