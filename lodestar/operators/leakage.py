"""Lexical leakage of evaluation queries into the opinions judged for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.stats import rank_stats
from lodestar.functions.similarity import jaccard, overlap
from lodestar.functions.text import char_ngrams, leakage_tokens

MEASURES = ("token_jaccard", "char_jaccard_5", "query_overlap")
THRESHOLDS = (0.3, 0.5, 0.7, 0.85, 0.95)


def judgments(queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score from the nested judgments."""
    return queries.select("query_id", F.explode("relevance_judgments").alias("j")).select("query_id", F.col("j.opinion_id").alias("doc_id"), F.col("j.score").alias("score"))


def measure(queries: DataFrame, qrels: DataFrame, opinions: DataFrame) -> DataFrame:
    """query_id, query_type, doc_id, score and the three similarities of query text and question, rounded to 3 places, halves to even.

    opinions: doc_id, question. Judged opinions without a row have null similarities. Tokens and n-grams are made once
    per query and once per judged opinion, before the join.
    """
    q = queries.select("query_id", "query_type", leakage_tokens(F.col("query_text")).alias("qt"), char_ngrams(F.col("query_text")).alias("qg"))
    o = opinions.join(qrels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", leakage_tokens(F.col("question")).alias("ot"), char_ngrams(F.col("question")).alias("og"))
    x = qrels.join(q, "query_id").join(o, "doc_id", "left")
    some = lambda c: F.when(F.col("ot").isNotNull(), F.bround(c, 3))
    return x.select("query_id", "query_type", "doc_id", "score", some(jaccard(F.col("qt"), F.col("ot"))).alias("token_jaccard"), some(jaccard(F.col("qg"), F.col("og"))).alias("char_jaccard_5"), some(overlap(F.col("qt"), F.col("ot"))).alias("query_overlap"))


def best(measured: DataFrame, least: int) -> DataFrame:
    """query_id, query_type and the best of each measure over judgments of score `least` or more, null if there are none."""
    return measured.groupBy("query_id", "query_type").agg(*[F.max(F.when(F.col("score") >= least, F.col(m))).alias(m) for m in MEASURES])


def missing(qrels: DataFrame, opinions: DataFrame) -> DataFrame:
    """score, n, missing: the judgments of each score and how many judge an opinion that isn't there."""
    x = qrels.join(opinions.select("doc_id").distinct().withColumn("_in", F.lit(1)), "doc_id", "left")
    return x.groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("_in").isNull()).alias("missing"))


def summary(measured: DataFrame) -> DataFrame:
    """group_kind, group, measure, n, mean, median, p25, p75, max, min: the best of each measure per query at score 2 and at 1 and above, over all queries, and the query overlap at score 2 by query type. Rounded to 3 places; quartiles null below four values."""
    per = measured.groupBy("query_id", "query_type").agg(*[F.max(F.when(F.col("score") >= least, F.col(m))).alias(f"{m}_score{tag}") for m in MEASURES for least, tag in ((2, "2"), (1, "1plus"))])
    names = [f"{m}_score{tag}" for m in MEASURES for tag in ("2", "1plus")]
    row = lambda kind, group, name: F.struct(F.lit(kind).alias("group_kind"), group.alias("group"), F.lit(name).alias("measure"), F.col(name).alias("v"))
    rows = [row("overall", F.lit("all"), n) for n in names] + [row("query_type", F.col("query_type"), "query_overlap_score2")]
    got = rank_stats(per.select(F.explode(F.array(*rows)).alias("x")).select("x.*"), ["group_kind", "group", "measure"], "v")
    r = lambda c, name: F.bround(F.round(c, 6), 3).alias(name)
    return got.select("group_kind", "group", "measure", "n", r("mean", "mean"), r("median", "median"), r("q1", "p25"), r("q3", "p75"), r("max", "max"), r("min", "min"))


def buckets(best_rows: DataFrame) -> DataFrame:
    """measure, n (queries with a value) and how many reach each threshold."""
    flat = best_rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])).alias("x")).select("x.*")
    return flat.groupBy("measure").agg(F.count("v").alias("n"), *[F.count_if(F.col("v") >= t).alias(f"ge_{str(t)[2:]}") for t in THRESHOLDS])


def best_match(measured: DataFrame) -> DataFrame:
    """query_id, doc_id, query_overlap of the judged opinion that each query overlaps most, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.col("query_overlap").desc_nulls_last(), "doc_id")
    return measured.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("query_id", "doc_id", "query_overlap")
