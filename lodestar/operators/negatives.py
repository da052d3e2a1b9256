"""Hard negatives: lexical neighbours and statute neighbours of each training opinion, merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lexical_negatives(scored: DataFrame, excluded: DataFrame, overfetch: int = 30, k: int = 5) -> DataFrame:
    """doc_id, neg_id, rank, score: of the best `overfetch` by score, those above 0 that are neither self nor excluded, the first k.

    scored: query_id (the positive's id), doc_id, score. Exclusion comes after the cut, as a positive must not gain
    candidates by it.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    cut = scored.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= overfetch).filter("score > 0 AND doc_id <> query_id")
    cut = cut.join(excluded.select(F.col(excluded.columns[0]).alias("doc_id")).distinct(), "doc_id", "left_anti")
    w2 = Window.partitionBy("query_id").orderBy("_rn")
    return cut.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k).select(F.col("query_id").alias("doc_id"), F.col("doc_id").alias("neg_id"), "rank", F.bround("score", 4).alias("score"))


def merge_negatives(lexical: DataFrame, statute: DataFrame) -> DataFrame:
    """doc_id, neg_id, source (bm25, same_statute or both), rank, score, n_shared, ordinal: lexical ones first, each by its rank."""
    s = statute.select("doc_id", "neg_id", "n_shared", F.col("rank").alias("s_rank"))
    m = lexical.join(s, ["doc_id", "neg_id"], "full_outer")
    source = F.when(F.col("rank").isNull(), "same_statute").when(F.col("s_rank").isNull(), "bm25").otherwise("bm25+same_statute")
    w = Window.partitionBy("doc_id").orderBy(F.col("rank").asc_nulls_last(), "s_rank", "neg_id")
    return m.select("doc_id", "neg_id", source.alias("source"), "rank", "score", "n_shared", F.row_number().over(w).alias("ordinal"))


def anchor_mix(negatives: DataFrame, anchors: DataFrame) -> DataFrame:
    """mix (mixed, bm25_only, statute_only, empty), n: anchors by the sources of their negatives."""
    n = F.lower(F.trim("source"))
    per = negatives.groupBy(F.col("doc_id")).agg(F.bool_or(n.contains("bm25")).alias("b"), F.bool_or(n.contains("same_statute")).alias("s"))
    x = anchors.select("doc_id").distinct().join(per, "doc_id", "left")
    mix = F.when(F.col("b") & F.col("s"), "mixed").when(F.col("b"), "bm25_only").when(F.col("s"), "statute_only").otherwise("empty")
    return x.groupBy(mix.alias("mix")).agg(F.count("*").alias("n"))


def list_summary(negatives: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """n, mean, least, most of the list lengths of all anchors, those without a list at 0; the mean to 3 places, halves to even."""
    per = negatives.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.count("*").alias("length"))
    x = anchors.select("doc_id").distinct().join(per, "doc_id", "left").select(F.coalesce("length", F.lit(0)).alias("length"))
    return x.agg(F.count("*").alias("n"), F.bround(F.avg("length"), 3).alias("mean"), F.min("length").alias("least"), F.max("length").alias("most"))


def list_lengths(negatives: DataFrame, key: str) -> DataFrame:
    """length, n: how many anchors have lists of each length. Two aggregations; no list is built."""
    return negatives.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("n"))
