"""Hybrid search: lexical and dense scores fused by weights, routed by citations, over whole grids of trials.

All queries and trials are one plan: pools and scores do not depend on the knobs and are made once; a trial is an
exploded row of knobs and a window.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POOL = 100


@dataclass(frozen=True)
class Trial:
    label: str
    w_sem: float = 0.6
    cb_threshold: float = 1.3
    all_path: bool = False
    w_sem_by_type: dict[str, float] = field(default_factory=dict)
    top1_threshold: float | None = None
    gap_threshold: float | None = None
    boost_w_sem: float = 0.7


def trials_from_config(config: dict) -> list[Trial]:
    """The trials of a sweep's configuration, in order. The path switch keeps the value of the trial before (at first the
    configuration's) where a trial names none; all other knobs fall back to their defaults. A lexical weight has no effect.
    """
    out, all_path = [], bool(config.get("semantic_only_path", False))
    for t in config["trials"]:
        all_path = bool(t.get("semantic_only_path", all_path))
        out.append(
            Trial(
                t["label"], t["w_sem"], t["cb_threshold"], all_path, t.get("w_sem_by_type") or {}, t.get("confidence_top1_threshold"), t.get("confidence_gap_threshold"), t.get("confidence_boost_w_sem", 0.7),
            )
        )
    return out


def _trials(trials: list[Trial]) -> Column:
    none = F.lit(None).cast("double")
    num = lambda v: none if v is None else F.lit(float(v))
    return F.array(
        *[
            F.struct(
                F.lit(t.label).alias("label"), num(t.w_sem).alias("w_sem"), num(t.cb_threshold).alias("cb"), F.lit(t.all_path).alias("all_path"),
                (F.create_map(*[x for k, v in sorted(t.w_sem_by_type.items()) for x in (F.lit(k), F.lit(float(v)))]) if t.w_sem_by_type else F.create_map().cast("map<string,double>")).alias("by_type"),
                num(t.top1_threshold).alias("t1"), num(t.gap_threshold).alias("gap"), num(t.boost_w_sem).alias("boost"),
            )
            for t in trials
        ]
    )


def pools(queries: DataFrame, lexical: DataFrame, cited: DataFrame, dense: DataFrame) -> DataFrame:
    """query_id, doc_id, bm25, cos, from_citation of every query's candidates: the lexical top 100 and the cited documents.

    queries: query_id; lexical: query_id, doc_id, score; cited: query_id, doc_id; dense: query_id, doc_id, score (any superset of
    the pool; missing scores are 0).
    """
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    top = lexical.filter("score > 0").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= POOL).select("query_id", "doc_id")
    pool = top.withColumn("c", F.lit(0)).unionByName(cited.select("query_id", "doc_id").withColumn("c", F.lit(1))).groupBy("query_id", "doc_id").agg((F.max("c") == 1).alias("from_citation"))
    pool = pool.join(lexical.select("query_id", "doc_id", F.col("score").alias("bm25")), ["query_id", "doc_id"], "left").join(dense.select("query_id", "doc_id", F.col("score").alias("cos")), ["query_id", "doc_id"], "left")
    return pool.select("query_id", "doc_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("cos", F.lit(0.0)).alias("cos"), "from_citation")


def min_max(value: str, keys: list[str]) -> Column:
    """Scaled to [0, 1] within the keys; 1 where all values are equal."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi == lo, F.lit(1.0)).otherwise((F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)))


def search(queries: DataFrame, has_tokens: DataFrame, has_citations: DataFrame, pool: DataFrame, trials: list[Trial], k: int = 20, adaptive=None) -> tuple[DataFrame, DataFrame]:
    """(ranking, diagnostics) of every trial and query.

    queries: query_id, query_type; has_tokens, has_citations: query_id. Routes: empty_query (no tokens), bm25_only_noncite (no
    citation and not all_path: lexical order, scores above 0), empty_pool, cb_fired (best two lexical scores of the pool in a
    ratio of cb_threshold or more: lexical order, zeros kept), fusion ((1 - w) lexical + w dense, min-max scaled in the pool).
    The weight is the trial's, its type's if given, `adaptive(top1, mean, w)` of Columns if given, and last the confidence boost. Ties go by document id.
    ranking: run_id (the trial), query_id, rank, doc_id, score. diagnostics: one row per trial and query. k is at most POOL, as
    the lexical route takes its rows from the pool.
    """
    if k > POOL:
        raise ValueError(f"k must be at most {POOL}, the lexical part of the pool")
    q = queries.select("query_id", "query_type").join(has_tokens.select("query_id").distinct().withColumn("tok", F.lit(True)), "query_id", "left").join(has_citations.select("query_id").distinct().withColumn("cit", F.lit(True)), "query_id", "left")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "doc_id")
    p = pool.withColumn("lex_rank", F.row_number().over(w)).withColumn("nb", min_max("bm25", ["query_id"])).withColumn("ns", min_max("cos", ["query_id"]))
    stats = p.groupBy("query_id").agg(
        F.count("*").alias("pool_size"), F.count_if("from_citation").alias("citation_pool_size"), F.max(F.when(F.col("lex_rank") == 1, F.col("bm25"))).alias("b1"), F.max(F.when(F.col("lex_rank") == 2, F.col("bm25"))).alias("b2"),
        F.max("cos").alias("sem_top1"), F.avg("cos").alias("sem_mean"),
    )
    d = q.join(stats, "query_id", "left").withColumn("ratio", F.when(F.col("b2") > 0, F.col("b1") / F.nullif(F.col("b2"), F.lit(0.0)))).withColumn("t", F.explode(_trials(trials)))
    path = (
        F.when(F.col("tok").isNull(), "empty_query").when(F.col("cit").isNull() & ~F.col("t.all_path"), "bm25_only_noncite").when(F.col("pool_size").isNull(), "empty_pool")
        .when(F.col("ratio").isNull() | (F.col("ratio") >= F.col("t.cb")), "cb_fired").otherwise("fusion")
    )
    base = F.coalesce(F.try_element_at(F.col("t.by_type"), F.coalesce(F.col("query_type"), F.lit(""))), F.col("t.w_sem"))
    if adaptive is not None:
        base = adaptive(F.col("sem_top1"), F.col("sem_mean"), base)
    boosted = (F.col("sem_top1") >= F.col("t.t1")) & (F.col("t.gap").isNull() | (F.col("sem_top1") - F.col("sem_mean") >= F.col("t.gap")))
    weight = F.when(F.coalesce(boosted, F.lit(False)), F.col("t.boost")).otherwise(base)
    d = d.select(
        F.col("t.label").alias("run_id"), "query_id", path.alias("path"), F.col("cit").isNotNull().alias("has_citations"), F.coalesce("pool_size", F.lit(0)).alias("pool_size"),
        F.coalesce("citation_pool_size", F.lit(0)).alias("citation_pool_size"), F.col("ratio").alias("top12_ratio"), weight.alias("w_sem"), "sem_top1", "sem_mean",
    )
    x = d.filter(F.col("path").isin("bm25_only_noncite", "cb_fired", "fusion")).select("run_id", "query_id", "path", "w_sem").join(p, "query_id")
    # without a citation route, only lexical candidates with a score count
    x = x.filter((F.col("path") != "bm25_only_noncite") | (F.col("bm25") > 0))
    score = F.when(F.col("path") == "fusion", (1 - F.col("w_sem")) * F.col("nb") + F.col("w_sem") * F.col("ns")).otherwise(F.col("bm25"))
    order = Window.partitionBy("run_id", "query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    ranking = x.withColumn("score", score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("run_id", "query_id", "rank", "doc_id", "score")
    return ranking, d


def path_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("run_id", "path").agg(F.count("*").alias("n"))
