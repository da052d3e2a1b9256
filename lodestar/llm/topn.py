"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_n_per_group(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int) -> DataFrame:
    """The n highest-scoring rows of each group, with column `position`.

    Order: score descending, then the columns `ties` ascending with nulls last, which should end
    in an identifier. Rows with a null group column or a null or NaN score are never kept. Rows equal in group,
    score and every tie column are one record and come out once. n < 1 gives no row; an empty table gives none.

    Plan: copies are dropped first, by an aggregation that collapses them in every task before its shuffle (which spreads by
    record, so neither a hot group nor a hot record gathers). Then a rank filter directly on the row_number window lets
    Catalyst place WindowGroupLimit before and after the shuffle by group: a group of any size leaves each task as n rows.
    """
    keep = F.lit(True)
    for g in groups:
        keep = keep & F.col(f"`{g}`").isNotNull()
    s = F.col(f"`{score}`")
    if dict(df.dtypes)[score] in ("double", "float"):
        keep = keep & ~F.isnan(s)
    order = [s.desc(), *[F.col(f"`{t}`").asc_nulls_last() for t in ties]]
    w = Window.partitionBy(*[F.col(f"`{g}`") for g in groups]).orderBy(*order)
    return (
        df.filter(s.isNotNull() & keep)
        .dropDuplicates([*groups, score, *ties])
        .withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= n)
    )


def top_negatives(neg: DataFrame, n: int = 5) -> DataFrame:
    """The n best negatives per anchor and source; source is trimmed and lower-cased first (blank counts as a source of its own)."""
    clean = neg.select("anchor_id", F.lower(F.trim("source")).alias("source"), "neg_id", "score", "rank")
    return top_n_per_group(clean, ["anchor_id", "source"], "score", ["rank", "neg_id"], n)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    neg = spark.read.parquet(f"{sf_dir}/neg_records.parquet")
    return top_negatives(neg).select("anchor_id", "source", "neg_id")


SQL = {
    "p6_found": """
WITH d AS (SELECT DISTINCT anchor_id, lower(trim(source)) AS source, neg_id, score, rank FROM neg_records
           WHERE anchor_id IS NOT NULL AND source IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, source ORDER BY score DESC, rank ASC NULLS LAST, neg_id) AS p FROM d)
SELECT anchor_id, source, neg_id FROM r WHERE p <= 5""",
}
