"""Citation and statute indexes as long tables; look-ups are equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import base_code, citations


def citation_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """kind (gov_exact, gov_base, reg_exact), key, doc_id of the citations in the documents' texts."""
    c = docs.select(F.col(id_col).alias("doc_id"), F.explode(citations(F.col(text_col))).alias("c"))
    keys = F.when(F.col("c.kind") == "gov", F.array(F.struct(F.lit("gov_exact").alias("kind"), F.col("c.raw").alias("key")), F.struct(F.lit("gov_base").alias("kind"), F.col("c.base").alias("key")))).otherwise(
        F.array(F.struct(F.lit("reg_exact").alias("kind"), F.col("c.raw").alias("key")))
    )
    return c.select("doc_id", F.explode(keys).alias("x")).select("x.kind", "x.key", "doc_id").distinct()


def query_keys(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query_id, kind, key that a query looks up: statutes exactly and by base, regulations exactly and by base only if they have a subsection."""
    c = queries.select(F.col(id_col).alias("query_id"), F.explode(citations(F.col(text_col))).alias("c"))
    gov = F.array(F.struct(F.lit("gov_exact").alias("kind"), F.col("c.raw").alias("key")), F.struct(F.lit("gov_base").alias("kind"), F.col("c.base").alias("key")))
    reg = F.array(F.struct(F.lit("reg_exact").alias("kind"), F.col("c.raw").alias("key")), F.struct(F.lit("reg_exact").alias("kind"), F.col("c.base").alias("key")))
    return c.select("query_id", F.explode(F.when(F.col("c.kind") == "gov", gov).otherwise(reg)).alias("x")).select("query_id", "x.kind", "x.key").distinct()


def cited_documents(keys: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, doc_id of all documents with a key of the query."""
    return keys.join(index, ["kind", "key"]).select("query_id", "doc_id").distinct()


def code_table(df: DataFrame, id_col: str, codes_col: str) -> DataFrame:
    """doc_id, code: base codes of the lists, each once; null and blank codes are dropped."""
    return df.select(F.col(id_col).alias("doc_id"), F.explode(codes_col).alias("code")).withColumn("code", base_code(F.col("code"))).filter("code IS NOT NULL AND code <> ''").distinct()


#: Holders beyond which a code is not joined with itself.
HOLDERS = 5_000


def statute_neighbours(positives: DataFrame, codes: DataFrame, excluded: DataFrame | None, k: int = 5, holders: int | None = None) -> DataFrame:
    """doc_id, neg_id, n_shared, rank: for every positive the k documents sharing most codes, ties by id.

    Self and excluded documents are no candidates. codes: doc_id, code, each once. A code of up to `holders` (HOLDERS) documents is joined
    with itself and its pairs are counted. Commoner codes make no pairs: their part of a count comes from the two
    documents' sets of common codes. Documents that share common codes alone are all alike to a positive if they have the same
    set of them, so the first k + 1 by id of each such set are candidates enough. The result is that of joining all.
    """
    codes = codes.select("doc_id", "code").persist()
    asked = positives.select("doc_id").distinct()
    mine = codes.join(asked, "doc_id", "left_semi")
    other = codes.select(F.col("doc_id").alias("neg_id"), "code")
    if excluded is not None:
        other = other.join(excluded.select(F.col(excluded.columns[0]).alias("neg_id")).distinct(), "neg_id", "left_anti")
    w = Window.partitionBy("doc_id").orderBy(F.desc("n_shared"), "neg_id")
    # at most rows / holders codes
    common = codes.groupBy("code").count().filter(F.col("count") > (HOLDERS if holders is None else holders)).select("code").persist()
    if not common.limit(1).count():
        shared = mine.join(other, "code").filter("doc_id <> neg_id").groupBy("doc_id", "neg_id").agg(F.count("*").alias("n_shared"))
        return shared.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    rare = lambda df: df.join(common, "code", "left_anti")
    sets = lambda df, c: df.join(common, "code", "left_semi").groupBy(c).agg(F.array_sort(F.collect_set("code")).alias("set"))
    of_mine, of_other = sets(mine, "doc_id"), sets(other, "neg_id").persist()
    by_rare = rare(mine).join(rare(other), "code").filter("doc_id <> neg_id").groupBy("doc_id", "neg_id").agg(F.count("*").alias("n"))
    by_rare = by_rare.join(of_mine, "doc_id", "left").join(of_other.withColumnRenamed("set", "set_"), "neg_id", "left")
    by_rare = by_rare.select("doc_id", "neg_id", (F.col("n") + F.coalesce(F.size(F.array_intersect("set", "set_")), F.lit(0))).alias("n_shared"))
    first = of_other.withColumn("_rn", F.row_number().over(Window.partitionBy("set").orderBy("neg_id"))).filter(F.col("_rn") <= k + 1).select("neg_id", F.col("set").alias("set_"))
    met = of_mine.select("set").distinct().withColumn("code", F.explode("set")).join(first.select("set_").distinct().withColumn("code", F.explode("set_")), "code").groupBy("set", "set_").agg(F.count("*").alias("n_shared"))
    # of each positive's set the best k documents (and one for itself), before the positives come in
    best = met.join(first, "set_").withColumn("_rn", F.row_number().over(Window.partitionBy("set").orderBy(F.desc("n_shared"), "neg_id"))).filter(F.col("_rn") <= k + 1)
    by_common = of_mine.join(best.select("set", "neg_id", "n_shared"), "set").filter("doc_id <> neg_id").select("doc_id", "neg_id", "n_shared")
    shared = by_rare.unionByName(by_common).groupBy("doc_id", "neg_id").agg(F.max("n_shared").alias("n_shared"))
    return shared.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
