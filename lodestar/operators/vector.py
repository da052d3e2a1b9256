"""Exact nearest vectors by inner product."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that one task holds at once, and document vectors of a block where there are more queries.
BLOCK = 4096
DOC_BLOCK = 65_536


def _best(ids, mat, d, m, k: int):
    """An Arrow batch of the k best of the documents (ids d, rows of m) for each query (ids, rows of mat)."""
    import pyarrow as pa

    s = np.round(mat @ m.T, 9)
    s[ids[:, None] == d[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(d, s.shape), -s), axis=1)[:, : min(k, s.shape[1])]
    picked = np.take_along_axis(s, order, 1)
    keep = np.isfinite(picked)
    qi = np.repeat(ids, order.shape[1]).reshape(order.shape)
    return pa.RecordBatch.from_arrays([pa.array(qi[keep]), pa.array(d[order][keep]), pa.array(picked[keep])], names=["query_id", "doc_id", "score"])


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def top_k(queries: DataFrame, docs: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, doc_id, score, rank of the k best documents of every query, ties by id; a query is no answer to itself.

    Matrix products of blocks, each keeping k candidates per query, so a shuffle carries k rows per query and block, not the product.
    Up to BLOCK queries go to all tasks and the documents stay where they are. More are cut into blocks of BLOCK, the documents
    into blocks of DOC_BLOCK, and every pair of blocks meets in a task of its own; no vector passes the driver then.
    Vectors are used as they are (normalise beforehand for cosines); null vectors are left out.
    """
    vectors = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter("v IS NOT NULL AND id IS NOT NULL")
    q, d = vectors(queries), vectors(docs)
    few = q.limit(BLOCK + 1).collect()
    if not few:
        return docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    out = "query_id long, doc_id long, score double"
    if len(few) <= BLOCK:
        ids, mat = np.array([r[0] for r in few], np.int64), np.array([r[1] for r in few], np.float64)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield _best(ids, mat, b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1)), k)

        found = d.mapInArrow(run, out)
    else:
        n_q, n_d = -(-q.count() // BLOCK), max(-(-d.count() // DOC_BLOCK), 1)
        block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = q.select("id", "v", block(n_q, 1).alias("qb"), every(n_d).alias("db"))
        right = d.select("id", "v", every(n_q).alias("qb"), block(n_d, 2).alias("db"))

        def both(a, b):
            import pyarrow as pa

            if not a.num_rows or not b.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            vec = lambda t: (t.column("id").to_numpy(), _matrix(t.column("v")))
            return pa.Table.from_batches([_best(*vec(a), *vec(b), k)])

        found = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(both, out)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def full_ranks(queries: DataFrame, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, doc_id, rank of the wanted pairs in the whole ranking of all documents by inner product, ties by id; wanted documents without a vector have no row.

    queries: query_id, v; docs: doc_id, v (ids as strings). The ranking is never made: every task counts for each wanted
    pair how many of its documents come before it. Queries and wanted pairs go to all tasks and must be few; BLOCK bounds the queries.
    """
    q = queries.filter("v IS NOT NULL").limit(BLOCK + 1).collect()
    if len(q) > BLOCK:
        raise ValueError(f"more than {BLOCK} queries")
    at = {r["query_id"]: i for i, r in enumerate(q)}
    mat = np.array([r["v"] for r in q], np.float64)
    pairs = wanted.select("query_id", "doc_id").distinct()
    d = docs.filter("v IS NOT NULL").select("doc_id", "v")
    have = [(at[r[0]], r[1], np.array(r[2], np.float64)) for r in pairs.join(d, "doc_id").select("query_id", "doc_id", "v").collect() if r[0] in at]
    mine = [(i, doc, float(np.round(mat[i] @ v, 9))) for i, doc, v in have]
    names = [r["query_id"] for r in q]

    def run(batches):
        import pyarrow as pa

        ahead = np.zeros(len(mine), np.int64)
        for b in batches:
            if b.num_rows:
                ids = np.array(b.column(0).to_pylist(), object)
                s = np.round(_matrix(b.column(1)) @ mat.T, 9)
                for n, (i, doc, score) in enumerate(mine):
                    col = s[:, i]
                    ahead[n] += np.count_nonzero(col > score) + np.count_nonzero((col == score) & (ids < doc))
        cols = [[names[i] for i, _, _ in mine], [doc for _, doc, _ in mine], ahead]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["query_id", "doc_id", "ahead"])

    return d.mapInArrow(run, "query_id string, doc_id string, ahead long").groupBy("query_id", "doc_id").agg((F.sum("ahead") + 1).cast("int").alias("rank"))


def norms(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """n and how many vectors lie outside the unit norm by more than 1 %, over all rows."""
    norm = F.sqrt(F.aggregate(F.col(vec_col), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.agg(F.count("*").alias("n"), F.count_if(~norm.between(0.99, 1.01)).alias("off_norm"))
