"""BM25 over an inverted index kept as tables: postings, document lengths, corpus totals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import retrieval_token_lists, retrieval_tokens

K1, B = 1.5, 0.75
FEW = 200_000  # query terms that may go to all tasks
#: Queries that one task holds at once, and documents (and bytes of tokens) that it scores at a time.
BLOCK = 16_384
DOC_BLOCK = 16_384
DOC_BYTES = 100_000_000


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query_id, term, q_tf; a query without tokens has no row."""
    t = queries.select(F.col(id_col).alias("query_id"), F.explode(retrieval_tokens(F.col(text_col))).alias("term"))
    return t.groupBy("query_id", "term").agg(F.count("*").alias("q_tf"))


def scores(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score of all documents that share a term with a query.

    A term counts as often as the query has it; idf = ln(1 + (N - df + .5) / (df + .5)). The documents are tokenised once and the
    tokens kept for the totals and the postings. Only postings of query terms are shuffled (a semi join on distinct terms
    prunes the rest where the tokens arise, by broadcast if they are at most FEW); they are kept for the counts of holders and the
    scores. Ids are taken as unique; null texts count as empty documents.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), retrieval_tokens(F.col(text_col)).alias("toks")).withColumn("dl", F.size("toks")).persist()
    terms = terms.persist()
    few = terms.limit(FEW + 1).count() <= FEW
    hint = F.broadcast if few else lambda x: x
    totals = d.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).withColumn("_k", F.lit(1))
    # one row per document and term that some query has
    wanted = hint(terms.select("term").distinct())
    post = d.select("doc_id", "dl", F.explode("toks").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf")).persist()
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    x = post.join(hint(df), "term").join(hint(terms), "term").withColumn("_k", F.lit(1)).join(F.broadcast(totals), "_k")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    return x.groupBy("query_id", "doc_id").agg(F.sum(F.col("q_tf") * idf * F.col("tf") * (k1 + 1) / norm).alias("score"))


class _Queries:
    """Queries with the weights of their terms, and the k-th best score each has reached."""

    def __init__(self, ids, terms, weights, k: int):
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = pc.dictionary_encode(terms.flatten().cast(pa.string()))
        of, w = flat.indices.to_numpy(), weights.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy())])
        self.ids, self.vocabulary, self.k = ids, flat.dictionary, k
        self.terms = [(of[a:b], w[a:b]) for a, b in zip(ends, ends[1:])]
        self.least = np.zeros(len(ids))

    def best(self, docs, tokens, lengths, avgdl: float, k1: float, b: float):
        """An Arrow batch of the k best of the documents for each query, without those that earlier documents have put below the first k."""
        import pyarrow as pa
        import pyarrow.compute as pc

        order = pc.sort_indices(docs)  # places in the order of ids
        docs, tokens, dl = docs.take(order), tokens.take(order), lengths.take(order).to_numpy()
        n, n_terms = len(docs), len(self.vocabulary)
        term = pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.vocabulary), n_terms).to_numpy().astype(np.int64)
        keys, tf = np.unique(term * n + np.repeat(np.arange(n), pc.list_value_length(tokens).to_numpy()), return_counts=True)
        term, at = np.divmod(keys, n)
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[at] / avgdl))
        ends = np.searchsorted(term, np.arange(n_terms + 1))
        posts = [(at[x:y], part[x:y]) for x, y in zip(ends, ends[1:])]
        s, found = np.empty(n), []
        for q, (of, w) in enumerate(self.terms):
            s[:] = 0
            for t, x in zip(of, w):
                where, value = posts[t]
                s[where] += x * value
            # a little below, as it is the score to 9 places that counts
            c = np.flatnonzero(s > max(self.least[q] - 1e-8, 0))
            if len(c) >= self.k:
                v = np.round(s[c], 9)
                last = np.partition(v, len(c) - self.k)[len(c) - self.k]
                self.least[q] = max(self.least[q], last)
                above, same = c[v > last], c[v == last]
                c = np.concatenate([above, same[: self.k - len(above)]])
            if len(c):
                found.append((q, c, s[c]))
        qs, cs, ss = [np.repeat([q for q, _, _ in found], [len(c) for _, c, _ in found]).astype(np.int64), *[np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (1, 2)]]
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(qs)), docs.take(pa.array(cs.astype(np.int64))), pa.array(ss)], names=["query_id", "doc_id", "score"])


def _column(table, name: str):
    import pyarrow as pa

    c = table.column(name)
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c


def best(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score as of scores(), of candidates only: the k best of every query, ties by id, and some that are not among them.

    scores() makes a row of every query and document with a common term, this one none: a task sums up the scores of some documents
    for one query after the other and keeps its k best, so a shuffle carries k rows per query and task. The work still grows with
    queries times documents. Up to BLOCK queries go to all tasks and the documents stay where they are; more are cut into blocks of BLOCK, the
    documents into blocks of DOC_BLOCK, and every pair of blocks meets in a task of its own.
    """
    import pyarrow as pa

    lower = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    id_type = dict(lower.dtypes)["doc_id"]

    def tokens(batches):
        for x in batches:
            toks = retrieval_token_lists(x.column(1))
            yield pa.RecordBatch.from_arrays([x.column(0), toks, toks.value_lengths()], names=["doc_id", "toks", "dl"])

    d = lower.mapInArrow(tokens, f"doc_id {id_type}, toks array<string>, dl int").persist()
    terms = terms.persist()
    hint = F.broadcast if terms.limit(FEW + 1).count() <= FEW else lambda x: x
    n_docs, avgdl = d.agg(F.count("*"), F.avg("dl")).first()
    out = f"query_id {dict(terms.dtypes)['query_id']}, doc_id {id_type}, score double"
    # holders are counted within tasks first; no posting is shuffled
    df = d.select(F.explode(F.array_distinct("toks")).alias("term")).join(hint(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    parts = F.array_sort(F.collect_list(F.struct("term", (F.col("q_tf") * idf).alias("w"))))
    queries = terms.join(hint(df), "term").groupBy("query_id").agg(parts.alias("x")).select("query_id", F.col("x.term").alias("terms"), F.col("x.w").alias("weights")).persist()
    n_q = queries.count()
    if n_q <= BLOCK:
        got = queries.toArrow()
        shared = docs.sparkSession.sparkContext.broadcast([_column(got, c) for c in got.column_names])

        def run(batches):
            asked, held, rows, size = None, [], 0, 0

            def scored():
                t = pa.Table.from_batches(held)
                return asked.best(*[_column(t, c) for c in ("doc_id", "toks", "dl")], avgdl, k1, b)

            for x in batches:
                if not x.num_rows:
                    continue
                asked = asked or _Queries(*shared.value, k)
                held.append(x)
                rows, size = rows + x.num_rows, size + x.nbytes
                if rows >= DOC_BLOCK or size >= DOC_BYTES:
                    yield scored()
                    held, rows, size = [], 0, 0
            if held:
                yield scored()

        return d.mapInArrow(run, out)
    m_q, m_d = -(-n_q // BLOCK), max(-(-n_docs // DOC_BLOCK), 1)
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = queries.withColumn("qb", block("query_id", m_q)).withColumn("db", every(m_d))
    right = d.withColumn("db", block("doc_id", m_d)).withColumn("qb", every(m_q))

    def both(a, x):
        if not a.num_rows or not x.num_rows:
            return pa.Table.from_batches([], a.select(["query_id"]).schema.append(x.schema.field("doc_id")).append(pa.field("score", pa.float64())))
        asked = _Queries(*[_column(a, c) for c in ("query_id", "terms", "weights")], k)
        return pa.Table.from_batches([asked.best(*[_column(x, c) for c in ("doc_id", "toks", "dl")], avgdl, k1, b)])

    return left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(both, out)


def top_k(scored: DataFrame, k: int, ties: str = "doc_id") -> DataFrame:
    """The k best of each query by score, ties by id, with rank; scores of 0 and below are dropped after the cut."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), ties)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).filter("score > 0")


def ranks_of(scored: DataFrame, wanted: DataFrame, ties: str = "doc_id") -> DataFrame:
    """query_id, doc_id, rank of the wanted documents among all scored ones, in the order of top_k without its cut.

    A rank is the number of documents that don't come later, so nothing is sorted and no query is gathered in a task. Give `scored`
    persisted: it is read twice. The wanted pairs that are scored go to all tasks.
    """
    s = scored.filter("score > 0").select("query_id", "doc_id", F.round("score", 9).alias("s"), F.col(ties).alias("t"))
    w = s.join(F.broadcast(wanted.select("query_id", "doc_id").distinct()), ["query_id", "doc_id"]).select("query_id", F.col("doc_id").alias("wanted"), F.col("s").alias("ws"), F.col("t").alias("wt"))
    ahead = s.join(F.broadcast(w), "query_id").filter("s > ws OR (s = ws AND t <= wt)")
    return ahead.groupBy("query_id", F.col("wanted").alias("doc_id")).agg(F.count("*").cast("int").alias("rank"))
