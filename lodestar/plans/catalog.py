"""All named queries of the engine over the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import stats
from lodestar.functions import text as T
from lodestar.functions.similarity import dot
from lodestar.operators import bm25, chunking, citations, compare, fusion, leakage, metrics, negatives, pairs, splits, vector
from lodestar.plans import oracle
from lodestar.sources.io import resume

TRIALS = [
    fusion.Trial("w60"),
    fusion.Trial("w40_all", w_sem=0.4, cb_threshold=1.5, all_path=True),
    fusion.Trial("lexical_all", w_sem=0.0, cb_threshold=2.0, all_path=True),
    fusion.Trial("by_type", w_sem=0.4, cb_threshold=1.5, all_path=True, w_sem_by_type={"keyword": 0.2, "fact_pattern": 0.7}),
    fusion.Trial("boost", w_sem=0.4, cb_threshold=1.5, all_path=True, top1_threshold=0.6, gap_threshold=0.1, boost_w_sem=0.8),
]
DIMS = ["query_type", "query_topic"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, question, qa, full_text of every opinion once: the held-out ones, then the delivered ones by first delivery."""
    h = table(spark, sf_dir, "heldout_pairs").select(F.col("opinion_id").alias("doc_id"), "question", F.col("pos_qa_text").alias("qa"), F.col("pos_qa_text").alias("full_text"), F.lit(0).alias("o"), F.col("item_id").alias("i"))
    p = table(spark, sf_dir, "pairs").select(F.col("opinion_id").alias("doc_id"), "question", F.col("pos_qa_text").alias("qa"), F.col("pos_full_text").alias("full_text"), F.lit(1).alias("o"), F.col("pair_id").alias("i"))
    return pairs.first_per_id(h.unionByName(p), "doc_id", ["o", "i"]).select("doc_id", "question", "qa", "full_text")


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinion records as delivered, their sections cut from the full text by its titles; some lack a question or an answer or have a short question."""
    p = table(spark, sf_dir, "pairs")
    k = F.col("pair_id")
    p = p.withColumn("question", F.when(k % 29 == 3, F.lit(None)).when(k % 31 == 4, F.lit("Too short?")).otherwise(F.col("question"))).withColumn("pos_qa_text", F.when(k % 37 == 5, F.lit(" ")).otherwise(F.col("pos_qa_text")))
    cut = lambda a, b: F.nullif(F.regexp_extract("pos_full_text", rf"(?s)\n\n{a}\n\n(.*?)\n\n{b}", 1), F.lit(""))
    return p.select(
        F.col("pair_id").cast("string").alias("id"), F.nullif("year", F.lit(0)).alias("year"),
        F.struct(
            F.when(F.col("question_source") == "real", F.col("question")).alias("question"), F.when(F.col("question_source") != "real", F.col("question")).alias("question_synthetic"), cut("FACTS", "ANALYSIS").alias("facts"),
            cut("ANALYSIS", "Sincerely").alias("analysis"), cut("CONCLUSION", "(?:FACTS|ANALYSIS)").alias("conclusion"), F.when(~F.col("has_conclusion"), F.lit("Yes.")).alias("conclusion_synthetic"),
        ).alias("sections"),
        F.struct(F.col("pos_qa_text").alias("qa_text"), F.nullif("qa_source", F.lit("")).alias("qa_source")).alias("embedding"), F.struct("topic_primary").alias("classification"), F.struct(F.col("pos_full_text").alias("full_text")).alias("content"),
    )


def eval_queries(spark, sf_dir):
    return table(spark, sf_dir, "eval_queries")


def qrels(spark, sf_dir):
    return leakage.judgments(eval_queries(spark, sf_dir))


def lexical(spark, sf_dir, ops=None):
    return bm25.scores(ops or opinions(spark, sf_dir), "doc_id", "full_text", bm25.query_terms(eval_queries(spark, sf_dir), "query_id", "query_text"))


def hashed(df: DataFrame, id_col: str, text: str, out: str) -> DataFrame:
    """Token counts in 64 hashed places: stands in for an encoder, which is a model from outside."""
    b = F.transform(T.retrieval_tokens(F.col(text)), lambda t: F.conv(F.substring(F.md5(t), 1, 2), 16, 10).cast("int") % 64)
    return df.select(F.col(id_col).alias(out), T.let(b, lambda b: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double"))).alias("v"))


def pool(spark, sf_dir) -> DataFrame:
    q, ops = eval_queries(spark, sf_dir), opinions(spark, sf_dir).persist()
    lex = lexical(spark, sf_dir, ops).persist()
    cited = citations.cited_documents(citations.query_keys(q, "query_id", "query_text"), citations.citation_index(ops, "doc_id", "full_text")).persist()
    # dense scores of candidates only
    ids = fusion.pools(q, lex, cited, lex.limit(0)).select("query_id", "doc_id")
    qv, dv = hashed(q, "query_id", "query_text", "query_id").withColumnRenamed("v", "qv"), hashed(ops.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "qa", "doc_id").withColumnRenamed("v", "dv")
    norm = F.sqrt(dot(F.col("qv"), F.col("qv"))) * F.sqrt(dot(F.col("dv"), F.col("dv")))
    dense = ids.join(qv, "query_id").join(dv, "doc_id").select("query_id", "doc_id", F.when(norm > 0, dot(F.col("qv"), F.col("dv")) / F.nullif(norm, F.lit(0.0))).otherwise(0.0).alias("score"))
    return fusion.pools(q, lex, cited, dense)


def sweep(spark, sf_dir, adaptive=None) -> tuple[DataFrame, DataFrame]:
    q = eval_queries(spark, sf_dir)
    return fusion.search(q, bm25.query_terms(q, "query_id", "query_text"), citations.query_keys(q, "query_id", "query_text"), pool(spark, sf_dir).persist(), TRIALS, adaptive=adaptive)


def surer(top1, mean, weight):
    """An adaptive rule: 0.2 more weight for the dense scores where the best stands out by 0.3."""
    return F.when(top1 - mean >= 0.3, F.least(weight + 0.2, F.lit(1.0))).otherwise(weight)


def adaptive_routes(spark, sf_dir) -> DataFrame:
    d = sweep(spark, sf_dir, surer)[1]
    return d.select("run_id", "query_id", "path", F.round("w_sem", 6).alias("w_sem"), F.round("sem_top1", 6).alias("sem_top1"), F.round("sem_mean", 6).alias("sem_mean"))


def sweep_metrics(spark, sf_dir) -> DataFrame:
    return metrics.graded(sweep(spark, sf_dir)[0], qrels(spark, sf_dir), [t.label for t in TRIALS])


def dense_run(spark, sf_dir, k=20) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vector.top_k(e.filter("vec_id % 20 = 0"), e, k)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors with graded metrics by label: documents of the query's label are relevant."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 20 = 0")
    rel = q.select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("doc_id"), "label"), "label").filter("query_id <> doc_id").select("query_id", "doc_id", F.lit(2).alias("score"))
    per = metrics.graded(dense_run(spark, sf_dir).withColumn("run_id", F.lit("exact")), rel, ["exact"])
    return metrics.grouped(per, q.select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("label")), ["label"])


def measured(spark, sf_dir):
    return leakage.measure(eval_queries(spark, sf_dir), qrels(spark, sf_dir), opinions(spark, sf_dir).select("doc_id", "question"))


def train(spark, sf_dir):
    return table(spark, sf_dir, "pairs").filter("split_name = 'train'")


def held_ids(spark, sf_dir):
    """The held-out opinions and those of the validation and test rows."""
    return table(spark, sf_dir, "heldout_pairs").select("opinion_id").unionByName(table(spark, sf_dir, "pairs").filter("split_name <> 'train'").select("opinion_id"))


def run_wins(spark, sf_dir):
    """Wins of w40_all over w60 by type, topic and the route that w40_all took."""
    ranking, routes = sweep(spark, sf_dir)
    per = metrics.graded(ranking, qrels(spark, sf_dir), [t.label for t in TRIALS])
    q = eval_queries(spark, sf_dir).join(routes.filter("run_id = 'w40_all'").select("query_id", "path"), "query_id")
    return compare.wins(compare.deltas(per, "w60", "w40_all", "ndcg_5"), q, [*DIMS, "path"])


def unit(df: DataFrame) -> DataFrame:
    """Vectors v scaled to length 1; null without any token."""
    scaled = lambda v: T.let(F.sqrt(dot(v, v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))
    return df.withColumn("v", T.let(F.col("v"), scaled))


def dense_gold_ranks(spark, sf_dir):
    """Where the judged opinions stand in the whole dense ranking of all opinions."""
    q = unit(hashed(eval_queries(spark, sf_dir), "query_id", "query_text", "query_id"))
    d = unit(hashed(opinions(spark, sf_dir), "doc_id", "qa", "doc_id"))
    rel = qrels(spark, sf_dir)
    return metrics.gold_ranks(vector.full_ranks(q, d, rel), rel)


def val_evaluator(spark, sf_dir):
    """The validation rows as queries and as corpus: how well a question finds its own answer. Documents have the negated ids."""
    p = table(spark, sf_dir, "pairs").filter("split_name = 'val'")
    rows = metrics.val_rows(p, "pos_qa_text").join(p.groupBy(F.col("opinion_id").alias("doc_id")).agg(F.max("pair_id").alias("id")), "doc_id").persist()
    vec = lambda c, i: unit(hashed(rows.withColumn("_i", i), "_i", c, "vec_id")).withColumnRenamed("v", "embedding")
    run = vector.top_k(vec("question", F.col("id")), vec("positive", -F.col("id")), 100)
    return metrics.binary(run, rows.select(F.col("id").alias("query_id"), (-F.col("id")).alias("doc_id")))


def statute(spark, sf_dir, k=5, asked=None):
    t = train(spark, sf_dir)
    codes = pairs.first_per_id(t, "opinion_id", ["pair_id"]).select(F.col("opinion_id").alias("doc_id"), F.transform(F.filter(T.citations(F.col("pos_full_text")), lambda c: c["kind"] == "gov"), lambda c: c["base"]).alias("codes"))
    return citations.statute_neighbours(codes.select("doc_id") if asked is None else asked, citations.code_table(codes, "doc_id", "codes"), held_ids(spark, sf_dir), k)


def lexical_negatives(spark, sf_dir):
    """For the opinions whose pair id is divisible by 20, against all training opinions."""
    docs = pairs.first_per_id(train(spark, sf_dir), "opinion_id", ["pair_id"])
    terms = bm25.query_terms(docs.filter("pair_id % 20 = 0"), "opinion_id", "question")
    return negatives.lexical_negatives(bm25.best(docs, "opinion_id", "pos_full_text", terms, 30), held_ids(spark, sf_dir), overfetch=30)


def merged_negatives(spark, sf_dir):
    lex = lexical_negatives(spark, sf_dir)
    asked = pairs.first_per_id(train(spark, sf_dir), "opinion_id", ["pair_id"]).filter("pair_id % 20 = 0").select(F.col("opinion_id").alias("doc_id"))
    return negatives.merge_negatives(lex, statute(spark, sf_dir, asked=asked))


def training(spark, sf_dir):
    n = table(spark, sf_dir, "neg_records").filter("anchor_id IS NOT NULL").select(F.col("anchor_id").alias("opinion_id"), F.col("opinion_id").alias("neg_opinion_id"), F.col("neg_id").alias("ordinal")).distinct()
    corpus = opinions(spark, sf_dir).select("doc_id", F.col("qa").alias("text"))
    return pairs.training_rows(train(spark, sf_dir), held_ids(spark, sf_dir), "pos_body", n, corpus, 2, "query: ", "passage: ")


def training_keys(spark, sf_dir):
    rows = training(spark, sf_dir)
    return rows.select("pair_id", "anchor", F.length("positive").alias("n_positive"), F.array_join(F.transform("negatives", F.md5), ",").alias("negatives"), "shuffle_key")


def answers(spark, sf_dir):
    """Model answers of several shapes made of the events: fenced, bare, broken, with a blank field."""
    e = table(spark, sf_dir, "events")
    obj = F.concat(F.lit('{"keyword": "'), F.col("event_type"), F.lit('", "fact_pattern": " seen by '), F.col("user_id").cast("string"), F.lit(' "}'))
    k = F.col("event_id") % 4
    t = F.when(k == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), obj)).when(k == 2, F.substring(obj, 1, 20)).otherwise(F.regexp_replace(obj, r" seen by \d+ ", " "))
    return e.select("event_id", t.alias("answer"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    tokens = lambda f, c="question": lambda s, d: table(s, d, "pairs").select("pair_id", F.array_join(f(F.col(c)), " ").alias("tokens"))
    p = lambda s, d: table(s, d, "pairs")
    return {
        "flagship": flagship,
        "normalize_question": lambda s, d: p(s, d).select("pair_id", T.normalize_question(F.col("question")).alias("question")),
        "retrieval_tokens": tokens(T.retrieval_tokens, "pos_full_text"),
        "leakage_tokens": tokens(T.leakage_tokens),
        "char_ngrams": lambda s, d: eval_queries(s, d).select("query_id", F.explode(T.char_ngrams(F.col("query_text"))).alias("gram")),
        "document_citations": lambda s, d: table(s, d, "documents").select("doc_id", F.explode(T.citations(F.col("text"))).alias("c")).select("doc_id", "c.kind", "c.raw", "c.base").distinct(),
        "base_codes": lambda s, d: citations.code_table(table(s, d, "neg_records"), "neg_id", "shared_codes"),
        "conclusions": lambda s, d: p(s, d).select("pair_id", T.conclusion_section(F.col("pos_qa_text")).alias("section"), T.conclusion_text(F.col("pos_qa_text")).alias("conclusion")),
        "embedding_text": lambda s, d: p(s, d).select("pair_id", F.md5(T.prefixed("passage: ", T.qa_or_full(F.col("pos_body"), F.col("pos_full_text")))).alias("text")),
        "prompts": lambda s, d: p(s, d).select("pair_id", F.md5(T.prompt("Q: {question}\nC: {conclusion}\n", F.col("question"), T.conclusion_text(F.col("pos_qa_text")))).alias("prompt")),
        "paraphrase_json": lambda s, d: answers(s, d).select("event_id", T.paraphrase_json(F.col("answer")).alias("a")).select("event_id", "a.keyword", "a.fact_pattern"),
        "build_pairs": lambda s, d: pairs.build_pairs(nested(s, d)).drop("pos_full_text", "pos_qa_text").withColumns({"pos_body": F.md5("pos_body"), "pos_qa_plus_body": F.md5("pos_qa_plus_body")}),
        "pair_reasons": lambda s, d: pairs.build_pairs(nested(s, d)).groupBy(F.coalesce("reason", F.lit("pair")).alias("reason")).agg(F.count("*").alias("n")),
        "pair_counters": lambda s, d: pairs.counters(_records(s, d), _hard_anchors(s, d)),
        "question_coverage": lambda s, d: pairs.question_coverage(nested(s, d)),
        "language_model_texts": lambda s, d: pairs.language_model_texts(opinions(s, d), "doc_id", "full_text", table(s, d, "heldout_pairs").select("opinion_id")).select("doc_id", F.md5("full_text").alias("text")),
        "paraphrase_rows": lambda s, d: pairs.paraphrase_rows(p(s, d).select("pair_id", "year", "question", "question_source"), _answered(s, d), "pair_id"),
        "first_deliveries": lambda s, d: pairs.first_per_id(p(s, d), "opinion_id", ["ingested_at", "pair_id"]).select("opinion_id", "pair_id"),
        "coverage": lambda s, d: pairs.coverage(p(s, d)),
        "top_topics": lambda s, d: pairs.top_categories(p(s, d), "topic_primary"),
        "fill_report": lambda s, d: pairs.fill_report(p(s, d), ["pos_body", "pos_qa_plus_body", "topic_primary"]),
        "length_stats": lambda s, d: _rounded(stats.rank_stats(p(s, d).withColumn("n_chars", F.length("pos_full_text")), ["split_name"], "n_chars"), ["split_name"]),
        "training_pairs": lambda s, d: pairs.without(train(s, d), held_ids(s, d), "opinion_id").select("pair_id"),
        "val_slice": lambda s, d: splits.fraction_per_stratum(p(s, d), "pair_id", "year").select("pair_id", "year"),
        "proportional_sample": lambda s, d: splits.proportional_sample(p(s, d), "pair_id", "topic_primary", 300).select("pair_id", "topic_primary"),
        "first_rows": lambda s, d: splits.prefix(p(s, d), 100, ["pair_id"]).select("pair_id"),
        "split_drift": lambda s, d: splits.drift(p(s, d).withColumn("is_val", F.col("split_name") == "val"), "is_val", ["question_source", "topic_primary", "year"]),
        "leakage_pairs": measured,
        "leakage_buckets": lambda s, d: leakage.buckets(leakage.best(measured(s, d), 2)),
        "leakage_best_match": lambda s, d: leakage.best_match(measured(s, d)),
        "leakage_stats": lambda s, d: leakage.summary(measured(s, d)),
        "leakage_missing": lambda s, d: leakage.missing(qrels(s, d), p(s, d).select(F.col("opinion_id").alias("doc_id"))),
        "judged_opinions": lambda s, d: qrels(s, d).groupBy("doc_id").agg(F.max("score").alias("best"), F.count("*").alias("n")),
        "bm25_top20": lambda s, d: bm25.top_k(lexical(s, d), 20).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score")),
        "dense_top20": lambda s, d: dense_run(s, d).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score")),
        "vector_norms": lambda s, d: vector.norms(table(s, d, "embeddings")),
        "dense_binary": lambda s, d: metrics.binary(dense_run(s, d, 100), _same_label(s, d)),
        "cited_documents": lambda s, d: citations.cited_documents(citations.query_keys(eval_queries(s, d), "query_id", "query_text"), citations.citation_index(opinions(s, d), "doc_id", "full_text")),
        "statute_neighbours": statute,
        "fusion_pool": lambda s, d: pool(s, d).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"), F.round("cos", 6).alias("cos"), "from_citation"),
        "fusion_ranking": lambda s, d: sweep(s, d)[0].select("run_id", "query_id", "rank", "doc_id", F.round("score", 6).alias("score")),
        "fusion_routes": lambda s, d: sweep(s, d)[1].select("run_id", "query_id", "path", "has_citations", "pool_size", "citation_pool_size", F.round("top12_ratio", 6).alias("top12_ratio"), F.round("w_sem", 6).alias("w_sem"), F.round("sem_top1", 6).alias("sem_top1")),
        "fusion_paths": lambda s, d: fusion.path_counts(sweep(s, d)[1]),
        "fusion_per_query": lambda s, d: _rounded(sweep_metrics(s, d), ["run_id", "query_id"]),
        "fusion_metrics": lambda s, d: metrics.grouped(sweep_metrics(s, d), eval_queries(s, d), DIMS),
        "best_trial": lambda s, d: compare.best_trial(metrics.grouped(sweep_metrics(s, d), eval_queries(s, d), DIMS), "ndcg_5", [t.label for t in TRIALS]),
        "fusion_adaptive": adaptive_routes,
        "run_wins": run_wins,
        "run_join": lambda s, d: _rounded(compare.join_runs(sweep_metrics(s, d), [t.label for t in TRIALS], "ndcg_10"), ["query_id"]),
        "topic_mean": lambda s, d: compare.filtered_mean(compare.deltas(sweep_metrics(s, d), "w60", "w40_all", "ndcg_5"), eval_queries(s, d), "query_topic", "conflicts_of_interest"),
        "largest_changes": lambda s, d: _rounded(compare.largest(compare.deltas(sweep_metrics(s, d), "w60", "w40_all", "ndcg_10")), ["query_id"]),
        "change_texts": lambda s, d: compare.largest(compare.deltas(sweep_metrics(s, d), "w60", "w40_all", "ndcg_5")).join(eval_queries(s, d), "query_id").select("query_id", "mark", T.excerpt(F.col("query_text")).alias("query")),
        "oracle_mean": lambda s, d: compare.oracle_mean(sweep_metrics(s, d), "w60", "w40_all", "ndcg_10"),
        "metric_pivot": lambda s, d: compare.pivot_metric(metrics.grouped(sweep_metrics(s, d), eval_queries(s, d), DIMS), "ndcg_10", [t.label for t in TRIALS]),
        "side_by_side": lambda s, d: compare.side_by_side(sweep(s, d)[0], qrels(s, d), ["w60", "w40_all"]),
        "gold_ranks": lambda s, d: metrics.gold_ranks(bm25.ranks_of(lexical(s, d).persist(), qrels(s, d)), qrels(s, d)),
        "dense_gold_ranks": dense_gold_ranks,
        "lexical_negatives": lexical_negatives,
        "hard_negatives": merged_negatives,
        "anchor_mix": lambda s, d: negatives.anchor_mix(table(s, d, "neg_records").withColumn("doc_id", F.col("anchor_id")), train(s, d).withColumn("doc_id", F.col("opinion_id"))),
        "negative_list_summary": lambda s, d: negatives.list_summary(table(s, d, "neg_records"), train(s, d).select(F.col("opinion_id").alias("doc_id")), "anchor_id"),
        "negative_list_lengths": lambda s, d: negatives.list_lengths(table(s, d, "neg_records"), "anchor_id"),
        "training_rows": training_keys,
        "training_report": lambda s, d: pairs.training_report(p(s, d), held_ids(s, d), "pos_body", training(s, d)),
        "extra_pairs": lambda s, d: pairs.with_extra(p(s, d).select("pair_id", "year", "question", "question_source"), pairs.paraphrase_rows(p(s, d).select("pair_id", "year", "question", "question_source"), _answered(s, d), "pair_id")),
        "val_evaluator": val_evaluator,
        "question_index": lambda s, d: opinions(s, d).select("doc_id", T.normalize_question(F.col("question")).alias("question"), F.length("full_text").alias("n_chars")),
        "chunks": lambda s, d: chunking.chunk_windows(table(s, d, "documents"), "doc_id", "text", 130).select("doc_id", "chunk", "n_tokens", F.md5(F.array_join("tokens", " ")).alias("tokens")),
        "resume": lambda s, d: resume(p(s, d).select("pair_id", "opinion_id"), table(s, d, "neg_records").select(F.col("anchor_id").alias("opinion_id")), "opinion_id").select("pair_id"),
    }


def _records(spark, sf_dir) -> DataFrame:
    """The nested records under their opinion numbers, in order of delivery."""
    n = nested(spark, sf_dir)
    return n.withColumn("ordinal", F.col("id").cast("long")).drop("id").join(table(spark, sf_dir, "pairs").select(F.col("pair_id").alias("ordinal"), F.col("opinion_id").alias("id")), "ordinal")


def _hard_anchors(spark, sf_dir) -> DataFrame:
    """Stands for a held-out list: the opinions that are anchors."""
    return table(spark, sf_dir, "neg_records").filter("anchor_id IS NOT NULL").select("anchor_id")


def _answered(spark, sf_dir) -> DataFrame:
    """Parsed model answers for pairs; pair k has that of event k - 1,000,000."""
    return answers(spark, sf_dir).select((F.col("event_id") + 1_000_000).alias("pair_id"), T.paraphrase_json(F.col("answer")).alias("a"))


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[c if c in keys or t != "double" else F.round(c, 6).alias(c) for c, t in df.dtypes])


def _same_label(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("doc_id"), "label"), "label").filter("query_id <> doc_id").select("query_id", "doc_id")


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
