"""Question-opinion pairs from nested opinion records, their coverage, and training rows made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import conclusion_section, filled, normalize_question, prefixed


def first_per_id(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """The first row of each id in the given order; rows without an id are dropped."""
    w = Window.partitionBy(id_col).orderBy(*order)
    return df.filter(F.col(id_col).isNotNull()).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def build_pairs(opinions: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One pair per usable opinion.

    Input: id, year, sections, embedding, classification, content (nested; missing, null and blank texts are alike).
    `reason` tells why a row is no pair (no_question, short_or_empty) and is null for pairs; counts of all reasons
    add up to the input. A real question goes before a synthetic one; a pair needs a question of 15 characters, qa
    text and full text; a body needs an analysis and facts or a conclusion.
    """
    real, synth = filled(F.col("sections.question")), filled(F.col("sections.question_synthetic"))
    facts, analysis = filled(F.col("sections.facts")), filled(F.col("sections.analysis"))
    conclusion = F.coalesce(filled(F.col("sections.conclusion")), filled(F.col("sections.conclusion_synthetic")))
    qa, full = filled(F.col("embedding.qa_text")), filled(F.col("content.full_text"))
    body = F.when(analysis.isNotNull() & (facts.isNotNull() | conclusion.isNotNull()), F.concat_ws("\n\n", facts, analysis, conclusion))
    question = normalize_question(F.coalesce(real, synth))
    reason = F.when(F.coalesce(real, synth).isNull(), "no_question").when((F.length(question) < 15) | qa.isNull() | full.isNull(), "short_or_empty")
    return opinions.select(
        F.col("id").alias("opinion_id"), F.coalesce(F.col("year"), F.lit(0)).cast("int").alias("year"), question.alias("question"),
        F.when(real.isNotNull(), "real").when(synth.isNotNull(), "synthetic").alias("question_source"), F.coalesce(F.col("embedding.qa_source"), F.lit("")).alias("qa_source"),
        F.col("classification.topic_primary").alias("topic_primary"), qa.alias("pos_qa_text"), body.alias("pos_body"), F.concat(qa, F.lit("\n\n"), body).alias("pos_qa_plus_body"), full.alias("pos_full_text"),
        real.isNotNull().alias("has_real_question"), synth.isNotNull().alias("has_synth_question"), facts.isNotNull().alias("has_facts"), analysis.isNotNull().alias("has_analysis"),
        conclusion.isNotNull().alias("has_conclusion"), body.isNotNull().alias("body_complete"), reason.alias("reason"), *(keep or []),
    )


def without(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not among `ids` (held-out or validation)."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_anti")


def coverage(pairs: DataFrame) -> DataFrame:
    """Counts by question source, qa source, topic and year in long form: dimension, value, n. One pass by grouping sets."""
    dims = ["question_source", "qa_source", "topic_primary", "year"]
    p = pairs.select(*[F.col(d).cast("string") for d in dims])
    flat = p.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("")).alias("value")) for d in dims])).alias("x")).select("x.*")
    return flat.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def counters(opinions: DataFrame, held: DataFrame) -> DataFrame:
    """outcome, n of every record, which add up to the input: duplicate_or_no_id, held_out, no_question, short_or_empty, emitted.

    The first that holds counts, in this order; opinions need `id` and an `ordinal` that tells first deliveries.
    """
    w = Window.partitionBy("id").orderBy("ordinal")
    seen = opinions.withColumn("_rn", F.row_number().over(w)).withColumn("_dup", F.col("id").isNull() | (F.col("_rn") > 1))
    gone = held.select(F.col(held.columns[0]).alias("_h")).distinct().withColumn("_out", F.lit(True))
    x = seen.join(gone, F.col("id") == F.col("_h"), "left")
    pair = build_pairs(x, keep=["_dup", "_out"])
    outcome = F.when(F.col("_dup"), "duplicate_or_no_id").when(F.col("_out"), "held_out").otherwise(F.coalesce("reason", F.lit("emitted")))
    return pair.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def question_coverage(opinions: DataFrame) -> DataFrame:
    """real, synthetic_only, neither: how many opinions have which question."""
    real, synth = filled(F.col("sections.question")), filled(F.col("sections.question_synthetic"))
    return opinions.agg(F.count_if(real.isNotNull()).alias("real"), F.count_if(real.isNull() & synth.isNotNull()).alias("synthetic_only"), F.count_if(real.isNull() & synth.isNull()).alias("neither"))


def language_model_texts(docs: DataFrame, id_col: str, text_col: str, held: DataFrame, least: int = 100) -> DataFrame:
    """id and text of the documents that aren't held out and have at least `least` characters."""
    return without(docs.filter(F.length(text_col) >= least), held, id_col).select(id_col, text_col)


def paraphrase_rows(pairs: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Two rows, a keyword and a fact-pattern question, for every pair with a parsed answer; all other columns as they were.

    answers: key, a (struct keyword, fact_pattern, or null where parsing failed).
    """
    forms = F.array(*[F.struct(F.col(f"a.{f}").alias("question"), F.lit(f"synthetic_{f}").alias("question_source")) for f in ("keyword", "fact_pattern")])
    x = pairs.drop("question", "question_source").join(answers.filter("a IS NOT NULL").select(key, "a"), key)
    return x.withColumn("_q", F.explode(forms)).select(*[c for c in x.columns if c != "a"], "_q.question", "_q.question_source")


def top_categories(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The n most frequent values of a column, ties by value; a global top-k, which Spark takes per partition first."""
    return df.groupBy(F.coalesce(F.col(col), F.lit("")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def fill_report(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """column, filled, total: how many rows have a non-empty value, conclusion_only derived from pos_qa_text."""
    p = pairs.withColumn("pos_conclusion_only", conclusion_section(F.col("pos_qa_text")))
    agg = p.agg(F.count("*").alias("total"), *[F.count_if(F.length(F.coalesce(c, F.lit(""))) > 0).alias(c) for c in [*cols, "pos_conclusion_only"]])
    return agg.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in [*cols, "pos_conclusion_only"]])).alias("x")).select("x.column", "x.filled", "total")


def with_extra(pairs: DataFrame, *extra: DataFrame) -> DataFrame:
    """The pairs and the rows of extra sets, as paraphrases are; columns that a set lacks are null."""
    for e in extra:
        pairs = pairs.unionByName(e, allowMissingColumns=True)
    return pairs


def training_report(pairs: DataFrame, val_ids: DataFrame, positive: str, rows: DataFrame) -> DataFrame:
    """outcome, n of training_rows: input_pairs, dropped_val_overlap, dropped_poscol_null, dropped_insufficient_hard_negs, training_rows; the first is the sum of the others."""
    gone = val_ids.select(F.col(val_ids.columns[0]).alias("opinion_id")).distinct().withColumn("_val", F.lit(True))
    made = rows.groupBy("pair_id").agg(F.count("*").alias("_rows"))
    x = pairs.select("pair_id", "opinion_id", positive).join(gone, "opinion_id", "left").join(made, "pair_id", "left")
    outcome = (
        F.when(F.col("_val"), "dropped_val_overlap").when(F.length(F.coalesce(F.col(positive), F.lit(""))) == 0, "dropped_poscol_null")
        .when(F.col("_rows").isNull(), "dropped_insufficient_hard_negs").otherwise("training_rows")
    )
    names = ["dropped_val_overlap", "dropped_poscol_null", "dropped_insufficient_hard_negs", "training_rows"]
    got = x.agg(F.count("*").alias("input_pairs"), *[F.count_if(outcome == n).alias(n) for n in names])
    return got.select(F.explode(F.array(*[F.struct(F.lit(n).alias("outcome"), F.col(n).alias("n")) for n in ["input_pairs", *names]])).alias("x")).select("x.*")


def training_rows(pairs: DataFrame, val_ids: DataFrame, positive: str, negatives: DataFrame | None = None, corpus: DataFrame | None = None, n_negatives: int = 0, query_prefix: str = "", doc_prefix: str = "", seed: str = "42") -> DataFrame:
    """anchor, positive, negatives (array) and shuffle_key of each training row.

    Validation opinions and rows without the positive column are left out. With n_negatives, a row takes the texts of
    its first n negatives (by `ordinal`) that have a non-empty text in `corpus` (doc_id, text), or is left out.
    negatives: opinion_id, neg_opinion_id, ordinal. Order by shuffle_key for the seeded shuffle.
    """
    p = without(pairs, val_ids, "opinion_id").filter(F.length(F.coalesce(F.col(positive), F.lit(""))) > 0)
    out = p.select("pair_id", "opinion_id", prefixed(query_prefix, F.col("question")).alias("anchor"), prefixed(doc_prefix, F.col(positive)).alias("positive"))
    if n_negatives:
        texts = corpus.filter(F.length("text") > 0).select(F.col("doc_id").alias("neg_opinion_id"), "text")
        w = Window.partitionBy("opinion_id").orderBy("ordinal", "neg_opinion_id")
        got = negatives.join(texts, "neg_opinion_id").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n_negatives)
        lists = got.groupBy("opinion_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: F.concat(F.lit(doc_prefix), x["text"])).alias("negatives"))
        out = out.join(lists.filter(F.size("negatives") == n_negatives), "opinion_id")
    else:
        out = out.withColumn("negatives", F.array().cast("array<string>"))
    return out.withColumn("shuffle_key", F.md5(F.concat(F.lit(seed + "|"), F.col("pair_id").cast("string"))))
