"""Readers and writers: nested opinions, evaluation queries, JSON lines, configs, vectors with a content-keyed cache."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPINION = (
    "id string, year int, sections struct<question:string,question_synthetic:string,facts:string,analysis:string,conclusion:string,conclusion_synthetic:string,has_standard_format:boolean>, "
    "embedding struct<qa_text:string,qa_source:string>, citations struct<government_code:array<string>,regulations:array<string>,prior_opinions:array<string>,cited_by:array<string>>, "
    "classification struct<topic_primary:string,confidence:double,classification_method:string>, content struct<full_text:string>"
)
QUERIES = "queries array<struct<id:string,text:string,type:string,topic:string,issue:string,relevance_judgments:array<struct<opinion_id:string,score:int,rationale:string>>>>"


def read_opinions(spark: SparkSession, path: str, missing_id: str = "drop", duplicates: str = "first") -> DataFrame:
    """Opinions from <year>/<id>.json files, with file_name.

    missing_id: drop, or stem (the file's name without suffix). duplicates: first or last in order of year folder and
    file name, or keep.
    """
    df = spark.read.schema(OPINION).json(path, multiLine=True, recursiveFileLookup=True).withColumn("_path", F.col("_metadata.file_path"))
    parts = F.split("_path", "/")
    df = df.withColumn("_dir", F.element_at(parts, -2)).withColumn("file_name", F.element_at(parts, -1))
    stem = F.regexp_replace("file_name", r"\.json$", "")
    df = df.withColumn("id", F.coalesce("id", stem)) if missing_id == "stem" else df.filter("id IS NOT NULL")
    if duplicates != "keep":
        order = [F.col("_dir"), F.col("file_name")] if duplicates == "first" else [F.desc("_dir"), F.desc("file_name")]
        df = df.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter("_rn = 1").drop("_rn")
    return df.drop("_path", "_dir")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query_text, query_type, query_topic, issue, relevance_judgments from a file with a list `queries`."""
    q = spark.read.schema(QUERIES).json(path, multiLine=True).select(F.explode("queries").alias("q"))
    return q.select(F.col("q.id").alias("query_id"), F.col("q.text").alias("query_text"), F.col("q.type").alias("query_type"), F.col("q.topic").alias("query_topic"), "q.issue", "q.relevance_judgments")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a line that isn't JSON gives a row of nulls."""
    return spark.read.schema(schema).json(path)


def read_hard_negatives(spark: SparkSession, path: str) -> DataFrame:
    """opinion_id, ordinal, neg_opinion_id, source, rank, score, shared_codes in the order of the lists."""
    item = "struct<opinion_id:string,source:string,rank:int,score:double,shared_codes:array<string>>"
    df = spark.read.schema(f"opinion_id string, negatives array<{item}>").json(path)
    x = df.select("opinion_id", F.posexplode("negatives").alias("ordinal", "n"))
    return x.select("opinion_id", "ordinal", F.col("n.opinion_id").alias("neg_opinion_id"), "n.source", "n.rank", "n.score", "n.shared_codes")


def read_config(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The JSON of a path, None where it doesn't exist."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(schema).json(path, multiLine=True) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


METRIC_KEYS = {"mrr": "mrr", "ndcg@5": "ndcg_5", "ndcg@10": "ndcg_10", "p@5": "p_5", "p@10": "p_10", "r@10": "r_10", "r@20": "r_20"}


def read_run(spark: SparkSession, path: str, run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, per_query) of run result files (one JSON object each, with overall, by_type, by_topic and per_query), as the metric tables have them.

    groups: run_id, group_kind, group, metrics; per_query: run_id, query_id, metrics. run_id: as given, else the record's label or engine_name,
    else its file's folder. Missing parts give no rows, missing metrics nulls. Many files are read as one table.
    """
    m = "map<string,double>"
    schema = f"label string, engine_name string, overall {m}, by_type map<string,{m}>, by_topic map<string,{m}>, per_query array<struct<query_id:string,metrics:{m}>>"
    folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    x = spark.read.schema(schema).json(path, multiLine=True).withColumn("run_id", F.lit(run_id) if run_id else F.coalesce("label", "engine_name", folder))
    cells = lambda c: [F.try_element_at(c, F.lit(k)).alias(v) for k, v in METRIC_KEYS.items()]
    row = lambda kind, group, values: F.struct(F.lit(kind).alias("group_kind"), group.alias("group"), values.alias("m"))
    of = lambda c, kind: F.transform(F.coalesce(F.map_entries(c), F.array()), lambda e: row(kind, e["key"], e["value"]))
    all_ = F.filter(F.array(row("overall", F.lit("all"), F.col("overall"))), lambda r: r["m"].isNotNull())
    g = x.select("run_id", F.explode(F.concat(all_, of("by_type", "query_type"), of("by_topic", "query_topic"))).alias("x")).select("run_id", "x.group_kind", "x.group", *cells(F.col("x.m")))
    per = x.select("run_id", F.explode("per_query").alias("x")).select("run_id", "x.query_id", *cells(F.col("x.metrics")))
    return g, per


def read_vectors(spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Vectors as stored, with `norm` of every row."""
    norm = F.sqrt(F.aggregate(F.col(vec_col), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return spark.read.parquet(path).select(id_col, vec_col).withColumn("norm", norm)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file; it is written by one task, so give it aggregates only."""
    df.coalesce(1).write.mode("overwrite").json(path)


def content_key(df: DataFrame, id_col: str, text_col: str, model: str, prefix: str = "", max_length: int = 512) -> str:
    """A key of ids, texts and encoder settings: equal keys mean equal vectors. One aggregation; the order of rows doesn't matter."""
    settings = json.dumps([model, prefix, max_length])
    h = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(settings))
    r = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("s")).first()
    return f"{r['n']}-{(r['x'] or 0) & (2**64 - 1):016x}-{r['s'] or 0}"


def cached_vectors(df: DataFrame, id_col: str, text_col: str, encode, path: str, model: str, prefix: str = "", max_length: int = 512) -> DataFrame:
    """Vectors of texts, from the cache under `path` if the same texts were encoded before, else by encode(df) and stored."""
    spark = df.sparkSession
    at = f"{path}/key={content_key(df, id_col, text_col, model, prefix, max_length)}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at + "/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        encode(df).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def resume(todo: DataFrame, done: DataFrame | None, id_col: str) -> DataFrame:
    """What of a list hasn't been done yet."""
    return todo if done is None else todo.join(done.select(id_col).distinct(), id_col, "left_anti")
