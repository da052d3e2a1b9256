import json

from lodestar.sources import io
from lodestar.streaming.metrics_log import append_new, read_metrics, stream_metrics


def test_opinions(spark, tmp_path):
    for year, name, id_ in (("1999", "b", "x"), ("1998", "a", "x"), ("1998", "c", None)):
        (tmp_path / year).mkdir(exist_ok=True)
        (tmp_path / year / f"{name}.json").write_text(json.dumps({"id": id_, "year": int(year), "sections": {"question": "q"}}))
    at = str(tmp_path)
    assert [(r["id"], r["year"]) for r in io.read_opinions(spark, at).collect()] == [("x", 1998)]
    assert [(r["id"], r["year"]) for r in io.read_opinions(spark, at, duplicates="last").collect()] == [("x", 1999)]
    assert sorted(r["id"] for r in io.read_opinions(spark, at, missing_id="stem", duplicates="keep").collect()) == ["c", "x", "x"]


def test_queries_and_negatives(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"id": "q1", "text": "t", "relevance_judgments": [{"opinion_id": "a", "score": 2}]}]}))
    assert io.read_queries(spark, str(tmp_path / "q.json")).first()["relevance_judgments"][0]["score"] == 2
    (tmp_path / "n.jsonl").write_text('{"opinion_id": "p", "negatives": [{"opinion_id": "b", "source": "bm25", "rank": 1}, {"opinion_id": "a", "source": "same_statute"}]}\n\n')
    assert [(r["ordinal"], r["neg_opinion_id"]) for r in io.read_hard_negatives(spark, str(tmp_path / "n.jsonl")).collect()] == [(0, "b"), (1, "a")]
    assert io.read_if_there(spark, str(tmp_path / "none.json"), "a int") is None


def test_writers_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    io.write_jsonl(df, str(tmp_path / "o"))
    io.write_jsonl(df, str(tmp_path / "o"), append=True)
    assert io.read_jsonl(spark, str(tmp_path / "o"), "id long, t string").count() == 4
    calls = []

    def encode(d):
        calls.append(1)
        return d.selectExpr("id", "array(cast(id as double)) AS v")

    for d in (df, df.repartition(2), df.filter("id = 1")):
        io.cached_vectors(d, "id", "t", encode, str(tmp_path / "c"), "m").count()
    assert len(calls) == 2
    assert [r["id"] for r in io.resume(df, df.filter("id = 1"), "id").collect()] == [2]


def test_metrics_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"step": 10, "epoch": 0.5, "r1_ndcg": 0.25, "loss": 1}\n')
    want = [(10, "loss", 1.0), (10, "ndcg", 0.25)]
    assert sorted((r["step"], r["metric"], r["value"]) for r in read_metrics(spark, str(tmp_path / "log"), "r1").collect()) == want
    s = stream_metrics(spark, str(tmp_path / "log"), "r1").writeStream.format("memory").queryName("m").outputMode("append").trigger(availableNow=True).start()
    s.awaitTermination(60)
    assert spark.table("m").count() == 2
    src = str(tmp_path / "todo")
    spark.createDataFrame([("a",), ("a",), ("b",)], "id string").write.json(src)
    for _ in range(2):
        q = append_new(spark.readStream.schema("id string").json(src), "id", str(tmp_path / "done"), str(tmp_path / "ck"))
        q.awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "done")).collect()) == ["a", "b"]


def test_read_run(spark, tmp_path):
    import json

    from lodestar.sources.io import read_run

    m = {"mrr": 0.5, "ndcg@5": 0.25, "r@20": 1.0}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "m.json").write_text(json.dumps({"label": "t1", "overall": m, "by_type": {"keyword": m}, "by_topic": {"gifts": m, "other": m}, "per_query": [{"query_id": "q1", "metrics": m}]}, indent=2))
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "m.json").write_text(json.dumps({"overall": m}))
    groups, per = read_run(spark, str(tmp_path / "*"))
    assert sorted((r["run_id"], r["group_kind"], r["group"], r["ndcg_5"], r["p_5"]) for r in groups.collect()) == [
        ("t1", "overall", "all", 0.25, None), ("t1", "query_topic", "gifts", 0.25, None), ("t1", "query_topic", "other", 0.25, None), ("t1", "query_type", "keyword", 0.25, None), ("two", "overall", "all", 0.25, None),
    ]
    assert [(r["run_id"], r["query_id"], r["mrr"]) for r in per.collect()] == [("t1", "q1", 0.5)]


def test_command_line(spark, tmp_path, capsys):
    from lodestar.cli import main

    spark.createDataFrame([(1, " 1. May we? ")], "pair_id int, question string").write.parquet(f"{tmp_path}/pairs.parquet")
    assert main([]) == 0 and "normalize_question" in capsys.readouterr().out
    assert main(["normalize_question", "--tables", str(tmp_path), "--out", f"{tmp_path}/out", "--format", "json"]) == 0
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/out/normalize_question").select("pair_id", "question").collect()] == [(1, "May we?")]
