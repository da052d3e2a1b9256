import random
import math
import statistics

import pytest
from pyspark.sql import functions as F

from lodestar.functions.similarity import jaccard, overlap
from lodestar.functions.stats import percent, rank_stats
from lodestar.operators import bm25, chunking, citations, compare, fusion, leakage, metrics, negatives, pairs, splits, vector


def test_set_similarity(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), (["a", "a"], ["a"])], "x array<string>, y array<string>")
    got = [tuple(r) for r in df.select(jaccard(F.col("x"), F.col("y")), overlap(F.col("x"), F.col("y")), jaccard(F.col("y"), F.col("x"))).collect()]
    assert got == [(1 / 3, 0.5, 1 / 3), (0, 0, 0), (1, 1, 1)]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 10, 100])
def test_rank_stats(spark, n):
    xs = sorted((i * 37) % 101 + 0.5 for i in range(n))
    df = spark.createDataFrame([("k", x) for x in xs] + [("k", None)], "k string, v double")
    r = rank_stats(df, ["k"], "v").first()
    if n == 0:
        assert r is None
        return
    assert (r["n"], r["p10"], r["p50"], r["p90"], r["p99"]) == (n, xs[n // 10], xs[n // 2], xs[int(0.9 * n)], xs[int(0.99 * n)])
    assert r["median"] == pytest.approx(statistics.median(xs))
    if n >= 4:
        q = statistics.quantiles(xs, n=4)
        assert (r["q1"], r["q3"]) == (pytest.approx(q[0]), pytest.approx(q[2]))
    else:
        assert r["q1"] is None


def test_percent(spark):
    assert [r[0] for r in spark.createDataFrame([(1, 3), (1, 0)], "a int, b int").select(percent(F.col("a"), F.col("b"))).collect()] == [33.33, 0.0]


def opinion(id_, **s):
    base = dict.fromkeys(("question", "question_synthetic", "facts", "analysis", "conclusion", "conclusion_synthetic"))
    return (id_, None, tuple((base | s).values()), ("qa text", None), (None,), ("full text",))


SCHEMA = (
    "id string, year int, sections struct<question:string,question_synthetic:string,facts:string,analysis:string,conclusion:string,conclusion_synthetic:string>, "
    "embedding struct<qa_text:string,qa_source:string>, classification struct<topic_primary:string>, content struct<full_text:string>"
)


def test_build_pairs(spark):
    q = "Is this long enough?"
    rows = [
        opinion("a", question=q, analysis="A"), opinion("b", question=q, facts="F", conclusion="C"), opinion("c", question_synthetic=q, facts="F", analysis="A"),
        opinion("d", question=q, analysis="A", conclusion=" ", conclusion_synthetic="S"), opinion("e"), opinion("f", question="fourteen chars"), opinion("g", question="fifteen chars..", question_synthetic=q),
    ]
    got = {r["opinion_id"]: r for r in pairs.build_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k]["pos_body"] for k in "abcd"] == [None, None, "F\n\nA", "A\n\nS"]
    assert [got[k]["reason"] for k in "aefg"] == [None, "no_question", "short_or_empty", None]
    assert got["c"]["question_source"] == "synthetic" and got["g"]["question_source"] == "real" and got["d"]["has_conclusion"] and got["d"]["year"] == 0
    assert got["c"]["pos_qa_plus_body"] == "qa text\n\nF\n\nA" and got["a"]["pos_qa_plus_body"] is None


def test_first_per_id_and_anti(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 0), ("b", 5)], "id string, o int")
    assert sorted(tuple(r) for r in pairs.first_per_id(df, "id", ["o"]).collect()) == [("a", 1), ("b", 5)]
    assert [r["id"] for r in pairs.without(df.filter("id = 'b' OR o = 1"), spark.createDataFrame([("a",)], "x string"), "id").collect()] == ["b"]


def test_splits(spark):
    df = spark.createDataFrame([(i, y) for y, n in ((1, 9), (2, 10), (3, 30), (4, 50)) for i in range(y * 1000, y * 1000 + n)], "id long, year int")
    got = {r["year"]: r["count"] for r in splits.fraction_per_stratum(df, "id", "year").groupBy("year").count().collect()}
    assert got == {3: 2, 4: 2}  # 0.45, 0.5, 1.5 and 2.5 rounded half to even
    again = splits.fraction_per_stratum(df.repartition(3), "id", "year")
    assert sorted(r["id"] for r in again.collect()) == sorted(r["id"] for r in splits.fraction_per_stratum(df, "id", "year").collect())
    assert splits.proportional_sample(df, "id", "year", 20).count() <= 20
    assert {r["year"] for r in splits.proportional_sample(df, "id", "year", 40).collect()} == {1, 2, 3, 4}


def test_bm25_matches_formula(spark):
    docs = {1: "gift gift rule", 2: "gift report", 3: "", 4: "lobby fee"}
    df = spark.createDataFrame([(k, v) for k, v in docs.items()] + [(5, None)], "id long, t string")
    terms = bm25.query_terms(spark.createDataFrame([("q", "gift gift rule"), ("none", "the")], "q string, t string"), "q", "t")
    got = {r["doc_id"]: r["score"] for r in bm25.scores(df, "id", "t", terms).collect()}
    avg = (3 + 2 + 0 + 2 + 0) / 5
    idf = lambda n: math.log(1 + (5 - n + 0.5) / (n + 0.5))
    w = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == {1: pytest.approx(2 * idf(2) * w(2, 3) + idf(1) * w(1, 3)), 2: pytest.approx(2 * idf(2) * w(1, 2))}


def test_vector_top_k(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8)).round(1)
    rows = [(i, m[i].tolist()) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(vector, "BLOCK", 2)
    got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in vector.top_k(df.filter("vec_id < 5"), df, 7).collect())
    s = (m @ m.T).round(9)
    want = sorted((q, k + 1, d) for q in range(5) for k, d in enumerate(sorted((d for d in range(60) if d != q), key=lambda d: (-s[q, d], d))[:7]))
    assert got == want
    assert vector.top_k(df.limit(0), df, 3).count() == 0


def test_graded_metrics(spark):
    # a score-1 document first and a score-2 document ninth
    run = spark.createDataFrame([("r", "q", 1, "a", 9.0)] + [("r", "q", k, f"x{k}", 1.0) for k in range(2, 9)] + [("r", "q", 9, "b", 0.5)], "run_id string, query_id string, rank int, doc_id string, score double")
    rel = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 0), ("none", "z", 0)], "query_id string, doc_id string, score int")
    got = {r["query_id"]: r for r in metrics.graded(run, rel).collect()}
    assert got["q"]["mrr"] == pytest.approx(1 / 9)
    ideal = 2 + 1 / math.log2(3)
    assert got["q"]["ndcg_5"] == pytest.approx(1 / ideal) and got["q"]["ndcg_10"] == pytest.approx((1 + 2 / math.log2(10)) / ideal)
    assert (got["q"]["p_5"], got["q"]["p_10"], got["q"]["r_10"]) == (0.2, 0.2, 1.0)
    assert all(got["none"][m] == 0 for m in metrics.METRICS)


def test_routing_and_fusion(spark):
    q = spark.createDataFrame([(k, "keyword") for k in ("empty", "plain", "cb", "one", "fuse", "nopool")], "query_id string, query_type string")
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "query_id string")
    pool = spark.createDataFrame(
        [("plain", "a", 2.0, 0.1, False), ("plain", "b", 0.0, 0.9, False), ("cb", "a", 2.6, 0.0, True), ("cb", "b", 2.0, 0.9, False), ("one", "a", 1.0, 0.5, True)]
        + [("fuse", "a", 2.0, 0.0, True), ("fuse", "b", 1.9, 0.5, True), ("fuse", "c", 0.0, 1.0, True)],
        "query_id string, doc_id string, bm25 double, cos double, from_citation boolean",
    )
    trials = [fusion.Trial("t"), fusion.Trial("type", w_sem_by_type={"keyword": 1.0}), fusion.Trial("boost", top1_threshold=0.9, boost_w_sem=0.0, w_sem_by_type={"keyword": 1.0}), fusion.Trial("gap", top1_threshold=0.9, gap_threshold=0.9, boost_w_sem=0.0)]
    ranking, diag = fusion.search(q, ids("plain", "cb", "one", "fuse", "nopool"), ids("cb", "one", "fuse", "nopool"), pool, trials)
    paths = {r["query_id"]: r["path"] for r in diag.filter("run_id = 't'").collect()}
    assert paths == {"empty": "empty_query", "plain": "bm25_only_noncite", "cb": "cb_fired", "one": "cb_fired", "fuse": "fusion", "nopool": "empty_pool"}
    order = lambda run, query: [r["doc_id"] for r in ranking.filter(f"run_id = '{run}' AND query_id = '{query}'").orderBy("rank").collect()]
    assert order("t", "plain") == ["a"] and order("t", "cb") == ["a", "b"]
    assert order("type", "fuse") == ["c", "b", "a"] and order("boost", "fuse") == ["a", "b", "c"]
    w = {r["run_id"]: r["w_sem"] for r in diag.filter("query_id = 'fuse'").collect()}
    assert w == {"t": 0.6, "type": 1.0, "boost": 0.0, "gap": 0.6}


def test_negatives(spark):
    scored = spark.createDataFrame([("p", f"d{k:02d}", 40.0 - k) for k in range(35)] + [("p", "p", 99.0)], "query_id string, doc_id string, score double")
    gone = spark.createDataFrame([("d00",), ("d02",)], "id string")
    lex = negatives.lexical_negatives(scored, gone, overfetch=6, k=5)
    assert [(r["neg_id"], r["rank"]) for r in lex.orderBy("rank").collect()] == [("d01", 1), ("d03", 2), ("d04", 3)]
    codes = spark.createDataFrame([("p", "1"), ("p", "2"), ("x", "1"), ("x", "2"), ("y", "2"), ("d01", "1"), ("z", "1")], "doc_id string, code string")
    st = citations.statute_neighbours(spark.createDataFrame([("p",)], "doc_id string"), codes, spark.createDataFrame([("z",)], "id string"))
    assert [(r["neg_id"], r["n_shared"]) for r in st.orderBy("rank").collect()] == [("x", 2), ("d01", 1), ("y", 1)]
    merged = negatives.merge_negatives(lex, st).orderBy("ordinal").collect()
    assert [(r["neg_id"], r["source"]) for r in merged] == [("d01", "bm25+same_statute"), ("d03", "bm25"), ("d04", "bm25"), ("x", "same_statute"), ("y", "same_statute")]


def test_compare(spark):
    per = spark.createDataFrame([("a", "1", 0.5), ("b", "1", 0.6), ("a", "2", 0.5), ("b", "2", 0.45), ("a", "3", 0.5)], "run_id string, query_id string, m double")
    d = compare.deltas(per, "a", "b", "m")
    q = spark.createDataFrame([("1", "x"), ("2", "x")], "query_id string, t string")
    r = compare.wins(d, q, ["t"]).filter("group_kind = 'overall'").first()
    # a change of exactly the margin is a win or a loss
    assert (r["n"], r["wins"], r["losses"], r["flat"]) == (2, 1, 1, 0)
    rows = [(run, str(i), 0.5 + (d if run == "b" else 0.0)) for i, d in enumerate((0.05, -0.05, 0.049, -0.049, 0.0)) for run in "ab"]
    r = compare.wins(compare.deltas(spark.createDataFrame(rows, "run_id string, query_id string, m double"), "a", "b", "m"), spark.createDataFrame([(str(i), "x") for i in range(5)], "query_id string, t string"), ["t"]).first()
    assert (r["n"], r["wins"], r["losses"], r["flat"]) == (5, 1, 1, 3)
    assert compare.oracle_mean(per, "a", "b", "m").first()["oracle"] == 0.55
    assert sorted(map(tuple, compare.join_runs(per, ["a", "b", "c"], "m").collect())) == [("1", 0.5, 0.6, None, 1), ("2", 0.5, 0.45, None, 1), ("3", 0.5, None, None, 2)]
    assert tuple(compare.filtered_mean(d, q, "t", "x").first()) == (2, 0.5, 0.525, 0.025) and compare.filtered_mean(d, q, "t", "none").first()["n"] == 0
    groups = spark.createDataFrame([("z", "overall", 0.5), ("a", "overall", 0.5), ("b", "overall", 0.4), ("b", "t", 0.9)], "run_id string, group_kind string, m double")
    assert compare.best_trial(groups, "m", ["b", "z", "a"]).first()["run_id"] == "z"  # the first of equal ones in the order of trials


def test_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(100)))), (2, ""), (3, None), (4, "a b")], "id long, t string")
    got = chunking.chunk_windows(df, "id", "t", 12, 3).collect()
    assert sorted((r["id"], r["chunk"], r["n_tokens"]) for r in got) == [(1, 0, 10), (1, 1, 10), (1, 2, 10), (4, 0, 2)]
    runs = [int(t) for r in sorted(got, key=lambda r: (r["id"], r["chunk"])) if r["id"] == 1 for t in r["tokens"]]
    assert runs == list(range(runs[0], runs[0] + 30))


def test_chunks_of_the_whole_text(spark, tmp_path):
    from lodestar.plans import catalog

    df = spark.createDataFrame([(1, " ".join(map(str, range(128 * 20 + 40)))), (2, "a " * 513), (3, "b " * 40)], "doc_id long, text string")
    got = sorted(chunking.chunk_windows(df, "doc_id", "text", 130).collect(), key=lambda r: (r["doc_id"], r["chunk"]))
    assert [int(t) for r in got if r["doc_id"] == 1 for t in r["tokens"]] == list(range(128 * 20 + 40))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.queries()["chunks"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["chunk"], r["n_tokens"]) for r in rows) == [(r["doc_id"], r["chunk"], r["n_tokens"]) for r in got]
    assert [sum(r["n_tokens"] for r in rows if r["doc_id"] == k) for k in (1, 2, 3)] == [2600, 512, 40]


def test_leakage_measures(spark):
    q = spark.createDataFrame([("q", "keyword", "gift rules report")], "query_id string, query_type string, query_text string")
    rel = spark.createDataFrame([("q", "a", 2), ("q", "gone", 1)], "query_id string, doc_id string, score int")
    o = spark.createDataFrame([("a", "May the gift report be late?")], "doc_id string, question string")
    got = {r["doc_id"]: r for r in leakage.measure(q, rel, o).collect()}
    assert got["a"]["token_jaccard"] == 0.5 and got["a"]["query_overlap"] == 0.667 and got["gone"]["token_jaccard"] is None


def test_trials_from_config(spark):
    config = {"trials": [{"label": "a", "w_bm25": 0.9, "w_sem": 0.4, "cb_threshold": 1.3}, {"label": "b", "w_sem": 0.4, "cb_threshold": 2.0, "semantic_only_path": True}, {"label": "c", "w_sem": 0.1, "cb_threshold": 2.0, "w_sem_by_type": {"keyword": 0.2}}]}
    got = fusion.trials_from_config(config)
    assert [(t.label, t.w_sem, t.all_path) for t in got] == [("a", 0.4, False), ("b", 0.4, True), ("c", 0.1, True)] and got[2].w_sem_by_type == {"keyword": 0.2} and got[0].boost_w_sem == 0.7


def test_adaptive_rule_and_control_trial(spark):
    q = spark.createDataFrame([("q", "keyword")], "query_id string, query_type string")
    pool = spark.createDataFrame([("q", "a", 2.0, 0.0, True), ("q", "b", 1.9, 0.5, True), ("q", "c", 0.0, 1.0, True)], "query_id string, doc_id string, bm25 double, cos double, from_citation boolean")
    run = lambda trials, **k: [r["doc_id"] for r in fusion.search(q, q, q, pool, trials, **k)[0].filter(f"run_id = '{trials[0].label}'").orderBy("rank").collect()]
    assert run([fusion.Trial("x", w_sem=0.0)]) == ["a", "b", "c"]
    assert run([fusion.Trial("x", w_sem=0.0)], adaptive=lambda top, mean, w: F.when(top > 0.9, 1.0).otherwise(w)) == ["c", "b", "a"]
    assert run([fusion.Trial("control", w_sem=0.4, top1_threshold=999.0)]) == run([fusion.Trial("plain", w_sem=0.4)])


def test_counters_add_up(spark):
    q = "Is this long enough?"
    rows = [(*opinion("a", question=q), 1), (*opinion("a", question=q), 2), (*opinion("h", question=q), 3), (*opinion("n"), 4), (*opinion("s", question="short"), 5), (*opinion(None, question=q), 6)]
    df = spark.createDataFrame(rows, SCHEMA + ", ordinal int")
    got = {r["outcome"]: r["n"] for r in pairs.counters(df, spark.createDataFrame([("h",), ("h",)], "x string")).collect()}
    assert got == {"emitted": 1, "duplicate_or_no_id": 2, "held_out": 1, "no_question": 1, "short_or_empty": 1}
    assert tuple(pairs.question_coverage(df).first()) == (5, 0, 1)


def test_paraphrase_rows(spark):
    p = spark.createDataFrame([(1, "q", "real", 2000), (2, "q", "real", 2001)], "pair_id int, question string, question_source string, year int")
    a = spark.createDataFrame([(1, ("k", "f")), (2, None)], "pair_id int, a struct<keyword:string,fact_pattern:string>")
    assert sorted(tuple(r) for r in pairs.paraphrase_rows(p, a, "pair_id").collect()) == [(1, 2000, "f", "synthetic_fact_pattern"), (1, 2000, "k", "synthetic_keyword")]


def test_gold_ranks_beyond_the_counters(spark):
    # q1: 2,500 documents, ties of two; the judged ones stand beyond 1000; q2 has none of its judged documents scored
    run = spark.createDataFrame([("q1", f"d{k:04d}", 5000.0 - k // 2) for k in range(2500)] + [("q2", "d0001", 1.0)], "query_id string, doc_id string, score double")
    qrels = spark.createDataFrame([("q1", "d1912", 2), ("q1", "d2001", 2), ("q1", "d0099", 1), ("q1", "d0999", 1), ("q1", "d0001", 0), ("q1", "gone", 1), ("q2", "d0007", 2)], "query_id string, doc_id string, score int")
    ranks = bm25.ranks_of(run, qrels)
    assert sorted(map(tuple, ranks.collect())) == [("q1", "d0001", 2), ("q1", "d0099", 100), ("q1", "d0999", 1000), ("q1", "d1912", 1913), ("q1", "d2001", 2002)]
    assert sorted(map(tuple, metrics.gold_ranks(ranks, qrels).collect())) == [("q1", 1913, 0, 1, 2), ("q2", 99999, 0, 0, 0)]


def test_gold_ranks_query_has_no_cut(spark, tmp_path):
    from lodestar.plans import catalog

    # 1,200 shorter opinions are better than the judged ones
    held = [(k, f"d{k:04d}", "q", "gift" + " council" * (k >= 1200)) for k in range(1300)]
    spark.createDataFrame(held, "item_id long, opinion_id string, question string, pos_qa_text string").write.parquet(f"{tmp_path}/heldout_pairs.parquet")
    spark.createDataFrame([], "pair_id long, opinion_id string, question string, pos_qa_text string, pos_full_text string").write.parquet(f"{tmp_path}/pairs.parquet")
    judged = [("q1", "gift", [("d1249", 2), ("d0004", 1), ("d1205", 1)])]
    spark.createDataFrame(judged, "query_id string, query_text string, relevance_judgments array<struct<opinion_id:string,score:int>>").write.parquet(f"{tmp_path}/eval_queries.parquet")
    assert [tuple(r) for r in catalog.queries()["gold_ranks"](spark, str(tmp_path)).collect()] == [("q1", 1250, 0, 1, 1)]


@pytest.mark.parametrize("holders", [1, 3, 20])
def test_common_codes_make_no_pairs_but_the_same_neighbours(spark, holders):
    rng = random.Random(holders)
    rows = {(f"d{i:02d}", str(c)) for i in range(40) for c in ({rng.randrange(30) for _ in range(rng.randint(0, 4))} | ({100} if rng.random() < 0.7 else set()) | ({101} if rng.random() < 0.5 else set()))}
    codes = spark.createDataFrame(sorted(rows), "doc_id string, code string")
    asked = spark.createDataFrame([(f"d{i:02d}",) for i in range(0, 40, 3)], "doc_id string")
    gone = spark.createDataFrame([("d01",), ("d02",)], "id string")
    of = {}
    for d, c in rows:
        of.setdefault(d, set()).add(c)
    want = []
    for i in range(0, 40, 3):
        d = f"d{i:02d}"
        near = sorted((-len(of.get(d, set()) & cs), n) for n, cs in of.items() if n != d and n not in ("d01", "d02") and of.get(d, set()) & cs)[:5]
        want += [(d, n, -k, r + 1) for r, (k, n) in enumerate(near)]
    got = sorted(map(tuple, citations.statute_neighbours(asked, codes, gone, 5, holders).collect()))
    assert got == sorted(want)


def test_full_ranks(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None)], "query_id string, v array<double>")
    d = spark.createDataFrame([(f"d{i}", [float(i // 2), 1.0]) for i in range(9)] + [("null", None)], "doc_id string, v array<double>").repartition(3)
    rel = spark.createDataFrame([("q", "d8"), ("q", "d1"), ("q", "d0"), ("q", "gone"), ("q", "null"), ("none", "d1")], "query_id string, doc_id string")
    assert sorted(map(tuple, vector.full_ranks(q, d, rel).collect())) == [("q", "d0", 8), ("q", "d1", 9), ("q", "d8", 1)]


def test_training_report_and_extra_pairs(spark):
    p = spark.createDataFrame([(1, "a", "x"), (2, "v", "x"), (3, "b", ""), (4, "c", None), (5, "d", "x")], "pair_id int, opinion_id string, body string")
    made = spark.createDataFrame([(1,)], "pair_id int")
    got = {r["outcome"]: r["n"] for r in pairs.training_report(p, spark.createDataFrame([("v",), ("v",)], "id string"), "body", made).collect()}
    assert got == {"input_pairs": 5, "dropped_val_overlap": 1, "dropped_poscol_null": 2, "dropped_insufficient_hard_negs": 1, "training_rows": 1}
    both = pairs.with_extra(p, spark.createDataFrame([(9, "e")], "pair_id int, opinion_id string"))
    assert both.count() == 6 and both.filter("pair_id = 9").first()["body"] is None


def test_leakage_summary_and_missing(spark):
    rows = [(f"q{i}", "k", "d", 2 if i < 5 else 1, 0.1 * i, 0.2, 0.0625) for i in range(6)] + [("n", "k", "d", 2, None, None, None)]
    m = spark.createDataFrame(rows, "query_id string, query_type string, doc_id string, score int, token_jaccard double, char_jaccard_5 double, query_overlap double")
    got = {(r["group_kind"], r["measure"]): r for r in leakage.summary(m).collect()}
    assert len(got) == 7 and (got["overall", "token_jaccard_score2"]["n"], got["overall", "token_jaccard_score1plus"]["n"]) == (5, 6)
    assert got["query_type", "query_overlap_score2"]["mean"] == 0.062  # halves to even
    rel = spark.createDataFrame([("q", "a", 2), ("q", "gone", 2), ("q", "b", 1)], "query_id string, doc_id string, score int")
    assert sorted(map(tuple, leakage.missing(rel, spark.createDataFrame([("a",), ("b",), ("a",)], "doc_id string")).collect())) == [(1, 1, 0), (2, 2, 1)]


def test_lexical_route_takes_no_more_than_the_pool(spark):
    with pytest.raises(ValueError):
        fusion.search(None, None, None, None, [], k=101)


@pytest.mark.parametrize("block, doc_block", [(100, 100), (100, 7), (3, 7)])
def test_bm25_best_is_the_first_of_all_scores(spark, monkeypatch, block, doc_block):
    monkeypatch.setattr(bm25, "BLOCK", block)
    monkeypatch.setattr(bm25, "DOC_BLOCK", doc_block)
    words = "gift rule board member city water 87103(a) council lease the".split()
    # many copies, so ties by id decide what is among the first
    df = spark.createDataFrame([(f"d{k:02}", " ".join(words[j] for j in range(10) for _ in range((k % 9) * (j + 3) % 4))) for k in range(60)] + [("null", None), ("none", "zzz")], "id string, t string").repartition(3)
    q = [("q1", "gift rule"), ("q2", "water council council"), ("q3", "87103(a) lease"), ("q4", "unheard word"), ("q5", "the"), ("q6", "city gift water lease"), ("q7", "zzz")]
    terms = bm25.query_terms(spark.createDataFrame(q, "q string, t string"), "q", "t")
    first = lambda s: [(r["query_id"], r["doc_id"], r["rank"], round(r["score"], 9)) for r in bm25.top_k(s, 4).orderBy("query_id", "rank").collect()]
    best = bm25.best(df, "id", "t", terms, 4)
    assert first(best) == first(bm25.scores(df, "id", "t", terms)) and len(first(best)) == 4 * 4 + 1
    # candidates only: 4 of each query for every block that a task has seen, not every document with a common term
    assert best.count() < bm25.scores(df, "id", "t", terms).count() and bm25.best(df.limit(0), "id", "t", terms, 4).count() == 0


def test_lexical_negatives_make_no_row_of_every_pair(spark, tmp_path):
    from lodestar.plans import catalog

    rows = [(k, f"o{k:03}", "gift rule city board", f"gift rule city board {k % 7} {'lease ' * (k % 11)}", "train") for k in range(400)]
    spark.createDataFrame(rows, "pair_id long, opinion_id string, question string, pos_full_text string, split_name string").coalesce(1).write.parquet(f"{tmp_path}/pairs.parquet")
    spark.createDataFrame([], "opinion_id string").write.parquet(f"{tmp_path}/heldout_pairs.parquet")
    made = []

    def cut(scored, *rest, **more):
        made.append(scored.count())
        return negatives_of(scored, *rest, **more)

    negatives_of, negatives.lexical_negatives = negatives.lexical_negatives, cut
    try:
        assert catalog.lexical_negatives(spark, str(tmp_path)).count() == 20 * 5
    finally:
        negatives.lexical_negatives = negatives_of
    # 20 opinions asked; all 8,000 pairs share terms
    assert made[0] <= 20 * 30 * 4


def test_hard_negatives_seek_statute_neighbours_of_the_asked_only(spark, tmp_path, monkeypatch):
    from lodestar.plans import catalog

    rows = [(k, f"o{k:02}", "gift rule city board", f"gift rule Section {81000 + k % 3} {k % 7}", "train") for k in range(60)]
    spark.createDataFrame(rows, "pair_id long, opinion_id string, question string, pos_full_text string, split_name string").coalesce(1).write.parquet(f"{tmp_path}/pairs.parquet")
    spark.createDataFrame([], "opinion_id string").write.parquet(f"{tmp_path}/heldout_pairs.parquet")
    asked, neighbours = [], citations.statute_neighbours
    monkeypatch.setattr(citations, "statute_neighbours", lambda positives, *rest: asked.append(sorted(r[0] for r in positives.select("doc_id").distinct().collect())) or neighbours(positives, *rest))
    got = [tuple(r) for r in catalog.merged_negatives(spark, str(tmp_path)).filter("n_shared IS NOT NULL").select("doc_id", "neg_id", "n_shared").orderBy("doc_id", "neg_id").collect()]
    want = catalog.statute(spark, str(tmp_path)).filter("doc_id IN ('o00', 'o20', 'o40')").select("doc_id", "neg_id", "n_shared").orderBy("doc_id", "neg_id").collect()
    assert got == [tuple(r) for r in want] and len(got) == 15 and asked[0] == ["o00", "o20", "o40"]


def test_token_lists_are_the_retrieval_tokens(spark):
    import pyarrow as pa

    from lodestar.functions import text as T

    odd = ["", " ", "-", "--a b", "§ 87103(a)(2) and 1(b)2(c)", "İstanbul K 5(A)", "a\x00b", "\n\n", "the", "É x\x85y z", "𝒳 gift-", " The GIFT, the rule. ", "(a) a1(b)(c)"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string").orderBy("k")
    lower = [r[0] for r in df.select(F.lower("t")).collect()]
    want = [r[0] for r in df.select(T.retrieval_tokens(F.col("t"))).collect()]
    assert T.retrieval_token_lists(pa.array(lower, pa.string())).to_pylist() == want
    assert T.retrieval_token_lists(pa.array(["x", *lower], pa.string())[1:]).to_pylist() == want and T.retrieval_token_lists(pa.array([], pa.string())).to_pylist() == []
