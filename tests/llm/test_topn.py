import math

from lodestar.llm.topn import top_n_per_group, top_negatives

SCHEMA = "anchor_id string, source string, neg_id long, score double, rank int, position string, extra int"


def brute(rows, n):
    groups = {}
    for a, s, i, score, rank, *_ in set(rows):
        if a is not None and s is not None and score is not None and not math.isnan(score):
            groups.setdefault((a, s.strip().lower()), set()).add((-score, rank is None, rank or 0, i))
    return sorted((a, s, i) for (a, s), v in groups.items() for *_, i in sorted(v)[:n])


def test_against_brute_force_with_ties_copies_and_nulls(spark):
    rows = [("a" if k % 3 else "hot", (" bm25", "BM25 ", "x")[k % 3 if k % 5 else 0], k % 40, [None, float("nan"), 1.0, 2.0, 2.0][k % 5] if k % 40 < 35 else 9.0, None if k % 40 % 4 == 0 else k % 40 % 7, "p", 1) for k in range(400)]
    fixed = {}
    rows = [fixed.setdefault((r[0], r[1], r[2]), r) for r in rows] * 2 + [(None, "x", 1, 1.0, 1, "p", 1), ("a", None, 2, 1.0, 1, "p", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((r["anchor_id"], r["source"], r["neg_id"]) for r in top_negatives(df, 5).collect())
    assert got == brute(rows, 5)


def test_plan_has_group_limits_on_both_sides_of_the_shuffle_by_group(spark):
    df = spark.createDataFrame([("a", "s", 1, 1.0, 1, "p", 1)], SCHEMA)
    plan = top_n_per_group(df, ["anchor_id", "source"], "score", ["rank", "neg_id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and plan.count("Exchange hashpartitioning") == 2 and plan.count("Exchange hashpartitioning(anchor_id") == 1


def test_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_negatives(df).count() == 0
    one = spark.createDataFrame([("a", "s", 1, 1.0, None, "p", 7)] * 3, SCHEMA)
    assert top_negatives(one, 0).count() == 0
    got = top_n_per_group(one, ["anchor_id"], "score", ["rank", "neg_id"], 2).collect()
    assert len(got) == 1 and got[0]["position"] == 1 and got[0]["extra"] == 7
