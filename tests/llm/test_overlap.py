import random

import pytest
from pyspark.sql import functions as F

from lodestar.llm import overlap
from lodestar.llm import common
from lodestar.llm.overlap import alike, coverage, coverage_report, expanded, opinion_key, opinion_members, question_words, split_overlaps, within


def test_opinion_keys(spark):
    same = [("82A107", "82a107", " 82 A 107 ", "82-A-107", "82Al07", "82A1O7"), ("A-82-103", "a–82–103", "A82103", "A 82 l03"), ("82-103", "82 103", "82–l03")]
    df = spark.createDataFrame([(i, s) for i, g in enumerate(same) for s in g] + [(9, "T-82-103"), (10, "83-103"), (11, None), (12, " - ")], "g int, s string")
    got = {}
    for r in df.select("g", opinion_key(F.col("s")).alias("k")).collect():
        got.setdefault(r["g"], set()).add(r["k"])
    assert all(len(v) == 1 for v in got.values()) and got[11] == got[12] == {None}
    assert len({next(iter(v)) for k, v in got.items() if k < 11}) == 5


def test_question_words():
    plain = question_words("May the council member report a disputed gift?")
    for s in ("QUESTION PRESENTED: may the Council member, report a disputed gift", "1. May the council rnember report a clisputed gift?", "May the council member re-\nport\n\n   [2]\n\na disputed gift?", "Question Presented — May the council member report a disputed gift"):
        assert question_words(s) == plain, s


def test_comparison():
    a = "a b c d e f g h i j k l m n o p".split()
    assert within(a, a, 0) and within(a, a[:3] + ["x"] + a[4:], 1) and not within(a, a[:3] + ["x"] + a[4:], 0)
    assert within(a, a[:3] + a[4:], 1) and within(a, a[:3] + ["x"] + a[3:], 1) and within(a, a[:3] + [a[4], a[3]] + a[5:], 1)
    assert not within(a, a[2:], 1)
    w = "council member accepted disputed payment report gift client former separate county fairground building official transit agency".split()
    broken = w[:5] + ["rep", "ort"] + w[6:10] + ["cou", "nty"] + w[11:]
    assert alike(w, broken, 0.125) and not alike(w, w[:8], 0.125)


@pytest.mark.parametrize("n", [60, 480, 540, 4000])
def test_words_run_together_make_no_difference_at_any_length(n):
    rng = random.Random(n)
    a = [f"w{rng.randrange(10**6)}x" for _ in range(n)]
    b = [x for i in range(0, n, 12) for x in [a[i] + a[i + 1], *a[i + 2 : i + 12]]]
    assert alike(a, b, 0.125) and alike(b, a, 0.125)
    b[3 : 3 + n // 8 + 2] = [f"new{k}" for k in range(n // 8 + 2)]
    assert not alike(a, b, 0.125)


def test_within_against_brute_force():
    def distance(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(9))] for _ in range(2))
        if "".join(a) != "".join(b):
            assert [within(a, b, k) for k in range(9)] == [distance(a, b) <= k for k in range(9)], (a, b)


def test_coverage():
    a = "a b c d e f g h".split()
    assert coverage(a, a) == 1 and coverage(a, a[:4] + ["x"] + a[5:]) == 7 / 8 and coverage(a, ["h", "c", "d", "a"]) == 2 / 8 and coverage(a, []) == 0


@pytest.mark.parametrize("shard, group, small", [(100_000, 20_000, 200_000), (7, 20_000, 200_000), (3, 2, 0)])
def test_overlaps(spark, monkeypatch, shard, group, small):
    monkeypatch.setattr(overlap, "SHARD_PASSAGES", shard)
    monkeypatch.setattr(overlap, "GROUP_TEXTS", group)
    monkeypatch.setattr(common, "SMALL", small)
    monkeypatch.setattr(common, "HOT", 2 if not small else 100_000)
    rng = random.Random(6)
    vocab = [f"{a}{b}{c}" for a in "bdfgkm" for b in ("ane", "oto", "ete") for c in ("k", "st", "me")]
    qs = [" ".join(rng.choice(vocab) for _ in range(n)) for n in [8, 12, 16, 24, 40] * 8]
    rows, want = [], set()
    for i, q in enumerate(qs):
        rows.append((i, f"90A{i:03d}", q, "test" if i % 2 else "val", 1))
        ws = q.split()
        for k in (0, max(1, len(ws) // 8), len(ws) // 8 + 3 + len(ws) // 8):
            t = list(ws)
            for x in rng.sample(range(len(t)), k):
                t[x] = f"new{x}"
            rows.append((1000 + 3 * i + min(k, 2) if k < 2 else 2000 + 10 * i + k, f"91A{i:03d}", ("QUESTION: " if k else "") + " ".join(t).upper(), "train", 1))
            if k <= max(1, len(ws) // 8):
                want.add((i, rows[-1][0]))
    rows += [(5000, "90-a-003", "Is this a gift?", "train", 1), (5001, None, None, "train", 1), (5002, "90A004", "Is this a gift?", None, 1), (5003, "", "Is this a gift?", "test", 1), (None, "90A001", qs[0], "train", 1), rows[0], rows[1]]
    want.add((3, 5000))
    pairs = spark.createDataFrame(rows, "pair_id long, opinion_id string, question string, split_name string, q int").repartition(3)
    neg = spark.createDataFrame([(10**9, "90 A 007", 1), (10**9, "90 A 007", 1), (10**9 + 1, "77-100", 1), (10**9 + 2, None, 1)], "neg_id long, opinion_id string, shard int")
    want.add((7, 10**9))
    parts = split_overlaps(pairs, neg)
    got = {(r["eval_id"], r["train_id"]) for r in expanded(*parts).collect()}
    assert got == want
    report = {r["eval_id"]: r for r in coverage_report(*parts).collect()}
    assert {k: r["opinions"] + r["questions"] + r["negatives"] for k, r in report.items()} == {i: sum(x == i for x, _ in want) for i, _ in want}
    assert report[0]["coverage"] == 1 and report[7]["negatives"] == 1
    assert expanded(*split_overlaps(pairs.limit(0), neg)).count() == 0
    assert {(r["eval_id"], r["train_id"]) for r in expanded(*split_overlaps(pairs, None)).collect()} == want - {(7, 10**9)}


def test_work_grows_with_the_data(spark, monkeypatch):
    """With many shards, what goes to them grows in proportion: neither side is copied to all of them."""
    monkeypatch.setattr(overlap, "SHARD_PASSAGES", 50)
    monkeypatch.setattr(overlap, "GROUP_TEXTS", 50)
    rng = random.Random(9)
    vocab = [f"{a}{b}{c}" for a in "bdfgkmprst" for b in ("ane", "oto", "ete", "ilu", "ora") for c in ("k", "st", "me", "ld", "rn", "x")]
    make = lambda n: [" ".join(rng.choice(vocab) for _ in range(16)) for _ in range(n)]
    sent = []
    real = overlap.small
    for n in (200, 800):
        shipped = []
        qs, ts = make(n), make(4 * n)
        e, t = (spark.createDataFrame([(x,) for x in xs], "q string") for xs in (qs, ts + qs))
        monkeypatch.setattr(overlap, "small", lambda df, *a: (shipped.append(df), real(df, *a))[1])
        assert overlap.question_links(e, t, 0.125, 2, 8).count() == n
        place = shipped[-1]
        cost = place.agg(F.sum("n_texts"), F.sum("n_passages"), F.countDistinct("shard")).first()
        sent.append((cost[0] + cost[1], cost[2]))
    assert sent[1][1] > 3 * sent[0][1] > 30 and sent[1][0] < 6 * sent[0][0]


def test_plans_hold_no_plan_many_times(spark):
    """The driver keeps the plans of a query; with those of all that was made before, at every place, they outgrow its memory."""
    qs = [f"may member {i} of the council of city {i * 7} accept gift {i * 13} from a client" for i in range(4)]
    pairs = spark.createDataFrame([(i, f"90A{i}", qs[i % 4], "test" if i < 4 else "train") for i in range(12)], "pair_id long, opinion_id string, question string, split_name string")
    neg = spark.createDataFrame([(100, "90-a-1")], "neg_id long, opinion_id string")
    e, t = (pairs.filter(pairs.split_name == x).select(F.col("question").alias("q")).distinct() for x in ("test", "train"))
    parts = split_overlaps(pairs, neg)
    for df, rows, most in ((overlap.question_links(e, t, 0.125, 1, 8), 4, 10), (expanded(*parts), 9, 20), (coverage_report(*parts), 4, 20)):
        assert df.count() == rows
        assert df._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") <= most


def test_hot_opinion(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL", 0)
    monkeypatch.setattr(common, "HOT", 10)
    pairs = spark.createDataFrame([(i, "90A1", "test") for i in range(3)] + [(10 + i, "90-a-1", "train") for i in range(25)] + [(99, None, "test")], "pair_id long, opinion_id string, split string")
    ev, tr = opinion_members(pairs, None)
    got = common.join_members(ev.withColumnRenamed("id", "eval_id"), tr, ["c"], "id")
    assert got.select("eval_id", "id").distinct().count() == got.count() == 75
