import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import leakage
from lodestar.llm.leakage import align, leaks, terms

NAMES = [a + b + c for a in ("bal", "dor", "fen", "gan", "hol", "kes") for b in ("qua", "ri", "to", "ve") for c in ("mont", "ley", "sk", "pe")]


def sentence(rng, n):
    return " ".join(rng.choice(NAMES) for _ in range(n))


def test_align():
    item = np.arange(30, dtype=np.int32)
    text = np.concatenate((np.full(20, -1), item[5:25], np.full(20, -1))).astype(np.int32)
    assert align(item, text, 15, 0.125) == 20
    assert align(item, np.concatenate((item[5:15], np.full(9, -1), item[15:25])).astype(np.int32), 15, 0.125) == 20  # furniture between
    assert align(item, item[3:13].astype(np.int32), 15, 0.125) == 0  # too short
    assert align(item, item[::-1].copy(), 15, 0.125) == 0  # not in order
    changed = item[2:22].copy()
    changed[[4, 12]] = -1
    assert align(item, changed, 15, 0.125) >= 18
    changed[[1, 7, 9, 15]] = -1
    assert align(item, changed, 15, 0.125) == 0


def test_search(spark, monkeypatch):
    rng = random.Random(4)
    items = {i: (sentence(rng, 30), sentence(rng, 60)) for i in range(1, 9)}
    q = {i: items[i][0].split() for i in items}
    a = {i: items[i][1].split() for i in items}
    fill = lambda: sentence(rng, 150)
    scanned = " ".join(a[3][10:40]).replace("m", "rn").replace("d", "cl").upper()
    broken = "\n".join(" ".join(a[4][k : k + 6]) + ("-" if k == 12 else "") for k in range(0, 36, 6)).replace("-\n", "-\n\n   Page 3\n\n", 1)
    one = a[5][20:40]
    one[9] = "other"
    docs = {
        1: fill() + " " + " ".join(q[1][5:21]) + ". " + fill(), 2: f"{fill()} {scanned}, {fill()}", 3: f"{fill()}\n{broken}\n{fill()}", 4: fill() + " " + " ".join(one) + fill(), 5: fill() + " " + " ".join(q[6][:10]) + " " + fill(),
        6: fill() + " ".join(reversed(a[7])) + fill(), 7: fill(), 8: "", 9: None, 10: " ".join(f"{fill()} {' '.join(a[8][:20])}" for _ in range(60)),
    }
    rows = [(k, t, 1, "x") for k, t in docs.items()] + [(1, docs[1], 1, "x"), (None, docs[1], 1, "x")]
    df = spark.createDataFrame(rows, "pair_id long, t string, block int, term string").repartition(3)
    held = spark.createDataFrame([(i, *v, "y") for i, v in items.items()] + [(50, None, None, "y"), (51, "too short", "", "y"), (None, items[1][0], None, "y")], "item_id long, q string, a string, doc string")
    want = [(1, 1), (3, 2), (4, 3), (5, 4), (8, 10)]
    got = leaks(df, "pair_id", "t", held, "item_id", ["q", F.col("a")])
    assert sorted((r["item_id"], r["doc"]) for r in got.collect()) == want
    monkeypatch.setattr(leakage, "ITEM_WORDS", 200)
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 400)
    assert sorted((r["item_id"], r["doc"]) for r in leaks(df, "pair_id", "t", held, "item_id", ["q", "a"]).collect()) == want
    assert leaks(df.limit(0), "pair_id", "t", held, "item_id", ["q"]).count() == 0
    assert leaks(df, "pair_id", "t", held.limit(0), "item_id", ["q"]).count() == 0


def test_terms():
    assert terms("The ﬁling, re-\nport") == terms("the FILING report") and terms(None) == []


def test_lists():
    """Postings come back whole, whatever the blocks, and places of different texts lie apart."""
    rng = random.Random(2)
    texts = [sentence(rng, n) for n in (40, 0, 3, 200)]
    memo = {}
    ts = [leakage.term_ids(terms(t), memo) for t in texts]

    class Frame:  # stands for a table with one batch
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            import pyarrow as pa

            self.rows = [r for b in run([pa.RecordBatch.from_arrays([pa.array([7, 8, 9, 10]), pa.array(texts)], names=["id", "text"])]) for r in b.to_pylist()]
            return self

    frame = Frame()
    leakage.F, real = type("F", (), {"col": staticmethod(lambda c: type("C", (), {"cast": lambda s, t: s, "alias": lambda s, a: s})())}), leakage.F
    try:
        row = leakage.positional_index(frame, "a", "b").rows[0]
    finally:
        leakage.F = real
    block = leakage.Block(**{("terms_" if k == "terms" else k): v for k, v in row.items()})
    assert block.ids.tolist() == [7, 8, 9, 10] and len(block.places) == sum(map(len, ts))
    for d, t in enumerate(ts):
        assert block.has(block.lists(t), block.begins[d] + np.arange(len(t))).all()
    assert block.lists(np.array([12345], np.int64))[0] == -1 and not block.has(np.array([-1]), np.array([0])).any()
    assert block.near(block.lists(ts[3][:1]), np.array([block.begins[3] + 9]), 9).all()


def test_many_items_take_one_scan(spark, monkeypatch):
    rng = random.Random(11)
    vocab = [a + b for a in NAMES for b in ("", "in", "ard", "us")]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, make(24)) for i in range(20_000)]
    docs, want = [], set()
    for d in range(120):
        picked = rng.sample(range(20_000), 3)
        want.update((i, d) for i in picked)
        docs.append((d, " ".join(f"{make(40)} {items[i][1]} {make(40)}" for i in picked)))
    scans = []
    real = leakage.positional_index
    monkeypatch.setattr(leakage, "positional_index", lambda *a: (scans.append(1), real(*a))[1])
    got = leaks(spark.createDataFrame(docs, "d long, t string").repartition(2), "d", "t", spark.createDataFrame(items, "i long, q string"), "i", ["q"])
    assert {(r["item_id"], r["doc"]) for r in got.collect()} == want and len(scans) == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "ExistingRDD" in plan  # from the stored index, not from the texts
