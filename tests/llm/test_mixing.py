import pytest

from lodestar.llm.common import encoder
from lodestar.llm.mixing import allot, mix_sources, schedule_segments


def test_allot():
    t = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 1), ("none", 0.1, 2)]
    got = allot({"a": 1000, "b": 100, "c": 900}, t)
    total = sum(got.values())
    assert got["a"] / total == pytest.approx(0.5) and got["b"] == pytest.approx(400) and "none" not in got
    full = allot({"a": 1000, "b": 100, "c": 900}, t, 1800)
    assert full["b"] == 400 and full["a"] == pytest.approx(1000) and full["c"] == pytest.approx(400)
    assert sum(allot({"a": 10}, t, 10**6).values()) == 10 and allot({}, t) == {} and allot({"a": 5}, [("a", 0.5, 0)]) == {}


def test_segments():
    s = schedule_segments(((0.0, 2.0), (0.5, 0.0), (1.0, 0.0)))
    assert len(s) == 1 and s[0][5] == float("inf")
    s = schedule_segments(((0.2, 1.0), (1.0, 3.0)))
    assert [round(x[4], 6) for x in s] == [0.0, round(0.2 / 1.8, 6)]
    for bad in (((0.0, -1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 0.0)), ((0.0, 1.0), (2.0, 1.0))):
        with pytest.raises(ValueError):
            schedule_segments(bad)


def test_mixture(spark, monkeypatch):
    import lodestar.llm.mixing as m

    monkeypatch.setattr(m, "BUCKET_ROWS", 20)
    rows = [(i, f"w{i} " * (1 + i % 7), ("A ", "b", "B", None, "other")[i % 5], 1, 2) for i in range(300)] + [(900, "", "a", 1, 2), (901, None, "a", 1, 2), (None, "x", "a", 1, 2), (1, "w1 w1", "b", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repeat int, u int").repartition(3)
    targets = spark.createDataFrame([("a", 0.8, 3), ("b", 0.1, 2), ("missing", 0.1, 5)], "source_name string, target_share double, max_repeats int")
    placed, report = mix_sources(docs, targets, "doc_id", "text", "source", schedules={"a": ((0.0, 2.0), (0.5, 1.0), (1.0, 0.0))})
    got = placed.collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got) and all(0 <= r["position"] < 1 for r in got)
    rep = {r["source"]: r for r in report.collect()}
    assert rep["a"]["actual_share"] == pytest.approx(0.8 / 0.9, abs=0.02) and rep["a"]["repeats"] <= 3 and rep["b"]["repeats"] <= 2
    assert rep["missing"]["used_tokens"] == 0 and rep["other"]["target_share"] == 0 and rep[None]["used_tokens"] == 0
    assert sum(r["actual_share"] for r in rep.values()) == pytest.approx(1)
    # passes before the last use every document once
    for source in ("a", "b"):
        last = max(r["repeat"] for r in got if r["source"] == source)
        docs_of = {i for i, t, s, *_ in rows if s and s.strip().lower() == source and t and i is not None}
        for k in range(last):
            assert {r["doc_id"] for r in got if r["source"] == source and r["repeat"] == k} == docs_of
    # weight falls from 2 to 0: three quarters of a's tokens... by half time
    a = [r for r in got if r["source"] == "a"]
    early = sum(r["n_tokens"] for r in a if r["position"] < 0.5) / sum(r["n_tokens"] for r in a)
    assert early == pytest.approx(0.75, abs=0.03)
    n = {i: len(encoder().encode_ordinary(t)) for i, t, *_ in rows if t and i != 1}
    assert all(r["n_tokens"] == n[r["doc_id"]] for r in got if r["doc_id"] != 1)
    placed, report = mix_sources(docs.limit(0), targets, "doc_id", "text", "source")
    assert placed.count() == 0 and report.count() == 3
