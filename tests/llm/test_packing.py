import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm.common import encoder
from lodestar.llm.packing import pack, pack_texts, plan_containers


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25))
def test_plan_holds_everything(counts):
    plan = plan_containers(counts, 60)
    held = Counter()
    for pattern, n in plan:
        assert n > 0 and sum(s * k for s, k in pattern) <= 60
        assert sum(k for s, k in pattern if 3 * s > 60) <= 2
        for s, k in pattern:
            held[s] += k * n
    assert held == Counter(counts)


def test_plan_is_tight():
    rng = random.Random(3)
    counts = Counter(rng.randint(1, 2048) for _ in range(20_000))
    n = sum(m for _, m in plan_containers(counts, 2048))
    assert n <= 1.02 * sum(s * c for s, c in counts.items()) / 2048


def test_frame(spark):
    rows = [(k % 50, (k * 37) % 25 if k else None, 1) for k in range(300)] + [(1000, 105, 1), (None, 7, 1)]
    df = spark.createDataFrame(rows, "doc_id long, n int, size int").repartition(4)
    got = pack(df, "doc_id", "n", 20).collect()
    by, seen = {}, Counter()
    for r in got:
        if r["size"]:
            by.setdefault(r["container"], []).append(r)
            seen[r["doc_id"]] += r["size"]
        else:
            assert r["container"] is None and r["slot"] is None
    assert all(sum(r["size"] for r in v) <= 20 and sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    want = Counter()
    for i, n, _ in rows:
        want[i] += n or 0
    assert +seen == +want and sorted(by) == list(range(len(by)))
    assert sorted((r["piece"], r["first"], r["last"]) for r in got if r["doc_id"] == 1000) == [(0, 0, 20), (1, 20, 40), (2, 40, 60), (3, 60, 80), (4, 80, 100), (5, 100, 105)]
    assert {r["piece"] for r in got if r["doc_id"] != 1000 and r["size"] < 20} == {0} or all(r["last"] <= 25 for r in got if r["doc_id"] != 1000)
    assert pack(df.limit(0), "doc_id", "n", 20).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", "n", 0)


def test_texts(spark):
    texts = ["a b c", "", None, "  \n ", "word " * 3000, "ñandú 😀", "a b c"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = pack_texts(df, "doc_id", "text", 512).collect()
    size = Counter()
    for r in got:
        size[r["doc_id"]] += r["size"]
    assert all(size[i] == (len(encoder().encode_ordinary(t)) if t else 0) for i, t in enumerate(texts))
    assert all(r["container"] is None for r in got if r["doc_id"] in (1, 2))
