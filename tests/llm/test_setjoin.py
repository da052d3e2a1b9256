import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import setjoin
from lodestar.llm.setjoin import merge_lists, required, similar_in_group, similar_records, similar_sets


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), max_size=15), max_size=6), st.integers(1, 4), st.integers(0, 10), st.integers(10, 31))
def test_merge_counts_occurrences(lists, count, low, high):
    want = sorted((x, n) for x in range(low, high) if (n := sum(x in s for s in lists)) >= count)
    assert sorted(merge_lists([sorted(s) for s in lists if s], count, low, high)) == want


def test_required_overlap():
    for a, b in itertools.product(range(1, 15), repeat=2):
        o = required(a, b, 0.75)
        assert o / (a + b - o) >= 0.75 - 1e-9 or o > min(a, b)
        assert o == 0 or (o - 1) / (a + b - o + 1) < 0.75


@pytest.mark.parametrize("hot, threshold", [(20_000, 0.75), (3, 0.75), (2, 0.5), (1, 0.75)])
def test_join_against_brute_force(spark, hot, threshold):
    rng = random.Random(5)
    base = [frozenset(rng.sample(range(40), rng.randint(2, 12))) for _ in range(120)]
    for s in base[:80]:
        t = set(s)
        for _ in range(rng.randint(1, 2)):
            t.symmetric_difference_update({rng.choice([1, 2, 3, rng.randrange(40)])})
        base.append(frozenset(t))
    sets = sorted({s | {1} if rng.random() < 0.5 else s for s in base if s}, key=sorted)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)] + [(900, None), (901, [])], "id long, s array<bigint>")
    got = sorted(tuple(r) for r in similar_sets(df, "id", "s", threshold, 2, hot).collect())
    want = sorted((i, j) for i, j in itertools.combinations(range(len(sets)), 2) if min(len(sets[i]), len(sets[j])) >= 2 and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold - 1e-9)
    assert got == want and len(want) > 20


def test_records(spark):
    codes = ["§ 81001(a)", " 81002 ", "Gov. Code 81003", "81004"]
    rows = [(5, codes, 1, "n"), (5, codes, 1, "n"), (3, ["81004", "81003", "81002(b)", "81001", None, ""], 1, "n"), (7, codes + ["81005"], 1, "n"), (8, codes[:3], 1, "n"), (9, None, 1, "n"), (10, [], 1, "n"), (None, codes, 1, "n"), (11, ["none"], 1, "n"), (12, ["9" * 30] * 5 + codes, 1, "n")]
    df = spark.createDataFrame(rows, "neg_id long, shared_codes array<string>, class_id int, s string")
    links, members = similar_records(df, "neg_id", "shared_codes")
    assert sorted(tuple(r) for r in links.collect()) == [(3, 7), (3, 12)]
    assert sorted((r["rec"], r["class_id"], r["class_size"]) for r in members.collect()) == [(3, 3, 2), (5, 3, 2), (7, 7, 1), (12, 12, 1)]
    links, members = similar_records(df.limit(0), "neg_id", "shared_codes")
    assert links.count() == 0 and members.count() == 0
    with pytest.raises(ValueError):
        similar_sets(df, "neg_id", "shared_codes", 0)


def test_heap_skipping_runs(monkeypatch):
    """Within groups, lists are merged with a required count above one, which skips."""
    counts = []
    real = setjoin.merge_lists
    monkeypatch.setattr(setjoin, "merge_lists", lambda lists, count, low, high: (counts.append((len(lists), count)), real(lists, count, low, high))[1])
    rng = random.Random(8)
    sets = sorted({tuple(sorted({0, *rng.sample(range(1, 40), rng.randint(5, 9)), *(39 + k for k in range(rng.randint(1, 4)))})) for _ in range(300)}, key=lambda s: (len(s), s))
    got = sorted(similar_in_group([list(s) for s in sets], (0,), 0.6))
    want = sorted((i, j) for i in range(len(sets)) for j in range(i) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.6)
    assert got == want and len(want) > 20
    assert sum(c > 1 and n > 1 for n, c in counts) > len(counts) / 2


def test_hot_pair_of_values_is_split(spark, monkeypatch):
    """Sets that all share two values, in far more groups than one: no group holds more than about twice the bound."""
    rng = random.Random(1)
    sets = sorted({(1, 2, *sorted(rng.sample(range(3, 60), 4))) for _ in range(3000)})
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "id long, s array<bigint>")
    monkeypatch.setattr(setjoin, "TOP", 0)  # the order of the numbers, in which the two come first
    sizes = []
    real = setjoin._groups

    def counted(threshold):
        run = real(threshold)

        def over(batches):
            import pyarrow as pa

            rows = list(batches)
            tab = pa.Table.from_batches(rows) if rows else None
            if tab is not None and tab.num_rows:
                cols = [tab.column(c).to_pylist() if c in tab.column_names else [None] * tab.num_rows for c in ("k", "lo", "hi")]
                most = max(sum(1 for _ in g) for _, g in itertools.groupby(zip(*cols)))
                assert most <= 3 * 100, most
            yield from run(iter(rows))

        return over

    monkeypatch.setattr(setjoin, "_groups", counted)
    got = {tuple(r) for r in similar_sets(df, "id", "s", 0.7, 1, 100).collect()}
    want = set()
    by = {}
    for i, s in enumerate(sets):
        for part in itertools.combinations(s[2:], 3):
            by.setdefault(part, []).append(i)
    for ids in by.values():
        want.update(itertools.combinations(ids, 2))
    assert got == want and len(want) > 500
