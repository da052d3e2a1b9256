"""All pairs of set-valued records with a Jaccard similarity above a threshold, by T-occurrence list merging.

Sets are integers in a fixed total order (rare values first). Two sets with the required overlap share a value among
the first few of each (the prefix), so each set is posted under the values of its prefix; inside one such posting
group the sets' other values form small inverted lists. A probe merges its shorter lists through a heap, skipping
by binary search over entries that can't reach the required count, and looks the rest up in its far longest lists by
binary search. A pair is emitted only in the group of its first common values, hence once.
Groups of more than `hot` sets are posted again under one more value, and again, DEPTH values deep; what is still hot then, or
can't be split by values, is joined in blocks of probes times blocks of sets. So no task holds more than about 2 * hot sets.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heappush
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import join_members, keep, shuffle_width, small

#: Order keys: rare values keep their own number, the `TOP` most frequent come after all of them by frequency.
TOP = 20_000
_FREQUENT = 1 << 61
DEPTH = 5  # values of a key at most
LONG = 8  # times the middle length makes a list one to be searched instead of merged


def required(a: int, b: int, threshold: float) -> int:
    """The least overlap of sets of a and b values with Jaccard similarity >= threshold."""
    return ceil(threshold * (a + b) / (1 + threshold) - 1e-9)


def merge_lists(lists: list[list[int]], count: int, low: int, high: int) -> list[tuple[int, int]]:
    """(entry, occurrences) for the entries in [low, high) on at least `count` of the ascending lists.

    Heap merge with skipping: while fewer than `count` lists stand on the smallest entry, count - 1 heads are taken
    off and moved by binary search to the next head, below which no entry can reach the count.
    """
    heap = []
    for k, entries in enumerate(lists):
        p = bisect_left(entries, low)
        if p < len(entries) and entries[p] < high:
            heap.append((entries[p], k, p))
    heapify(heap)
    out = []

    def move(k: int, p: int) -> None:
        entries = lists[k]
        if p < len(entries) and entries[p] < high:
            heappush(heap, (entries[p], k, p))

    while len(heap) >= count:
        first = heap[0][0]
        taken = []
        while heap and heap[0][0] == first:
            taken.append(heappop(heap))
        if len(taken) >= count:
            out.append((first, len(taken)))
            for _, k, p in taken:
                move(k, p + 1)
            continue
        while len(taken) < count - 1 and heap:
            taken.append(heappop(heap))
        if not heap:
            break
        goal = heap[0][0]
        for _, k, p in taken:
            move(k, bisect_left(lists[k], goal, p))
    return out


def split_lists(own: list[list[int]], need: int) -> tuple[list[list[int]], list[list[int]]]:
    """(lists to merge, lists to search): the far longest are searched, but so many stay that an entry must be on two of them, if need be at all."""
    own.sort(key=len)
    most = need - 2 if need > 2 else need - 1
    middle = len(own[len(own) // 2])
    aside = 0
    while aside < min(most, len(own) - 1) and len(own[-1 - aside]) > LONG * middle:
        aside += 1
    return own[: len(own) - aside], own[len(own) - aside :]


def similar_in_group(sets: list, key: tuple, threshold: float, blocks: list | None = None):
    """Pairs (i, j), j < i, of one posting group; sets ascend by size, each an ascending list of order keys.

    key: the values by which all sets of the group are posted, which get no list of their own. blocks: with it, only pairs of
    different blocks.
    """
    n_skip = len(key)
    lists: dict[int, list[int]] = {}
    sizes = [len(s) for s in sets]
    for i, s in enumerate(sets):
        n = len(s)
        least = ceil(threshold * n - 1e-9)
        need = max(required(n, least, threshold), 1) - n_skip  # over the smallest partner; each pair is held against its own below
        found = []
        own = []
        for v in s:
            if v in key:
                continue
            got = lists.get(v)
            if got is None:
                lists[v] = [i]
            else:
                if got[-1] != i:
                    own.append(got)
        low = bisect_left(sizes, least, 0, i)
        if need <= 0:  # the key may be all that is required: only sets of a few values
            mine = set(s)
            found = [j for j in range(low, i) if len(mine.intersection(sets[j])) >= required(n, sizes[j], threshold)]
        elif low < i and len(own) >= need:
            short, aside = split_lists(own, need)
            for j, c in merge_lists(short, max(need - len(aside), 1), low, i):
                for entries in aside:
                    p = bisect_left(entries, j)
                    c += p < len(entries) and entries[p] == j
                if c >= required(n, sizes[j], threshold) - n_skip:
                    found.append(j)
        for got in own:
            got.append(i)
        for j in found:
            if blocks is None or blocks[i] != blocks[j]:
                yield i, j


def _order_keys(flat: np.ndarray, values: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Order keys of values: frequent ones by rank, after all the rare ones."""
    if len(values) == 0:
        return flat
    at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
    return np.where(values[at] == flat, _FREQUENT + ranks[at], flat)


def similar_sets(sets: DataFrame, id_col: str, set_col: str, threshold: float = 0.75, min_size: int = 1, hot: int = 20_000) -> DataFrame:
    """rec_a < rec_b of all pairs of distinct sets with Jaccard similarity >= threshold.

    sets: one row per distinct set; set_col: array<bigint> without nulls or repeats, values in [0, 2^61).
    Sets of fewer than min_size values (empty ones always) and null sets have no pairs.
    Only the TOP most frequent values go to all tasks (a fixed bound); all others come before them in the order.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = sets.sparkSession
    src = sets.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{set_col}`").alias("s")).filter(F.size("s") >= max(min_size, 1))
    freq = src.select(F.explode("s").alias("v")).groupBy("v").count().orderBy(F.desc("count"), "v").limit(TOP).collect()
    by_value = sorted((r["v"], len(freq) - k) for k, r in enumerate(freq))
    values, ranks = np.array([v for v, _ in by_value], np.int64), np.array([r for _, r in by_value], np.int64)

    def post(batches, keys_only=False):
        import pyarrow as pa

        for b in batches:
            ids, col = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            flat, offs = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), col.offsets.to_numpy().astype(np.int64)
            offs = offs - offs[0]
            size = np.diff(offs)
            # rare first: fewer occurrences, smaller rank
            key = _order_keys(flat, values, ranks)
            owner = np.repeat(np.arange(len(size)), size)
            key = key[np.lexsort((key, owner))]
            prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
            rec = np.repeat(np.arange(len(size)), prefix)
            place = np.arange(len(rec)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            lens = size[rec]
            starts = offs[:-1][rec]
            if keys_only:
                yield pa.RecordBatch.from_arrays([pa.array(key[starts + place])], names=["w"])
                continue
            o = np.concatenate(([0], np.cumsum(lens)))
            take = np.repeat(starts - o[:-1], lens) + np.arange(o[-1])
            for at in range(0, len(rec), 50_000):
                to = min(at + 50_000, len(rec))
                part = pa.ListArray.from_arrays(pa.array(o[at : to + 1] - o[at], pa.int32()), pa.array(key[take[o[at] : o[to]]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[starts[at:to] + place[at:to]]), pa.array(ids[rec[at:to]]), pa.array(lens[at:to].astype(np.int32)), part], names=["w", "id", "n", "s"]
                )

    posted = src.mapInArrow(post, "w long, id long, n int, s array<long>").select(F.array("w").alias("k"), "id", "n", "s")
    keys = src.mapInArrow(lambda batches: post(batches, True), "w long").select(F.array("w").alias("k"))
    width = max(shuffle_width(spark), 1)
    found, deep = [], 1
    while True:
        # at most rows / hot keys; the lists of their sets are not moved before they are split
        large = small(keys.groupBy("k").agg(F.count("*").alias("_m")).filter(F.col("_m") > hot))
        any_large = large.limit(1).count() > 0
        plain = posted.join(large, "k", "left_anti") if any_large else posted
        found.append(plain.repartition(width, "k").sortWithinPartitions("k", "n", "id").select("k", "id", "s", F.lit(None).cast("long").alias("x")).mapInArrow(_groups(threshold), "a long, b long"))
        if not any_large:
            break
        over = posted.join(large, "k")
        ends = F.element_at("k", -1) == F.element_at("k", -2) if deep > 1 else F.lit(False)  # exactly these values in common
        blocked = over.filter(ends) if deep < DEPTH else over
        if deep > 1:
            found.append(_blocks(blocked, hot, width).mapInArrow(_groups(threshold), "a long, b long"))
        if deep == DEPTH:
            break
        keys = posted = keep(over.filter(~ends).select("k", "id", "n", "s").mapInArrow(_deeper(threshold), "k array<long>, id long, n int, s array<long>"))
        deep += 1
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    return both.select(F.least("a", "b").alias("rec_a"), F.greatest("a", "b").alias("rec_b"))


def _deeper(threshold: float):
    """Posts the sets of a hot key under that key and each value that can be the next in common, and, where the key can suffice, under it alone (its last value twice)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = [[], [], [], []]
            for k, i, n, s in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("k", "id", "n", "s"))):
                at = s.index(k[-1])
                need = ceil(threshold * n - 1e-9)  # the least overlap with any partner
                for v in ([k[-1]] if need <= len(k) else []) + s[at + 1 : max(n - need + len(k) + 1, at + 1)]:
                    for col, x in zip(cols, ([*k, v], i, n, s)):
                        col.append(x)
            kinds = (pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["k", "id", "n", "s"])

    return run


def _blocks(over: DataFrame, hot: int, width: int) -> DataFrame:
    """Every pair of blocks of a key's sets as a group of its own: k, id, s, x (the set's block, null within one block)."""
    n_blocks = (F.col("_m") / hot + 1).cast("long")
    mine = F.pmod(F.xxhash64("id", F.lit(11)), n_blocks)
    to = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n_blocks - 1), lambda o: F.struct(F.least(F.col("_b"), o).alias("lo"), F.greatest(F.col("_b"), o).alias("hi"))))
    x = over.withColumn("_b", mine).select("k", "id", "n", "s", "_b", to.alias("_p"))
    x = x.repartition(width * 4, "k", "_p").sortWithinPartitions("k", "_p", "n", "id")
    # the pair of blocks tells groups of one key apart
    return x.select("k", "id", "s", F.when(F.col("_p.lo") == F.col("_p.hi"), F.lit(None)).otherwise(F.col("_b")).cast("long").alias("x"), F.col("_p.lo").alias("lo"), F.col("_p.hi").alias("hi"))


def _groups(threshold: float):
    """Joins posting groups that come one after the other, sorted by key and size: the pairs whose first common values are the key."""

    def run(batches):
        import pyarrow as pa

        now, ids, group, blocks = None, [], [], []
        a, b_ = [], []

        def flush():
            if len(group) < 2:
                return
            key = now[0]
            alone = len(key) > 1 and key[-1] == key[-2]
            key = tuple(key[:-1]) if alone else tuple(key)
            for i, j in similar_in_group(group, key, threshold, None if blocks[0] is None else blocks):
                common = sorted(set(group[i]).intersection(group[j]))
                # in the group of the first common values only
                if tuple(common) == key if alone else tuple(common[: len(key)]) == key:
                    a.append(ids[i])
                    b_.append(ids[j])

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b_, pa.int64())], names=["a", "b"])

        for b in batches:
            names = b.schema.names
            k_, i_, s_, x_ = (b.column(names.index(c)).to_pylist() for c in ("k", "id", "s", "x"))
            lo, hi = (b.column(names.index(c)).to_pylist() if c in names else [None] * len(k_) for c in ("lo", "hi"))
            for n in range(len(k_)):
                if (k_[n], lo[n], hi[n]) != now:
                    flush()
                    now, ids, group, blocks = (k_[n], lo[n], hi[n]), [], [], []
                ids.append(i_[n])
                group.append(s_[n])
                blocks.append(x_[n])
            if len(a) > 20_000:
                yield batch()
                a.clear()
                b_.clear()
        flush()
        yield batch()

    return run


def base_sections(codes) -> object:
    """The ascending set of base section numbers of a code list: the digits before any subsection.

    Label, sign and spaces are dropped, null and blank entries and entries without digits ignored. Numbers of more
    than 17 digits stand for themselves by a hash.
    """
    digits = F.transform(codes, lambda c: F.regexp_extract(c, r"(\d+)", 1))
    digits = F.filter(digits, lambda d: F.length(d) > 0)
    as_long = F.transform(digits, lambda d: F.coalesce(F.when(F.length(d) <= 17, d.try_cast("bigint")), F.shiftrightunsigned(F.xxhash64(d), 4)))
    return F.array_sort(F.array_distinct(as_long))


def similar_records(df: DataFrame, id_col: str, list_col: str, threshold: float = 0.75, min_size: int = 4) -> tuple[DataFrame, DataFrame]:
    """(links, members): links between class representatives (rec_a < rec_b) and class membership (rec, class_id, class_size).

    A class holds the records with the same set; its id is its smallest record id. Copies of a set are joined once, as
    a class; every link between different sets is kept. Null ids are left out, repeated rows count once.
    """
    recs = df.select(F.col(f"`{id_col}`").alias("rec"), base_sections(F.col(f"`{list_col}`")).alias("s")).filter(F.col("rec").isNotNull() & (F.size("s") >= min_size))
    recs = keep(recs.dropDuplicates(["rec", "s"]))
    classes = keep(recs.groupBy("s").agg(F.min("rec").alias("class_id"), F.count("*").alias("class_size")))
    links = similar_sets(classes, "class_id", "s", threshold, min_size)
    members = recs.join(classes, "s").select("rec", "class_id", "class_size")
    return links, members


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of neg_ids, copies expanded as the case list asks."""
    neg = spark.read.parquet(f"{sf_dir}/neg_records.parquet")
    links, members = similar_records(neg, "neg_id", "shared_codes")
    links = keep(links)
    m = keep(members)
    # a class with copies is linked with itself
    own = m.filter("class_size > 1").select(F.col("class_id").alias("rec_a"), F.col("class_id").alias("rec_b")).distinct()
    x = join_members(links.select("rec_a", "rec_b").unionByName(own), m.select(F.col("rec").alias("x"), F.col("class_id").alias("rec_a")), ["rec_a"], "x")
    got = join_members(x, m.select(F.col("rec").alias("y"), F.col("class_id").alias("rec_b")), ["rec_b"], "y")
    got = got.filter("(rec_a = rec_b AND x < y) OR (rec_a <> rec_b AND x <> y)")
    return got.select(F.least("x", "y").alias("neg_a"), F.greatest("x", "y").alias("neg_b")).distinct()


SQL = {
    "p3_found": """
WITH s AS (SELECT neg_id, list_distinct(list_filter(list_transform(shared_codes, lambda x: regexp_extract(x, '[0-9]+')), lambda x: x <> '')) AS s FROM (SELECT DISTINCT neg_id, shared_codes FROM neg_records WHERE shared_codes IS NOT NULL)),
t AS (SELECT neg_id, len(s) AS n, unnest(s) AS c FROM s WHERE len(s) >= 4),
p AS (SELECT a.neg_id AS neg_a, b.neg_id AS neg_b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.c = b.c AND a.neg_id < b.neg_id WHERE 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY ALL)
SELECT neg_a, neg_b FROM p WHERE 4 * k >= 3 * (na + nb - k)""",
}
