"""Filling fixed-capacity containers: large-item matching, then best fit, planned on the histogram of sizes.

Items of one size are interchangeable, so the whole plan is made on at most `capacity` (size, count) entries, however
many items there are; each planned place then takes a run of ranks within its size. Only the histogram and the plan,
both bounded by the capacity, pass the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import keep, token_counts

#: Rows per (size, bucket) group that are ranked together.
BUCKET_ROWS = 50_000


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((size, how many), ...), containers alike), ...] holding every counted item; sizes in 1..capacity.

    Items above a third of the capacity: the largest with the largest that still fits beside it, two to a container
    at most. The smaller ones, in falling order, each go to the tightest gap that takes them, else to a new container.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    if any(not 1 <= s <= capacity for s in left):
        raise ValueError("sizes must be between 1 and the capacity")
    large = sorted(s for s in left if 3 * s > capacity)
    gaps: dict[int, list] = {}
    keys: list[int] = []

    def put(pattern, n, gap):
        if n <= 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(keys, gap)
        gaps[gap].append((pattern, n))

    while large:
        s = large[-1]
        while left[s]:
            # the largest size still there that fits beside s
            k = bisect_left(large, capacity - s + 1) - 1
            t = large[k] if k >= 0 else None
            if t == s and left[s] < 2:
                t = large[k - 1] if k > 0 else None
            if t is None:
                put(((s, 1),), left[s], capacity - s)
                left[s] = 0
            elif t == s:
                n = left[s] // 2
                put(((s, 2),), n, capacity - 2 * s)
                left[s] -= 2 * n
            else:
                n = min(left[s], left[t])
                put(((s, 1), (t, 1)), n, capacity - s - t)
                left[s] -= n
                left[t] -= n
                if not left[t]:
                    large.remove(t)
        large.remove(s)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        c = left[s]
        while c:
            k = bisect_left(keys, s)
            if k == len(keys):
                fit = capacity // s
                n = c // fit
                put(((s, fit),), n, capacity - fit * s)
                if c % fit:
                    put(((s, c % fit),), 1, capacity - c % fit * s)
                break
            gap = keys[k]
            pattern, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], keys[k]
            fit = gap // s
            full = min(n, c // fit)
            put((*pattern, (s, fit)), full, gap - fit * s)
            c -= full * fit
            rest = n - full
            if rest and 0 < c < fit:
                put((*pattern, (s, c)), 1, gap - c * s)
                c, rest = 0, rest - 1
            put(pattern, rest, gap)
    return [x for gap in sorted(gaps) for x in gaps[gap]]


def _places(plan) -> np.ndarray:
    """Rows (size, first rank, how many a container, first container, first slot), by size and first rank."""
    rows, at, base = [], {}, 0
    for pattern, n in plan:
        slot = 0
        for s, k in pattern:
            rows.append((s, at.get(s, 0), k, base, slot))
            at[s] = at.get(s, 0) + k * n
            slot += k
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """Container places: id, piece, first, last (units of the item the piece covers), size, container, slot.

    An item is cut, into pieces of the capacity and a rest, only if it is larger than the capacity. Items of size 0 or
    null have no place and come out with a null container. Repeated rows are packed each for itself; equal ids are told
    apart by their place only. Containers are numbered from 0; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n = F.coalesce(F.col(f"`{size_col}`"), F.lit(0)).cast("long")
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / F.lit(capacity)) - 1, F.lit(0).cast("long"))))
    items = sizes.select(F.col(f"`{id_col}`").alias("id"), n.alias("n"), pieces.alias("piece")).withColumn("size", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity).cast("long")))
    items = keep(items)
    counts = {r["size"]: r["count"] for r in items.filter("size > 0").groupBy("size").count().collect()}
    places = _places(plan_containers(counts, capacity))
    buckets = max(1, max(counts.values(), default=0) // BUCKET_ROWS + 1)
    # ranks within a size: bucket sizes first, so that a size of any frequency is ranked in bounded groups
    keyed = items.withColumn("b", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    per = keyed.groupBy("size", "b").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per.select("size", "b", F.coalesce(before, F.lit(0)).alias("before"))
    in_bucket = F.row_number().over(Window.partitionBy("size", "b").orderBy("id", "piece"))
    ranked = keyed.join(offsets, ["size", "b"]).select("id", "n", "piece", "size", (F.col("before") + in_bucket - 1).alias("rank"))
    span = int(places[:, 1].max()) + 1 if len(places) else 1
    if len(places) and capacity * (span + 1) >= 1 << 62:
        raise ValueError("too many items of one size for one plan")
    sought = places[:, 0] * span + places[:, 1] if len(places) else np.zeros(0, np.int64)

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            size, rank = (b.column(b.schema.names.index(c)).to_numpy() for c in ("size", "rank"))
            has = size > 0
            k = np.searchsorted(sought, size * span + np.minimum(rank, span - 1), side="right") - 1
            # a rank beyond every first rank of its size belongs to the last place of that size
            k = np.where(has, np.maximum(k, 0), 0)
            row = places[k] if len(places) else np.zeros((len(size), 5), np.int64)
            off = rank - row[:, 1]
            per_bin = np.maximum(row[:, 2], 1)
            container, slot = row[:, 3] + off // per_bin, row[:, 4] + off % per_bin
            cols = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            first = cols["piece"].to_numpy() * capacity
            yield pa.RecordBatch.from_arrays(
                [cols["id"], cols["piece"], pa.array(first), pa.array(first + size), cols["size"], pa.array(container, mask=~has), pa.array(slot, mask=~has)],
                names=[id_col, "piece", "first", "last", "size", "container", "slot"],
            )

    kind = dict(sizes.dtypes)[id_col]
    return ranked.mapInArrow(assign, f"`{id_col}` {kind}, piece long, first long, last long, size long, container long, slot long")


def pack_texts(docs: DataFrame, id_col: str, text_col: str, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """pack() of texts measured in tokens of a public tokenizer (a .tiktoken rank file); first and last count tokens."""
    return pack(token_counts(docs, id_col, text_col, tokenizer=tokenizer), id_col, "n_tokens", capacity)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's place in containers of 2,048 tokens."""
    return pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: containers, tokens, the least number that could hold them, share of space used."""
    placed = p7_containers(spark, sf_dir).filter("container IS NOT NULL")
    total = placed.agg(F.countDistinct("container").alias("containers"), F.sum("size").alias("tokens"))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / 2048).alias("least"), F.round(F.col("tokens") / F.greatest(F.col("containers") * 2048, F.lit(1)), 6).alias("used"))


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers, as one row: how many are over capacity, have gaps in their slots, how many texts are cut though they fit, or are not whole, and how many texts have a place."""
    placed = keep(p7_containers(spark, sf_dir).filter("container IS NOT NULL").select("doc_id", "piece", "first", "last", "size", "container", "slot"))
    boxes = placed.groupBy("container").agg(F.sum("size").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"), F.count("*").alias("rows"))
    over = boxes.agg(F.count_if(F.col("n") > 2048).alias("over_capacity"), F.count_if((F.col("rows") != F.col("slots")) | (F.col("last") + 1 != F.col("slots"))).alias("gaps"))
    texts = placed.groupBy("doc_id").agg(F.sum("size").alias("n"), F.max("last").alias("end"), F.count("*").alias("pieces"), F.countDistinct("first").alias("starts"), F.count_if(F.col("last") - F.col("first") != F.col("size")).alias("odd"))
    split = texts.agg(
        F.count_if((F.col("pieces") > 1) & (F.col("n") <= 2048)).alias("split_though_fitting"), F.count_if((F.col("n") != F.col("end")) | (F.col("pieces") != F.col("starts")) | (F.col("odd") > 0)).alias("not_whole"), F.count("*").alias("placed"),
    )
    return over.withColumn("_k", F.lit(1)).join(split.withColumn("_k", F.lit(1)), "_k").drop("_k")


SQL = {"p7_checked": "SELECT 0 AS over_capacity, 0 AS gaps, 0 AS split_though_fitting, 0 AS not_whole, count(DISTINCT doc_id) AS placed FROM documents WHERE length(text) > 0"}
