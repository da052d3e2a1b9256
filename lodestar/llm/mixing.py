"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over the training run (piecewise linear). Its integral, scaled to the source's share,
is the source's cumulative token demand; a document whose tokens begin at the u-th part of that demand is placed where
the integral reaches u. Sorting by range of that position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import keep, token_counts

BUCKET_ROWS = 20_000
#: Schedules of the mixture query, as (time, weight) knots: crawled pages early, opinions and manuals late.
CURRICULUM = {
    "web_crawl": ((0.0, 1.6), (0.5, 1.0), (1.0, 0.4)),
    "agenda_minutes": ((0.0, 1.3), (1.0, 0.7)),
    "formal_opinions": ((0.0, 0.7), (1.0, 1.3)),
    "manuals": ((0.0, 0.6), (0.5, 1.0), (1.0, 1.4)),
}


def allot(tokens: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, float]:
    """Token demand per source. tokens: available per source; targets: (source, share, max_repeats).

    total None: the largest total at which every source that has tokens gets its exact share (shares of sources
    without tokens go to the others in proportion). With a total, sources whose repeats don't suffice give all they
    may, and what they lack goes to the others in proportion to their shares.
    """
    able = {s: tokens.get(s, 0) * max(r, 0) for s, share, r in targets if share > 0 and tokens.get(s, 0) * max(r, 0) > 0}
    share = {s: w for s, w, _ in targets if s in able}
    if not able:
        return {}
    if total is None:
        total = min(able[s] / (share[s] / sum(share.values())) for s in able)
    got, open_, rest = {}, set(able), float(total)
    while open_:
        weight = sum(share[s] for s in open_)
        full = [s for s in open_ if rest * share[s] / weight >= able[s] * (1 - 1e-12)]
        if not full:
            got |= {s: rest * share[s] / weight for s in open_}
            break
        for s in full:
            got[s] = float(able[s])
        rest -= sum(able[s] for s in full)
        open_ -= set(full)
    return {s: v for s, v in got.items() if v > 0}


def schedule_segments(knots) -> list[tuple[float, float, float, float, float, float]]:
    """(t0, t1, w0, w1, f0, f1) of each segment that has weight: the integral, 1 in all, goes from f0 to f1 there.

    The last f1 is infinite, so that every part of the demand has exactly one segment whatever the rounding.
    """
    knots = sorted(knots)
    if knots[0][0] > 0:
        knots = [(0.0, knots[0][1]), *knots]
    if knots[-1][0] < 1:
        knots = [*knots, (1.0, knots[-1][1])]
    if any(w < 0 for _, w in knots) or knots[0][0] < 0 or knots[-1][0] > 1:
        raise ValueError("weights must not be negative and times lie in [0, 1]")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if area <= 0:
        raise ValueError("a schedule needs some weight")
    out, done = [], 0.0
    for a, b in zip(knots, knots[1:]):
        part = (b[0] - a[0]) * (a[1] + b[1]) / 2 / area
        if part > 0:
            out.append((a[0], b[0], a[1] / area, b[1] / area, done))
            done += part
    ends = [*(x[4] for x in out[1:]), float("inf")]
    return [(*x, e) for x, e in zip(out, ends)]


def mix_sources(
    docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, total_tokens: float | None = None, schedules: dict | None = None, seed: int = 20260521, tokenizer: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(placements, report).

    placements: id, source, repeat (from 0), n_tokens, position in [0, 1), ascending in position. Every use of a
    document is one row; a source is used at most max_repeats times, whole passes first, then part of one, in an order
    hashed from id and seed. report: source, target_share, tokens available, tokens used, actual_share, repeats.

    Source names are trimmed and lower-cased. Null sources and sources without target are not mixed in, but reported
    with target 0; a target without documents is reported with actual share 0. Texts without tokens and null ids are
    not used. Repeated rows count each for itself. The targets are held as a small table (one row per source).
    """
    source = F.lower(F.trim(F.col(f"`{source_col}`")))
    base = token_counts(docs.select(F.col(f"`{id_col}`").alias("id"), source.alias("source"), F.col(f"`{text_col}`").alias("_text")), "id", "_text", keep=("source",), tokenizer=tokenizer)
    base = keep(base.filter((F.col("n_tokens") > 0) & F.col("id").isNotNull()))
    spark = docs.sparkSession
    t = targets.select(F.lower(F.trim("source_name")).alias("source"), "target_share", "max_repeats").filter(F.col("source").isNotNull()).limit(100_001).collect()
    if len(t) > 100_000:
        raise ValueError("more than 100,000 target sources")
    wanted = [r["source"] for r in t]
    avail = keep(base.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    have = {r["source"]: (r["tokens"], r["docs"]) for r in avail.filter(F.col("source").isin(wanted)).collect()}
    demand = allot({s: v[0] for s, v in have.items()}, [(r["source"], r["target_share"] or 0.0, r["max_repeats"] or 0) for r in t], total_tokens)
    buckets = max((v[1] for v in have.values()), default=0) // BUCKET_ROWS + 1
    segs = [(s, *seg) for s in demand for seg in schedule_segments((schedules or {}).get(s, ((0.0, 1.0), (1.0, 1.0))))]
    seg = F.broadcast(spark.createDataFrame(segs, "source string, t0 double, t1 double, w0 double, w1 double, f0 double, f1 double"))
    plan = F.broadcast(spark.createDataFrame([(s, demand[s], have[s][0]) for s in demand], "source string, demand double, available long"))
    h = F.xxhash64("id", F.lit(seed))
    keyed = base.join(plan, "source").withColumn("h", h).withColumn("b", F.pmod(F.shiftright("h", 3), F.lit(buckets)))
    per = keyed.groupBy("source", "b").agg(F.sum("n_tokens").alias("m"))
    before = F.sum("m").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per.select("source", "b", F.coalesce(before, F.lit(0)).alias("before"))
    w = Window.partitionBy("source", "b").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.join(offsets, ["source", "b"]).withColumn("begin", F.col("before") + F.sum("n_tokens").over(w) - F.col("n_tokens"))
    # a use counts if more than half of it lies within the demand
    uses = F.floor((F.col("demand") - F.col("begin") - F.col("n_tokens") / 2) / F.col("available")).cast("int")
    used = placed.withColumn("uses", uses).filter("uses >= 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), "uses")))
    u = F.least((F.col("repeat") * F.col("available") + F.col("begin")) / F.col("demand"), F.lit(1.0 - 1e-12))
    used = used.withColumn("u", u).join(seg, "source")
    used = used.filter((F.col("u") >= F.col("f0")) & (F.col("u") < F.col("f1")))
    a = (F.col("w1") - F.col("w0")) / (2 * (F.col("t1") - F.col("t0")))
    c = F.col("u") - F.col("f0")
    root = F.sqrt(F.greatest(F.col("w0") * F.col("w0") + 4 * a * c, F.lit(0.0)))
    x = F.when(c <= 0, F.lit(0.0)).otherwise(2 * c / (F.col("w0") + root))
    position = F.least(F.col("t0") + x, F.col("t1") - 1e-12)
    out = used.select(F.col("id").alias(id_col), "source", "repeat", "n_tokens", position.alias("position"))
    out = out.orderBy("position", "source", id_col, "repeat")
    mine = out.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.max("repeat").alias("last"))
    all_used = F.sum("used_tokens").over(Window.partitionBy())
    tt = spark.createDataFrame([(r["source"], r["target_share"], r["max_repeats"]) for r in t], "source string, target_share double, max_repeats int")
    report = (
        avail.withColumnRenamed("source", "s").join(F.broadcast(tt), F.col("s") == F.col("source"), "full_outer").select(F.coalesce("source", "s").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("tokens", F.lit(0)).alias("available_tokens"))
        .join(mine, "source", "left")
        .select(
            "source", "target_share", "available_tokens", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
            F.coalesce(F.col("used_tokens") / all_used, F.lit(0.0)).alias("actual_share"), F.coalesce(F.col("last") + 1, F.lit(0)).alias("repeats"),
        )
    )
    return out, report


def _mix(spark: SparkSession, sf_dir: str):
    docs, targets = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "mix_targets"))
    return mix_sources(docs, targets, "doc_id", "text", "source", schedules=CURRICULUM)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training order: every use of a document with its position."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mix(spark, sf_dir)[1]


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mixture, as one row: uses beyond a source's cap, of a source without target, twice the same, or outside [0, 1); the sum of the shares; and sources with documents and a target that are not used."""
    used, report = _mix(spark, sf_dir)
    caps = spark.read.parquet(f"{sf_dir}/mix_targets.parquet").select(F.lower(F.trim("source_name")).alias("source"), "max_repeats")  # one row per source
    x = keep(used.join(F.broadcast(caps), "source", "left").select("doc_id", "source", "repeat", "position", "max_repeats"))
    uses = x.agg(F.count_if(F.col("repeat") >= F.col("max_repeats")).alias("over_cap"), F.count_if(F.col("max_repeats").isNull()).alias("untargeted"), F.count_if(~F.coalesce((F.col("position") >= 0) & (F.col("position") < 1), F.lit(False))).alias("outside"))
    twice = x.groupBy("doc_id", "repeat").count().agg(F.count_if(F.col("count") > 1).alias("used_twice"))
    shares = report.agg(F.round(F.sum("actual_share"), 6).alias("share_sum"), F.count_if((F.col("target_share") > 0) & (F.col("available_tokens") > 0) & (F.col("used_tokens") == 0)).alias("unused"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(uses).join(one(twice), "_k").join(one(shares), "_k").drop("_k")


SQL = {"p8_checked": "SELECT 0 AS over_cap, 0 AS untargeted, 0 AS outside, 0 AS used_twice, 1.0::DOUBLE AS share_sum, 0 AS unused"}
