"""The same or nearly the same records across splits, by Aho-Corasick automata over evaluation passages.

An evaluation question is cut into more passages than words of it may be changed, so that some stand unaltered in any
near copy. The cuts are placed such that every passage has a run of PASSAGE words as rare as can be; the commonest passage
needn't be sought. Every passage goes to one shard only, that of its rarest run, and a training question to the shards of its
own runs that are such anchors; so neither side is copied as the data grow. A run that very many texts or passages share is a shard of its own, split further on both sides. In a shard an
automaton over the passages scans the texts. Where one stands, the matched places of the whole evaluation question are
merged into its coverage; what is covered enough is compared word by word.
Opinion numbers are whole keys and are joined by equality.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import fold_word, join_members, keep, shuffle_width, small, stored, words
from lodestar.llm.scan import page_breaks

SHARD_PASSAGES = 100_000  # passages of one automaton
GROUP_TEXTS = 20_000  # training texts that one task scans with one automaton
PASSAGE = 4  # words of a run that anchors a passage, hence of the shortest passage
LEAST_COVERAGE = 0.6  # of the evaluation question's words, for a comparison
_JOIN = re.compile(r"[-‐‑¬\xad–][ \t]*(?:\r?\n|\f)\s*")
# --- fixed values: labels in front of a question --------------------------------------
_LABEL = re.compile(r"^\W*(?:(?:(?:issue|question|questions|short question|query|q)(?:\s+(?:presented|no\.?\s*\d+|\d+|one))?|re|\(?\d{1,2}\)?)\s*[:.)—–-]+\s*)+", re.I)
# ---------------------------------------------------------------------------------------


def question_words(text: str | None) -> list[str]:
    """The folded words of a question without its label, page furniture and breaks within words."""
    if not text:
        return []
    if "\n" in text or "\f" in text or "\r" in text:
        text = page_breaks(text)[0]
        text = _JOIN.sub("", text)
    return [fold_word(w) for w in words(_LABEL.sub("", text, count=1))]


def opinion_key(col):
    """A key equal for spellings of one opinion number, null if there is none.

    Case, spaces and punctuation are dropped and letters misread for digits (o, l, i, s, b) read as such; s and b only
    after the first place, where a number may have a prefix letter. Another year, serial or letter is another key: A-82-103, 82A103
    and 82-103 are three opinions.
    """
    flat = F.upper(F.regexp_replace(col, r"[^\p{L}\p{N}|]", ""))
    key = F.concat(F.translate(F.substring(flat, 1, 1), "OLI|", "0111"), F.translate(F.substring(flat, 2, 1000), "OLI|SB", "011158"))
    return F.when(F.length(flat) > 0, key)


def _regrouped(a: list[str], b: list[str], i: int, j: int) -> tuple[int, int] | None:
    """Where the words from a[i] and from b[j] have spelt the same letters first, if they do."""
    x, y = a[i], b[j]
    i, j = i + 1, j + 1
    while len(x) != len(y):
        if len(x) < len(y):
            if not y.startswith(x) or i == len(a):
                return None
            x += a[i]
            i += 1
        else:
            if not x.startswith(y) or j == len(b):
                return None
            y += b[j]
            j += 1
    return (i, j) if x == y else None


def within(a: list[str], b: list[str], most: int) -> bool:
    """Whether at most `most` words are changed, left out or added between the lists.

    Transposed neighbours count once, words broken or run together not at all. Exact at any length: all places that can be
    reached with each number of changes, equal words being passed at once.
    """
    n, m = len(a), len(b)
    seen: set[tuple[int, int]] = set()
    level = [(0, 0)]
    for cost in range(most + 1):
        following = []
        while level:
            i, j = level.pop()
            while i < n and j < m and a[i] == b[j]:
                i, j = i + 1, j + 1
            if i == n and j == m:
                return True
            if (i, j) in seen or max(n - i, m - j) == 0:
                continue
            seen.add((i, j))
            if i < n and j < m:
                to = _regrouped(a, b, i, j)
                if to:
                    level.append(to)
                following.append((i + 1, j + 1))
                if i + 1 < n and j + 1 < m and a[i] == b[j + 1] and a[i + 1] == b[j]:
                    following.append((i + 2, j + 2))
            if i < n:
                following.append((i + 1, j))
            if j < m:
                following.append((i, j + 1))
        level = following
    return False


def coverage(a: list[str], b: list[str]) -> float:
    """The share of the words of a in places that b matches: runs of two words or more, merged."""
    pairs = set(zip(b, b[1:]))
    covered, upto = 0, 0
    for i, pair in enumerate(zip(a, a[1:])):
        if pair in pairs:
            covered += i + 2 - max(i, upto)
            upto = i + 2
    return covered / len(a)


def alike(a: list[str], b: list[str], share: float) -> bool:
    """Almost the same: at most `share` of the words changed, however they are spaced."""
    return within(a, b, n_changed(max(len(a), len(b)), share))


def distinct_questions(df: DataFrame, id_col: str, text_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(texts, members): key and words of each distinct question of at least `least` words; id and key of its rows."""
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, keys = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = question_words(t)
                if len(ws) >= least:
                    ids.append(i)
                    keys.append(" ".join(ws))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], names=["id", "q"])

    members = keep(src.mapInArrow(run, "id long, q string"))
    return members.select("q").distinct(), members


def n_changed(n: int, share: float) -> int:
    return max(1, int(n * share))


def cut_passages(counts: list[int], words_: int, k: int, size: int) -> list[tuple[int, int, int]]:
    """(begin, end, place of the rarest run) of at least k passages, cut such that the commonest of their rarest runs is as rare as can be.

    counts: how many texts have the run of `size` words from each word on. Fewer than k only where the words don't suffice.
    """

    def cut(most):
        out, begin, i = [], 0, 0
        while i < len(counts):
            if counts[i] <= most:
                out.append((begin, i + size))
                begin = i = i + size
            else:
                i += 1
        if out:
            out[-1] = (out[-1][0], words_)
        return out

    levels = sorted(set(counts))
    lo, hi = 0, len(levels) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if len(cut(levels[mid])) >= k:
            hi = mid
        else:
            lo = mid + 1
    return [(b, e, min(range(b, max(min(e - size, len(counts) - 1), b) + 1), key=counts.__getitem__)) for b, e in cut(levels[lo])]


def sought_passages(q: str, counts: list[int], share: float, spare: int, size: int) -> list[tuple[str, int]]:
    """(passage, place of its anchor) of those passages of which one stands in any near copy.

    Changed words alter a passage each, and a scanner `spare` more; so the rarest of that many and one more are sought. A passage
    whose anchor no text has can't match.
    """
    ws = q.split(" ")
    altered = n_changed(len(ws), share) + spare
    cut = sorted(cut_passages(counts, len(ws), min(altered + 1, max(len(ws) // size, 1)), size), key=lambda x: counts[x[2]])
    return [(" ".join(ws[b:e]), at) for b, e, at in cut[: altered + 1] if counts[at]]


def grams(text, n: int):
    """Hashes of the runs of n words of a text of words, in order."""
    ws = F.split(text, " ")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(ws, i, n))))


def anchored_passages(eval_q: DataFrame, hits: DataFrame, share: float, spare: int, size: int) -> DataFrame:
    """q, p, g, n: the passages of each evaluation question that are sought, their rarest run of words and how many texts have it."""
    n = hits.groupBy("g").agg(F.count("*").alias("n"))
    runs = eval_q.select("q", F.posexplode(grams("q", size)).alias("i", "g")).join(n, "g", "left")
    runs = runs.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("runs"))

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for q, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(q, p, runs[at]["g"], runs[at]["n"]) for p, at in sought_passages(q, [r["n"] for r in runs], share, spare, size)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["q", "p", "g", "n"])

    return runs.mapInArrow(cut, "q string, p string, g long, n long")


def question_links(eval_q: DataFrame, train_q: DataFrame, share: float, spare: int, least: int) -> DataFrame:
    """e, t, coverage of the evaluation and training texts (q, distinct) that are the same or almost; e and t as md5."""
    spark = eval_q.sparkSession
    size = max(1, min(PASSAGE, least // (n_changed(least, share) + 1)))
    asked = small(eval_q.select(F.explode(grams("q", size)).alias("g")).distinct())
    # stored, not kept: a plan holds the whole plan of all that is kept in it, at every place anew, and the driver all plans of a query
    hits = stored(train_q.select(F.xxhash64("q").alias("th"), F.explode(F.array_distinct(grams("q", size))).alias("g")).join(asked, "g", "left_semi"))
    sought = stored(anchored_passages(eval_q, hits, share, spare, size))
    anchors = keep(sought.groupBy("g").agg(F.max("n").alias("n"), F.count("*").alias("m")))
    total = anchors.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    shards = max(total["n"] // GROUP_TEXTS, total["m"] // SHARD_PASSAGES, min(shuffle_width(spark), total["n"] // 500)) + 1
    # a run above either bound is a shard of its own, in blocks of texts times blocks of passages
    own = (F.col("n") > GROUP_TEXTS) | (F.col("m") > SHARD_PASSAGES)
    place = anchors.select(
        "g", F.when(own, F.col("g")).otherwise(F.pmod(F.xxhash64("g", F.lit(3)), F.lit(shards))).alias("shard"),
        F.when(own, F.col("n") / GROUP_TEXTS + 1).otherwise(1).cast("int").alias("n_texts"), F.when(own, F.col("m") / SHARD_PASSAGES + 1).otherwise(1).cast("int").alias("n_passages"),
    )
    place = small(place)
    salt = lambda h, n: F.pmod(h, F.col(n).cast("long")).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    routes = hits.join(place, "g").select("th", "shard", salt(F.xxhash64("th", F.lit(7)), "n_texts").alias("st"), all_of("n_passages").alias("sp"))
    sent = routes.groupBy("th").agg(F.collect_set(F.struct("shard", "st", "sp")).alias("to")).join(train_q.select(F.xxhash64("q").alias("th"), "q"), "th").select("q", F.explode("to").alias("x")).select("q", "x.*")
    machines = sought.join(place, "g").select("q", "p", "shard", salt(F.xxhash64("q", "p"), "n_passages").alias("sp"), all_of("n_texts").alias("st"))
    machines = machines.groupBy("shard", "st", "sp", "q").agg(F.collect_set("p").alias("ps"))

    def scan(left, right):
        import ahocorasick
        import pandas as pd

        machine, owners = ahocorasick.Automaton(), {}
        for q, ps in zip(left["q"], left["ps"]):
            for p in ps:
                owners.setdefault(p, []).append(q)
        for p, qs in owners.items():
            machine.add_word(f" {p} ", qs)
        found: list[tuple[str, str, float]] = []
        if len(machine):
            machine.make_automaton()
            split: dict[str, list[str]] = {}
            for t in right["q"]:
                ts = None
                for q in {q for _, qs in machine.iter(f" {t} ") for q in qs}:
                    if q == t:
                        found.append((q, t, 1.0))
                        continue
                    qs = split.get(q)
                    if qs is None:
                        qs = split[q] = q.split(" ")
                    ts = ts or t.split(" ")
                    covered = coverage(qs, ts)
                    if covered >= LEAST_COVERAGE and alike(qs, ts, share):
                        found.append((q, t, covered))
        return pd.DataFrame(found, columns=["e", "t", "coverage"]).astype({"e": "str", "t": "str", "coverage": "float64"})

    got = machines.groupBy("shard", "st", "sp").cogroup(sent.groupBy("shard", "st", "sp")).applyInPandas(scan, "e string, t string, coverage double")
    # a pair may meet in several shards
    return got.select(F.md5("e").alias("e"), F.md5("t").alias("t"), "coverage").groupBy("e", "t").agg(F.max("coverage").alias("coverage"))


def opinion_members(pairs: DataFrame, negatives: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(id, key of the evaluation rows; id, key, reason of the training records whose opinion an evaluation row has)."""
    number = lambda df, c: df.select(F.col(c).cast("long").alias("id"), opinion_key(F.col("opinion_id")).alias("c")).filter("id IS NOT NULL AND c IS NOT NULL").distinct()
    ev = number(pairs.filter(F.col("split").isin("val", "test")), "pair_id")
    seen = small(ev.select("c").distinct())
    mine = lambda df, c, why: number(df, c).join(seen, "c", "left_semi").withColumn("reason", F.lit(why))
    tr = mine(pairs.filter(F.col("split") == "train"), "pair_id", "opinion")
    return ev, tr if negatives is None else tr.unionByName(mine(negatives, "neg_id", "negative"))


def split_overlaps(pairs: DataFrame, negatives: DataFrame | None, share: float = 0.125, least: int = 8, spare: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, eval_members, train_members) of all overlaps; nothing is expanded (see expanded()).

    links: e, t, reason (opinion, question or negative), coverage (share of the evaluation question's words that the
    training one matches; 1 for opinions). eval_members: id, e; train_members: id, t, reason: the rows of each class of equal texts or
    numbers, a class being the md5 of a question's words or an opinion's key.
    pairs: pair_id, opinion_id, question, split_name; rows of val and test are evaluation rows, those of train training
    rows, others (null splits too) neither. negatives: neg_id, opinion_id. Null, empty or blank opinion numbers and
    questions under `least` words identify nothing; repeated rows count once. Empty tables give no rows.
    """
    if not 0 < share <= 0.25:
        raise ValueError("share must be above 0 and at most 1/4")
    p = pairs.select("pair_id", "opinion_id", "question", F.lower(F.trim("split_name")).alias("split"))
    e_n, t_n = opinion_members(p, negatives)
    t_n = keep(t_n)
    e_q, e_rows = distinct_questions(p.filter(F.col("split").isin("val", "test")), "pair_id", "question", least)
    t_q, t_rows = distinct_questions(p.filter(F.col("split") == "train"), "pair_id", "question", least)
    asked = question_links(keep(e_q), keep(t_q), share, spare, least).select("e", "t", F.lit("question").alias("reason"), "coverage")
    links = stored(asked.unionByName(t_n.select("c", "reason").distinct().select(F.col("c").alias("e"), F.col("c").alias("t"), "reason", F.lit(1.0).alias("coverage"))))
    eval_members = e_n.select("id", F.col("c").alias("e")).unionByName(e_rows.select("id", F.md5("q").alias("e")).distinct())
    train_members = t_n.select("id", F.col("c").alias("t"), "reason").unionByName(t_rows.select("id", F.md5("q").alias("t"), F.lit("question").alias("reason")).distinct())
    return links, eval_members, train_members


def expanded(links: DataFrame, eval_members: DataFrame, train_members: DataFrame) -> DataFrame:
    """eval_id, train_id, reason, coverage of every pair of rows; one with two reasons has two rows. Large classes are spread by salts."""
    x = join_members(links, eval_members.withColumnRenamed("id", "eval_id"), ["e"], "eval_id")
    return join_members(x, train_members.withColumnRenamed("id", "train_id"), ["t", "reason"], "train_id").select("eval_id", "train_id", "reason", "coverage")


def coverage_report(links: DataFrame, eval_members: DataFrame, train_members: DataFrame) -> DataFrame:
    """eval_id, coverage (the best of its questions' links, 0 without one), opinions, questions, negatives: the training records each evaluation row overlaps.

    Counted by class sizes; no pair of rows is made.
    """
    sizes = train_members.groupBy("t", "reason").agg(F.count("*").alias("n"))
    per = links.join(sizes, ["t", "reason"]).groupBy("e").agg(
        F.max(F.when(F.col("reason") == "question", F.col("coverage"))).alias("coverage"), *[F.sum(F.when(F.col("reason") == r, F.col("n")).otherwise(0)).alias(f"{r}s") for r in ("opinion", "question", "negative")]
    )
    rows = join_members(per, eval_members.withColumnRenamed("id", "eval_id"), ["e"], "eval_id")
    return rows.groupBy("eval_id").agg(F.coalesce(F.max("coverage"), F.lit(0.0)).alias("coverage"), *[F.sum(f"{r}s").alias(f"{r}s") for r in ("opinion", "question", "negative")])


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return split_overlaps(spark.read.parquet(f"{sf_dir}/pairs.parquet"), spark.read.parquet(f"{sf_dir}/neg_records.parquet"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded(*_run(spark, sf_dir)).select(F.least("eval_id", "train_id").alias("rec_a"), F.greatest("eval_id", "train_id").alias("rec_b")).distinct()


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlapping evaluation row with its split, source, coverage and counterparts by reason."""
    rows = spark.read.parquet(f"{sf_dir}/pairs.parquet").select(F.col("pair_id").alias("eval_id"), F.col("split_name").alias("split"), F.coalesce(F.col("question_source"), F.lit("")).alias("source"))
    return coverage_report(*_run(spark, sf_dir)).join(rows, "eval_id").withColumn("coverage", F.round("coverage", 6))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per split, source and reason: evaluation rows with any, pairs of rows, mean coverage of the questions."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(f"{r}s").alias("n")) for r in ("opinion", "question", "negative")])).alias("x")
    x = p2_coverage(spark, sf_dir).select("split", "source", "coverage", each).filter("x.n > 0")
    return x.groupBy("split", "source", "x.reason").agg(F.count("*").alias("eval_rows"), F.sum("x.n").alias("pairs"), F.round(F.avg("coverage"), 6).alias("coverage"))


def p2_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that share an opinion number, with the reason: a training row or a negative."""
    pairs = spark.read.parquet(f"{sf_dir}/pairs.parquet").select("pair_id", "opinion_id", F.lower(F.trim("split_name")).alias("split"))
    ev, tr = opinion_members(pairs, spark.read.parquet(f"{sf_dir}/neg_records.parquet"))
    got = join_members(ev.withColumnRenamed("id", "eval_id"), tr, ["c"], "id")
    return got.select(F.least("eval_id", "id").alias("rec_a"), F.greatest("eval_id", "id").alias("rec_b"), "reason").distinct()


_KEY = "translate(substr(f, 1, 1), 'OLI|', '0111') || translate(substr(f, 2), 'OLI|SB', '011158')"
_FLAT = r"upper(regexp_replace(opinion_id, '[^\p{L}\p{N}|]', '', 'g'))"
SQL = {
    "p2_opinions": f"""
WITH p AS (SELECT id, split, {_KEY} AS c FROM (SELECT pair_id AS id, lower(trim(split_name)) AS split, {_FLAT} AS f FROM pairs) WHERE f <> ''),
n AS (SELECT DISTINCT id, {_KEY} AS c FROM (SELECT neg_id AS id, {_FLAT} AS f FROM neg_records) WHERE f <> '')
SELECT DISTINCT least(e.id, t.id) AS rec_a, greatest(e.id, t.id) AS rec_b, 'opinion' AS reason FROM p e JOIN p t USING (c) WHERE e.split IN ('val', 'test') AND t.split = 'train'
UNION ALL SELECT DISTINCT least(e.id, n.id), greatest(e.id, n.id), 'negative' FROM p e JOIN n USING (c) WHERE e.split IN ('val', 'test')""",
}
