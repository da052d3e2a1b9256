"""Evaluation passages leaking into training texts: a distributed positional inverted index.

The training texts are cut into blocks; a block stores for every term the ascending places at which it stands, as shards of
terms. The index doesn't depend on the evaluation items: it is written once, in one scan of the texts, and any number of items
is searched in one pass over it. In every window of an item the rarest terms by the lengths of their lists are taken; the
lists of any two of them, offset by their distance in the item, are intersected by binary search, the shorter one
probing the longer. A place found is held against the lists of its neighbours, and item and text are aligned within a band over
the lists' entries, which gives exact and proximity matches alike. The texts are never put together again.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import fold_word, stored, words

_JOIN = re.compile(r"[-‐‑¬\xad–][ \t]*(?:\r?\n|\f)\s*")
BAND = 14  # how far text and passage may shift against each other (page furniture, added words)
AGREE = 5  # words within BAND of a place that must stand at the same offset, before an alignment
BLOCK_WORDS = 2_000_000  # of the texts in a block of the index; a longer text is a block of its own
TERM_SHARDS = 16
ITEM_WORDS = 4_000_000  # of the items that go to all tasks at once
PROBES = 1_000_000  # list entries probed at once


def terms(text: str | None) -> list[str]:
    """Folded words; words broken at line ends are joined, apostrophes and other signs dropped."""
    if not text:
        return []
    return [fold_word(w) for w in words(_JOIN.sub("", text) if "\n" in text else text)]


def term_ids(ws: list[str], memo: dict[str, int]) -> np.ndarray:
    """64-bit ids of the folded forms of words; memo is filled, and emptied when it gets large."""
    import xxhash

    out = np.empty(len(ws), np.int64)
    for k, w in enumerate(ws):
        t = memo.get(w)
        if t is None:
            if len(memo) > 500_000:
                memo.clear()
            t = xxhash.xxh3_64_intdigest(fold_word(w).encode("utf-8", "replace"))
            t = memo[w] = t - (1 << 64) if t >> 63 else t
        out[k] = t
    return out


def _pack(a: np.ndarray) -> bytes:
    """Compressed differences; ascending places of frequent terms take about a byte each."""
    return zlib.compress(np.diff(a, prepend=a.dtype.type(0)).tobytes(), 1)


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), kind), dtype=kind)


def positional_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per block of texts: ids, begins (the place of each text's first word; texts lie 2 * BAND places apart) and, by shard of terms, terms (ascending), ends (of their lists) and places.

    One scan, no shuffle. Null texts and ids are left out.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        import pyarrow as pa

        memo: dict[str, int] = {}
        bounds = np.array([(k << 60) - (1 << 63) for k in range(1, 16)], np.int64)[:: 16 // TERM_SHARDS]

        def block(ids, ts):
            lens = np.array([len(t) for t in ts], np.int64)
            begins = np.cumsum(lens + 2 * BAND) - lens
            term = np.concatenate(ts)
            place = (np.arange(len(term)) + np.repeat(begins - (np.cumsum(lens) - lens), lens)).astype(np.int32)
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order]
            ends = np.append(np.flatnonzero(np.diff(term)) + 1, len(term)) if len(term) else np.zeros(0, np.int64)
            unique = term[ends - 1]
            cut = [0, *np.searchsorted(unique, bounds), len(unique)]
            parts = []
            for a, b in zip(cut, cut[1:]):
                first = int(ends[a - 1]) if a else 0
                last = int(ends[b - 1]) if b else 0
                parts.append((_pack(unique[a:b]), _pack((ends[a:b] - first).astype(np.int32)), _pack(place[first:last])))
            row = [pa.array([_pack(np.array(x, np.int64))], pa.binary()) for x in (ids, begins)]
            row += [pa.array([list(x)], pa.list_(pa.binary())) for x in zip(*parts)]
            return pa.RecordBatch.from_arrays(row, names=["ids", "begins", "terms", "ends", "places"])

        ids, ts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                if t is None or i is None:
                    continue
                ids.append(i)
                ts.append(term_ids(words(_JOIN.sub("", t) if "\n" in t else t), memo))
                size += len(ts[-1])
                if size > BLOCK_WORDS:
                    yield block(ids, ts)
                    ids, ts, size = [], [], 0
        if ids:
            yield block(ids, ts)

    return src.mapInArrow(run, "ids binary, begins binary, terms array<binary>, ends array<binary>, places array<binary>")


def align(item: np.ndarray, text: np.ndarray, least: int, changed: float) -> int:
    """The longest passage of the item, in words, that the text holds in order: at least `least` words of which at most
    the share `changed` (rounded up) is missing or other; 0 if there is none. Unknown words of the text are -1.

    A longest common subsequence gives the pairs; words of the text between two pairs may be up to BAND more than those
    of the item.
    """
    where: dict[int, list[int]] = {}
    for p, t in enumerate(text.tolist()):
        if t >= 0:
            where.setdefault(t, []).append(p)
    return align_lists(item, where, least, changed)


def align_lists(item: np.ndarray, where: dict[int, list[int]], least: int, changed: float) -> int:
    """align() over lists of the places of each item word."""
    n = len(item)
    # chains of matching pairs: best score ending in a pair, over pairs close before it
    pairs, score, back = [], [], []
    for i, t in enumerate(item.tolist()):
        for p in where.get(t, ()):
            s, b = 1.0, -1
            for k in range(len(pairs) - 1, -1, -1):
                j, q = pairs[k]
                if i - j > 8:
                    break
                if j < i and q < p and p - q - (i - j) <= BAND and i - j - (p - q) <= 4:
                    v = score[k] + 1 - 0.35 * (i - j - 1) - 0.02 * abs((p - q) - (i - j))
                    if v > s:
                        s, b = v, k
            pairs.append((i, p))
            score.append(s)
            back.append(b)
    best = 0
    seen = set()
    for k in sorted(range(len(pairs)), key=lambda k: -score[k]):
        if k in seen or score[k] < 0.5 * least:
            continue
        chain = []
        while k >= 0 and k not in seen:
            seen.add(k)
            chain.append(pairs[k][0])
            k = back[k]
        chain.reverse()
        # the longest stretch from one match to another with few enough gaps
        for a in range(len(chain)):
            for b in range(len(chain) - 1, a - 1, -1):
                # a changed word may be the first or last of the passage
                length = chain[b] - chain[a] + 1
                if length <= best or length + 2 < least:
                    break
                hits = b - a + 1
                full = max(length, least)
                if full > n:
                    break
                if full - hits <= -(-full * changed // 1):
                    best = full
                    break
    return best


class Block:
    """A block of the index, its lists end to end: key = number of the term, then place."""

    def __init__(self, ids, begins, terms_, ends, places):
        self.ids, self.begins = _unpack(ids, np.int64), _unpack(begins, np.int64)
        e = [_unpack(x, np.int32).astype(np.int64) for x in ends]
        p = [_unpack(x, np.int32) for x in places]
        self.terms = np.concatenate([_unpack(x, np.int64) for x in terms_])
        base = np.cumsum([0, *[len(x) for x in p]])
        self.ends = np.concatenate([x + b for x, b in zip(e, base)])
        self.places = np.concatenate(p).astype(np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1])) if len(self.ends) else self.ends
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64) << 32, self.ends - self.starts) | self.places

    def lists(self, terms_: np.ndarray) -> np.ndarray:
        """The number of each term's list, -1 for a term without."""
        if not len(self.terms):
            return np.full(len(terms_), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms_), len(self.terms) - 1)
        return np.where(self.terms[at] == terms_, at, -1)

    def has(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the list has the place, by binary search; False for list -1."""
        q = (number << 32) | np.maximum(place, 0)
        at = np.minimum(np.searchsorted(self.keys, q), len(self.keys) - 1)
        return (self.keys[at] == q) & (number >= 0)


    def near(self, number: np.ndarray, place: np.ndarray, reach: int) -> np.ndarray:
        """Whether the list has an entry within `reach` of the place; False for list -1."""
        q = (number << 32) | np.maximum(place - reach, 0)
        at = np.minimum(np.searchsorted(self.keys, q), len(self.keys) - 1)
        return (self.keys[at] >= q) & (self.keys[at] <= ((number << 32) | np.maximum(place + reach, 0))) & (number >= 0)

    def between(self, numbers: np.ndarray, lo: int, hi: int) -> dict[int, list[int]]:
        """The lists' entries in [lo, hi), less lo."""
        t = np.unique(numbers[numbers >= 0])
        a, b = np.searchsorted(self.keys, (t << 32) | lo), np.searchsorted(self.keys, (t << 32) | hi)
        return {int(t[k]): (self.places[a[k] : b[k]] - lo).tolist() for k in np.flatnonzero(b > a)}


def rarest(counts: np.ndarray, part: np.ndarray, least: int, anchors: int, missing: int) -> np.ndarray:
    """Which words of the parts are anchors: the `anchors` with the shortest lists of every window of `least` words that lacks at most `missing`."""
    chosen = np.zeros(len(counts), bool)
    n = len(counts) - least + 1
    step = 100_000
    for a in range(0, max(n, 0), step):
        c = np.lib.stride_tricks.sliding_window_view(counts[a : min(a + step, n) + least - 1], least)
        ok = np.flatnonzero((part[a : a + len(c)] == part[a + least - 1 : a + len(c) + least - 1]) & ((c == 0).sum(1) <= missing))
        if len(ok):
            chosen[(a + ok)[:, None] + np.argpartition(c[ok], anchors - 1, axis=1)[:, :anchors]] = True
    return chosen


def seeds(block: Block, number: np.ndarray, part: np.ndarray, least: int, anchors: int, missing: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of the items, place in the block) where two rare terms of a window stand at the right distance and AGREE words around them do, too."""
    counts = np.where(number >= 0, (block.ends - block.starts)[number], 0) if len(block.terms) else np.zeros(len(number), np.int64)
    chosen = rarest(counts, part, least, anchors, missing) & (counts > 0)
    at_w, at_p = [], []
    for d in range(1, least):
        i = np.flatnonzero(chosen[:-d] & chosen[d:] & (part[:-d] == part[d:]))
        if not len(i):
            continue
        # the shorter list probes the longer
        swap = counts[i] > counts[i + d]
        probe, other, shift = np.where(swap, i + d, i), np.where(swap, i, i + d), np.where(swap, -d, d)
        size = counts[probe]
        cum = np.cumsum(size)
        a = 0
        while a < len(i):
            b = max(int(np.searchsorted(cum, (cum[a - 1] if a else 0) + PROBES, "right")), a + 1)
            n = size[a:b]
            which = np.repeat(np.arange(a, b), n)
            entry = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + block.starts[number[probe[which]]]
            place = block.places[entry]
            hit = block.has(number[other[which]], place + shift[which])
            at_w.append(probe[which[hit]])
            at_p.append(place[hit])
            a = b
    if not at_w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w, p = np.concatenate(at_w), np.concatenate(at_p)
    both = np.unique(np.stack((w, p)), axis=1)
    w, p = both[0], both[1]
    # of the words around it, some at the same offset, then all but the changed ones of a passage within the band
    for reach, least_many in ((0, AGREE + 1), (BAND, least - missing)):
        agree = np.ones(len(w), np.int64)
        for k in [*range(1 - least, 0), *range(1, least)]:
            v = np.clip(w + k, 0, len(part) - 1)
            same = (part[v] == part[w]) & (v == w + k)
            agree += same & (block.near(number[v], p + k, reach) if reach else block.has(number[v], p + k))
        ok = agree >= least_many
        w, p = w[ok], p[ok]
    return w, p


def search_block(block: Block, term: np.ndarray, starts: np.ndarray, least: int, changed: float, anchors: int) -> list[tuple[int, int, int]]:
    """(part, text's id, words of the longest passage) of all parts that stand in a text of the block; starts: where each part's words begin."""
    if not len(block.keys) or not len(term):
        return []
    part = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    number = block.lists(term)
    w, p = seeds(block, number, part, least, anchors, missing=anchors - 2)
    doc = np.searchsorted(block.begins, p, "right") - 1
    out = []
    order = np.lexsort((p - w, doc, part[w]))
    w, p, doc = w[order], p[order], doc[order]
    edges = np.flatnonzero(np.diff(part[w]) | np.diff(doc)) + 1 if len(w) else np.zeros(0, np.int64)
    for a, b in zip([0, *edges], [*edges, len(w)]):
        if a == b:
            continue
        k = int(part[w[a]])
        mine = number[starts[k] : starts[k + 1]]
        begin_of_text = int(block.begins[doc[a]])
        # where the part would begin by each seed; near ones are one place, aligned in a window of bounded length
        best, first, last = 0, None, None
        for begin in [*np.unique(p[a:b] - (w[a:b] - starts[k])).tolist(), None]:
            if first is not None and (begin is None or begin - last > 2 * BAND or begin - first > 6 * BAND):
                lo, hi = max(begin_of_text, first - BAND), last + len(mine) + 3 * BAND
                if doc[a] + 1 < len(block.begins):
                    hi = min(hi, int(block.begins[doc[a] + 1]) - BAND)
                best = max(best, align_lists(mine, block.between(mine, lo, hi), least, changed))
                first = None
                if best == len(mine):
                    break
            first = begin if first is None else first
            last = begin
        if best:
            out.append((k, int(block.ids[doc[a]]), best))
    return out


def item_terms(held: DataFrame, least: int) -> DataFrame:
    """item, part, n, terms (ids as bytes) of the parts of at least `least` words. held: item, part, text."""

    def run(batches):
        import pyarrow as pa

        memo: dict[str, int] = {}
        for b in batches:
            rows = [(i, k, terms(t)) for i, k, t in zip(*(b.column(c).to_pylist() for c in range(3)))]
            rows = [(i, k, len(ws), term_ids(ws, memo).tobytes()) for i, k, ws in rows if len(ws) >= least]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["item", "part", "n", "terms"])

    return held.filter("item IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "item long, part int, n long, terms binary")


def search_index(index: DataFrame, items: list, least: int, changed: float, anchors: int) -> DataFrame:
    """item_id, doc, words of all passages of the items (rows of item_terms) in the index, in one pass over it."""
    starts = np.cumsum([0, *[r["n"] for r in items]])
    shared = index.sparkSession.sparkContext.broadcast(([r["item"] for r in items], b"".join(r["terms"] for r in items), starts))

    def run(batches):
        import pyarrow as pa

        names, raw, starts = shared.value
        term = np.frombuffer(raw, np.int64)
        for b in batches:
            cols = [b.column(b.schema.names.index(c)) for c in ("ids", "begins", "terms", "ends", "places")]
            for k in range(b.num_rows):
                got = search_block(Block(*[c[k].as_py() for c in cols]), term, starts, least, changed, anchors)
                out = [[names[x] for x, _, _ in got], [d for _, d, _ in got], [n for _, _, n in got]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32()))], names=["item_id", "doc", "words"])

    return index.mapInArrow(run, "item_id long, doc long, words int")


def leaks(docs: DataFrame, doc_id: str, text_col: str, held: DataFrame, item_col: str, part_cols: list, least: int = 15, changed: float = 0.125, anchors: int = 5) -> DataFrame:
    """item_id, doc, words (of the longest passage): every leaking pair once.

    part_cols: columns or expressions of the parts of an item; a passage lies within one part. Null or short parts leak
    nothing; repeated ids of an item or document count as one. The texts are scanned once. Items of up to ITEM_WORDS words
    together go to all tasks at once, so that what is held is bounded; more take a further pass each over the stored index.
    """
    held = held.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.posexplode(F.array(*[(F.col(f"`{c}`") if isinstance(c, str) else c).cast("string") for c in part_cols])).alias("part", "text"))
    asked = item_terms(held, least)
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    passes = max(-(-total // ITEM_WORDS), 1)
    index = stored(positional_index(docs, doc_id, text_col))
    found = None
    for k in range(passes):
        mine = asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == k) if passes > 1 else asked
        got = search_index(index, mine.collect(), least, changed, anchors)
        found = got if found is None else found.unionByName(got)
    return found.groupBy("item_id", "doc").agg(F.max("words").alias("words"))


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = spark.read.parquet(f"{sf_dir}/pairs.parquet").filter("lower(trim(split_name)) = 'train'")
    held = spark.read.parquet(f"{sf_dir}/heldout_pairs.parquet")
    cut = F.when(F.instr("pos_qa_text", "CONCLUSION:") > 0, F.expr("substring(pos_qa_text, instr(pos_qa_text, 'CONCLUSION:') + 11)")).otherwise(F.col("pos_qa_text"))
    return leaks(train, "pair_id", "pos_full_text", held, "item_id", ["question", cut])


def p4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking pairs with the words of their longest common passage."""
    return _run(spark, sf_dir).withColumnRenamed("doc", "pair_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_leaks(spark, sf_dir).select("item_id", "pair_id")
