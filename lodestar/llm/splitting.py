"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Boundary kinds from strong to weak; a cut falls at the end of a match.
_KINDS = (
    ("paragraph", re.compile(r"(?:\r?\n|\f)[ \t]*(?:\r?\n|\f)[\s]*|\f\s*")),
    ("line", re.compile(r"\r?\n[ \t]*")),
    ("sentence", re.compile(r"[.!?][\"'”’)\]]*\s+")),
    ("word", re.compile(r"\s+")),
)


def _snap(text: str, target: int, lo: int, hi: int) -> tuple[int, str]:
    """The strongest boundary in (lo, hi], the nearest to target among equals; else target itself."""
    lo, hi = max(lo, 0), min(hi, len(text))
    # a little before lo, so that a match which ends within the span is seen whole
    at = max(0, lo - 8)
    near = text[at : hi + 8]
    for kind, pattern in _KINDS:
        best = None
        for m in pattern.finditer(near):
            p = at + m.end()
            if p > hi:
                p = hi if at + m.start() < hi and kind == "word" else p
                if p > hi:
                    break
            if p > lo and (best is None or abs(p - target) < abs(best - target)):
                best = p
        if best is not None:
            return best, kind
    return min(max(target, lo + 1), hi), "none"


def _balanced(text: str, n: int, limit: int, overlap: int, room: int) -> list[tuple[int, str]] | None:
    """The n - 1 cuts (place, boundary) of n pieces with targets at equal lengths, None if a piece gets too long."""
    size = len(text)
    step = (size - overlap) / n
    reach = max(1, int(step / 3))
    cuts: list[tuple[int, str]] = []
    prev = 0
    for i in range(1, n):
        target = round(i * step + overlap)
        top = min(prev + (limit if i == 1 else room), size - 1)
        if top <= prev:
            return None
        p, kind = _snap(text, min(target, top), max(prev, target - reach), min(target + reach, top))
        cuts.append((p, kind))
        prev = p
    return cuts if size - prev <= room else None


def _one_by_one(text: str, limit: int, room: int) -> list[tuple[int, str]]:
    """Cuts from the front, each in the last half of what still fits; for limits that leave hardly any room beside the overlap."""
    cuts, prev, size = [], 0, len(text)
    while size - prev > room:
        top = min(prev + (room if cuts else limit), size - 1)
        cuts.append(_snap(text, top, prev + (top - prev) // 2, top))
        prev = cuts[-1][0]
    return cuts


def cut_points(text: str, limit: int = 6000, overlap: int = 200) -> list[tuple[int, int, int, str]]:
    """(begin, fresh, end, boundary) of each piece: text[begin:end] is the piece, text[fresh:end] what is new in it.

    The fresh parts join to the text exactly. Every piece has at most `limit` characters and every one but the
    first begins about `overlap` characters back, at a word or sentence start where there is one near.
    The least number of pieces is tried first, with targets at equal lengths; each target snaps to the strongest
    boundary within a third of a piece; where a piece gets too long, one more piece is tried (two in a hundred from 100 pieces on).
    Every text ends in pieces, for any overlap below the limit.
    A text of at most `limit` characters is one piece; an empty one too.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    size = len(text)
    if size <= limit:
        return [(0, 0, size, "end")]
    # how far back of the overlap's place its start may snap; a piece always has room for something new
    slack = min(40, overlap // 4, (limit - overlap - 1) // 2)
    room = limit - overlap - slack
    n = max(2, -(-(size - overlap) // (limit - overlap)))
    cuts = None
    # pieces of at most room / 2 fit wherever their cuts snap, so more need not be tried
    while cuts is None and n <= -(-2 * size // room) + 2:
        cuts = _balanced(text, n, limit, overlap, room)
        n += max(1, n // 50)
    if cuts is None:
        cuts = _one_by_one(text, limit, room)
    out, prev, kind_end = [], 0, "end"
    for i, (end, kind) in enumerate([*cuts, (size, kind_end)]):
        begin = prev
        if i and overlap:
            want = max(0, prev - overlap)
            b, k = _snap(text, want, max(-1, want - slack - 1), min(want + slack, prev - 1)) if prev else (0, "none")
            begin = b if k != "none" else want
            begin = min(max(begin, end - limit, 0), prev)
        out.append((begin, prev, end, kind))
        prev = end
    return out


def split_long_texts(df: DataFrame, id_col: str, fields: list[str], limit: int = 6000, overlap: int = 200, only_long: bool = False) -> DataFrame:
    """Ordered pieces of each text field: id, field, piece (from 0), n_pieces, begin, fresh, end, boundary, text.

    Null texts give no row, empty texts one empty piece, texts within the limit one piece (none if `only_long`);
    repeated rows give repeated pieces. Lengths are in code points. One narrow pass, no shuffle: short texts never
    leave the JVM, long ones go to Python as Arrow batches; the work is linear in the text.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("text")) for f in fields]))
    flat = df.select(F.col(f"`{id_col}`").alias(id_col), pairs.alias("_p")).select(id_col, "_p.field", "_p.text").filter(F.col("text").isNotNull())
    id_type = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {id_type}, field string, piece int, n_pieces int, begin long, fresh long, end long, boundary string, text string"

    def run(batches):
        import pyarrow as pa


        for b in batches:
            ids, fld, txt = b.columns
            rows = ([], [], [], [], [], [], [], [], [])
            size = 0
            for i in range(b.num_rows):
                t = txt[i].as_py()
                got = cut_points(t, limit, overlap)
                for k, (begin, fresh, end, kind) in enumerate(got):
                    for col, v in zip(rows, (i, fld[i].as_py(), k, len(got), begin, fresh, end, kind, t[begin:end])):
                        col.append(v)
                    size += end - begin
                if size > 8_000_000:
                    yield _batch(pa, b, rows)
                    rows, size = ([], [], [], [], [], [], [], [], []), 0
            if rows[0]:
                yield _batch(pa, b, rows)

    def _batch(pa, b, rows):
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        cols = [b.column(0).take(pa.array(rows[0], pa.int64())), *[pa.array(r, k) for r, k in zip(rows[1:], kinds)]]
        return pa.RecordBatch.from_arrays(cols, names=[id_col, "field", "piece", "n_pieces", "begin", "fresh", "end", "boundary", "text"])

    n = F.char_length("text")
    long = flat.filter(n > limit).mapInArrow(run, schema)
    if only_long:
        return long
    whole = flat.filter(n <= limit).select(
        id_col, "field", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("fresh"),
        n.cast("long").alias("end"), F.lit("end").alias("boundary"), "text",
    )
    return whole.unionByName(long)


FIELDS = ["pos_full_text", "pos_qa_plus_body"]


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the oversized texts."""
    return split_long_texts(spark.read.parquet(f"{sf_dir}/pairs.parquet"), "pair_id", FIELDS, only_long=True)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that needed more than one piece: the operator's second pieces."""
    return p1_pieces(spark, sf_dir).filter("piece = 1").select("pair_id", "field")


def p1_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each oversized text come to: fresh parts joined again (md5), longest piece within the limit, several pieces, each overlapping the one before by about 200."""
    size = F.col("end") - F.col("fresh")
    part = F.expr("substring(text, cast(fresh - begin + 1 AS int), cast(end - fresh AS int))")
    back = F.col("fresh") - F.col("begin")
    x = p1_pieces(spark, sf_dir).select("pair_id", "field", "piece", "n_pieces", part.alias("part"), size.alias("new"), F.char_length("text").alias("n"), back.alias("back"))
    return x.groupBy("pair_id", "field").agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "part"))), lambda y: y["part"]), "")).alias("rejoined"), F.bool_and((F.col("n") <= 6000) & (F.col("new") > 0)).alias("within_limit"),
        ((F.count("*") == F.max("n_pieces")) & (F.count("*") > 1)).alias("all_pieces"), F.bool_and((F.col("piece") == 0) | F.col("back").between(100, 300)).alias("overlapping"),
    )


SQL = {
    "p1_rejoined": "".join(
        f"{u} SELECT pair_id, '{f}' AS field, md5({f}) AS rejoined, true AS within_limit, true AS all_pieces, true AS overlapping FROM pairs WHERE length({f}) > 6000" for u, f in (("", FIELDS[0]), (" UNION ALL", FIELDS[1]))
    ).strip(),
    "p1_found": """
SELECT pair_id, 'pos_full_text' AS field FROM pairs WHERE length(pos_full_text) > 6000
UNION ALL SELECT pair_id, 'pos_qa_plus_body' FROM pairs WHERE length(pos_qa_plus_body) > 6000""",
}
