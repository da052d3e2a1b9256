"""Keyword-stuffed and link-list pages, by block-wise compression ratio and sentence punctuation.

Every text is cut into blocks of about a thousand characters at blank lines, and every block is compressed twice: as it
is, which shows repeated keywords, and as its skeleton, in which links, numbers and all words but function words stand as one
sign for their class, which shows lists of ever new links, names or tags. Both sizes are set against what blocks of that
language and length take over the whole corpus. A block far below is redundant, and is spam if its sentence punctuation
confirms it: few sentence ends per word, sentences of one skeleton counted once. The further below, the less the
punctuation must be, as stuffed sentences keep some. No block is spam by its words or its punctuation alone.
Rows of tables, contents and agendas are put aside first.
"""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import keep

# --- fixed values: function words ----------------------------------------------------
FUNCTION_WORDS = {
    "en": frozenset(
        "the of a an to in and or for on at is are be by with that from this it as was were has have had not may will can cannot must which who whom if its their his her our your we you they i "
        "do does did so no any all more than then there these those such also but would should could shall been being about into under over after before when where because while during between through".split()
    ),
    "es": frozenset("el la los las un una unos unas y e o en de del al por para con sin no que se su sus lo como es son fue ha más porque ni cuando donde entre sobre hasta desde este esta".split()),
}
#: Expected sizes of an unusual language, as shares of a block's bytes: BASE + SLOPE / bytes, with SPREAD of the logarithm; of the block and of its skeleton.
CURVES = {"ratio": (0.485, 50.0, 0.045), "skeleton": (0.17, 12.0, 0.15)}
# -------------------------------------------------------------------------------------

BLOCK = 1000
LEAST = 120  # characters that a block needs to be judged
MIN_BLOCKS = 100  # blocks that a norm needs
# each pattern begins with what is rare in a text, so that most letters are passed at once
_PARA = re.compile(r"\n[ \t\r]*\n\s*")
_SENTENCE = re.compile(r"(?:(?<=[^\W_])|(?<=[\"”’)\]]))[.!?;](?=\s|$)")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"https?://\S+|www\.\S+|<a\s[^>]*>|[^\W\d_]+|\d+(?:[.,]\d+)*|\n|[^\w\s]", re.I)
_RUN = re.compile(r"w(?:(?: ,)? [w0])+")
_END = re.compile(r"(?<=[.!?;]) ")
_LINK = re.compile(r"(?:https?://|www\.)\S+|<a\s[^>]*>|</a>|\]\([^)\s]*\)", re.I)
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|ene|abr|ago|dic)\w*\.?"
_TABLE = re.compile(
    rf"^\s*(?:.*\.{{3,}}\s*\d+\s*$|(?:\d{{1,3}}|[a-z])[.)]\s+\w.*$|{_MONTH} \d{{1,2}}, \d{{4}}\b.*[$€]?\d[\d.,]*\s*$|[$€]?\s*\d[\d,]*(?:\.\d+)?\s*$|[^\t]*\t[^\t]*\t.*$)", re.I
)


def _paragraphs(text: str):
    """Paragraphs without table rows, and how many characters those had. Short neighbours without a sentence end stay together."""
    kept, aside = [], 0
    short: list[str] = []
    for p in _PARA.split(text):
        if not p.strip():
            continue
        if "\n" in p or len(p) < 200:
            lines, table = [], 0
            for line in p.split("\n"):
                if _TABLE.match(line) and not _LINK.search(line):
                    table += len(line)
                else:
                    lines.append(line)
            if table:
                aside += table
                p = "\n".join(lines)
                if len(p) < 60:  # a heading of the rows
                    aside += len(p)
                    continue
        if len(p) < LEAST and not _SENTENCE.search(p[-3:]):
            short.append(p)
            continue
        if short:
            kept.append("\n".join(short))
            short = []
        kept.append(p)
    if short:
        kept.append("\n".join(short))
    return kept, aside


def language(text: str, declared: str | None) -> str:
    """en, es or other: as declared, else by the function words of the whole text."""
    d = (declared or "").strip().lower()
    if d in FUNCTION_WORDS:
        return d
    if d and d != "und":
        return "other"
    ws = _WORD.findall(text.lower())
    got = {k: sum(w in v for w in ws) for k, v in FUNCTION_WORDS.items()}
    best = max(got, key=got.get)
    return best if got[best] * 8 >= len(ws) else "other"


def skeleton(text: str, funcs: frozenset, memo: dict) -> str:
    """The text with one sign for each class: u a link, 0 a number, w a word, W one with a capital; function words, punctuation and line ends stay."""
    out = []
    for t in _TOKEN.findall(text):
        c = memo.get(t)
        if c is None:
            low = t.lower()
            if low[:4] in ("http", "www.") or low[:2] == "<a":
                c = "u"
            elif t[0].isalpha():
                c = low if low in funcs else "W" if t[0].isupper() else "w"
            else:
                c = "0" if t[0].isdigit() else t
            if len(memo) > 200_000:
                memo.clear()
            memo[t] = c
        out.append(c)
    return " ".join(out)


def sentences(skel: str) -> int:
    """How many different sentences a skeleton has: runs of words are one, whatever their number and case; ends within links don't count."""
    flat = _RUN.sub("w", skel.lower().replace("\n ", ""))
    return len({x for x in _END.split(flat) if x[-1:] in ".!?;" and len(x) > 2 and x[-3:-2] != "u"})


def measure(text: str, lang: str, memo: dict | None = None) -> tuple[list[tuple], int]:
    """([(characters, bytes, compressed share, compressed skeleton's share, different sentences, words), ...] by block, characters in table rows)."""
    paras, aside = _paragraphs(text)
    funcs = FUNCTION_WORDS.get(lang) or FUNCTION_WORDS["en"] | FUNCTION_WORDS["es"]
    memo = {} if memo is None else memo
    out = []
    for p in paras:
        n = max(1, round(len(p) / BLOCK))
        step = -(-len(p) // n)
        at = 0
        while at < len(p):
            to = at + step if len(p) - at > step * 4 // 3 else len(p)
            # at a blank, if there is one near, so that no link or word is cut
            if to < len(p) and (gap := max(p.rfind(" ", at + step // 2, to), p.rfind("\n", at + step // 2, to))) > 0:
                to = gap + 1
            b = p[at:to]
            at = to
            data = b.lower().encode("utf-8", "replace")
            skel = skeleton(b, funcs, memo)
            size = max(1, len(data))
            out.append((len(b), len(data), len(zlib.compress(data, 6)) / size, len(zlib.compress(skel.encode("utf-8", "replace"), 6)) / size, sentences(skel), max(1, len(b.split()))))
    return out, aside


def usual(kind: str, n_bytes: int) -> float:
    """The log share usual for a length."""
    base, slope, _ = CURVES[kind]
    return math.log(min(base + slope / max(n_bytes, 50), 1.2))


def punctuation_limit(z: float, redundant: float) -> float:
    """Sentence ends per word below which a block's redundancy is confirmed: well under the usual 1 in 20 at the threshold, more for what is far beyond it."""
    return min(0.02 + 0.007 * (-z - redundant), 0.08)


def judge(blocks, aside: int, lang: str, norms: dict, redundant: float = 4.0) -> tuple[float, float, float]:
    """(share of the text in spam blocks, mean deviation, sentence ends per word); the last two over the spam blocks, or over all if there are none.

    A block's deviation is minus the length of its two shares' deviations below the norm, each in spreads of it. Blocks under LEAST bytes are spam only as skeletons
    without any sentence, as single lines of a list are.
    """
    total, bad = aside, 0
    sums = {True: [0.0, 0, 0, 0], False: [0.0, 0, 0, 0]}
    for chars, size, ratio, skel, ends, n_words in blocks:
        total += chars
        z = 0.0
        for kind, v in (("ratio", ratio), ("skeleton", skel)):
            mid, spread = norms.get((lang, kind)) or (0.0, CURVES[kind][2])
            z = math.hypot(z, min((math.log(max(v, 1e-6)) - usual(kind, size) - mid) / spread, 0.0))
        z = max(-z, -40.0)
        spam = z <= -redundant and ends / n_words < punctuation_limit(z, redundant) and (size >= LEAST or (size >= 40 and not ends))
        bad += chars * spam
        for part in (sums[spam],):
            part[0] += z * chars
            part[1] += chars
            part[2] += ends
            part[3] += n_words
    dev, weight, ends, n_words = sums[True] if bad else sums[False]
    return bad / total if total else 0.0, dev / weight if weight else 0.0, ends / n_words if n_words else 0.0


def spam_scores(docs: DataFrame, id_col: str, text_col: str, lang_col: str, redundant: float = 4.0, least_chars: int = 200) -> DataFrame:
    """id, spam_share, deviation, sentence_ends, is_spam of every document (repeated rows each for itself).

    spam_share: the part of the text in blocks that are redundant and confirmed by their punctuation; more than half makes a spam page.
    deviation and sentence_ends (per word) are the two measures over these blocks, or over all if there are none.
    Null, blank and short texts (under least_chars) are never spam and have share 0. A language's norm is the median and
    the upper half's spread of the log share, less the usual one of the length, over all blocks of the corpus that have
    sentences (stuffed ones sit in the lower half); one of fewer than MIN_BLOCKS blocks takes the fixed curve. Norms: 3 rows.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    id_type = dict(docs.dtypes)[id_col]
    block = "struct<chars:int,bytes:int,ratio:double,skeleton:double,ends:int,words:int>"

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("chars", pa.int32()), ("bytes", pa.int32()), ("ratio", pa.float64()), ("skeleton", pa.float64()), ("ends", pa.int32()), ("words", pa.int32())]))
        names = ("chars", "bytes", "ratio", "skeleton", "ends", "words")
        memos: dict[str, dict] = {}
        for b in batches:
            langs, aside, blocks = [], [], []
            for t, d in zip(b.column(1), b.column(2)):
                t = t.as_py() or ""
                if len(t.strip()) < least_chars:
                    got, rows, lang = 0, [], "other"
                else:
                    lang = language(t, d.as_py())
                    rows, got = measure(t, lang, memos.setdefault(lang, {}))
                langs.append(lang)
                aside.append(got)
                blocks.append([dict(zip(names, r)) for r in rows])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs), pa.array(aside, pa.int32()), pa.array(blocks, kind)], names=["id", "lang", "aside", "blocks"])

    measured = keep(src.mapInArrow(run, f"id {id_type}, lang string, aside int, blocks array<{block}>"))
    flat = measured.select("lang", F.explode("blocks").alias("b")).filter("b.bytes >= 200 AND b.ends >= 0.02 * b.words")
    less = lambda k: F.log(f"b.{k}") - F.log(CURVES[k][0] + CURVES[k][1] / F.col("b.bytes"))
    norm = flat.groupBy("lang").agg(F.count("*").alias("n"), *[F.percentile_approx(less(k), [0.5, 0.75], 2000).alias(k) for k in CURVES]).filter(F.col("n") >= MIN_BLOCKS)
    norms = {}
    for r in norm.collect():
        for k, (_, _, usual_spread) in CURVES.items():
            mid, upper = r[k]
            norms[r["lang"], k] = (mid, min(max((upper - mid) / 0.6745, 0.6 * usual_spread), 1.8 * usual_spread))

    def score(batches):
        import pyarrow as pa

        for b in batches:
            got = [judge([x.values() for x in blocks], aside, lang, norms, redundant) for lang, aside, blocks in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            share, dev, ends = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.float64()) for x in (share, dev, ends)]], names=["id", "spam_share", "deviation", "sentence_ends"])

    got = measured.mapInArrow(score, f"id {id_type}, spam_share double, deviation double, sentence_ends double")
    return got.select(F.col("id").alias(id_col), "spam_share", "deviation", "sentence_ends", (F.col("spam_share") > 0.5).alias("is_spam"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).filter("is_spam").select("doc_id")
