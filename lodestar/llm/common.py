"""Helpers shared by the training-data operators: names, sizes, text folding, tokenizers."""

from __future__ import annotations

import base64
import os
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

# --- fixed values -----------------------------------------------------------------
#: What a scanner reads in place of what was printed: (read, printed).
MISREAD = (
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("vv", "w"),
    ("h", "li"), ("b", "h"), ("l", "i"), ("i", "l"), ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"),
    ("|", "i"), ("5", "s"), ("8", "b"), ("9", "g"), ("6", "b"),
)
#: The cut for the byte-level vocabularies.
BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# ----------------------------------------------------------------------------------

# Each letter as a run of simple strokes, such that both sides of every misreading become the same run, whatever stands
# around them: m as rn, n as ri and so on down to letters that nothing is misread for.
_STROKES = str.maketrans(
    {"i": "l", "1": "l", "|": "l", "h": "ll", "b": "ll", "6": "ll", "8": "ll", "u": "ll", "n": "rl", "m": "rrl", "d": "cl", "w": "vv", "0": "o", "5": "s", "9": "g"}
)
_WORD = re.compile(r"[^\W_]+(?:\|[^\W_]*)*|\|[^\W_]+")


def fold_letters(s: str) -> str:
    """A key equal for spellings that differ only by scanner misreadings (letters and mixed words)."""
    return s.translate(_STROKES)


def fold_word(w: str) -> str:
    """fold_letters for a lower-case word; a number keeps its digits."""
    return w if w.isdigit() else fold_letters(w)


def words(text: str) -> list[str]:
    """Lower-case words and numbers after compatibility normalisation (ligatures, full-width forms)."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower().replace("’", "'").replace("'s ", " "))


def with_columns_safe(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of any name can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persisted (in memory, then on disk) until release(); made again where an executor is lost."""
    from pyspark import StorageLevel

    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(df)
    return df


def release() -> None:
    """Gives back what operators of this process have kept. What is still in use is made again when needed."""
    while _kept:
        try:
            _kept.pop().unpersist()
        except Exception:  # noqa: BLE001  (its session has ended)
            continue


def stored(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder of spark.checkpoint.dir and read from there, its lineage cut. Where that is unset, in local mode a folder is made; elsewhere the table is kept."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.startswith("local"):
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoint")
        if folder is None:
            return keep(df)
        sc.setCheckpointDir(folder)
    return df.checkpoint()


SMALL = 200_000  # rows of keys that may go to all tasks
HOT = 100_000  # members of a class in one task


def small(df: DataFrame) -> DataFrame:
    """The table kept, marked for broadcast if it has at most SMALL rows; else as it is, for a shuffled join."""
    df = keep(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def join_members(links: DataFrame, members: DataFrame, on: list[str], id_col: str) -> DataFrame:
    """links joined with the members of their classes.

    Few links go to all tasks and no member is shuffled. Otherwise the members of a class above HOT are spread by salts of their ids, to
    each of which the class's links go; there are at most rows / HOT such classes.
    """
    links = keep(links)
    if links.count() <= SMALL:
        return F.broadcast(links).join(members, on)
    hot = small(members.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT).select(*on, (F.col("_n") / HOT + 1).cast("long").alias("_n")))
    salted = members.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(id_col), F.coalesce("_n", F.lit(1).cast("long")))).drop("_n")
    spread = links.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_n", F.lit(1).cast("long")) - 1))).drop("_n")
    return spread.join(salted, [*on, "_salt"]).drop("_salt")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_encoders: dict[str, object] = {}


def encoder(path: str | None = None):
    """A byte-level encoder from a .tiktoken rank file; one per process."""
    path = path or os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), tokenizer: str | None = None, out: str = "n_tokens") -> DataFrame:
    """id, kept columns and the token count of the whole text (null text: 0). One pass, no shuffle; texts stay in their task."""
    import pyarrow as pa

    src = with_columns_safe(docs, id_col, *keep, text_col)
    fields = [*[f for f in src.schema.fields if f.name != text_col]]
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*fields, StructField(out, LongType())])

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            texts = b.column(b.schema.names.index(text_col))
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in texts)]
            rest = [i for i, name in enumerate(b.schema.names) if name != text_col]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in rest], pa.array(n, pa.int64())], names=[*[b.schema.names[i] for i in rest], out])

    return src.mapInArrow(run, schema)
