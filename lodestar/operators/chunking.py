"""Fixed windows of tokens for language modelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_windows(df: DataFrame, id_col: str, text_col: str, size: int = 512, most: int | None = None, seed: str = "42") -> DataFrame:
    """id, chunk, n_tokens, tokens: consecutive windows of size - 2 tokens (room for two marks) over the whole text, or with `most` that many at the
    most, from a seeded start.

    The start is hashed from seed and id over the room that is left, none without `most`; a last window under a quarter of the size
    is dropped. Tokens are words parted by white space. Null and blank texts give none.
    """
    c = size - 2
    toks = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda t: t != "")
    d = df.select(F.col(id_col), toks.alias("t")).withColumn("len", F.size("t")).filter("len > 0")
    n = F.greatest(F.lit(1), F.ceil(F.col("len") / c))
    d = d.withColumn("n", (n if most is None else F.least(n, F.lit(most))).cast("int"))
    room = F.greatest(F.lit(0), F.col("len") - F.col("n") * c)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("bigint")
    d = d.withColumn("start", F.pmod(h, room + 1).cast("int"))
    x = d.select(id_col, F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.slice("t", F.col("start") + k * c + 1, c))).alias("chunk", "tokens"))
    return x.withColumn("n_tokens", F.size("tokens")).filter(F.col("n_tokens") >= c // 4).select(id_col, "chunk", "n_tokens", "tokens")
