"""Scalar text functions as Column expressions: normalisation, tokenizers, citations, derived fields."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: white space, patterns and word lists -------------------------------
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LEADING_LABEL = rf"(?i)^{SPACE}*(?:QUESTION|QUESTIONS?{SPACE}*PRESENTED|ISSUE){SPACE}*[:.\-]{SPACE}*"
LEADING_NUMBER = rf"^{SPACE}*(?:[0-9]+{SPACE}*[.)]{SPACE}*)+"
STATUTE = r"(?i)(?:Section|Gov(?:ernment)?\.?\s*Code)\s+(\d{3,5})(\([a-zA-Z0-9]\))?"
REGULATION = r"(?i)(?:Reg(?:ulation)?\.?)\s+(\d{4,5}(?:\.\d+)?)"
BARE_STATUTE = r"\b(?:8[1-9]\d{3}|90\d{3}|91014|109[0-7])(?:\([a-zA-Z0-9]\))?\b"
BARE_REGULATION = r"\b18\d{3}(?:\.\d+)?\b"
LEAKAGE_TOKEN = "[a-z0-9]+(?:[’']s)?"
RETRIEVAL_STOPWORDS = (
    "a an and are as at be been being but by can could did do does doing done down during each few for from further get got had has have having he her here hers herself him himself his how i if in into is "
    "it its itself just let may me might more most much must my myself nor of off on once only or other ought our ours ourselves out over own same shall she should so some such than that the their theirs "
    "them themselves then there these they this those through to too under until up upon us very was we were what when where which while who whom why will with would yet you your yours yourself yourselves "
    "about above after again against all am any because before below between both also"
).split()
LEAKAGE_STOPWORDS = (
    "the a an of to in on at for and or is are was were be been being this that these those it its as by with from but if do does did may must can could would should shall will have has had any all not no "
    "than then there their they we you he she his her him i my me us our section subsection"
).split()
# ---------------------------------------------------------------------------------------


def let(value: Column, f) -> Column:
    """f(value) with the value worked out once: inside another lambda it would be worked out for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(SPACES))


def filled(c: Column) -> Column:
    """The stripped text, null where nothing is left: missing, null and blank are one case."""
    return F.nullif(strip(c), F.lit(""))


def normalize_question(c: Column) -> Column:
    """Without leading labels and numbers (twice each), runs of white space as one blank. Null becomes empty."""
    for _ in range(2):
        c = F.regexp_replace(F.regexp_replace(c, LEADING_LABEL, ""), LEADING_NUMBER, "")
    return F.coalesce(strip(F.regexp_replace(c, f"{SPACE}+", " ")), F.lit(""))


def _without(tokens: Column, stop) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop) & (t != ""))


def retrieval_tokens(c: Column) -> Column:
    """Tokens for lexical scoring: lower case, 87103(a) as 87103a, letters, digits and hyphens, no stop words."""
    joined = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?<=\d)\(([a-z0-9])\)", "$1")  # beginning with the rare sign
    return _without(F.split(F.trim(F.regexp_replace(joined, r"[^a-z0-9\-]+", " ")), " "), RETRIEVAL_STOPWORDS)


def retrieval_token_lists(texts):
    """retrieval_tokens for an Arrow array of lower-case texts without nulls, many times as fast as the column expression."""
    import pyarrow as pa
    import pyarrow.compute as pc

    joined = pc.replace_substring_regex(texts, pattern=r"([0-9])\(([a-z0-9])\)", replacement=r"\1\2")
    lists = pc.split_pattern_regex(joined, pattern=r"[^a-z0-9\-]+")
    flat = lists.flatten()
    kept = pc.invert(pc.is_in(flat, value_set=pa.array([*RETRIEVAL_STOPWORDS, ""], flat.type)))
    before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])  # tokens kept before each place
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    return pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), flat.filter(kept))


def excerpt(c: Column, n: int = 60) -> Column:
    """The first n characters for a cell of a table, bars escaped; null becomes empty."""
    return F.replace(F.substring(F.coalesce(c, F.lit("")), 1, n), F.lit("|"), F.lit("\\|"))


def leakage_tokens(c: Column) -> Column:
    """Tokens for leakage measures: words with a possessive s, over one character, no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(LEAKAGE_TOKEN), 0), lambda t: ~t.isin(*LEAKAGE_STOPWORDS) & (F.length(t) > 1))


def char_ngrams(c: Column, n: int = 5) -> Column:
    """The set of character n-grams of the lower-case, space-collapsed text; a shorter text is its only one, an empty one has none."""
    s = strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"{SPACE}+", " "))
    grams = lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(n))))
    return let(s, lambda s: F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(grams(s)))


def base_code(c: Column) -> Column:
    """A statute code without its parenthesised parts."""
    return F.trim(F.regexp_replace(c, r"\([^)]*\)", ""))


def conclusion_section(c: Column) -> Column:
    """From CONCLUSION: on, where a blank line stands before it; else null."""
    at = F.locate("\n\nCONCLUSION:", c)
    return F.when(at > 0, F.substring(c, at + 2, F.length(c)))


def conclusion_text(c: Column, most: int = 1500) -> Column:
    """The stripped text after CONCLUSION:, cut to `most` characters; empty if there is none."""
    return F.substring(strip(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\n\nCONCLUSION:(.*)", 1)), 1, most)


def qa_or_full(qa: Column, full: Column, least: int = 20) -> Column:
    """The text to embed: qa if it has at least `least` characters, else the full text, a blank if that is empty."""
    q = F.coalesce(qa, F.lit(""))
    t = F.when(F.length(strip(q)) < least, F.coalesce(full, F.lit(""))).otherwise(q)
    return F.when(strip(t) == "", F.lit(" ")).otherwise(t)


def citations(c: Column) -> Column:
    """array<struct<kind, raw, base>> of the statutes and regulations cited, labelled ones before bare ones, each raw form once."""
    t = F.coalesce(c, F.lit(""))
    gov = F.concat(
        F.transform(F.regexp_extract_all(t, F.lit(STATUTE), 0), lambda m: F.regexp_extract(m, r"\d{3,5}(?:\([a-zA-Z0-9]\))?$", 0)),
        F.regexp_extract_all(t, F.lit(BARE_STATUTE), 0),
    )
    reg = F.concat(F.regexp_extract_all(t, F.lit(REGULATION), 1), F.regexp_extract_all(t, F.lit(BARE_REGULATION), 0))
    gov_s = F.transform(F.array_distinct(gov), lambda r: F.struct(F.lit("gov").alias("kind"), r.alias("raw"), F.regexp_replace(r, r"\(.*", "").alias("base")))
    reg_s = F.transform(F.array_distinct(reg), lambda r: F.struct(F.lit("reg").alias("kind"), r.alias("raw"), F.regexp_replace(r, r"\..*", "").alias("base")))
    return F.concat(gov_s, reg_s)


def paraphrase_json(c: Column) -> Column:
    """struct<keyword, fact_pattern> from a model's answer: fences cut, the outermost braces parsed; null unless both are filled texts."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?im)^```(?:json)?\s*|\s*```$", "")
    got = F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), "keyword string, fact_pattern string", {"mode": "PERMISSIVE"})
    k, f = strip(got["keyword"]), strip(got["fact_pattern"])
    return F.when((k != "") & (f != ""), F.struct(k.alias("keyword"), f.alias("fact_pattern")))


def prompt(template: str, question: Column, conclusion: Column) -> Column:
    """A template with {question} and {conclusion} filled in; an empty conclusion reads (not available)."""
    c = F.when(F.coalesce(conclusion, F.lit("")) == "", F.lit("(not available)")).otherwise(conclusion)
    return F.replace(F.replace(F.lit(template), F.lit("{conclusion}"), c), F.lit("{question}"), F.coalesce(question, F.lit("")))


def prefixed(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c)
