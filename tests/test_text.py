import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("QUESTION: 1. Foo bar", "Foo bar"), ("1. QUESTION: Foo  bar ", "Foo bar"), ("(2) Foo", "(2) Foo"), ("Issue — Foo", "Issue — Foo"), ("1.5 million", "5 million"), ("a  \n b", "a b"), (None, ""), ("", ""),
        ("Questions presented: what", "what"), ("QUESTIONS: what", "QUESTIONS: what"),
    ],
)
def test_normalize_question(spark, given, wanted):
    assert one(spark, T.normalize_question, given) == wanted


def test_tokens(spark):
    assert one(spark, T.retrieval_tokens, "The Section 87103(a) gift-rule, of Gifts!") == ["section", "87103a", "gift-rule", "gifts"]
    assert one(spark, T.leakage_tokens, "The agency's Section 5 a gift") == ["agency's", "gift"]
    assert one(spark, T.retrieval_tokens, None) == [] and one(spark, T.leakage_tokens, "the a") == []


def test_char_ngrams(spark):
    assert one(spark, T.char_ngrams, "ABC  def") == ["abc d", "bc de", "c def"]
    assert one(spark, T.char_ngrams, "ab") == ["ab"] and one(spark, T.char_ngrams, "  ") == [] and one(spark, T.char_ngrams, None) == []


def test_citations(spark):
    got = lambda s: [(c["kind"], c["raw"], c["base"]) for c in one(spark, T.citations, s)]
    assert got("Section 87103(a), more") == [("gov", "87103(a)", "87103"), ("gov", "87103", "87103")]
    assert got("Section 18702.2") == [("gov", "18702", "18702"), ("reg", "18702.2", "18702")]
    assert got("see 1090 and Regulation 18730.1 and 1090") == [("gov", "1090", "1090"), ("reg", "18730.1", "18730")]
    assert got("none") == [] and got(None) == []


def test_conclusions(spark):
    t = "QUESTION: a?\n\nCONCLUSION: yes. "
    assert one(spark, T.conclusion_section, t) == "CONCLUSION: yes. " and one(spark, T.conclusion_text, t) == "yes."
    assert one(spark, T.conclusion_section, "CONCLUSION: yes") is None and one(spark, T.conclusion_text, None) == ""
    assert len(one(spark, T.conclusion_text, "\n\nCONCLUSION:" + "x" * 2000)) == 1500


def test_paraphrase_json(spark):
    r = one(spark, T.paraphrase_json, '```json\n{"keyword": " a ", "fact_pattern": "b"}\n```')
    assert (r["keyword"], r["fact_pattern"]) == ("a", "b")
    for bad in ("", None, "no", '{"keyword": "a"}', '{"keyword": "a", "fact_pattern": " "}', '{"keyword": "a", "fact'):
        assert one(spark, T.paraphrase_json, bad) is None


def test_qa_or_full(spark):
    df = spark.createDataFrame([("short", "full text"), ("x" * 20, "f"), (None, None), ("", " ")], "q string, f string")
    assert [r[0] for r in df.select(T.qa_or_full(F.col("q"), F.col("f"))).collect()] == ["full text", "x" * 20, " ", " "]


def test_base_code(spark):
    assert one(spark, T.base_code, " 87103(a)(2) ") == "87103"
