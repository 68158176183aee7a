"""X1-X9, F1-F5 on the hand-made cases of FIXTURES.md."""

from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import filters as flt


def one(spark, col_fn, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col_fn(F.col("t")).alias("r")).first().r


def test_split_sentences(spark):
    cases = {
        "Mr. Smith paid 1. 5 dollars. Done? Yes! Ok.": ["Mr. Smith paid 1. 5 dollars.", "Done?", "Yes! Ok."],
        "The U.S. economy grew. ACME Inc. rose.": ["The U.S.", "economy grew.", "ACME Inc.", "rose."],
        "A.  B. ": ["A.", " B.", ""],
        "Dr. No left.\nNext line? End": ["Dr. No left.", "Next line?", "End"],
        "": [""],
    }
    for text, expected in cases.items():
        assert one(spark, tx.split_sentences, text) == expected, text


def test_shares(spark):
    assert abs(one(spark, tx.digit_punct_fraction, "a1.%") - 0.75) < 1e-12
    assert abs(one(spark, tx.digit_punct_fraction, "abcdefg123") - 0.30) < 1e-12
    assert one(spark, tx.digit_punct_fraction, "") is None
    assert one(spark, lambda c: tx.digit_punct_fraction(c, empty=0.0), "") == 0.0
    # superscript two counts as a digit, as Python's isdigit() does
    assert abs(one(spark, tx.digit_punct_fraction, "a²") - 0.5) < 1e-12
    assert one(spark, tx.word_count, "  a  b\nc ") == 3
    assert one(spark, tx.percent_count, "5% of 6%") == 2


def test_report_sentences(spark):
    sents = ["Sales rose 12 percent here.", "2019 2020 2021", "a%%%%%% b", "a%%%%% b", "   "]
    df = spark.createDataFrame([(sents,)], "s array<string>")
    kept = df.select(tx.keep_report_sentences(F.col("s")).alias("k")).first().k
    assert kept == ["Sales rose 12 percent here.", "a%%%%% b"]


def test_transcripts(spark):
    lines = ["Operator: Good morning everyone", "This is a rather long line: with colon", "Short: hi",
             "Analyst: a question here", "CEO: thanks for the question"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:4]))], "doc_id long, text string")
    out = {r.doc_id: r.text for r in flt.clean_transcripts(df).collect()}
    assert list(out) == [1]
    assert out[1] == " Good morning everyone This is a rather long line: with colon  a question here  thanks for the question"


def test_doc_type(spark):
    df = spark.createDataFrame([(t,) for t in ["EX-99.1", "EX-99.5", "EX-10.1", "EX-99"]], "doc_type string")
    assert sorted(r.doc_type for r in flt.filter_doc_type(df).collect()) == ["EX-99", "EX-99.1"]


def test_normalize_pretokenize(spark):
    assert one(spark, tx.normalize_text, "  Éléphant Über ") == "elephant uber"
    assert one(spark, tx.pretokenize, "abc123def, x_y!!") == ["abc", "1", "2", "3", "def", ",", "x_y", "!!"]
