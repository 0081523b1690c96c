import pytest
from pyspark.sql import functions as F

from mapwright.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (T.tokens, "Éa b_2, C!", ["éa", "b_2", "c"]),
        (T.sentences, "One. Two!  Three? four", ["One.", "Two!", "Three?", "four"]),
        (T.is_header, "Section 1: Access", True),
        (T.is_header, "2.1  Unique", True),
        (T.is_header, "2.1 Unique", False),
        (T.is_header, "APPENDIX A — Terms", True),
        (T.comparable, "  Page 12 of 30 ", "page # of #"),
        (T.is_fragment, "(see below)", True),
        (T.is_fragment, "Approved by the CISO " + "x" * 200, True),
        (T.is_fragment, "A policy of the firm.", False),
        (T.ends_with_trailing_word, "Access is granted to the", True),
        (T.ends_with_trailing_word, "Access is granted.", False),
        (T.truncate, "a\nb", "a b"),
        (T.truncate, "x" * 160, "x" * 147 + "..."),
        (T.requirement_key, " Use  TLS.; ", "use tls"),
        (T.family_of, "8.2.5", "8"),
        (T.family_of, "AC-1", "AC"),
        (T.family_of, "X", "X"),
        (T.json_object, 'say ```json\n{"a": 1}\n``` done', '{"a": 1}'),
        (T.json_object, 'x {"a": {"b": 1}} y', '{"a": {"b": 1}}'),
        (T.json_array, "x [1, [2]] y", "[1, [2]]"),
        (T.truncate_at_sentence, "short", "short"),
        (T.truncate_at_sentence, "a" * 700 + ". " + "b" * 700, "a" * 700 + "."),
        (T.truncate_at_sentence, "a. " + "b" * 1400, "a. " + "b" * 1197 + "\n[...truncated]"),
        (T.expand_query, "Flaw Remediation", "Flaw Remediation [patching, vulnerability management, CVE, security update]"),
        (T.page_segments, "short", ["short"]),
    ],
)
def test_functions(spark, f, given, expected):
    assert one(spark, f, given) == expected


def test_long_pages_are_cut_at_numbered_headings(spark):
    page = "intro\n1  First\n" + "x" * 1500 + "\n1.2  Second\ny"
    assert one(spark, T.page_segments, page) == ["intro", "1  First\n" + "x" * 1500, "1.2  Second\ny"]


def test_cosine_of_nothing_is_zero(spark):
    row = spark.sql("select array(0.0D, 0.0D) a, array(1.0D, 2.0D) b").select(T.cosine(F.col("a"), F.col("b")).alias("z"), T.cosine(F.col("b"), F.col("b")).alias("o")).first()
    assert row["z"] == 0 and abs(row["o"] - 1) < 1e-12
