import pytest
from pyspark.sql import functions as F

from quire.functions import text as t


def run(spark, column, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("v"))).collect()]


def test_norm_key(spark):
    given = ["ＢＥＲＴ-Base_x", "Straße", "  Long　Short--Term ", "ﬁne_tune", "---", None]
    assert run(spark, t.norm_key, given) == ["bert base x", "strasse", "long short term", "fine tune", "", None]


def test_norm_key_of_ascii_names_is_that_of_python(spark):
    given = ["".join(map(chr, range(k, k + 16))) for k in range(0, 128, 16)] + ["a\x1cb\x1f", "\x00 A", "A\n", "A\x85", "A\u2028", "x\r\n", " -_ "]
    assert run(spark, t.norm_key, given) == [t.norm_text(x) for x in given]


def test_parse_value(spark):
    given = ["90.18", "93.8%", "12.3 dB", "85-90", "1,234", "1e-3", ".5", "SNR=-2", "n/a", "", None]
    assert run(spark, t.parse_value, given) == [90.18, 93.8, 12.3, 85, 1, 1, 5, -2, None, None, None]


def test_filename_of_and_title(spark):
    assert run(spark, t.filename_of, ["a.md::3", "a::b.md::0", "a:::5", "plain"]) == ["a.md", "a::b.md", "a:", "plain"]
    assert run(spark, t.title_of, ["a_b.md", "x.md.md", "n"]) == ["a b", "x.md", "n"]
    assert run(spark, t.snippet, ["a\nb" * 60]) == [("a b" * 60)[:100]]


def test_strip_is_unicode(spark):
    assert run(spark, t.strip, ["  a b　\n", "\u001cx", "", None]) == ["a b", "x", "", None]


def test_result_id_takes_null_as_empty(spark):
    row = spark.range(1).select(t.result_id(F.lit("a"), F.lit(None).cast("string"), F.lit("b")).alias("x"), F.md5(F.lit("a||b").cast("binary")).alias("y")).first()
    assert row.x == row.y


def test_headers(spark):
    levels = [("#", "h1"), ("##", "h2"), ("###", "h3")]
    df = spark.range(1).select(F.create_map(F.lit("h1"), F.lit("A"), F.lit("h3"), F.lit("C"), F.lit("h2"), F.lit("")).alias("m"))
    prefix = t.header_prefix(F.col("m"), levels)
    assert df.select(prefix).first()[0] == "# A\n### C"
    assert df.select(t.add_prefix(F.lit("body"), F.lit(""))).first()[0] == "body"


@pytest.mark.parametrize("text", ["a\r\nb\rc\n"])
def test_line_ends(spark, text):
    assert spark.range(1).select(t.text_of(F.lit(text).cast("binary"))).first()[0] == "a\nb\nc\n"
