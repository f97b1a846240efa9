from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import prompts, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


@pytest.mark.parametrize("value", ["", " a ", "　x \t", "\x1c\x85y ", "in ner", None, "\n\n"])
def test_clean_text_strips_like_python(spark, value):
    assert one(spark, text.clean_text(F.lit(value).cast("string"))) == (value or "").strip()


def test_longest_prefers_the_first_of_equals(spark):
    cols = [F.lit(" ab "), F.lit("cd"), F.lit(None).cast("string"), F.lit("\U0001f600")]
    assert one(spark, text.longest_of(cols)) == "ab"
    assert one(spark, text.longest_of([F.lit(None).cast("string"), F.lit("  ")])) == ""


def test_keyword_fallback_order(spark):
    df = spark.createDataFrame([("", None, "de", "kp"), (" own ", "a", "b", "c")], "`k` string, `Author Keywords` string, DE string, `Keywords Plus` string")
    got = [r.x for r in df.select(text.keyword_fallback(F.col("k"), df.columns).alias("x")).collect()]
    assert got == ["kp", "own"]


def test_split_list(spark):
    assert one(spark, text.split_list(F.lit(" a, ,b ,"))) == ["a", "b"]
    assert text.split_argument(" a, ,b ,") == ["a", "b"]
    assert text.split_argument(None) == []


def test_render_is_sequential(spark):
    template = "{{a}} {{b}} {{c}}"
    assert one(spark, prompts.render(template, a="x{{b}}", b=F.lit("y{{c}}"), z="no")) == "xy{{c}} y{{c}} {{c}}"
    assert one(spark, prompts.render(template, a=F.lit("{{b}}"), b="{{a}}", c=3)) == "{{a}} {{a}} 3"
    assert one(spark, prompts.render("plain", a=F.lit("x"))) == "plain"


def test_read_template(spark, tmp_path):
    (tmp_path / "score.md").write_text("Rate {{topic}}\n  twice\n", encoding="utf-8")
    assert prompts.read_template(spark, str(tmp_path / "score.md")) == "Rate {{topic}}\n  twice\n"
