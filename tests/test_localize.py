import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.operators import localize

KIND = T.StructType().add("title", "string").add("n", T.IntegerType()).add("parts", T.ArrayType(T.StructType().add("name", "string").add("tags", T.MapType(T.StringType(), T.ArrayType(T.StringType()))))).add("a.b", "string")
PHRASES, TEMPLATES = {"Good.": "Gut.", "Product schema detected.": "exact"}, ((r"^(\w+) schema detected\.$", "$1 gefunden."), (r"^(\w+) .*$", "later $1"))


def test_texts_at_every_depth(spark):
    row = ("Good.", 3, [("Good.", {"Good.": ["Good.", None, "kept"], "none": None}), None, ("Article schema detected.", {})], "Product schema detected.")
    frame = spark.createDataFrame([(1, row, "Good.", ["two words", "x"]), (2, None, None, None)], T.StructType().add("id", T.IntegerType()).add("payload", KIND).add("plain", "string").add("odd.name", T.ArrayType(T.StringType())))
    out = localize.localized(frame, "de", phrases=PHRASES, templates=TEMPLATES)
    assert out.schema.simpleString() == frame.schema.simpleString()
    one, two = sorted(out.collect())
    assert one.payload.title == "Gut." and one.payload.n == 3 and one.payload["a.b"] == "exact"  # a phrase before templates
    first, gap, last = one.payload.parts
    assert first.name == "Gut." and first.tags == {"Good.": ["Gut.", None, "kept"], "none": None} and gap is None and last.name == "Article gefunden." and last.tags == {}
    assert one.plain == "Gut." and one["odd.name"] == ["later two", "x"] and (two.payload, two.plain, two["odd.name"]) == (None, None, None)
    only = localize.localized(frame, "de", ["plain"], PHRASES, TEMPLATES).where("id = 1").first()
    assert only.plain == "Gut." and only.payload.title == "Good."


def test_languages(spark):
    frame = spark.createDataFrame([("FAQ content is missing.",), ("Product schema detected.",), ("free text",)], "t string")
    same = lambda language: [r.t for r in localize.localized(frame, language).collect()]
    assert same("en") == same("xx") == ["FAQ content is missing.", "Product schema detected.", "free text"] and same("zh") == ["缺少 FAQ 内容。", "已检测到 Product Schema。", "free text"]
    with pytest.raises(ValueError, match="join a table"):
        localize.localized(frame, "de", phrases={str(i): "x" for i in range(localize.MOST_PHRASES + 1)})
    assert "Join" not in localize.localized(frame.withColumn("k", F.lit(1)), "zh")._jdf.queryExecution().executedPlan().toString()
