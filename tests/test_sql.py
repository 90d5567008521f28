"""Text functions called from SQL text against the column expressions they are made of."""

import random

import pytest
from pyspark.sql import functions as F

from screenlens.functions import sql
from screenlens.operators import subtitles

PIECES = ["<i>", "{\\an8}", "&amp;lt;", "a < b", "<v Ann>", "ko", "en-US", ".", "_", "forced", " ", "\u00a0", "\r\n", "http://x.y/z",
          "https://[::1", "00:01:02,5", "1:02.250", "'", '"', "\\", "$1", "é", "\ufeff", "-->"]


@pytest.fixture(scope="module")
def values(spark):
    sql.register(spark)
    rng = random.Random(2)
    rows = [tuple("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 5))) for _ in range(2)) for _ in range(300)]
    rows += [("x.mkv.ko.srt", "x.mkv."), ("x.en-US.vtt", "x."), (None, "en"), ("en", None), (None, None), ("", "")]
    df = spark.createDataFrame([(*r, rng.choice([None, 0.0, 12.34, 3600.05])) for r in rows], "a string, b string, d double")
    return df.withColumn("e", F.col("d") + 100.25)


@pytest.mark.parametrize("name", sql.EXPRESSIONS)
def test_sql_equals_expression(spark, values, name):
    parameters, expression = sql.EXPRESSIONS[name]
    names = ["d", "e"] if "DOUBLE" in parameters else ["a", "b"]
    names = names[: len(parameters.split(", "))]
    got = spark.sql(f"SELECT *, {name}({', '.join(names)}) AS got FROM {{v}}", v=values)
    both = got.withColumn("want", expression(*[F.col(n) for n in names]))
    assert both.filter(~F.col("got").eqNullSafe(F.col("want"))).collect() == []
    assert both.filter("got IS NOT NULL").count() > 0


def test_cues_of_documents(spark):
    sql.register(spark)
    documents = [
        ("a", "1\r\n00:00:05,000 --> 00:00:06,500\r\n<i>Late</i>\r\n\r\n2\r\n00:00:01,000 --> 00:00:02,000\r\n<v Bob>Hi &amp; bye\r\n"),
        ("b", "WEBVTT\n\nNOTE 00:01.000 --> 00:02.000\nno cue\n\n00:03.5 --> 00:04 align:start\nIt's {\\\\an8}here\nand there\n"),
        ("c", "no cue at all"),
        ("d", ""),
        ("e", "00:02.000 --> 00:01.000\nends first\n\n00:01.000 --> 00:02.000\n<b></b>\n"),
    ]
    files = spark.createDataFrame(documents, "file_id string, text string")
    want = subtitles.parse_timed_blocks(files, "basic").drop("cue_no")
    cues = spark.sql("SELECT file_id, timed_cues(text) AS cues FROM {f}", f=files)
    got = cues.select("file_id", F.inline("cues"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [r.text for r in got.filter("file_id = 'a'").collect()] == ["Bob: Hi & bye", "Late"]
