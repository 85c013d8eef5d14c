from pyspark.sql import functions as F

from lightloom.llm.common import ascii_lower, count_plain_words


def test_words_and_lower(spark):
    rows = [(None, 0), ("", 0), (" \t\n", 0), ("a", 1), (" a\x0bb\r c ", 3), ("é ü x", 2)]
    df = spark.createDataFrame(rows, "text string, n long").select("n", count_plain_words(F.col("text")).alias("m"))
    assert all(r.n == r.m for r in df.collect())
    assert spark.range(1).select(ascii_lower(F.lit("ÀBcZé")).alias("x")).first().x == "Àbczé"
