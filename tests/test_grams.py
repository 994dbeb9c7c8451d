import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import textml as M


@pytest.mark.parametrize("most", [200_000, 3])
def test_grams_of_kept_words_are_those_of_the_expression(spark, monkeypatch, most):
    """Also where the words that a task keeps are dropped now and then, and for odd blanks and letters."""
    monkeypatch.setattr(M, "WORDS", most)
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abÄé𝒳ß1#|") for _ in range(draw.randrange(1, 9)))
    rows = [(i, draw.choice([" ", "  ", "\t", "\x0b\n", "\u00a0"]).join(word() for _ in range(draw.randrange(5)))) for i in range(300)]
    df = spark.createDataFrame([*rows, (300, None), (301, "   ")], "id long, t string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {r.id: r.grams for r in M.with_grams(df, "t", 2, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r.id: r.g for r in df.select("id", M.char_wb_ngrams(F.col("t"), 2, 5).alias("g")).collect()}


def test_the_models_texts_are_stored_without_their_grams(spark):
    """Their joins are made once, and no expression makes n-grams letter by letter."""
    from ledgerloom.plans import features
    from ledgerloom.plans.fixtures import Fixture

    plan = features.texts(Fixture(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "substring" not in plan and "MapInArrow" in plan
