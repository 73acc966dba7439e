"""The yes or no of a printed number is one pattern and says what the full reading says."""

import random

from pyspark.sql import functions as F

from figtrail.functions.numbers import is_number, looks_like_cell_value, with_number

PIECES = ["0", "12", "1,234", "12,34,567", "1,2", ",", ".5", "₹", "Rs.", "US$", "$", "-", "−", "nil", "(", ")", "%", "bps", "x", " ", " ", "*", "¤", "b"]


def test_the_pattern_agrees_with_the_full_reading(spark):
    rng = random.Random(7)
    texts = {"".join(rng.choice(PIECES) for _ in range(rng.randint(1, 5))) for _ in range(20000)} | {"(₹ 12)", "( 12)%", "US$ 1,234.5", "-12 bps", "(1,234 %)", "nil"}
    df = with_number(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "n_").withColumn("yes", is_number(F.col("text")))
    assert df.filter("yes").count() > 50
    assert df.filter("yes <> (n_kind IS NOT NULL)").take(3) == []


def test_a_text_is_read_once(spark):
    df = spark.createDataFrame([("12 *",), ("12* *",), ("1-2",), ("(nil)",), ("-^",)], "text string").select("text", looks_like_cell_value(F.col("text")).alias("yes"))
    assert {r.text: r.yes for r in df.collect()} == {"12 *": True, "12* *": False, "1-2": True, "(nil)": False, "-^": True}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("regexp") == 0
