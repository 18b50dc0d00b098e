import random

import pytest
from helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from ballotcredit.operators.numbering import factor_levels, ranked_keys, with_rank


@pytest.fixture
def frame(table):
    draw = random.Random(1)
    values = [(draw.choice(["a", "b", None]), draw.choice([None, *range(12)]), draw.randrange(3), i)
              for i in range(400)]
    return table("k string, x int, y int, id int", *values)


@pytest.mark.parametrize("within", [[], ["k"], ["k", "x"]])
def test_equal_to_windows(frame, within):
    order = [c for c in ("x", "y") if c not in within]
    by = Window.partitionBy(*[F.col(c) for c in within]).orderBy(*order)
    for dense, place in ((False, F.rank()), (True, F.dense_rank())):
        got = with_rank(frame, order, "place", within, dense)
        want = frame.withColumn("place", place.over(by).cast("long"))
        assert got.schema["place"].dataType == want.schema["place"].dataType
        assert rows(got, "id") == rows(want, "id")


def test_no_task_ranks_all_keys(spark):
    many = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("v"))
    ranked = ranked_keys(many, ["v"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the sums of the ranges
    checked = ranked.withColumn("below", F.col("v"))
    assert ranked.count() == 200_000
    ends = checked.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()
    assert tuple(ends) == (1, 200_000, 200_000)
    line = Window.orderBy("v")
    assert checked.where("v % 1000 < 3").withColumn("next", F.lead("rank").over(line)).where(
        "next <= rank").isEmpty()


def test_factor_levels(table):
    df = table("uf string", ("SP",), ("AC",), ("SP",), (None,))
    assert rows(factor_levels(df, "uf", "code")) == [("AC", 1), ("SP", 2)]
    assert dict(factor_levels(df, "uf", "code").dtypes)["code"] == "int"


def test_empty_table_and_names(table, frame):
    assert ranked_keys(frame.limit(0), ["x"], ["k"]).count() == 0
    for bad in (lambda: ranked_keys(table("n int", (1,)), ["n"]), lambda: ranked_keys(frame, [])):
        with pytest.raises(ValueError):
            bad()
