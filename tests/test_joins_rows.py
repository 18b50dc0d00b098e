import pytest
from helpers import rows
from pyspark.sql import functions as F

from ballotcredit.operators import joins
from ballotcredit.operators import rows as row_ops


def test_left_column_wins_and_no_suffixes(table):
    left = table("k int, ano int, nome string", (1, 2006, "left"), (2, 2006, None))
    right = table("k int, ano int, nome string, votos int", (1, 2006, "right", 5))
    joined = joins.key_join(left, right, ["k", "ano"])
    assert joined.columns == ["k", "ano", "nome", "votos"]
    assert rows(joined) == [(1, 2006, "left", 5), (2, 2006, None, None)]


@pytest.mark.parametrize("salts", [1, 7])
def test_null_keys_match_only_when_asked(table, salts):
    left = table("id int, donor bigint", (1, None), (2, 5), (3, 6), (4, None))
    right = table("cnpj bigint, total int", (None, 100), (5, 200))
    options = {"spread_by": ["id"], "salts": salts}
    plain = joins.key_join(left, right, {"donor": "cnpj"}, **options)
    safe = joins.key_join(left, right, {"donor": "cnpj"}, match_nulls=["donor"], **options)
    assert rows(plain, "id") == [(1, None, None), (2, 5, 200), (3, 6, None), (4, None, None)]
    assert rows(safe, "id") == [(1, None, 100), (2, 5, 200), (3, 6, None), (4, None, 100)]


def test_salted_join_equals_plain_join_and_fans_out(table):
    left = table("k string, i int", *[("hot", i) for i in range(200)], ("cold", 1), ("no", 1))
    right = table("k string, x int", ("hot", 1), ("hot", 2), ("cold", 3))
    plain = joins.key_join(left, right, ["k"])
    salted = joins.key_join(left, right, ["k"], spread_by=["i"], salts=16)
    assert rows(plain) == rows(salted)
    assert salted.columns == ["k", "i", "x"]


def test_salted_join_spreads_a_hot_key(spark, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "256")
    try:
        left = spark.range(4000).select((F.col("id") % 1).alias("k"), F.col("id").alias("i"))
        right = table("k long, x int", (0, 1), (1, 2))

        def largest(salts):
            joined = joins.key_join(left, right, ["k"], spread_by=["i"], salts=salts)
            sizes = joined.groupBy(F.spark_partition_id()).count().collect()
            return max(r[1] for r in sizes)

        assert largest(1) == 4000
        # A salt holds a sixteenth of the rows; no more than three salts share a task.
        assert largest(16) <= 3 * 4000 / 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_salts_need_columns(table):
    df = table("k int", (1,))
    with pytest.raises(ValueError):
        joins.key_join(df, df, ["k"], salts=4)


def test_semi_join_keeps_rows_once(table):
    loans = table("cnpj bigint, v int", (5, 1), (5, 2), (6, 3), (None, 4))
    donors = table("donor bigint", (5,), (5,), (None,))
    safe = joins.key_semi_join(loans, donors, {"cnpj": "donor"}, match_nulls=["cnpj"])
    plain = joins.key_semi_join(loans, donors, {"cnpj": "donor"})
    assert rows(safe, "v") == [(5, 1), (5, 2), (None, 4)]
    assert rows(plain, "v") == [(5, 1), (5, 2)]


def test_one_to_many_check(table):
    left = table("k int", (1,), (1,), (2,), (3,), (3,))
    right = table("k int, v int", (1, 1), (2, 2))
    assert rows(joins.one_to_many_violations(left, right, ["k"])) == [(1, 2)]
    with pytest.raises(ValueError, match="n_left=2"):
        joins.require_one_to_many(left, right, ["k"])
    joins.require_one_to_many(left.distinct(), right, ["k"])


def test_one_to_many_check_reads_no_right_row_where_no_left_key_repeats(table):
    left = table("k int", (1,), (2,), (None,))
    unread = left.select(F.raise_error(F.lit("a right row was read")).cast("int").alias("k"))
    joins.require_one_to_many(left, unread, ["k"])
    with pytest.raises(Exception, match="a right row was read"):
        joins.require_one_to_many(left.union(left), unread, ["k"])


def test_filter_reaches_both_sides_of_the_join(spark, tmp_path, table):
    for name in ("a", "b"):
        table("id int, ano int", (1, 2006), (1, 2010)).write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")
    joined = joins.key_join(
        a, b.withColumn("x", F.lit(1)), ["id", "ano"], match_nulls=["id"]
    ).filter("ano = 2006")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(ano,2006)") == 2


def test_first_row_per_key(table):
    df = table("k string, o int, v string", ("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"))
    assert rows(row_ops.first_row_per_key(df, ["k"], ["o"])) == [(None, 1, "z"), ("a", 1, "y")]
    plan = row_ops.first_row_per_key(df, ["k"], ["o"])._jdf.queryExecution().executedPlan()
    assert plan.toString().count("WindowGroupLimit") == 2


def test_top_with_ties(table):
    df = table("k int, v double", *[(1, float(v)) for v in (9, 8, 7, 6, 5, 5, 4)], (2, None))
    assert len(rows(row_ops.top_with_ties(df, ["k"], "v", 5))) == 6


def test_column_helpers(table):
    df = table("a int, b_var_x int, c int", (1, 2, 3))
    assert row_ops.keep_columns(df, ["c", "a", "c"]).columns == ["c", "a"]
    assert row_ops.drop_matching(df, "VAR_").columns == ["a", "c"]
    assert row_ops.move_columns(df, ["c"], after="a").columns == ["a", "c", "b_var_x"]
    assert row_ops.move_columns(df, ["c"], before="a").columns == ["c", "a", "b_var_x"]
    assert row_ops.move_columns(df, ["c"]).columns == ["c", "a", "b_var_x"]
    assert rows(row_ops.distinct_on(df.union(df), ["a", "c"])) == [(1, 3)]
