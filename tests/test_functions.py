from decimal import Decimal

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ballotcredit import functions as fn


def values(spark, f, cells, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [r[1] for r in rows(df.select("i", f(F.col("c"))), "i")]


def test_fold_accents(spark):
    cells = ["São João d'Oeste", "Ça Œuvre ß Þ", "plain", "São", "Łł ø", None, ""]
    assert values(spark, fn.fold_accents, cells) == [
        "Sao Joao d'Oeste", "Ca OEuvre ss TH", "plain", "Sao", "Ll o", None, ""]


def test_normalize_name(spark):
    cells = ["São João d'Oeste", "SAO JOAO DOESTE", "Mogi-Guaçu 2"]
    assert values(spark, fn.normalize_name, cells) == [
        "SAOJOAODOESTE", "SAOJOAODOESTE", "MOGIGUACU2"]


def test_letters_and_digits_keep_accents(spark):
    assert values(spark, fn.letters_and_digits, ["São João-3!", "№ 5"]) == ["SãoJoão3", "5"]


def test_birth_place_fixes_spelling(spark):
    assert values(spark, fn.birth_place, ["Mazag ão", "Mazagão", None]) == [
        "MAZAGAO", "MAZAGAO", None]


def test_punctuation_keeps_symbols(spark):
    assert values(spark, fn.strip_punctuation, ["a.b-c/d", "+$1,5", "«x»"]) == [
        "abcd", "+$15", "x"]


def test_tax_id(spark):
    cells = ["00.000.000/0001-91", "191", "", "abc", "***", None, "12 "]
    assert values(spark, fn.parse_tax_id, cells) == [191, 191, None, None, None, None, 12]
    assert values(spark, fn.tax_id_digits, cells) == [14, 3, 0, 0, 0, None, 2]


def test_parse_decimal(spark):
    cells = ["1.234,56", "0,5", "-1.000", "", "n/d", None]
    assert values(spark, fn.parse_decimal, cells) == [
        Decimal("1234.56"), Decimal("0.50"), Decimal("-1000.00"), None, None, None]


def test_magnitude(spark):
    cells = [999999.0, 999999.6, 1250000.0, 999999999.0, 1000000000.0, 12250000000.0, None,
             0.0, 1234.5, -5e9, 1.5e9]
    assert values(spark, fn.magnitude, cells, "double") == [
        "999.999", "1,0 mi", "1,2 mi", "1.000,0 mi", "1,0 bi", "12,25 bi", None,
        "0", "1.234", "-5.000.000.000", "1,5 bi"]


def test_three_valued_choice(spark):
    got = values(spark, lambda c: fn.if_else(c > 1, F.lit("a"), F.lit("b")), [2, 1, None], "int")
    assert got == ["a", "b", None]


def test_ratio_without_infinite_values(spark):
    got = values(spark, lambda c: fn.safe_ratio(F.lit(3), c), [2, 0, None], "int")
    assert got == [1.5, None, None]


def test_nan_to_null(spark):
    assert values(spark, fn.nan_to_null, [float("nan"), 1.0], "double") == [None, 1.0]


def test_na_sum(table):
    df = table("k string, x int", ("a", 10), ("a", None), ("b", 10), ("b", 5), ("c", None))
    got = df.groupBy("k").agg(fn.na_sum(F.col("x")).alias("na"),
                              fn.na_sum(F.col("x"), skip_nulls=True).alias("skip"))
    assert rows(got) == [("a", None, 10), ("b", 15, 15), ("c", None, None)]


def test_compound_key_and_label(table):
    df = table("ano int, uf string, e int", (2006, "SP", 0), (2010, None, 1), (2014, "RJ", None))
    got = df.select(fn.compound_key(F.col("ano"), F.col("uf")).alias("k"),
                    fn.label(F.col("e")).alias("l"), "ano")
    assert rows(got, "ano") == [("2006.SP", "Não eleito", 2006), (None, "Eleito", 2010),
                                ("2014.RJ", None, 2014)]


# Estimates, errors and stars as printed.
@pytest.mark.parametrize("estimate,error,marks", [
    (0.767, 0.512, ""), (1.117, 0.633, "+"), (1.216, 0.517, "*"), (1.018, 0.327, "**"),
    (1.296, 0.368, "***"), (-0.430, 0.579, ""), (2.780, 1.316, "*"), (6.029, 3.554, "+"),
    (None, 1.0, None), (1.0, None, None), (1.0, 0.0, "***"),
])
def test_stars(table, estimate, error, marks):
    df = table("e double, s double", (estimate, error))
    assert df.select(fn.stars(F.col("e"), F.col("s"))).first()[0] == marks
