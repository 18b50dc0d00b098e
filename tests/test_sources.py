from datetime import date
from decimal import Decimal

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ballotcredit.operators.rows import first_row_per_key
from ballotcredit.sources import readers, schemas, sinks


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_loan_file(spark, tmp_path):
    path = write(tmp_path / "loans.csv", (
        "area_operacional;cliente;cnpj;uf;municipio;municipio_codigo;data_da_contratacao;"
        "valor_contratado_reais;valor_desembolsado_reais\n"
        "x;FIRMA \"A\" ;00.000.000/0001-91;SP; São João ;35;2006-05-04;1.234,56;0,5\n"
        "x;B;;SP;;0;04/05/2010;;n/d\n"))
    got = readers.read_loans(spark, path, schemas.NON_AUTOMATIC_LOANS)
    assert rows(got, "uf", "municipio_codigo") == [
        ("B", None, "SP", None, 0, date(2010, 5, 4), None, None),
        ('FIRMA "A"', "00.000.000/0001-91", "SP", "São João", 35, date(2006, 5, 4),
         Decimal("1234.56"), Decimal("0.50"))]


def test_loan_file_without_grouping_mark(spark, tmp_path):
    path = write(tmp_path / "monthly.csv", "ano;valor\n2006; 12,5 \n")
    schema = {"ano": "int", "valor": "decimal(18,2)"}
    got = readers.read_loans(spark, path, schema, grouping_mark="")
    assert rows(got) == [(2006, Decimal("12.50"))]


def test_comma_file_selects_by_name(spark, tmp_path):
    path = write(tmp_path / "voting.csv", (
        "extra,votos,resultado,ano,id_candidato_bd,tipo_eleicao\n"
        '1,10,"eleito, ""x""",2006,c1,o\n1,NA,,2006,c2,o\n1,bad,NA,2006,c3,o\n'))
    assert rows(readers.read_voting(spark, path)) == [
        ("c1", 2006, "o", 10, 'eleito, "x"'), ("c2", 2006, "o", None, None),
        ("c3", 2006, "o", None, None)]


def test_missing_column_raises(spark, tmp_path):
    path = write(tmp_path / "a.csv", "ano\n2006\n")
    with pytest.raises(ValueError, match="votos"):
        readers.read_voting(spark, path)


def test_revenue_is_trimmed(spark, tmp_path):
    path = write(tmp_path / "revenue.csv", (
        "id_candidato_bd,ano,tipo_eleicao,cargo,cpf_cnpj_doador,valor_receita,data_receita,"
        "origem_receita\n"
        "1,2006,o,deputado federal,123,1500.50,2006-08-01,p\n"
        "1,2020,o,deputado federal,123,1,2006-08-01,p\n1,2006,o,senador,123,1,2006-08-01,p\n"))
    got = readers.read_revenue(spark, path)
    assert rows(got.select("valor_receita", "data_receita")) == [
        (Decimal("1500.50"), date(2006, 8, 1))]


def test_latin1_coalitions_by_year(spark, tmp_path):
    header = ("sg_uf;nr_candidato;nm_candidato;x;sg_partido;ds_composicao_coligacao;"
              "ds_sit_tot_turno\n")
    paths = {
        2006: write(tmp_path / "a.csv", header + "SP;10;JOÃO;y;PT;PT / PÇ;ELEITO\n", "latin-1"),
        2010: write(tmp_path / "b.csv", header + "SP;11;É;y;PX;;SUPLENTE\n", "latin-1"),
    }
    got = readers.read_coalitions(spark, paths).select(
        "ano", "nm_candidato", "ds_composicao_coligacao")
    assert rows(got) == [(2006, "JOÃO", "PT / PÇ"), (2010, "É", None)]


def test_municipal_vote_files(spark, tmp_path):
    votes = write(tmp_path / "v.csv", (
        "sg_uf,nr_candidato,nm_municipio,qt_votos_nom_validos,sg_partido,"
        "ds_composicao_coligacao,ds_sit_tot_turno\nSP,10,São João,5,PT,L,ELEITO\n"))
    totals = write(tmp_path / "t.csv", (
        "Município,UF,Quantidade de votos nominais válidos\nSão João,SP,20\n"))
    assert rows(readers.read_municipal_votes(spark, {2006: votes}).select(
        "ano", "nm_municipio", "qt_votos_nom_validos")) == [(2006, "São João", 5)]
    assert rows(readers.read_valid_votes(spark, {2006: totals}).select(
        "ano", "uf", "nm_municipio", "qt_votos_mun")) == [(2006, "SP", "São João", 20)]


def test_row_order_follows_the_file(spark, tmp_path):
    lines = [f"{i % 7},{i}" for i in range(20000)]
    path = write(tmp_path / "big.csv", "k,v\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = readers.read_delimited(spark, path, {"k": "int", "v": "int"}, row_order="row")
        assert df.rdd.getNumPartitions() > 3
        first = first_row_per_key(df, ["k"], ["row"]).select("k", "v")
        assert rows(first) == [(i, i) for i in range(7)]
        last = first_row_per_key(df, ["k"], [F.col("row").desc()]).select("v")
        assert rows(last) == [(v,) for v in range(19993, 20000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_snapshot_prunes_partitions(spark, tmp_path, table):
    df = table("id string, ano int, votos long", ("a", 2006, 1), ("b", 2010, 2), ("c", 2010, 3))
    sinks.snapshot(df, f"{tmp_path}/s")
    got = readers.read_table(spark, f"{tmp_path}/s").filter("ano = 2010")
    assert rows(got.select("id", "ano")) == [("b", 2010), ("c", 2010)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ano" in plan


def test_catalog_table(spark, tmp_path, table):
    table("x int", (1,)).createOrReplaceTempView("catalog_votes")
    assert rows(readers.read_table(spark, "catalog_votes")) == [(1,)]


def test_csv_round_trip(spark, tmp_path, table):
    df = table("a string, b int", ('say "é", ok', 1), (None, None))
    sinks.write_csv(df, f"{tmp_path}/c")
    got = readers.read_delimited(spark, f"{tmp_path}/c", {"a": "string", "b": "int"})
    assert rows(got) == [(None, None), ('say "é", ok', 1)]


def test_panels_of_two_channels_stay_apart(spark, tmp_path, table):
    def panel(*years):
        return table("id string, ano int", *[("x", y) for y in years])
    path = f"{tmp_path}/p"
    sinks.write_panel(panel(2006, 2010), path, "a")
    sinks.write_panel(panel(2006), path, "b")
    sinks.write_panel(panel(2014), path, "a")
    assert rows(spark.read.parquet(path).select("canal", "ano")) == [("a", 2014), ("b", 2006)]


def test_one_election_is_written_again(spark, tmp_path, table):
    def panel(*rows):
        return table("id string, sample string, ano int", *rows)

    def folders():
        return {str(f.relative_to(tmp_path).parent): f.name for f in tmp_path.rglob("*.parquet")}

    path = str(tmp_path / "p q")
    sinks.write_panel(panel(("a", "all", 2006), ("b", "all", 2010), ("b", "pt", 2010)), path, "m")
    first = folders()
    # A new election; rows of other elections are not written.
    sinks.write_panel(panel(("c", "all", 2014), ("c", "pt", 2014), ("x", "all", 2006)), path, "m",
                      elections=[2014])
    got = ["canal", "sample", "ano", "id"]
    assert rows(spark.read.parquet(path).select(*got)) == [
        ("m", "all", 2006, "a"), ("m", "all", 2010, "b"), ("m", "all", 2014, "c"),
        ("m", "pt", 2010, "b"), ("m", "pt", 2014, "c")]
    assert first.items() <= folders().items()
    # Written again, twice: a sample that has no rows any more goes, other elections stay.
    for _ in range(2):
        sinks.write_panel(panel(("d", "all", 2010)), path, "m", elections=[2010])
        assert rows(spark.read.parquet(path).select(*got)) == [
            ("m", "all", 2006, "a"), ("m", "all", 2010, "d"), ("m", "all", 2014, "c"),
            ("m", "pt", 2014, "c")]
    name = "p q/canal=m/sample=all/ano=2006"
    assert folders()[name] == first[name]
    sinks.write_panel(panel(("e", "all", 2018)).limit(0), path, "m", elections=[2014])
    assert rows(spark.read.parquet(path).select("ano")) == [(2006,), (2010,)]


def test_snapshot_of_some_values(spark, tmp_path, table):
    df = table("k string, v int", ("a/b", 1), ("c d", 2), ("é", 3))
    sinks.snapshot(df, f"{tmp_path}/s", ["k"], only={"k": ["a/b", "é"]})
    sinks.snapshot(df.where("v = 3"), f"{tmp_path}/s", ["k"], only={"k": ["a/b", "é", "c d"]})
    assert rows(spark.read.parquet(f"{tmp_path}/s").select("k", "v")) == [("é", 3)]
    for bad in ({}, {"v": [1]}):
        with pytest.raises(ValueError, match="can be replaced"):
            sinks.snapshot(df, f"{tmp_path}/s", ["k"], only=bad)


def test_report(spark, tmp_path, table):
    sinks.write_report(table("ano int, t string", (2006, "1,0 bi")), f"{tmp_path}/r")
    got = readers.read_delimited(spark, f"{tmp_path}/r", {"ano": "int", "t": "string"})
    assert rows(got) == [(2006, "1,0 bi")]


def test_written_table_has_the_same_rows_and_a_short_plan(spark, table):
    df = table("k int, v decimal(18,4)", (1, Decimal("1.5")), (2, None)).groupBy("k").agg(
        F.sum("v").alias("v"))
    kept = sinks.written(df)
    assert kept.schema == df.schema and rows(kept) == rows(df)
    assert "Aggregate" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sinks.work_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text('a,b\n"x\ny",1\n"say ""z""",2\n')
    types = {"a": "string", "b": "int"}
    with pytest.raises(ValueError, match="multi_line"):
        readers.read_delimited(spark, str(path), types)
    got = readers.read_delimited(spark, str(path), types, multi_line=True)
    assert [tuple(r) for r in got.collect()] == [("x\ny", 1), ('say "z"', 2)]
    assert readers.read_delimited(spark, str(path), types, check_quotes=False).count() == 3


def test_work_folder_must_be_named(spark, monkeypatch):
    class Unset:
        conf = {}
        sparkContext = spark.sparkContext

    monkeypatch.setattr(sinks, "_own", {})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sinks.work_folder(Unset)
    sinks.use_work_folder("/shared/folder")
    assert sinks.work_root(Unset).startswith("/shared/folder/ballotcredit-")


def test_row_positions_follow_files(spark, tmp_path):
    for name, cells in (("b", "3\n4"), ("a", "1\n2")):
        (tmp_path / f"{name}.csv").write_text(f"v\n{cells}\n")
    got = readers.read_delimited(spark, str(tmp_path), {"v": "int"}, row_order="p")
    assert [r.v for r in got.orderBy("p").collect()] == [1, 2, 3, 4]
    assert [r.p >> 44 for r in got.orderBy("p").collect()] == [0, 0, 1, 1]
    assert dict(got.dtypes)["p"] == "bigint"
