"""The whole study from files to panels, report and result table."""

import pytest
from helpers import rows

from ballotcredit.plans import study
from ballotcredit.sources import readers

PEOPLE = ("id_candidato_bd,ano,tipo_eleicao,cargo,email,municipio_nascimento,sigla_uf,"
          "sigla_uf_nascimento,nome,cpf,situacao,genero,instrucao,estado_civil,nacionalidade,"
          "raca,numero_partido,idade,turno,numero_candidato,sigla_partido\n")
LOANS = "cliente;{}uf;municipio;municipio_codigo;data_da_contratacao;{};valor_desembolsado_reais\n"


def person(ident, number, party, year=2006, name="João"):
    return (f"{ident},{year},o,deputado federal,e@x,Mazag ão,SP,SP,{name},1,deferido,f,s,c,b,p,"
            f"13,40,1,{number},{party}\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("inputs")
    files = {
        "demographics.csv": PEOPLE + "".join(
            person(*p) for p in (("a", 10, "PT"), ("b", 20, "PT"), ("c", 30, "PC"))),
        "voting.csv": ("id_candidato_bd,ano,tipo_eleicao,votos,resultado\n"
                       "a,2006,o,100,eleito\nb,2006,o,40,suplente\nc,2006,o,30,suplente\n"),
        "revenue.csv": (
            "id_candidato_bd,ano,tipo_eleicao,cargo,cpf_cnpj_doador,valor_receita,data_receita,"
            "origem_receita\n"
            # The first row of the file is not the first date: its donor has no loans.
            "a,2006,o,deputado federal,99,5,2006-09-01,recursos de pessoas juridicas\n"
            "a,2006,o,deputado federal,00.000.000/0001-91,5,2006-08-01,"
            "recursos de pessoas juridicas\n"
            "b,2006,o,deputado federal,191,7,2006-08-01,recursos de pessoas juridicas\n"),
        "operacoes-financiamento-operacoes-nao-automaticas.csv": LOANS.format(
            "cnpj;", "valor_contratado_reais") + (
            "BANCO;00.000.000/0001-91;SP;SAO PAULO;1;2007-01-01;1.000,50;10,00\n"
            "BANCO DOIS;191;SP;SAO PAULO;1;2006-01-01;2.000,00;0,5\n"),
        "operacoes-financiamento-operacoes-indiretas-automaticas.csv": LOANS.format(
            "", "valor_da_operacao_em_reais") + "X;SP;SANTOS;2;2008-01-01;5,00;5,00\n",
    }
    for year in (2006, 2010, 2014):
        files[f"cand_mais_votado-brasil_deputado_federal_{year}.csv"] = (
            "sg_uf;nr_candidato;nm_candidato;sg_partido;ds_composicao_coligacao;ds_sit_tot_turno"
            "\nSP;10;JOÃO;PT;PT / PC;ELEITO\nSP;30;Z;PC;PT / PC;SUPLENTE\n")
        files[f"votacao_candidato_mun_{year}.csv"] = (
            "sg_uf,nr_candidato,nm_municipio,qt_votos_nom_validos,sg_partido,"
            "ds_composicao_coligacao,ds_sit_tot_turno\n"
            "SP,10,São Paulo,60,PT,L,E\nSP,20,Santos,40,PT,L,S\nSP,30,Itu,30,PC,L,S\n")
        files[f"votos_por_mun_{year}.csv"] = (
            "Município,UF,Quantidade de votos nominais válidos\nSão Paulo,SP,100\n")
    for name, text in files.items():
        encoding = "latin-1" if name.startswith("cand_mais") else "utf-8"
        (base / name).write_bytes(text.encode(encoding))
    return str(base)


def test_study(spark, folder, tmp_path):
    out = str(tmp_path)
    study.run_study(spark, folder, out)
    # The channels have different columns, so all of them are read with merged schemas.
    written = spark.read.option("mergeSchema", True).parquet(f"{out}/panels")
    cities = written.filter("canal = 'municipios' AND sample = 'all'")
    assert rows(cities.select("id_candidato_bd", "ano", "vote_margin", "total_contratado_base",
                              "is_colig_pt", "elected_label")) == [
        ("a", 2006, 60, 3000.5, 1, "Eleito"), ("b", 2006, -60, 5, 1, "Não eleito"),
        ("c", 2006, -70, 0, 1, "Não eleito")]
    sizes = written.groupBy("canal", "sample").count()
    assert rows(sizes) == [
        ("empresas", "all", 2), ("empresas", "pt", 2), ("empresas", "pt_colig", 2),
        ("municipios", "all", 3), ("municipios", "pt", 2), ("municipios", "pt_colig", 3)]
    firms = written.filter("canal = 'empresas' AND sample = 'all'")
    assert rows(firms.select("id_candidato_bd", "total_bndes_donors_c", "n_clients",
                             "cpf_cnpj_doador", "indic_bndes")) == [
        ("a", 3000.5, 1, 99, 0), ("b", 3000.5, 1, 191, 1)]
    types = {c: "string" for c in ("ano", "total_contratado_Automática",
                                   "total_contratado_Não automática")}
    report = readers.read_delimited(spark, f"{out}/loan_table", types)
    assert rows(report) == [("2006", None, "2.000"), ("2007", None, "1.000"), ("2008", "5", None)]


def test_first_client_is_the_first_in_the_file(spark, folder):
    inputs = study.read_inputs(spark, folder)
    from ballotcredit.operators.donors import donor_loan_totals

    totals = donor_loan_totals(inputs.non_automatic, inputs.revenue, order=study.POSITION)
    assert rows(totals.select("ano", "cnpj", "cliente")) == [(2006, 191, "BANCO")]


def test_birth_place_is_cleaned(spark, folder):
    people = study.read_inputs(spark, folder).candidates()
    assert rows(people.select("municipio_nascimento").distinct()) == [("MAZAGAO",)]


def test_result_table(spark, folder):
    panel = study.panels(study.read_inputs(spark, folder))["municipios"]
    table = study.result_table(panel, "log_c", {"all": [(1, 100), (1, 200)], "pt": [(1, 100)]})
    assert table.columns == ["sample", "line", "label", "(1)", "(2)"]
    counts = table.filter("line = 3").orderBy("sample").collect()
    assert [tuple(r)[3:] for r in counts] == [("[2, 1]", "[2, 1]"), ("[1, 1]", None)]


def test_warehouse_snapshot(spark, tmp_path, table):
    table("id string, ano int", ("a", 2006), ("b", 2010)).createOrReplaceTempView("w_voting")
    study.snapshot_tables(spark, {"voting": "w_voting"}, str(tmp_path))
    got = readers.read_table(spark, f"{tmp_path}/voting")
    assert rows(got.select("id", "ano")) == [("a", 2006), ("b", 2010)]


def test_options_go_to_the_channels_that_know_them(spark, folder, tmp_path):
    out = str(tmp_path)
    study.run_study(spark, folder, out, base_size=3, fold_names=True, match_nulls=False,
                    skip_nulls=True, indicator="any", salts=2)
    written = spark.read.option("mergeSchema", True).parquet(f"{out}/panels")
    firms = written.filter("canal = 'empresas' AND sample = 'all'")
    assert rows(firms.select("id_candidato_bd", "indic_bndes")) == [("a", 1), ("b", 1)]
    with pytest.raises(TypeError, match="unknown options"):
        study.run_study(spark, folder, out, base_sise=3)


def test_plans_read_the_snapshot_of_the_files(spark, folder, tmp_path):
    inputs = study.read_inputs(spark, folder).snapshot(str(tmp_path))
    plan = study.panels(inputs)["municipios"]._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "FileScan csv" not in plan
    loans = inputs.loans()
    assert loans._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2
