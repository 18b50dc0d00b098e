"""The driver's tables in the roles of the study.

Each role is one SELECT that Spark and the checking engine both run, so only the operators on
top of it are compared. Names in braces are driver tables or other roles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ELECTIONS = (1995, 1997, 1999)
YEARS_AFTER = 2
BASE_SIZE = 3
PARTY = "BUILDING"
STATUSES = {
    1999: ("eleito por qp", "eleito por media"),
    None: ("eleito", "eleito por media"),
}

_PRICE = "cast(l_extendedprice AS decimal(18,2))"
# Some 1997 amounts are unknown.
_CONTRACTED = f"""CASE WHEN l_quantity >= 49 AND l_linestatus = 'O' AND year(l_shipdate) = 1997
        THEN NULL ELSE {_PRICE} END"""
_DISBURSED = f"cast({_PRICE} * (1 - cast(l_discount AS decimal(4,2))) AS decimal(18,4))"
_CLIENT = "concat('Supplier#', lpad(cast(l_suppkey AS string), 9, '0'))"
_ID = "lpad(cast(l_suppkey AS string), 8, '0')"
# Loans carry punctuated ids, some of them unreadable; donations carry digits or 'n/d'.
_LOAN_ID = f"""CASE WHEN l_quantity = 1 AND l_tax = 0 THEN '***' ELSE concat(
        substr({_ID}, 1, 2), '.', substr({_ID}, 3, 3), '.', substr({_ID}, 6, 3), '/0001-91') END"""
_DONOR_ID = f"""CASE WHEN l_returnflag = 'R' AND l_discount = 0 THEN 'n/d'
        ELSE concat({_ID}, '000191') END"""
# A line item's state and municipality: 25 states with 25 municipalities, by part and supplier.
_STATE = "concat('NATION_', l_partkey % 25)"
_PLACE = "concat('NATION_', l_suppkey % 25)"

_CODE = """cast(CASE WHEN l_suppkey % 25 = 0 THEN 0
        ELSE (l_partkey % 25) * 100 + l_suppkey % 25 END AS bigint)"""

ROLES = {
    # Candidates: customers in every year they order.
    "demographics": """
        SELECT cast(c_custkey AS string) AS id_candidato_bd, ano,
            'eleicao ordinaria' AS tipo_eleicao,
            CASE WHEN c_acctbal < -500 THEN 'deputado estadual'
                 ELSE 'deputado federal' END AS cargo,
            concat(c_name, '@example.com') AS email, lower(n_name) AS municipio_nascimento,
            n_name AS sigla_uf, c_mktsegment AS sigla_partido, c_name AS nome,
            CASE WHEN c_acctbal < 500 THEN 'indeferido' WHEN c_acctbal < 5000 THEN 'deferido'
                 ELSE 'deferido com recurso' END AS situacao,
            cast(c_custkey AS int) AS numero_candidato
        FROM (SELECT DISTINCT o_custkey, cast(year(o_orderdate) AS int) AS ano
              FROM {orders}) AS active
            JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    # Results: the value of the year's orders; that of pending orders is unknown.
    "voting": """
        SELECT id_candidato_bd, ano, tipo_eleicao, votos,
            CASE WHEN votos >= 450000 AND ano = 1999 THEN 'eleito por qp'
                 WHEN votos >= 450000 THEN 'eleito' WHEN votos >= 350000 THEN 'eleito por media'
                 ELSE 'suplente' END AS resultado,
            'resultados' AS nome
        FROM (SELECT cast(o_custkey AS string) AS id_candidato_bd,
                  cast(year(o_orderdate) AS int) AS ano, 'eleicao ordinaria' AS tipo_eleicao,
                  cast(sum(CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice) END) AS bigint)
                      AS votos
              FROM {orders} GROUP BY 1, 2, 3) AS yearly""",
    # Votes by municipality: quantities a customer buys per year and municipality.
    "votes": """
        SELECT ano, n_name AS sg_uf, cast(o_custkey AS int) AS nr_candidato,
            concat('nãtion_', place) AS nm_municipio, qt_votos_nom_validos,
            c_mktsegment AS sg_partido, 'turno unico' AS ds_sit_tot_turno
        FROM (SELECT o_custkey, cast(year(o_orderdate) AS int) AS ano, l_suppkey % 25 AS place,
                  cast(sum(l_quantity) AS bigint) AS qt_votos_nom_validos
              FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
              GROUP BY 1, 2, 3) AS bought
            JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    # Valid votes per municipality; one municipality has no name.
    "valid_votes": """
        SELECT ano, sg_uf AS uf, nullif(nm_municipio, 'nãtion_5') AS nm_municipio,
            cast(sum(qt_votos_nom_validos) AS bigint) AS qt_votos_mun
        FROM {votes} GROUP BY ano, sg_uf, nm_municipio""",
    # Loans: line items; some municipalities are written in two ways.
    "loans": f"""
        SELECT {_CLIENT} AS cliente, {_STATE} AS uf,
            CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN lower({_PLACE})
                 ELSE {_PLACE} END AS municipio,
            {_CODE} AS municipio_codigo,
            cast(l_shipdate AS date) AS data_da_contratacao,
            {_CONTRACTED} AS valor_da_operacao_em_reais,
            {_DISBURSED} AS valor_desembolsado_reais
        FROM {{lineitem}}""",
    # The two loan tables with the columns each of them has.
    "non_automatic": f"""
        SELECT {_CLIENT} AS cliente, {_LOAN_ID} AS cnpj, {_STATE} AS uf, {_PLACE} AS municipio,
            {_CODE} AS municipio_codigo,
            cast(l_shipdate AS date) AS data_da_contratacao,
            {_CONTRACTED} AS valor_contratado_reais, {_DISBURSED} AS valor_desembolsado_reais
        FROM {{lineitem}} WHERE l_linestatus = 'O'""",
    "automatic": f"""
        SELECT {_CLIENT} AS cliente, {_STATE} AS uf, {_PLACE} AS municipio,
            {_CODE} AS municipio_codigo, cast(l_shipdate AS date) AS data_da_contratacao,
            {_CONTRACTED} AS valor_da_operacao_em_reais, {_DISBURSED} AS valor_desembolsado_reais
        FROM {{lineitem}} WHERE l_linestatus <> 'O'""",
    # Donations: a customer's line items, given by the supplier.
    "revenue": f"""
        SELECT cast(o_custkey AS string) AS id_candidato_bd,
            cast(year(o_orderdate) AS int) AS ano, 'eleicao ordinaria' AS tipo_eleicao,
            {_DONOR_ID} AS cpf_cnpj_doador,
            CASE WHEN l_tax = 0 THEN NULL
                 ELSE cast({_PRICE} * cast(l_tax AS decimal(4,2)) AS decimal(18,4)) END
                 AS valor_receita,
            cast(o_orderdate AS date) AS data_receita,
            CASE WHEN l_returnflag = 'N' THEN 'recursos de pessoas fisicas'
                 ELSE 'recursos de pessoas juridicas' END AS origem_receita
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    # Coalitions: market segments are parties, some of them joined in some states.
    "coalition": """
        SELECT ano, sigla_uf AS sg_uf, numero_candidato AS nr_candidato, nome AS nm_candidato,
            sigla_partido AS sg_partido,
            CASE WHEN sigla_partido = 'HOUSEHOLD' THEN NULL
                 WHEN sigla_partido = 'BUILDING' AND sigla_uf LIKE '%1' THEN NULL
                 WHEN sigla_partido IN ('BUILDING', 'FURNITURE') THEN 'BUILDING / FURNITURE'
                 WHEN sigla_partido = 'MACHINERY' AND sigla_uf LIKE '%2'
                     THEN 'AUTOMOBILE / MACHINERY'
                 WHEN sigla_partido = 'AUTOMOBILE' AND sigla_uf LIKE '%2'
                     THEN 'AUTOMOBILE / MACHINERY'
                 ELSE sigla_partido END AS ds_composicao_coligacao,
            'turno unico' AS ds_sit_tot_turno
        FROM {demographics}""",
}


class Tables:
    """Driver tables and roles of one folder; each is defined once, so that branches of a plan
    that use the same role can share its shuffles."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in ROLES:
                parts = {part: self[part] for part in _parts(ROLES[name])}
                self._known[name] = self.spark.sql(ROLES[name], **parts)
            else:
                self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._known[name]

    def state(self) -> tuple:
        """Path, length and time of each file of the driver tables that roles are made of."""
        names = {p for text in ROLES.values() for p in _parts(text)} - set(ROLES)
        hadoop, found = self.spark._jvm.org.apache.hadoop.fs, []
        for name in sorted(names):
            path = hadoop.Path(f"{self.folder}/{name}.parquet")
            files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listFiles(path, True)
            while files.hasNext():
                status = files.next()
                found.append((status.getPath().toString(), status.getLen(),
                              status.getModificationTime()))
        return tuple(sorted(found))


def _parts(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def role_ctes(*names: str) -> str:
    """Common table expressions of the roles and what they build on, for the checking SQL."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in ROLES and name not in done:
            parts = _parts(ROLES[name])
            for part in parts:
                add(part)
            done[name] = f"{name} AS ({ROLES[name].format(**{p: p for p in parts})})"

    for name in names:
        add(name)
    return ",\n".join(done.values())
