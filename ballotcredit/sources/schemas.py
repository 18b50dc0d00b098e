"""Columns and types of the input files.

Only the columns the study names are listed; the files have more, and readers select by name.
"""

from __future__ import annotations

# Column names as the files spell them. ``decimal`` marks locale-formatted money.
DEMOGRAPHICS = {
    "id_candidato_bd": "string", "ano": "int", "tipo_eleicao": "string", "cargo": "string",
    "email": "string", "municipio_nascimento": "string", "sigla_uf": "string",
    "sigla_uf_nascimento": "string", "nome": "string", "cpf": "string", "situacao": "string",
    "genero": "string", "instrucao": "string", "estado_civil": "string",
    "nacionalidade": "string", "raca": "string", "numero_partido": "int", "idade": "int",
    "turno": "int", "numero_candidato": "int", "sigla_partido": "string",
}
VOTING = {
    "id_candidato_bd": "string", "ano": "int", "tipo_eleicao": "string", "votos": "bigint",
    "resultado": "string",
}
REVENUE = {
    "id_candidato_bd": "string", "ano": "int", "tipo_eleicao": "string", "cargo": "string",
    "cpf_cnpj_doador": "string", "valor_receita": "decimal(18,2)", "data_receita": "date",
    "origem_receita": "string",
}
NON_AUTOMATIC_LOANS = {
    "cliente": "string", "cnpj": "string", "uf": "string", "municipio": "string",
    "municipio_codigo": "bigint", "data_da_contratacao": "date",
    "valor_contratado_reais": "decimal(18,2)", "valor_desembolsado_reais": "decimal(18,2)",
}
AUTOMATIC_LOANS = {
    "cliente": "string", "uf": "string", "municipio": "string", "municipio_codigo": "bigint",
    "data_da_contratacao": "date", "valor_da_operacao_em_reais": "decimal(18,2)",
    "valor_desembolsado_reais": "decimal(18,2)",
}
COALITION = {
    "sg_uf": "string", "nr_candidato": "int", "nm_candidato": "string", "sg_partido": "string",
    "ds_composicao_coligacao": "string", "ds_sit_tot_turno": "string",
}
VOTES_BY_MUNICIPALITY = {
    "sg_uf": "string", "nr_candidato": "int", "nm_municipio": "string",
    "qt_votos_nom_validos": "bigint", "sg_partido": "string",
    "ds_composicao_coligacao": "string", "ds_sit_tot_turno": "string",
}
VALID_VOTES = {
    "Município": "string", "UF": "string", "Quantidade de votos nominais válidos": "bigint",
}
VALID_VOTES_NAMES = {
    "Município": "nm_municipio", "UF": "uf",
    "Quantidade de votos nominais válidos": "qt_votos_mun",
}
