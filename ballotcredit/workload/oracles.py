"""Checking SQL for the registered queries, over the same roles, in the dialect of DuckDB.

The statements take the direct way (interval joins, windows, row-level residuals, determinants)
where the operators take a distributed one.
"""

from __future__ import annotations

from itertools import permutations

from ballotcredit.workload.queries import (
    BANDWIDTH,
    CUBIC,
    DATE_WINDOWS,
    LINEAR,
    MIXED,
    ROBUST,
    SAMPLES,
    SPECS,
    VOLUME_FROM,
    VOLUME_TO,
)
from ballotcredit.workload.roles import BASE_SIZE, ELECTIONS, PARTY, YEARS_AFTER, role_ctes

YEARS = ", ".join(map(str, ELECTIONS))
ELECTION_ROWS = ", ".join(f"({y})" for y in ELECTIONS)
WON = """CASE WHEN ano = 1999 THEN resultado IN ('eleito por qp', 'eleito por media')
    ELSE resultado IN ('eleito', 'eleito por media') END"""
FROM_LOSER = "resultado IN ('eleito', 'eleito por media')"


def fold(c: str) -> str:
    return f"strip_accents(replace({c}, 'ß', 'ss'))"


def letters(c: str) -> str:
    return rf"regexp_replace({c}, '[^\p{{L}}\p{{Nd}}]', '', 'g')"


def name(c: str) -> str:
    return letters(f"upper({fold(c)})")


def tax_id(c: str) -> str:
    return rf"try_cast(regexp_replace({c}, '\p{{P}}', '', 'g') AS bigint)"


def money(c: str, digits: int = 2) -> str:
    return f"round(cast({c} AS double), {digits}) AS {c}"


def whole_sum(c: str) -> str:
    return f"CASE WHEN count(*) = count({c}) THEN sum({c}) END"


def query(roles: tuple[str, ...], ctes: list[str], body: str) -> str:
    parts = [role_ctes(*roles)] if roles else []
    text = ",\n".join(parts + ctes)
    return f"WITH {text}\n{body}" if text else body


def window_join(source: str, columns: str = "l.*") -> str:
    return f"""SELECT e.ano, {columns} FROM {source} l
        JOIN (VALUES {ELECTION_ROWS}) e(ano) ON l.data_da_contratacao
            BETWEEN make_date(e.ano, 1, 1) AND make_date(e.ano + {YEARS_AFTER}, 12, 31)"""


ALL_LOANS = """all_loans AS (
    SELECT * REPLACE (cast(valor_da_operacao_em_reais AS decimal(18,2))
        AS valor_da_operacao_em_reais) FROM (
    SELECT 'Não automática' AS tipo_op, valor_contratado_reais AS valor_da_operacao_em_reais,
        * EXCLUDE (valor_contratado_reais) FROM non_automatic
    UNION ALL BY NAME SELECT 'Automática' AS tipo_op, * FROM automatic))"""
VOLUME = f"""volume AS (
    SELECT tipo_op, cast(year(data_da_contratacao) AS int) AS ano,
        {whole_sum("valor_da_operacao_em_reais")} AS total_contratado,
        {whole_sum("valor_desembolsado_reais")} AS total_desembolsado,
        count(*) AS n_operacoes, avg(valor_da_operacao_em_reais) AS media_contratado,
        var_samp(cast(valor_da_operacao_em_reais AS double)) AS var_contratado
    FROM all_loans WHERE year(data_da_contratacao) BETWEEN {VOLUME_FROM} AND {VOLUME_TO}
    GROUP BY 1, 2)"""
CANDIDATES = f"""cand AS (
    SELECT d.id_candidato_bd, d.ano, d.nome, {name("d.municipio_nascimento")}
        AS municipio_nascimento, d.sigla_uf, d.sigla_partido, d.situacao, d.numero_candidato,
        v.votos, v.resultado
    FROM demographics d LEFT JOIN voting v ON d.id_candidato_bd = v.id_candidato_bd
        AND d.ano = v.ano AND d.tipo_eleicao = v.tipo_eleicao
    WHERE d.cargo = 'deputado federal' AND d.ano >= 1995)"""
RUNNING = f"running AS (SELECT * FROM cand WHERE ano IN ({YEARS}))"


def municipality_totals(clean, total, source: str = "loans") -> list[str]:
    return [
        f"""located AS (SELECT * REPLACE ({clean("municipio")} AS municipio)
            FROM ({window_join(source)}) WHERE municipio_codigo <> 0)""",
        f"""codes AS (SELECT ano, municipio_codigo,
                {total("valor_da_operacao_em_reais")} AS total_contratado,
                {total("valor_desembolsado_reais")} AS total_desembolsado
            FROM located GROUP BY ALL)""",
        """totals AS (SELECT DISTINCT ano, municipio_codigo, uf, municipio, total_contratado,
                total_desembolsado FROM located JOIN codes USING (ano, municipio_codigo))""",
    ]


BASE = [
    CANDIDATES, RUNNING,
    f"""shares AS (SELECT c.*, v.nm_municipio, {name("v.nm_municipio")} AS municipio,
            v.qt_votos_nom_validos,
            cast(v.qt_votos_nom_validos AS double) / c.votos AS vot_prop_cand
        FROM running c JOIN votes v ON c.ano = v.ano AND c.sigla_uf = v.sg_uf
            AND c.numero_candidato = v.nr_candidato)""",
    f"""base AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY id_candidato_bd, ano
            ORDER BY vot_prop_cand DESC NULLS LAST) AS place FROM shares)
        WHERE place <= {BASE_SIZE} AND vot_prop_cand > 0)""",
]


def base_outcomes(clean=letters, source: str = "loans") -> list[str]:
    return [
        *BASE, *municipality_totals(clean, whole_sum, source),
        """outcomes AS (SELECT id_candidato_bd, ano, any_value(b.sigla_uf) AS sigla_uf,
            any_value(sigla_partido) AS sigla_partido, any_value(votos) AS votos,
            any_value(resultado) AS resultado,
            sum(coalesce(total_contratado, 0)) AS total_contratado_base,
            sum(coalesce(total_desembolsado, 0)) AS total_desembolsado_base,
            ln(1 + cast(sum(coalesce(total_contratado, 0)) AS double)) AS log_c,
            ln(1 + cast(sum(coalesce(total_desembolsado, 0)) AS double)) AS log_d,
            max(vot_prop_cand) AS vot_prop_cand
        FROM base b LEFT JOIN totals t ON b.ano = t.ano AND b.sigla_uf = t.uf
            AND b.municipio = t.municipio
        WHERE situacao IN ('deferido', 'deferido com recurso')
        GROUP BY id_candidato_bd, b.ano)""".replace("id_candidato_bd, ano, any",
                                                    "id_candidato_bd, b.ano, any"),
    ]


OUTCOME_COLUMNS = f"""SELECT id_candidato_bd, ano, sigla_uf, sigla_partido, votos, resultado,
    {money("total_contratado_base")}, {money("total_desembolsado_base", 4)}, {money("log_c", 6)},
    {money("log_d", 6)}, {money("vot_prop_cand", 12)} FROM outcomes"""

GIFTS = f"""gifts AS (SELECT * REPLACE ({tax_id("cpf_cnpj_doador")} AS cpf_cnpj_doador)
    FROM revenue)"""
FIRM_LOANS = f"firm_loans AS (SELECT * REPLACE ({tax_id('cnpj')} AS cnpj) FROM non_automatic)"


def firm_totals(total) -> list[str]:
    return [
        GIFTS, FIRM_LOANS, f"firm_windows AS ({window_join('firm_loans')})",
        f"""sums AS (SELECT ano, cnpj, {total("valor_contratado_reais")} AS total_contratado,
            {total("valor_desembolsado_reais")} AS total_desembolsado
            FROM firm_windows GROUP BY ALL)""",
        """first_loans AS (SELECT ano, cnpj, cliente, uf, municipio FROM (SELECT *,
            row_number() OVER (PARTITION BY ano, cnpj
                ORDER BY data_da_contratacao, cliente, uf, municipio) AS position
            FROM firm_windows) WHERE position = 1)""",
        """firms AS (SELECT s.*, f.cliente, f.uf, f.municipio FROM sums s JOIN first_loans f
                ON s.ano = f.ano AND s.cnpj IS NOT DISTINCT FROM f.cnpj)""",
    ]


def donor_outcomes(total=whole_sum, null_match: bool = True, any_loan: bool = False):
    same = "IS NOT DISTINCT FROM" if null_match else "="
    indicator = "largest" if any_loan else "total_contratado"
    return [
        *firm_totals(total), CANDIDATES, RUNNING,
        f"""given AS (SELECT c.* , g.cpf_cnpj_doador, g.data_receita,
                coalesce(g.valor_receita, 0) AS valor_receita, f.cliente,
                coalesce(f.total_contratado, 0) AS total_contratado,
                coalesce(f.total_desembolsado, 0) AS total_desembolsado
            FROM running c JOIN gifts g ON c.id_candidato_bd = g.id_candidato_bd
                    AND c.ano = g.ano AND g.origem_receita = 'recursos de pessoas juridicas'
                LEFT JOIN firms f ON f.ano = g.ano AND f.cnpj {same} g.cpf_cnpj_doador)""",
        """per_candidate AS (SELECT id_candidato_bd, ano, sum(valor_receita) AS total_donations,
                sum(total_contratado) AS total_bndes_donors_c,
                sum(total_desembolsado) AS total_bndes_donors_d,
                count(DISTINCT cliente) AS n_clients, max(total_contratado) AS largest
            FROM given GROUP BY ALL)""",
        """first_gifts AS (SELECT * FROM (SELECT *, row_number() OVER (
                PARTITION BY id_candidato_bd, ano ORDER BY data_receita,
                cpf_cnpj_doador NULLS FIRST, valor_receita) AS position
            FROM given WHERE situacao IN ('deferido', 'deferido com recurso'))
            WHERE position = 1)""",
        f"""outcomes AS (SELECT p.*, CASE WHEN n_clients = 0 THEN 0 ELSE
                cast(total_bndes_donors_c AS double) / n_clients END AS avg_bndes_donors_c,
                CASE WHEN n_clients = 0 THEN 0 ELSE
                cast(total_bndes_donors_d AS double) / n_clients END AS avg_bndes_donors_d,
                ln(1 + avg_bndes_donors_c) AS log_avg_c, ln(1 + avg_bndes_donors_d) AS log_avg_d,
                g.cpf_cnpj_doador, g.valor_receita, g.data_receita, g.total_contratado,
                CASE WHEN {indicator} > 0 THEN 1 ELSE 0 END AS indic_bndes,
                g.sigla_uf, g.sigla_partido, g.votos, g.resultado
            FROM per_candidate p JOIN first_gifts g USING (id_candidato_bd, ano)
            WHERE total_donations > 0)""",
    ]


DONOR_COLUMNS = f"""SELECT id_candidato_bd, ano, {money("total_donations", 4)},
    {money("total_bndes_donors_c")}, {money("total_bndes_donors_d", 4)}, n_clients,
    avg_bndes_donors_c, avg_bndes_donors_d, {money("log_avg_c", 6)},
    {money("log_avg_d", 6)}, cpf_cnpj_doador, {money("valor_receita", 4)},
    cast(data_receita AS varchar) AS data_receita, {money("total_contratado")}, indic_bndes,
    sigla_uf, sigla_partido, votos FROM outcomes"""


def listed(source: str, filled: bool = True) -> list[str]:
    own = "coalesce(m.colig, c.sigla_partido)" if filled else "m.colig"
    return [
        """lists AS (SELECT DISTINCT ano, sg_uf, sg_partido,
            ds_composicao_coligacao AS colig FROM coalition)""",
        f"""party_lists AS (SELECT DISTINCT ano, sg_uf, colig AS colig_pt FROM lists
            WHERE sg_partido = '{PARTY}' AND colig IS NOT NULL)""",
        f"""listed AS (SELECT c.*, coalesce(m.colig, c.sigla_partido) AS colig, p.colig_pt,
                CASE WHEN {own} = p.colig_pt THEN 1 WHEN {own} <> p.colig_pt THEN 0 END
                    AS is_colig_pt
            FROM {source} c
                LEFT JOIN lists m ON c.ano = m.ano AND c.sigla_uf = m.sg_uf
                    AND c.sigla_partido = m.sg_partido
                LEFT JOIN party_lists p ON c.ano = p.ano AND c.sigla_uf = p.sg_uf)""",
    ]


LISTED_COLUMNS = """id_candidato_bd, ano, sigla_uf, sigla_partido, resultado, votos, colig,
    colig_pt, is_colig_pt"""


def margins(from_loser: str = FROM_LOSER) -> list[str]:
    return [
        f"""thresholds AS (SELECT *, {WON} AS won,
            min(CASE WHEN {WON} THEN votos END) OVER list AS min_votos_win,
            max(CASE WHEN NOT ({WON}) THEN votos END) OVER list AS max_votos_loss
            FROM listed WINDOW list AS (PARTITION BY ano, sigla_uf, colig))""",
        f"""measured AS (SELECT *, CASE WHEN won THEN 1 WHEN NOT won THEN 0 END AS elected,
            CASE WHEN {from_loser} THEN votos - max_votos_loss
                 WHEN NOT ({from_loser}) THEN votos - min_votos_win END AS vote_margin,
            abs(vote_margin) AS abs_vote_margin
            FROM thresholds WHERE min_votos_win IS NOT NULL)""",
        """panel AS (SELECT *, ano || '.' || sigla_uf || '.' || colig AS factor_cluster,
            sigla_uf AS factor_uf FROM measured WHERE abs_vote_margin <> 0)""",
    ]


MARGIN_COLUMNS = "elected, min_votos_win, max_votos_loss, vote_margin, abs_vote_margin"


def panel_columns(outcomes) -> str:
    logs = ", ".join(money(c, 6) for c in outcomes)
    return f"""SELECT id_candidato_bd, ano, sigla_uf, sigla_partido, colig, is_colig_pt, votos,
        {MARGIN_COLUMNS}, {logs}, factor_cluster, factor_uf FROM panel"""


MUNICIPALITY_ROLES = ("demographics", "voting", "votes", "loans", "coalition")
FIRM_ROLES = ("demographics", "voting", "revenue", "non_automatic", "coalition")
MUNICIPALITY_PANEL = [*base_outcomes(), *listed("outcomes"), *margins()]
FIRM_PANEL = [*donor_outcomes(), *listed("outcomes", filled=False), *margins()]


def sample_filter(sample: str) -> str:
    kind, _, year = sample.rpartition("_")
    if not year.isdigit():
        kind, year = sample, None
    condition = {
        "all": "true", "reg": f"abs_vote_margin <= {BANDWIDTH}",
        "pt": f"sigla_partido = '{PARTY}'", "pt_colig": "is_colig_pt = 1",
    }[kind]
    return condition if year is None else f"{condition} AND ano = {year}"


def samples(names=SAMPLES) -> str:
    union = " UNION ALL ".join(
        f"SELECT '{s}' AS sample, * FROM panel WHERE {sample_filter(s)}" for s in names
    )
    return f"samples AS ({union})"


# --- regression discontinuity: solved by determinants, residuals taken row by row ---------------

def determinant(matrix: list[list[str]]) -> str:
    size = range(len(matrix))
    terms = []
    for order in permutations(size):
        swaps = sum(order[i] > order[j] for i in size for j in size if i < j)
        terms.append(("-" if swaps % 2 else "+") + "*".join(matrix[i][order[i]] for i in size))
    return "(" + " ".join(terms) + ")"


def cramer(degree: int, right: list[str]) -> list[str]:
    size = range(degree + 1)
    system = [[f"s{i + j}" for j in size] for i in size]
    whole = determinant(system)
    solutions = []
    for k in size:
        swapped = [[right[i] if j == k else system[i][j] for j in size] for i in size]
        solutions.append(f"{determinant(swapped)} / {whole}")
    return solutions


def rd_ctes(outcome: str, specs) -> list[str]:
    rows = ", ".join(
        f"('{s}', {number}, {degree}, cast({width} AS double))"
        for s, number, degree, width in specs
    )
    ctes = [
        samples(),
        f"specs AS (SELECT * FROM (VALUES {rows}) v(sample, spec, degree, bandwidth))",
        f"""inside AS (SELECT sample, spec, degree, bandwidth, factor_cluster,
                vote_margin >= 0 AS is_right, vote_margin / bandwidth AS x,
                1 - abs(vote_margin) / bandwidth AS w, {outcome} AS y
            FROM samples JOIN specs USING (sample) WHERE abs(vote_margin) <= bandwidth)""",
    ]
    fits = []
    for degree in sorted({s[2] for s in specs}):
        size = range(degree + 1)
        powers = ", ".join(f"sum(w * x**{j}) AS s{j}" for j in range(2 * degree + 1))
        crossed = ", ".join(f"sum(w * x**{j} * y) AS t{j}" for j in size)
        ctes.append(f"""moments{degree} AS (SELECT sample, spec, degree, bandwidth, is_right,
                count(DISTINCT CASE WHEN w > 0 THEN x END) AS points, {powers}, {crossed}
            FROM inside WHERE degree = {degree} GROUP BY ALL)""")
        solved = [
            *[f"CASE WHEN points > {degree} THEN {c} END AS b{k}"
              for k, c in enumerate(cramer(degree, [f"t{i}" for i in size]))],
            *[f"CASE WHEN points > {degree} THEN {c} END AS a{k}"
              for k, c in enumerate(cramer(degree, ["1" if i == 0 else "0" for i in size]))],
        ]
        padding = [f"0 AS {v}{k}" for v in "ba" for k in range(degree + 1, 4)]
        ctes.append(f"""fit{degree} AS (SELECT sample, spec, degree, bandwidth, is_right,
            {', '.join(solved + padding)} FROM moments{degree})""")
        fits.append(f"SELECT * FROM fit{degree}")
    ctes.append(f"fits AS ({' UNION ALL BY NAME '.join(fits)})")
    ctes.append("""scores AS (SELECT sample, spec, is_right, factor_cluster, count(*) AS n,
            sum(w * (a0 + a1 * x + a2 * x**2 + a3 * x**3)
                * (y - b0 - b1 * x - b2 * x**2 - b3 * x**3)) AS score
        FROM inside JOIN fits USING (sample, spec, degree, bandwidth, is_right)
        GROUP BY ALL)""")
    ctes.append("""variances AS (SELECT sample, spec, is_right, sum(n) AS n,
            CASE WHEN count(*) = count(score) THEN sum(score * score) END AS variance
        FROM scores GROUP BY ALL)""")
    ctes.append("""grid AS (SELECT sample, spec, degree, bandwidth,
            max(CASE WHEN NOT is_right THEN b0 END) AS intercept_left,
            max(CASE WHEN is_right THEN b0 END) AS intercept_right,
            intercept_right - intercept_left AS estimate,
            sqrt(max(CASE WHEN NOT is_right THEN variance END)
                + max(CASE WHEN is_right THEN variance END)) AS std_error,
            cast(coalesce(sum(CASE WHEN NOT is_right THEN n END), 0) AS bigint) AS n_left,
            cast(coalesce(sum(CASE WHEN is_right THEN n END), 0) AS bigint) AS n_right
        FROM fits LEFT JOIN variances USING (sample, spec, is_right)
        GROUP BY sample, spec, degree, bandwidth)""")
    ctes.append("""starred AS (SELECT *, CASE WHEN estimate IS NULL OR std_error IS NULL THEN NULL
            WHEN abs(estimate) > 3.290527 * std_error THEN '***'
            WHEN abs(estimate) > 2.575829 * std_error THEN '**'
            WHEN abs(estimate) > 1.959964 * std_error THEN '*'
            WHEN abs(estimate) > 1.644854 * std_error THEN '+' ELSE '' END AS stars FROM grid)""")
    return ctes


def robust_ctes(outcome: str, specs, matches: int) -> list[str]:
    """Order 1 with a pilot of order 2; neighbours by all pairs of margins of a side."""
    rows = ", ".join(
        f"('{s}', {number}, {degree}, cast({width} AS double), cast({pilot} AS double))"
        for s, number, degree, width, pilot in specs
    )
    side = "sample, spec, degree, bandwidth, pilot, is_right"

    def moments(name: str, weight: str, top: int) -> str:
        sums = ", ".join([f"sum({weight} * x**{m}) AS s{m}" for m in range(2 * top + 2)]
                         + [f"sum({weight} * x**{j} * y) AS t{j}" for j in range(top + 1)])
        return f"{name} AS (SELECT {side}, {sums} FROM inside GROUP BY ALL)"

    def solved(name: str, top: int, unit: int) -> str:
        return ", ".join(f"{c} AS {name}{k}" for k, c in enumerate(
            cramer(top, ["1" if i == unit else "0" for i in range(top + 1)])))

    def coefficients(name: str, top: int) -> str:
        return ", ".join(f"{c} AS {name}{k}" for k, c in enumerate(
            cramer(top, [f"t{i}" for i in range(top + 1)])))

    def jump(c: str) -> str:
        return f"max(CASE WHEN is_right THEN {c} END) - max(CASE WHEN NOT is_right THEN {c} END)"

    def error(c: str) -> str:
        return (f"sqrt(max(CASE WHEN is_right THEN {c} END) "
                f"+ max(CASE WHEN NOT is_right THEN {c} END))")

    def grid(name: str, source: str) -> str:
        return f"""{name} AS (SELECT sample, spec, degree, bandwidth, pilot,
                {jump('b0')} AS estimate, {jump('b0 - kappa * q2')} AS estimate_bc,
                {error('plain')} AS std_error, {error('robust')} AS robust_error,
                cast(coalesce(sum(n) FILTER (NOT is_right), 0) AS bigint) AS n_left,
                cast(coalesce(sum(n) FILTER (is_right), 0) AS bigint) AS n_right
            FROM fits JOIN {source} USING ({side}) JOIN counts USING ({side}) GROUP BY ALL)"""

    pulls = "w * (a0 + a1 * x)", "w * (a0 + a1 * x) - kappa * g * (c0 + c1 * x + c2 * x**2)"
    return [
        samples(),
        f"specs AS (SELECT * FROM (VALUES {rows}) v(sample, spec, degree, bandwidth, pilot))",
        f"""inside AS (SELECT sample, spec, degree, bandwidth, pilot, factor_cluster, vote_margin,
                vote_margin >= 0 AS is_right, vote_margin / greatest(bandwidth, pilot) AS x,
                greatest(1 - abs(vote_margin) / bandwidth, 0) AS w,
                greatest(1 - abs(vote_margin) / pilot, 0) AS g, {outcome} AS y
            FROM samples JOIN specs USING (sample)
            WHERE abs(vote_margin) <= greatest(bandwidth, pilot) AND {outcome} IS NOT NULL)""",
        f"""counts AS (SELECT {side}, count(*) FILTER (abs(vote_margin) <= bandwidth) AS n
            FROM inside GROUP BY ALL)""",
        moments("low", "w", 1), moments("high", "g", 2),
        f"""low_fit AS (SELECT {side}, {coefficients('b', 1)}, a0, a1, a0 * s2 + a1 * s3 AS kappa
            FROM (SELECT *, {solved('a', 1, 0)} FROM low))""",
        f"high_fit AS (SELECT {side}, {coefficients('q', 2)}, {solved('c', 2, 2)} FROM high)",
        f"fits AS (SELECT * FROM low_fit JOIN high_fit USING ({side}))",
        f"""scores AS (SELECT {side}, factor_cluster,
                sum(({pulls[0]}) * (y - b0 - b1 * x)) AS plain,
                sum(({pulls[1]}) * (y - q0 - q1 * x - q2 * x**2)) AS robust
            FROM inside JOIN fits USING ({side}) GROUP BY ALL)""",
        f"""clustered AS (SELECT {side}, sum(plain * plain) AS plain, sum(robust * robust) AS robust
            FROM scores GROUP BY ALL)""",
        f"""margins AS (SELECT {side}, vote_margin, count(*) AS m, sum(y) AS total
            FROM inside GROUP BY ALL)""",
        f"""met AS (SELECT {side}, a.vote_margin, b.m, b.total,
                abs(a.vote_margin - b.vote_margin) AS far,
                sum(b.m) OVER near - sum(b.m) OVER tied AS nearer
            FROM margins a JOIN margins b USING ({side})
            WINDOW near AS (PARTITION BY {side}, a.vote_margin
                    ORDER BY abs(a.vote_margin - b.vote_margin)),
                tied AS (PARTITION BY {side}, a.vote_margin, abs(a.vote_margin - b.vote_margin)))""",
        f"""close AS (SELECT {side}, vote_margin, sum(m) - 1 AS j, sum(total) AS total
            FROM met WHERE far = 0 OR nearer - 1 < {matches} GROUP BY ALL)""",
        f"""near AS (SELECT {side}, sum(({pulls[0]})**2 * v) AS plain, sum(({pulls[1]})**2 * v) AS robust
            FROM (SELECT *, j / (j + 1) * (y - (total - y) / j)**2 AS v
                FROM inside JOIN fits USING ({side}) JOIN close USING ({side}, vote_margin))
            GROUP BY ALL)""",
        grid("clustered_grid", "clustered"), grid("near_grid", "near"),
    ]


def bandwidth_ctes(outcome: str) -> list[str]:
    """The plug-in rule: cubics of whole sides, then quadratics of their windows."""
    def sums(width: str, top: int) -> str:
        return ", ".join([f"sum((d / {width})**{m}) AS s{m}" for m in range(2 * top + 1)]
                         + [f"sum((d / {width})**{j} * y) AS t{j}" for j in range(top + 1)])

    third, curve = (cramer(top, [f"t{i}" for i in range(top + 1)])[top] for top in (3, 2))
    return [
        samples(),
        f"""points AS (SELECT sample, vote_margin >= 0 AS is_right, {outcome} AS y,
                cast(vote_margin AS double) AS x, abs(cast(vote_margin AS double)) AS d
            FROM samples WHERE {outcome} IS NOT NULL AND vote_margin IS NOT NULL)""",
        """spread AS (SELECT sample, count(*) AS n, 1.84 * stddev_samp(x) * count(*)**(-0.2) AS h
            FROM points GROUP BY sample)""",
        "reaches AS (SELECT sample, is_right, max(d) AS reach FROM points GROUP BY ALL)",
        f"""sides AS (SELECT sample, is_right, n, h, reach, count(*) AS m,
                count(*) FILTER (d <= h) AS near, var_samp(y) FILTER (d <= h) AS noise,
                {sums("reach", 3)}
            FROM points JOIN spread USING (sample) JOIN reaches USING (sample, is_right)
            GROUP BY ALL)""",
        """densities AS (SELECT sample, sum(near) / (2 * any_value(n) * any_value(h)) AS density
            FROM sides GROUP BY sample)""",
        f"""windows AS (SELECT sample, is_right, m, n, noise, density, least(reach,
                3.56 * (noise / (density * third * third))**(1 / 7) * m**(-1 / 7)) AS wide
            FROM (SELECT *, 6 * {third} / reach**3 AS third FROM sides)
                JOIN densities USING (sample))""",
        f"""bends AS (SELECT sample, is_right, wide, count(*) AS inside, {sums("wide", 2)}
            FROM points JOIN windows USING (sample, is_right) WHERE d <= wide GROUP BY ALL)""",
        f"""ruled AS (SELECT sample, is_right, m, n, noise, density,
                2 * {curve} / wide**2 AS bend, 2160 * noise / (inside * wide**4) AS regular
            FROM bends JOIN windows USING (sample, is_right, wide))""",
    ]


def rd(specs, body: str, outcome: str = "log_c") -> str:
    return query(MUNICIPALITY_ROLES, [*MUNICIPALITY_PANEL, *rd_ctes(outcome, specs)], body)


PANELS = (("municipios", MUNICIPALITY_ROLES, MUNICIPALITY_PANEL),
          ("empresas", FIRM_ROLES, FIRM_PANEL))


def robust(grid: str) -> str:
    return query(MUNICIPALITY_ROLES, [*MUNICIPALITY_PANEL, *robust_ctes("log_c", ROBUST, 3)], f"""
        SELECT sample, spec, degree, bandwidth, pilot, {money("estimate", 5)},
            {money("estimate_bc", 5)}, {money("std_error", 5)}, {money("robust_error", 5)},
            n_left, n_right FROM {grid}""")


GRID_COLUMNS = f"""SELECT sample, spec, {money("estimate", 4)}, stars, {money("std_error", 4)},
    n_left, n_right, bandwidth, degree AS "order", 'Triangular' AS kernel FROM starred"""


def magnitude(c: str) -> str:
    text = f"""CASE WHEN {c} > 999999999
            THEN regexp_replace(format('{{:,.2f}}', {c} / 1e9), '0$', '') || ' bi'
        WHEN {c} > 999999 THEN format('{{:,.1f}}', {c} / 1e6) || ' mi'
        ELSE format('{{:,.0f}}', {c}) END"""
    return f"translate({text}, ',.', '.,')"


TYPES = (("Automática", "aut"), ("Não automática", "nao_aut"))


def _of_type(measure: str, label: str) -> str:
    return f"max(CASE WHEN tipo_op = '{label}' THEN cast({measure} AS double) END)"


def _wide_table() -> str:
    columns = ", ".join(
        f"{magnitude(_of_type(m, label))} AS {m}_{short}"
        for m in ("total_contratado", "media_contratado", "n_operacoes")
        for label, short in TYPES
    )
    return f"SELECT ano, {columns} FROM volume GROUP BY ano"


def _wide_measures() -> str:
    columns = ", ".join(
        f"round({_of_type(m, label)}, 4) AS {m}_{short}"
        for m in ("total_desembolsado", "n_operacoes") for label, short in TYPES
    )
    return f"SELECT ano, {columns} FROM volume GROUP BY ano"


LOAN_TABLES = ("non_automatic", "automatic")
BASE_ROLES = ("demographics", "voting", "votes")
LIST_ROLES = ("demographics", "voting", "coalition")
LISTED = [CANDIDATES, RUNNING, *listed("running")]
TOTAL_COLUMNS = f"""SELECT ano, municipio_codigo, uf, municipio, {money("total_contratado")},
    {money("total_desembolsado", 4)} FROM totals"""


def plain_sum(c: str) -> str:
    return f"sum({c})"


def _layout() -> str:
    lines = (
        ("LATE", "format('{:.3f}', estimate) || stars"),
        ("", "'(' || format('{:.3f}', std_error) || ')'"),
        ("", "'[' || n_left || ', ' || n_right || ']'"),
        ("Banda", "format('{:.0f}', bandwidth)"),
        ("Ordem", "cast(degree AS varchar)"),
        ("Kernel", "'Triangular'"),
    )
    union = " UNION ALL ".join(
        f"SELECT sample, {i} AS line, '{label}' AS label, spec, {text} AS text FROM starred"
        for i, (label, text) in enumerate(lines, start=1)
    )
    columns = ", ".join(f"max(CASE WHEN spec = {i} THEN text END) AS spec_{i}" for i in range(1, 5))
    return f"SELECT sample, line, label, {columns} FROM ({union}) GROUP BY sample, line, label"


ORACLES = {
    "loan_volume_by_type_year": query(LOAN_TABLES, [ALL_LOANS, VOLUME], f"""
        SELECT tipo_op, ano, {money("total_contratado")}, {money("total_desembolsado", 4)},
            n_operacoes, {money("media_contratado")},
            round(var_contratado / 1e6, 3) AS var_contratado_mi FROM volume"""),
    "loan_table_wide": query(LOAN_TABLES, [ALL_LOANS, VOLUME], _wide_table()),
    "report_file_scan": query(LOAN_TABLES, [ALL_LOANS, VOLUME], _wide_table()),
    "loan_measures_wide": query(LOAN_TABLES, [ALL_LOANS, VOLUME], _wide_measures()),
    "loan_types_found": query(LOAN_TABLES, [ALL_LOANS, f"""typed AS (
            SELECT *, CASE WHEN month(data_da_contratacao) % 3 = 0 THEN '{MIXED}' ELSE tipo_op END
                AS kind, cast(year(data_da_contratacao) AS int) AS ano
            FROM all_loans
            WHERE year(data_da_contratacao) BETWEEN {VOLUME_FROM} AND {VOLUME_TO})"""],
        "SELECT ano, " + ", ".join(
            f"""cast(nullif(count(*) FILTER (kind = '{kind}'), 0) AS double) AS n_operacoes_{short},
            CASE WHEN count(*) FILTER (kind = '{kind}')
                = count(valor_desembolsado_reais) FILTER (kind = '{kind}')
            THEN round(cast(sum(valor_desembolsado_reais) FILTER (kind = '{kind}') AS double), 4)
            END AS total_desembolsado_{short}"""
            for kind, short in (("Automática", "aut"), ("Não automática", "nao_aut"),
                                (MIXED, "mista"))) + " FROM typed GROUP BY ano"),
    "loans_in_date_windows": query(("non_automatic",), [], f"""
        SELECT w.ano, cliente, cast(data_da_contratacao AS varchar) AS data,
            {money("valor_desembolsado_reais", 4)}
        FROM non_automatic JOIN (VALUES {', '.join(
            f"({n}, DATE '{a}', DATE '{b}')" for n, a, b in DATE_WINDOWS)}) w(ano, a, b)
            ON data_da_contratacao BETWEEN w.a AND w.b"""),
    "loans_union_types": query(LOAN_TABLES, [ALL_LOANS], f"""
        SELECT tipo_op, cliente, cnpj, uf,
            cast(data_da_contratacao AS varchar) AS data_da_contratacao,
            {money("valor_da_operacao_em_reais")}, {money("valor_desembolsado_reais", 4)}
        FROM all_loans"""),
    "loans_in_election_window": query(
        ("non_automatic",), [f"windows AS ({window_join('non_automatic')})"], f"""
        SELECT ano, cliente, cast(data_da_contratacao AS varchar) AS data,
            {money("valor_desembolsado_reais", 4)} FROM windows"""),
    "municipality_loan_totals": query(
        ("loans",), municipality_totals(letters, whole_sum), TOTAL_COLUMNS),
    "municipality_loan_totals_folded": query(
        ("loans",), municipality_totals(name, plain_sum), TOTAL_COLUMNS),
    "na_sum_injected": """
        SELECT l_partkey,
            round(cast(CASE WHEN count(*) = count(amount) THEN sum(amount) END AS double), 2)
                AS na_total,
            round(cast(sum(amount) AS double), 2) AS total
        FROM (SELECT l_partkey, CASE WHEN l_quantity <> 50
                  THEN cast(l_extendedprice AS decimal(18,2)) END AS amount FROM lineitem)
        GROUP BY l_partkey""",
    "normalized_names": f"""
        SELECT doc_id, {fold("text")} AS folded, {name("text")} AS name,
            {letters("text")} AS letters FROM documents""",
    "normalized_turns": f"""
        SELECT conv_id, turn, role, {name("text")} AS name FROM conversations""",
    "stripped_punctuation": r"""
        SELECT doc_id, regexp_replace(text, '\p{P}', '', 'g') AS plain FROM documents""",
    "tax_id_parse": query(("non_automatic",), [], rf"""
        SELECT cnpj, {tax_id("cnpj")} AS id,
            cast(length(regexp_replace(cnpj, '[^0-9]', '', 'g')) AS int) AS digits
        FROM non_automatic"""),
    "decimal_comma_parse": """
        SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 1 THEN 'n/d' ELSE
                translate(format('{:,.2f}', l_extendedprice), ',.', '.,') END AS text,
            CASE WHEN l_quantity <> 1 THEN round(l_extendedprice, 2) END AS amount
        FROM lineitem""",
    "magnitude_text": f"""
        SELECT o_orderkey, {magnitude("x")} AS text FROM (SELECT o_orderkey,
            floor(o_totalprice) * CASE o_orderpriority WHEN '1-URGENT' THEN 100000
                WHEN '2-HIGH' THEN 100 ELSE 1 END AS x FROM orders)""",
    "candidate_frame": query(("demographics", "voting"), [CANDIDATES], """
        SELECT id_candidato_bd, ano, nome, municipio_nascimento, sigla_uf, sigla_partido,
            situacao, votos, resultado FROM cand"""),
    "one_to_many_violations": """
        SELECT l_orderkey AS key, count(*) AS n_left FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
        GROUP BY l_orderkey HAVING count(*) > 1""",
    "null_safe_left_join": query(("revenue", "non_automatic"), [GIFTS, FIRM_LOANS], f"""
        SELECT id_candidato_bd, ano, cpf_cnpj_doador, n_loans, {money("disbursed")}
        FROM gifts LEFT JOIN (SELECT cnpj, count(*) AS n_loans,
                sum(valor_desembolsado_reais) AS disbursed FROM firm_loans GROUP BY cnpj) f
            ON cpf_cnpj_doador IS NOT DISTINCT FROM cnpj"""),
    "null_safe_semi_join": query(("revenue", "non_automatic"), [GIFTS, FIRM_LOANS], """
        SELECT cnpj, count(*) AS n_loans FROM firm_loans WHERE EXISTS (SELECT 1 FROM gifts
            WHERE cpf_cnpj_doador IS NOT DISTINCT FROM cnpj)
        GROUP BY cnpj"""),
    "first_row_per_candidate": query(("revenue",), [GIFTS], f"""
        SELECT id_candidato_bd, ano, cast(data_receita AS varchar) AS data_receita,
            cpf_cnpj_doador, {money("valor_receita", 4)} FROM (SELECT *, row_number() OVER (
                PARTITION BY id_candidato_bd, ano ORDER BY data_receita,
                cpf_cnpj_doador NULLS FIRST, valor_receita DESC NULLS LAST) AS position FROM gifts)
        WHERE position = 1"""),
    "municipal_vote_share": query(("votes", "valid_votes"), [], f"""
        SELECT v.ano, v.sg_uf, v.nr_candidato, {name("v.nm_municipio")} AS municipio,
            v.qt_votos_nom_validos, t.qt_votos_mun,
            round(cast(v.qt_votos_nom_validos AS double) / t.qt_votos_mun, 9) AS vot_prop_mun
        FROM votes v LEFT JOIN valid_votes t ON v.ano = t.ano AND v.sg_uf = t.uf
            AND v.nm_municipio = t.nm_municipio"""),
    "electoral_base_topk": query(BASE_ROLES, BASE, f"""
        SELECT id_candidato_bd, ano, sigla_uf, municipio, qt_votos_nom_validos, votos,
            {money("vot_prop_cand", 12)} FROM base"""),
    "base_loan_outcomes": query((*BASE_ROLES, "loans"), base_outcomes(), OUTCOME_COLUMNS),
    "base_loan_outcomes_folded": query(
        (*BASE_ROLES, "loans"), base_outcomes(name), OUTCOME_COLUMNS),
    "donor_loan_totals": query(
        FIRM_ROLES[:4], [*firm_totals(whole_sum), CANDIDATES, RUNNING, """
        donors AS (SELECT DISTINCT c.ano, g.cpf_cnpj_doador FROM running c
            LEFT JOIN gifts g ON c.id_candidato_bd = g.id_candidato_bd AND c.ano = g.ano)"""], f"""
        SELECT ano, cnpj, cliente, uf, municipio, {money("total_contratado")},
            {money("total_desembolsado", 4)} FROM firms f
        WHERE EXISTS (SELECT 1 FROM donors d WHERE d.ano = f.ano
            AND d.cpf_cnpj_doador IS NOT DISTINCT FROM f.cnpj)"""),
    "donor_loan_outcomes": query(FIRM_ROLES[:4], donor_outcomes(), DONOR_COLUMNS),
    "donor_loan_outcomes_any": query(
        FIRM_ROLES[:4], donor_outcomes(plain_sum, null_match=False, any_loan=True),
        DONOR_COLUMNS),
    "coalition_map": query(("coalition",), [], """
        SELECT DISTINCT ano, sg_uf, sg_partido, ds_composicao_coligacao AS colig
        FROM coalition"""),
    "party_coalition_flag": query(LIST_ROLES, LISTED, f"SELECT {LISTED_COLUMNS} FROM listed"),
    "party_coalition_flag_unfilled": query(
        LIST_ROLES, [CANDIDATES, RUNNING, *listed("running", filled=False)],
        f"SELECT {LISTED_COLUMNS} FROM listed"),
    "vote_margin": query(
        LIST_ROLES, [*LISTED, *margins()],
        f"SELECT {LISTED_COLUMNS}, {MARGIN_COLUMNS} FROM panel"),
    "vote_margin_consistent": query(
        LIST_ROLES, [*LISTED, *margins("won")],
        f"SELECT {LISTED_COLUMNS}, {MARGIN_COLUMNS} FROM measured"),
    "pooled_panel": query(
        MUNICIPALITY_ROLES, MUNICIPALITY_PANEL, panel_columns(("log_c", "log_d"))),
    "pooled_panel_firms": query(
        FIRM_ROLES, FIRM_PANEL, panel_columns(("log_avg_c", "log_avg_d"))),
    "panel_subsamples": query(
        MUNICIPALITY_ROLES, [*MUNICIPALITY_PANEL, samples((*SAMPLES, "reg"))], """
        SELECT sample, id_candidato_bd, ano, elected,
            CASE elected WHEN 0 THEN 'Não eleito' WHEN 1 THEN 'Eleito' END AS elected_label,
            vote_margin FROM samples"""),
    "panel_in_reading_order": query(MUNICIPALITY_ROLES, MUNICIPALITY_PANEL, """
        SELECT ano, colig, votos, id_candidato_bd, vote_margin, rank() OVER (PARTITION BY ano
            ORDER BY colig NULLS FIRST, votos NULLS FIRST) AS position FROM panel"""),
    "state_factor": query(LIST_ROLES, LISTED, """
        SELECT sigla_uf, cast(dense_rank() OVER (ORDER BY sigla_uf) AS int) AS code,
            count(*) AS n FROM listed GROUP BY sigla_uf"""),
    "rd_effective_counts": rd(SPECS, """
        SELECT sample, spec, degree, bandwidth, count(*) FILTER (NOT is_right) AS n_left,
            count(*) FILTER (is_right) AS n_right FROM inside GROUP BY ALL"""),
    "rd_local_linear": rd(LINEAR, f"""
        SELECT sample, spec, degree, bandwidth, {money("intercept_left", 5)},
            {money("intercept_right", 5)}, {money("estimate", 5)} FROM grid"""),
    "rd_local_cubic": rd(CUBIC, f"""
        SELECT sample, spec, degree, bandwidth, {money("intercept_left", 4)},
            {money("intercept_right", 4)}, {money("estimate", 4)} FROM grid"""),
    "rd_std_error": rd(LINEAR, f"""
        SELECT sample, spec, degree, bandwidth, {money("estimate", 5)},
            {money("std_error", 5)}, n_left, n_right FROM grid"""),
    "rd_bandwidth_rule": query(
        MUNICIPALITY_ROLES, [*MUNICIPALITY_PANEL, *bandwidth_ctes("log_c")], """
        SELECT sample, round(3.4375 * (sum(noise) / (any_value(density) * (
                (sum(bend) FILTER (is_right) - sum(bend) FILTER (NOT is_right))**2
                + sum(regular))))**0.2 * any_value(n)**(-0.2), 1) AS bandwidth,
            round(any_value(density) * 1e6, 6) AS density_mi,
            round(sum(noise) FILTER (NOT is_right), 6) AS noise_left,
            round(sum(noise) FILTER (is_right), 6) AS noise_right,
            cast(sum(m) FILTER (NOT is_right) AS bigint) AS n_left,
            cast(sum(m) FILTER (is_right) AS bigint) AS n_right FROM ruled GROUP BY sample"""),
    "rd_robust_error": robust("clustered_grid"),
    "rd_neighbour_error": robust("near_grid"),
    "rd_result_grid": rd(SPECS, GRID_COLUMNS),
    "rd_result_grid_firms": query(
        FIRM_ROLES, [*FIRM_PANEL, *rd_ctes("log_avg_c", SPECS)], GRID_COLUMNS),
    "rd_table_layout": rd(SPECS, _layout()),
    "loan_file_scan": query(("non_automatic",), [], """
        SELECT uf, municipio, municipio_codigo, cast(year(data_da_contratacao) AS int) AS ano,
            round(cast(sum(valor_contratado_reais) AS double), 2) AS contracted,
            round(cast(sum(cast(valor_desembolsado_reais AS decimal(18,2))) AS double), 2)
                AS disbursed,
            count(valor_contratado_reais) AS n_known, count(*) AS n
        FROM non_automatic GROUP BY ALL"""),
    "quoted_file_scan": r"""
        SELECT source, count(*) AS n, sum(doc_id)::BIGINT AS ids,
            sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::BIGINT AS words,
            sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D][^\n]*')))::BIGINT AS lines
        FROM documents GROUP BY source""",
    "candidate_number_violations": query(
        ("demographics", "voting", "votes"), [CANDIDATES, RUNNING], """
        SELECT ano, sigla_uf, numero_candidato % 1000 AS numero_candidato, count(*) AS n_left
        FROM running r WHERE EXISTS (SELECT 1 FROM votes v WHERE v.ano = r.ano
            AND v.sg_uf = r.sigla_uf AND v.nr_candidato % 1000 = r.numero_candidato % 1000)
        GROUP BY 1, 2, 3 HAVING count(*) > 1"""),
    "municipality_panel_of_files": query(
        (*MUNICIPALITY_ROLES, *LOAN_TABLES),
        [ALL_LOANS, *base_outcomes(source="all_loans"), *listed("outcomes"), *margins()],
        panel_columns(("log_c", "log_d"))),
    "municipality_first_rows": query(("loans",), [
        """placed AS (SELECT *, 1000000000
                - date_diff('day', DATE '1970-01-01', data_da_contratacao) * 10000
                + cast(regexp_extract(uf, '([0-9]+)', 1) AS bigint) * 100
                + cast(regexp_extract(municipio, '([0-9]+)', 1) AS bigint) AS posicao,
            uf || '/' || month(data_da_contratacao) AS stated FROM loans)""",
        f"""located AS (SELECT * REPLACE ({letters("municipio")} AS municipio)
            FROM ({window_join("placed")}) WHERE municipio_codigo <> 0)""",
        f"""codes AS (SELECT ano, municipio_codigo,
                {whole_sum("valor_da_operacao_em_reais")} AS total_contratado
            FROM located GROUP BY ALL)""",
        """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (
                PARTITION BY ano, municipio_codigo, municipio ORDER BY posicao, stated) AS place
            FROM located) WHERE place = 1)"""], f"""
        SELECT ano, municipio_codigo, municipio, stated AS uf, {money("total_contratado")}
        FROM firsts JOIN codes USING (ano, municipio_codigo)"""),
    "pooled_panel_strict_union": query(
        MUNICIPALITY_ROLES, MUNICIPALITY_PANEL, panel_columns(("log_c", "log_d"))),
    "place_alias": f"""
        SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MAZAGAO' ELSE {name("c_name")} END
            AS place FROM customer""",
    "coalition_file_scan": query(("coalition",), [], f"""
        SELECT ano, sg_uf, sg_partido, ds_composicao_coligacao, count(*) AS n,
            cast(sum(nr_candidato) AS bigint) AS numbers FROM coalition
        WHERE ano IN ({YEARS}) GROUP BY ALL"""),
    "disbursement_file_scan": query(("automatic",), [], """
        SELECT cliente, uf, round(cast(sum(valor_desembolsado_reais) AS double), 4) AS disbursed,
            count(*) AS n FROM automatic GROUP BY ALL"""),
    "vote_files_by_year": query(("votes",), [], f"""
        SELECT ano, sg_uf, nm_municipio, cast(sum(qt_votos_nom_validos) AS bigint) AS votes,
            count(*) AS n, cast(0 AS bigint) AS n_listed
        FROM votes WHERE ano IN ({YEARS}) GROUP BY ALL"""),
    "snapshot_by_year": query(("voting",), [], f"""
        SELECT ano, resultado, cast(sum(votos) AS bigint) AS votos, count(*) AS n
        FROM voting WHERE ano IN ({YEARS}) GROUP BY ALL"""),
    **{name: " UNION ALL ".join(
        "SELECT * FROM (" + query(roles, panel, f"""
        SELECT '{channel}' AS canal, ano, count(*) AS n,
            cast(sum(vote_margin) AS bigint) AS margins, cast(sum(elected) AS bigint) AS elected
        FROM panel GROUP BY ano""") + ")"
        for channel, roles, panel in chosen)
       for name, chosen in (("panel_folders", PANELS), ("panel_one_year_again", PANELS[:1]))},
}
