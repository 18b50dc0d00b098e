import math

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from ballotcredit.operators import panel as panels
from ballotcredit.operators import rd

H = 25000.0


@pytest.fixture(scope="module")
def sample(spark):
    """Margins on both sides in clusters, with a jump and noise, from a fixed generator."""
    rng = np.random.default_rng(7)
    n = 400
    margin = rng.integers(-40000, 40000, n)
    margin[margin == 0] = 1
    y = 1 + 2 * (margin > 0) + margin / 3e4 + rng.normal(0, 0.5, n)
    data = [
        (str(i), 2006 + 4 * (i % 3), f"U{i % 5}", f"L{i % 7}", "PT" if i % 4 == 0 else "PX",
         i % 2, int(margin[i] > 0), int(margin[i]), float(y[i]))
        for i in range(n)
    ]
    df = spark.createDataFrame(
        data, "id string, ano int, sigla_uf string, colig string, sigla_partido string, "
        "is_colig_pt int, elected int, vote_margin long, log_c double")
    pooled = panels.pooled_panel(df.withColumn("abs_vote_margin", F.abs("vote_margin")))
    samples = [f"{s}{y}" for s in ("all", "pt", "pt_colig", "reg")
               for y in ("", "_2006", "_2010", "_2014")]
    return panels.panel_subsamples(pooled, samples).cache()


def fit(df, degree, h):
    """Weighted least squares per side with numpy: intercepts and clustered variances."""
    result = {}
    for right in (False, True):
        part = [r for r in df if (r.vote_margin >= 0) == right and abs(r.vote_margin) <= h]
        x = np.array([r.vote_margin / h for r in part])
        y = np.array([r.log_c for r in part])
        w = 1 - np.abs(x)
        design = np.vander(x, degree + 1, increasing=True)
        root = np.sqrt(w)[:, None]
        beta = np.linalg.lstsq(design * root, y * root[:, 0], rcond=None)[0]
        bread = np.linalg.inv(design.T @ (design * w[:, None]))
        score = design * (w * (y - design @ beta))[:, None]
        clusters = np.array([r.factor_cluster for r in part])
        sums = [score[clusters == c].sum(axis=0) for c in set(clusters)]
        meat = sum(np.outer(s, s) for s in sums)
        result[right] = (beta[0], (bread @ meat @ bread)[0, 0], len(part))
    jump = result[True][0] - result[False][0]
    return jump, math.sqrt(result[True][1] + result[False][1]), result


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_jump_and_error_equal_weighted_least_squares(sample, degree):
    specs = rd.grid_specs({"all": [(degree, H), (degree, 30000)], "pt_2010": [(degree, H)]})
    got = {(r.sample, r.spec): r for r in rd.rd_std_error(sample, "log_c", specs).collect()}
    jumps = {(r.sample, r.spec): r
             for r in rd.rd_local_polynomial(sample, "log_c", specs).collect()}
    assert len(got) == len(jumps) == 3
    for name, number, _, h in specs:
        part = sample.filter(F.col("sample") == name).collect()
        jump, error, sides = fit(part, degree, h)
        row = got[name, number]
        assert row.estimate == pytest.approx(jump, rel=1e-8)
        assert row.std_error == pytest.approx(error, rel=1e-8)
        assert (row.n_left, row.n_right) == (sides[False][2], sides[True][2])
        assert jumps[name, number].intercept_left == pytest.approx(sides[False][0], rel=1e-8)


def points(table, *pairs):
    return table("sample string, vote_margin long, log_c double, factor_cluster string",
                 *[("s", x, y, f"c{i}") for i, (x, y) in enumerate(pairs)])


def test_exact_lines_give_the_exact_jump(table):
    left = [(-x, 1.0 - x / 1000) for x in (100, 200, 300)]
    right = [(x, 5.0 + x / 500) for x in (100, 400, 700)]
    got = rd.rd_std_error(points(table, *left, *right), "log_c", [("s", 1, 1, 1000.0)]).first()
    assert got.estimate == pytest.approx(4.0) and got.std_error == pytest.approx(0, abs=1e-9)


def test_too_few_distinct_margins_give_null(table):
    df = points(table, (-10, 1.0), (-10, 2.0), (10, 1.0), (20, 2.0), (30, 1.0))
    grid = rd.rd_result_grid(df, "log_c", [("s", 1, 1, 100.0), ("s", 2, 3, 100.0)])
    got = rows(grid.select("spec", "estimate", "std_error", "stars", "n_left", "n_right"))
    assert got == [(1, None, None, None, 2, 3), (2, None, None, None, 2, 3)]


def test_one_empty_side_gives_null(table):
    df = points(table, (10, 1.0), (20, 2.0), (30, 1.0))
    got = rd.rd_std_error(df, "log_c", [("s", 1, 1, 100.0)]).first()
    assert (got.estimate, got.std_error, got.n_left, got.n_right) == (None, None, 0, 3)


def test_boundary_and_missing_outcomes(table):
    df = points(table, (-100, 9.0), (-101, 9.0), (100, None), (50, 1.0), (-50, 2.0))
    counts = rd.rd_effective_counts(df, [("s", 1, 1, 100.0)]).first()
    assert (counts.n_left, counts.n_right) == (2, 2)


def test_counts_add_up_and_nest(sample):
    names = [f"{s}{y}" for s in ("all", "pt", "pt_colig")
             for y in ("", "_2006", "_2010", "_2014")]
    specs = rd.grid_specs({n: [(1, H), (1, 30000), (3, H), (3, 35000)] for n in names})
    n = {(r.sample, r.spec): (r.n_left, r.n_right)
         for r in rd.rd_effective_counts(sample, specs).collect()}
    for kind in ("all", "pt", "pt_colig"):
        for spec in (1, 2, 3, 4):
            years = [n[f"{kind}_{y}", spec] for y in (2006, 2010, 2014)]
            assert tuple(map(sum, zip(*years))) == n[kind, spec]
    for name in names:
        assert n[name, 1] == n[name, 3]
        assert n[name, 1][0] <= n["all", 1][0] and n[name, 1][1] <= n["all", 1][1]


def test_the_panel_is_read_once(sample):
    specs = rd.grid_specs({"all": [(1, H), (3, H)]})
    fresh = sample.sparkSession.createDataFrame(sample.limit(50).toPandas(), sample.schema)
    df = rd.rd_std_error(fresh, "log_c", specs)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_printed_layout(sample):
    specs = rd.grid_specs({"all": [(1, H), (1, 30000), (3, H), (3, 40000)]})
    grid = rd.rd_result_grid(sample, "log_c", specs)
    lines = rows(rd.rd_table_layout(grid, 4), "line")
    first = grid.filter("spec = 1").first()
    assert [r[2] for r in lines] == ["LATE", "", "", "Banda", "Ordem", "Kernel"]
    assert lines[0][3] == f"{first.estimate:.3f}{first.stars}"
    assert lines[2][3] == f"[{first.n_left}, {first.n_right}]"
    assert [r[3:] for r in lines[3:]] == [
        ("25000", "30000", "25000", "40000"), ("1", "1", "3", "3"), ("Triangular",) * 4]


def test_subsamples(sample):
    sizes = {r.sample: r["count"] for r in sample.groupBy("sample").count().collect()}
    assert sizes["all"] == 400 == sum(sizes[f"all_{y}"] for y in (2006, 2010, 2014))
    assert sizes["pt"] == 100 and sizes["pt_colig"] == 200
    whole = sample.filter("sample = 'all'").drop("sample", "elected_label")
    inside = panels.panel_subsamples(whole, ["reg"])
    assert inside.count() == sizes["reg"]
    assert inside.agg(F.max("abs_vote_margin")).first()[0] <= H
    labels = inside.select("elected", "elected_label").distinct()
    assert rows(labels) == [(0, "Não eleito"), (1, "Eleito")]
    assert panels.panel_subsamples(whole, ["pt_colig_2010"]).count() == sizes["pt_colig_2010"]
    with pytest.raises(ValueError):
        panels.panel_subsamples(whole, ["other"])


def test_pooling_needs_equal_layouts(table):
    a = table("ano int, sigla_uf string, colig string", (2006, "SP", "L"))
    b = table("ano int, sigla_uf string, other string", (2010, "SP", "L"))
    assert panels.pooled_panel(a, a).count() == 2
    with pytest.raises(Exception, match="colig"):
        panels.pooled_panel(a, b).collect()


def test_inspection_order(table):
    df = table("ano int, colig string, votos int", (2010, "A", 1), (2006, "B", 2), (2006, "B", 1))
    assert [tuple(r) for r in panels.inspection_order(df).collect()] == [
        (2006, "B", 1), (2006, "B", 2), (2010, "A", 1)]


def test_layout_does_not_lose_a_specification(sample):
    specs = rd.grid_specs({"all": [(1, H + 1000 * i) for i in range(6)]})
    grid = rd.rd_result_grid(sample, "log_c", specs)
    assert rd.rd_table_layout(grid, 6).columns[3:] == [f"({i})" for i in range(1, 7)]
    with pytest.raises(Exception, match="does not fit"):
        rd.rd_table_layout(grid, 4).collect()
