import math

import numpy as np
import pytest
from helpers import rows

from ballotcredit.operators import rd, rd_robust


@pytest.fixture(scope="module")
def points():
    """Margins with many ties, outcomes with curvature, in clusters."""
    rng = np.random.default_rng(5)
    n = 500
    margin = rng.integers(-60, 60, n) * 500 + rng.integers(0, 3, n)
    y = 1 + (margin >= 0) + (margin / 2e4) ** 2 + rng.normal(0, 0.5, n)
    return [("s", int(m), float(v), f"c{i % 17}") for i, (m, v) in enumerate(zip(margin, y))]


@pytest.fixture
def panel(table, points):
    return table("sample string, vote_margin long, log_c double, factor_cluster string", *points)


def neighbours(x, y, matches):
    """Variance of each outcome from its nearest ones, by plain loops."""
    out = np.full(len(x), np.nan)
    for i in range(len(x)):
        far = np.abs(x - x[i])
        far[i] = np.inf
        near = np.sort(far)[:min(matches, len(x) - 1)]
        if len(near):
            others = y[far <= near[-1]]
            j = len(others)
            out[i] = j / (j + 1) * (y[i] - others.mean()) ** 2
    return out


def fit(points, degree, h, b, matches):
    """Matrices of both fits with numpy: jumps and variances by cluster and by neighbour."""
    total = np.zeros(6)
    for right in (False, True):
        part = [p for p in points if (p[1] >= 0) == right and abs(p[1]) <= max(h, b)]
        x, y = np.array([p[1] for p in part], float), np.array([p[2] for p in part])
        clusters = np.array([p[3] for p in part])
        unit = x / max(h, b)
        w, g = (np.maximum(1 - np.abs(x) / k, 0) for k in (h, b))
        low, high = (np.vander(unit, k + 1, increasing=True) for k in (degree, degree + 1))
        lower = np.linalg.inv(low.T @ (low * w[:, None])) @ (low * w[:, None]).T
        higher = np.linalg.inv(high.T @ (high * g[:, None])) @ (high * g[:, None]).T
        plain = lower[0]
        robust = plain - (lower @ unit ** (degree + 1))[0] * higher[degree + 1]
        residual = y - low @ (lower @ y)
        pilot = y - high @ (higher @ y)
        sums = [[(row * r)[clusters == c].sum() for c in set(clusters)]
                for row, r in ((plain, residual), (robust, pilot))]
        near = neighbours(x, y, matches)
        sign = 1 if right else -1
        total += [sign * plain @ y, sign * robust @ y, np.dot(sums[0], sums[0]),
                  np.dot(sums[1], sums[1]), plain ** 2 @ near, robust ** 2 @ near]
    return total[:2], np.sqrt(total[2:])


@pytest.mark.parametrize("degree,h,b", [(1, 20000.0, 20000.0), (1, 15000.0, 25000.0),
                                        (2, 25000.0, 18000.0), (3, 30000.0, 30000.0)])
def test_equal_to_matrices(panel, points, degree, h, b):
    specs = [("s", 1, degree, h, b), ("s", 2, 1, h, h)]
    clustered = {r.spec: r for r in rd_robust.rd_robust_error(panel, "log_c", specs).collect()}
    for matches, ranges in ((3, 7), (1, 64), (9, 2)):
        near = {r.spec: r for r in rd_robust.rd_neighbour_error(
            panel, "log_c", specs, matches, ranges).collect()}
        for _, spec, p, width, pilot in specs:
            jumps, errors = fit(points, p, width, pilot, matches)
            for row in (clustered[spec], near[spec]):
                assert (row.estimate, row.estimate_bc) == pytest.approx(tuple(jumps), rel=1e-9)
            assert (clustered[spec].std_error, clustered[spec].robust_error) == pytest.approx(
                tuple(errors[:2]), rel=1e-9)
            assert (near[spec].std_error, near[spec].robust_error) == pytest.approx(
                tuple(errors[2:]), rel=1e-9)
            inside = [p for p in points if abs(p[1]) <= width]
            assert near[spec].n_left == sum(p[1] < 0 for p in inside)
            assert clustered[spec].n_right == sum(p[1] >= 0 for p in inside)


def test_equal_pilot_gives_the_next_order(panel):
    plain = [("s", 1, 1, 20000.0), ("s", 2, 2, 20000.0)]
    orders = {r.spec: r for r in rd.rd_std_error(panel, "log_c", plain).collect()}
    got = rd_robust.rd_robust_error(panel, "log_c", rd_robust.with_pilots(plain[:1])).first()
    assert got.estimate == pytest.approx(orders[1].estimate, rel=1e-10)
    assert got.std_error == pytest.approx(orders[1].std_error, rel=1e-10)
    assert got.estimate_bc == pytest.approx(orders[2].estimate, rel=1e-8)
    assert got.robust_error == pytest.approx(orders[2].std_error, rel=1e-8)


def test_parabola_is_corrected_exactly(table):
    data = [("s", 100 * k, (k / 10) ** 2 + (3.0 if k > 0 else 0.0), "c") for k in range(-40, 41) if k]
    df = table("sample string, vote_margin long, log_c double, factor_cluster string", *data)
    got = rd_robust.rd_robust_error(df, "log_c", [("s", 1, 1, 3000.0, 4000.0)]).first()
    assert abs(got.estimate - 3) < 1e-9 or got.estimate != pytest.approx(3, abs=1e-6)
    assert got.estimate_bc == pytest.approx(3, abs=1e-9)
    assert got.robust_error == pytest.approx(0, abs=1e-9)


def test_neighbours_across_ranges_and_ties(table):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.integers(0, 40, 60), [100, 100, 100, 100], [200], [207]])
    y = rng.normal(size=len(x))
    seen = {}
    for a, v in zip(x.tolist(), y.tolist()):
        seen.setdefault(a, []).append(v)
    groups = table("k int, distance double, n long, mean double",
                   *[(1, float(a), len(v), float(np.mean(v))) for a, v in seen.items()])
    for matches in (1, 2, 3, 5, 200):
        for ranges in (2, 5, 40):
            got = rd_robust.neighbour_sums(groups, ["k"], matches, ranges).collect()
            assert len(got) == len(seen)
            for r in got:
                far = np.abs(x - r.distance)
                kept = np.sort(far)[1:][:min(matches, len(x) - 1)]
                others = (far <= kept[-1]) & (far > 0)
                assert r.others == others.sum()
                assert r.gap == pytest.approx(float((y[others] - r.mean).sum()), abs=1e-9)


def test_lonely_rows_empty_sides_and_few_margins(table):
    schema = "sample string, vote_margin long, log_c double, factor_cluster string"
    lonely = table(schema, ("s", -5, 1.0, "a"), *[("s", 10 * k, float(k), "a") for k in range(1, 9)])
    got = rd_robust.rd_neighbour_error(lonely, "log_c", [("s", 1, 0, 100.0, 100.0)]).first()
    assert got.estimate is not None and got.std_error is None and got.n_left == 1
    one = table(schema, *[("s", 10 * k, float(k), "a") for k in range(1, 9)], ("s", -1, None, "a"))
    got = rd_robust.rd_robust_error(one, "log_c", [("s", 1, 1, 100.0, 100.0)]).first()
    assert (got.estimate, got.estimate_bc, got.n_left, got.n_right) == (None, None, 0, 8)
    few = table(schema, *[("s", s * k, float(k), "a") for k in (1, 2) for s in (-1, 1)])
    got = rd_robust.rd_robust_error(few, "log_c", [("s", 1, 1, 100.0, 100.0)]).first()
    assert not math.isnan(got.estimate) and got.estimate_bc is None and got.robust_error is None
    assert rows(rd_robust.rd_robust_error(
        one.limit(0), "log_c", [("s", 1, 1, 100.0, 100.0)]).select("sample")) == []
