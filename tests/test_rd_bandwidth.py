import numpy as np
import pytest

from ballotcredit.operators.rd_bandwidth import rd_bandwidth

SCHEMA = "sample string, vote_margin long, log_c double"


def rule(x, y):
    """The published rule with numpy, its third derivatives from a cubic of each side."""
    n = len(x)
    first = 1.84 * x.std(ddof=1) * n ** -0.2
    density = (np.abs(x) <= first).sum() / (2 * n * first)
    noise, bend, regular = [], [], []
    for right in (False, True):
        a, b = x[(x >= 0) == right], y[(x >= 0) == right]
        noise.append(b[np.abs(a) <= first].var(ddof=1))
        reach = np.abs(a).max()
        third = 6 * np.polyfit(a / reach, b, 3)[0] / reach ** 3
        second = 3.56 * (noise[-1] / (density * third ** 2)) ** (1 / 7) * len(a) ** (-1 / 7)
        second = min(second, reach)
        near = np.abs(a) <= second
        bend.append(2 * np.polyfit(a[near] / second, b[near], 2)[0] / second ** 2)
        regular.append(2160 * noise[-1] / (near.sum() * second ** 4))
    h = 3.4375 * (sum(noise) / (density * ((bend[1] - bend[0]) ** 2 + sum(regular)))) ** 0.2
    return h * n ** -0.2, density, noise, bend


def test_equal_to_numpy(table):
    rng = np.random.default_rng(2)
    parts = {}
    for name, n in (("a", 900), ("b", 300)):
        x = rng.integers(-50_000, 50_000, n)
        y = np.sin(x / 9000) + (x >= 0) + (x / 3e4) ** 3 + rng.normal(0, 0.3, n)
        parts[name] = x, y
    data = [(name, int(i), float(j)) for name, (x, y) in parts.items() for i, j in zip(x, y)]
    data += [("a", 100, None), ("a", None, 1.0)]
    got = {r["sample"]: r for r in rd_bandwidth(table(SCHEMA, *data), "log_c").collect()}
    assert set(got) == set(parts)
    for name, (x, y) in parts.items():
        h, density, noise, bend = rule(x.astype(float), y)
        row = got[name]
        assert row.bandwidth == pytest.approx(h, rel=1e-7)
        assert row.density == pytest.approx(density, rel=1e-12)
        assert (row.noise_left, row.noise_right) == pytest.approx(noise, rel=1e-9)
        assert (row.curvature_left, row.curvature_right) == pytest.approx(bend, rel=1e-6)
        assert (row.n_left, row.n_right) == ((x < 0).sum(), (x >= 0).sum())


def test_more_rows_and_more_curvature_narrow_the_bandwidth(table):
    rng = np.random.default_rng(4)

    def width(n, bend):
        x = np.linspace(-1000, 1000, n).round().astype(int)
        y = bend * (x / 300) ** 2 * np.sign(x) + rng.normal(0, 1, n)
        return rd_bandwidth(table(SCHEMA, *[("s", int(i), float(j)) for i, j in zip(x, y)]),
                            "log_c").first().bandwidth

    assert width(4000, 1.0) < width(400, 1.0)
    assert width(4000, 5.0) < width(4000, 0.5)


def test_sides_that_cannot_be_fitted_give_null(table):
    one = [("s", 10 * k, float(k % 3)) for k in range(1, 30)]
    got = rd_bandwidth(table(SCHEMA, *one), "log_c").first()
    assert (got.bandwidth, got.n_left, got.n_right) == (None, 0, 29)
    few = one + [("s", -10, 1.0), ("s", -10, 2.0), ("s", -20, 1.0)]
    assert rd_bandwidth(table(SCHEMA, *few), "log_c").first().bandwidth is None
    assert rd_bandwidth(table(SCHEMA), "log_c").count() == 0
