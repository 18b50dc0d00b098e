"""Regression discontinuity at margin zero as weighted-moment aggregates.

A local polynomial with triangular kernel needs only the sums of w z^j and w z^j y per side, so
the panel is reduced by one hash aggregation and the small systems are solved as column
expressions over one row per side. The distance from the cutoff is mapped to z in [-1, 1] before
powers are taken, which keeps the systems well conditioned; the cutoff is at z = -1.

Samples come in the ``sample`` column (see ``panel_subsamples``). Specifications are parameters,
``(sample, spec, degree, bandwidth)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotcredit.functions.numeric import stars
from ballotcredit.operators.tables import parameter_table

Spec = tuple[str, int, int, float]
KEYS = ("sample", "spec", "degree", "bandwidth")
# A pivot below this part of its diagonal entry means fewer distinct margins than coefficients.
SINGULAR = 1e-13


def grid_specs(columns: Mapping[str, Sequence[tuple[int, float]]]) -> list[Spec]:
    """Specifications numbered from 1 per sample from its (degree, bandwidth) columns."""
    return [
        (sample, number, degree, float(bandwidth))
        for sample, pairs in columns.items()
        for number, (degree, bandwidth) in enumerate(pairs, start=1)
    ]


def _inside(panel: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """Panel rows once per specification of their sample, inside its bandwidth (inclusive)."""
    table = parameter_table(
        panel.sparkSession,
        {"sample": "string", "spec": "int", "degree": "int", "bandwidth": "double"},
        specs,
    )
    return panel.join(table, "sample").filter(F.abs("vote_margin") <= F.col("bandwidth"))


def rd_effective_counts(panel: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """Rows left and right of the cutoff inside each bandwidth, boundary included."""
    right = F.col("vote_margin") >= 0
    return (
        _inside(panel, specs)
        .groupBy(*KEYS)
        .agg(F.count_if(~right).alias("n_left"), F.count_if(right).alias("n_right"))
    )


def _moments(
    panel: DataFrame, outcome: str, specs: Sequence[Spec], cluster: Sequence[str] = ()
) -> DataFrame:
    """Weighted moments s0..s2p and t0..tp per specification and side (and cluster)."""
    top = max(degree for _, _, degree, _ in specs)
    rows = _inside(panel, specs).select(
        *KEYS, *cluster,
        (F.col("vote_margin") >= 0).alias("right"),
        (F.abs("vote_margin").cast("double") / F.col("bandwidth")).alias("distance"),
        F.col(outcome).cast("double").alias("y"),
    ).filter(F.col("y").isNotNull())
    rows = rows.withColumns({
        "p0": F.lit(1.0) - F.col("distance"), "z": F.lit(2.0) * F.col("distance") - F.lit(1.0),
    })
    for j in range(1, 2 * top + 1):
        rows = rows.withColumn(f"p{j}", F.col(f"p{j - 1}") * F.col("z"))
    return rows.groupBy(*KEYS, "right", *cluster).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"p{j}").alias(f"s{j}") for j in range(2 * top + 1)],
        *[F.sum(F.col(f"p{j}") * F.col("y")).alias(f"t{j}") for j in range(top + 1)],
    )


def eliminate(system: DataFrame, size: int, rights: Sequence[str]) -> DataFrame:
    """Gauss-Jordan elimination on the columns m<i><j>, with diagonals d<i> before it started.

    The right-hand sides, named by patterns as "b{}", become solutions; a singular system gives
    NULL.
    """
    for k in range(size):
        columns = [f"m{{}}{j}" for j in range(k + 1, size)] + list(rights)
        pivot = F.when(F.col(f"m{k}{k}") > SINGULAR * F.col(f"d{k}"), F.col(f"m{k}{k}"))
        scaled = system.withColumn("pivot", pivot).withColumns(
            {c.format(k): F.col(c.format(k)) / F.col("pivot") for c in columns}
        )
        system = scaled.withColumns({
            c.format(i): F.col(c.format(i)) - F.col(f"m{i}{k}") * F.col(c.format(k))
            for i in range(size) if i != k for c in columns
        })
    return system


def _solve(moments: DataFrame, top: int) -> DataFrame:
    """Coefficients b0..bp, weights a0..ap and the intercept at the cutoff, per row of moments.

    Gauss-Jordan elimination of S b = t and S a = v, where v holds the powers of z = -1: the
    intercept is v'b, and a turns a score into its part of the intercept. Rows of a lower degree
    than ``top`` are padded with the identity; a singular system gives NULL.
    """
    size = range(top + 1)
    used = [F.lit(i) <= F.col("degree") for i in size]

    def entry(i: int, j: int):
        padding = F.lit(1.0 if i == j else 0.0)
        return F.when(used[max(i, j)], F.col(f"s{i + j}")).otherwise(padding)

    others = [c for c in moments.columns if c[0] not in "st" or not c[1:].isdigit()]
    system = moments.select(
        *others,
        *[entry(i, j).alias(f"m{i}{j}") for i in size for j in size],
        *[entry(i, i).alias(f"d{i}") for i in size],
        *[F.when(used[i], F.col(f"t{i}")).otherwise(0.0).alias(f"b{i}") for i in size],
        *[F.when(used[i], F.lit((-1.0) ** i)).otherwise(0.0).alias(f"a{i}") for i in size],
    )
    system = eliminate(system, top + 1, ("b{}", "a{}"))
    at_cutoff = sum(F.lit((-1.0) ** i) * F.col(f"b{i}") for i in size)
    return system.select(
        *others, *[f"b{i}" for i in size], *[f"a{i}" for i in size],
        at_cutoff.alias("intercept"),
    )


def _by_side(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row per specification with ``<measure>_left`` and ``<measure>_right``."""
    sides = {"left": ~F.col("right"), "right": F.col("right")}
    return df.groupBy(*KEYS).agg(*[
        F.max(F.when(side, F.col(m))).alias(f"{m}_{name}")
        for m in measures for name, side in sides.items()
    ])


def rd_local_polynomial(panel: DataFrame, outcome: str, specs: Sequence[Spec]) -> DataFrame:
    """Jump of the outcome at margin zero per specification: right minus left intercept.

    Fewer distinct margins than coefficients on a side give NULL.
    """
    top = max(degree for _, _, degree, _ in specs)
    sides = _by_side(_solve(_moments(panel, outcome, specs), top), ["intercept"])
    jump = F.col("intercept_right") - F.col("intercept_left")
    return sides.withColumn("estimate", jump)


def rd_std_error(
    panel: DataFrame, outcome: str, specs: Sequence[Spec], cluster: str = "factor_cluster"
) -> DataFrame:
    """Jump with its cluster-robust standard error and the rows used on each side.

    The sandwich variance sums the squared cluster scores of each side, without a small-sample
    factor. A cluster's score follows from its own moments and the coefficients, so the panel is
    read once; the per-cluster moments are shuffled once and used for both steps. Naming a row
    id as the cluster gives the heteroskedasticity-robust error.
    """
    top = max(degree for _, _, degree, _ in specs)
    size = range(top + 1)
    clusters = _moments(panel, outcome, specs, (cluster,))
    sums = [c for c in clusters.columns if c not in (*KEYS, "right", cluster)]
    whole = clusters.groupBy(*KEYS, "right").agg(*[F.sum(c).alias(c) for c in sums])
    # Two rows per specification, and specifications are parameters: safe to broadcast.
    solved = F.broadcast(_solve(whole, top).withColumnRenamed("n", "n_side"))
    scores = []
    for j in size:
        fitted = sum(F.col(f"b{k}") * F.col(f"s{j + k}") for k in size)
        scores.append(F.col(f"a{j}") * (F.col(f"t{j}") - fitted))
    scored = clusters.join(solved, [*KEYS, "right"]).withColumn("score", sum(scores))
    sides = _by_side(
        scored.groupBy(*KEYS, "right").agg(
            F.max("intercept").alias("intercept"),
            F.sum(F.col("score") * F.col("score")).alias("variance"),
            F.sum("n").alias("n"),
        ),
        ["intercept", "variance", "n"],
    )
    return sides.select(
        *KEYS, (F.col("intercept_right") - F.col("intercept_left")).alias("estimate"),
        F.sqrt(F.col("variance_left") + F.col("variance_right")).alias("std_error"),
        F.coalesce("n_left", F.lit(0)).alias("n_left"),
        F.coalesce("n_right", F.lit(0)).alias("n_right"),
    )


def rd_result_grid(
    panel: DataFrame, outcome: str, specs: Sequence[Spec], cluster: str = "factor_cluster"
) -> DataFrame:
    """Result table: estimate, stars, standard error, rows per side, bandwidth, order, kernel."""
    errors = rd_std_error(panel, outcome, specs, cluster)
    return errors.select(
        "sample", "spec", "estimate",
        stars(F.col("estimate"), F.col("std_error")).alias("stars"),
        "std_error", "n_left", "n_right", "bandwidth",
        F.col("degree").alias("order"), F.lit("Triangular").alias("kernel"),
    )


def rd_table_layout(grid: DataFrame, columns: int, bandwidth_label: str = "Banda") -> DataFrame:
    """The grid as printed: per sample the lines estimate, error, rows, bandwidth, order, kernel,
    with one text column ``(1)``, ``(2)``, ... per specification.

    ``columns`` is the largest number of specifications of a sample; a specification beyond it
    fails the query instead of going missing.
    """
    beyond = F.raise_error(F.format_string(
        "specification %d does not fit into the stated columns", F.col("spec")))
    grid = grid.withColumn(
        "spec", F.when(F.col("spec").between(1, columns), F.col("spec")).otherwise(beyond))

    def digits(c: str):
        return F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c)))

    texts = [
        ("LATE", F.concat(digits("estimate"), F.col("stars"))),
        ("", F.concat(F.lit("("), digits("std_error"), F.lit(")"))),
        ("", F.format_string("[%d, %d]", "n_left", "n_right")),
        (bandwidth_label, F.format_string("%.0f", F.col("bandwidth"))),
        ("Ordem", F.col("order").cast("string")),
        ("Kernel", F.col("kernel")),
    ]
    lines = F.array(*[
        F.struct(F.lit(i).alias("line"), F.lit(name).alias("label"), text.alias("text"))
        for i, (name, text) in enumerate(texts, start=1)
    ])
    numbers = list(range(1, columns + 1))
    wide = (
        grid.select("sample", "spec", F.inline(lines))
        .groupBy("sample", "line", "label")
        .pivot("spec", numbers)
        .agg(F.first("text"))
    )
    return wide.select(
        "sample", "line", "label", *[F.col(f"`{n}`").alias(f"({n})") for n in numbers]
    )
