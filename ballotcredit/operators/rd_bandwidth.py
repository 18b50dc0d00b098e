"""A bandwidth for the local linear jump from the data: the plug-in rule of Imbens and Kalyanaraman.

The rule weighs the noise near the cutoff against the curvature that a line misses. Density and noise
come from a first window, the curvature from quadratic fits in windows whose widths follow from third
derivatives, and those from a cubic over each side. Every step needs sums per sample and side only:
the panel is aggregated three times, and nothing but those sums is ever joined back to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotcredit.operators.rd_robust import fit_moments

# Fixed values of the published rule: width of the first window, width of the curvature windows,
# regularisation, and the constant of the triangular kernel.
FIRST, SECOND, REGULAR, TRIANGULAR = 1.84, 3.56, 2160.0, 3.4375
SIDE = ("sample", "right")


def _sums(width: str, top: int) -> list[Column]:
    """s<m>, t<j>: sums of z^m and z^j y, with z the distance mapped from [0, width] to [-1, 1]."""
    z = F.lit(2.0) * F.col("distance") / F.col(width) - 1.0
    powers = [F.lit(1.0)]
    for _ in range(2 * top):
        powers.append(powers[-1] * z)
    return [F.sum(p).alias(f"s{m}") for m, p in enumerate(powers)] + [
        F.sum(p * F.col("y")).alias(f"t{j}") for j, p in enumerate(powers[:top + 1])]


def _derivative(sums: DataFrame, top: int, width: str, name: str) -> DataFrame:
    """The derivative of order ``top`` of the least-squares polynomial of that order."""
    fitted = fit_moments(sums, "s", top + 1, F.lit(top),
                         {"b": [F.col(f"t{j}") for j in range(top + 1)]})
    factor = 1.0
    for i in range(1, top + 1):
        factor *= i
    scale = F.pow(F.lit(2.0) / F.col(width), F.lit(float(top)))
    used = [f"s{m}" for m in range(2 * top + 1)] + [f"t{j}" for j in range(top + 1)]
    return fitted.withColumn(name, F.col(f"b{top}") * factor * scale).drop(
        *used, *[f"b{j}" for j in range(top + 1)])


def rd_bandwidth(panel: DataFrame, outcome: str) -> DataFrame:
    """(sample, bandwidth, density, noise_left, noise_right, curvature_left, curvature_right,
    n_left, n_right): the bandwidth of each sample of a panel.

    Rows without an outcome or a margin take no part. The third derivatives come from a cubic of
    each side over all its rows; one that is zero leaves the side's window as wide as the side. A
    side with too few rows or distinct margins for its fits gives NULL. One row per sample, also
    for tables of one side; samples are few, and joins to them broadcast.
    """
    rows = panel.select(
        "sample", (F.col("vote_margin") >= 0).alias("right"),
        F.abs("vote_margin").cast("double").alias("distance"),
        F.col("vote_margin").cast("double").alias("x"), F.col(outcome).cast("double").alias("y"),
    ).where(F.col("y").isNotNull() & F.col("x").isNotNull())
    spread = rows.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"))
    first = spread.withColumn(
        "first", F.lit(FIRST) * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    reach = rows.groupBy(*SIDE).agg(F.max("distance").alias("reach"))
    placed = rows.join(F.broadcast(first), "sample").join(F.broadcast(reach), [*SIDE])
    near = F.col("distance") <= F.col("first")
    global_ = placed.groupBy(*SIDE, "n", "first", "reach").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(near).alias("close"),
        F.var_samp(F.when(near, F.col("y"))).alias("noise"), *_sums("reach", 3))
    third = _derivative(global_, 3, "reach", "third")
    close = third.groupBy("sample").agg(F.sum("close").alias("closer"))
    density = F.col("closer") / (F.lit(2.0) * F.col("n") * F.col("first"))
    wide = F.lit(SECOND) * F.pow(
        F.try_divide(F.col("noise"), F.col("density") * F.col("third") * F.col("third")),
        F.lit(1 / 7)) * F.pow(F.col("rows").cast("double"), F.lit(-1 / 7))
    # The window is no wider than the side, which is all that a wider one would hold.
    sides = third.join(F.broadcast(close), "sample").withColumn("density", density).withColumn(
        "second", F.when(F.col("third").isNotNull() & F.col("noise").isNotNull(),
                         F.least(F.coalesce(wide, F.col("reach")), F.col("reach"))))
    held = rows.join(F.broadcast(sides.select(*SIDE, "second")), [*SIDE]).where(
        F.col("distance") <= F.col("second"))
    local = held.groupBy(*SIDE, "second").agg(F.count(F.lit(1)).alias("within"),
                                              *_sums("second", 2))
    curved = _derivative(local, 2, "second", "curvature").withColumn(
        "_second", F.col("second")).drop("second")
    whole = sides.join(F.broadcast(curved), [*SIDE], "left").withColumn(
        "regular", F.lit(REGULAR) * F.col("noise") / (F.col("within") * F.pow("_second", F.lit(4.0))))

    def side(column: str, right: bool) -> Column:
        return F.max(F.when(F.col("right") == F.lit(right), F.col(column)))

    table = whole.groupBy("sample").agg(
        F.max("n").alias("n"), F.max("density").alias("density"),
        *[side(c, right).alias(f"{c}_{name}") for c in ("noise", "curvature", "regular", "rows")
          for name, right in (("left", False), ("right", True))])
    bend = F.col("curvature_right") - F.col("curvature_left")
    noise = F.col("noise_left") + F.col("noise_right")
    bandwidth = F.lit(TRIANGULAR) * F.pow(F.try_divide(noise, F.col("density") * (
        bend * bend + F.col("regular_left") + F.col("regular_right"))), F.lit(0.2)) * F.pow(
        F.col("n").cast("double"), F.lit(-0.2))
    return table.select(
        "sample", bandwidth.alias("bandwidth"), "density", "noise_left", "noise_right",
        "curvature_left", "curvature_right", F.coalesce("rows_left", F.lit(0)).alias("n_left"),
        F.coalesce("rows_right", F.lit(0)).alias("n_right"))
