"""Bias-corrected jumps, robust errors and nearest-neighbour variances at margin zero.

A local polynomial of order p misses the curvature inside its bandwidth. A pilot fit of order p + 1,
in a bandwidth of its own, estimates the missing term; subtracting what the fit makes of it corrects
the estimate, and the robust error counts the noise of the pilot too. Both fits are sums of
w z^j and w z^j y, and so are the scores of a cluster: one aggregation of the panel per cluster
gives everything. Both fits use the same z, the distance from the cutoff mapped to [-1, 1].

The nearest-neighbour variance compares a row with those of the closest margins on its side.
Margins are grouped, cut into ranges of about equal numbers, and every range gets the few margins
before and after it, so that ranges are worked on apart and no side is sorted in one task.

Specifications are ``(sample, spec, degree, bandwidth, pilot bandwidth)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotcredit.operators import rd
from ballotcredit.operators.tables import parameter_table

RobustSpec = tuple[str, int, int, float, float]
KEYS = (*rd.KEYS, "pilot")
SIDE = (*KEYS, "right")


def with_pilots(specs: Sequence[rd.Spec], ratio: float = 1.0) -> list[RobustSpec]:
    """Specifications with a pilot bandwidth of ``ratio`` times their own."""
    return [(*spec, float(spec[3] * ratio)) for spec in specs]


def _inside(panel: DataFrame, outcome: str, specs: Sequence[RobustSpec], *columns: str) -> DataFrame:
    """Rows inside either bandwidth with a known outcome: side, distance, z, y and the weights w of
    the fit and g of the pilot."""
    table = parameter_table(
        panel.sparkSession,
        {"sample": "string", "spec": "int", "degree": "int", "bandwidth": "double",
         "pilot": "double"},
        specs,
    )
    distance = F.abs("vote_margin").cast("double")
    return (
        panel.join(table, "sample")
        .filter(distance <= F.greatest("bandwidth", "pilot"))
        .select(*KEYS, *columns, (F.col("vote_margin") >= 0).alias("right"),
                distance.alias("distance"), F.col(outcome).cast("double").alias("y"))
        .filter(F.col("y").isNotNull())
        .withColumns(_weights())
    )


def _weights() -> dict[str, Column]:
    """z and the weights of a row at ``distance``."""
    def triangle(width: str) -> Column:
        return F.greatest(F.lit(1.0) - F.col("distance") / F.col(width), F.lit(0.0))

    z = F.lit(2.0) * F.col("distance") / F.greatest("bandwidth", "pilot") - F.lit(1.0)
    return {"z": z, "w": triangle("bandwidth"), "g": triangle("pilot")}


def _moments(rows: DataFrame, top: int, *cluster: str) -> DataFrame:
    """u<m>, v<j>: sums of w z^m and w z^j y; s<m>, t<k>: those of the pilot; n: rows of the fit."""
    for kind in "wg":
        rows = rows.withColumn(f"{kind}0", F.col(kind))
        for m in range(1, 2 * top + 3):
            rows = rows.withColumn(f"{kind}{m}", F.col(f"{kind}{m - 1}") * F.col("z"))
    y = F.col("y")
    return rows.groupBy(*SIDE, *cluster).agg(
        F.count_if(F.col("distance") <= F.col("bandwidth")).alias("n"),
        *[F.sum(f"w{m}").alias(f"u{m}") for m in range(2 * top + 2)],
        *[F.sum(F.col(f"w{j}") * y).alias(f"v{j}") for j in range(top + 1)],
        *[F.sum(f"g{m}").alias(f"s{m}") for m in range(2 * top + 3)],
        *[F.sum(F.col(f"g{k}") * y).alias(f"t{k}") for k in range(top + 2)],
    )


def fit_moments(sums: DataFrame, moment: str, size: int, order: Column,
         rights: Mapping[str, Sequence[Column]]) -> DataFrame:
    """``sums`` with the solutions of the moment system of an order, zero beyond it."""
    used = [F.lit(i) <= order for i in range(size)]

    def entry(i: int, j: int) -> Column:
        padding = F.lit(1.0 if i == j else 0.0)
        return F.when(used[max(i, j)], F.col(f"{moment}{i + j}")).otherwise(padding)

    system = sums.select(
        "*",
        *[entry(i, j).alias(f"m{i}{j}") for i in range(size) for j in range(size)],
        *[entry(i, i).alias(f"d{i}") for i in range(size)],
        *[F.when(used[i], right).otherwise(0.0).alias(f"{name}{i}")
          for name, values in rights.items() for i, right in enumerate(values)],
    )
    solved = rd.eliminate(system, size, [f"{name}{{}}" for name in rights])
    return solved.drop(*[c for c in system.columns if c[0] in "md" and c[1:].isdigit()], "pivot")


def _at(prefix: str, size: int, index: Column) -> Column:
    """The column of a run of columns that an index names."""
    return F.element_at(F.array(*[F.col(f"{prefix}{i}") for i in range(size)]), index + 1)


def _fits(sums: DataFrame, top: int) -> DataFrame:
    """Both fits of each side.

    b and q: coefficients of the fit and of the pilot; a: weights of a score in the intercept; c:
    in the pilot's leading coefficient; kappa: what the intercept takes from that coefficient.
    """
    degree = F.col("degree")
    sign = F.when(degree % 2 == 0, -1.0).otherwise(1.0)  # z^(p+1) at the cutoff, z = -1
    fit = fit_moments(sums, "u", top + 1, degree, {
        "b": [F.col(f"v{j}") for j in range(top + 1)],
        "a": [F.lit((-1.0) ** j) for j in range(top + 1)]})
    fit = fit_moments(fit, "s", top + 2, degree + 1, {
        "q": [F.col(f"t{k}") for k in range(top + 2)],
        "c": [F.when(degree + 1 == k, 1.0).otherwise(0.0) for k in range(top + 2)]})
    # a<j> is zero for orders beyond the degree: the index then only has to exist.
    taken = sum(F.col(f"a{j}") * _at("u", 2 * top + 2, F.least(degree + (j + 1), F.lit(2 * top + 1)))
                for j in range(top + 1))
    intercept = sum(F.lit((-1.0) ** j) * F.col(f"b{j}") for j in range(top + 1))
    fit = fit.withColumn("kappa", taken - sign).withColumn("intercept", intercept)
    return fit.withColumn(
        "corrected", intercept - F.col("kappa") * _at("q", top + 2, degree + 1))


def _jumps(sides: DataFrame, errors: Mapping[str, str]) -> DataFrame:
    """One row per specification from one per side; ``errors`` maps an error to its variance."""
    def pick(column: str, right: bool) -> Column:
        return F.max(F.when(F.col("right") == F.lit(right), F.col(column)))

    def both(column: str) -> Column:
        return F.sqrt(pick(column, False) + pick(column, True))

    def rows(right: bool) -> Column:
        return F.coalesce(pick("n", right), F.lit(0))

    return sides.groupBy(*KEYS).agg(
        (pick("intercept", True) - pick("intercept", False)).alias("estimate"),
        (pick("corrected", True) - pick("corrected", False)).alias("estimate_bc"),
        *[both(variance).alias(error) for error, variance in errors.items()],
        rows(False).alias("n_left"), rows(True).alias("n_right"),
    )


def rd_robust_error(
    panel: DataFrame, outcome: str, specs: Sequence[RobustSpec], cluster: str = "factor_cluster",
) -> DataFrame:
    """Jump, bias-corrected jump, and the cluster-robust errors of both, per specification.

    ``std_error`` belongs to ``estimate`` and equals ``rd.rd_std_error``; ``robust_error`` belongs
    to ``estimate_bc``, takes residuals from the pilot fit and adds no small-sample factor. Naming a
    row id as the cluster gives heteroskedasticity-robust errors. Too few distinct margins for the
    pilot leave the corrected columns NULL. A pilot of the same bandwidth corrects to the jump of
    the next order. Per-cluster moments are shuffled once and used for both steps.
    """
    top = max(spec[2] for spec in specs)
    clusters = _moments(_inside(panel, outcome, specs, cluster), top, cluster)
    sums = [c for c in clusters.columns if c not in (*SIDE, cluster)]
    whole = clusters.groupBy(*SIDE).agg(*[F.sum(c).alias(c) for c in sums])
    # Two rows per specification, and specifications are parameters: safe to broadcast.
    fits = F.broadcast(_fits(whole, top).drop(*[c for c in sums if c != "n"])
                       .withColumnRenamed("n", "n_side"))

    def score(weight: str, moment: str, crossed: str, coefficient: str, size: int, other: int):
        return sum(
            F.col(f"{weight}{j}") * (F.col(f"{crossed}{j}") - sum(
                F.col(f"{coefficient}{k}") * F.col(f"{moment}{j + k}") for k in range(other)))
            for j in range(size))

    plain = score("a", "u", "v", "b", top + 1, top + 1)
    robust = (score("a", "u", "v", "q", top + 1, top + 2)
              - F.col("kappa") * score("c", "s", "t", "q", top + 2, top + 2))
    sides = (
        clusters.drop("n").join(fits, [*SIDE])
        .withColumns({"plain": plain, "robust": robust}).groupBy(*SIDE).agg(
            *[F.max(c).alias(c) for c in ("intercept", "corrected")],
            F.max("n_side").alias("n"),
            F.sum(F.col("plain") * F.col("plain")).alias("plain"),
            F.sum(F.col("robust") * F.col("robust")).alias("robust"))
    )
    return _jumps(sides, {"std_error": "plain", "robust_error": "robust"})


def neighbour_sums(groups: DataFrame, keys: Sequence[str], matches: int, ranges: int) -> DataFrame:
    """``groups`` with others and gap: rows in the nearest groups, and the sum of their means' gaps.

    ``groups`` has one row per key and ``distance`` with n rows of mean ``mean``. Of each group the
    nearest others are taken, in turn and both at once where they are equally near, until they and
    the group's own other rows are ``matches``. ``gap`` sums n (their mean - the own mean).
    """
    fractions = [i / ranges for i in range(1, ranges)]
    # One row per key, and keys are specifications and sides: safe to broadcast.
    cuts = F.broadcast(groups.groupBy(*keys).agg(
        F.percentile_approx("distance", fractions, 10 * ranges).alias("cuts")))
    ranged = groups.join(cuts, [*keys]).withColumn(
        "range", F.size(F.filter("cuts", lambda c: c < F.col("distance")))).drop("cuts")
    group = F.struct("distance", "n", "mean")
    by = Window.partitionBy(*keys, "range")

    def edge(order: Column, name: str) -> DataFrame:
        placed = ranged.withColumn("place", F.row_number().over(by.orderBy(order)))
        return placed.where(F.col("place") <= matches).groupBy(*keys, "range").agg(
            F.collect_list(group).alias(name))

    edges = edge(F.col("distance").asc(), "first").join(
        edge(F.col("distance").desc(), "last"), [*keys, "range"])
    # A side has no more ranges than the parameter says, of which each adds a few groups.
    line = Window.partitionBy(*keys).orderBy("range")
    before = F.flatten(F.collect_list("last").over(line.rowsBetween(-matches, -1)))
    after = F.flatten(F.collect_list("first").over(line.rowsBetween(1, matches)))
    halo = edges.select(*keys, "range", before.alias("before"), after.alias("after")).select(
        *keys, "range", F.inline(F.concat(
            F.slice(F.reverse(F.array_sort("before")), 1, matches),
            F.slice(F.array_sort("after"), 1, matches))))
    own = [c for c in ranged.columns if c not in (*keys, "range", "distance", "n", "mean")]
    lined = ranged.withColumn("own", F.lit(True)).unionByName(
        halo.withColumn("own", F.lit(False)), allowMissingColumns=True)
    near = by.orderBy("distance")
    state = "struct<i:int,k:int,others:bigint,gap:double>"

    def step(now: Column, _: Column) -> Column:
        left, right = F.get("_before", now["i"]), F.get("_after", now["k"])
        behind, ahead = F.col("distance") - left["distance"], right["distance"] - F.col("distance")
        take_left = behind.isNotNull() & (ahead.isNull() | (behind <= ahead))
        take_right = ahead.isNotNull() & (behind.isNull() | (ahead <= behind))

        def taken(of: Column, value: Column) -> Column:
            return F.when(of, value).otherwise(F.lit(0))

        moved = F.struct(
            (now["i"] + taken(take_left, F.lit(1))).alias("i"),
            (now["k"] + taken(take_right, F.lit(1))).alias("k"),
            (now["others"] + taken(take_left, left["n"]) + taken(take_right, right["n"])).alias("others"),
            (now["gap"] + taken(take_left, left["n"] * (left["mean"] - F.col("mean")))
             + taken(take_right, right["n"] * (right["mean"] - F.col("mean")))).alias("gap"))
        return F.when(now["others"] + F.col("n") - 1 >= matches, now).otherwise(moved.cast(state))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("others"),
                     F.lit(0.0).alias("gap")).cast(state)
    found = (
        lined
        .withColumn("_before", F.reverse(F.collect_list(group).over(near.rowsBetween(-matches, -1))))
        .withColumn("_after", F.collect_list(group).over(near.rowsBetween(1, matches)))
        .where("own")
        .withColumn("found", F.aggregate(F.sequence(F.lit(1), F.lit(matches)), start, step))
    )
    return found.select(*keys, "distance", "n", "mean", *own, "found.others", "found.gap")


def rd_neighbour_error(
    panel: DataFrame, outcome: str, specs: Sequence[RobustSpec], matches: int = 3, ranges: int = 64,
) -> DataFrame:
    """Jump, bias-corrected jump, and the errors of both from nearest-neighbour variances.

    A row's variance is J / (J + 1) times the squared gap between its outcome and the mean of its J
    neighbours: the rows of its own margin, and the nearest margins on its side inside the wider
    bandwidth until there are ``matches``, with all rows of a margin and both of two equally near
    ones. A row without any neighbour leaves the errors NULL. ``ranges`` sets into how many parts a
    side's margins are cut, not the result.
    """
    top = max(spec[2] for spec in specs)
    rows = _inside(panel, outcome, specs)
    fits = F.broadcast(_fits(_moments(rows, top), top).select(
        *SIDE, "n", "intercept", "corrected", "kappa", *[f"a{j}" for j in range(top + 1)],
        *[f"c{k}" for k in range(top + 2)]).withColumnRenamed("n", "n_side"))
    groups = rows.groupBy(*SIDE, "distance").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"),
        (F.var_pop("y") * F.count(F.lit(1))).alias("spread"))
    near = neighbour_sums(groups, SIDE, matches, ranges).join(fits, [*SIDE]).withColumns(_weights())
    j = F.col("others") + F.col("n") - 1
    squares = F.try_divide(j, j + 1) * (
        F.col("spread") * F.pow(1 + F.try_divide(F.lit(1.0), j), 2)
        + F.col("n") * F.pow(F.try_divide(F.col("gap"), j), 2))

    def curve(weight: str, size: int) -> Column:
        value = F.col(f"{weight}{size - 1}")
        for i in reversed(range(size - 1)):
            value = value * F.col("z") + F.col(f"{weight}{i}")
        return value

    plain = F.col("w") * curve("a", top + 1)
    robust = plain - F.col("kappa") * F.col("g") * curve("c", top + 2)
    weighed = near.withColumns({
        "unknown": (j < 1).cast("int"), "plain": plain * plain * squares,
        "robust": robust * robust * squares})

    def whole(name: str) -> Column:
        return F.when(F.max("unknown") == 0, F.sum(name)).alias(name)

    sides = weighed.groupBy(*SIDE).agg(
        *[F.max(c).alias(c) for c in ("intercept", "corrected")], F.max("n_side").alias("n"),
        whole("plain"), whole("robust"))
    return _jumps(sides, {"std_error": "plain", "robust_error": "robust"})
