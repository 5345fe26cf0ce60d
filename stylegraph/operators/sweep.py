"""Choosing a point of a parameter sweep.

A sweep is a small table by nature (one row per tried value), grouped by the
method that was swept; all rules are windows over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def first_minimal_change(sweep: DataFrame, key: str, metrics: list[str], threshold: float,
                         by: list[str]) -> DataFrame:
    """Largest key whose metrics all changed by less than ``threshold`` against
    the next larger key; null when there is none. One row per ``by``."""
    down = Window.partitionBy(*by).orderBy(F.col(key).desc())
    calm = F.lit(True)
    for m in metrics:
        calm = calm & (F.abs(F.col(m) - F.lag(m).over(down)) < threshold)
    return (sweep.withColumn("_calm", calm).groupBy(*by)
            .agg(F.max(F.when(F.col("_calm"), F.col(key))).alias(key)))


def extremum(sweep: DataFrame, x: str, y: str, largest: bool, by: list[str]) -> DataFrame:
    """First x holding the best value: ``(*by, best_x, best_y, last_x)``."""
    value = -F.col(y) if largest else F.col(y)
    best = F.min(F.struct(value.alias("v"), F.col(x).alias("x")))
    return sweep.groupBy(*by).agg(best.alias("_b"), F.max(x).alias("last_x")).select(
        *by, F.col("_b.x").alias("best_x"),
        (-F.col("_b.v") if largest else F.col("_b.v")).alias("best_y"), "last_x")


def stable_point(sweep: DataFrame, x: str, y: str, by: list[str], window: int = 3,
                 threshold: float | None = None) -> DataFrame:
    """First x ending ``window`` changes in a row below ``threshold``, else the last x.

    Without a threshold, the spread (population deviation) of the changes is used.
    """
    along = Window.partitionBy(*by).orderBy(x)
    whole = Window.partitionBy(*by)
    rows = sweep.withColumn("_step", F.col(y) - F.lag(y).over(along))
    limit = F.lit(threshold) if threshold is not None else F.stddev_pop("_step").over(whole)
    rows = rows.withColumn("_calm", F.when(F.abs("_step") < limit, 1).otherwise(0))
    recent = along.rowsBetween(-(window - 1), 0)
    rows = (rows.withColumn("_all", F.min("_calm").over(recent))
            .withColumn("_seen", F.count("_step").over(recent)))
    stable = (F.col("_all") == 1) & (F.col("_seen") == window)
    return rows.groupBy(*by).agg(
        F.coalesce(F.min(F.when(stable, F.col(x))), F.max(x)).alias("stable_x"))


def optimal_stable_point(sweep: DataFrame, x: str, y: str, largest: bool,
                         by: list[str]) -> DataFrame:
    """The best point, or the stable point when the best is the last one."""
    best = extremum(sweep, x, y, largest, by)
    return best.join(stable_point(sweep, x, y, by), by).select(
        *by, F.when(F.col("best_x") == F.col("last_x"), F.col("stable_x"))
        .otherwise(F.col("best_x")).alias("point"))


def next_largest_or_equal(values: DataFrame, x: str, targets: DataFrame, target: str,
                          by: list[str]) -> DataFrame:
    """Smallest value not below the target: ``(*by, x)``, null when all are below."""
    return (targets.join(values.select(*by, x), by, "left")
            .groupBy(*by).agg(F.min(F.when(F.col(x) >= F.col(target), F.col(x))).alias(x)))


def select_sweep_point(sweep: DataFrame, x: str, metrics: dict[str, bool],
                       by: list[str]) -> DataFrame:
    """The sweep row at the rounded mean of the metrics' optimal stable points,
    or at the next tried value above it. ``metrics`` tells which ones are best
    when large."""
    points = None
    for name, largest in metrics.items():
        here = optimal_stable_point(sweep, x, name, largest, by).withColumnRenamed(
            "point", f"_p_{name}")
        points = here if points is None else points.join(here, by)
    total = sum((F.col(f"_p_{m}") for m in metrics), F.lit(0.0))
    target = points.select(*by, F.bround(total / len(metrics), 0).alias("target"))
    chosen = next_largest_or_equal(sweep, x, target, "target", by)
    return sweep.join(chosen, [*by, x], "left_semi")


def best_eps(performance: DataFrame) -> DataFrame:
    """The row with the smallest (eer, ap, ndcg, mean_sim), then the smallest eps."""
    order = F.struct("eer", "ap", "ndcg", "mean_sim", "eps")
    return performance.agg(F.min(order).alias("b")).select("b.*")
