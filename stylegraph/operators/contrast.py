"""Representative and contrastive selection with cosine or RBF kernels.

With a cosine kernel every mean of kernel values is a dot product with a mean of
unit vectors, so no kernel matrix is built. Items are ``(id, vector)``; unit
vectors are formed here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from stylegraph.functions.vectors import dot, l2_normalize, norm, vector_mean, vector_sum
from stylegraph.operators.blocks import (BLOCK_ROWS, TILE_ROWS, arrow_schema, matrix, product,
                                         unit_rows)
from stylegraph.operators.skew import lookup_join
from stylegraph.sources.staging import settle

FLOOR = 1e-12


def units(items: DataFrame) -> DataFrame:
    return items.withColumn("vector", l2_normalize(F.col("vector")))


def _mean_vector(rows: DataFrame) -> Column:
    """Mean vector of unit rows as a constant."""
    value = rows.agg(vector_mean(F.col("vector")).alias("m")).first()["m"]
    return F.lit([float(x) for x in value])


def kernel_row_means(items: DataFrame, gamma: float | None = None, ridge: float = 0.0,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean kernel value of each item to all items, and its diagonal:
    ``(id, mean, diagonal)``. ``gamma`` selects an RBF kernel, ``ridge`` is added
    to the diagonal."""
    n = items.count()
    if gamma is None:
        unit = settle(units(items.select("id", "vector")), "units")
        mean = _mean_vector(unit)
        own = dot(F.col("vector"), F.col("vector"))
        rows = unit.select("id", dot(F.col("vector"), mean).alias("mean"), own.alias("diagonal"))
    else:
        kind = items.schema["id"].dataType.simpleString()
        schema = f"id {kind}, total double"
        out = arrow_schema(schema)

        def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
            a, b = matrix(lt), matrix(rt)
            total = np.zeros(len(a))
            for s in range(0, len(a), TILE_ROWS):
                x = a[s:s + TILE_ROWS]
                square = (x ** 2).sum(1)[:, None] - 2 * x @ b.T + (b ** 2).sum(1)[None, :]
                total[s:s + TILE_ROWS] = np.exp(-gamma * np.maximum(square, 0)).sum(axis=1)
            return pa.table([lt.column("id"), pa.array(total)], schema=out)

        points = items.select("id", "vector")
        rows = product(points, points, kernel, schema, block_rows).groupBy("id").agg(
            (F.sum("total") / n).alias("mean")).withColumn("diagonal", F.lit(1.0))
    return rows.select("id", (F.col("mean") + ridge / n).alias("mean"),
                       (F.col("diagonal") + ridge).alias("diagonal"))


def gain_inputs(items: DataFrame, universe: DataFrame, selected: DataFrame,
                against: DataFrame | None = None) -> DataFrame:
    """What the closed gains need, per candidate item not yet selected.

    Columns: ``to_v`` mean kernel to the universe, ``to_s`` to the selection,
    ``vs`` mean of the selection's ``to_v``, ``ss`` mean kernel inside the
    selection, ``m`` size of the selection plus one, ``own`` the diagonal, and
    ``to_p`` mean kernel to ``against``.
    """
    unit = settle(units(items.select("id", "vector")), "units")
    picked = unit.join(selected.select("id"), "id", "left_semi")
    size = picked.count()
    zero = F.lit(0.0)
    v = F.col("vector")
    mean_v = _mean_vector(units(universe.select("id", "vector")))
    rows = unit.join(selected.select("id"), "id", "left_anti").select(
        "id", "vector", dot(v, mean_v).alias("to_v"), dot(v, v).alias("own"))
    if size:
        mean_s = _mean_vector(picked)
        rows = (rows.withColumn("to_s", dot(v, mean_s)).withColumn("vs", dot(mean_v, mean_s))
                .withColumn("ss", dot(mean_s, mean_s)))
    else:
        rows = rows.withColumn("to_s", zero).withColumn("vs", zero).withColumn("ss", zero)
    to_p = zero if against is None else dot(v, _mean_vector(units(against.select("id", "vector"))))
    return rows.withColumn("m", F.lit(float(size + 1))).withColumn("to_p", to_p)


def _grown(m: Column) -> Column:
    """Whether something was selected before."""
    return m > 1


def gain_mmd(to_v="to_v", to_s="to_s", vs="vs", ss="ss", m="m", own="own") -> Column:
    """Gain of an item in how well the selection's mean matches the universe's."""
    to_v, to_s, vs, ss, m, own = map(F.col, (to_v, to_s, vs, ss, m, own))
    before = F.when(_grown(m), -2 * vs + (2 * (m - 1) / m + 1 / m) * ss
                    - 2 * (m - 1) / m * to_s).otherwise(0.0)
    return (2 * to_v - own / m + before) / m


def gain_ekxs(to_v="to_v", vs="vs") -> Column:
    """Gain in the selection's mean similarity to the universe."""
    m = F.col("m")
    return (F.col(to_v) - F.when(_grown(m), F.col(vs)).otherwise(0.0)) / m


def gain_div(to_v="to_v", vs="vs") -> Column:
    """Gain in diversity: the drop of the similarity inside the selection; the universe plays no part."""
    m = F.col("m")
    before = F.when(_grown(m), (2 * (m - 1) / m + 1 / m) * F.col("ss")
                    - 2 * (m - 1) / m * F.col("to_s")).otherwise(0.0)
    return (-F.col("own") / m + before) / m


def gain_kxs(to_v="to_v", vs="vs") -> Column:
    """Mean similarity to the universe, whatever was selected."""
    return F.col(to_v)


def gain_critic(absolute: bool = True) -> Column:
    """Difference of the mean similarities to the universe and to a second set."""
    gap = F.col("to_v") - F.col("to_p")
    return F.abs(gap) if absolute else gap


def gain_dummy() -> Column:
    return F.lit(0.0)


def combine(*weighted: tuple[float, Column]) -> Column:
    """Weighted sum of gains; a weight of -1 subtracts."""
    total = F.lit(0.0)
    for weight, gain in weighted:
        total = total + F.lit(float(weight)) * gain
    return total


def gain_nn(items: DataFrame, universe: DataFrame, selected: DataFrame,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Nearest-neighbour gain ``(id, gain)``: how much an item raises the sum of
    the universe's best similarities to the selection."""
    unit = settle(units(items.select("id", "vector")), "units")
    chosen = unit.join(selected.select("id"), "id", "left_semi")
    candidates = unit.join(selected.select("id"), "id", "left_anti")
    kind = unit.schema["id"].dataType.simpleString()
    schema = f"id {kind}, gain double"
    out = arrow_schema(schema)
    against = settle(units(universe.select("id", "vector")), "universe")
    other = against.schema["id"].dataType.simpleString()
    best_out = arrow_schema(f"id {other}, have double")

    def best(lt: pa.Table, rt: pa.Table) -> pa.Table:
        a, b = matrix(lt), matrix(rt)
        have = [(a[s:s + TILE_ROWS] @ b.T).max(axis=1) for s in range(0, len(a), TILE_ROWS)]
        return pa.table([lt.column("id"), pa.array(np.concatenate(have))], schema=best_out)

    # the best similarity so far of every universe row; none while nothing is selected
    have = product(against, chosen, best, f"id {other}, have double", block_rows).groupBy("id").agg(
        F.max("have").alias("have"))
    against = against.join(have, "id", "left")

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        a, b = matrix(lt), matrix(rt)
        have = rt.column("have").to_pandas().to_numpy(dtype=float)
        gain = np.zeros(len(a))
        for s in range(0, len(a), TILE_ROWS):
            w = a[s:s + TILE_ROWS] @ b.T
            gain[s:s + TILE_ROWS] = np.where(np.isnan(have), w, np.maximum(w - have, 0)).sum(1)
        return pa.table([lt.column("id"), pa.array(gain)], schema=out)

    def add(held: pa.Table, found: pa.Table) -> pa.Table:
        return held.set_column(1, out[1], pc.add(held.column("gain"), found.column("gain")))

    parts = product(candidates, against, kernel, schema, block_rows, add)
    return parts.groupBy("id").agg(F.sum("gain").alias("gain"))


def gram(rows: DataFrame) -> np.ndarray | None:
    """Sum of the outer products of ``rows(vector)``, width x width; None without rows."""
    schema = "i int, part array<double>"
    out = arrow_schema(schema)

    def outer(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(list(total))], schema=out)

    sums = rows.select("vector").mapInArrow(outer, schema).groupBy("i").agg(vector_sum(F.col("part")).alias("part"))
    found = sums.orderBy("i").toArrow()             # one row per dimension
    return np.array(found.column("part").to_pylist()) if found.num_rows else None


def gain_logdet(items: DataFrame, selected: DataFrame, merged: DataFrame | None = None,
                ridge: float = 0.0) -> DataFrame:
    """Log of an item's variance given the selection: ``(id, gain)``.

    ``merged`` adds a second set to the selection; the variance has a floor.
    """
    unit = settle(units(items.select("id", "vector")), "units")
    given = selected.select("id") if merged is None else selected.select("id").union(
        merged.select("id"))
    together = gram(unit.join(given.distinct(), "id", "left_semi"))
    explains = None
    if together is not None:
        # what a selection explains of x is x' G (G + ridge)^-1 x, whose size is the width of x
        values, axes = np.linalg.eigh(together)
        kept = values > 1e-10 * values.max()
        share = np.where(kept, values / np.where(kept, values + ridge, 1.0), 0.0)
        explains = (axes * share) @ axes.T
    kind = unit.schema["id"].dataType.simpleString()
    schema = f"id {kind}, gain double"
    out = arrow_schema(schema)

    def solve(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch)
            variance = (x ** 2).sum(1) + ridge
            if explains is not None:
                variance = np.abs(variance - ((x @ explains) * x).sum(1))
            gain = np.log(np.maximum(variance, FLOOR))
            yield pa.record_batch([batch.column("id"), pa.array(gain)], schema=out)

    return unit.join(selected.select("id"), "id", "left_anti").mapInArrow(solve, schema)


#: Gains that a selection's sums decide, by name: of how an item stands to a set and what was selected of it.
CLOSED_GAINS = {"mmd": gain_mmd, "ekxs": gain_ekxs, "div": gain_div, "kxs": gain_kxs}


def greedy_select_by_class(items: DataFrame, k: int, weight: float = 0.1,
                           doubled_class=None, gain: str = "mmd", against: str = "mmd") -> DataFrame:
    """Per class the ``k`` items that best represent it and least the others.

    ``items(id, class, vector)``; each step takes, in every class, the item with
    the largest ``gain`` on the class minus ``weight`` times its gain ``against`` the
    complement, both among ``CLOSED_GAINS``. Ties go to the smaller id; a class with fewer items ends early.
    ``doubled_class`` counts one class twice in the complement of the others, as
    well as in its own. Returns ``(class, step, id, gain)``.
    """
    unit = settle(units(items.select("id", "class", "vector")), "units")
    v = F.col("vector")
    sums = settle(unit.groupBy("class").agg(vector_sum(v).alias("s"),
                                            F.count(F.lit(1)).alias("n")), "class-sums")
    everything = sums if doubled_class is None else sums.unionByName(
        sums.filter(F.col("class") == doubled_class))
    every = everything.agg(vector_sum(F.col("s")).alias("s"), F.sum("n").alias("n")).first()
    whole, count = F.lit([float(x) for x in every["s"]]), F.lit(int(every["n"]))
    others = F.zip_with(whole, F.col("s"), lambda t, s: t - s)
    means = sums.select(
        "class", "n", F.transform("s", lambda x: x / F.col("n")).alias("mean"),
        F.when(count > F.col("n"), F.transform(others, lambda x: x / (count - F.col("n"))))
        .otherwise(F.transform("s", lambda x: x * 0.0)).alias("rest"))
    state = lookup_join(unit, means, ["class"], counted="n").select(
        "id", "class", "vector", dot(v, F.col("mean")).alias("to_v"),
        dot(v, F.col("rest")).alias("to_c"), dot(v, v).alias("own"),
        *[F.lit(0.0).alias(c) for c in ("dots", "sum_v", "sum_c", "inner")])
    chosen = None
    for step in range(1, k + 1):
        m = F.lit(float(step))
        seen = F.lit(float(max(step - 1, 1)))
        rows = (settle(state, "greedy").withColumn("m", m)
                .withColumn("to_s", F.col("dots") / seen).withColumn("ss", F.col("inner") / (seen * seen))
                .withColumn("vs", F.col("sum_v") / seen).withColumn("cs", F.col("sum_c") / seen))
        total = CLOSED_GAINS[gain]()
        if weight:
            total = total - weight * CLOSED_GAINS[against](to_v="to_c", vs="cs")
        kept = ["id", "vector", "to_v", "to_c", "own", "dots", "sum_v", "sum_c", "inner"]
        best = rows.groupBy("class").agg(F.min(F.struct(
            (-F.round(total, 12)).alias("loss"), *kept)).alias("b"))
        best = settle(best, "picks")
        here = best.select("class", F.lit(step).cast("bigint").alias("step"), "b.id",
                           (-F.col("b.loss")).alias("gain"))
        chosen = here if chosen is None else chosen.unionByName(here)
        if step == k:
            break
        pick = best.select(
            "class", F.col("b.id").alias("_id"), F.col("b.vector").alias("_vector"),
            (F.col("b.sum_v") + F.col("b.to_v")).alias("_sum_v"),
            (F.col("b.sum_c") + F.col("b.to_c")).alias("_sum_c"),
            (F.col("b.inner") + 2 * F.col("b.dots") + F.col("b.own")).alias("_inner"))
        state = lookup_join(rows, pick, ["class"]).filter("id <> _id").select(
            "id", "class", "vector", "to_v", "to_c", "own",
            (F.col("dots") + dot(v, F.col("_vector"))).alias("dots"),
            F.col("_sum_v").alias("sum_v"), F.col("_sum_c").alias("sum_c"),
            F.col("_inner").alias("inner"))
    return chosen


def greedy_select(items: DataFrame, k: int, gain: str = "mmd", universe: DataFrame | None = None,
                  ridge: float = 0.0, batch: int = 256) -> DataFrame:
    """The ``k`` items of the largest gains, one by one: ``(step, id, gain)``.

    ``items(id, vector)``; ``gain`` is one of ``CLOSED_GAINS`` with all items as the universe, ``nn``
    (nearest neighbours of ``universe``, all items by default) or ``logdet`` (variance that
    the selection leaves). Ties go to the smaller id; ``batch`` is that of ``lazy_greedy``.
    """
    if gain in CLOSED_GAINS:
        return greedy_select_by_class(items.withColumn("class", F.lit(0)), k, 0.0, gain=gain).drop("class")
    items = settle(items.select("id", "vector"), "items")
    if gain == "nn":
        covered = items if universe is None else settle(universe.select("id", "vector"), "universe")
        # the first pick starts the coverage, so bounds begin with the second
        return lazy_greedy(items, k, lambda rows, selected: gain_nn(rows, covered, selected), batch, whole_steps=2)
    if gain == "logdet":
        return lazy_greedy(items, k, lambda rows, selected: gain_logdet(rows, selected, ridge=ridge), batch)
    raise ValueError(f"unknown gain {gain}")


def lazy_greedy(items: DataFrame, k: int, evaluate: Callable[[DataFrame, DataFrame], DataFrame],
                batch: int = 256, whole_steps: int = 1, digits: int = 12) -> DataFrame:
    """Greedy selection by gains that only fall as the selection grows: ``(step, id, gain)``.

    ``evaluate(rows, selected)`` gives ``(id, gain)`` of the rows that are not selected; ``rows``
    hold the selected ones too. A gain found before is an upper bound of what it is now. So a step
    evaluates anew the ``batch`` items of the largest bounds, and if an item not yet evaluated might
    still win, sixteen times as many; after that all items are evaluated in one pass, however
    many might win. The first ``whole_steps`` steps evaluate all items at once, and
    from the last of them on gains must fall. The driver sees at most 17 batches of items a step.
    """
    spark, kind = items.sparkSession, items.schema["id"].dataType.simpleString()

    def among(ids: list) -> DataFrame:
        named = spark.createDataFrame([(i,) for i in ids], f"id {kind}")
        return items.join(F.broadcast(named), "id", "left_semi")    # as many as some batches and a selection

    def chosen_ids() -> DataFrame:
        return spark.createDataFrame([(i,) for _, i, _ in chosen], f"id {kind}")

    chosen: list[tuple] = []
    renewed: dict = {}                  # id -> bound, of items evaluated again since all were

    def best_bounds(n: int) -> list[tuple]:
        taken = {i for _, i, _ in chosen}
        fresh = first.orderBy("loss", "id").limit(n + len(renewed) + len(taken)).collect()
        rest = [(r.loss, r.id) for r in fresh if r.id not in renewed and r.id not in taken][:n]
        return sorted(rest + [(loss, i) for i, loss in renewed.items() if i not in taken])

    for step in range(1, k + 1):
        now: dict = {}                  # evaluated against the selection as it stands
        best = None
        for asked_for in ([] if step <= whole_steps else [batch, 16 * batch]):
            stale = [b for b in best_bounds(asked_for) if b[1] not in now]
            if stale and (best is None or best > stale[0]):
                asked = [i for _, i in stale[:asked_for]]
                found = evaluate(among(asked + [i for _, i, _ in chosen]), chosen_ids()).collect()
                now.update({r["id"]: -round(r["gain"], digits) + 0.0 for r in found})
                renewed.update(now)
                best = min(((loss, i) for i, loss in now.items()), default=None)
        left = [] if step <= whole_steps else [b for b in best_bounds(1) if b[1] not in now]
        if step <= whole_steps or (left and (best is None or best > left[0])):
            loss = (-F.round("gain", digits) + F.lit(0.0)).alias("loss")
            first = settle(evaluate(items, chosen_ids()).select("id", loss), "bounds")
            renewed.clear()
            best = next(iter(best_bounds(1)), None)
        if best is None:
            break
        chosen.append((step, best[1], -best[0]))
    return spark.createDataFrame(chosen, f"step bigint, id {kind}, gain double")


def class_complement(items: DataFrame, members: DataFrame) -> DataFrame:
    """Items outside the class."""
    return items.join(members.select("id"), "id", "left_anti")


def contrastive_representation(features: DataFrame, k: int = 5, weight: float = 0.1,
                               compat: bool = False) -> DataFrame:
    """Top representative and contrastive features per cluster.

    ``features(cluster_label, feature, vector)``: one row per distinct feature of
    a cluster, noise left out here. ``compat`` counts the features of cluster 0
    twice in the complement. Returns ``(cluster_label, step, feature, gain)``.
    """
    items = (features.filter("cluster_label <> -1")
             .select(F.col("feature").alias("id"), F.col("cluster_label").alias("class"), "vector"))
    chosen = greedy_select_by_class(items, k, weight, 0 if compat else None)
    return chosen.select(F.col("class").alias("cluster_label"), "step",
                         F.col("id").alias("feature"), "gain")


def farthest_first_seeds(items: DataFrame, n: int, first) -> DataFrame:
    """Seeds: ``first``, then always the item farthest from the chosen ones:
    ``(seed, id)``. Ties go to the smaller id."""
    rows = settle(items.select("id", "vector"), "points")
    latest = rows.filter(F.col("id") == first).first()
    chosen = [(1, latest["id"])]
    far = rows.withColumn("far", F.lit(float("inf")))
    for seed in range(2, n + 1):
        at = F.lit([float(x) for x in latest["vector"]])
        gap = F.round(norm(F.zip_with(F.col("vector"), at, lambda x, y: x - y)), 9)
        far = settle(far.withColumn("far", F.least("far", gap)), "far")
        latest = far.agg(F.min(F.struct((-F.col("far")).alias("f"), "id", "vector")).alias("b")).select(
            "b.id", "b.vector").first()
        chosen.append((seed, latest["id"]))
    kind = items.schema["id"].dataType.simpleString()
    return items.sparkSession.createDataFrame(chosen, f"seed bigint, id {kind}")
