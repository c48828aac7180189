"""The steps of a fit, added up over tasks: for fits with more cells than one task should hold.

The iteration is that of `functions.binomial`. Tasks add up the cross products of their own cells, the
sums meet per fit, and coefficients go out for the next step; columns that depend on earlier ones are
found from the triangular factors of the parts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopscan.functions.binomial import (
    FACTORS,
    CellFit,
    Progress,
    Terms,
    design,
    independent,
    normal_sums,
    triangle,
)
from stopscan.session import cut_lineage

#: Fits whose coefficients (some 300 numbers each) are on the driver at one time.
FITS_AT_ONCE = 1000


def _met(cells: DataFrame, keys: Sequence[str], of_part: Callable, join: Callable, found: Callable,
         rest: str) -> list:
    """`found(key, joined)` per fit, where `of_part(key, rows)` is the array of a part of its cells.

    Cells lie sorted by fit, so a task sends one array for each fit it holds. A fit has at most
    3 * 64 * 64 * 61 * 61 cells, 460 tasks of them, whose arrays (half a MB) meet in one.
    """

    names = list(keys)
    kinds = dict(cells.dtypes)
    prefix = [f"`{k}` {kinds[k]}" for k in names]

    def row(key, sums) -> pd.DataFrame:
        return pd.DataFrame([[*key, len(sums), sums.tobytes()]], columns=[*names, "size", "sums"])

    def partial(batches):
        held = None
        for batch in batches:
            for key, rows in batch.groupby(names, sort=False):
                part = of_part(tuple(key), rows)
                if part is None:
                    continue
                if held is not None and held[0] == key:
                    held = key, join(held[1], part)
                    continue
                if held is not None:
                    yield row(*held)
                held = key, part
        if held is not None:
            yield row(*held)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for size, sums in zip(rows["size"], rows["sums"]):
            part = np.frombuffer(sums).reshape(size, -1)
            total = part if total is None else join(total, part)
        key = tuple(rows[k].iloc[0] for k in names)
        return pd.DataFrame([[*key, *found(key, total)]])

    parts = cells.mapInPandas(partial, ", ".join([*prefix, "size bigint", "sums binary"]))
    return parts.groupBy(*names).applyInPandas(meet, ", ".join([*prefix, rest])).collect()


def fit_wide(cells: DataFrame, keys: Sequence[str], terms: Terms) -> dict[tuple, CellFit]:
    """One fit per key of `cells`, which is written and sorted by key; at most FITS_AT_ONCE keys.

    Collected are levels, columns and cross products' solutions: about 130 names and 300 numbers a fit.
    """

    train, context = cells.where("n_train > 0"), cells.sparkSession.sparkContext
    listed = train.groupBy(*keys).agg(*[
        F.sort_array(F.collect_set(c)).alias(f) for f, c in FACTORS.items()]).collect()
    levels = {tuple(r[k] for k in keys): {f: list(r[f]) for f in FACTORS} for r in listed}

    def factor(key, rows):
        return triangle(design(rows, terms, levels[key]), rows["n_train"].to_numpy(dtype=float))

    columns = _met(train, keys, factor, lambda a, b: np.linalg.qr(np.vstack([a, b]), mode="r"),
                   lambda _, r: [independent(r).tolist()], "kept array<int>")
    kept = {tuple(r[k] for k in keys): np.array(r.kept, dtype=int) for r in columns}
    at = {key: Progress() for key in kept}
    while open_ := {key: p for key, p in at.items() if not p.done}:
        state = context.broadcast(open_)

        def sums(key, rows, state=state):
            if key not in state.value:
                return None
            matrix = design(rows, terms, levels[key]).kept(kept[key])
            n = rows["n_train"].to_numpy(dtype=float)
            y = np.clip(rows["y_train"].to_numpy(dtype=float) / n, 0.0, 1.0)
            return normal_sums(matrix, n, y, state.value[key].beta)[None, :]

        def step(key, total, state=state):
            p = state.value[key].after(total.ravel())
            return [p.beta.tolist(), p.deviance, p.steps, p.done, p.converged]

        for row in _met(train, keys, sums, np.add, step, "beta array<double>, deviance double, "
                        "steps int, done boolean, converged boolean"):
            key = tuple(row[k] for k in keys)
            at[key] = Progress(np.array(row.beta), row.deviance, row.steps, row.done, row.converged)
    return {key: CellFit(terms, levels[key], kept[key], [], p.beta, p.converged)
            for key, p in at.items()}


def evaluate_wide(cells: DataFrame, keys: Sequence[str], models: Mapping[str, Terms],
                  lanes: int) -> DataFrame:
    """Held-out r squared per key and model, each fit's cells spread over `lanes` tasks."""

    names = list(keys)
    lane = F.pmod(F.xxhash64(*[c for c in cells.columns if c not in names]), F.lit(lanes))
    cells = cells.withColumn("_lane", lane).repartition(*names, "_lane").sortWithinPartitions(
        *names).drop("_lane")
    fits = cells.select(*names).distinct().count()
    turns = max(1, -(-fits // FITS_AT_ONCE))
    out = None
    for turn in range(turns):
        own = cut_lineage(cells.where(F.pmod(F.xxhash64(*names), F.lit(turns)) == turn))
        for model, terms in models.items():
            scored = _scored(own, names, model, fit_wide(own, names, terms))
            out = scored if out is None else out.unionByName(scored)
    return out


def _scored(cells: DataFrame, names: Sequence[str], model: str, fits: Mapping) -> DataFrame:
    state = cells.sparkSession.sparkContext.broadcast(dict(fits))
    kinds = dict(cells.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in names]
                       + ["n double, p double, y double, yy double, converged boolean"])

    def predicted(batches):
        for batch in batches:
            for key, rows in batch.groupby(names, sort=False):
                fitted = state.value.get(tuple(key))
                rows = rows[fitted.known(rows)] if fitted else rows.head(0)
                if len(rows):
                    yield rows[names].assign(
                        n=rows["n_test"].astype(float), p=fitted.predict(rows), y=rows["y_test"],
                        yy=rows["yy_test"], converged=fitted.converged)

    held = cells.where("n_test > 0").mapInPandas(predicted, schema)
    n, p, y, yy = (F.col(c) for c in ("n", "p", "y", "yy"))
    total = held.groupBy(*names).agg(
        F.sum(n).alias("n"), F.sum(n * p).alias("sp"), F.sum(n * p * p).alias("spp"),
        F.sum(p * y).alias("spy"), F.sum(y).alias("sy"), F.sum(yy).alias("syy"),
        F.bool_and("converged").alias("converged"))
    cross = F.col("spy") - F.col("sp") * F.col("sy") / n
    vp = F.col("spp") - F.col("sp") * F.col("sp") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    # As in a fit of one task: no correlation where predictions or responses do not vary.
    flat = (n < 2) | (vp <= 1e-15 * n) | (vy <= 0)
    return total.select(
        *names, F.lit(model).alias("model"),
        F.when(flat, F.lit(float("nan"))).otherwise(cross * cross / (vp * vy)).alias("r2"),
        n.cast("bigint").alias("held_out"), "converged")
