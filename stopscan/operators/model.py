"""The readthrough model: grouped binomial fits on cells, prediction, scoring, cross-validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.functions.binomial import (
    BASELINE_TERMS,
    FACTORS,
    MODELS,
    CellFit,
    Terms,
    fit_cells,
    squared_correlation,
)
from stopscan.functions.fixed import ROUNDS, SUPPORT_STRATA
from stopscan.functions.scalars import half_even, met
from stopscan.operators.ranking import quantiles
from stopscan.operators.selection import in_round, taken_rounds
from stopscan.operators.wide_fits import evaluate_wide
from stopscan.session import cut_lineage

CELL = tuple(FACTORS.values())
KINETIC = ("k_up", "k_down")
#: Cells of one fit that one task holds; a fit of more adds its sums up over as many tasks as it needs.
TASK_CELLS = 100_000


def training_cells(features: DataFrame, keys: Sequence[str] = ("therapy_id",)) -> DataFrame:
    """Rows and summed response per stop and pair of triplets: at most 3 * 64 * 64 per group."""

    return features.groupBy(*keys, *CELL).agg(
        F.count(F.lit(1)).alias("n"), F.sum("RT_binomial").alias("y"))


def _schema(df: DataFrame, keys: Sequence[str], rest: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [rest])


def fit(features: DataFrame, keys: Sequence[str] = ("therapy_id",),
        terms: Terms = BASELINE_TERMS) -> DataFrame:
    """The fitted model as its prediction for every combination of levels it has seen."""

    cells = training_cells(features, keys)
    names = list(keys)

    def grid(rows: pd.DataFrame) -> pd.DataFrame:
        fitted = fit_cells(rows, rows["n"], rows["y"], terms)
        index = pd.MultiIndex.from_product(
            [fitted.levels[f] for f in FACTORS], names=list(CELL))
        out = index.to_frame(index=False)
        out["predicted"] = fitted.predict(out)
        for position, k in enumerate(names):
            out.insert(position, k, rows[k].iloc[0])
        return out

    return cells.groupBy(*keys).applyInPandas(grid, _schema(
        cells, keys, "stop_type string, up_123nt string, down_123nt string, predicted double"))


def coefficients(features: DataFrame, keys: Sequence[str] = ("therapy_id",),
                 terms: Terms = BASELINE_TERMS) -> DataFrame:
    """`(keys, term, estimate, converged)` for the identifiable columns."""

    cells = training_cells(features, keys)
    names = list(keys)

    def listed(rows: pd.DataFrame) -> pd.DataFrame:
        fitted = fit_cells(rows, rows["n"], rows["y"], terms)
        out = pd.DataFrame({"term": fitted.names, "estimate": fitted.beta,
                            "converged": fitted.converged})
        for position, k in enumerate(names):
            out.insert(position, k, rows[k].iloc[0])
        return out

    return cells.groupBy(*keys).applyInPandas(listed, _schema(
        cells, keys, "term string, estimate double, converged boolean"))


def relative_error(held_out: DataFrame, keys: Sequence[str] = ("therapy_id",),
                   quantile: float = 0.95) -> DataFrame:
    """The relative error a share of the held-out predictions falls within."""

    error = F.try_divide(F.abs(F.col("predicted") - F.col("observed")), F.col("predicted"))
    return quantiles(held_out.select(*keys, error.alias("_e")), keys, "_e", {"spread": quantile})


def score(contexts: DataFrame, model: DataFrame, spreads: DataFrame,
          biological_context: str = "HEK293T") -> DataFrame:
    """Every scoreable context under every therapy, with its interval, or marked missing.

    The model is a grid of at most 3 * 64 * 64 cells per therapy and the therapies a short list, so
    contexts meet a small side on a four-part key; unknown levels simply find no cell.
    """

    therapies = spreads.agg(F.sort_array(F.collect_set("therapy_id"))).scalar()
    rows = contexts.where("scoreable").withColumn("therapy_id", F.explode(therapies))
    joined = rows.join(model, ["therapy_id", *CELL], "left").join(
        spreads.select("therapy_id", "spread"), "therapy_id", "left")
    predicted, seen = F.col("predicted"), F.col("predicted").isNotNull()
    low = F.greatest(predicted * (1 - F.col("spread")), F.lit(0.0))
    return joined.select(
        *[c for c in ("variant_id", "gene_symbol", "transcript_id", "protein_position",
                      "stop_type") if c in joined.columns],
        "therapy_id", F.lit(biological_context).alias("biological_context"),
        predicted.alias("readthrough_predicted"),
        F.when(seen, low).alias("readthrough_low"),
        F.when(seen, predicted * (1 + F.col("spread"))).alias("readthrough_high"),
        F.when(seen, "present").otherwise("missing").alias("status"),
        F.when(seen, "").otherwise("not_available").alias("reason"),
        *[c for c in ("review_stars",) if c in joined.columns])


def fold_cells(marked: DataFrame, keys: Sequence[str] = ("therapy_id",),
               extra: Sequence[str] = (), rounds: int = ROUNDS) -> DataFrame:
    """Training and held-out counts of every cell in every round, from rows marked with their folds.

    One pass adds up a cell's rows in each round that its rows train in; no row is copied for a round.
    The held-out side is the whole cell less its training side.
    """

    pattern = [*CELL, *extra]
    y = F.col("RT_binomial")
    whole = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy")]
    train = [s.alias(f"_{n}{r}") for r in range(1, rounds + 1) for n, s in (
        ("n", F.count_if(in_round(r))), ("y", F.sum(F.when(in_round(r), y))),
        ("yy", F.sum(F.when(in_round(r), y * y))))]
    summed = marked.groupBy(*keys, *pattern).agg(*whole, *train)
    each = summed.select(*keys, *pattern, "n", "y", "yy", F.inline(F.array(*[F.struct(
        F.lit(r).alias("round"), F.col(f"_n{r}").alias("n_train"),
        F.coalesce(f"_y{r}", F.lit(0.0)).alias("y_train"),
        F.coalesce(f"_yy{r}", F.lit(0.0)).alias("_yy")) for r in range(1, rounds + 1)])))
    rest = F.col("n_train") < F.col("n")
    return each.select(
        *keys, "round", *pattern, "n_train", "y_train", (F.col("n") - F.col("n_train")).alias("n_test"),
        F.when(rest, F.col("y") - F.col("y_train")).otherwise(0.0).alias("y_test"),
        F.when(rest, F.col("yy") - F.col("_yy")).otherwise(0.0).alias("yy_test"))


def fit_fold(rows: pd.DataFrame, terms: Terms) -> tuple[pd.DataFrame, CellFit]:
    """One round's held-out cells whose levels were all seen, and the fit."""

    train = rows[rows["n_train"] > 0]
    fitted = fit_cells(train, train["n_train"], train["y_train"], terms)
    test = rows[(rows["n_test"] > 0)]
    test = test[fitted.known(test)]
    return test, fitted


def trains(rows: pd.DataFrame) -> bool:
    """Whether any row trains in the round; a key of one row may have none."""

    return bool((rows["n_train"] > 0).any())


def evaluate(cells: DataFrame, keys: Sequence[str] = ("therapy_id",),
             models: Mapping[str, Terms] | None = None, derived: bool = False) -> DataFrame:
    """(keys, round, model, r2, held_out, converged): each model on the rows each round left out.

    Cells of the three factors are at most 3 * 64 * 64 per round. Cells told apart by row-level kinetics
    have no such bound, so a round's cells are counted; where one task cannot hold them, every step of
    the same iteration is added up over several. `derived` says the kinetic columns are functions of
    the cell, which keeps the bound. `converged` is false where a fit stopped at its limit of steps.
    """

    wanted = dict(models or {"B": MODELS["B"]})
    names = [*keys, "round"]
    wide = None
    if set(KINETIC) & set(cells.columns) and not derived:
        cells = cut_lineage(cells)
        sizes = cells.groupBy(*names).count().where(F.col("count") > TASK_CELLS)
        largest = sizes.agg(F.max("count")).first()[0]
        if largest:
            large = sizes.select(*names)
            wide = evaluate_wide(cells.join(large, names, "left_semi"), names, wanted,
                                 -(-largest // TASK_CELLS))
            cells = cells.join(large, names, "left_anti")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for name, terms in wanted.items() if trains(rows) else ():
            test, fitted = fit_fold(rows, terms)
            n = test["n_test"].to_numpy(dtype=float)
            found.append({**{k: rows[k].iloc[0] for k in names}, "model": name,
                          "r2": squared_correlation(fitted.predict(test), n,
                                                    test["y_test"].to_numpy(),
                                                    test["yy_test"].to_numpy()),
                          "held_out": int(n.sum()), "converged": fitted.converged})
        return pd.DataFrame(found, columns=[*names, "model", "r2", "held_out", "converged"])

    # Counted partitions, which are not merged: a fit is small in bytes, but long work.
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = cells.repartition(parts, *names).groupBy(*names).applyInPandas(one, _schema(
        cells, names, "model string, r2 double, held_out bigint, converged boolean"))
    return near if wide is None else near.unionByName(wide)


def held_out_predictions(marked: DataFrame, keys: Sequence[str] = ("therapy_id",),
                         terms: Terms = BASELINE_TERMS, rounds: int = ROUNDS) -> DataFrame:
    """`(keys, round, row, predicted, observed)` for the rows each round left out."""

    cells = fold_cells(marked, keys, rounds=rounds)
    names = [*keys, "round"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        if not trains(rows):
            return rows[[*names, *CELL]].head(0).assign(predicted=0.0)
        test, fitted = fit_fold(rows, terms)
        out = test[[*names, *CELL]].copy()
        out["predicted"] = fitted.predict(test)
        return out

    grid = cells.groupBy(*names).applyInPandas(one, _schema(
        cells, [*names, *CELL], "predicted double"))
    left = marked.select(*keys, "row", *CELL, F.col("RT_binomial").alias("observed"), F.explode(
        taken_rounds(rounds, taken=False)).alias("round"))
    return left.join(grid, [*names, *CELL]).select(*names, "row", "predicted", "observed")


def r_squared(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Squared Pearson correlation of predicted and observed rows per group."""

    return predictions.groupBy(*keys).agg(
        F.pow(F.corr("predicted", "observed"), F.lit(2.0)).alias("r2"),
        F.count(F.lit(1)).alias("held_out"))


def weighted_median(values: pd.Series, weights: pd.Series) -> float:
    """Median of the positive values, each counted `weights` times."""

    held = pd.DataFrame({"v": values, "w": weights})
    held = held[(held["v"] > 0) & (held["w"] > 0)].sort_values("v")
    upto, total = held["w"].cumsum().to_numpy(), int(held["w"].sum())
    middle = [held["v"].iloc[(upto > at).argmax()] for at in ((total - 1) // 2, total // 2)]
    return sum(middle) / 2.0


def stratified_gain(cells: DataFrame, keys: Sequence[str] = ("therapy_id",),
                    models: Mapping[str, Terms] | None = None) -> DataFrame:
    """Held-out r squared within each support stratum of each round.

    The stratum of a row is how many training rows its stop-by-downstream cell holds, against the
    median over rows whose cell holds any. Strata with under three held-out rows are left out.
    """

    wanted = dict(models or {m: MODELS[m] for m in ("B", "K1")})
    names = [*keys, "round"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        support = rows.groupby(["stop_type", "down_123nt"])["n_train"].transform("sum")
        median = weighted_median(support, rows["n_train"] + rows["n_test"])
        unsupported, thin, supported = SUPPORT_STRATA
        strata = pd.Series(supported, index=rows.index)
        strata[support < median] = thin
        strata[support == 0] = unsupported
        found = []
        for name, terms in wanted.items() if trains(rows) else ():
            test, fitted = fit_fold(rows, terms)
            predicted = fitted.predict(test)
            inside = strata.reindex(test.index).to_numpy()
            for stratum in SUPPORT_STRATA:
                at = inside == stratum
                n = test["n_test"].to_numpy(dtype=float)[at]
                if n.sum() < 3:
                    continue
                found.append({**{k: rows[k].iloc[0] for k in names}, "model": name,
                              "support": stratum, "r2": squared_correlation(
                                  predicted[at], n, test["y_test"].to_numpy()[at],
                                  test["yy_test"].to_numpy()[at]), "held_out": int(n.sum())})
        return pd.DataFrame(found, columns=[*names, "model", "support", "r2", "held_out"])

    return cells.groupBy(*names).applyInPandas(one, _schema(
        cells, names, "model string, support string, r2 double, held_out bigint"))


def model_parity(metrics: DataFrame, reliability: DataFrame) -> DataFrame:
    """Mean and spread of r squared per drug beside the ceiling its replicates set."""

    rounds = metrics.groupBy("drug").agg(
        half_even(F.avg("r2")).alias("r2_mean"), half_even(F.stddev_samp("r2")).alias("r2_sd"),
        F.count(F.lit(1)).alias("rounds"))
    ceilings = reliability.select(F.col("treatment").alias("drug"),
                                  half_even(F.col("ceiling")).alias("ceiling"))
    return rounds.join(ceilings, "drug", "left")


def reliability(samples: DataFrame) -> DataFrame:
    """Replicate correlation per treatment and the ceiling it sets (Spearman-Brown).

    One row per treatment and identifier is formed first; rows lacking a replicate or the merged
    response are left out. A replicate given twice, a merged response that differs between the
    replicates, and merged responses that are no rescaled mean of the replicates are errors.
    """

    def check(broken: Column, what: str) -> Column:
        return F.when(broken, F.raise_error(F.concat_ws(
            " ", F.lit(what), "treatment", F.col("identifier").cast("string"))))

    def rep(k: int) -> Column:
        here = F.col("replicate") == k
        return F.coalesce(check(F.count_if(here) > 1, f"replicate {k} repeated in"),
                          F.max(F.when(here, F.col("fitness_rep"))))

    both = F.when(F.col("replicate").isin(1, 2), F.col("RT_binomial"))
    apart = F.max(both) - F.min(both) > 1.5e-8 * F.abs(F.max(both))
    merged = F.coalesce(check(apart, "merged responses differ in"),
                        F.max(F.when(F.col("replicate") == 1, F.col("RT_binomial"))))
    wide = samples.groupBy("treatment", "identifier").agg(
        rep(1).alias("rep1"), rep(2).alias("rep2"), merged.alias("merged")
    ).where("rep1 is not null and rep2 is not null and merged is not null")
    single = F.corr("rep1", "rep2")
    agreement = wide.agg(F.corr((F.col("rep1") + F.col("rep2")) / 2, "merged")).scalar()
    mean = F.when(~met(F.abs(agreement) > 1 - 1e-6), F.raise_error(F.lit(
        "merged responses are not the mean of their replicates")))
    return wide.groupBy("treatment").agg(
        F.count(F.lit(1)).alias("variants"), single.alias("r")
    ).withColumn("r", F.coalesce(mean, "r")).select("treatment", "variants", "r", (F.col("r") * F.col("r")).alias("single_replicate"),
             (2 * F.col("r") / (1 + F.col("r"))).alias("ceiling"))


def eligible_labels(samples: DataFrame, drug: str | None = None) -> DataFrame:
    """The second replicate's adequately covered, non-viral, measured labels."""

    kept = samples.where((F.col("replicate") == 2) & (F.col("reads_allbins") > 15)
                         & (F.col("viral") == "no") & F.col("RT").isNotNull())
    return kept if drug is None else kept.where(F.col("treatment") == drug)


def reporter_offsets(measured: DataFrame, longest: int) -> DataFrame:
    """The 1-based offsets at which the nine-base motif matches in every measured row."""

    motif = F.translate(F.lower(F.concat("up_123nt", "stop_type", "down_123nt")), "u", "t")
    rows = measured.select(F.lower("nt_seq").alias("s"), motif.alias("m"))
    tests = [F.bool_and(F.substring("s", k, 9) == F.col("m")).alias(f"o{k}")
             for k in range(1, longest - 7)]
    checked = rows.agg(*tests, F.min(F.length("s")).alias("shortest"))
    return checked.select("shortest", F.inline(F.array(*[
        F.struct(F.lit(k).alias("offset"), F.col(f"o{k}").alias("matches"))
        for k in range(1, longest - 7)]))).where(
        F.col("matches") & (F.col("offset") <= F.col("shortest") - 8)).select("offset")
