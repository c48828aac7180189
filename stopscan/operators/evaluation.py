"""Named splits from a seed, and the controls a gain has to survive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopscan.functions.fixed import ROUNDS, SEED, TRAIN_FRACTION
from stopscan.operators.ranking import quantiles
from stopscan.operators.resampling import bootstrap_mean_ci
from stopscan.operators.selection import cut_digests, round_marks, taken_rounds, with_cuts
from stopscan.session import cut_lineage

#: Bits of a row's fold marks.
MOST_ROUNDS = 62
SPLITTERS: dict[str, tuple[str, ...]] = {
    "published_random_cv": ("row",),
    "grouped_by_gene": ("gene",),
    "grouped_by_sequence_cluster": ("up_123nt", "down_123nt"),
}
"""The columns of a unit: rows that agree in them fall on the same side of every round."""


def mark_folds(features: DataFrame, config: str, keys: Sequence[str] = ("therapy_id",),
               rounds: int = ROUNDS, fraction: float = TRAIN_FRACTION, seed: int = SEED) -> DataFrame:
    """`features` with `folds`, a bit for every round in which the row trains.

    The groups a split keeps together are ordered by a hash of seed, round and group; the first
    fraction of them trains. Which rows train is therefore the same on every run and cluster, and no
    row is copied or moved for a round: each compares its own hashes with the cuts of its key.
    """

    if config not in SPLITTERS:
        raise ValueError(f"{config} has no splitter; supported: {', '.join(sorted(SPLITTERS))}")
    if rounds > MOST_ROUNDS:
        raise ValueError(f"{rounds} rounds do not fit one number; at most {MOST_ROUNDS}")
    together = SPLITTERS[config]
    grouped = features.withColumn("_group", F.concat_ws(
        "|", *[F.col(c).cast("string") for c in together]))
    units = grouped.select(*keys, "_group")
    # A row number stands in one row already.
    units = cut_lineage(units if together == ("row",) else units.distinct(), name="units")
    cuts = cut_digests(units, keys, "_group", lambda n: F.floor(n * F.lit(fraction)), rounds, seed)
    return with_cuts(grouped, cuts, keys).withColumn(
        "folds", round_marks(F.col("cuts"), F.col("_group"), rounds, seed)).drop("_group", "cuts")


def training_rows(marked: DataFrame, keys: Sequence[str], rounds: int) -> DataFrame:
    """Training rows `(keys, round, row)` of each round."""

    return marked.select(*keys, F.explode(taken_rounds(rounds)).alias("round"), "row")


def split(features: DataFrame, config: str, keys: Sequence[str] = ("therapy_id",),
          rounds: int = ROUNDS, fraction: float = TRAIN_FRACTION, seed: int = SEED) -> DataFrame:
    """Training rows `(keys, round, row)` of each round of a named split."""

    return training_rows(mark_folds(features, config, keys, rounds, fraction, seed), keys, rounds)


def stratified_partitions(features: DataFrame, keys: Sequence[str] = ("therapy_id",),
                          rounds: int = ROUNDS, fraction: float = TRAIN_FRACTION,
                          strata: int = 5, seed: int = SEED) -> DataFrame:
    """Training rows drawn inside response quantile groups, a ceiling share of each."""

    cuts = quantiles(features, keys, "RT_binomial",
                     {f"q{i}": i / strata for i in range(1, strata)})
    placed = cut_lineage(features.join(cuts, list(keys)).select(*keys, "row", sum(
        (F.when(F.col("RT_binomial") > F.col(f"q{i}"), 1).otherwise(0)
         for i in range(2, strata)),
        F.when(F.col("RT_binomial") > F.col("q1"), 1).otherwise(0)).alias("_stratum"),
        F.col("row").cast("string").alias("_group")), name="strata")
    group = [*keys, "_stratum"]
    taken = cut_digests(placed, group, "_group", lambda n: F.ceil(n * F.lit(fraction)), rounds, seed)
    marked = with_cuts(placed, taken, group).withColumn(
        "folds", round_marks(F.col("cuts"), F.col("_group"), rounds, seed))
    return training_rows(marked, keys, rounds)


def improvement(scored: DataFrame, keys: Sequence[str], baseline: str = "B") -> DataFrame:
    """Each model's gain over the baseline within its own round."""

    base = scored.where(F.col("model") == baseline).select(
        *keys, "round", F.col("r2").alias("_base"))
    return scored.where(F.col("model") != baseline).join(base, [*keys, "round"]).select(
        *keys, "round", "model", (F.col("r2") - F.col("_base")).alias("gain"))


def worst_case(gains: DataFrame, draws: int = 9999, seed: int = SEED) -> DataFrame:
    """The drug with the largest mean gain, and that gain's interval over its rounds; one row."""

    means = gains.groupBy("drug").agg(F.avg("gain").alias("mean"))
    worst = means.agg(F.min_by("drug", F.struct(-F.col("mean"), "drug")).alias("drug"))
    chosen = gains.join(worst, "drug")
    return bootstrap_mean_ci(chosen, ["drug"], ["round"], "gain", draws, seed).select(
        "drug", F.col("point").alias("gain"), "ci_low", "ci_high", "includes_zero")


def leakage(random: DataFrame, grouped: DataFrame) -> DataFrame:
    """What the random split gains over the grouped one, round by round."""

    return random.select("drug", "round", F.col("gain").alias("_r")).join(
        grouped.select("drug", "round", F.col("gain").alias("_g")), ["drug", "round"]
    ).select("drug", "round", (F.col("_r") - F.col("_g")).alias("gain"))


def control_outcomes(unshuffled: DataFrame, shuffled: dict[str, DataFrame],
                     random: DataFrame, draws: int = 9999) -> DataFrame:
    """The grouped gain, every shuffle's worst case, and the leakage, one row each."""

    def row(control: str, gains: DataFrame, drug=None) -> DataFrame:
        found = worst_case(gains, draws)
        return found.select(F.lit(control).alias("control"),
                            (F.col("drug") if drug is None else F.lit(drug)).alias("drug"),
                            "gain", "ci_low", "ci_high", "includes_zero")

    out = row("grouped_gain", unshuffled)
    for kind, gains in shuffled.items():
        out = out.unionByName(row(kind, gains, "worst case"))
    return out.unionByName(row("grouped_split_leakage", leakage(random, unshuffled),
                               "worst case"))


def passing_rule(intervals: DataFrame) -> DataFrame:
    """The three conditions of a supported claim, and the names of those that fail.

    Rows carry a gain with its interval, whether every shuffle interval includes zero, how many
    shuffles there were, and whether the gain is confined to unsupported cells.
    """

    excludes = (F.col("gain") > 0) & ~(
        (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))
    collapse = (F.col("shuffles") > 0) & F.col("all_shuffles_include_zero")
    survives = ~F.col("confined_to_unsupported")
    held = {"gain_excludes_zero": excludes, "shuffles_collapse": collapse,
            "survives_support": survives}
    failures = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in held.items()]))
    return intervals.select(
        "*", *[c.alias(n) for n, c in held.items()],
        (excludes & collapse & survives).alias("supported"),
        F.array_join(failures, ";").alias("failures"))


def head_to_head_intervals(scored: DataFrame, reliability: DataFrame,
                           draws: int = 9999) -> DataFrame:
    """Each model's mean gain with its interval, against the room left under the ceiling."""

    keys = ["drug", "shuffle"]
    gains = improvement(scored, keys)
    spread = bootstrap_mean_ci(gains, [*keys, "model"], ["round"], "gain", draws)
    base = scored.where("model = 'B'").groupBy(*keys).agg(F.avg("r2").alias("baseline_r2"))
    joined = spread.join(base, keys).join(
        reliability.select(F.col("treatment").alias("drug"), "ceiling"), "drug", "left")
    headroom = F.col("ceiling") - F.col("baseline_r2")
    return joined.select(
        *keys, "model", F.col("point").alias("gain"), "ci_low", "ci_high",
        (~F.col("includes_zero")).alias("excludes_zero"), "baseline_r2", "ceiling",
        headroom.alias("headroom"),
        F.try_divide(F.col("point"), headroom).alias("share_of_headroom"))
