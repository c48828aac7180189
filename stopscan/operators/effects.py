"""Treated against control: paired and unpaired effects, the signature, and the contrast itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopscan.functions.fixed import CONFIDENCE, QUANTITIES
from stopscan.functions.scalars import t_quantile

UPPER = 1.0 - (1.0 - CONFIDENCE) / 2.0


def arms_of(runs: DataFrame, dataset: str) -> DataFrame:
    """Each footprint library of a dataset with its treatment and replicate."""

    return runs.where((F.col("assay") == "riboseq") & (F.col("dataset") == dataset)).select(
        "sample", "treatment", "replicate")


def libraries_without_counts(arms: DataFrame, counts: DataFrame) -> DataFrame:
    """Libraries named for a contrast but absent from the counts; must be empty."""

    return arms.select("sample").distinct().join(counts, "sample", "left_anti")


def treated_libraries(counts: DataFrame, arms: DataFrame, control: str) -> DataFrame:
    """Libraries a control-only feature may not be built from: unnamed, or treated."""

    return counts.select("sample").distinct().join(arms, "sample", "left").where(
        F.col("treatment").isNull() | (F.col("treatment") != control)).select("sample", "treatment")


def repeated_samples(df: DataFrame) -> DataFrame:
    """Samples that break a one-to-one join; must be empty."""

    return df.groupBy("sample").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def long_quantities(ratios: DataFrame, arms: DataFrame,
                    quantities: Sequence[str] = QUANTITIES) -> DataFrame:
    """One row per library and quantity, with its arm; libraries are tens of rows."""

    joined = ratios.join(arms.select("sample", "treatment", "replicate"), "sample")
    return joined.select("sample", "treatment", "replicate", *quantities).unpivot(
        ["sample", "treatment", "replicate"], list(quantities), "quantity", "value")


def unpaired_effects(ratios: DataFrame, arms: DataFrame, treated: str, control: str,
                     quantities: Sequence[str] = QUANTITIES) -> DataFrame:
    """Mean difference with a Welch interval, and whether the arms separate completely."""

    long = long_quantities(ratios, arms, quantities)

    def arm(name: str, fn, label: str):
        return fn(F.when(F.col("treatment") == name, F.col("value"))).alias(label)

    stats = []
    for name, tag in ((treated, "a"), (control, "b")):
        stats += [arm(name, F.avg, f"mean_{tag}"), arm(name, F.var_samp, f"var_{tag}"),
                  arm(name, F.count, f"n_{tag}"), arm(name, F.min, f"min_{tag}"),
                  arm(name, F.max, f"max_{tag}")]
    wide = long.groupBy("quantity").agg(*stats)
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    error = F.sqrt(va + vb)
    free = F.try_divide(
        F.pow(va + vb, 2.0), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    sized = wide.select(
        "quantity", (F.col("mean_a") - F.col("mean_b")).alias("mean_difference"),
        F.when(enough, error).alias("error"),
        F.when(enough & (error > 0), F.greatest(F.lit(1.0), F.floor(free))).alias("df"),
        ((F.col("min_a") > F.col("max_b")) | (F.col("max_a") < F.col("min_b")))
        .alias("consistent"), "n_a", "n_b")
    half = F.when(F.col("error") == 0, F.lit(0.0)).otherwise(
        t_quantile(UPPER, F.col("df")) * F.col("error"))
    return sized.select(
        "quantity", "mean_difference", (F.col("mean_difference") - half).alias("ci_low"),
        (F.col("mean_difference") + half).alias("ci_high"), "consistent",
        F.col("n_a").alias("n_treated"), F.col("n_b").alias("n_control"))


def replicate_pairs(ratios: DataFrame, arms: DataFrame, treated: str, control: str,
                    quantities: Sequence[str] = QUANTITIES) -> DataFrame:
    """Per quantity and replicate: the two values, their difference and ratio."""

    def value(name: str):
        return F.max(F.when(F.col("treatment") == name, F.col("value")))

    long = long_quantities(ratios, arms, quantities)
    return long.groupBy("quantity", "replicate").agg(
        value(treated).alias("treated"), value(control).alias("control")
    ).select("*", (F.col("treated") - F.col("control")).alias("difference"),
             F.try_divide("treated", "control").alias("ratio"))


def paired_effects(ratios: DataFrame, arms: DataFrame, treated: str, control: str,
                   quantities: Sequence[str] = QUANTITIES) -> DataFrame:
    """Mean within-replicate difference with a t interval, and whether all moved the same way.

    A replicate without both arms makes its quantity's effect null instead of shrinking the design.
    """

    pairs = replicate_pairs(ratios, arms, treated, control, quantities)
    stats = pairs.groupBy("quantity").agg(
        F.avg("difference").alias("mean"), F.stddev_samp("difference").alias("sd"),
        F.count("difference").alias("n"), F.count(F.lit(1)).alias("replicates"),
        F.min("difference").alias("low"), F.max("difference").alias("high"))
    whole = F.col("n") == F.col("replicates")
    half = F.when(whole & (F.col("n") >= 2), t_quantile(
        UPPER, (F.col("n") - 1)) * F.col("sd") / F.sqrt("n"))
    mean = F.when(whole, F.col("mean"))
    return stats.select(
        "quantity", mean.alias("mean_difference"), (mean - half).alias("ci_low"),
        (mean + half).alias("ci_high"),
        F.when(whole, (F.col("low") > 0) | (F.col("high") < 0)).alias("consistent"),
        F.col("n").alias("replicates"))


def signature(effects: DataFrame) -> DataFrame:
    """The three conditions, the stalling verdict and arm separation of one contrast; one row."""

    def of(quantity: str, column: str):
        return F.max(F.when(F.col("quantity") == quantity, F.col(column)))

    down, term, gap = QUANTITIES
    rose = (of(down, "mean_difference") > 0) & of(down, "consistent")
    fell = (of(term, "mean_difference") < 0) & of(term, "consistent")
    moved = (of(gap, "mean_difference") > 0) & of(gap, "consistent") & (of(gap, "ci_low") > 0)
    stalled = (of(term, "mean_difference") >= 0) & (of(down, "mean_difference") <= 0)
    no = F.lit(False)
    return effects.agg(
        F.coalesce(rose, no).alias("downstream_rose"),
        F.coalesce(fell, no).alias("termination_fell"),
        F.coalesce(moved, no).alias("frame_moved_to_coding"),
        F.coalesce(rose & fell & moved, no).alias("complete"),
        F.coalesce(stalled, no).alias("stalling"),
        F.coalesce(of(term, "consistent"), no).alias("termination_arms_separate"))
