"""Counting errors, their intervals, and the sample sizes and depths a target difference needs."""

from __future__ import annotations

import math
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.functions.fixed import (
    CDS_FRAMES,
    EXTENSION_FRAMES,
    MAXIMUM_REPLICATES,
    POWER,
    QUANTITIES,
)
from stopscan.functions.scalars import t_quantile, t_quantile_value
from stopscan.operators.effects import UPPER, long_quantities
from stopscan.operators.resampling import bootstrap_sums

SUMMED = (*CDS_FRAMES, *EXTENSION_FRAMES, "termination")


def counting_error(counts: DataFrame) -> DataFrame:
    """Per library and quantity, the error its finite counts alone impose."""

    pooled = counts.groupBy("sample").agg(*[F.sum(c).alias(c) for c in SUMMED])

    def floored(c: Column) -> Column:
        return F.greatest(c.cast("double"), F.lit(1.0))

    def ratio_error(top: str) -> Column:
        lower, safe = floored(F.col(top)), floored(F.col("cds_frame0"))
        return lower / safe * F.sqrt(1.0 / lower + 1.0 / safe)

    def share_variance(part: str, frames: tuple[str, ...]) -> Column:
        whole = floored(sum((F.col(c) for c in frames[1:]), F.col(frames[0])))
        share = F.col(part) / whole
        return share * (1.0 - share) / whole

    gap = F.sqrt(share_variance("extension_frame0", EXTENSION_FRAMES)
                 + share_variance("cds_frame0", CDS_FRAMES))
    return pooled.select(
        "sample", ratio_error("extension_frame0").alias(QUANTITIES[0]),
        ratio_error("termination").alias(QUANTITIES[1]), gap.alias(QUANTITIES[2]))


def bootstrap_intervals(counts: DataFrame, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Per library and quantity, the spread of its value over resampled transcripts."""

    sums = bootstrap_sums(counts.select("sample", "transcript", *SUMMED), ["sample"],
                          ["transcript"], SUMMED, draws, seed)
    extension = sum((F.col(c) for c in EXTENSION_FRAMES[1:]), F.col(EXTENSION_FRAMES[0]))
    coding = sum((F.col(c) for c in CDS_FRAMES[1:]), F.col(CDS_FRAMES[0]))
    values = sums.select(
        "sample", F.try_divide("extension_frame0", "cds_frame0").alias(QUANTITIES[0]),
        F.try_divide("termination", "cds_frame0").alias(QUANTITIES[1]),
        (F.try_divide(F.col("extension_frame0"), extension)
         - F.try_divide(F.col("cds_frame0"), coding)).alias(QUANTITIES[2]))
    long = values.unpivot(["sample"], list(QUANTITIES), "quantity", "value")
    return long.groupBy("sample", "quantity").agg(
        F.percentile("value", 0.025).alias("bootstrap_low"),
        F.percentile("value", 0.975).alias("bootstrap_high"),
        F.stddev_samp("value").alias("bootstrap_se"))


def _targets(targets: Mapping[str, float]) -> Column:
    if missing := [q for q in QUANTITIES if q not in targets]:
        raise ValueError(f"targets lack {', '.join(missing)}")
    return F.create_map(*[F.lit(x) for q in QUANTITIES for x in (q, float(targets[q]))])


def detectability(ratios: DataFrame, counting: DataFrame, arms: DataFrame, treated: str,
                  control: str, targets: Mapping[str, float]) -> DataFrame:
    """Per quantity: the smallest resolvable effect, its floor, and what would reach the target.

    The variance of a library's value is what its arm shows between libraries plus the counting
    error that depth buys down. Depth is solved for directly, since the effect falls with it.
    """

    values = long_quantities(ratios, arms)
    errors = counting.unpivot(["sample"], list(QUANTITIES), "quantity", "counted")
    joined = values.join(errors, ["sample", "quantity"])

    def arm(name: str, fn, column: Column) -> Column:
        return fn(F.when(F.col("treatment") == name, column))

    stats = []
    for name, tag in ((treated, "a"), (control, "b")):
        stats += [
            arm(name, F.avg, F.col("value")).alias(f"mean_{tag}"),
            F.coalesce(arm(name, F.var_samp, F.col("value")), F.lit(0.0)).alias(f"seen_{tag}"),
            arm(name, F.avg, F.col("counted") * F.col("counted")).alias(f"count_{tag}"),
            arm(name, F.count, F.col("value")).alias(f"n_{tag}")]
    wide = joined.groupBy("quantity").agg(*stats)
    between = {t: F.greatest(F.lit(0.0), F.col(f"seen_{t}") - F.col(f"count_{t}")) for t in "ab"}
    sized = wide.select(
        "*", between["a"].alias("floor_a"), between["b"].alias("floor_b"),
        (F.col("n_a") + F.col("n_b") - 2).alias("df"),
        F.try_element_at(_targets(targets), F.col("quantity")).alias("target"))
    reach = t_quantile(UPPER, F.col("df")) + t_quantile(POWER, F.col("df"))
    floor = F.col("floor_a") / F.col("n_a") + F.col("floor_b") / F.col("n_b")
    depth_part = F.col("count_a") / F.col("n_a") + F.col("count_b") / F.col("n_b")
    solved = sized.withColumn("k", reach).withColumn("floor", floor).withColumn(
        "depth_part", depth_part)
    target = F.abs(F.col("target"))
    least = F.col("k") * F.sqrt(F.col("floor") + F.col("depth_part"))
    irreducible = F.col("k") * F.sqrt("floor")
    room = F.pow(target / F.col("k"), F.lit(2.0)) - F.col("floor")
    depth = (F.when(irreducible >= target, F.lit(float("inf")))
             .when(least <= target, 1.0).otherwise(F.col("depth_part") / room))
    total = F.col("floor_a") + F.col("count_a") + F.col("floor_b") + F.col("count_b")
    summary = solved.select(
        "quantity", F.col("target").alias("reference_effect"),
        (F.col("mean_a") - F.col("mean_b")).alias("observed_difference"),
        least.alias("minimum_detectable_effect"), irreducible.alias("irreducible_effect"),
        F.try_divide(F.col("floor_a") + F.col("floor_b"), total).alias("between_library_share"),
        depth.alias("depth_multiplier_at_least"),
        F.col("df").alias("variance_degrees_of_freedom"), total.alias("_variance"))
    return summary.join(_replicates(summary), "quantity", "left").drop("_variance")


def _replicates(summary: DataFrame) -> DataFrame:
    """The fewest libraries per arm, from 2 to `MAXIMUM_REPLICATES`, that resolve the target.

    The effect falls as libraries are added, so the range is halved: about ten designs for each of
    the three quantities.
    """

    def effect(n: int, variance: float) -> float:
        free = 2 * n - 2
        return (t_quantile_value(UPPER, free) + t_quantile_value(POWER, free)) * math.sqrt(
            variance / n)

    @F.pandas_udf("int")
    def fewest(variance: pd.Series, target: pd.Series) -> pd.Series:
        found = []
        for v, t in zip(variance, target):
            low, high = 1, MAXIMUM_REPLICATES
            if not (v >= 0 and effect(high, v) <= t):
                found.append(None)
                continue
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (low, middle) if effect(middle, v) <= t else (middle, high)
            found.append(high)
        return pd.Series(found, dtype="Int32")

    return summary.select("quantity", fewest("_variance", F.abs("reference_effect")).alias(
        "replicates_required"))


def per_library_table(ratios: DataFrame, arms: DataFrame, counting: DataFrame,
                      intervals: DataFrame, kinds: DataFrame) -> DataFrame:
    """Each library's ratios with its arm, bootstrap interval, counting error and failure kind."""

    errors = counting.unpivot(["sample"], list(QUANTITIES), "quantity", "counting_se")
    return (ratios.join(arms, "sample").join(intervals.join(errors, ["sample", "quantity"]),
                                             "sample")
            .join(kinds.select("sample", "calibration"), "sample", "left"))
