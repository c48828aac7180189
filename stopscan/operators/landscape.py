"""One row per variant with each condition kept separate, and how many meet them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.functions.fixed import (
    READTHROUGH_THRESHOLDS,
    STOP_CODONS,
    TOLERABLE_SHARE,
    near_cognate,
    substitution_scores,
)
from stopscan.functions.nucleotides import as_dna
from stopscan.functions.scalars import lookup, met
from stopscan.operators.decay import escapes_decay
from stopscan.operators.ranking import first_by, top_per_group


def similarity(original: Column, inserted: Column) -> Column:
    """Substitution score of one residue for another."""

    scores = {a + b: score for (a, b), score in substitution_scores().items()}
    return lookup(scores, F.concat(original, inserted))


def conservative(original: Column, inserted: Column) -> Column:
    return similarity(original, inserted) >= 0


def tolerable_shares() -> dict[str, float]:
    """`residue + stop` to the share of the stop's near-cognate insertions that are conservative."""

    scores = substitution_scores()
    residues = sorted({a for a, _ in scores})
    return {aa + stop: sum(scores[aa, x] >= 0 for x in near_cognate(stop)) / len(near_cognate(stop))
            for aa in residues for stop in STOP_CODONS}


def tolerable_share(original: Column, stop: Column) -> Column:
    return lookup(tolerable_shares(), F.concat(original, as_dna(stop)))


def near_cognate_residues(stop: Column) -> Column:
    """The residues one base away from a stop, joined in order."""

    return lookup({s: ",".join(near_cognate(s)) for s in STOP_CODONS}, as_dna(stop))


def best_present(scores: DataFrame) -> DataFrame:
    """Each variant's best therapy among those that could score it; ties to the first therapy."""

    present = scores.where(F.col("status") == "present").withColumn(
        "_worst", -F.col("readthrough_predicted"))
    best = first_by(present, ["variant_id"], ["_worst", "therapy_id"])
    return best.select("variant_id", F.col("therapy_id").alias("best_therapy"),
                       F.col("readthrough_predicted").alias("best_readthrough"),
                       F.col("readthrough_low").alias("best_readthrough_low"))


def landscape(contexts: DataFrame, scores: DataFrame) -> DataFrame:
    placed = contexts.where("scoreable")
    return placed.join(best_present(scores), "variant_id", "left").select(
        "variant_id", "gene_symbol", "protein_position", "stop_type", "original_aa",
        "review_stars", escapes_decay().alias("escapes_decay_by_rule"), "nt_to_last_junction",
        "best_therapy", "best_readthrough", "best_readthrough_low",
        tolerable_share(F.col("original_aa"), F.col("stop_type"))
        .alias("tolerable_insertion_share"))


def threshold_summary(table: DataFrame,
                      thresholds: tuple[float, ...] = READTHROUGH_THRESHOLDS) -> DataFrame:
    """Variants meeting each condition, and all together, at each threshold.

    One pass counts every threshold; the counts are then laid out a row per threshold.
    """

    escapes = met(F.col("escapes_decay_by_rule"))
    tolerated = met(F.col("tolerable_insertion_share") >= TOLERABLE_SHARE)
    names, counts = [], []
    for i, t in enumerate(thresholds):
        reads, sure = (met(F.col(c) >= t) for c in ("best_readthrough", "best_readthrough_low"))
        row = {"variants": F.count(F.lit(1)), "escapes_decay": F.count_if(escapes),
               "reaches_threshold": F.count_if(reads),
               "reaches_threshold_lower_bound": F.count_if(sure),
               "most_insertions_tolerable": F.count_if(tolerated),
               "all_conditions": F.count_if(escapes & reads & tolerated),
               "all_conditions_lower_bound": F.count_if(escapes & sure & tolerated)}
        counts += [c.alias(f"{n}_{i}") for n, c in row.items()]
        names = list(row)
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("readthrough_threshold"),
                 *[F.col(f"{n}_{i}").alias(n) for n in names])
        for i, t in enumerate(thresholds)])
    return table.agg(*counts).select(F.inline(rows))


def interval_overlap(scores: DataFrame) -> DataFrame:
    """Whether the two best therapies' intervals overlap, and where, per variant."""

    arms = scores.where(F.col("readthrough_predicted").isNotNull()).select(
        "variant_id", "therapy_id", "readthrough_predicted", "readthrough_low", "readthrough_high")
    ranked = top_per_group(
        arms, ["variant_id"], [F.desc("readthrough_predicted"), F.asc("therapy_id")], 2)

    def of(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    paired = of(2, "therapy_id").isNotNull()
    low = F.greatest(of(1, "readthrough_low"), of(2, "readthrough_low"))
    high = F.least(of(1, "readthrough_high"), of(2, "readthrough_high"))
    return ranked.groupBy("variant_id").agg(
        of(1, "therapy_id").alias("first_therapy"), of(2, "therapy_id").alias("second_therapy"),
        F.when(paired, low).alias("overlap_low"), F.when(paired, high).alias("overlap_high"),
        met(paired & (high > low)).alias("overlaps"))
