"""Which measurement would settle which open question, over axes that are never summed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.functions.fixed import EVIDENCE_GAP, FEASIBILITY, VERDICTS
from stopscan.functions.nucleotides import as_dna
from stopscan.functions.scalars import joined_or_none, lookup, met, named_items

AXES = ("potential_variants", "potential_genes", "potential_conditions",
        "open_questions_addressed", "evidence_gap", "feasibility")


def _decay_escaping(df: DataFrame) -> Column:
    if "escapes_decay_by_rule" not in df.columns:
        raise ValueError("join `escapes_decay_by_rule` to the contexts first "
                         "(see with_decay_verdict); 'decay_escaping' selects by it")
    return met(F.col("escapes_decay_by_rule"))


REACH: dict[str, Callable[[DataFrame], Column]] = {
    "uag_stops": lambda df: met(as_dna(F.col("stop_type")) == "TAG"),
    "all_scoreable": lambda df: F.lit(True),
    "decay_escaping": _decay_escaping,
}
"""Named reach rules: which placed variants a programme would inform if it generalises."""


def verdict_counts(ledger: DataFrame) -> DataFrame:
    """Rows under each verdict in declared order, empty verdicts kept."""

    counted = ledger.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(v).alias("verdict"), F.col(v).alias("rows"))
        for i, v in enumerate(VERDICTS)]))).orderBy("ordinal").drop("ordinal")


def with_decay_verdict(contexts: DataFrame, landscape: DataFrame) -> DataFrame:
    """Placed contexts with the landscape's decay verdict, a missing one counted as no escape."""

    return contexts.where(met(F.col("scoreable"))).join(
        landscape.select("variant_id", "escapes_decay_by_rule"), "variant_id", "left"
    ).withColumn("escapes_decay_by_rule", met(F.col("escapes_decay_by_rule")))


def reach_by_rule(contexts: DataFrame, conditions: DataFrame,
                  rules: Sequence[str]) -> DataFrame:
    """Distinct variants, genes and conditions each named rule selects; one row per rule."""

    flags = {r: REACH[r](contexts) for r in rules}
    flagged = contexts.select("variant_id", "gene_symbol", F.explode(F.array_compact(F.array(*[
        F.when(c, F.lit(r)) for r, c in flags.items()]))).alias("reach_rule"))
    reached = flagged.groupBy("reach_rule").agg(
        F.count_distinct("variant_id").alias("potential_variants"),
        F.count_distinct("gene_symbol").alias("potential_genes"))
    concepts = conditions.select("variant_id", "medgen").distinct().join(
        flagged.select("variant_id", "reach_rule").distinct(), "variant_id"
    ).groupBy("reach_rule").agg(F.count_distinct("medgen").alias("potential_conditions"))
    return reached.join(concepts, "reach_rule", "left")


def propose(programmes: DataFrame, contexts: DataFrame, conditions: DataFrame,
            ledger: DataFrame, rules: Sequence[str] = tuple(REACH)) -> DataFrame:
    """Each programme with its computed axes: reach, open claims addressed, gap, feasibility."""

    reach = reach_by_rule(contexts, conditions, rules)
    names = F.array_sort(F.array_distinct(named_items(F.col("resolves"))))
    open_claims = ledger.where(~F.col("verdict").isin("supported", "refuted")).select(
        F.col("claim_id").alias("claim"))
    addressed = programmes.select("experiment_id", F.explode(names).alias("claim")).join(
        open_claims.distinct(), "claim", "left_semi").groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("open_questions_addressed"))
    joined = programmes.join(reach, "reach_rule", "left").join(addressed, "experiment_id", "left")
    return joined.select(
        *programmes.columns,
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in AXES[:4]],
        joined_or_none(names).alias("claims_named"),
        lookup(EVIDENCE_GAP, F.col("evidence_grade")).cast("bigint").alias("evidence_gap"),
        lookup(FEASIBILITY, F.col("complexity")).cast("bigint").alias("feasibility"))


def frontier(proposed: DataFrame, axes: Sequence[str] = AXES,
             identity: str = "experiment_id") -> DataFrame:
    """Which programmes nothing beats on every axis at once, and what beats the others.

    Programmes with the same axes share one verdict, so only distinct axes are compared: reach has a
    value per rule and the other axes have a few grades, whatever the number of programmes. Names
    are attached to the beaten axes afterwards.
    """

    points = proposed.groupBy(*axes).agg(F.collect_list(identity).alias("_ids"))
    listed = points.agg(F.collect_list(F.struct(*axes))).scalar()

    def beats(other: Column) -> Column:
        at_least, more = F.lit(True), F.lit(False)
        for axis in axes:
            at_least = at_least & (other[axis] >= F.col(axis))
            more = more | (other[axis] > F.col(axis))
        return at_least & more

    beaten = points.withColumn("_all", listed).select(
        *axes, F.explode(F.filter("_all", beats)).alias("_by"))
    better = points.select(F.struct(*axes).alias("_by"), "_ids")
    named = beaten.join(better, "_by").groupBy(*axes).agg(
        F.transform(F.array_sort(F.flatten(F.collect_list("_ids"))),
                    lambda v: v.cast("string")).alias("_beaten"))
    named = named.select(*[F.col(a).alias(f"_{a}") for a in axes], "_beaten")
    held = proposed.join(named, [F.col(a) == F.col(f"_{a}") for a in axes], "left")
    found = F.coalesce("_beaten", F.array().cast("array<string>"))
    return held.select(*proposed.columns, (F.size(found) == 0).alias("on_frontier"),
                       joined_or_none(found).alias("dominated_by"))
