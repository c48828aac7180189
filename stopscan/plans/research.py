"""The research aggregate: denominators, frontiers, decay atlas and top conditions in one payload."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopscan.functions.scalars import half_even
from stopscan.operators import coverage as cov
from stopscan.operators import decay as dec
from stopscan.operators import editing as ed
from stopscan.operators import payloads as pay
from stopscan.operators import variants as var

CAVEATS = {
    "entities": "A concept is an asserted condition, not a verified disease.",
    "coverage": "Coverage is exact restoration by design, not a therapeutic or clinical claim.",
    "metrics": "reach, covered_fraction and complete are three separate metrics.",
}


def frontier_points(frontier: DataFrame) -> DataFrame:
    """A frontier trimmed to what a curve needs."""

    return frontier.select(
        "rank", "design_id", "cumulative",
        half_even(F.col("cumulative_fraction"), 4).alias("cumulative_fraction"), "marginal")


def research_sections(conditions: DataFrame, contexts: DataFrame, top: int = 50,
                      tool: DataFrame | None = None, efficiency: DataFrame | None = None,
                      editing: DataFrame | None = None,
                      experiments: DataFrame | None = None) -> dict[str, DataFrame | None]:
    """The sections by name; each holds at most a frontier's, a list's or one row."""

    predictors = dec.decay_predictors(contexts)
    coverage = cov.disease_coverage(conditions, contexts)
    return {
        "denominators": pay.research_counts(conditions, contexts),
        "mapping_completeness": var.condition_status_counts(conditions),
        "nmd": dec.disagreement_atlas(predictors),
        "aenmd": None if tool is None else dec.tool_agreement(predictors, tool),
        "nmdetective": None if efficiency is None else dec.efficiency_separation(
            predictors, efficiency),
        "escape": None if editing is None else ed.escape_summary(editing),
        "variants_frontier": frontier_points(cov.coverage_frontier(contexts, "variants")),
        "genes_frontier": frontier_points(cov.coverage_frontier(contexts, "genes")),
        "conditions_frontier": frontier_points(cov.disease_reach_frontier(conditions, contexts)),
        "condition_coverage_top": coverage.drop("designs").orderBy(
            F.desc("eligible_variants"), "medgen").limit(top),
        "experiments": experiments,
    }


def research_payload(conditions: DataFrame, contexts: DataFrame, provenance: Mapping[str, str],
                     **layers: DataFrame | None) -> DataFrame:
    """The whole payload as one JSON row; absent layers are null and NaN is refused."""

    sections = {n: None if s is None else pay.refuse_nan(s)
                for n, s in research_sections(conditions, contexts, **layers).items()}
    return pay.evidence({**provenance, **CAVEATS}, sections, contexts.sparkSession)
