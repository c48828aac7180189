"""The predicted arm end to end: archive, placement, score, decay, landscape, editing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from stopscan.operators import decay, editing, landscape, placement, variants
from stopscan.operators.evaluation import mark_folds
from stopscan.operators.model import fit, held_out_predictions, relative_error, score
from stopscan.session import cut_lineage, refuse


@dataclass(frozen=True)
class Amenability:
    """The tables of one run, whose placements agree with every reference protein."""

    variants: DataFrame
    conditions: DataFrame
    contexts: DataFrame
    scores: DataFrame
    predictors: DataFrame
    landscape: DataFrame
    summary: DataFrame
    reachability: DataFrame


def amenability(records: DataFrame, features: DataFrame, sequences: DataFrame,
                proteins: DataFrame, library: DataFrame,
                config: str = "published_random_cv") -> Amenability:
    """Every table from archive records, an annotation and a measured library.

    Contexts and scores are written once, since several branches read them. The interval of a
    therapy comes from its own held-out predictions. A placement that contradicts its reference
    protein ends the run with an error that names it.
    """

    kept, _ = variants.split_alleles(variants.pathogenic_nonsense(records))
    models = placement.one_model_per_gene(placement.transcript_models(features, sequences))
    contexts = cut_lineage(placement.stop_contexts(kept, models))
    refuse(placement.protein_disagreements(contexts, proteins),
           "placements contradict their proteins")
    held_out = held_out_predictions(mark_folds(library, config))
    scores = cut_lineage(score(contexts, fit(library), relative_error(held_out)))
    table = landscape.landscape(contexts, scores)
    return Amenability(
        kept, variants.normalize_conditions(kept), contexts,
        scores, decay.decay_predictors(contexts), table, landscape.threshold_summary(table),
        editing.reachability(editing.stop_guides(kept, models)))
