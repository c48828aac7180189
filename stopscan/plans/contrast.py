"""The measured arm end to end: gate, lengths, universe, ratios, effects, signature."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from stopscan.operators import effects as eff
from stopscan.operators import footprints as fp
from stopscan.operators.intervals import overlapping_other_genes
from stopscan.operators.native_stops import excluded_transcripts
from stopscan.session import cut_lineage, refuse


@dataclass(frozen=True)
class Contrast:
    """One contrast's tables; a contrast that may not be read never gets this far."""

    libraries: DataFrame
    effects: DataFrame
    signature: DataFrame


def readthrough_contrast(counts: DataFrame, frames: DataFrame, offsets: DataFrame,
                         arms: DataFrame, features: DataFrame, genes: DataFrame, treated: str,
                         control: str, dataset: str, calibrated: str, paired: bool = False,
                         published: tuple[int, int] | None = None,
                         minimum_psites: int | None = None) -> Contrast:
    """Test a length-stratified count table for the readthrough signature.

    The lengths come from the calibration, or from a published window that still passes the gate.
    Qualifying rows are written once and read by every later step. A library that fails its
    calibration, a calibration of another dataset, and a named library without counts each end the
    run with an error before any effect is formed.
    """

    floor = {} if minimum_psites is None else {"minimum_psites": minimum_psites}
    verdicts = fp.library_verdicts(frames, offsets, **floor)
    wanted = arms.where(arms.treatment.isin(treated, control))
    absent = eff.libraries_without_counts(wanted, counts)
    refuse(fp.manifest_gate(verdicts, dataset, calibrated).unionByName(
        absent.selectExpr("sample", "'without counts' AS failures")),
        f"{dataset} may not be contrasted")
    lengths = (fp.shared_lengths(frames) if published is None
               else range(published[0], published[1] + 1))
    excluded = excluded_transcripts(overlapping_other_genes(features), genes)
    kept = cut_lineage(fp.qualifying(fp.collapse_lengths(counts, lengths), excluded=excluded,
                                     samples=wanted))
    ratios = cut_lineage(fp.library_ratios(kept))
    compare = eff.paired_effects if paired else eff.unpaired_effects
    effects = compare(ratios, wanted, treated, control)
    return Contrast(ratios.join(wanted, "sample"), effects, eff.signature(effects))
