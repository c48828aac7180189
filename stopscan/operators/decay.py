"""Whether a premature stop escapes decay: two rule sets, and two outside models beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.functions.fixed import (
    ESCAPE_RULES,
    LAST_JUNCTION_NT,
    LONG_EXON_NT,
    START_PROXIMAL_NT,
)
from stopscan.functions.scalars import half_even, met, ratio, variant_key, without_version
from stopscan.operators.ranking import first_by, quantiles

RULES = ("rule_last_exon", "rule_within_last_junction", "rule_start_proximal", "rule_long_exon")


def within_last_junction() -> Column:
    """Strictly upstream of the last junction, by at most the guideline distance."""

    distance = F.col("nt_to_last_junction")
    return met((distance > 0) & (distance <= LAST_JUNCTION_NT))


def escapes_decay() -> Column:
    """The guideline rule: last exon, or just upstream of the last junction."""

    return met(F.col("in_last_exon")) | within_last_junction()


def decay_predictors(contexts: DataFrame) -> DataFrame:
    """The four escape rules of each scoreable stop, the two predictors, and where they split."""

    ruled = contexts.where("scoreable").select(
        "variant_id", "gene_symbol",
        met(F.col("in_last_exon")).alias(RULES[0]),
        within_last_junction().alias(RULES[1]),
        met(F.col("nt_from_start") < START_PROXIMAL_NT).alias(RULES[2]),
        met(F.col("ptc_exon_length") > LONG_EXON_NT).alias(RULES[3]))
    guideline = F.col(RULES[0]) | F.col(RULES[1])
    full = guideline | F.col(RULES[2]) | F.col(RULES[3])
    return ruled.select("*", guideline.alias("escape_guideline"), full.alias("escape_full_rules"),
                        (guideline != full).alias("predictors_disagree"))


def disagreement_atlas(predictors: DataFrame) -> DataFrame:
    """One row of counts and shares: both rules, their disagreements, and those by added rule."""

    split, start, long_exon = (F.col(c) for c in (
        "predictors_disagree", "rule_start_proximal", "rule_long_exon"))
    counted = predictors.agg(
        F.count(F.lit(1)).alias("scoreable"),
        F.count_if("escape_guideline").alias("escape_guideline"),
        F.count_if("escape_full_rules").alias("escape_full_rules"),
        F.count_if(split).alias("disagree"),
        F.count_if(split & start & ~long_exon).alias("driven_by_start_proximal"),
        F.count_if(split & ~start & long_exon).alias("driven_by_long_exon"),
        F.count_if(split & start & long_exon).alias("driven_by_both"))
    share = {name: half_even(F.coalesce(ratio(F.col(c), F.col("scoreable")), F.lit(0.0)), 4)
             for name, c in (("guideline_fraction", "escape_guideline"),
                             ("full_rules_fraction", "escape_full_rules"),
                             ("disagree_fraction", "disagree"))}
    return counted.withColumns(share)


def select_transcript_by_gene(summary: DataFrame) -> DataFrame:
    """Gene id to its Select transcript, versions stripped; the last listed one wins."""

    chosen = summary.where(F.col("MANE_status").contains("MANE Select")).select(
        F.regexp_replace("NCBI_GeneID", "^GeneID:", "").cast("bigint").alias("gene_id"),
        without_version(F.col("Ensembl_nuc")).alias("mane_enst"), "ordinal")
    return first_by(chosen, ["gene_id"], ["ordinal"], descending=True).drop("ordinal")


def rule_table(raw: DataFrame) -> DataFrame:
    """The outside tool's rules per variant and transcript, transcript versions stripped."""

    return raw.withColumn("transcript", without_version(F.col("transcript")))


def external_verdicts(rules: DataFrame, variants: DataFrame, transcripts: DataFrame,
                      order: str = "ordinal") -> DataFrame:
    """One row per variant: the tool's call on the Select transcript, or the cause it has none."""

    keyed = first_by(variants, ["variant_id"], [order]).select(
        "variant_id", "gene_id",
        variant_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("key"),
    ).join(transcripts, "gene_id", "left")
    scored = first_by(rules, ["key", "transcript"], [order]).select(
        "key", F.col("transcript").alias("mane_enst"), "is_ptc", *ESCAPE_RULES)
    annotated = rules.select(F.col("transcript").alias("mane_enst")).distinct().withColumn(
        "annotated", F.lit(True))
    joined = (keyed.join(scored, ["key", "mane_enst"], "left")
              .join(annotated, "mane_enst", "left"))
    available = F.col("is_ptc").isNotNull()
    reason = (F.when(available, "")
              .when(F.col("mane_enst").isNull(), "no_mane_ensembl")
              .when(F.col("annotated"), "variant_filtered")
              .otherwise("transcript_absent"))
    escapes = {f"aenmd_{r}": met(F.col(r)) for r in ESCAPE_RULES}
    any_rule = F.lit(False)
    for held in escapes.values():
        any_rule = any_rule | held
    return joined.select(
        "variant_id", available.alias("aenmd_available"), reason.alias("reason"),
        met(F.col("is_ptc")).alias("aenmd_is_ptc"),
        *[held.alias(n) for n, held in escapes.items()],
        (any_rule & available).alias("aenmd_escape"))


def tool_agreement(predictors: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rule tier against the outside tool over the variants both call; one row."""

    full, guideline, tool = (F.col(c) for c in (
        "escape_full_rules", "escape_guideline", "aenmd_escape"))
    both = predictors.join(
        verdicts.where(met(F.col("aenmd_available"))).select("variant_id", "aenmd_escape"),
        "variant_id")
    compared = both.agg(
        F.count(F.lit(1)).alias("both_available"),
        F.count_if(tool).alias("aenmd_escape"),
        F.count_if(full == tool).alias("full_rules_vs_aenmd_agree"),
        F.count_if(full & ~tool).alias("full_escape_aenmd_decay"),
        F.count_if(~full & tool).alias("full_decay_aenmd_escape"),
        F.count_if(guideline == tool).alias("_guideline_agree"))
    present = verdicts.agg(F.count_if(met(F.col("aenmd_available"))).alias("n"),
                           F.count(F.lit(1)).alias("rows"))
    scoreable = predictors.agg(F.count(F.lit(1)).alias("n"))
    total = F.col("both_available")
    return compared.select(
        scoreable.scalar().alias("scoreable"),
        present.select("n").scalar().alias("aenmd_available"),
        "both_available",
        half_even(F.coalesce(present.select(ratio(F.col("n"), F.col("rows"))).scalar(),
                             F.lit(0.0)), 4).alias("aenmd_available_fraction"),
        "aenmd_escape", half_even(ratio(tool, total), 4).alias("aenmd_escape_fraction"),
        "full_rules_vs_aenmd_agree",
        half_even(ratio(F.col("full_rules_vs_aenmd_agree"), total), 4)
        .alias("full_rules_vs_aenmd_agree_fraction"),
        "full_escape_aenmd_decay", "full_decay_aenmd_escape",
        half_even(ratio(F.col("_guideline_agree"), total), 4)
        .alias("guideline_vs_aenmd_agree_fraction"))


def efficiency_table(raw: DataFrame) -> DataFrame:
    """The deep model's score table; a missing score column is filled with null."""

    if "nmd_efficiency" in raw.columns:
        return raw
    return raw.withColumn("nmd_efficiency", F.lit(None).cast("double"))


def efficiency_separation(predictors: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Mean efficiency of stops each rule set calls escape and decay, and the gap; one row."""

    efficiency = F.col("nmd_efficiency").cast("double")
    both = predictors.join(
        verdicts.where(met(F.col("nmd_available"))).select(
            "variant_id", efficiency.alias("nmd_efficiency")), "variant_id")
    columns = [F.count(F.lit(1)).alias("both_available")]
    for name, rule in (("guideline", "escape_guideline"), ("full_rules", "escape_full_rules")):
        escape = F.avg(F.when(F.col(rule), F.col("nmd_efficiency")))
        decay = F.avg(F.when(~F.col(rule), F.col("nmd_efficiency")))
        columns += [half_even(escape, 4).alias(f"{name}_escape_mean_efficiency"),
                    half_even(decay, 4).alias(f"{name}_decay_mean_efficiency"),
                    half_even(decay - escape, 4).alias(f"{name}_separation")]
    middle = quantiles(both, [], "nmd_efficiency", {"median": 0.5})
    totals = verdicts.agg(F.count_if(met(F.col("nmd_available"))).alias("n"),
                          F.count(F.lit(1)).alias("rows"))
    return both.agg(*columns).select(
        predictors.agg(F.count(F.lit(1))).scalar().alias("scoreable"),
        totals.select("n").scalar().alias("available"),
        half_even(F.coalesce(totals.select(ratio(F.col("n"), F.col("rows"))).scalar(),
                             F.lit(0.0)), 4).alias("available_fraction"),
        half_even(middle.scalar(), 4).alias("efficiency_median"), "*")
