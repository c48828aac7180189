"""Strict table contracts: every violation of a table is reported, none is repaired."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.functions.fixed import (
    CONSEQUENCES,
    EVIDENCE_GAP,
    FEASIBILITY,
    TRIAGE_CLASSES,
    VERDICTS,
)
from stopscan.functions.nucleotides import degenerate_prefix
from stopscan.functions.scalars import met

VIOLATIONS = "column_name string, check_name string, failures bigint"


@dataclass(frozen=True)
class Field:
    """One declared column: its type name, whether it may be null, and its value checks."""

    kind: str
    nullable: bool = False
    checks: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)
    unique: bool = False


@dataclass(frozen=True)
class Contract:
    """A strict column set, plus checks that read several columns of a row."""

    columns: Mapping[str, Field]
    row_checks: Mapping[str, Callable[[], Column]] = field(default_factory=dict)


def one_of(values: Sequence[str]) -> dict[str, Callable[[Column], Column]]:
    return {"isin": lambda c: c.isin(*values)}


def between(low: float | None = None, high: float | None = None,
            above: float | None = None) -> dict[str, Callable[[Column], Column]]:
    checks: dict[str, Callable[[Column], Column]] = {}
    if low is not None:
        checks[f"ge_{low:g}"] = lambda c: c >= low
    if high is not None:
        checks[f"le_{high:g}"] = lambda c: c <= high
    if above is not None:
        checks[f"gt_{above:g}"] = lambda c: c > above
    return checks


def matches(pattern: str) -> dict[str, Callable[[Column], Column]]:
    return {"matches": lambda c: c.rlike(pattern)}


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """`(column_name, check_name, failures)` for every check that fails; empty when `df` conforms.

    All value, null and row checks are counted in one pass. Uniqueness is a count of keys held by
    more than one row.
    """

    spark = df.sparkSession
    present = dict(df.dtypes)
    shape = [(c, "missing_column", 1) for c in contract.columns if c not in present]
    shape += [(c, "undeclared_column", 1) for c in present if c not in contract.columns]
    shape += [(c, f"type_{present[c]}", 1) for c, f in contract.columns.items()
              if c in present and present[c] != f.kind]
    usable = {c: f for c, f in contract.columns.items() if present.get(c) == f.kind}

    counted: list[tuple[str, str, Column]] = []
    for name, declared in usable.items():
        column = F.col(name)
        if not declared.nullable:
            counted.append((name, "not_null", column.isNull()))
        for check, holds in declared.checks.items():
            counted.append((name, check, column.isNotNull() & ~met(holds(column))))
    if set(contract.columns) <= set(present):
        for check, holds in contract.row_checks.items():
            counted.append(("*", check, ~met(holds())))

    found = spark.createDataFrame(shape, VIOLATIONS)
    if counted:
        totals = df.agg(*[F.count_if(bad).alias(f"c{i}") for i, (_, _, bad) in enumerate(counted)])
        listed = F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("check_name"),
                     F.col(f"c{i}").alias("failures"))
            for i, (c, k, _) in enumerate(counted)])
        found = found.unionByName(totals.select(F.inline(listed)))
    for name, declared in usable.items():
        if declared.unique:
            repeated = (df.groupBy(name).count().where("count > 1")
                        .agg(F.count(F.lit(1)).alias("failures")))
            found = found.unionByName(repeated.select(
                F.lit(name).alias("column_name"), F.lit("unique").alias("check_name"), "failures"))
    return found.where("failures > 0")


def require(df: DataFrame, contract: Contract, source: str = "table") -> DataFrame:
    """`df` itself where it conforms; otherwise an error naming every failed check."""

    # One row per declared check at most.
    failed = violations(df, contract).collect()
    if failed:
        detail = "; ".join(f"{r.column_name}.{r.check_name}: {r.failures}" for r in failed)
        raise ValueError(f"{source} does not meet its contract: {detail}")
    return df


# --- Declared contracts -------------------------------------------------------------------------

READTHROUGH_LABELS = Contract({
    "variant_id": Field("string"),
    "gene_id": Field("string"),
    "therapy_id": Field("string"),
    "stop_codon": Field("string", checks=one_of(("UAA", "UAG", "UGA"))),
    "readthrough_efficiency": Field("double", checks=between(0.0, 1.0)),
    "replicate_sd": Field("double", nullable=True, checks=between(0.0)),
    "censored": Field("boolean"),
})

PATHOGENIC_NONSENSE = Contract({
    "variant_id": Field("string"),
    "allele_id": Field("bigint"),
    "chrom": Field("string"),
    "pos": Field("bigint", checks=between(above=0)),
    "ref": Field("string", checks=one_of("ACGT")),
    "alt": Field("string", checks=one_of("ACGT")),
    "gene_symbol": Field("string"),
    "gene_id": Field("bigint"),
    "clinical_significance": Field("string"),
    "review_status": Field("string"),
    "review_stars": Field("int", checks=between(0, 4)),
    "conditions": Field("string"),
    "condition_xrefs": Field("string"),
})

TRIAGE_INPUT = Contract({
    "variant_id": Field("string"),
    "consequence": Field("string", checks=one_of(CONSEQUENCES)),
    "transcript_supported": Field("boolean"),
})

TRIAGE_OUTPUT = Contract({
    **TRIAGE_INPUT.columns,
    "triage_class": Field("string", checks=one_of(TRIAGE_CLASSES)),
    "applies": Field("boolean"),
    "reason": Field("string"),
})

_RUN_COLUMNS = {
    "dataset": Field("string"),
    "sample": Field("string", unique=True),
    "run_accession": Field("string", unique=True),
    "cell_line": Field("string"),
    "variant": Field("string", nullable=True),
    "treatment": Field("string"),
    "replicate": Field("int", checks=between(above=0)),
    "assay": Field("string", checks=one_of(("riboseq", "rnaseq"))),
    "layout": Field("string", checks=one_of(("single", "paired"))),
    "read_count": Field("bigint", checks=between(above=0)),
    "adapter_3p": Field("string", checks=matches("^[ACGTN]+$")),
    "adapter_3p_2": Field("string", nullable=True, checks=matches("^[ACGTN]+$")),
    "adapter_overlap": Field("int", checks=between(above=0)),
    "cut_5p": Field("int", checks=between(0)),
}


def _overlap_exceeds_prefix() -> Column:
    """True where the overlap reaches past the degenerate start, so that fixed bases are compared."""

    return F.col("adapter_overlap") > degenerate_prefix(F.col("adapter_3p"))


def _second_read_matches_layout(*columns: str) -> Callable[[], Column]:
    def check() -> Column:
        return F.coalesce(*columns).isNotNull() == (F.col("layout") == "paired")

    return check


SEQUENCING_RUNS = Contract(
    {
        **_RUN_COLUMNS,
        "fastq_1_url": Field("string"),
        "fastq_1_md5": Field("string"),
        "fastq_2_url": Field("string", nullable=True),
        "fastq_2_md5": Field("string", nullable=True),
    },
    {
        "overlap_exceeds_degenerate_prefix": _overlap_exceeds_prefix,
        "second_read_matches_layout": _second_read_matches_layout("fastq_2_url", "fastq_2_md5"),
    },
)

STAGED_RUNS = Contract(
    {**_RUN_COLUMNS, "fastq_1": Field("string"), "fastq_2": Field("string", nullable=True)},
    {
        "overlap_exceeds_degenerate_prefix": _overlap_exceeds_prefix,
        "second_read_matches_layout": _second_read_matches_layout("fastq_2"),
    },
)

_FILLED = {"not_blank": lambda c: c != ""}

CLAIMS_LEDGER = Contract({
    name: Field("string", unique=name == "claim_id",
                checks=_FILLED | (one_of(VERDICTS) if name == "verdict" else {}))
    for name in ("claim_id", "claim", "assay", "endpoint", "comparability", "verdict", "detail",
                 "what_would_settle_it", "source")
})

_CLOSED = {
    "reach_rule": ("uag_stops", "all_scoreable", "decay_escaping"),
    "evidence_grade": tuple(EVIDENCE_GAP),
    "complexity": tuple(FEASIBILITY),
}

EXPERIMENT_PROGRAMMES = Contract({
    name: Field("string", unique=name == "experiment_id",
                checks=_FILLED | (one_of(_CLOSED[name]) if name in _CLOSED else {}))
    for name in (
        "experiment_id", "question", "why_it_matters", "what_the_lab_does", "comparison",
        "success_criterion", "if_it_fails", "evidence_gap_reason", "assay", "model_system",
        "endpoint", "decision_rule", "replicates", "resolves", "reach_rule", "direct_scope",
        "generalisation_required", "replicate_endpoint", "replicate_effect",
        "replicate_variance_source", "replicate_design", "replicate_alpha_power",
        "replicate_method", "evidence_grade", "complexity", "safety_relevant", "provenance")
})


def label_summary(labels: DataFrame) -> DataFrame:
    """Rows and censored rows of a label table."""

    return labels.agg(F.count(F.lit(1)).alias("labels"), F.count_if("censored").alias("censored"))
