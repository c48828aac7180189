"""From archive records to the scored population, its conditions and its triage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopscan.functions.fixed import (
    ENTITY_STATUS,
    NONSENSE_TERM,
    PATHOGENIC_CLASSES,
    PLACEHOLDER_CONCEPTS,
    TRIAGE,
    TRIAGE_NO_TRANSCRIPT,
)
from stopscan.functions.scalars import lookup, met, review_stars, xref_ids


def triage(variants: DataFrame) -> DataFrame:
    """Class, whether readthrough applies, and why: transcript support first, then consequence."""

    consequence, supported = F.col("consequence"), F.col("transcript_supported")

    def verdict(part: int, fallback):
        mapping = {name: found[part] for name, found in TRIAGE.items()}
        return F.when(~supported, F.lit(TRIAGE_NO_TRANSCRIPT[part])).otherwise(
            lookup(mapping, consequence, fallback))

    outside = F.concat(consequence, F.lit(" is outside the supported variant classes"))
    return variants.select(
        "*",
        verdict(0, F.lit("unsupported")).alias("triage_class"),
        verdict(1, F.lit(False)).alias("applies"),
        verdict(2, outside).alias("reason"),
    )


def pathogenic_nonsense(records: DataFrame) -> DataFrame:
    """Records that are single-nucleotide, stop-gaining, pathogenic, one alternate, one gene.

    `records` holds the VCF columns and the INFO fields by name. `unambiguous` says whether both
    alleles are plain bases; `split_alleles` separates the two populations.
    """

    gene = F.split_part(F.coalesce("GENEINFO", F.lit("")), F.lit("|"), F.lit(1))
    gene_id = F.regexp_extract(gene, r"^[^:]*:(\d+)$", 1)
    significance = F.split_part(F.coalesce("CLNSIG", F.lit("")), F.lit("|"), F.lit(1))
    kept = records.where(
        (F.col("CLNVC") == "single_nucleotide_variant")
        & F.col("MC").contains(NONSENSE_TERM)
        & significance.isin(*PATHOGENIC_CLASSES)
        & (F.col("alt") != ".") & ~F.col("alt").contains(",")
        & (gene_id != "")
    )
    blank = F.lit("")
    return kept.select(
        F.coalesce("CLNHGVS", blank).alias("variant_id"),
        F.coalesce(F.col("ALLELEID").try_cast("bigint"), F.lit(0)).alias("allele_id"),
        "chrom", "pos", "ref", "alt",
        F.split_part(gene, F.lit(":"), F.lit(1)).alias("gene_symbol"),
        gene_id.cast("bigint").alias("gene_id"),
        F.coalesce("CLNSIG", blank).alias("clinical_significance"),
        F.coalesce("CLNREVSTAT", blank).alias("review_status"),
        review_stars(F.coalesce("CLNREVSTAT", blank)).alias("review_stars"),
        F.coalesce("CLNDN", blank).alias("conditions"),
        F.coalesce("CLNDISDB", blank).alias("condition_xrefs"),
        (F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$")).alias("unambiguous"),
    )


def split_alleles(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose alleles name plain bases, and how many rows do not, as a one-row table."""

    return (
        found.where("unambiguous").drop("unambiguous"),
        found.agg(F.count_if(~F.col("unambiguous")).alias("ambiguous_alleles")),
    )


def population_report(found: DataFrame) -> DataFrame:
    """Variants, genes, well-reviewed variants and ambiguous alleles of the extracted population."""

    kept = F.col("unambiguous")
    return found.agg(
        F.count_if(kept).alias("variants"),
        F.count_distinct(F.when(kept, F.col("gene_id"))).alias("genes"),
        F.count_if(kept & (F.col("review_stars") >= 2)).alias("two_stars_or_more"),
        F.count_if(~kept).alias("ambiguous_alleles"),
    )


def normalize_conditions(variants: DataFrame) -> DataFrame:
    """One row per variant and asserted condition, with ids by source and a mapping status.

    `conditions` and `condition_xrefs` are parallel `|` lists; a missing or short list of
    cross-references leaves its conditions unmapped.
    """

    names = F.coalesce("conditions", F.lit(""))
    entries = F.split(F.coalesce("condition_xrefs", F.lit("")), r"\|")
    carried = [c for c in variants.columns if c not in ("conditions", "condition_xrefs")]
    listed = variants.where(names != "").select(
        *carried, entries.alias("_entries"),
        F.posexplode(F.split(names, r"\|")).alias("condition_ordinal", "condition_name"))
    entry = F.coalesce(F.get("_entries", F.col("condition_ordinal")), F.lit(""))
    ids = {name.lower(): xref_ids(entry, name)
           for name in ("MedGen", "OMIM", "Orphanet", "MONDO", "MeSH")}
    found = listed.select(
        *carried, "condition_ordinal", "condition_name",
        F.coalesce(F.get(ids["medgen"], F.lit(0)), F.lit("")).alias("medgen"),
        *[F.array_join(ids[s], ";").alias(s) for s in ("omim", "orphanet", "mondo", "mesh")])
    placeholder = lookup(PLACEHOLDER_CONCEPTS, F.col("medgen"))
    status = (F.when(placeholder.isNotNull(), "placeholder")
              .when(F.col("medgen") == "", "unmapped")
              .when((F.col("omim") == "") & (F.col("orphanet") == ""), "medgen_only")
              .otherwise("mapped"))
    reason = (F.when(placeholder.isNotNull(),
                     F.concat(F.lit("ClinVar placeholder ("), placeholder, F.lit(")")))
              .when(F.col("medgen") == "", "no MedGen concept on the condition")
              .when((F.col("omim") == "") & (F.col("orphanet") == ""),
                    "MedGen concept with no OMIM or Orphanet cross-reference")
              .otherwise(""))
    return found.withColumns({"mapping_status": status, "reason": reason})


def condition_status_counts(conditions: DataFrame) -> DataFrame:
    """Rows and distinct concepts under each mapping status."""

    return conditions.groupBy("mapping_status").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("medgen").alias("concepts"))


def named_entities(conditions: DataFrame) -> DataFrame:
    """Rows that name a real concept."""

    return conditions.where(met(F.col("mapping_status").isin(*ENTITY_STATUS)))


def search(variants: DataFrame, query: str, fields: list[str], order: str,
           shown: int = 12) -> DataFrame:
    """The first `shown` rows whose text contains `query`, each with the total number found."""

    haystack = F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))
    found = variants.where(F.contains(haystack, F.lit(query.strip().lower())))
    total = found.agg(F.count(F.lit(1)).alias("total")).scalar()
    return found.orderBy(order).limit(shown).withColumn("total", total)
