"""Transcript models, and the sequence context around the stop a substitution makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.functions.fixed import CONTEXT_WINDOW_NT, PRIMARY_CHROMOSOMES
from stopscan.functions.nucleotides import as_rna, base_at, complement, is_stop, residue
from stopscan.functions.scalars import let
from stopscan.operators.ranking import first_by


def annotated_features(gff: DataFrame) -> DataFrame:
    """Exon and coding rows of the Select transcripts on the primary assembly, ids extracted."""

    kept = gff.where(
        F.col("feature").isin("exon", "CDS")
        & F.col("attrs").contains("tag=MANE Select")
        & F.col("chrom").isin(*PRIMARY_CHROMOSOMES))
    named = kept.select(
        "chrom", "feature", "start", "end", "strand", "phase",
        *[c for c in ("ordinal",) if c in gff.columns],
        F.nullif(F.regexp_extract("attrs", r"Parent=rna-([^;]+)", 1), F.lit(""))
        .alias("transcript_id"),
        F.regexp_extract("attrs", r"GeneID:(\d+)", 1).try_cast("bigint").alias("gene_id"),
        F.nullif(F.regexp_extract("attrs", r"protein_id=([^;]+)", 1), F.lit(""))
        .alias("protein_id"))
    return named.dropna(subset=["transcript_id", "gene_id"])


def transcript_models(features: DataFrame, sequences: DataFrame) -> DataFrame:
    """One row per transcript with exons, coding bounds and sequence; incomplete ones are left out.

    Added per transcript, once: exons in reading order with their spliced offset, the offsets of
    the coding sequence's two ends, and the junction offsets. Sequences are joined by sorting: they
    may be derived, and the planner would broadcast what it takes to be short strings.
    """

    coding, exon = F.col("feature") == "CDS", F.col("feature") == "exon"
    order = F.col("ordinal") if "ordinal" in features.columns else F.col("start")
    built = features.groupBy("transcript_id").agg(
        F.min_by("gene_id", order).alias("gene_id"),
        F.min_by("chrom", order).alias("chrom"),
        F.min_by("strand", order).alias("strand"),
        F.sort_array(F.collect_list(F.when(exon, F.struct("start", "end")))).alias("exons"),
        F.min(F.when(coding, F.col("start"))).alias("cds_start"),
        F.max(F.when(coding, F.col("end"))).alias("cds_end"),
        F.min_by("protein_id", F.when(coding, order)).alias("protein_id"),
        F.min(order).alias("first_seen"),
    ).where((F.size("exons") > 0) & F.col("cds_start").isNotNull())
    return with_offsets(built.join(sequences.select(
        F.col("accession").alias("transcript_id"), "sequence").hint("merge"), "transcript_id"))


def with_offsets(models: DataFrame) -> DataFrame:
    """Spliced offsets of exons, coding ends and junctions, from genomic exons and strand."""

    ordered = F.when(F.col("strand") == "+", F.col("exons")).otherwise(F.reverse("exons"))
    widths = F.transform("_ordered", lambda e: (e["end"] - e["start"] + 1).cast("int"))
    starts = F.aggregate(
        widths, F.array(F.lit(0)),
        lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
    spliced = F.transform("_ordered", lambda e, i: F.struct(
        e["start"].alias("start"), e["end"].alias("end"),
        F.get(F.col("_starts"), i).alias("offset")))
    forward = F.col("strand") == "+"
    return (
        models.withColumn("_ordered", ordered).withColumn("_starts", starts)
        .withColumn("spliced", spliced)
        .withColumn("junctions", F.slice("_starts", F.lit(2), F.size("_ordered") - 1))
        .withColumn("coding_offset", offset_of(
            F.when(forward, F.col("cds_start")).otherwise(F.col("cds_end"))))
        .withColumn("coding_end_offset", offset_of(
            F.when(forward, F.col("cds_end")).otherwise(F.col("cds_start"))))
        .drop("_ordered", "_starts"))


def offset_of(position: Column) -> Column:
    """Genomic position to spliced offset, null in introns and outside the transcript."""

    holding = F.get(F.filter("spliced", lambda e: position.between(e["start"], e["end"])), F.lit(0))
    within = F.when(F.col("strand") == "+", position - holding["start"]).otherwise(
        holding["end"] - position)
    return (holding["offset"] + within).cast("int")


def one_model_per_gene(models: DataFrame) -> DataFrame:
    """The last transcript listed for a gene is the one its variants are placed on."""

    return first_by(models, ["gene_id"], ["first_seen", "transcript_id"], descending=True)


_MODEL_COLUMNS = ("transcript_id", "protein_id", "strand", "spliced", "junctions",
                  "coding_offset", "coding_end_offset", "sequence", "exons")


def placed(variants: DataFrame, models: DataFrame) -> DataFrame:
    """Each variant on its gene's transcript: offset, codon, mutated codon and failure reason.

    The model side is one row per gene, so a gene holding many variants is a skewed equi-join that
    adaptive execution splits on the variant side. It carries sequences, so it is not broadcast.
    """

    sides = models.select("gene_id", *_MODEL_COLUMNS).hint("merge")
    joined = variants.join(sides, "gene_id", "left")
    forward, coding, last = F.col("strand") == "+", F.col("coding_offset"), F.col(
        "coding_end_offset")
    expected = F.when(forward, F.col("ref")).otherwise(complement(F.col("ref")))
    substituted = F.when(forward, F.col("alt")).otherwise(complement(F.col("alt")))

    sequence = F.col("sequence")

    def spot(offset: Column) -> Column:
        start = (coding + F.floor((offset - coding) / 3) * 3).cast("int")
        return let(start, lambda s: let(codon_at(offset, s), lambda c: let(
            F.concat(F.substring(c, F.lit(1), offset - s), substituted,
                     F.substring(c, offset - s + 2, F.lit(3))),
            lambda m: outcome(offset, s, c, m))))

    def outcome(offset: Column, start: Column, codon: Column, mutated: Column) -> Column:
        matches = F.coalesce(base_at(sequence, offset) == expected, F.lit(False))
        stop_made = F.coalesce(is_stop(mutated) & ~is_stop(codon), F.lit(False))
        return F.struct(
            offset.alias("offset"), start.alias("codon_start"), codon.alias("codon"),
            mutated.alias("mutated"), _reason(offset, start, codon, matches, stop_made)
            .alias("reason"), (matches & stop_made & last.isNotNull()).alias("makes_stop"))

    def codon_at(offset: Column, start: Column) -> Column:
        covered = (offset >= coding) & (last.isNull() | (start + 2 <= last))
        read = base_at(F.col("sequence"), start, 3)
        return F.when(covered & (F.length(read) == 3), read)

    found = joined.withColumn("_spot", let(offset_of(F.col("pos")), spot))
    return found.select(*joined.columns, "_spot.*")


def _reason(offset: Column, start: Column, codon: Column, matches: Column,
            stop_made: Column) -> Column:
    """The first check a placement fails, in the order the checks are declared."""

    upstream_ok = start >= CONTEXT_WINDOW_NT
    downstream_ok = F.length("sequence") - start - 3 >= CONTEXT_WINDOW_NT
    return (
        F.when(F.col("transcript_id").isNull(), "no_mane_transcript")
        .when(offset.isNull(), "outside_transcript")
        .when(~matches, "reference_mismatch")
        .when(codon.isNull(), "outside_transcript")
        .when(~stop_made, "not_a_premature_stop")
        .when(~(upstream_ok & downstream_ok), "truncated_context")
        .otherwise(""))


def stop_contexts(variants: DataFrame, models: DataFrame) -> DataFrame:
    """The context around every premature stop, failures kept beside their reason."""

    found = placed(variants, models)
    ok = F.col("reason") == ""
    start, sequence = F.col("codon_start"), F.col("sequence")
    upstream = as_rna(base_at(sequence, start - CONTEXT_WINDOW_NT, CONTEXT_WINDOW_NT))
    downstream = as_rna(base_at(sequence, start + 3, CONTEXT_WINDOW_NT))
    last = F.try_element_at("junctions", F.lit(-1))
    bounds_low = F.coalesce(F.array_max(F.filter("junctions", lambda j: j <= start)), F.lit(0))
    bounds_high = F.coalesce(F.array_min(F.filter("junctions", lambda j: j > start)),
                             F.length(sequence))
    columns = {
        "transcript_id": F.col("transcript_id"),
        "protein_id": F.col("protein_id"),
        "protein_position": (F.floor((start - F.col("coding_offset")) / 3) + 1).cast("int"),
        "stop_type": as_rna(F.col("mutated")),
        "reference_codon": F.col("codon"),
        "original_aa": residue(F.col("codon")),
        "up_123nt": F.right(upstream, F.lit(3)),
        "down_123nt": F.left(downstream, F.lit(3)),
        "upstream": upstream,
        "downstream": downstream,
        "exon_count": F.size("exons"),
        "in_last_exon": last.isNull() | (start >= last),
        "nt_to_last_junction": last - start,
        "nt_from_start": start - F.col("coding_offset"),
        "ptc_exon_length": bounds_high - bounds_low,
    }
    carried = [c for c in ("variant_id", "gene_id", "gene_symbol", "review_stars")
               if c in found.columns]
    return found.select(*carried, ok.alias("scoreable"), "reason",
                        *[F.when(ok, c).alias(n) for n, c in columns.items()])


def protein_disagreements(contexts: DataFrame, proteins: DataFrame) -> DataFrame:
    """Placements whose codon does not translate to the residue the reference protein carries."""

    carried = F.substring("protein", F.col("protein_position"), F.lit(1))
    checked = contexts.where("scoreable").join(
        proteins.select(F.col("accession").alias("protein_id"),
                        F.col("sequence").alias("protein")).hint("merge"), "protein_id")
    return checked.where(
        (F.col("protein_position") <= F.length("protein")) & (F.col("original_aa") != carried)
    ).select("variant_id", "transcript_id", "protein_position",
             F.col("reference_codon").alias("codon"),
             F.col("original_aa").alias("translated"), carried.alias("in_protein"))


def failure_counts(contexts: DataFrame) -> DataFrame:
    """How many variants each reason left unscoreable."""

    return (contexts.where(~F.col("scoreable")).groupBy("reason")
            .agg(F.count(F.lit(1)).alias("variants")))


def alleles_by_chromosome(variants: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Single-base substitutions in chromosome and position order."""

    rank = F.array_position(F.lit(list(order)), F.col("chrom"))
    kept = variants.where((F.length("ref") == 1) & (F.length("alt") == 1))
    return kept.withColumn("chrom_rank", rank).orderBy(
        F.when(rank > 0, rank).otherwise(len(order) + 1), "pos")
