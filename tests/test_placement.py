"""Placing a substitution on a transcript, on both strands, and every reason it can fail."""

import pytest
from pyspark.sql import functions as F

from stopscan.operators import placement as plc
from stopscan.sources import text as src

HEAD = "C" * 80


def features(strand: str, sequence: str, split: int, gene: int = 1, accession: str = "t1"):
    """A two-exon transcript whose coding sequence is offsets 80..end-80."""

    first, second = split, len(sequence) - split
    if strand == "+":
        exons = [(101, 100 + first), (1001, 1000 + second)]
    else:
        exons = [(101, 100 + second), (1001, 1000 + first)]
    rows = [("chr1", "exon", a, b, strand, accession, gene, None) for a, b in exons]

    def at(offset: int) -> int:
        if strand == "+":
            return 101 + offset if offset < split else 1001 + offset - split
        return 1000 + first - offset if offset < split else 100 + second - (offset - split)

    ends = sorted((at(80), at(len(sequence) - 81)))
    rows.append(("chr1", "CDS", ends[0], ends[1], strand, accession, gene, "p1"))
    return rows, at


SCHEMA = ("chrom string, feature string, start bigint, end bigint, strand string, "
          "transcript_id string, gene_id bigint, protein_id string")
CODING = "ATGAAAGGGTGGCAATAA"
SEQUENCE = HEAD + CODING + "G" * 80
FLIP = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module", params=["+", "-"])
def placed(request, spark):
    strand = request.param
    rows, at = features(strand, SEQUENCE, 90)
    models = plc.one_model_per_gene(plc.transcript_models(
        spark.createDataFrame(rows, SCHEMA),
        spark.createDataFrame([("t1", SEQUENCE)], "accession string, sequence string")))

    def call(*variants):
        table = []
        for i, (gene, pos, ref, alt) in enumerate(variants):
            if strand == "-":
                ref, alt = ref.translate(FLIP), alt.translate(FLIP)
            table.append((f"v{i}", gene, pos, ref, alt))
        df = spark.createDataFrame(
            table, "variant_id string, gene_id bigint, pos bigint, ref string, alt string")
        found = plc.stop_contexts(df, models).orderBy("variant_id").collect()
        return [r.asDict() for r in found]

    return call, at


def test_context_of_a_premature_stop(placed):
    call, at = placed
    one, two = call((1, at(83), "A", "T"), (1, at(91), "G", "A"))
    assert (one["stop_type"], one["reference_codon"], one["original_aa"]) == ("uaa", "AAA", "K")
    assert (one["protein_position"], one["up_123nt"], one["down_123nt"]) == (2, "aug", "ggg")
    assert (len(one["upstream"]), len(one["downstream"])) == (72, 72)
    # The junction sits at offset 90: four codons in, inside TGG.
    assert (one["exon_count"], one["in_last_exon"], one["nt_to_last_junction"]) == (2, False, 7)
    assert (one["nt_from_start"], one["ptc_exon_length"]) == (3, 90)
    assert (two["stop_type"], two["original_aa"], two["in_last_exon"]) == ("uga", "W", False)
    assert two["nt_to_last_junction"] == 1


def test_every_failure_has_its_reason(placed):
    call, at = placed
    found = call(
        (2, at(83), "A", "T"), (1, 5, "A", "T"), (1, at(83), "G", "T"), (1, at(83), "A", "C"),
        (1, at(10), "C", "A"), (1, at(97), "A", "G"))
    assert [r["reason"] for r in found] == [
        "no_mane_transcript", "outside_transcript", "reference_mismatch", "not_a_premature_stop",
        "outside_transcript", "not_a_premature_stop"]
    assert not any(r["scoreable"] for r in found)
    assert all(r["stop_type"] is None for r in found)


def test_a_short_flank_is_a_truncated_context(spark):
    sequence = "C" * 80 + "ATGAAATAA" + "G" * 80
    rows, at = features("+", sequence, 40)
    cut = spark.createDataFrame([("t1", sequence[:140])], "accession string, sequence string")
    models = plc.transcript_models(spark.createDataFrame(rows, SCHEMA), cut)
    df = spark.createDataFrame([("v", 1, at(83), "A", "T")],
                               "variant_id string, gene_id bigint, pos bigint, ref string, "
                               "alt string")
    assert plc.stop_contexts(df, models).first().reason == "truncated_context"


def test_incomplete_transcripts_are_left_out_and_the_last_of_a_gene_wins(spark):
    a, _ = features("+", SEQUENCE, 90, accession="t1")
    b, _ = features("+", SEQUENCE, 90, accession="t2")
    no_coding = [r for r in features("+", SEQUENCE, 90, accession="t3")[0] if r[1] == "exon"]
    df = spark.createDataFrame(a + b + no_coding, SCHEMA).withColumn(
        "ordinal", F.monotonically_increasing_id())
    fasta = spark.createDataFrame([(t, SEQUENCE) for t in ("t1", "t2", "t3")],
                                  "accession string, sequence string")
    models = plc.transcript_models(df, fasta)
    assert {r.transcript_id for r in models.collect()} == {"t1", "t2"}
    assert plc.one_model_per_gene(models).first().transcript_id == "t2"


def test_annotation_keeps_selected_transcripts_of_the_primary_assembly(spark):
    def line(chrom, feature, tag, more=""):
        return (f"{chrom}\tR\t{feature}\t1\t9\t.\t+\t.\tID=x;Parent=rna-T1.1;"
                f"Dbxref=GeneID:77;tag={tag}{more}",)

    lines = spark.createDataFrame(
        [("##gff-version 3",), line("chr9", "exon", "MANE Select"),
         line("chr9", "CDS", "MANE Select", ";protein_id=P1"), line("chr9", "gene", "MANE Select"),
         line("chr9", "exon", "MANE Plus Clinical"), line("chr9_alt", "exon", "MANE Select")],
        "value string")
    found = plc.annotated_features(src.parse_features(lines)).orderBy("feature").collect()
    assert [(r.feature, r.transcript_id, r.gene_id, r.protein_id) for r in found] == [
        ("CDS", "T1.1", 77, "P1"), ("exon", "T1.1", 77, None)]
