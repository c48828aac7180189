"""Archive filter, conditions, triage, decay, landscape and contracts on hand-built rows."""

import pytest
from pyspark.sql import functions as F

from stopscan.functions.fixed import CONSEQUENCES, near_cognate, substitution_scores
from stopscan.operators import contracts as ct
from stopscan.operators import decay as dec
from stopscan.operators import landscape as land
from stopscan.operators import variants as var
from stopscan.sources import text as src

INFO = ("ALLELEID=7;CLNDN={name};CLNHGVS=h{i};CLNREVSTAT=reviewed_by_expert_panel;CLNSIG={sig};"
        "CLNVC={kind};GENEINFO={gene};MC={mc}")
NONSENSE = "SO:0001583|missense,SO:0001587|nonsense"


def vcf(spark, *records):
    lines = ["##fileformat=VCFv4.1", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    for i, given in enumerate(records):
        r = {"alt": "T", "sig": "Pathogenic", "kind": "single_nucleotide_variant",
             "gene": "CFTR:1080|OTHER:2", "mc": NONSENSE, "name": "x"} | given
        lines.append(f"7\t{100 + i}\t.\tC\t{r['alt']}\t.\t.\t" + INFO.format(i=i, **r))
    return src.parse_vcf(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_only_pathogenic_nonsense_substitutions_are_kept(spark):
    found = var.pathogenic_nonsense(vcf(
        spark, {}, {"sig": "Likely_pathogenic|risk"}, {"sig": "Benign"}, {"kind": "Deletion"},
        {"mc": "SO:0001583|missense"}, {"alt": "T,G"}, {"alt": "."}, {"gene": "NOID"},
        {"alt": "R"}, {"sig": "Conflicting_classifications_of_pathogenicity"}))
    kept, lost = var.split_alleles(found)
    assert sorted(r.variant_id for r in kept.collect()) == ["h0", "h1"]
    first = kept.where("variant_id = 'h0'").first()
    assert (first.gene_symbol, first.gene_id, first.review_stars, first.allele_id) == (
        "CFTR", 1080, 3, 7)
    assert first.condition_xrefs == ""
    assert lost.first().ambiguous_alleles == 1
    assert not ct.violations(kept, ct.PATHOGENIC_NONSENSE).collect()


def test_conditions_keep_order_sources_and_status(spark):
    df = spark.createDataFrame([
        ("a", "Cystic fibrosis|not provided|Odd|Plain",
         "MedGen:C1,OMIM:2,OMIM:PS9,OMIM:2,MONDO:MONDO:0009,Orphanet:Orphanet:586|MedGen:C3661900"
         "|Other:4|MedGen:C5"),
        ("b", None, None), ("c", "Lone", "")], "variant_id string, conditions string, "
        "condition_xrefs string")
    found = {(r.variant_id, r.condition_name): r for r in var.normalize_conditions(df).collect()}
    assert len(found) == 5
    first = found["a", "Cystic fibrosis"]
    assert (first.medgen, first.omim, first.mondo, first.orphanet) == (
        "C1", "2;PS9", "MONDO:0009", "Orphanet:586")
    assert [found["a", n].mapping_status for n in (
        "Cystic fibrosis", "not provided", "Odd", "Plain")] == [
        "mapped", "placeholder", "unmapped", "medgen_only"]
    assert found["c", "Lone"].mapping_status == "unmapped"


def test_triage_is_total(spark):
    pairs = [(str(i), c, s) for i, (c, s) in enumerate(
        (c, s) for c in CONSEQUENCES for s in (True, False))]
    df = spark.createDataFrame(pairs, "variant_id string, consequence string, "
                                      "transcript_supported boolean")
    found = var.triage(df)
    assert not ct.violations(found, ct.TRIAGE_OUTPUT).collect()
    assert [r.consequence for r in found.where("applies").collect()] == ["stop_gained"]
    assert found.where("triage_class = 'unsupported_transcript'").count() == len(CONSEQUENCES)
    assert found.where("triage_class = 'unsupported'").count() == 2


def test_contract_reports_every_failure_at_once(spark):
    df = spark.createDataFrame(
        [("c1", "", "supported"), ("c1", "x", "maybe"), ("c2", None, "refuted")],
        "claim_id string, detail string, verdict string")
    for name in ct.CLAIMS_LEDGER.columns:
        if name not in df.columns and name != "source":
            df = df.withColumn(name, F.lit("x"))
    found = {(r.column_name, r.check_name): r.failures
             for r in ct.violations(df, ct.CLAIMS_LEDGER).collect()}
    assert found == {("source", "missing_column"): 1, ("detail", "not_blank"): 1,
                     ("detail", "not_null"): 1, ("verdict", "isin"): 1, ("claim_id", "unique"): 1}
    with pytest.raises(ValueError, match="claim_id.unique"):
        ct.require(df, ct.CLAIMS_LEDGER)


CONTEXT = ("variant_id string, gene_symbol string, scoreable boolean, in_last_exon boolean, "
           "nt_to_last_junction int, nt_from_start int, ptc_exon_length int")


def test_decay_window_is_one_sided_and_missing_is_not_met(spark):
    df = spark.createDataFrame([
        ("in", "g", True, False, 50, 999, 100), ("out", "g", True, False, 51, 999, 100),
        ("at", "g", True, False, 0, 999, 100), ("last", "g", True, True, -5, 999, 100),
        ("none", "g", True, False, None, 149, 100), ("long", "g", True, False, 400, 150, 408),
        ("un", "g", False, None, None, None, None)], CONTEXT)
    found = {r.variant_id: r for r in dec.decay_predictors(df).collect()}
    assert "un" not in found
    assert {k for k, r in found.items() if r.escape_guideline} == {"in", "last"}
    assert {k for k, r in found.items() if r.predictors_disagree} == {"none", "long"}
    atlas = dec.disagreement_atlas(dec.decay_predictors(df)).first()
    assert (atlas.scoreable, atlas.driven_by_start_proximal, atlas.driven_by_long_exon) == (6, 1, 1)
    assert atlas.disagree_fraction == 0.3333


def test_external_verdict_reasons(spark):
    variants = spark.createDataFrame([
        ("hit", 1, "1", 5, "A", "G", 0), ("hit", 1, "1", 6, "A", "G", 1),
        ("filtered", 1, "1", 7, "A", "G", 2), ("absent", 2, "1", 8, "A", "G", 3),
        ("none", 3, "1", 9, "A", "G", 4)],
        "variant_id string, gene_id bigint, chrom string, pos bigint, ref string, alt string, "
        "ordinal bigint")
    rules = dec.rule_table(spark.createDataFrame(
        [("1:000000005|A|G", "E1.3", True, False, True, False, False, False, 0)],
        "key string, transcript string, is_ptc boolean, is_last boolean, is_penultimate boolean, "
        "is_css_proximal boolean, is_single boolean, is_407plus boolean, ordinal bigint"))
    mane = spark.createDataFrame([(1, "E1"), (2, "E2")], "gene_id bigint, mane_enst string")
    found = {r.variant_id: (r.aenmd_available, r.reason, r.aenmd_escape)
             for r in dec.external_verdicts(rules, variants, mane).collect()}
    assert found == {"hit": (True, "", True), "filtered": (False, "variant_filtered", False),
                     "absent": (False, "transcript_absent", False),
                     "none": (False, "no_mane_ensembl", False)}


def test_residue_tables():
    assert near_cognate("TAG") == ("E", "K", "L", "Q", "S", "W", "Y")
    scores = substitution_scores()
    assert len(scores) == 400 and scores["W", "W"] == 11 and scores["A", "W"] == -3
    share = land.tolerable_shares()
    assert share["WTGA"] == pytest.approx(sum(scores["W", x] >= 0 for x in near_cognate("TGA")) / 6)


def test_best_therapy_uses_present_rows_and_breaks_ties_by_name(spark):
    df = spark.createDataFrame(
        [("a", "t2", 0.3, "present"), ("a", "t1", 0.3, "present"), ("a", "t0", 0.9, "missing")],
        "variant_id string, therapy_id string, readthrough_predicted double, status string")
    df = df.withColumn("readthrough_low", F.col("readthrough_predicted"))
    assert land.best_present(df).first().best_therapy == "t1"
