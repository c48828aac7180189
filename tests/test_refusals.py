"""Runs that must stop: each refusal names the rows it found."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stopscan.operators import codons as cod
from stopscan.operators import footprints as fp
from stopscan.operators import kinetics as kin
from stopscan.operators import model as mod
from stopscan.operators import reads as rd
from stopscan.plans.amenability import amenability
from stopscan.plans.carriers import Tables
from stopscan.plans.contrast import readthrough_contrast
from stopscan.plans.queries_plans import amenability_inputs


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def contrast(t, calibrated="d1", arms=None, floor=1):
    return readthrough_contrast(
        t("counts"), t("frames"), t("offsets"), t("arms") if arms is None else arms, t("gtf"),
        t("genes"), "treated", "control", "d1", calibrated, minimum_psites=floor)


def test_a_contrast_stops_on_calibration_dataset_and_absent_libraries(t):
    with pytest.raises(ValueError, match="may not be contrasted: .*failures=psites"):
        contrast(t, floor=10 ** 9)
    with pytest.raises(ValueError, match="may not be contrasted"):
        contrast(t, calibrated="d2")
    more = t("arms").unionByName(t("arms").limit(1).withColumn("sample", F.lit("s99")))
    with pytest.raises(ValueError, match="sample=s99, failures=without counts"):
        contrast(t, arms=more)


def test_a_placement_against_its_protein_stops_the_arm(t):
    given = amenability_inputs(t)
    given["proteins"] = given["proteins"].withColumn(
        "sequence", F.regexp_replace("sequence", "[^*]", "X"))
    with pytest.raises(ValueError, match="contradict their proteins: variant_id="):
        amenability(**given)


def test_unknown_and_repeated_codons_are_errors(spark):
    table = "codon string, site string, occupancy double"
    twice = spark.createDataFrame([("AAA", "a", 1.0), ("AAA", "a", 2.0)], table)
    with pytest.raises(Exception, match="codon scored more than once: AAA"):
        kin.codon_scores(twice).collect()
    one = kin.codon_scores(spark.createDataFrame([("AAA", "a", 1.0)], table))
    rows = spark.createDataFrame([("aaa", "aac")], "up_123nt string, down_123nt string")
    with pytest.raises(Exception, match="no kinetic score for codon AAC"):
        kin.attach(rows, one).collect()
    assert kin.attach(rows, one, strict=False).first().k_down is None
    assert [tuple(r) for r in kin.unscored_triplets(rows, one).collect()] == [
        ("down_123nt", "AAC", 1)]


def samples(spark, rows):
    return spark.createDataFrame(rows, "treatment string, identifier int, replicate int, "
                                       "fitness_rep double, RT_binomial double")


def test_replicates_are_checked_before_their_ceiling(spark):
    good = [("a", i, k, float(i * i + 3 * k * (i % 3)), (2 * i * i + 9 * (i % 3)) / 200.0)
            for i in range(6) for k in (1, 2)]
    found = mod.reliability(samples(spark, good)).first()
    assert found.variants == 6 and found.ceiling > found.single_replicate
    with pytest.raises(Exception, match="replicate 1 repeated in a 0"):
        mod.reliability(samples(spark, [*good, good[0]])).collect()
    apart = [(*r[:4], r[4] + (i == 3)) for i, r in enumerate(good)]
    with pytest.raises(Exception, match="merged responses differ in a 1"):
        mod.reliability(samples(spark, apart)).collect()
    other = [(*r[:4], float(r[1] % 2)) for r in good]
    with pytest.raises(Exception, match="not the mean of their replicates"):
        mod.reliability(samples(spark, other)).collect()


def test_a_library_without_statistics_is_an_error(spark):
    runs = spark.createDataFrame([("s1", "srr1", "d1", "rnaseq"), ("s2", "srr2", "d1", "rnaseq")],
                                 "sample string, run_accession string, dataset string, assay string")
    trimming = spark.createDataFrame(
        [("s1", 10, 9, 0.9, 0.5), ("s2", 10, 9, 0.9, 0.5)], "sample string, reads_raw long, "
        "reads_cleaned long, reads_retained double, adapter_rate double")
    stats = spark.createDataFrame(
        [(f"{p}_1", 50.0, 20.0) for p in ("s1", "srr1", "s2", "srr2")],
        "Sample string, percent_gc double, percent_duplicates double")
    assert rd.course_qc(runs, stats, trimming, "d1").count() == 2
    with pytest.raises(Exception, match="no trimming or statistics for s2"):
        rd.course_qc(runs, stats.where("Sample <> 'srr2_1'"), trimming, "d1").collect()
    with pytest.raises(Exception, match="no trimming or statistics for s2"):
        rd.course_qc(runs, stats, trimming.where("sample = 's1'"), "d1").collect()


def test_offsets_beyond_the_bound_are_joined_by_shuffle(spark, monkeypatch):
    reads = spark.createDataFrame([("s", 28, "t", 10), ("s", 29, "t", 11), ("s", 40, "t", 12)],
                                  "sample string, length int, transcript string, end5 int")
    offsets = spark.createDataFrame([("s", 28, 12), ("s", 29, 13)], "sample string, length int, "
                                    "corrected_offset_from_5 int")
    annotation = spark.createDataFrame([("t", 5, 30, 9)], "transcript string, l_utr5 int, "
                                       "l_cds int, l_utr3 int")
    one = fp.assign_psites(reads, offsets, annotation)
    assert "broadcast" in one._jdf.queryExecution().toString().lower()
    monkeypatch.setattr(fp, "OFFSET_ROWS", 1)
    two = fp.assign_psites(reads, offsets, annotation)
    assert sorted(map(tuple, one.select("end5", "psite").collect())) == sorted(
        map(tuple, two.select("end5", "psite").collect())) == [(10, 22), (11, 24)]


def test_a_codon_feature_is_not_built_from_a_treated_or_unnamed_library(spark):
    counts = spark.createDataFrame(
        [(s, "t", 30, 6, 10) for s in ("c", "x", "u")],
        "sample string, transcript string, length int, codon_index int, n bigint")
    arms = spark.createDataFrame([("c", "control"), ("x", "drug")], "sample string, treatment string")
    windows = spark.createDataFrame([("t", "CCC" * 60)], "transcript string, codons string")

    def table(*samples):
        return cod.control_table(counts.where(F.col("sample").isin(*samples)), arms, "control",
                                 windows, minimum_psites=1, minimum_codons=1)

    assert table("c").where("positions > 0").count() == 1
    for samples, named in ((("c", "x"), "sample=x, treatment=drug"),
                           (("c", "u"), "sample=u, treatment=None")):
        with pytest.raises(ValueError, match=f"not control libraries.*{named}"):
            table(*samples)
