"""From alignments to effects: windows, lengths, universes, pooled ratios, intervals, power."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stopscan.functions.fixed import COUNT_COLUMNS
from stopscan.functions.scalars import t_quantile_value
from stopscan.operators import codons as cod
from stopscan.operators import detectability as det
from stopscan.operators import effects as eff
from stopscan.operators import footprints as fp
from stopscan.operators import native_stops as nat
from stopscan.operators import payloads as pay
from stopscan.operators.resampling import STEP, bootstrap_mean_ci, bootstrap_sums, mixed

COUNTS = ("transcript string, sample string, length int, extension int, l_cds int, l_utr3 int, "
          + ", ".join(f"{c} bigint" for c in COUNT_COLUMNS))


def count(**given):
    base = {"transcript": "t1", "sample": "s1", "length": 30, "extension": 60, "l_cds": 900,
            "l_utr3": 200, "cds_frame0": 200, "cds_frame1": 50, "cds_frame2": 50,
            "extension_frame0": 4, "extension_frame1": 2, "extension_frame2": 2,
            "termination": 20} | given
    base["cds_total"] = base["cds_frame0"] + base["cds_frame1"] + base["cds_frame2"]
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return tuple(base[n] for n in names)


def table(spark, *rows):
    return spark.createDataFrame([count(**r) for r in rows], COUNTS)


def test_windows_are_disjoint_and_framed(spark):
    # l_utr5 = 10, l_cds = 90: the stop's last base is psite 100, so from_stop = psite - 100.
    reads = spark.createDataFrame(
        [("s", "t", 30, 0, p - 12) for p in (5, 11, 28, 29, 84, 85, 100, 101, 104, 111, 112, 113)]
        + [("s", "t", 30, 256, 40)],
        "sample string, transcript string, length int, flag int, end5 int")
    offsets = spark.createDataFrame([("s", 30, 1.0, 12, 17)],
                                    "sample string, length int, total_percentage double, "
                                    "corrected_offset_from_5 int, corrected_offset_from_3 int")
    annotation = spark.createDataFrame([("t", 10, 90, 50)],
                                       "transcript string, l_utr5 int, l_cds int, l_utr3 int")
    ps = fp.assign_psites(fp.primary_footprints(reads), offsets, annotation)
    assert ps.count() == 12
    assert {r.region: r.n for r in fp.region_fractions(ps).collect()} == {
        "5utr": 1, "cds": 6, "3utr": 5}
    ext = spark.createDataFrame([("t", 15)], "transcript string, extension int")
    row = fp.readthrough_counts(ps, ext).first()
    # Internal coding runs from +18 to -16: psites 29 and 84 of those near its edges.
    assert row.cds_total == 2 and row.termination == 2
    assert (row.extension_frame0, row.extension_frame1, row.extension_frame2) == (2, 1, 1)
    shift = {r.shift: r.frame0 for r in fp.offset_shift_check(ps, offsets).collect()}
    assert set(shift) == {-2, -1, 0, 1, 2} and shift[-2] == shift[1]
    profile = fp.metaprofile(ps)
    assert profile.count() == 150 and profile.agg(F.sum("count")).first()[0] > 0


FRAMES = "sample string, length int, frame int, n bigint"


def frames(spark, extra=()):
    rows = [(s, 28, f, n) for s in ("a", "b") for f, n in enumerate((600, 200, 200))]
    rows += [("a", 29, 0, 500), ("a", 29, 1, 100), ("b", 29, 0, 100), ("b", 29, 1, 500)]
    rows += [(s, 30, 0, 3) for s in ("a", "b")]
    return spark.createDataFrame(rows + list(extra), FRAMES)


def test_a_length_must_be_periodic_in_every_library_and_not_tiny(spark):
    assert [r.length for r in fp.shared_lengths(frames(spark)).collect()] == [28]


def test_verdicts_name_each_failure(spark):
    offsets = spark.createDataFrame(
        [("a", 28, 60.0, 12, 15), ("a", 29, 40.0, 20, 9), ("b", 28, 60.0, 16, 12)],
        "sample string, length int, total_percentage double, corrected_offset_from_5 int, "
        "corrected_offset_from_3 int")
    found = {r["sample"]: r for r in
             fp.library_verdicts(frames(spark), offsets, minimum_psites=1000)
             .withColumn("kind", fp.failure_kind()).collect()}
    assert (found["a"].failures, found["a"].kind, found["a"].offset_from_5) == ("", "none", 12)
    assert (found["b"].failures, found["b"].kind) == ("offset", "validity")
    thin = fp.library_verdicts(frames(spark), offsets).withColumn("kind", fp.failure_kind())
    assert thin.where("sample = 'a'").first().kind == "precision"
    assert fp.manifest_gate(thin, "d1", "d1").count() == 2
    assert fp.manifest_gate(fp.library_verdicts(frames(spark), offsets, 1000), "d1", "d2").count() == 2


def test_collapse_then_pool_equals_pooling_directly(spark):
    df = table(spark, {"length": 28}, {"length": 29, "cds_frame0": 7},
               {"length": 40, "cds_frame0": 1000}, {"sample": "s2", "length": 28})
    kept = fp.collapse_lengths(df, (28, 29))
    assert {(r["sample"], r.cds_frame0) for r in kept.collect()} == {("s1", 207), ("s2", 200)}
    wanted = df.where("length in (28, 29)").groupBy("sample").sum("cds_frame0").collect()
    assert {r["sample"]: r[1] for r in wanted} == {
        r["sample"]: r.cds_frame0_total for r in fp.library_ratios(kept).collect()}
    with pytest.raises(ValueError):
        fp.collapse_lengths(df.drop("length"), (28,))


def test_one_universe_for_the_libraries_asked_for(spark):
    df = table(spark, {"sample": "s1"}, {"sample": "s2"}, {"sample": "s1", "transcript": "t2"},
               {"sample": "s2", "transcript": "t2", "cds_frame0": 99},
               {"sample": "s1", "transcript": "t3", "l_utr3": 49},
               {"sample": "s1", "transcript": "t4", "extension": None},
               {"sample": "s3", "transcript": "t9"})
    asked = spark.createDataFrame([("s1",), ("s2",)], "sample string")
    assert {r.transcript for r in fp.qualifying(df, samples=asked).collect()} == {"t1"}
    missing = spark.createDataFrame([("s1",), ("s2",), ("s9",)], "sample string")
    assert fp.qualifying(df, samples=missing).count() == 0
    genes = spark.createDataFrame([("t1", "VDR")], "transcript string, gene string")
    assert fp.qualifying(df, genes=genes, samples=asked).count() == 0


def test_ratios_are_pooled_before_dividing(spark):
    df = table(spark, {"transcript": "t1", "cds_frame0": 100, "extension_frame0": 10},
               {"transcript": "t2", "cds_frame0": 900, "extension_frame0": 0,
                "extension_frame1": 0, "extension_frame2": 0})
    row = fp.library_ratios(df).first()
    assert row.downstream_occupancy == pytest.approx(10 / 1000)
    assert row.median_readthrough == pytest.approx(0.05) and row.with_downstream == 0.5
    assert row.frame_gap == pytest.approx(10 / 14 - 1000 / 1200)


ARMS = "sample string, treatment string, replicate int"


def arms_and_ratios(spark, treated, control):
    rows, ratios = [], []
    for arm, values in (("g", treated), ("d", control)):
        for i, v in enumerate(values, 1):
            rows.append((f"{arm}{i}", arm, i))
            ratios.append((f"{arm}{i}", *[float(v)] * 3))
    return (spark.createDataFrame(ratios, "sample string, downstream_occupancy double, "
                                          "termination_occupancy double, frame_gap double"),
            spark.createDataFrame(rows, ARMS))


def test_welch_interval_floors_its_degrees_of_freedom(spark):
    a, b = np.array([3.0, 3.4, 3.1]), np.array([1.0, 2.0, 1.2])
    found = eff.unpaired_effects(*arms_and_ratios(spark, a, b), "g", "d").first()
    va, vb = a.var(ddof=1) / 3, b.var(ddof=1) / 3
    df = max(1, math.floor((va + vb) ** 2 / (va**2 / 2 + vb**2 / 2)))
    half = t_quantile_value(0.975, df) * math.sqrt(va + vb)
    assert found.mean_difference == pytest.approx(a.mean() - b.mean())
    assert found.ci_low == pytest.approx(a.mean() - b.mean() - half)
    assert found.consistent
    point = eff.unpaired_effects(*arms_and_ratios(spark, [2, 2.0], [1, 1.0]), "g", "d").first()
    assert point.ci_low == point.ci_high == 1.0
    lone = eff.unpaired_effects(*arms_and_ratios(spark, [2.0], [1.0, 1.5]), "g", "d").first()
    assert lone.ci_low is None


def test_paired_effect_needs_whole_replicates(spark):
    found = eff.paired_effects(*arms_and_ratios(spark, [1.0, 2.0, 4.0], [0.5, 1.0, 2.0]),
                               "g", "d").first()
    d = np.array([0.5, 1.0, 2.0])
    half = t_quantile_value(0.975, 2) * d.std(ddof=1) / math.sqrt(3)
    assert found.ci_high == pytest.approx(d.mean() + half) and found.consistent
    broken = eff.paired_effects(*arms_and_ratios(spark, [1.0, 2.0], [0.5]), "g", "d").first()
    assert broken.mean_difference is None


def test_signature_and_stalling(spark):
    rows = [("downstream_occupancy", 0.1, 0.01, 0.2, True),
            ("termination_occupancy", -0.1, -0.2, 0.1, True), ("frame_gap", 0.2, 0.1, 0.3, True)]
    schema = ("quantity string, mean_difference double, ci_low double, ci_high double, "
              "consistent boolean")
    full = eff.signature(spark.createDataFrame(rows, schema)).first()
    assert full.complete and not full.stalling and full.termination_arms_separate
    rows[2] = ("frame_gap", 0.2, -0.1, 0.3, True)
    assert not eff.signature(spark.createDataFrame(rows, schema)).first().frame_moved_to_coding
    stalled = [(q, -m, lo, hi, c) for q, m, lo, hi, c in rows]
    assert eff.signature(spark.createDataFrame(stalled, schema)).first().stalling


def design(spark, treated, control, errors, target):
    ratios, arms = arms_and_ratios(spark, treated, control)
    counting = arms.select("sample", *[F.lit(float(errors)).alias(q) for q in (
        "downstream_occupancy", "termination_occupancy", "frame_gap")])
    targets = dict.fromkeys(("downstream_occupancy", "termination_occupancy", "frame_gap"), target)
    return det.detectability(ratios, counting, arms, "g", "d", targets).where(
        "quantity = 'frame_gap'").first()


def test_detectability_splits_variance_and_solves_depth(spark):
    spread = design(spark, [0.1, 0.3], [0.1, 0.4], 1e-4, 0.1)
    assert spread.between_library_share > 0.99 and math.isinf(spread.depth_multiplier_at_least)
    assert spread.variance_degrees_of_freedom == 2 and spread.replicates_required > 2
    agreeing = design(spark, [0.2, 0.2], [0.2, 0.2], 0.05, 0.01)
    assert agreeing.irreducible_effect == 0.0 and agreeing.depth_multiplier_at_least > 1
    k = t_quantile_value(0.975, 2) + t_quantile_value(0.8, 2)
    at = k * math.sqrt(0.05**2 / agreeing.depth_multiplier_at_least)
    assert at == pytest.approx(0.01)
    precise = design(spark, [0.2, 0.2], [0.2, 0.2], 1e-5, -0.01)
    assert (precise.depth_multiplier_at_least, precise.replicates_required) == (1.0, 2)


def test_counting_error_is_finite_at_zero_and_falls_with_depth(spark):
    df = table(spark, {"sample": "thin"},
               {"sample": "deep", **{c: 100 * v for c, v in (
                   ("cds_frame0", 200), ("extension_frame0", 4), ("termination", 20))}},
               {"sample": "empty", "extension_frame0": 0})
    found = {r["sample"]: r.downstream_occupancy for r in det.counting_error(df).collect()}
    assert found["deep"] == pytest.approx(found["thin"] / 10, rel=0.01)
    assert 0 < found["empty"] < 1


def test_bucketed_bootstrap_is_a_multinomial_resample(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"g": "hot", "id": np.arange(900), "v": rng.normal(5, 2, 900)})
    df = spark.createDataFrame(data)
    sums = bootstrap_sums(df, ["g"], ["id"], ["v"], 400, 1, bucket_rows=100).toPandas()
    assert (sums["n"] == 900).all() and len(sums) == 400
    means = sums["v"] / sums["n"]
    assert means.mean() == pytest.approx(data.v.mean(), abs=0.02)
    assert means.std() == pytest.approx(data.v.std() / 30, rel=0.15)
    again = bootstrap_sums(df.repartition(3), ["g"], ["id"], ["v"], 400, 1, bucket_rows=100)
    assert again.toPandas()["v"].sum() == pytest.approx(sums["v"].sum())
    ci = bootstrap_mean_ci(df, ["g"], ["id"], "v", 400).first()
    assert ci.ci_low < ci.point < ci.ci_high and not ci.includes_zero


def test_picks_are_spread_and_repeat_in_plain_integers():
    draws, slots = np.arange(2000, dtype=np.int64)[:, None], np.arange(10, dtype=np.int64)[None, :]
    picks = mixed(721, 5, 0, draws, slots) % 10
    counts = np.bincount(picks.ravel(), minlength=10)
    assert ((counts - 2000) ** 2 / 2000).sum() < 30
    # Slots of one draw, and one slot of neighbouring draws, are as good as unrelated.
    assert abs(np.corrcoef(picks[:, 0], picks[:, 1])[0, 1]) < 0.08
    assert abs(np.corrcoef(picks[:-1, 3], picks[1:, 3])[0, 1]) < 0.08
    found, prime = 0, (1 << 31) - 1
    for number in (721, 5, 0, 17, 3, 0):
        found = pow(found + number + STEP, 5, prime)
    assert picks[17, 3] == found % 10


def test_codon_occupancy_counts_empty_positions(spark):
    sequence = "ATG" + "AAA" * 3 + "CCC" * 40 + "GGG" * 40 + "TAA" + "C" * 30
    annotation = spark.createDataFrame([("t", 0, len(sequence) - 30, 30)],
                                       "transcript string, l_utr5 int, l_cds int, l_utr3 int")
    fasta = spark.createDataFrame([("t", sequence)], "accession string, sequence string")
    windows = cod.scorable_windows(annotation, fasta)
    held = windows.first().codons
    assert held.startswith("CCC") and len(held) // 3 == (len(sequence) - 30 - 17) // 3 - 5
    counts = spark.createDataFrame([("s", "t", 30, i, 10) for i in range(5, 25)],
                                   "sample string, transcript string, length int, "
                                   "codon_index int, n bigint")
    found = {r.codon: r for r in cod.library_table(counts, windows).collect()}
    n = len(held) // 3
    ccc = held.count("CCC")
    assert len(found) == 61 and found["GGG"].occupancy == 0.0 and found["AAC"].occupancy is None
    assert found["CCC"].occupancy == pytest.approx((200 / (200 / n)) / ccc)
    assert cod.library_table(counts, windows, minimum_psites=500).count() == 0


def test_next_stop_and_peptide(spark):
    annotation = spark.createDataFrame(
        [("a", 3, 9, 0), ("b", 0, 9, 0), ("c", 0, 8, 0)],
        "transcript string, l_utr5 int, l_cds int, l_utr3 int")
    fasta = spark.createDataFrame(
        [("a", "GGGATGAAATGACCCGGGTAACC"), ("b", "ATGAAATAGCCCC"), ("c", "ATGAAATAGTAA")],
        "accession string, sequence string")
    windows = nat.extension_windows(annotation, fasta)
    assert {r.transcript: r.extension for r in windows.collect()} == {"a": 9, "b": None, "c": None}
    peptide = nat.extension_peptides(annotation, fasta, windows).first()
    assert (peptide.extension_peptide, peptide.extension_aa) == ("PG", 2)
    assert {(r.transcript, r.stop_type, r.up_123nt, r.down_123nt)
            for r in nat.native_stop_features(annotation, fasta).collect()} == {
        ("a", "uga", "aaa", "ccc"), ("b", "uag", "aaa", "ccc")}


def test_peptides_find_their_windows_in_one_join(spark):
    annotation = spark.createDataFrame(
        [("a", 3, 9), ("b", 0, 9), ("c", 0, 8), ("d", 0, 6)],
        "transcript string, l_utr5 int, l_cds int")
    fasta = spark.createDataFrame(
        [("a", "GGGATGAAATGACCCGGGTAACC"), ("b", "ATGAAATAGCCCC"), ("c", "ATGAAATAGTAA"),
         ("d", "ATGTGATAA")], "accession string, sequence string")
    found = nat.extension_peptides(annotation, fasta)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [("a", 9, 2, "PG"), ("d", 3, 0, "")]
    windows = nat.extension_windows(annotation, fasta)
    assert rows == sorted(tuple(r) for r in nat.extension_peptides(
        annotation, fasta, windows).collect())


def test_joined_bootstrap_agrees_with_the_compact_one(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    pairs = spark.createDataFrame(pd.DataFrame(
        {"id": np.arange(60), "x": x, "y": np.round(x + rng.normal(size=60), 1)}))
    one = nat.compact_draws(pairs, "id", 60, 1).toPandas().sort_values("draw")["rho"]
    two = nat.joined_draws(pairs, "id", 60, 1).toPandas().sort_values("draw")["rho"]
    assert len(one) == len(two) == 60 and one.nunique() == 60
    assert one.to_numpy() == pytest.approx(two.to_numpy(), abs=1e-12)
    few = nat.concordance(pairs.limit(19), "x", "y", "id").first()
    assert few.n == 19 and few.rho is None


def test_payload_refuses_nan_and_writes_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    assert pay.refuse_nan(df).count() == 2
    assert df.where("k = 'b'").select(pay.as_json(F.struct("k", "v"))).first()[0] == (
        '{"k":"b","v":null}')
    bad = spark.createDataFrame([("a", float("nan"))], "k string, v double")
    with pytest.raises(Exception, match="NaN"):
        pay.refuse_nan(bad).collect()
