"""Plans and paths that large tables need, seen on small ones."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stopscan.operators import codons as cod
from stopscan.operators import native_stops as nat
from stopscan.operators import placement as plc
from stopscan.operators import resampling as res
from stopscan.plans import carriers, load
from stopscan.plans.carriers import Tables
from stopscan.plans.queries_footprints import codon_counts_of, codon_windows
from stopscan.plans.queries_variants import models
from stopscan.sources import text as src

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_that_become_sequences_are_dealt_by_number(spark, monkeypatch):
    whole = {tuple(r) for r in Tables(spark, FOLDER)("seqs").collect()}
    monkeypatch.setattr(carriers, "ROWS_PER_TASK", 50)
    spread = Tables(spark, FOLDER)("seqs")
    assert spread.rdd.getNumPartitions() == -(-len(whole) // 50) > 1
    assert {tuple(r) for r in spread.collect()} == whole


def test_sequences_are_not_broadcast(spark):
    t = Tables(spark, FOLDER)
    assert "Broadcast" not in plan(t("variants"))
    contexts = plc.stop_contexts(t("variants"), plc.one_model_per_gene(models(t)))
    assert "Broadcast" not in plan(contexts)
    proteins = t("seqs").select("accession", "sequence")
    assert "Broadcast" not in plan(plc.protein_disagreements(contexts, proteins))
    annotation, fasta = t("seqs").drop("sequence"), t("seqs").select("accession", "sequence")
    assert "Broadcast" not in plan(nat.extension_peptides(
        annotation, fasta, nat.extension_windows(annotation, fasta)))


def test_codons_are_counted_for_sets_of_libraries(spark):
    codons = "AAA" * 70
    windows = spark.createDataFrame([("a", codons), ("b", codons)], "transcript string, codons string")
    counts = spark.createDataFrame(
        [(s, t, 30, i, 2) for s, t in (("s", "a"), ("s", "b"), ("u", "b")) for i in range(5, 75)],
        "sample string, transcript string, length int, codon_index int, n long")
    found = cod.library_table(counts, windows)
    assert not re.search(r"Aggregate \[transcript#\d+, codon#",
                         found._jdf.queryExecution().optimizedPlan().toString())
    assert {(r["sample"], r["positions"], r["transcripts"]) for r in found.where(
        "codon = 'AAA'").collect()} == {("s", 140, 2), ("u", 70, 1)}


def test_pairs_of_a_bootstrap_do_not_pass_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=250), 1)
    pairs = spark.createDataFrame(pd.DataFrame(
        {"id": np.arange(250), "x": x, "y": np.round(x + rng.normal(size=250), 1)}))
    monkeypatch.setattr(nat, "SLOTS", 100)
    two = nat.joined_draws(pairs, "id", 30, 1).toPandas().sort_values("draw")["rho"].to_numpy()

    def refused(self):
        raise AssertionError("collected")

    with monkeypatch.context() as m:
        m.setattr(type(pairs), "toPandas", refused)
        one = nat.compact_draws(pairs, "id", 30, 1).orderBy("draw").collect()
    assert [r["draw"] for r in one] == list(range(30))
    assert [r["rho"] for r in one] == pytest.approx(two.tolist(), abs=1e-12)
    assert "Broadcast" not in plan(Tables(spark, FOLDER)("paired_scores"))


@pytest.mark.parametrize("name, folder", [
    ("editing_guides", FOLDER), ("panel_comparison", FOLDER),
    ("amenability_run", "/root/testdata/sf0.01")])
def test_a_variant_is_placed_and_searched_once(spark, name, folder):
    found = load()[0][name](spark, folder)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    # A filter pushed below the search would spell the placement and its reasons again.
    assert text.count("reference_mismatch") == 1


def test_codon_counts_meet_in_tasks_of_bounded_rows(spark, monkeypatch):
    whole = sorted(map(str, load()[0]["codon_occupancy"](spark, FOLDER).collect()))
    monkeypatch.setattr(carriers, "DEALT_ROWS", 1000)
    t = Tables(spark, FOLDER)
    tasks = -(-t.table("lineitem").count() // 1000)
    assert codon_counts_of(t).rdd.getNumPartitions() == codon_windows(t).rdd.getNumPartitions() == tasks
    assert sorted(map(str, load()[0]["codon_occupancy"](spark, FOLDER).collect())) == whole


def test_buckets_of_a_bootstrap_meet_in_tasks_of_bounded_rows(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), "id", F.sin("id").alias("v"))

    def sums():
        return res.bootstrap_sums(rows, ["g"], ["id"], ["v"], 5, 1, bucket_rows=100)

    whole = {(r.g, r.draw): (r.n, r.v) for r in sums().collect()}
    monkeypatch.setattr(res, "TASK_ROWS", 500)
    assert "REPARTITION_BY_NUM" in plan(sums())
    found = {(r.g, r.draw): (r.n, r.v) for r in sums().collect()}
    assert found.keys() == whole.keys()
    assert all(found[k] == pytest.approx(whole[k]) for k in whole)


def test_replicates_meet_in_tasks_of_bounded_rows(spark, monkeypatch):
    whole = sorted(map(str, load()[0]["reliability"](spark, FOLDER).collect()))
    monkeypatch.setattr(carriers, "DEALT_ROWS", 1000)
    found = load()[0]["reliability"](spark, FOLDER)
    assert "REPARTITION_BY_NUM" in plan(found)
    assert sorted(map(str, found.collect())) == whole


def test_lines_of_a_split_are_not_shuffled(spark, tmp_path, request):
    folder = str(tmp_path / "reads")
    spark.range(4000, numPartitions=3).select(F.col("id").cast("string")).write.text(folder)
    # As on large files, which the planner does not take for small ones.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    lines = src.read_numbered_lines(spark, folder)
    assert "SortMergeJoin" not in plan(lines) and "ShuffledHashJoin" not in plan(lines)
    assert lines.count() == 4000
    assert lines.groupBy("file").agg((F.max("line") + 1 == F.count("line")).alias("ok")).where(
        "not ok").count() == 0
