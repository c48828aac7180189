"""Fits, splits, shuffles, the permutation null and resuming it."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stopscan.functions import binomial
from stopscan.functions.binomial import MODELS, fit_cells, independent, squared_correlation
from stopscan.functions.fixed import PERMUTATIONS_REQUIRED, ROUNDS
from stopscan.operators import evaluation as ev
from stopscan.operators import kinetics as kin
from stopscan.operators import model as mod
from stopscan.operators import permutation as perm
from stopscan.operators import selection, wide_fits
from stopscan.plans import queries_models as qm
from stopscan.plans.carriers import Tables
from stopscan.streaming import incremental as inc

STOPS, UPS, DOWNS = ("uaa", "uag", "uga"), ("aaa", "ccg", "gga"), ("aac", "cuu", "ggg")


@pytest.fixture(scope="module")
def library():
    rng = np.random.default_rng(7)
    rows = []
    for i in range(900):
        s, u, d = rng.integers(0, 3, 3)
        p = 1 / (1 + np.exp(-(-2 + 0.5 * s + 0.3 * u - 0.4 * d + 0.2 * (s == d))))
        rows.append(("D" if i % 2 else "E", i, f"g{rng.integers(0, 12)}", STOPS[s], UPS[u],
                     DOWNS[d], float(np.clip(p + rng.normal(0, 0.02), 0, 1))))
    return pd.DataFrame(rows, columns=["drug", "row", "gene", "stop_type", "up_123nt",
                                       "down_123nt", "RT_binomial"])


@pytest.fixture(scope="module")
def features(spark, library):
    return spark.createDataFrame(library)


def test_a_later_dependent_column_is_dropped():
    x = np.array([[1.0, 0, 1, 2], [0, 1, 1, 0], [1, 1, 2, 1], [0, 0, 0, 3]])
    assert list(independent(x)) == [0, 1, 3]
    assert list(independent(np.array([[1.0, 0], [2, 0]]))) == [0]


def test_cells_give_the_row_level_likelihood(library):
    one = library[library.drug == "D"]
    cells = one.groupby(["stop_type", "up_123nt", "down_123nt"])["RT_binomial"].agg(
        ["size", "sum"]).reset_index()
    fitted = fit_cells(cells, cells["size"], cells["sum"], MODELS["B"])
    # The score equations of the likelihood hold over the rows themselves, for every dummy.
    residual = one["RT_binomial"].to_numpy() - fitted.predict(one)
    for column in ("stop_type", "up_123nt", "down_123nt"):
        assert np.abs(pd.Series(residual).groupby(one[column].to_numpy()).sum()).max() < 1e-7


def test_an_unseen_cell_falls_back_to_its_marginals(library):
    one = library[(library.drug == "D") & ~((library.stop_type == "uga")
                                            & (library.down_123nt == "ggg"))]
    cells = one.groupby(["stop_type", "up_123nt", "down_123nt"])["RT_binomial"].agg(
        ["size", "sum"]).reset_index()
    fitted = fit_cells(cells, cells["size"], cells["sum"], MODELS["B"])
    assert "stop_type[uga]:down_123nt[ggg]" not in fitted.names
    beta = dict(zip(fitted.names, fitted.beta))
    wanted = beta["stop_type[uga]"] + beta["down_123nt[ggg]"]
    row = pd.DataFrame([("uga", "aaa", "ggg")], columns=["stop_type", "up_123nt", "down_123nt"])
    assert fitted.predict(row)[0] == pytest.approx(1 / (1 + np.exp(-wanted)))
    assert not fitted.known(row.assign(up_123nt="zzz"))[0]


def test_squared_correlation_from_cells():
    p, y = np.array([0.1, 0.1, 0.4, 0.7]), np.array([0.2, 0.1, 0.3, 0.9])
    found = squared_correlation(np.array([0.1, 0.4, 0.7]), np.array([2.0, 1, 1]),
                                np.array([0.3, 0.3, 0.9]), np.array([0.05, 0.09, 0.81]))
    assert found == pytest.approx(np.corrcoef(p, y)[0, 1] ** 2)


def test_score_marks_unknown_levels_missing(spark, features):
    model = mod.fit(features.withColumnRenamed("drug", "therapy_id"))
    spreads = spark.createDataFrame([("D", 2.0), ("E", 0.5)], "therapy_id string, spread double")
    contexts = spark.createDataFrame(
        [("v1", True, "uaa", "aaa", "aac"), ("v2", True, "uaa", "aaa", "zzz"),
         ("v3", False, None, None, None)],
        "variant_id string, scoreable boolean, stop_type string, up_123nt string, "
        "down_123nt string")
    found = {(r.variant_id, r.therapy_id): r for r in mod.score(contexts, model, spreads).collect()}
    assert set(found) == {(v, t) for v in ("v1", "v2") for t in "DE"}
    assert found["v1", "D"].readthrough_low == 0.0 and found["v1", "E"].readthrough_low > 0
    assert (found["v2", "D"].status, found["v2", "D"].readthrough_low) == ("missing", None)


def test_grouped_splits_keep_groups_on_one_side(features, library):
    for config, keys in ev.SPLITTERS.items():
        rounds = ev.split(features, config, ("drug",), rounds=3).toPandas()
        again = ev.split(features.repartition(7), config, ("drug",), rounds=3).toPandas()
        assert len(rounds.merge(again)) == len(rounds)
        for (drug, _), train in rounds.groupby(["drug", "round"]):
            mine = library[library.drug == drug]
            inside = mine["row"].isin(train["row"])
            groups = mine[list(keys)].astype(str).agg("|".join, axis=1)
            assert not set(groups[inside]) & set(groups[~inside])
            assert groups[inside].nunique() == int(groups.nunique() * 0.9)
    with pytest.raises(ValueError, match="no splitter"):
        ev.split(features, "external_transfer_test", ("drug",))


def test_cuts_are_the_kth_smallest_digests(spark, monkeypatch):
    """With few digits a step and nothing sorted early, the selection goes down many steps."""

    units = spark.range(3000).selectExpr("IF(id % 3 = 0, 'a', 'b') AS k", "CAST(id AS string) AS u")
    want = {}
    for key, own in units.toPandas().groupby("k")["u"]:
        for r in (1, 2):
            digests = sorted(hashlib.md5(f"9|{r}|{u}".encode()).hexdigest() for u in own)
            want[key, r] = digests[int(len(own) * 0.7) - 1]
    for digits, sorted_ in ((3, 20_000), (1, 2), (2, 0)):
        monkeypatch.setattr(selection, "DIGITS", digits)
        monkeypatch.setattr(selection, "SORTED", sorted_)
        found = selection.cut_digests(units, ["k"], "u", lambda n: F.floor(n * F.lit(0.7)), 2, 9)
        assert {(x.k, r): d for x in found.collect() for r, d in x.cuts.items()} == want
    none = selection.cut_digests(units, ["k"], "u", lambda n: n * 0, 2, 9)
    assert none.where("cuts IS NULL").count() == 2


def test_no_row_is_copied_for_a_round_before_a_shuffle(features):
    """Shuffles carry cells and digit counts, not rows times rounds."""

    marked = ev.mark_folds(features, "published_random_cv", ("drug",), rounds=2)
    plan = mod.fold_cells(marked, ("drug",), rounds=2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    one = features.where("row = 1")
    assert ev.split(one, "published_random_cv", ("drug",), rounds=2).count() == 0
    alone = ev.mark_folds(one, "published_random_cv", ("drug",), rounds=2)
    assert mod.evaluate(mod.fold_cells(alone, ("drug",), rounds=2), ("drug",)).count() == 0
    assert mod.held_out_predictions(alone, ("drug",), rounds=2).count() == 0


def test_cross_validation_matches_held_out_rows(features):
    marked = ev.mark_folds(features, "published_random_cv", ("drug",), rounds=2)
    cells = mod.evaluate(mod.fold_cells(marked, ("drug",), rounds=2), ("drug",)).toPandas()
    rows = mod.r_squared(mod.held_out_predictions(marked, ("drug",), rounds=2),
                         ["drug", "round"]).toPandas()
    both = cells.merge(rows, on=["drug", "round"])
    assert len(both) == 4 and (both.held_out_x == both.held_out_y).all()
    assert both.r2_x.to_numpy() == pytest.approx(both.r2_y.to_numpy())


CODONS = ("AAA", "AAC", "CCG", "CTT", "GGA", "GGG")


@pytest.fixture(scope="module")
def scores(spark):
    return kin.codon_scores(spark.createDataFrame(
        [(c, "a", float(i + 1)) for i, c in enumerate(CODONS)] + [("AAA", "p", 9.0)],
        "codon string, site string, occupancy double"))


def test_permutations_keep_the_values_and_the_families(spark, scores):
    wanted = spark.range(5).withColumnRenamed("id", "permutation")
    moved = kin.permuted_scores(scores, "global", wanted).toPandas()
    for _, one in moved.groupby("permutation"):
        assert sorted(one.occupancy) == [1, 2, 3, 4, 5, 6]
    assert moved.groupby("permutation").apply(
        lambda x: tuple(x.sort_values("codon").occupancy), include_groups=False).nunique() > 1
    matched = kin.permuted_scores(scores, "context_matched", wanted).toPandas()
    singles = matched[matched.codon.isin(["AAA", "AAC", "CCG", "CTT"])]
    assert singles.groupby("codon").occupancy.nunique().max() == 1
    for _, one in matched[matched.codon.isin(["GGA", "GGG"])].groupby("permutation"):
        assert sorted(one.occupancy) == [5, 6]
    with pytest.raises(ValueError):
        kin.permuted_scores(scores, "within_gene", wanted)


def test_within_gene_moves_pairs_together(features, scores, library):
    attached = kin.attach(features, scores)
    moved = kin.shuffled_within_gene(attached).toPandas()
    before = attached.toPandas()
    assert len(moved) == len(library)
    pairs = lambda df: df.groupby(["drug", "gene"]).apply(
        lambda x: sorted(zip(x.k_up, x.k_down)), include_groups=False)
    assert (pairs(moved) == pairs(before)).all()
    joined = moved.merge(before, on="row")
    assert (joined.k_up_x != joined.k_up_y).any()
    assert (joined.up_123nt_x == joined.up_123nt_y).all()


def test_every_permutation_is_a_bijection_in_both_layouts(spark, features, scores, library):
    rows = perm.numbered(kin.attach(features, scores).withColumn("k_up", F.col("row").cast("double")),
                         ["drug", "gene"], ["row"], 5)
    asked = F.array(*[F.lit(p).cast("bigint") for p in range(4)])
    near, far, some = (perm.permuted(rows, ["drug", "gene"], ["k_up", "k_down"], asked, 5, n)
                       .toPandas().sort_values(["permutation", "row"]).reset_index(drop=True)
                       for n in (4096, 0, 38))
    assert len(near) == 4 * len(library)
    pd.testing.assert_frame_equal(near, far)
    pd.testing.assert_frame_equal(near, some)
    for _, one in near.groupby(["permutation", "drug", "gene"]):
        assert sorted(one.k_up) == sorted(one.row)
    stayed = (near.k_up == near.row).mean()
    assert 0.01 < stayed < 0.06  # A random permutation keeps one row of a gene, of 37 or so.
    wide = near.pivot(index="row", columns="permutation", values="k_up")
    assert all((wide[a] == wide[b]).mean() < 0.06 for a in range(4) for b in range(a))


def test_a_permutation_is_worked_out_without_a_shuffle_of_its_own(features, scores):
    rows = perm.numbered(kin.attach(features, scores), ["drug", "gene"], ["row"], 5)

    def shuffles(permutations):
        out = perm.permuted(rows, ["drug", "gene"], ["k_up", "k_down"],
                            F.sequence(F.lit(0).cast("bigint"), F.lit(permutations)), 5)
        return out._jdf.queryExecution().executedPlan().toString()

    plan = shuffles(50)
    near = plan[:plan.index("SortMergeJoin")] if "SortMergeJoin" in plan else plan
    assert near.count("Exchange hashpartitioning") + near.count("REPARTITION_BY_NUM") >= 1
    assert near.index("Generate") < near.index("Exchange")  # Exploded above the only exchange.


def test_rows_of_large_genes_are_sent_in_batches_by_the_same_numbers(spark):
    """Groups of several sizes in one batch; the plan of large groups spells no swap per row."""

    sizes = {"a": 1, "b": 2, "c": 7, "d": 40}
    rows = spark.createDataFrame([(f"{g}{i}", g, float(i), i, n) for g, n in sizes.items()
                                  for i in range(n)], "row string, g string, v double, _at long, _n long")
    asked = F.array(*[F.lit(p).cast("bigint") for p in (0, 1, 17)])
    near, far = (perm.permuted(rows, ["g"], ["v"], asked, 3, n) for n in (4096, 0))
    wanted, found = (sorted(map(tuple, df.select("g", "permutation", "row", "v").collect()))
                     for df in (near, far))
    assert len(found) == 150 and wanted == found
    plan = far._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan
    assert "_turns" not in plan[plan.index("Join"):]


def test_pairs_of_numbers_part_company(spark):
    """Where two neighbours of 40 land is near uniform over pairs: a chi-square over 4 x 4 cells."""

    rows = spark.range(40).selectExpr("id AS row", "'a' AS g", "id AS v", "id AS _at", "40L AS _n")
    asked = F.sequence(F.lit(0).cast("bigint"), F.lit(1999))
    found = perm.permuted(rows, ["g"], ["v"], asked, 3).where("row < 2").toPandas().pivot(
        index="permutation", columns="row", values="v") // 10
    cells = found.groupby([0, 1]).size().to_numpy()
    wanted = np.where(np.eye(4).ravel() == 1, 10 * 9, 10 * 10) / (40 * 39) * 2000
    assert ((cells - wanted) ** 2 / wanted).sum() < 37.7  # 15 degrees of freedom, one in a thousand


def test_a_permutation_written_twice_is_an_error(spark):
    null = spark.createDataFrame([("f", 1, "x", 0.1), ("f", 1, "x", 0.1)],
                                 "shuffle string, permutation bigint, drug string, gain double")
    observed = spark.createDataFrame([("x", 0.3)], "drug string, gain double")
    with pytest.raises(Exception, match="permutation written more than once: f 1 x"):
        kin.familywise_pvalues(observed, null).collect()


def test_a_dependent_column_takes_nothing_from_those_behind_it():
    """The third column repeats the first; what is left of the fourth lies where its noise would."""

    x = np.array([[1.0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 1], [0, 0, 0, 0]])
    assert list(independent(x)) == [0, 1, 3]
    halves = [np.linalg.qr(part, mode="r") for part in (x[:2], x[2:])]
    assert list(independent(np.vstack(halves))) == [0, 1, 3]


def test_a_fit_at_its_limit_is_reported(library, monkeypatch):
    one = library[library.drug == "D"]
    cells = one.groupby(["stop_type", "up_123nt", "down_123nt"])["RT_binomial"].agg(
        ["size", "sum"]).reset_index()
    assert fit_cells(cells, cells["size"], cells["sum"], MODELS["S"]).converged
    monkeypatch.setattr(binomial, "STEPS", 1)
    assert not fit_cells(cells, cells["size"], cells["sum"], MODELS["S"]).converged


def test_baseline_ignores_every_shuffle(features, scores):
    marked = ev.mark_folds(features, "grouped_by_gene", ("drug",), rounds=2)
    base = None
    for kind in (None, *kin.FAMILIES):
        found = kin.head_to_head(marked, scores, kind, {m: MODELS[m] for m in ("B", "K1")},
                                 rounds=2)
        one = found.where("model = 'B'").orderBy("drug", "round").toPandas()["r2"].to_numpy()
        base = one if base is None else base
        assert one == pytest.approx(base, abs=1e-9)


def test_null_is_synchronised_complete_and_resumable(spark, features, scores, tmp_path):
    marked = ev.mark_folds(features, "grouped_by_gene", ("drug",), rounds=2)
    baseline = kin.baseline_scores(marked, rounds=2)
    calls = []

    def compute(left):
        calls.append(left.count())
        return kin.null_gains(marked, scores, baseline, left, chunk=2, rounds=2)

    keys, path = ["shuffle", "permutation"], str(tmp_path / "null")
    inc.resume(spark, path, inc.index_range(spark, kin.FAMILIES, 2), keys, compute)
    first = spark.read.parquet(path).drop(inc.BATCH).toPandas()
    full = inc.resume(spark, path, inc.index_range(spark, kin.FAMILIES, 3), keys, compute)
    inc.resume(spark, path, inc.index_range(spark, kin.FAMILIES, 3), keys, compute)
    assert calls == [6, 3]
    table = full.toPandas()
    assert len(table) == 3 * 3 * 2 and kin.repeated_permutations(full).count() == 0
    assert len(table.merge(first)) == len(first)
    again = kin.null_gains(marked, scores, baseline, inc.index_range(spark, kin.FAMILIES, 3),
                           chunk=5, rounds=2).toPandas()
    both = table.merge(again, on=["shuffle", "permutation", "drug"])
    assert both.gain_x.to_numpy() == pytest.approx(both.gain_y.to_numpy(), abs=1e-9)


def test_overlapping_writers_leave_no_key_twice(spark, tmp_path):
    """The second run starts and ends while the first one computes; both append the keys they share."""

    path, keys = str(tmp_path / "shared"), ["k"]

    def rows(left, by):
        return left.selectExpr("k", f"'{by}' AS writer", "explode(array(1, 2)) AS part")

    def slow(left):
        inc.resume(spark, path, spark.range(5, 15).toDF("k"), keys, lambda x: rows(x, "second"))
        return rows(left, "first")

    inc.resume(spark, path, spark.range(10).toDF("k"), keys, slow)
    assert spark.read.parquet(path).count() == 40
    found = inc.written(spark, path, keys).toPandas()
    assert len(found) == 30 and found.groupby(["k", "part"]).size().max() == 1
    assert set(found[found.k < 10].writer) == {"first"} and set(found[found.k > 9].writer) == {"second"}
    again = inc.resume(spark, path, spark.range(15).toDF("k"), keys, lambda x: 1 / 0)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.to_numpy().tolist()))


def test_only_a_path_without_a_table_counts_as_unwritten(spark, tmp_path):
    assert inc.batches(spark, str(tmp_path / "none")) is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"PAR1 not a table")
    with pytest.raises(Exception):  # noqa: B017 - the reader's own error, whichever it is
        inc.resume(spark, str(tmp_path / "broken"), spark.range(3).toDF("k"), ["k"], lambda x: x)
    assert len(list((tmp_path / "broken").iterdir())) == 1


def test_the_baseline_is_kept_until_rows_or_folds_change(features, tmp_path, monkeypatch):
    marked, path = ev.mark_folds(features, "grouped_by_gene", ("drug",), rounds=2), str(tmp_path / "b")
    calls, plain = [], kin.baseline_scores
    monkeypatch.setattr(kin, "baseline_scores", lambda m, **k: calls.append(
        sorted(r[0] for r in m.select("drug").distinct().collect())) or plain(m, **k))
    order = ["drug", "round"]
    first = kin.kept_baseline(marked, path, 2).orderBy(*order).toPandas()
    pd.testing.assert_frame_equal(kin.kept_baseline(marked, path, 2).orderBy(*order).toPandas(), first)
    pd.testing.assert_frame_equal(plain(marked, rounds=2).orderBy(*order).toPandas()[
        first.columns], first)
    other = marked.withColumn("RT_binomial", F.when(F.col("drug") == "E", F.col("RT_binomial") / 2)
                              .otherwise(F.col("RT_binomial")))
    assert kin.kept_baseline(other, path, 2).count() == len(first)
    assert calls == [["D", "E"], ["E"]]


def test_familywise_p_takes_the_maximum_inside_a_permutation(spark):
    null = spark.createDataFrame(
        [("f", p, d, g) for p, pair in enumerate(((0.1, 0.5), (0.2, 0.1), (0.3, 0.0)))
         for d, g in zip("xy", pair)], "shuffle string, permutation bigint, drug string, "
                                       "gain double")
    observed = spark.createDataFrame([("x", 0.3), ("x", 0.3), ("y", 0.9)],
                                     "drug string, gain double")
    found = {r.drug: r for r in kin.familywise_pvalues(observed, null).collect()}
    assert found["x"].p_familywise == pytest.approx(3 / 4)
    assert found["y"].p_familywise == pytest.approx(1 / 4)
    assert found["x"].null_max == 0.5 and found["x"].resolution == 0.25


@pytest.mark.parametrize("gain,low,high,shuffles,collapse,confined,failures", [
    (0.2, 0.1, 0.3, 3, True, False, ""),
    (0.2, -0.1, 0.3, 3, True, False, "gain_excludes_zero"),
    (-0.2, -0.3, -0.1, 3, True, False, "gain_excludes_zero"),
    (0.2, 0.1, 0.3, 3, False, True, "shuffles_collapse;survives_support"),
    (0.2, 0.1, 0.3, 0, True, False, "shuffles_collapse")])
def test_passing_rule(spark, gain, low, high, shuffles, collapse, confined, failures):
    df = spark.createDataFrame([(gain, low, high, shuffles, collapse, confined)],
                               "gain double, ci_low double, ci_high double, shuffles int, "
                               "all_shuffles_include_zero boolean, "
                               "confined_to_unsupported boolean")
    found = ev.passing_rule(df).first()
    assert found.failures == failures and found.supported == (failures == "")


def test_worst_case_is_the_drug_with_the_largest_mean(spark):
    df = spark.createDataFrame([("a", r, 0.1) for r in range(10)]
                               + [("b", r, 0.2 + 0.01 * r) for r in range(10)],
                               "drug string, round int, gain double")
    found = ev.worst_case(df, draws=200).first()
    assert found.drug == "b" and found.ci_low < found.gain < found.ci_high


def test_fits_across_tasks_equal_grouped_fits(features, scores, monkeypatch):
    marked = ev.mark_folds(features, "grouped_by_gene", ("drug",), rounds=2)
    models = {m: MODELS[m] for m in ("B", "K1")}
    grouped = kin.head_to_head(marked, scores, "within_gene", models, rounds=2).toPandas()
    monkeypatch.setattr(mod, "TASK_CELLS", 20)
    monkeypatch.setattr(wide_fits, "FITS_AT_ONCE", 3)
    wide = kin.head_to_head(marked, scores, "within_gene", models, rounds=2).toPandas()
    both = grouped.merge(wide, on=["drug", "round", "model"])
    assert len(both) == 8 and (both.held_out_x == both.held_out_y).all()
    assert both.r2_x.to_numpy() == pytest.approx(both.r2_y.to_numpy(), abs=1e-9)
    assert both.converged_x.all() and both.converged_y.all()


@pytest.mark.parametrize("name", ["B", "K1", "K2", "S"])
def test_columns_of_a_term_share_no_row(library, name):
    """Cross products, triangular factor and solution are those of the design written out."""

    cells = library[library.drug == "D"].groupby(["stop_type", "up_123nt", "down_123nt"])[
        "RT_binomial"].agg(["size", "sum"]).reset_index().drop(index=[4, 9])
    cells["k_up"], cells["k_down"] = np.arange(len(cells)) % 7 / 3, np.arange(len(cells)) % 5 / 2
    n = cells["size"].to_numpy(float)
    found = binomial.design(cells, MODELS[name], binomial.levels_of(cells))
    x = found.dense()
    gram = x.T @ (x * n[:, None])
    assert x.shape == (len(cells), len(found.names))
    assert found.gram(n) == pytest.approx(gram, abs=1e-9)
    assert found.cross(n) == pytest.approx(x.T @ n, abs=1e-9)
    assert found.times(np.arange(found.size)) == pytest.approx(x @ np.arange(found.size), abs=1e-9)
    factor = binomial.triangle(found, n)
    assert factor.T @ factor == pytest.approx(gram, abs=1e-9)
    kept = independent(factor)
    assert len(kept) == np.linalg.matrix_rank(x) == np.linalg.matrix_rank(x[:, kept])
    less = found.kept(kept)
    assert less.dense() == pytest.approx(x[:, kept])
    side = np.arange(len(kept), dtype=float)
    assert binomial.solved(less.gram(n), side) == pytest.approx(
        np.linalg.solve(gram[np.ix_(kept, kept)], side), rel=1e-6, abs=1e-8)


def test_the_kinetic_queries_read_whole_triplets_in_every_round(spark):
    """No row is left out, and every sense codon is a level of its own."""

    tables = Tables(spark, "/root/testdata/sf0.01")
    given, used = tables("library"), qm.drug_folds(tables)
    both = given.join(used.select("row", F.col("up_123nt").alias("up"), F.col("down_123nt").alias(
        "down"), "folds"), "row")
    assert both.count() == given.count() == used.count()
    stops = ("uaa", "uag", "uga")
    for one, other in (("up_123nt", "up"), ("down_123nt", "down")):
        assert both.where(~F.col(one).isin(*stops) & (F.col(one) != F.col(other))).count() == 0
        assert used.select(one).distinct().count() == 61
    assert used.agg(F.bit_or("folds")).first()[0] >> ROUNDS - 1 > 0


def test_refits_reach_the_maximum_of_a_whole_fit(spark, features, scores, monkeypatch):
    """Every family's r squared is that of K1 fitted from nothing, and a large drug's that of a small one."""

    marked = ev.mark_folds(features, "grouped_by_gene", ("drug",), rounds=2)
    baseline = kin.baseline_scores(marked, rounds=2)
    wanted = inc.index_range(spark, kin.FAMILIES, 3)

    def gains() -> np.ndarray:
        return kin.null_gains(marked, scores, baseline, wanted, rounds=2).toPandas().sort_values(
            ["shuffle", "permutation", "drug"])["gain"].to_numpy()

    found = gains()
    assert len(found) == 3 * 3 * 2
    with monkeypatch.context() as patched:
        patched.setattr(kin, "TASK_ROWS", 10)
        assert gains() == pytest.approx(found, abs=1e-7)
    by_hand = []
    for family in ("context_matched", "global"):
        for p in range(3):
            one = spark.range(p, p + 1).toDF("permutation")
            used = kin.permuted_scores(scores, family, one, 722).drop("permutation")
            by_hand.append(kin.observed_gains(marked, used, baseline, 2).groupBy("drug").agg(
                F.avg("gain")).orderBy("drug").toPandas().iloc[:, 1])
    assert found[:12] == pytest.approx(np.concatenate(by_hand), abs=1e-7)


def test_the_null_is_whole():
    assert qm.NULL_PERMUTATIONS == PERMUTATIONS_REQUIRED
