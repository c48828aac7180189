"""Ranks, quantiles and picks against brute force, with one group holding most rows."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stopscan.operators import ranking as rk


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(5)
    groups = np.where(rng.random(3000) < 0.7, "hot", rng.choice(list("abc"), 3000))
    return pd.DataFrame({"g": groups, "v": np.round(rng.exponential(3.0, 3000), 2),
                         "id": np.arange(3000)})


@pytest.mark.parametrize("one_block", [0, 10**9])
def test_quantiles_match_linear_interpolation(spark, skewed, monkeypatch, one_block):
    monkeypatch.setattr(rk, "ONE_BLOCK", one_block)
    df = spark.createDataFrame(skewed)
    found = rk.quantiles(df, ["g"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.95}).toPandas()
    for row in found.itertuples():
        values = skewed.loc[skewed.g == row.g, "v"]
        assert [row.lo, row.mid, row.hi] == pytest.approx(
            list(np.quantile(values, [0.05, 0.5, 0.95])))


@pytest.mark.parametrize("accuracy", [10, 200])
def test_quantiles_sort_only_values_beside_the_ranks(spark, skewed, monkeypatch, accuracy):
    """Brackets of any width are exact, of ties too, with a null group; one written pass each."""

    written = []
    kept = rk.cut_lineage
    monkeypatch.setattr(rk, "cut_lineage", lambda df, *a, **k: written.append(kept(df, *a, **k))
                        or written[-1])
    rows = skewed.assign(w=(skewed.v * 2).round() / 2)
    df = spark.createDataFrame(rows).withColumn("g", F.nullif("g", F.lit("a")))
    for value in ("v", "w"):
        found = rk.quantiles(df, ["g"], value, {"least": 0.0, "mid": 0.5, "hi": 0.95, "most": 1.0},
                             accuracy=accuracy).toPandas()
        assert len(found) == 4
        for row in found.itertuples():
            values = rows.loc[rows.g == (row.g if isinstance(row.g, str) else "a"), value]
            assert [row.least, row.mid, row.hi, row.most] == pytest.approx(
                list(np.quantile(values, [0.0, 0.5, 0.95, 1.0])))
    assert [df.count() for df in written] == [3000, 4, 4] * 2


def test_quantile_without_groups_skips_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (4.0,)], "v double")
    assert rk.quantiles(df, [], "v", {"m": 0.5}).first().m == 2.0


@pytest.mark.parametrize("one_block", [0, 10**9])
def test_average_ranks_share_ties(spark, skewed, monkeypatch, one_block):
    monkeypatch.setattr(rk, "ONE_BLOCK", one_block)
    found = rk.average_ranks(spark.createDataFrame(skewed), ["g"], "v", "r").toPandas()
    wanted = skewed.assign(r=skewed.groupby("g")["v"].rank()).set_index("id")["r"]
    assert (found.set_index("id")["r"].sort_index() == wanted).all()


def test_hashed_rank_is_the_digest_order(spark, skewed):
    found = rk.hashed_rank(spark.createDataFrame(skewed), ["g"], ["id"], "seed").toPandas()
    digest = skewed["id"].map(lambda i: hashlib.md5(f"seed|{i}".encode()).hexdigest())
    wanted = digest.groupby(skewed["g"]).rank().astype(int)
    assert (found.set_index("id")["hash_rank"].sort_index() == wanted).all()


def test_first_seen_codes_follow_appearance_across_blocks(spark):
    df = spark.createDataFrame(
        [("b", 5), ("a", 70000), ("c", 140000), ("b", 200000)], "k string, o bigint")
    found = {r.k: r.code for r in rk.first_seen_codes(df, "k", "o").collect()}
    assert found == {"b": 0, "a": 1, "c": 2}


def test_first_by_keeps_whole_rows(spark):
    df = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (2, 3, None)], "k int, o int, v string")
    assert {(r.k, r.v) for r in rk.first_by(df, ["k"], ["o"]).collect()} == {(1, "y"), (2, None)}
    last = rk.first_by(df, ["k"], ["o"], descending=True)
    assert {(r.k, r.v) for r in last.collect()} == {(1, "x"), (2, None)}


def test_top_per_group_prunes_before_the_shuffle(spark, skewed):
    df = rk.top_per_group(spark.createDataFrame(skewed), ["g"], [F.desc("v"), F.asc("id")], 3)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 12
