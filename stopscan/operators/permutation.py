"""Permutations inside groups as arithmetic: where a row goes is worked out in the row.

A group's rows are numbered once, in a hashed order. Permutation p sends number i through a swap-or-not
shuffle: in each of its rounds a mixed number pairs i with (k - i) mod n, and a bit mixed from the larger
of the two decides whether both trade places. Every round is its own inverse, so each p is a bijection
of 0..n-1 for any n, known without sorting and the same on any partitioning and in SQL.

The rows of a group of up to `GROUP_ROWS` lie side by side in one row of arrays, which every permutation
reads in place. A larger group's rows fetch from each other by a join on group and number, which
spreads a hot group over all tasks; where they are sent is worked out for a batch of rows at a time.
Both follow the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.operators.ranking import _join_on_keys, hashed_rank
from stopscan.operators.resampling import PRIME, mixed, mixed_column, mixed_sql
from stopscan.session import cut_lineage

#: Rounds of a shuffle; a number has met about half of them, so pairs part company soon.
SWAPS = 24
GROUP_ROWS = 4096


def numbered(df: DataFrame, group: Sequence[str], identity: Sequence[str], seed: int) -> DataFrame:
    """`df` with its number `_at` from 0 in its group and the group's size `_n`, written once."""

    ranked = hashed_rank(df, group, identity, f"{seed}|at", "_at").withColumn("_at", F.col("_at") - 1)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    return cut_lineage(_join_on_keys(ranked, sizes, group))


def group_number(group: Sequence[str]) -> Column:
    told = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in group]))
    return F.conv(F.substring(told, 1, 7), 16, 10).cast("bigint")


def _with_turns(df: DataFrame, group: Sequence[str], permutations: Column, seed: int) -> DataFrame:
    """`df` once per permutation, with the pairing number of every round of its group."""

    started = df.withColumn("permutation", F.explode(permutations)).withColumn(
        "_h", mixed_column(F.lit(seed), group_number(group), F.col("permutation")))
    return started.withColumn("_turns", F.transform(
        F.sequence(F.lit(0), F.lit(SWAPS - 1)), lambda r: F.struct(
            ((mixed_column(F.col("_h"), r * 3) * PRIME + mixed_column(F.col("_h"), r * 3 + 1))
             % F.col("_n")).alias("k"), (r * 3 + 2).alias("r"))))


def _target(at: Column) -> Column:
    def swap(i: Column, turn: Column) -> Column:
        partner = F.pmod(turn["k"] - i, F.col("_n"))
        bit = mixed_column(F.col("_h"), turn["r"], F.greatest(i, partner)) % 2
        return F.when(bit == 1, partner).otherwise(i)

    return F.aggregate(F.col("_turns"), at, swap)


def targets(at: np.ndarray, n: np.ndarray, head: np.ndarray) -> np.ndarray:
    """`_target` of a batch: where number `at` of a group of `n` goes under the shuffle begun by `head`."""

    heads, place = np.unique(head, return_inverse=True)
    for r in range(0, 3 * SWAPS, 3):
        turn = mixed(heads, r) * PRIME + mixed(heads, r + 1)
        partner = (turn[place] % n - at) % n
        bit = mixed(head, r + 2, np.maximum(at, partner)) % 2
        at = np.where(bit == 1, partner, at)
    return at


def _sent(seed: int, group: Sequence[str]) -> Column:
    """The target of a row that has `permutation`, `_at` and `_n`."""

    @F.pandas_udf("bigint")
    def sent(at: pd.Series, n: pd.Series, own: pd.Series, permutation: pd.Series) -> pd.Series:
        head = mixed(seed, own.to_numpy(np.int64), permutation.to_numpy(np.int64))
        return pd.Series(targets(at.to_numpy(np.int64), n.to_numpy(np.int64), head))

    return sent("_at", "_n", group_number(group), F.col("permutation").cast("bigint"))


def permuted(rows: DataFrame, group: Sequence[str], values: Sequence[str], permutations: Column,
             seed: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`permutation` and the columns of numbered `rows`, with `values` those of the row it is sent to.

    `permutations` is an array of indices. A null in a group column is a group of its own.
    """

    group, values = list(group), list(values)
    rest = [c for c in rows.columns if c not in (*group, *values, "_at", "_n")]
    out = [*group, "permutation", *rest, *values]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Counted partitions, which are not merged: each holds few bytes, but work for every permutation.
    near = rows.where(F.col("_n") <= group_rows).repartition(parts, *group).groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(
            "_at", F.struct(*values).alias("v"), F.struct(F.lit(0), *rest).alias("x")))).alias("_rows"),
        F.max("_n").alias("_n"))
    near = _with_turns(near, group, permutations, seed).select(*group, "permutation", F.inline(
        F.transform("_rows", lambda row: F.struct(row["x"].alias("x"), F.get(
            F.col("_rows"), _target(row["_at"]).cast("int"))["v"].alias("v")))))
    near = near.select(*group, "permutation", *[F.col("x")[c].alias(c) for c in rest],
                       *[F.col("v")[c].alias(c) for c in values])
    large = rows.where(F.col("_n") > group_rows)
    to = large.drop(*values).withColumn("permutation", F.explode(permutations)).withColumn(
        "_to", _sent(seed, group))
    far = _join_on_keys(to, large.select(*group, F.col("_at").alias("_to"), *values),
                        [*group, "_to"])
    return near.select(*out).unionByName(far.select(*out))


def permuted_sql(rows: str, group: Sequence[str], values: Sequence[str], seed: int) -> str:
    """Permutation 0 in SQL: CTEs ending in `moved`, from CTE `rows` with an identity named row."""

    keys = ", ".join(group)
    told = " || '|' || ".join(f"cast({g} AS varchar)" for g in group)
    same = " AND ".join(f"v.{g} = s.{g}" for g in group)

    def step(inner: str, name: str, *numbers: str) -> str:
        return f"SELECT {keys}, row, n, h, r, i, {name} FROM (SELECT *, {mixed_sql(*numbers)} FROM ({inner}))"

    last = "m2"
    one = step("SELECT * FROM swaps WHERE r < %d" % SWAPS, f"{last} AS a", "h", "r * 3")
    two = (f"SELECT {keys}, row, n, h, r, i, cast(a * {PRIME} + {last} AS BIGINT) % n AS k "
           f"FROM (SELECT *, {mixed_sql('h', 'r * 3 + 1')} FROM ({one}))")
    paired = f"SELECT *, (k - i + n) % n AS p FROM ({two})"
    return f"""nu AS (SELECT {keys}, row, {", ".join(values)}, count(*) OVER (PARTITION BY {keys}) AS n,
  row_number() OVER (PARTITION BY {keys} ORDER BY md5('{seed}|at|' || cast(row AS varchar))) - 1 AS i,
  cast('0x' || substring(md5({told}), 1, 7) AS BIGINT) AS g FROM {rows}),
swaps AS (SELECT {keys}, row, n, m3 AS h, 0 AS r, cast(i AS BIGINT) AS i FROM (
    SELECT *, {mixed_sql(str(seed), "g", "0")} FROM nu)
  UNION ALL SELECT {keys}, row, n, h, r + 1, CASE WHEN m3 % 2 = 1 THEN p ELSE i END FROM (
    SELECT *, {mixed_sql("h", "r * 3 + 2", "greatest(i, p)")} FROM ({paired}))),
moved AS (SELECT {", ".join("s." + g for g in group)}, s.row, {", ".join("v." + x for x in values)}
  FROM swaps s JOIN nu v ON {same} AND v.i = s.i WHERE s.r = {SWAPS})"""
