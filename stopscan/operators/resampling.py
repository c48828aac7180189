"""Bootstrap over groups of any size, from draws that any engine repeats.

What a slot of a draw picks is a number mixed from seed, group, bucket, draw and slot by arithmetic
modulo a prime under 2**31: no stream, no order of evaluation, and integers that fit 64 bits, so a lost
task, another partitioning or plain SQL gives the same pick.

A group's rows are dealt into buckets of about `BUCKET_ROWS` by a digest of their identity, and each
draw fills a bucket's slots from that bucket; only sums leave it. A group of one bucket is resampled as
usual. In a larger one the buckets are random parts of about equal mean, and fixing how many slots
each fills takes one part in `BUCKET_ROWS` from the variance of a mean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.session import cut_lineage

BUCKET_ROWS = 20_000
PICKS_AT_ONCE = 1_000_000
#: Rows of buckets that are sorted in one task.
TASK_ROWS = 400_000
PRIME = (1 << 31) - 1
#: Added in each step, so that small numbers do not stay small.
STEP = 1_013_904_223


def mixed(*numbers: int | np.ndarray) -> np.ndarray:
    """A number under PRIME from others under it. Fifth powers permute the numbers modulo this prime."""

    found = np.int64(0)
    for number in (*numbers, 0):
        x = (found + number + STEP) % PRIME
        square = x * x % PRIME
        found = square * square % PRIME * x % PRIME
    return found


def mixed_column(*numbers: Column) -> Column:
    """The same number as `mixed`, in the row."""

    def step(found: Column, number: Column) -> Column:
        x = (found + number + STEP) % PRIME
        square = x * x % PRIME
        return square * square % PRIME * x % PRIME

    zero = F.lit(0).cast("bigint")
    return F.aggregate(F.array(*[n.cast("bigint") for n in numbers], zero), zero, step)


def mixed_sql(*numbers: str) -> str:
    """Select items that give the same number as `mixed`, under the name of the last one."""

    items, found = [], "0"
    for at, number in enumerate((*numbers, "0")):
        items += [f"cast({found} + {number} + {STEP} AS BIGINT) % {PRIME} AS x{at}",
                  f"x{at} * x{at} % {PRIME} AS s{at}",
                  f"s{at} * s{at} % {PRIME} * x{at} % {PRIME} AS m{at}"]
        found = f"m{at}"
    return ", ".join(items)


def label_number(label: str) -> int:
    return int(hashlib.md5(label.encode()).hexdigest()[:7], 16)


def bootstrap_sums(df: DataFrame, keys: Sequence[str], identity: Sequence[str],
                   measures: Sequence[str], draws: int, seed: int,
                   bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`(keys, draw, n, measures)`: the measures' sums over each resample of a group.

    Rows of one identity have equal measures, or the pick between them depends on their order.
    """

    # Written once: sizes and the rows themselves are two passes over it.
    df = cut_lineage(df.select(*dict.fromkeys([*keys, *identity, *measures])))
    sizes = df.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(
        F.count(F.lit(1)) / bucket_rows)).cast("bigint").alias("_buckets"))
    told = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in identity]))
    placed = df.join(sizes, list(keys)).withColumn(
        "_bucket", F.conv(F.substring(told, 1, 7), 16, 10).cast("bigint") % F.col("_buckets")).drop(
        "_buckets")
    columns, names = list(measures), list(keys)

    def resample(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(identity), kind="mergesort")
        first = rows.iloc[0]
        group = label_number("|".join(str(first[k]) for k in names))
        values = rows[columns].to_numpy(dtype=float)
        size, slots = len(values), np.arange(len(values), dtype=np.int64)
        step = max(1, PICKS_AT_ONCE // size)
        sums = np.empty((draws, len(columns)))
        for start in range(0, draws, step):
            some = np.arange(start, min(draws, start + step), dtype=np.int64)[:, None]
            picks = mixed(seed, group, int(first["_bucket"]), some, slots[None, :]) % size
            for at in range(len(columns)):
                sums[start:start + step, at] = values[picks, at].sum(axis=1)
        out = pd.DataFrame(sums, columns=columns)
        out.insert(0, "n", size)
        out.insert(0, "draw", np.arange(draws))
        for position, k in enumerate(names):
            out.insert(position, k, first[k])
        return out

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in names] + ["draw int", "n bigint"]
                       + [f"`{m}` double" for m in columns])
    # Small compressed blocks would be put together until a task sorts millions of rows.
    tasks = -(-df.count() // max(TASK_ROWS, bucket_rows))
    if tasks > 1:
        placed = placed.repartition(tasks, *keys, "_bucket")
    parts = placed.groupBy(*keys, "_bucket").applyInPandas(resample, schema)
    return parts.groupBy(*keys, "draw").agg(
        F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in columns])


def bootstrap_mean_sql(source: str, keys: Sequence[str], identity: Sequence[str], value: str,
                       draws: int, seed: int, bucket_rows: int = BUCKET_ROWS,
                       named: Sequence[str] | None = None) -> str:
    """Common table `spread` (keys, ci_low, ci_high, point) that states `bootstrap_mean_ci` in SQL.

    `named` are the keys of the operator, where `keys` part its calls from one another, too.
    """

    key, order = ", ".join(keys), ", ".join(identity)
    label = " || '|' || ".join(f"cast({k} AS varchar)" for k in named or keys)
    told = " || '|' || ".join(f"cast({c} AS varchar)" for c in identity)
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return f"""bk AS (SELECT {key}, {order}, cast({value} AS DOUBLE) AS _v,
    ('0x' || substr(md5({told}), 1, 7))::BIGINT % cast(greatest(1, ceil(count(*) OVER (
      PARTITION BY {key}) / {bucket_rows})) AS BIGINT) AS _b FROM {source}),
nb AS (SELECT {key}, _b, _v, ('0x' || substr(md5({label}), 1, 7))::BIGINT AS _g,
    row_number() OVER (PARTITION BY {key}, _b ORDER BY {order}) - 1 AS _i,
    count(*) OVER (PARTITION BY {key}, _b) AS _n FROM bk),
pk AS (SELECT {key}, _b, _n, _d, {mixed_sql(str(seed), "_g", "_b", "_d", "_i")}
  FROM nb, (SELECT unnest(range(0, {draws})) AS _d) AS r),
sm AS (SELECT {", ".join(f"a.{k}" for k in keys)}, a._d, sum(b._v) / count(*) AS _m
  FROM pk a JOIN nb b ON {same} AND a._b = b._b AND b._i = a.m5 % a._n GROUP BY ALL),
spread AS (SELECT {", ".join(f"a.{k}" for k in keys)}, point, ci_low, ci_high FROM (
    SELECT {key}, quantile_cont(_m, 0.025) AS ci_low, quantile_cont(_m, 0.975) AS ci_high
    FROM sm GROUP BY {key}) a JOIN (
    SELECT {key}, avg(_v) AS point FROM bk GROUP BY {key}) b ON {same})"""


def bootstrap_mean_ci(df: DataFrame, keys: Sequence[str], identity: Sequence[str], value: str,
                      draws: int = 9999, seed: int = 721,
                      bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Percentile interval of a group's mean, with the mean itself and whether zero is inside."""

    sums = bootstrap_sums(df, keys, identity, [value], draws, seed, bucket_rows)
    spread = sums.groupBy(*keys).agg(
        F.percentile(F.col(value) / F.col("n"), 0.025).alias("ci_low"),
        F.percentile(F.col(value) / F.col("n"), 0.975).alias("ci_high"))
    points = df.groupBy(*keys).agg(F.avg(value).alias("point"))
    return points.join(spread, list(keys)).withColumn(
        "includes_zero", (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))
