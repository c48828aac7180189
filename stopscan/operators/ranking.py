"""Ranks, running totals, quantiles and first-row picks that never put a whole group in one task.

A group (library, gene, chromosome) may hold a third of all rows, so an ordinary window over it
would sort that third in one task. Here each group is cut into ordered blocks: block totals give
the offset of a block, and only one block is sorted at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopscan.functions.scalars import let
from stopscan.session import cut_lineage

BLOCKS = 256
ONE_BLOCK = 200_000
STRIDE = 16
#: Ranks of a quantile's sketch are off by at most one in this many of the group's rows.
SKETCH = 10_000


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str],
             descending: bool = False) -> DataFrame:
    """One whole row per key, the first (or last) in `order`; partial per task, no window."""

    pick = F.max_by if descending else F.min_by
    kept = df.groupBy(*keys).agg(
        pick(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return kept.select("_row.*")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int,
                  rank: str = "rank") -> DataFrame:
    """The first `limit` rows of each group. `row_number() <= limit` prunes every task's part of a
    group to `limit` rows before the shuffle, so a hot group arrives already small."""

    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)


def running_total(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str],
                  measure: str, into: str = "before") -> DataFrame:
    """Sum of `measure` over the rows of the group that sort strictly before this one.

    `block` must not decrease along `order`. Only block totals of a group meet in one task, then
    the rows of one block.
    """

    same = F.lit(1)
    totals = df.groupBy(*keys, block).agg(F.sum(measure).alias("_total"))
    across = Window.partitionBy(*(keys or [same])).orderBy(block).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, block, F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    placed = df.withColumn("_inside", F.coalesce(F.sum(measure).over(inside), F.lit(0)))
    joined = _join_on_keys(placed, offsets, [*keys, block])
    return joined.withColumn(into, F.col("_offset") + F.col("_inside")).drop("_offset", "_inside")


def _join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str],
                  how: str = "inner") -> DataFrame:
    """Join where a null key means the same group on both sides."""

    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    condition = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"_k_{k}"])
        condition = one if condition is None else condition & one
    return left.join(renamed, condition, how).drop(*[f"_k_{k}" for k in keys])


def hashed_rank(df: DataFrame, keys: Sequence[str], identity: Sequence[Column | str], seed: str,
                into: str = "hash_rank", digits: int = 3) -> DataFrame:
    """1-based rank of each row of a group in the order of an md5 of `seed` and `identity`.

    The digest's leading hex digits are the block, so a group spreads evenly over 16**digits tasks.
    """

    columns = [F.col(c) if isinstance(c, str) else c for c in identity]
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in columns]))
    hashed = (df.withColumn("_digest", digest)
              .withColumn("_block", F.substring("_digest", 1, digits))
              .withColumn("_one", F.lit(1).cast("long")))
    ranked = running_total(hashed, keys, "_block", ["_digest"], "_one", into)
    return ranked.withColumn(into, F.col(into) + 1).drop("_digest", "_block", "_one")


def value_blocks(values: DataFrame, keys: Sequence[str], value: str,
                 blocks: int = BLOCKS) -> DataFrame:
    """Give each distinct value of a group a `_block` of about equal size.

    Cut points come from a mergeable sketch and are written once, so the two passes that use them
    see the same cuts even when an executor is lost between them.
    """

    probabilities = [i / blocks for i in range(1, blocks)]
    cuts = values.groupBy(*keys).agg(
        F.percentile_approx(value, probabilities, 20_000).alias("_cuts"))
    cuts = cut_lineage(cuts)
    if keys:
        joined = _join_on_keys(values, cuts, keys)
    else:
        # A single row of `blocks` numbers: a scalar, not a table.
        joined = values.withColumn("_cuts", cuts.scalar())
    # Two short searches instead of one long one: every sixteenth cut, then the cuts between.
    coarse = F.filter("_cuts", lambda c, i: (i % STRIDE == STRIDE - 1) & (c <= F.col(value)))
    block = let(F.size(coarse) * STRIDE, lambda start: start + F.size(F.filter(
        F.slice("_cuts", start + 1, F.lit(STRIDE)), lambda c: c <= F.col(value))))
    return joined.withColumn("_block", block).drop("_cuts")


def counted_values(df: DataFrame, keys: Sequence[str], value: str,
                   blocks: int = BLOCKS, weight: str | None = None) -> DataFrame:
    """Distinct values of each group, how often each occurs, and its ordered block.

    A row stands for `weight` equal rows where that column is named.

    The distinct values are written once, because several passes read them. Few of them form one
    block; more are cut at sketched quantiles.
    """

    counted = cut_lineage(
        df.where(F.col(value).isNotNull()).groupBy(*keys, value)
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n")))
    if counted.count() <= ONE_BLOCK:
        return counted.withColumn("_block", F.lit(0))
    return value_blocks(counted, keys, value, blocks)


def value_positions(df: DataFrame, keys: Sequence[str], value: str,
                    blocks: int = BLOCKS, weight: str | None = None) -> DataFrame:
    """Distinct values of each group with `n` rows each and `before` rows below them."""

    placed = counted_values(df, keys, value, blocks, weight)
    return running_total(placed, keys, "_block", [value], "n").drop("_block")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float],
              accuracy: int = SKETCH) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of `probabilities`.

    A sketch, whose rank error has a bound, puts each wanted rank between two values. Rows below them
    are only counted, and only the distinct values between them are shuffled and sorted. The rows are
    written once, because two passes read them. A group whose count shows a rank outside its values is
    taken over all of them.
    """

    names = list(probabilities)
    rows = cut_lineage(df.where(F.col(value).isNotNull()), *keys, value, name="values")
    # The sketch is off by at most one rank in `accuracy`; the margin is twice that.
    margin = 2.0 / accuracy
    asked = [min(max(p + side * margin, 0.0), 1.0)
             for p in probabilities.values() for side in (-1, 1)]
    cuts = cut_lineage(rows.groupBy(*keys).agg(
        F.percentile_approx(value, asked, accuracy).alias("_cuts"),
        F.min(value).alias("_least"), F.max(value).alias("_most"),
        F.count(F.lit(1)).alias("_rows")), name="cuts")
    whole = F.flatten(F.array_repeat(F.array("_least", "_most"), len(names)))

    def bracketed(cuts: DataFrame) -> DataFrame:
        """Per group and probability: rows below its values, and the distinct values with counts."""

        ends = [F.struct(F.lit(i).alias("_i"), F.get("_cuts", F.lit(2 * i)).alias("_lo"),
                         F.get("_cuts", F.lit(2 * i + 1)).alias("_hi")) for i in range(len(names))]
        wide = cuts.select(*keys, F.inline(F.array(*ends)))
        sides = wide.groupBy(*keys).agg(F.collect_list(F.struct("_i", "_lo", "_hi")).alias("_ends"))
        # One row per group, with two values for each probability.
        joined = _join_on_keys(rows, sides, keys) if keys else rows.crossJoin(F.broadcast(sides))
        each = joined.select(*keys, value, F.inline("_ends")).where(F.col(value) <= F.col("_hi"))
        below = F.col(value) < F.col("_lo")
        return each.groupBy(*keys, "_i", F.when(~below, F.col(value)).alias("_v")).agg(
            F.count(F.lit(1)).alias("n"))

    def picked(cuts: DataFrame) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_v")))
        placed = bracketed(cuts).withColumn("_upto", upto)
        facts = cuts.select(*keys, "_rows")
        placed = (_join_on_keys(placed, facts, keys) if keys
                  else placed.crossJoin(F.broadcast(facts)))
        found = []
        for i, (name, p) in enumerate(probabilities.items()):
            rank = (F.col("_rows") - 1) * F.lit(float(p))
            for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
                holds = (F.col("_i") == i) & F.col("_v").isNotNull() & (
                    F.col("_upto") - F.col("n") <= at) & (at < F.col("_upto"))
                found.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{name}_{side}"))
            found.append(F.max(rank - F.floor(rank)).alias(f"_{name}_part"))
        return placed.groupBy(*keys).agg(*found)

    # Where the margin is a row or so, all values are taken.
    met = cut_lineage(picked(cuts.withColumn("_cuts", F.when(
        F.col("_rows") <= 4 * accuracy, whole).otherwise(F.col("_cuts")))), name="quantiles")
    lacks = F.lit(False)
    for name in names:
        lacks = lacks | F.col(f"_{name}_lo").isNull() | F.col(f"_{name}_hi").isNull()
    again = met.where(lacks).select(*keys)
    if not again.isEmpty():
        missed = again.select(*[F.col(k).alias(f"_m_{k}") for k in keys])
        left = cuts.withColumn("_cuts", whole)
        if keys:
            left = left.join(missed, reduce(and_, [
                F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys]), "left_semi")
        met = met.where(~lacks).unionByName(picked(left))
    return met.select(*keys, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part"))
        .alias(n) for n in names])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, into: str,
                  blocks: int = BLOCKS, weight: str | None = None) -> DataFrame:
    """Rows with the 1-based rank of `value` in their group, ties sharing their average rank."""

    positions = value_positions(df, keys, value, blocks, weight)
    ranked = positions.select(
        *keys, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(into))
    return _join_on_keys(df, ranked, [*keys, value])


def first_seen_codes(df: DataFrame, key: str, order: str, into: str = "code",
                     width: int = 1 << 16) -> DataFrame:
    """`(key, code)` with 0-based codes in the order the keys first appear; `order` is a BIGINT."""

    seen = (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
            .withColumn("_block", F.floor(F.col("_first") / width))
            .withColumn("_one", F.lit(1).cast("long")))
    coded = running_total(seen, [], "_block", ["_first", key], "_one", into)
    return coded.select(key, into)
