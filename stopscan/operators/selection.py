"""The k-th smallest digest of a group in every round, by radix selection.

A round orders the units of a group by a digest of seed, round and unit and takes the first k. Instead
of sorting units once per round, tasks count the units by the digest's leading digits, which is one short
histogram per group and round however many units there are; the digits under which the k-th lies are
known from the counts. This repeats on further digits while many units share them, and only the few that
still do are sorted. A unit is then taken in a round if its digest is not beyond the round's cut, which
its row can tell alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopscan.session import cut_lineage, within

#: Hex digits of one step: 4,096 bins per group and round.
DIGITS = 3
#: Units under the same digits that are sorted at last.
SORTED = 20_000
#: Groups and rounds whose cuts are sent to every task; more are joined.
SENT_CUTS = 100_000


def digest(seed: int, round_: Column, unit: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), round_.cast("string"), unit))


def with_cuts(rows: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rows` with the columns of `cuts`, which has one row per key and was written."""

    return rows.join(F.broadcast(cuts) if within(cuts, SENT_CUTS) else cuts, list(keys))


def cut_digests(units: DataFrame, keys: Sequence[str], unit: str, keep: Callable[[Column], Column],
                rounds: int, seed: int) -> DataFrame:
    """`(keys, cuts)`, written: the digest of the `keep(units)`-th smallest unit of each group, by round.

    A group that keeps none has no cuts. Every row of `units` is one unit; several passes read it.
    """

    group = [*keys, "round"]
    sizes = cut_lineage(units.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), name="sizes")
    groups, largest = sizes.agg(F.count(F.lit(1)), F.max("_n")).first()
    sent = F.broadcast if groups * rounds <= SENT_CUTS else (lambda df: df)
    state = sizes.select(
        *keys, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"),
        F.lit("").alias("_digits"), keep(F.col("_n")).cast("bigint").alias("_left")).where("_left > 0")

    def under(state: DataFrame) -> DataFrame:
        """Units under the digits known so far, with their digest; all rounds in the row."""

        known = state.groupBy(*keys).agg(F.collect_list(
            F.struct("round", "_digits", "_left")).alias("_known"))
        each = units.select(*keys, F.col(unit).alias("_unit")).join(sent(known), list(keys)).select(
            *keys, "_unit", F.inline("_known")).withColumn(
            "_digest", digest(seed, F.col("round"), F.col("_unit")))
        return each.where(F.startswith("_digest", F.col("_digits"))).drop("_unit")

    digits = 0
    while (largest or 0) > SORTED and digits < 32:
        digits += DIGITS
        further = F.substring("_digest", 1, digits)
        bins = under(state).groupBy(*group, "_left", further.alias("_bin")).agg(
            F.count(F.lit(1)).alias("_n"))
        order = Window.partitionBy(*group).orderBy("_bin")
        reached = bins.withColumn("_upto", F.sum("_n").over(order)).where(
            (F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")))
        state = cut_lineage(reached.select(
            *group, F.col("_bin").alias("_digits"),
            (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), "_n"), name="cuts")
        largest = state.agg(F.max("_n")).first()[0]
        state = state.drop("_n")
    last = under(state).withColumn("_rank", F.row_number().over(
        Window.partitionBy(*group).orderBy("_digest"))).where(F.col("_rank") == F.col("_left"))
    found = last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        "round", "_digest"))).alias("cuts"))
    return cut_lineage(sizes.drop("_n").join(found, list(keys), "left"), name="cuts")


def round_marks(cuts: Column, unit: Column, rounds: int, seed: int) -> Column:
    """A bit for every round that takes the unit: bit 0 for round 1."""

    found = F.lit(0).cast("bigint")
    for r in range(1, rounds + 1):
        taken = digest(seed, F.lit(r), unit) <= F.try_element_at(cuts, F.lit(r))
        found = found + F.when(taken, F.lit(1 << (r - 1)).cast("bigint")).otherwise(F.lit(0))
    return found


def in_round(r: int | Column, folds: str = "folds") -> Column:
    """Whether the row is taken in round `r`."""

    return F.getbit(folds, (F.lit(r) if isinstance(r, int) else r) - 1) == 1


def taken_rounds(rounds: int, folds: str = "folds", taken: bool = True) -> Column:
    """The rounds that take the row, or that leave it out."""

    return F.filter(F.sequence(F.lit(1), F.lit(rounds)),
                    lambda r: in_round(r, folds) if taken else ~in_round(r, folds))
