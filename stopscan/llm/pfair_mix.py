"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Time is a row of slots, and each slot takes one block of `block_rows` documents of one source. A
source with `share` of the `cycle` slots in a cycle has weight share / cycle; its block number j
(from 0) is released at slot floor(j / weight) and due by slot ceil((j + 1) / weight). Taking in
each slot the released block with the earliest deadline meets every deadline, so that after any
number of slots each source is less than one block from its weight, ahead or behind.

Shares are whole numbers that add up to the cycle, so the schedule repeats: one cycle is worked out
(an aggregate over the slots of a cycle, whose length is a parameter), and block j of a source is
its turn j mod share of cycle j div share. No task and no driver walks the corpus.

Every document has a place: when a source has run out, its slots stay empty and the others keep
their proportions to each other. A document's rank in its source follows a digest of its id, found
in two levels (a count per stretch of digests, a sort within a stretch), so a source with a third
of all documents is never in one task.

Defined results: a null source is a source of its own. A null id ranks as empty text; repeated rows
take a place each. An empty table gives an empty result. Over `MAX_SOURCES` sources is an error,
since a cycle must have a slot for each. Further columns are not read by `interleave`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stopscan.llm.common import id_text, settle

BLOCK_ROWS = 16
CYCLE = 1000
MAX_SOURCES = 1000
#: Target weights, unless given, are in proportion to rows to this power.
TEMPER = 0.5
#: Documents of one stretch of digests, on average.
STRETCH_ROWS = 50_000


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def shares(counts: DataFrame, weights: dict[str, float] | None, cycle: int) -> DataFrame:
    """(key, rows, number, share): whole slots per cycle by largest remainders, one at least."""

    given = F.pow(F.col("rows").cast("double"), F.lit(TEMPER)) if weights is None else F.coalesce(
        *[F.when(F.col("key") == f"={k}", F.lit(float(w))) for k, w in weights.items()],
        F.lit(0.0))
    every = W.partitionBy(F.lit(0))
    quota = F.round(F.col("w") / F.greatest(F.sum("w").over(every), F.lit(1e-300)), 9) * (
        F.lit(cycle) - F.count(F.lit(1)).over(every))
    ranked = counts.withColumn("w", given).withColumn("quota", quota).withColumn(
        "whole", F.floor("quota")).withColumn("left", (
            F.lit(cycle) - F.count(F.lit(1)).over(every) - F.sum("whole").over(every)))
    order = W.partitionBy(F.lit(0)).orderBy((F.col("quota") - F.col("whole")).desc(), "key")
    return ranked.withColumn("n", F.count(F.lit(1)).over(every)).withColumn(
        "extra", F.row_number().over(order) - 1).select(
        "key", "rows",
        (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("key")) - 1).alias("number"),
        (1 + F.col("whole") + F.when(F.col("extra") < F.col("left") % F.col("n"), 1).otherwise(0)
         + F.floor(F.col("left") / F.col("n"))).cast("bigint").alias("share"))


def one_cycle(shared: DataFrame, cycle: int) -> DataFrame:
    """(number, turn, at): the slot of every turn of every source, by earliest deadline first."""

    packed = shared.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "share"))),
                                    lambda x: x["share"]).alias("shares"))
    length = F.lit(cycle).cast("bigint")

    def place(state: Column, slot: Column) -> Column:
        def due(share: Column, number: Column) -> Column:
            done = F.get(state["done"], number)
            ready = (done < share) & (F.floor(done * length / share) <= slot)
            return F.when(ready, F.struct(
                F.ceil((done + 1) * length / share).alias("deadline"), number.alias("number")))

        pick = F.array_min(F.transform(F.col("shares"), due))["number"]
        return F.get(F.transform(F.array(pick), lambda p: F.struct(
            F.transform(state["done"], lambda v, i: v + F.when(i == p, 1).otherwise(0)).alias(
                "done"),
            F.concat(state["order"], F.array(F.struct(
                p.alias("number"), F.get(state["done"], p).alias("turn")))).alias("order"))), 0)

    start = F.struct(
        F.transform("shares", lambda s: F.lit(0).cast("bigint")).alias("done"),
        F.expr("cast(array() as array<struct<number:int,turn:bigint>>)").alias("order"))
    return packed.select(F.posexplode(F.aggregate(
        F.sequence(F.lit(0), F.lit(cycle - 1)), start, place, lambda s: s["order"])).alias(
        "at", "t")).select("t.number", "t.turn", "at")


def interleave(docs: DataFrame, weights: dict[str, float] | None = None,
               block_rows: int = BLOCK_ROWS, cycle: int = CYCLE,
               carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, block, release, deadline, slot, position): where each document stands.

    `position` orders the mix: the slot, then the place in its block. The columns `carried` follow.
    """

    carry = F.struct(*[F.col(c) for c in carried]) if carried else F.lit(None)
    rows = docs.select("doc_id", "source", source_key().alias("key"),
                       F.md5(id_text()).alias("digest"), carry.alias("carried"))
    counts, _ = settle(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "sources")
    found = counts.agg(F.count(F.lit(1)), F.sum("rows")).first()
    sources, total = found[0], found[1] or 0
    if sources > MAX_SOURCES:
        raise ValueError(f"{sources} sources; a mix takes at most {MAX_SOURCES}")
    cycle = max(cycle, 4 * sources)
    shared, _ = settle(shares(counts, weights, cycle), "shares")
    turns, _ = settle(one_cycle(shared, cycle), "cycle")
    # 32 bits of the digest, cut evenly into as many stretches as the corpus needs.
    stretches = max(64, -(-total // STRETCH_ROWS))
    lead = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("stretch", F.floor(lead * stretches / F.lit(1 << 32)))
    before = rows.groupBy("key", "stretch").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(W.partitionBy("key").orderBy("stretch").rowsBetween(
            W.unboundedPreceding, -1))).select(
        "key", "stretch", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = rows.withColumn("own", F.row_number().over(
        W.partitionBy("key", "stretch").orderBy("digest", "doc_id")) - 1).join(
        before, ["key", "stretch"]).withColumn("rank", F.col("before") + F.col("own"))
    length = F.lit(cycle).cast("bigint")
    # At most MAX_SOURCES shares and one cycle of turns, both fixed by parameters.
    placed = ranked.join(F.broadcast(shared.select("key", "number", "share")), "key").withColumn(
        "block", F.floor(F.col("rank") / block_rows)).withColumn(
        "turn", F.col("block") % F.col("share")).join(F.broadcast(turns), ["number", "turn"])
    slot = F.floor(F.col("block") / F.col("share")) * length + F.col("at")
    return placed.select(
        "doc_id", "source", "block",
        F.floor(F.col("block") * length / F.col("share")).alias("release"),
        F.ceil((F.col("block") + 1) * length / F.col("share")).alias("deadline"),
        slot.alias("slot"),
        (slot * block_rows + F.col("rank") % block_rows).alias("position"),
        *[F.col("carried")[c].alias(c) for c in carried])


#: The same in SQL: the cycle by a recursive query over its slots.
SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
c AS (SELECT k, count(*) AS n FROM r GROUP BY k),
w AS (SELECT k, n, sum(1) OVER () AS m,
             round(pow(n::DOUBLE, {TEMPER}) / sum(pow(n::DOUBLE, {TEMPER})) OVER (), 9) AS p
      FROM c),
q AS (SELECT k, n, m, greatest({CYCLE}, 4 * m)::BIGINT AS len, p FROM w),
f AS (SELECT *, floor(p * (len - m)) AS whole, p * (len - m) AS quota FROM q),
g AS (SELECT *, (len - m - sum(whole) OVER ())::BIGINT AS spare,
             row_number() OVER (ORDER BY quota - whole DESC, k) - 1 AS extra,
             row_number() OVER (ORDER BY k) AS number FROM f),
s AS (SELECT k, number, len, (1 + whole + CASE WHEN extra < spare % m THEN 1 ELSE 0 END
             + floor(spare / m))::BIGINT AS share FROM g),
a AS (SELECT list(share ORDER BY number) AS shares, any_value(len)::BIGINT AS len FROM s),
e AS (
  SELECT -1::BIGINT AS slot, [0::BIGINT for x in shares] AS done, NULL::BIGINT AS pick FROM a
  UNION ALL
  SELECT slot + 1, [done[i] + CASE WHEN i = p THEN 1 ELSE 0 END
                    for i in range(1, len(done) + 1)], p
  FROM (SELECT slot, done, list_min([
          CASE WHEN done[i] < shares[i] AND (done[i] * a.len) // shares[i] <= slot + 1
               THEN ((done[i] + 1) * a.len + shares[i] - 1) // shares[i] * 100000 + i END
          for i in range(1, len(done) + 1)]) % 100000 AS p
        FROM e, a WHERE slot + 1 < a.len)),
t AS (SELECT slot AS at, pick AS number,
             row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS turn
      FROM e WHERE slot >= 0),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY digest, doc_id) - 1 AS rank FROM r),
b AS (SELECT o.*, s.number, s.share, s.len, rank // {BLOCK_ROWS} AS block
      FROM o JOIN s USING (k))
SELECT b.doc_id, b.source, b.block, b.block * b.len // b.share AS release,
       ((b.block + 1) * b.len + b.share - 1) // b.share AS deadline,
       b.block // b.share * b.len + t.at AS slot,
       (b.block // b.share * b.len + t.at) * {BLOCK_ROWS} + b.rank % {BLOCK_ROWS} AS position
FROM b JOIN t ON t.number = b.number AND t.turn = b.block % b.share
"""


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Every document, in the order of the mix: files hold consecutive stretches of it."""

    placed, _ = settle(interleave(docs).select(
        F.col("doc_id").alias("__id"), "position"), "mix")
    # A repeated id has several places; its rows take the first.
    first = placed.groupBy("__id").agg(F.min("position").alias("__position"))
    joined = docs.join(first, F.col("doc_id").eqNullSafe(F.col("__id")))
    return joined.repartitionByRange("__position").sortWithinPartitions("__position").select(
        *docs.columns)
