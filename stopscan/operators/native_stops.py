"""Native stop codons: their extension windows, measured occupancy and predicted readability."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.functions.fixed import PROGRAMMED_READTHROUGH, QUADRANTS
from stopscan.functions.nucleotides import (
    as_dna,
    as_rna,
    base_at,
    is_stop,
    next_stop_distance,
    translate_sequence,
)
from stopscan.functions.scalars import half_even, let, met, ratio
from stopscan.operators.ranking import average_ranks, hashed_rank, quantiles
from stopscan.operators.resampling import PRIME, mixed, mixed_sql
from stopscan.session import cut_lineage, within


def _named(sequences: DataFrame) -> DataFrame:
    """Sequences under their transcript, to be joined by sorting: derived ones are far wider than
    the planner takes a string to be, and it would broadcast them."""

    return sequences.select(F.col("accession").alias("transcript"), "sequence").hint("merge")


def extension_windows(annotation: DataFrame, sequences: DataFrame) -> DataFrame:
    """The extension window of every coding transcript that has a sequence."""

    joined = annotation.where("l_cds > 0").join(
        _named(sequences), "transcript")
    start = (F.col("l_utr5") + F.col("l_cds") - 3).cast("int")
    return joined.select("transcript", next_stop_distance(F.col("sequence"), start)
                         .alias("extension"))


def extension_peptides(annotation: DataFrame, sequences: DataFrame,
                       extensions: DataFrame | None = None) -> DataFrame:
    """The peptide past each native stop, over whole codons the sequence holds.

    Without `extensions` the windows are found on the way, from the one join that brings the sequence.
    """

    if extensions is None:
        joined = annotation.where("l_cds > 0").join(_named(sequences), "transcript")
        stop = (F.col("l_utr5") + F.col("l_cds") - 3).cast("int")
        extension = next_stop_distance(F.col("sequence"), stop)
    else:
        joined = (extensions.where("extension is not null")
                  .join(annotation.select("transcript", "l_utr5", "l_cds").hint("merge"),
                        "transcript").join(_named(sequences), "transcript"))
        extension = F.col("extension")
    start = (F.col("l_utr5") + F.col("l_cds")).cast("int")

    def read(past: Column) -> Column:
        window = F.least(past - 3, F.length("sequence") - start)
        tail = F.upper(F.substring("sequence", start + 1, F.greatest(window, F.lit(0)).cast("int")))
        return let(F.when(past.isNotNull(), translate_sequence(tail)), lambda peptide: F.struct(
            past.alias("extension_nt"), F.length(peptide).alias("extension_aa"),
            peptide.alias("extension_peptide")))

    # Outer, since a filter on what is read would be pushed below the reading and repeat it.
    return joined.select("transcript", F.inline_outer(F.array(let(extension, read)))).where(
        "extension_nt is not null")


def native_stop_features(annotation: DataFrame, sequences: DataFrame) -> DataFrame:
    """The stop, the last sense codon and the first codon past it; non-stops are left out."""

    joined = annotation.where("l_cds >= 6").join(
        _named(sequences), "transcript")
    start = (F.col("l_utr5") + F.col("l_cds") - 3).cast("int")
    read = joined.select("transcript", *[
        base_at(F.col("sequence"), start + shift, 3).alias(name)
        for name, shift in (("stop", 0), ("up", -3), ("down", 3))])
    whole = (F.length("stop") == 3) & (F.length("up") == 3) & (F.length("down") == 3)
    return read.where(met(whole & is_stop(as_dna(F.col("stop"))))).select(
        "transcript", as_rna(F.col("stop")).alias("stop_type"),
        as_rna(F.col("up")).alias("up_123nt"), as_rna(F.col("down")).alias("down_123nt"))


def excluded_transcripts(overlapping: DataFrame, genes: DataFrame) -> DataFrame:
    """Transcripts that overlap another gene's coding sequence, or read through natively."""

    programmed = genes.where(F.col("gene").isin(*PROGRAMMED_READTHROUGH)).select("transcript")
    return overlapping.select(F.col("transcript_id").alias("transcript")).union(
        programmed).distinct()


def native_stop_occupancy(counts: DataFrame, arms: DataFrame, names: Sequence[str],
                          lengths: Sequence[int], excluded: DataFrame | None = None,
                          minimum_depth: int = 100, minimum_utr3: int = 50) -> DataFrame:
    """In-frame occupancy past each native stop, pooled over an arm's libraries.

    `names` lists the arms; `included` needs every one of them deep enough.
    """

    kept = counts.where(F.col("length").isin(*lengths) & (F.col("l_utr3") >= minimum_utr3))
    if excluded is not None:
        kept = kept.join(excluded.select("transcript").distinct(), "transcript", "left_anti")
    kept = kept.join(arms.select("sample", "treatment"), "sample")

    def pooled(column: str, arm: str) -> Column:
        return F.sum(F.when(F.col("treatment") == arm, F.col(column)))

    wide = kept.where(F.col("treatment").isin(*names)).groupBy("transcript").agg(
        *[pooled("extension_frame0", a).alias(f"_ext_{a}") for a in names],
        *[pooled("cds_frame0", a).alias(f"_cds_{a}") for a in names])
    columns, depths = [], []
    for arm in names:
        ext, cds = F.col(f"_ext_{arm}"), F.col(f"_cds_{arm}")
        depth = F.coalesce(cds, F.lit(0)).cast("bigint")
        depths.append(depth)
        columns += [
            ratio(ext, cds).alias(f"{arm}_occupancy"), depth.alias(f"{arm}_depth"),
            F.sqrt(F.try_divide(F.lit(1.0), ext.cast("double"))
                   + F.try_divide(F.lit(1.0), cds.cast("double"))).alias(f"{arm}_rel_se")]
    included = F.lit(True)
    for depth in depths:
        included = included & (depth >= minimum_depth)
    return wide.select("transcript", *columns, included.alias("included"))


def atlas_summary(atlas: DataFrame, control: str, arms: Sequence[str]) -> DataFrame:
    """Included and tight native stops, and each arm's mean lift over control; one row."""

    ok, base = F.col("included"), F.col(f"{control}_occupancy")
    return atlas.agg(
        F.count(F.lit(1)).alias("transcripts"), F.count_if(ok).alias("included"),
        F.count_if(ok & met(base < 0.05)).alias("tight"),
        *[F.avg(F.when(ok, F.col(f"{a}_occupancy") - base)).alias(f"{a}_mean_lift")
          for a in arms if a != control])


def labelled_atlas(predicted: DataFrame, atlas: DataFrame, selected: DataFrame,
                   treated: str, control: str) -> DataFrame:
    """Predictions beside the measured lift, with the one-per-gene flag."""

    measured = atlas.where("included").select(
        "transcript", F.col(f"{control}_occupancy").alias("control_occupancy"),
        F.col(f"{treated}_occupancy").alias("treated_occupancy"),
        F.col(f"{treated}_depth").alias("treated_depth"),
        (F.col(f"{treated}_occupancy") - F.col(f"{control}_occupancy")).alias("measured_lift"))
    flagged = selected.select("transcript").distinct().withColumn("mane_select", F.lit(True))
    return (predicted.join(measured, "transcript", "left")
            .join(flagged, "transcript", "left")
            .withColumn("measurable", F.col("measured_lift").isNotNull())
            .withColumn("mane_select", met(F.col("mane_select"))))


def four_quadrants(df: DataFrame, predicted: str, measured: str, measured_cut: float = 0.05,
                   predicted_quantile: float = 0.75) -> DataFrame:
    """Each native stop's group at the predicted upper quartile and the measured cut.

    The quartile is taken over the comparable stops: selected, predicted and measured.
    """

    usable = F.col("mane_select") & F.col(predicted).isNotNull() & F.col(measured).isNotNull()
    cut = quantiles(df.where(usable), [], predicted, {"cut": predicted_quantile})
    high_p, high_m = F.col(predicted) >= F.col("_cut"), F.col(measured) >= measured_cut
    both, only_p, only_m, neither = QUADRANTS
    return (df.withColumn("_cut", F.coalesce(cut.scalar(), F.lit(0.0)))
            .withColumn("group", F.when(~usable, "").when(high_p & high_m, both)
                        .when(high_p, only_p).when(high_m, only_m).otherwise(neither))
            .drop("_cut"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per group, ties at their average rank; `(keys, n, rho)`."""

    paired = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_ranks(average_ranks(paired, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


#: Pairs that one task holds, some tens of bytes each; more are joined.
COMPACT_ROWS = 8_000_000
SLOTS = 100_000
DRAWS_AT_ONCE = 20


def concordance(df: DataFrame, x: str, y: str, identity: str, draws: int = 2000,
                seed: int = 20240724) -> DataFrame:
    """Spearman's rho with a paired percentile bootstrap; nulls under twenty pairs; one row.

    Rows are numbered by a hash of their identity, and what a slot of a draw picks is mixed from seed,
    draw and slot, so the interval is the same whichever way the picked rows are fetched: a table of
    up to `COMPACT_ROWS` pairs (one per gene) is shuffled to the tasks, a larger one is joined.
    """

    paired = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        identity, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    point = spearman(paired, [], "x", "y")
    fetch = compact_draws if within(paired, COMPACT_ROWS) else joined_draws
    spread = fetch(paired, identity, draws, seed).where(
        F.col("rho").isNotNull() & ~F.isnan("rho")).agg(
        F.percentile("rho", 0.025).alias("low"), F.percentile("rho", 0.975).alias("high"))
    enough = F.col("n") >= 20
    return point.select(
        "n", F.when(enough, half_even(F.col("rho"), 4)).alias("rho"),
        *[F.when(enough, half_even(spread.select(c).scalar(), 4)).alias(c)
          for c in ("low", "high")])


def _picked(seed: int, draw: int, part: int, rows: int) -> np.ndarray:
    """The 0-based numbers of the rows that fill one part of a draw, `SLOTS` slots long."""

    slots = np.arange(part * SLOTS, min((part + 1) * SLOTS, rows))
    return (mixed(seed, draw, slots) * PRIME + mixed(seed, draw, slots, 1)) % rows


def concordance_sql(pairs: str, x: str, y: str, identity: str, draws: int = 2000,
                    seed: int = 20240724) -> str:
    """Common table `agreed` (n, rho, low, high) that states `concordance` of CTE `pairs` in SQL."""

    def ranked(by: str, group: str) -> str:
        part = f"PARTITION BY {group}" if group else ""
        each = f"PARTITION BY {group + ', ' if group else ''}{by}"
        return f"rank() OVER ({part} ORDER BY {by}) + (count(*) OVER ({each}) - 1) / 2"

    return f"""nb AS (SELECT {x} AS x, {y} AS y, count(*) OVER () AS n, row_number() OVER (
    ORDER BY md5('rows{seed}|' || cast({identity} AS varchar))) - 1 AS row FROM {pairs}
  WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
sl AS (SELECT d, row AS i, n FROM nb, (SELECT unnest(range(0, {draws})) AS d) AS r),
pa AS (SELECT d, i, n, m3 AS a FROM (SELECT *, {mixed_sql(str(seed), "d", "i")} FROM sl)),
pb AS (SELECT d, cast(a * {PRIME} + m4 AS BIGINT) % n AS row FROM (
    SELECT *, {mixed_sql(str(seed), "d", "i", "1")} FROM pa)),
rk AS (SELECT d, {ranked("x", "d")} AS a, {ranked("y", "d")} AS b FROM pb JOIN nb USING (row)),
rh AS (SELECT d, corr(a, b) AS rho FROM rk GROUP BY d),
iv AS (SELECT quantile_cont(rho, 0.025) AS low, quantile_cont(rho, 0.975) AS high FROM rh
  WHERE NOT isnan(rho)),
pt AS (SELECT count(*) AS n, corr(a, b) AS rho FROM (
    SELECT {ranked("x", "")} AS a, {ranked("y", "")} AS b FROM nb)),
agreed AS (SELECT n, CASE WHEN n >= 20 THEN round_even(rho, 4) END AS rho,
    CASE WHEN n >= 20 THEN round_even(low, 4) END AS low,
    CASE WHEN n >= 20 THEN round_even(high, 4) END AS high FROM pt, iv)"""


def _numbered(paired: DataFrame, identity: str, seed: int) -> DataFrame:
    return hashed_rank(paired, [], [identity], f"rows{seed}", "row").select("row", "x", "y")


def compact_draws(paired: DataFrame, identity: str, draws: int, seed: int) -> DataFrame:
    """`(draw, rho)` for at most `COMPACT_ROWS` pairs, `DRAWS_AT_ONCE` draws to a task.

    The pairs are packed into blocks that are dealt to the groups of draws in a shuffle, so nothing
    passes through the driver. Every draw counts how often it picks each pair: the ranks follow from
    the counts by value and need no sorting of the draw.
    """

    spark = paired.sparkSession
    numbered = _numbered(paired, identity, seed)

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"rows": [rows.num_rows], **{
            c: pa.array([rows.column(c).to_numpy().tobytes()], pa.binary())
            for c in ("row", "x", "y")}})

    blocks = numbered.withColumn("block", F.floor((F.col("row") - 1) / SLOTS)).groupBy(
        "block").applyInArrow(pack, "rows long, row binary, x binary, y binary")
    # Settled before it is dealt out, so that no group packs the pairs again.
    blocks = cut_lineage(blocks)
    groups = -(-draws // DRAWS_AT_ONCE)

    def resample(key: tuple, held: pa.Table) -> pa.Table:
        total = sum(held.column("rows").to_pylist())

        def column(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in held.column(name)])

        order = column("row", np.int64) - 1
        codes, sizes = [], []
        for name in ("x", "y"):
            values = np.empty(total)
            values[order] = column(name, np.float64)
            distinct, code = np.unique(values, return_inverse=True)
            codes.append(code.astype(np.int32))
            sizes.append(len(distinct))
        first = key[0].as_py() * DRAWS_AT_ONCE
        numbers = range(first, min(first + DRAWS_AT_ONCE, draws))
        return pa.table({"draw": pa.array(numbers, pa.int64()), "rho": pa.array(
            [_drawn_rho(codes, sizes, seed, d, total) for d in numbers], pa.float64(),
            from_pandas=False)})

    dealt = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    # Counted partitions, which are not merged: each holds few bytes, but work for every draw.
    return dealt.repartition(groups, "group").groupBy("group").applyInArrow(
        resample, "draw long, rho double")


def _drawn_rho(codes: Sequence[np.ndarray], sizes: Sequence[int], seed: int, draw: int,
               total: int) -> float:
    """Spearman's rho of one draw from the value codes of all pairs, NaN without spread."""

    weights = np.zeros(total, np.int32)
    for part in range(-(-total // SLOTS)):
        row, w = np.unique(_picked(seed, draw, part, total), return_counts=True)
        weights[row] += w.astype(np.int32)
    ranks = []
    for code, size in zip(codes, sizes):
        counts = np.bincount(code, weights, size)
        ranks.append(np.cumsum(counts) - (counts - 1) / 2.0 - (total + 1) / 2)
    sums = np.zeros(3)
    for at in range(0, total, SLOTS):
        w = weights[at:at + SLOTS]
        a, b = (rank[code[at:at + SLOTS]] for rank, code in zip(ranks, codes))
        sums += (w * a) @ b, (w * a) @ a, (w * b) @ b
    scale = np.sqrt(sums[1] * sums[2])
    return float(sums[0] / scale) if scale > 0 else float("nan")


def joined_draws(paired: DataFrame, identity: str, draws: int, seed: int) -> DataFrame:
    """`(draw, rho)` with nothing collected but the number of rows.

    Each part of a draw is one row of a range, so tasks stay bounded. A row picked several times
    stays one row with a weight, through the ranks and the sums of the correlation.
    """

    spark = paired.sparkSession
    numbered = _numbered(paired, identity, seed)
    total = numbered.count()
    parts = -(-total // SLOTS)

    def pick(batches):
        for batch in batches:
            for at in batch["id"]:
                draw, part = divmod(int(at), parts)
                row, w = np.unique(_picked(seed, draw, part, total), return_counts=True)
                yield pd.DataFrame({"draw": draw, "row": row + 1, "w": w})

    chosen = spark.range(draws * parts).mapInPandas(pick, "draw long, row long, w long").groupBy(
        "draw", "row").agg(F.sum("w").alias("w"))
    drawn = chosen.join(numbered, "row").select("draw", "x", "y", "w")
    ranked = average_ranks(average_ranks(drawn, ["draw"], "x", "_rx", weight="w"),
                           ["draw"], "y", "_ry", weight="w")
    a, b = F.col("_rx") - (total + 1) / 2, F.col("_ry") - (total + 1) / 2
    sums = ranked.groupBy("draw").agg(F.sum(F.col("w") * a * b).alias("_ab"), F.sqrt(
        F.sum(F.col("w") * a * a) * F.sum(F.col("w") * b * b)).alias("_scale"))
    return sums.select("draw", F.try_divide("_ab", "_scale").alias("rho"))
