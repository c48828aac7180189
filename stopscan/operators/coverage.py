"""What suppressor designs cover: by design, by disease, and as a greedy panel."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopscan.functions.fixed import AMINO_ACIDS
from stopscan.functions.scalars import half_even, met
from stopscan.operators.landscape import conservative
from stopscan.operators.variants import named_entities
from stopscan.session import cut_lineage, within


#: Pairs of signature and design that one task holds when it finishes a greedy order.
TASK_PAIRS = 200_000


def design_id() -> Column:
    """A suppressor design: the stop it reads and the residue it inserts."""

    return F.concat(F.upper("stop_type"), F.lit("-"), F.col("original_aa"))


def variant_designs(contexts: DataFrame) -> DataFrame:
    covered = met(F.col("scoreable"))
    return contexts.select("variant_id", covered.alias("covered"),
                           F.when(covered, design_id()).otherwise("").alias("design_id"))


def covered_sets(contexts: DataFrame, element: str) -> DataFrame:
    """Distinct `(design_id, element)` under exact restoration."""

    return contexts.where("scoreable").select(
        design_id().alias("design_id"), F.col(element).cast("string").alias("element")).distinct()


def is_partition(sets: DataFrame) -> DataFrame:
    """Whether the sets are disjoint: their sizes sum to the size of their union."""

    return sets.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("element").alias("in_union")
    ).select("total", "in_union", (F.col("total") == F.col("in_union")).alias("partition"))


def _finished(steps: DataFrame) -> DataFrame:
    return steps.select(
        "rank", "design_id",
        F.split_part("design_id", F.lit("-"), F.lit(1)).alias("recognized_stop"),
        F.substring_index("design_id", "-", -1).alias("_last"),
        "marginal", "cumulative", "cumulative_fraction", "uncovered",
    ).withColumn("inserted_aa", F.when(F.contains("design_id", F.lit("-")),
                                       F.regexp_extract("design_id", "^[^-]*-(.*)$", 1))
                 .otherwise("")).drop("_last")


def lazy_gains(pairs: pd.DataFrame) -> pd.DataFrame:
    """`(design_id, marginal)` of the greedy order of a few designs, those that add something.

    A design's last known gain bounds its gain from above, since gains never grow; only the design at
    the top of the heap is counted anew, and it is taken when its bound was right.
    """

    size = dict(zip(pairs["signature"], pairs["elements"]))
    held = pairs.groupby("design_id")["signature"].agg(list).to_dict()
    heap = [(-sum(size[s] for s in mine), d) for d, mine in held.items()]
    heapq.heapify(heap)
    taken = []
    while heap:
        bound, d = heapq.heappop(heap)
        gain = -sum(size[s] for s in held[d])
        if gain == bound:
            taken.append((d, -gain))
            size.update(dict.fromkeys(held[d], 0))
        elif gain:
            heapq.heappush(heap, (gain, d))
    return pd.DataFrame(taken, columns=["design_id", "marginal"])


def greedy_panel(sets: DataFrame) -> DataFrame:
    """The greedy maximum-coverage order of a set family, ties to the smaller id.

    Elements are first collapsed to the set of designs that hold them. While the signatures left are
    more than one task should hold, every design that comes first among all designs it shares an
    uncovered element with is settled, however many there are: it keeps its gain until the greedy
    order reaches it. What then fits a task is finished there. Gains never grow, so the order is
    their sort.
    """

    signatures = (
        sets.distinct().groupBy("element").agg(F.sort_array(F.collect_set("design_id")).alias("by"))
        .groupBy("by").agg(F.count(F.lit(1)).alias("elements")))
    numbered = cut_lineage(signatures.withColumn("signature", F.monotonically_increasing_id()))
    left = numbered.select("signature", F.explode("by").alias("design_id"), "elements")
    settled = []
    while not within(left, TASK_PAIRS):
        gains = left.groupBy("design_id").agg(
            F.sum("elements").alias("marginal"), F.count(F.lit(1)).alias("held"))
        first = cut_lineage(left.join(gains, "design_id").groupBy("signature").agg(
            F.min(F.struct((-F.col("marginal")).alias("order"), "design_id", "held")).alias("f")
        ).select("signature", "f.*"))
        chosen = cut_lineage(first.groupBy("design_id", "held", "order").agg(
            F.count(F.lit(1)).alias("led")).where(F.col("led") == F.col("held")).select(
            "design_id", (-F.col("order")).alias("marginal")))
        settled.append(chosen)
        covered = first.join(chosen, "design_id", "left_semi")
        left = cut_lineage(left.join(covered, "signature", "left_anti"))
    sizes = left.groupBy().applyInPandas(lazy_gains, "design_id string, marginal bigint")
    for chosen in settled:
        sizes = sizes.unionByName(chosen)
    return _finished(disjoint_panel(sizes))


def disjoint_panel(sizes: DataFrame) -> DataFrame:
    """The greedy order of disjoint sets from `(design_id, marginal)`: a sort and a running sum.

    One row per design reaches the window, never an element.
    """

    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("marginal"), "design_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("marginal").over(Window.partitionBy(F.lit(1)))
    return (sizes.withColumn("rank", F.row_number().over(order).cast("bigint"))
            .withColumn("cumulative", F.sum("marginal").over(so_far))
            .withColumn("cumulative_fraction", F.col("cumulative") / total)
            .withColumn("uncovered", total - F.col("cumulative")))


_ELEMENTS = {"variants": "variant_id", "genes": "gene_symbol"}


def coverage_frontier(contexts: DataFrame, objective: str = "variants") -> DataFrame:
    """The frontier for one objective; the first k rows are the panel of size k."""

    if objective not in _ELEMENTS:
        raise ValueError(f"cannot cover {objective!r}; known elements: {', '.join(_ELEMENTS)}")
    return greedy_panel(covered_sets(contexts, _ELEMENTS[objective]))


def panel_readout(frontier: DataFrame, sizes: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """What panels of chosen sizes cover."""

    return frontier.where(F.col("rank").isin(*sizes)).select(
        "rank", "cumulative", "cumulative_fraction", "uncovered")


def disease_reach_frontier(conditions: DataFrame, contexts: DataFrame) -> DataFrame:
    """The greedy panel that touches most condition entities."""

    reached = named_entities(conditions).select("variant_id", "medgen").join(
        variant_designs(contexts.where(met(F.col("scoreable")))), "variant_id")
    return greedy_panel(reached.where("design_id <> ''").select(
        "design_id", F.col("medgen").alias("element")))


def coverage_by_design(contexts: DataFrame) -> DataFrame:
    """Variants each stop and inserted residue restores exactly, or conservatively."""

    counts = contexts.where(F.col("stop_type").isNotNull()).groupBy(
        F.upper("stop_type").alias("recognized_stop"), "original_aa"
    ).agg(F.count(F.lit(1)).alias("n"))
    # At most three stops by twenty-one residues reach this point.
    inserted = counts.withColumn("inserted_aa", F.explode(F.split(F.lit(AMINO_ACIDS), "")))
    inserted = inserted.where("inserted_aa <> ''")
    return inserted.groupBy("recognized_stop", "inserted_aa").agg(
        F.sum("n").alias("variants_at_stop"),
        F.sum(F.when(F.col("original_aa") == F.col("inserted_aa"), F.col("n")).otherwise(0))
        .alias("restores_exactly"),
        F.sum(F.when(met(conservative(F.col("original_aa"), F.col("inserted_aa"))), F.col("n"))
              .otherwise(0)).alias("conservative"),
    ).withColumn("design_id", F.concat_ws("-", "recognized_stop", "inserted_aa")).orderBy(
        F.desc("conservative"), "design_id")


def disease_coverage(conditions: DataFrame, contexts: DataFrame,
                     order: str = "ordinal") -> DataFrame:
    """Per condition entity: eligible and covered variants, reach, completeness, designs, genes.

    Counted in two levels (entity and variant, then entity), so an entity holding many rows is
    already reduced when its rows meet.
    """

    keyed = named_entities(conditions).select(
        "variant_id", F.coalesce("medgen", F.lit("")).alias("medgen"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("condition_name", "omim", "orphanet")],
        "gene_symbol", order)
    merged = keyed.join(variant_designs(contexts), "variant_id", "left").withColumn(
        "covered", met(F.col("covered")))
    names = (merged.groupBy("medgen", "condition_name").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("medgen").agg(F.min_by(
                 "condition_name", F.struct(-F.col("n"), "condition_name")).alias("condition_name")))

    def first_filled(column: str) -> Column:
        filled = F.when(F.col(column) != "", F.struct(order, column))
        return F.min(filled)

    per_variant = merged.groupBy("medgen", "variant_id").agg(
        F.max("covered").alias("covered"),
        F.collect_set(F.when(F.col("covered") & (F.col("design_id") != ""), F.col("design_id")))
        .alias("designs"),
        F.collect_set("gene_symbol").alias("genes"),
        first_filled("omim").alias("omim"), first_filled("orphanet").alias("orphanet"))
    entities = per_variant.groupBy("medgen").agg(
        F.count(F.lit(1)).alias("eligible_variants"),
        F.count_if("covered").alias("model_covered"),
        F.coalesce(F.min("omim")["omim"], F.lit("")).alias("omim"),
        F.coalesce(F.min("orphanet")["orphanet"], F.lit("")).alias("orphanet"))
    genes = per_variant.select("medgen", F.explode("genes").alias("gene")).distinct().groupBy(
        "medgen").agg(F.count(F.lit(1)).alias("genes"))
    # A design is one of sixty, so the set per entity is small.
    designs = per_variant.select("medgen", F.explode("designs").alias("design_id")).distinct(
    ).groupBy("medgen").agg(F.sort_array(F.collect_set("design_id")).alias("designs"))
    joined = (entities.join(names, "medgen").join(genes, "medgen", "left")
              .join(designs, "medgen", "left"))
    listed = F.coalesce("designs", F.array().cast("array<string>"))
    mapped = (F.col("omim") != "") | (F.col("orphanet") != "")
    return joined.select(
        "medgen", "condition_name", "omim", "orphanet", "eligible_variants", "model_covered",
        half_even(F.col("model_covered") / F.col("eligible_variants"), 4)
        .alias("covered_fraction"),
        (F.col("model_covered") >= 1).alias("reach"),
        (F.col("model_covered") == F.col("eligible_variants")).alias("complete"),
        F.coalesce("genes", F.lit(0)).cast("bigint").alias("genes"),
        F.size(listed).alias("designs_contributing"), F.array_join(listed, ";").alias("designs"),
        F.when(mapped, "mapped").otherwise("medgen_only").alias("mapping_completeness"))
