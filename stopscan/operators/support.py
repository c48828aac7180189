"""What the measured library held behind each scored variant, term by term."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.functions.fixed import SUPPORT_KEYS
from stopscan.functions.nucleotides import as_dna
from stopscan.operators.ranking import quantiles, top_per_group

TERMS = ("stop_type", "up_123nt", "down_123nt")
#: Names of variants that one task compares.
NAMES_PER_TASK = 1_000_000


def normalised(df: DataFrame) -> DataFrame:
    """Triplets and stops in their DNA spelling."""

    return df.withColumns({c: as_dna(F.col(c)) for c in TERMS})


def context_cells(library: DataFrame) -> DataFrame:
    """Library rows per complete context, at most 3 * 64 * 64; every coarser count sums these."""

    return normalised(library).groupBy(*TERMS).agg(F.count(F.lit(1)).alias("n"))


def support_atlas(scored: DataFrame, library: DataFrame) -> DataFrame:
    """Every scored variant with the library count behind each term; absent levels count zero."""

    cells = context_cells(library)
    out = normalised(scored).select("variant_id", *TERMS)
    for name, keys in SUPPORT_KEYS.items():
        counts = cells.groupBy(*keys).agg(F.sum("n").alias(f"support_{name}"))
        out = out.join(counts, list(keys), "left")
    filled = out.select("variant_id", *[
        F.coalesce(f"support_{name}", F.lit(0)).cast("bigint").alias(f"support_{name}")
        for name in SUPPORT_KEYS])
    return filled.select(
        "*", (F.col("support_interaction_cell") == 0).alias("aliased_interaction"),
        (F.col("support_complete_context") > 0).alias("measured_exactly"),
        F.least(*[f"support_{n}" for n in (
            "stop", "upstream", "downstream", "interaction_cell")]).alias("weakest_term"))


def support_report(atlas: DataFrame) -> DataFrame:
    """How many variants are measured, aliased or unsupported, with median and 5th percentiles."""

    columns = ("support_upstream", "support_downstream", "support_interaction_cell")
    counted = atlas.agg(
        F.count(F.lit(1)).alias("variants"), F.count_if("measured_exactly").alias("measured"),
        F.count_if("aliased_interaction").alias("aliased"),
        F.count_if(F.col("weakest_term") == 0).alias("unsupported"))
    long = atlas.unpivot(["variant_id"], list(columns), "term", "value")
    found = quantiles(long, ["term"], "value", {"m": 0.5, "p5": 0.05})
    wide = found.agg(*[
        F.max(F.when(F.col("term") == c, F.col(q))).alias(f"{c}_{n}")
        for c in columns for q, n in (("m", "median"), ("p5", "p5"))])
    return counted.withColumns({n: wide.select(n).scalar() for n in wide.columns})


def context_analogues(scored: DataFrame, library: DataFrame, label: str,
                      limit: int = 10, identity: Sequence[str] = ("row",)) -> DataFrame:
    """Up to `limit` measured rows sharing each variant's complete context: same gene first, then
    the highest measured.

    A common context may hold much of both tables, so pairs are never formed. Per context and gene
    the top `limit` rows are kept, and per context the top `2 * limit`. If the variant's gene has
    fewer than `limit` rows there, at least `limit` rows of other genes are among those, and if it
    has more they fill the list alone: each variant meets at most `3 * limit` rows and the
    result is the exact one. They come as two sorted lists, so the variant's own list is put together
    in its row and no task sorts it; only a table that names a variant twice is ranked by sorting.
    """

    measured = normalised(library).select(
        *TERMS, "gene", F.upper("gene").alias("_gene"), "RT_binomial", *identity)
    best = [F.desc("RT_binomial"), *[F.asc(c) for c in identity]]
    held = F.struct("_r", "gene", "_gene", "RT_binomial", *identity)

    def listed(keys: Sequence[str], most: int, into: str) -> DataFrame:
        return top_per_group(measured, keys, best, most, "_r").groupBy(*keys).agg(
            F.sort_array(F.collect_list(held)).alias(into))

    own = listed([*TERMS, "_gene"], limit, "_own").withColumnRenamed("_gene", "_mine")
    every = listed(list(TERMS), 2 * limit, "_every")
    left = normalised(scored).select("variant_id", "gene_symbol", *TERMS,
                                     F.upper("gene_symbol").alias("_mine"))
    # Own rows first: few variants have any, so what the second join sorts is narrow.
    met = left.join(own, [*TERMS, "_mine"], "left").join(every, list(TERMS))

    def marked(items: Column, same: bool) -> Column:
        return F.transform(items, lambda x: F.struct(
            x["gene"].alias("gene"), x["RT_binomial"].alias("RT_binomial"),
            F.lit(same).alias("same_gene"), *[x[c].alias(c) for c in identity]))

    others = F.filter("_every", lambda x: ~x["_gene"].eqNullSafe(F.col("_mine")))
    joined = F.when(F.col("_own").isNull(), marked(others, False)).otherwise(
        F.concat(marked(F.col("_own"), True), marked(others, False)))
    ranked = met.select("variant_id", "gene_symbol", *TERMS,
                        F.posexplode(F.slice(joined, 1, limit)).alias("_place", "_row")).select(
        "variant_id", "gene_symbol", *TERMS, "_row.*", (F.col("_place") + 1).alias("rank"))
    if not _repeated(scored).isEmpty():
        ranked = top_per_group(ranked.drop("rank"), ["variant_id"],
                               [F.desc("same_gene"), *best], limit, "rank")
    return ranked.select(
        "variant_id", "gene_symbol", *TERMS, F.col("gene").alias("analogue_gene"),
        F.col("RT_binomial").alias("analogue_readthrough"), F.lit(label).alias("source"),
        "same_gene", "rank")


def _repeated(scored: DataFrame) -> DataFrame:
    """Variants named by several rows, their names dealt to tasks of bounded rows."""

    tasks = -(-scored.count() // NAMES_PER_TASK)
    names = scored.select("variant_id").repartition(max(tasks, 1), "variant_id")
    return names.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
