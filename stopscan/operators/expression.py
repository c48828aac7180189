"""Gene expression from count tables in long form `(gene_id, library, length, count)`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopscan.functions.scalars import gene_class, ratio
from stopscan.operators.footprints import share_of


def library_depth(counts: DataFrame) -> DataFrame:
    return counts.groupBy("library").agg(F.sum("count").alias("depth"))


def tpm(counts: DataFrame) -> DataFrame:
    """Reads per kilobase, then each library scaled to a million."""

    rated = counts.withColumn("_rpk", ratio(F.col("count"), F.col("length") / 1000))
    return share_of(rated, ["library"], "_rpk", "_share").select(
        "gene_id", "library", (F.col("_share") * 1e6).alias("tpm"))


def composition(expression: DataFrame, symbols: DataFrame) -> DataFrame:
    """Percent of each library by gene class."""

    named = expression.join(symbols, "gene_id", "left")
    return named.groupBy(gene_class(F.col("gene_symbol")).alias("gene_class"), "library").agg(
        (F.sum("tpm") / 1e4).alias("percent"))


def top_expressed(expression: DataFrame, symbols: DataFrame, top: int = 20,
                  exclude: Sequence[str] = ()) -> DataFrame:
    """The genes with the highest mean over all libraries, each library's value beside it.

    The top is chosen on one row per gene; only the chosen genes are joined back to their values.
    """

    libraries = expression.agg(F.count_distinct("library")).scalar()
    means = expression.groupBy("gene_id").agg((F.sum("tpm") / libraries).alias("mean_tpm"))
    named = means.join(symbols, "gene_id", "left").withColumn(
        "gene_symbol", F.coalesce("gene_symbol", F.split_part("gene_id", F.lit("."), F.lit(1))))
    if exclude:
        named = named.where(~gene_class(F.col("gene_symbol")).isin(*exclude))
    ranked = named.orderBy(F.desc("mean_tpm"), "gene_id").limit(top)
    return ranked.join(expression, "gene_id").select(
        "gene_id", "gene_symbol", "mean_tpm", "library", "tpm")
