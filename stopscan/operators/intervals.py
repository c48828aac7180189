"""Interval overlap without enumerating pairs.

An interval overlaps a query when it starts before the query ends and does not end before the
query starts; the second group lies inside the first. So the number of overlapping intervals is
`starts below the query's end` minus `ends at or below the query's start`: two rank lookups. Doing
this over all genes and again over the query's own gene gives the overlaps with other genes. Cost
is a few shuffles of the input however many pairs overlap, and one crowded locus is cut in blocks.
Where only the existence of an overlap is asked, one sweep keeps the furthest end of two genes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopscan.functions.fixed import UTR_FEATURES
from stopscan.operators.ranking import running_total
from stopscan.session import cut_lineage

INTERVAL = ("chrom", "start", "end", "strand", "gene_id", "transcript_id")


def coding_and_untranslated(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coding and untranslated intervals of one annotation, half-open."""

    rows = features.where(
        F.col("gene_id").isNotNull() & F.col("transcript_id").isNotNull()
    ).select("feature", "chrom", (F.col("start") - 1).alias("start"), "end", "strand",
             "gene_id", "transcript_id")
    return (rows.where("feature = 'CDS'").drop("feature"),
            rows.where(F.col("feature").isin(*UTR_FEATURES)).drop("feature"))


def downstream_regions(coding: DataFrame, untranslated: DataFrame) -> DataFrame:
    """Untranslated intervals past the coding sequence in the direction it is read."""

    extent = coding.groupBy("transcript_id").agg(
        F.min("start").alias("cds_start"), F.max("end").alias("cds_end"))
    past = F.when(F.col("strand") == "+", F.col("start") >= F.col("cds_end")).otherwise(
        F.col("end") <= F.col("cds_start"))
    return untranslated.join(extent, "transcript_id").where(past).select(*INTERVAL)


ANY = "*"


def overlap_counts(queries: DataFrame, intervals: DataFrame, keys: Sequence[str],
                   group: str | None = None, block: int = 1 << 16) -> DataFrame:
    """Distinct `(keys, start, end)` of `queries` with the number of overlapping `intervals`.

    With `group`, queries are told apart by it too and only intervals of other groups count. All
    rank lookups (starts and ends, over every group and over the query's own) are one running
    count over the union of points and lookups.
    """

    places = [*keys, "_scope", "_kind"]
    scopes = [F.lit(ANY)] + ([F.col(group).cast("string")] if group else [])

    def marked(begin: Column, finish: Column, signed: bool) -> Column:
        rows = []
        for own, scope in enumerate(scopes):
            for kind, at, sign in (("begin", begin, 1), ("end", finish, -1)):
                fields = [scope.alias("_scope"), F.lit(kind).alias("_kind"),
                          at.cast("bigint").alias("_at")]
                if signed:
                    fields.append(F.lit(-sign if own else sign).alias("_sign"))
                rows.append(F.struct(*fields))
        return F.inline(F.array(*rows))

    points = intervals.select(
        *keys, marked(F.col("start"), F.col("end"), False)
    ).groupBy(*places, "_at").agg(F.count(F.lit(1)).alias("n"))
    identity = [*keys, *([group] if group else []), "start", "end"]
    lookups = queries.select(*identity).distinct().select(
        *identity, marked(F.col("end") - 1, F.col("start"), True))
    events = points.withColumn("query", F.lit(0)).unionByName(
        lookups.select(*places, "_at").distinct().select(
            *places, "_at", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("query")))
    counted = running_total(
        events.withColumn("_block", F.floor(F.col("_at") / block)), places, "_block",
        ["_at", "query"], "n", "found")
    found = counted.where("query = 1").select(*places, "_at", "found")
    return lookups.join(found, [*places, "_at"]).groupBy(*identity).agg(
        F.sum(F.col("found") * F.col("_sign")).alias("overlaps"))


def _two_best(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`events` with the largest of `_one` and `_two` so far, `_first`, and of another gene, `_second`.

    Both are structs `(end, gene)`. While one gene holds the first place, the second is the largest of
    the others among what held the first place before and what has come since.
    """

    so_far = Window.partitionBy(*keys).orderBy(*order)
    upto = so_far.rowsBetween(Window.unboundedPreceding, 0)
    first, before = F.col("_first"), F.col("_before")
    led = events.withColumn("_first", F.max(F.greatest("_one", "_two")).over(upto)).withColumn(
        "_before", F.lag("_first").over(so_far))
    changed = F.coalesce(first["gene"] != before["gene"], F.lit(False))
    led = led.withColumn("_held", F.sum(changed.cast("int")).over(upto))
    others = F.greatest(
        F.when(F.col("_one")["gene"] != first["gene"], F.col("_one")),
        F.when(F.col("_two")["gene"] != first["gene"], F.col("_two")), F.when(changed, before))
    since = Window.partitionBy(*keys, "_held").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    return led.withColumn("_second", F.max(others).over(since)).drop("_before", "_held")


def furthest_ends(coding: DataFrame, asked: DataFrame, keys: Sequence[str],
                  block: int = 1 << 16) -> DataFrame:
    """Distinct `(keys, at)` of `asked` with the furthest end of the intervals that start at or below
    it, `_first`, and the furthest of another gene, `_second`; structs `(end, gene)`.

    One sweep over starts and places asked for, cut into blocks: a block begins with what the blocks
    before it hold, so only one block is sorted at a time.
    """

    kind = coding.select(F.struct("end", F.col("gene_id").alias("gene")).alias("_one")).schema[0].dataType
    points = coding.groupBy(*keys, F.col("start").alias("_at"), "gene_id").agg(
        F.max("end").alias("end")).select(
        *keys, "_at", F.lit(0).alias("_query"),
        F.struct("end", F.col("gene_id").alias("gene")).cast(kind).alias("_one"))
    places = asked.select(*keys, F.col("at").alias("_at")).distinct().select(
        *keys, "_at", F.lit(1).alias("_query"), F.lit(None).cast(kind).alias("_one"))
    events = points.unionByName(places).withColumn("_block", F.floor(F.col("_at") / block))
    inside = [*keys, "_block"]
    genes = events.groupBy(*inside, F.col("_one")["gene"].alias("_gene")).agg(
        F.max("_one").alias("_e"))
    top = F.max("_e").over(Window.partitionBy(*inside))
    blocks = genes.withColumn("_top", top).groupBy(*inside).agg(
        F.max("_e").alias("_one"),
        F.max(F.when(F.col("_e")["gene"] != F.col("_top")["gene"], F.col("_e"))).alias("_two"))
    earlier = Window.partitionBy(*keys).orderBy("_block")
    begun = _two_best(blocks, keys, ["_block"]).select(
        *inside, F.lit(None).cast("bigint").alias("_at"), F.lit(0).alias("_query"),
        F.lag("_first").over(earlier).alias("_one"), F.lag("_second").over(earlier).alias("_two"))
    # A missing place sorts first: what was held before the block.
    swept = _two_best(events.withColumn("_two", F.lit(None).cast(kind)).unionByName(begun), inside,
                      ["_at", "_query", "_one"])
    return swept.where("_query = 1").select(*keys, F.col("_at").alias("at"), "_first", "_second")


def overlapping_other_genes(features: DataFrame) -> DataFrame:
    """(transcript_id) with a downstream region that shares a base and a strand with the coding
    part of a different gene.

    Of the coding intervals of other genes that start before a region ends, one reaches into it if the
    one that ends last does; no pairs are formed.
    """

    coding, untranslated = coding_and_untranslated(features)
    # Written once: the regions are looked up and then matched back to their transcripts.
    regions = cut_lineage(downstream_regions(coding, untranslated).withColumn(
        "at", F.col("end") - 1))
    found = furthest_ends(coding, regions, ["chrom", "strand"])
    other = F.when(F.col("_first")["gene"] != F.col("gene_id"), F.col("_first")).otherwise(
        F.col("_second"))
    return regions.join(found, ["chrom", "strand", "at"]).where(
        other["end"] > F.col("start")).select("transcript_id").distinct()
