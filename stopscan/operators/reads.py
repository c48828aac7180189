"""What a library's own reads say about its adapter, and its trimming and alignment summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopscan.functions.fixed import (
    ALIGNER_FIELDS,
    MINIMUM_ADAPTER_RATE,
    PLAUSIBLE_FOOTPRINT,
)
from stopscan.functions.nucleotides import adapter_start, degenerate_prefix
from stopscan.functions.scalars import half_even, met, ratio


def located_adapters(reads: DataFrame, runs: DataFrame) -> DataFrame:
    """Every read of a footprint library with the length left before its declared adapter.

    `reads` is `(sample, sequence)`, whole libraries; runs are tens of rows.
    """

    declared = runs.where("assay = 'riboseq'").select(
        "sample", "adapter_3p", "cut_5p", "adapter_overlap")
    joined = reads.select("sample", "sequence").join(declared, "sample")
    loose = degenerate_prefix(F.col("adapter_3p"))
    fixed = F.ltrim("adapter_3p", F.lit("N"))
    minimum = F.greatest(F.lit(1), F.col("adapter_overlap") - loose).cast("int")
    start = adapter_start(F.col("sequence"), fixed, minimum)
    return joined.select("sample", "adapter_3p",
                         (start - F.col("cut_5p") - loose).alias("footprint"))


def adapter_survey(located: DataFrame) -> DataFrame:
    """Match rate and footprint deciles per library.

    Footprints are first counted by length, at most one row per base of a read, so order statistics
    are read off a running count of that small table. Deciles use the exclusive method and need
    more than ten values.
    """

    lengths = located.groupBy("sample", "adapter_3p", "footprint").agg(
        F.count(F.lit(1)).alias("n"))
    found = F.col("footprint").isNotNull()
    order = Window.partitionBy("sample").orderBy("footprint")
    counted = lengths.withColumn("upto", F.sum(F.when(found, F.col("n")).otherwise(0)).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    totals = lengths.groupBy("sample", "adapter_3p").agg(
        F.sum("n").alias("reads"),
        F.coalesce(F.sum(F.when(found, F.col("n"))), F.lit(0)).alias("matched"))
    joined = counted.join(totals, ["sample", "adapter_3p"])

    def at(rank: Column) -> Column:
        return F.min(F.when(found & (F.col("upto") >= rank), F.col("footprint")))

    m = F.col("matched")

    def decile(i: int) -> tuple[Column, Column, Column]:
        whole = F.floor((m + 1) * i / 10)
        whole = F.greatest(F.lit(1), F.least(whole, m - 1))
        part = (m + 1) * i - whole * 10
        return at(whole), at(whole + 1), F.max(part)

    columns = {"lo": at(F.floor((m + 1) / 2)), "hi": at(F.ceil((m + 1) / 2))}
    for i in (1, 9):
        columns[f"d{i}a"], columns[f"d{i}b"], columns[f"d{i}p"] = decile(i)
    picked = joined.groupBy("sample", "adapter_3p").agg(
        F.max("reads").alias("reads_surveyed"), F.max("matched").alias("matched"),
        *[c.alias(n) for n, c in columns.items()])

    def interpolated(i: int) -> Column:
        value = (F.col(f"d{i}a") * (10 - F.col(f"d{i}p")) + F.col(f"d{i}b") * F.col(f"d{i}p")) / 10
        return F.when(F.col("matched") > 10, F.bround(value, 0).cast("int"))

    return picked.select(
        "sample", "adapter_3p", "reads_surveyed",
        half_even(ratio(F.col("matched"), F.col("reads_surveyed")), 5).alias("adapter_rate"),
        interpolated(1).alias("footprint_p10"),
        F.bround((F.col("lo") + F.col("hi")) / 2, 0).cast("int").alias("footprint_median"),
        interpolated(9).alias("footprint_p90"))


def refused_adapters(survey: DataFrame, minimum_rate: float = MINIMUM_ADAPTER_RATE,
                     plausible: tuple[int, int] = PLAUSIBLE_FOOTPRINT) -> DataFrame:
    """Libraries whose declared adapter is too rare, or leaves an implausible footprint."""

    rare = F.col("adapter_rate") < minimum_rate
    odd = ~met(F.col("footprint_median").between(*plausible))
    return survey.where(rare | odd).select(
        "sample", F.when(rare, "adapter_rate").otherwise("footprint").alias("refused_for"))


def trim_summary(reports: DataFrame) -> DataFrame:
    """Retained and adapter rates of each library's trimming report."""

    raw = F.col("reads_raw")
    return reports.select(
        "sample", "reads_raw", "reads_cleaned",
        half_even(ratio(F.col("reads_cleaned"), raw), 5).alias("reads_retained"),
        "reads_with_adapter", half_even(ratio(F.col("reads_with_adapter"), raw), 5)
        .alias("adapter_rate"), "basepairs_raw", "basepairs_cleaned").orderBy("sample")


def refused_trimming(summary: DataFrame, expected: DataFrame,
                     minimum_rate: float = MINIMUM_ADAPTER_RATE) -> DataFrame:
    """Expected libraries whose adapter was found in too few reads; must be empty."""

    return summary.join(expected.select("sample").distinct(), "sample", "left_semi").where(
        F.col("reads_with_adapter") < minimum_rate * F.col("reads_raw")
    ).select("sample", "adapter_rate")


def alignment_summary(log_lines: DataFrame) -> DataFrame:
    """Aligner log lines `(sample, value)` to one row of metrics per library."""

    parts = F.split("value", r"\|", 2)
    label, value = F.trim(parts[0]), F.regexp_replace(F.trim(F.get(parts, F.lit(1))), "%+$", "")
    lines = log_lines.select("sample", label.alias("label"),
                             F.trim(F.regexp_replace(value, r"\s", "")).try_cast("double")
                             .alias("number")).where(F.col("label").isin(*ALIGNER_FIELDS))
    wide = lines.groupBy("sample").agg(*[
        F.max(F.when(F.col("label") == text, F.col("number"))).alias(name)
        for text, name in ALIGNER_FIELDS.items()])
    mapped = [F.coalesce(c, F.lit(0.0)) for c in (
        "unique_rate", "multimapped_rate", "over_multimapped_rate")]
    counts = {c: F.col(c).cast("bigint") for c in ("reads_input", "reads_unique")}
    return wide.withColumns(counts).withColumn(
        "mapped_rate", half_even(mapped[0] + mapped[1] + mapped[2], 2))


def course_qc(runs: DataFrame, stats: DataFrame, trimming: DataFrame, dataset: str) -> DataFrame:
    """One row per transcriptome library: trimming beside prefix means of the QC statistics.

    `stats` rows are named `<library>_<part>`; the part after the last underscore is dropped once
    and the means are joined, so no run is compared with every row. A library without trimming or
    without statistics of either read set is an error.
    """

    wanted = runs.where((F.col("dataset") == dataset) & (F.col("assay") == "rnaseq"))
    names = wanted.select(F.explode(F.array("sample", "run_accession")).alias("prefix")).distinct()
    cuts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(F.split("Sample", "_")) - 1, F.lit(1))),
        lambda k: F.array_join(F.slice(F.split("Sample", "_"), F.lit(1), k), "_"))
    keyed = stats.select("*", F.explode(F.array_distinct(cuts)).alias("prefix")).where(
        F.length("prefix") < F.length("Sample"))
    means = keyed.join(names, "prefix", "left_semi").groupBy("prefix").agg(
        F.avg("percent_gc").alias("gc"), F.avg("percent_duplicates").alias("duplicates"))

    def side(key: str, tag: str) -> DataFrame:
        return means.select(F.col("prefix").alias(key), F.col("gc").alias(f"gc_{tag}_percent"),
                            F.col("duplicates").alias(f"duplicates_{tag}_percent"))

    joined = (wanted.select("sample", "run_accession").join(
        trimming.withColumn("_trimmed", F.lit(True)), "sample", "left")
              .join(side("run_accession", "raw").withColumn("_raw", F.lit(True)),
                    "run_accession", "left")
              .join(side("sample", "cleaned").withColumn("_cleaned", F.lit(True)),
                    "sample", "left"))
    lacking = F.col("_trimmed").isNull() | F.col("_raw").isNull() | F.col("_cleaned").isNull()
    return joined.select(
        F.when(lacking, F.raise_error(F.concat(F.lit("no trimming or statistics for "), "sample")))
        .otherwise(F.col("sample")).alias("sample"), "run_accession", "reads_raw", "reads_cleaned",
        half_even(100 * F.col("reads_retained"), 3).alias("reads_retained_percent"),
        half_even(100 * F.col("adapter_rate"), 3).alias("adapter_percent"),
        *[half_even(F.col(c), 3).alias(c) for c in (
            "gc_raw_percent", "gc_cleaned_percent", "duplicates_raw_percent",
            "duplicates_cleaned_percent")])
