"""Codon occupancy: how long ribosomes sit on each codon, abundance cancelled per transcript."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopscan.functions.fixed import (
    CDS_FROM_STOP_NT,
    FIRST_SCORABLE_CODON,
    MINIMUM_CDS_PSITES,
    MINIMUM_SCORABLE_CODONS,
    SENSE_CODONS,
    SITE_SHIFT,
)
from stopscan.functions.nucleotides import codons_of, residue
from stopscan.functions.scalars import ratio
from stopscan.operators.effects import treated_libraries
from stopscan.operators.ranking import quantiles
from stopscan.session import cut_lineage, refuse


def scorable_windows(annotation: DataFrame, sequences: DataFrame) -> DataFrame:
    """(transcript, codons): upper-case codons from FIRST_SCORABLE_CODON to the last one that ends
    CDS_FROM_STOP_NT or more before the stop; transcripts without a coding part give no row.
    """

    named = sequences.select(F.col("accession").alias("transcript"), "sequence")
    joined = annotation.where("l_cds > 0").join(named.hint("merge"), "transcript")
    last = F.floor((F.col("l_cds") - 1 + CDS_FROM_STOP_NT) / 3).cast("int")
    width = (last - FIRST_SCORABLE_CODON + 1) * 3
    window = F.upper(F.substring(
        "sequence", F.col("l_utr5") + 3 * FIRST_SCORABLE_CODON + 1, width))
    return joined.where(last >= FIRST_SCORABLE_CODON).select(
        "transcript", window.alias("window")
    ).select("transcript", F.left("window", F.length("window") - F.length("window") % 3)
             .alias("codons"))


def library_table(counts: DataFrame, windows: DataFrame, site: str = "a",
                  lengths: Collection[int] | None = None,
                  minimum_psites: int = MINIMUM_CDS_PSITES,
                  minimum_codons: int = MINIMUM_SCORABLE_CODONS) -> DataFrame:
    """Codon occupancy of every library in `counts`: 61 rows per library.

    A position's count is divided by its transcript's mean over all scorable positions, and a
    codon's score is the mean over all its positions, those without reads included.
    """

    if site not in SITE_SHIFT:
        raise ValueError(f"no shift is known for site {site!r}; known: {', '.join(SITE_SHIFT)}")
    if lengths is not None:
        counts = counts.where(F.col("length").isin(*lengths))
    positions = (F.length("codons") / 3).cast("int")
    window = windows.select("transcript", "codons", positions.alias("positions"))
    scored = counts.groupBy("sample", "transcript", (
        F.col("codon_index") + SITE_SHIFT[site]).alias("index")).agg(F.sum("n").alias("n"))
    inside = scored.join(window.hint("merge"), "transcript").where(
        F.col("index").between(F.lit(FIRST_SCORABLE_CODON),
                               F.col("positions") + FIRST_SCORABLE_CODON - 1))
    at = (F.col("index") - FIRST_SCORABLE_CODON) * 3 + 1
    read = inside.select("sample", "transcript", "positions", "n",
                         F.substring("codons", at, F.lit(3)).alias("codon"))
    per_codon = read.groupBy("sample", "transcript", "positions", "codon").agg(
        F.sum("n").alias("n"))
    # At most 64 codons of one transcript meet in a window.
    psites = F.sum("n").over(Window.partitionBy("sample", "transcript"))
    rated = per_codon.withColumn("psites", psites).where(
        (F.col("psites") >= minimum_psites) & (F.col("positions") >= minimum_codons))
    # Written once: the scores, the positions available and the transcript counts all read it.
    kept_codons = cut_lineage(rated.select(
        "sample", "transcript", "codon",
        (F.col("n") * F.col("positions") / F.col("psites")).alias("normalised")))
    kept = kept_codons.select("sample", "transcript").distinct()
    observed = kept_codons.groupBy("sample", "codon").agg(F.sum("normalised").alias("psites"))
    # Transcripts kept in the same libraries are counted together, so that a task holds one count
    # per codon of such a set and not one per codon of a transcript.
    together = kept.groupBy("transcript").agg(
        F.sort_array(F.collect_set("sample")).alias("samples"))
    available = window.select("transcript", "codons").hint("merge").join(
        together, "transcript").select(
        "samples", F.explode(codons_of(F.col("codons"))).alias("codon")).groupBy(
        "samples", "codon").agg(F.count(F.lit(1)).alias("held")).select(
        "codon", "held", F.explode("samples").alias("sample")).groupBy("sample", "codon").agg(
        F.sum("held").alias("positions"))
    libraries = kept.groupBy("sample").agg(F.count(F.lit(1)).alias("transcripts"))
    grid = libraries.select("sample", "transcripts", F.explode(
        F.lit(list(SENSE_CODONS))).alias("codon"))
    joined = grid.join(available, ["sample", "codon"], "left").join(
        observed, ["sample", "codon"], "left")
    held = F.coalesce("positions", F.lit(0)).cast("bigint")
    return joined.select(
        "sample", "codon", residue(F.col("codon")).alias("amino_acid"), F.lit(site).alias("site"),
        ratio(F.coalesce("psites", F.lit(0.0)), held).alias("occupancy"),
        held.alias("positions"), "transcripts")


def aggregate_libraries(tables: DataFrame) -> DataFrame:
    """Library tables averaged per codon and site, with the sample deviation over libraries."""

    return tables.groupBy("codon", "amino_acid", "site").agg(
        F.avg("occupancy").alias("occupancy"), F.stddev_samp("occupancy").alias("occupancy_sd"),
        F.min("positions").alias("positions"), F.count(F.lit(1)).alias("libraries"))


def control_table(counts: DataFrame, arms: DataFrame, control: str, windows: DataFrame,
                  site: str = "a", **floors) -> DataFrame:
    """The codon table of control libraries, as a feature that may predict response to a treatment.

    Built from a treated library it would be circular: a library that `arms` does not name, or names
    under another treatment, is an error, found before any codon is counted.
    """

    refuse(treated_libraries(counts, arms, control), "not control libraries, so no codon feature")
    return aggregate_libraries(library_table(counts, windows, site, **floors))


def extremes(table: DataFrame, n: int = 5) -> DataFrame:
    """The slowest and fastest codons; the table has 61 rows per site."""

    filled = table.where(F.col("occupancy").isNotNull())
    slow = filled.orderBy(F.desc("occupancy"), "codon").limit(n).withColumn(
        "end", F.lit("slowest"))
    fast = filled.orderBy("occupancy", "codon").limit(n).withColumn("end", F.lit("fastest"))
    return slow.unionByName(fast).select("end", "codon", "amino_acid", "occupancy")


def relative_spread(table: DataFrame) -> DataFrame:
    """Median spread between libraries as a share of the score."""

    return quantiles(table.withColumn("_s", F.try_divide("occupancy_sd", "occupancy")), [],
                     "_s", {"median_spread": 0.5})


def residue_occupancy(table: DataFrame) -> DataFrame:
    """Mean occupancy per residue in each site, with how many codons it has in the A site."""

    def site(name: str):
        return F.avg(F.when(F.col("site") == name, F.coalesce("occupancy", F.lit(0.0))))

    return table.groupBy("amino_acid").agg(
        F.coalesce(site("a"), F.lit(0.0)).alias("a"), F.coalesce(site("p"), F.lit(0.0)).alias("p"),
        F.count_if(F.col("site") == "a").alias("codons")).orderBy(F.desc("a"), "amino_acid")
