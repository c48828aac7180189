"""From footprint alignments to length-stratified counts, and from counts to library ratios."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.functions.fixed import (
    CDS_FRAMES,
    CDS_FROM_START_NT,
    CDS_FROM_STOP_NT,
    COUNT_COLUMNS,
    EXTENSION_FRAMES,
    MINIMUM_CDS_PSITES,
    MINIMUM_FRAME0_SHARE,
    MINIMUM_LENGTH_SHARE,
    MINIMUM_PSITES,
    MINIMUM_UTR3_LENGTH,
    OFFSET_FROM_5,
    PROGRAMMED_READTHROUGH,
    SURVEY_LENGTHS,
    TERMINATION_FROM_STOP_NT,
)
from stopscan.functions.scalars import half_even, met, ratio
from stopscan.operators.ranking import quantiles
from stopscan.session import cut_lineage, within


OFFSET_ROWS = 100_000


def primary_footprints(alignments: DataFrame,
                       lengths: tuple[int, int] = SURVEY_LENGTHS) -> DataFrame:
    """Primary alignments of a kept length; secondary ones carry flag 256."""

    return alignments.where(
        (F.col("flag").bitwiseAND(256) == 0) & F.col("length").between(*lengths))


def assign_psites(reads: DataFrame, offsets: DataFrame, annotation: DataFrame) -> DataFrame:
    """Each read's P-site: its length's offset applied, distances to both codons, and region.

    `offsets` holds one row per library and length. They are counted, and up to `OFFSET_ROWS` of
    them travel to the reads, which would otherwise be shuffled on a few dozen keys; more of them
    are spread enough to shuffle. A transcript with a large share of the reads is a skewed
    equi-join on the read side.
    """

    known = offsets.select("sample", "length", "corrected_offset_from_5")
    joined = reads.join(
        F.broadcast(known) if within(known, OFFSET_ROWS) else known, ["sample", "length"]
    ).join(annotation.select("transcript", "l_utr5", "l_cds", "l_utr3"), "transcript")
    psite = F.col("end5") + F.col("corrected_offset_from_5")
    from_start = F.col("psite") - F.col("l_utr5") - 1
    from_stop = F.col("psite") - F.col("l_utr5") - F.col("l_cds")
    region = (F.when(F.col("l_cds") <= 0, F.lit(None).cast("string"))
              .when(F.col("psite_from_start") < 0, "5utr")
              .when(F.col("psite_from_stop") > 0, "3utr").otherwise("cds"))
    return (joined.withColumn("psite", psite)
            .withColumn("psite_from_start", from_start).withColumn("psite_from_stop", from_stop)
            .withColumn("psite_region", region))


def internal_cds() -> Column:
    """Coding sequence without its initiation and termination peaks."""

    return met((F.col("psite_region") == "cds")
               & (F.col("psite_from_start") >= CDS_FROM_START_NT)
               & (F.col("psite_from_stop") <= CDS_FROM_STOP_NT))


def at_termination() -> Column:
    return met(F.col("psite_from_stop").between(TERMINATION_FROM_STOP_NT, 0))


def past_stop() -> Column:
    """Strictly between the native stop and the next one in frame."""

    return met((F.col("psite_from_stop") >= 1)
               & (F.col("psite_from_stop") <= F.col("extension") - 3))


def _frame(k: int) -> Column:
    return F.pmod("psite_from_start", F.lit(3)) == k


def readthrough_counts(psites: DataFrame, extensions: DataFrame) -> DataFrame:
    """Coding, termination and extension counts per library, transcript and length.

    Rows with no count at all are left out.
    """

    joined = psites.join(extensions.select("transcript", "extension"), "transcript", "left")
    counted = joined.groupBy("sample", "transcript", "length").agg(
        *[F.count_if(internal_cds() & _frame(k)).alias(CDS_FRAMES[k]) for k in range(3)],
        F.count_if(at_termination()).alias("termination"),
        F.first("extension").alias("extension"),
        *[F.count_if(past_stop() & _frame(k)).alias(EXTENSION_FRAMES[k]) for k in range(3)],
        F.first("l_cds").alias("l_cds"), F.first("l_utr3").alias("l_utr3"))
    total = sum((F.col(c) for c in CDS_FRAMES[1:]), F.col(CDS_FRAMES[0]))
    return counted.withColumn("cds_total", total).where(
        F.greatest("cds_total", "termination", *EXTENSION_FRAMES) > 0)


def frame_counts(psites: DataFrame) -> DataFrame:
    """Internal coding P-sites per library, length and frame."""

    return psites.where(internal_cds()).groupBy(
        "sample", "length", F.pmod("psite_from_start", F.lit(3)).alias("frame")
    ).agg(F.count(F.lit(1)).alias("n"))


def codon_counts(psites: DataFrame) -> DataFrame:
    """In-frame coding P-sites per library, transcript, length and codon index."""

    return psites.where((F.col("psite_region") == "cds") & _frame(0)).groupBy(
        "sample", "transcript", "length",
        F.floor(F.col("psite_from_start") / 3).cast("int").alias("codon_index"),
    ).agg(F.count(F.lit(1)).alias("n"))


def share_of(df: DataFrame, keys: Sequence[str], measure: str, into: str) -> DataFrame:
    """Each row's share of its group's total, by an aggregate joined back."""

    totals = df.groupBy(*keys).agg(F.sum(measure).alias("_total"))
    return df.join(totals, list(keys)).withColumn(
        into, ratio(F.col(measure), F.col("_total"))).drop("_total")


def region_fractions(psites: DataFrame) -> DataFrame:
    counted = psites.groupBy("sample", F.col("psite_region").alias("region")).agg(
        F.count(F.lit(1)).alias("n"))
    return share_of(counted, ["sample"], "n", "fraction")


def frame_fractions(frames: DataFrame) -> DataFrame:
    """Frame shares per library over all lengths."""

    return share_of(frames.groupBy("sample", "frame").agg(F.sum("n").alias("n")),
                    ["sample"], "n", "fraction")


def dominant_offsets(offsets: DataFrame) -> DataFrame:
    """The most used length of each library, ties to the shortest, with both its offsets."""

    return offsets.groupBy("sample").agg(F.min_by(
        F.struct("length", "corrected_offset_from_5", "corrected_offset_from_3"),
        F.struct(-F.col("total_percentage"), "length")).alias("d")
    ).select("sample", F.col("d.length").alias("dominant_length"),
             F.col("d.corrected_offset_from_5").alias("offset_from_5"),
             F.col("d.corrected_offset_from_3").alias("offset_from_3"))


def offset_shift_check(psites: DataFrame, offsets: DataFrame) -> DataFrame:
    """Frame-0 share of the dominant length's coding P-sites at shifts -2..2."""

    dominant = dominant_offsets(offsets).select(
        "sample", F.col("dominant_length").alias("length"))
    rows = psites.where("psite_region = 'cds'").join(dominant, ["sample", "length"])
    shifts = range(-2, 3)
    counted = rows.groupBy("sample", "length").agg(*[
        F.avg((F.pmod(F.col("psite_from_start") + k, F.lit(3)) == 0).cast("double"))
        .alias(f"s{k + 2}") for k in shifts])
    return counted.select("sample", "length", F.inline(F.array(*[
        F.struct(F.lit(k).alias("shift"), F.col(f"s{k + 2}").alias("frame0")) for k in shifts])))


def metaprofile(psites: DataFrame, utr5: int = 25, cds: int = 50, utr3: int = 25) -> DataFrame:
    """P-sites by distance around the start and the stop codon, every distance listed."""

    start = F.when(F.col("psite_from_start").between(-utr5, cds - 1), F.struct(
        F.lit("Distance from start (nt)").alias("region"),
        F.col("psite_from_start").cast("int").alias("distance")))
    stop = F.when(F.col("psite_from_stop").between(-(cds - 1), utr3), F.struct(
        F.lit("Distance from stop (nt)").alias("region"),
        F.col("psite_from_stop").cast("int").alias("distance")))
    counted = psites.select("sample", F.inline(F.array_compact(F.array(start, stop)))).groupBy(
        "sample", "region", "distance").agg(F.count(F.lit(1)).alias("n"))
    around = F.array(
        F.struct(F.lit("Distance from start (nt)").alias("region"),
                 F.sequence(F.lit(-utr5), F.lit(cds - 1)).alias("at")),
        F.struct(F.lit("Distance from stop (nt)").alias("region"),
                 F.sequence(F.lit(-(cds - 1)), F.lit(utr3)).alias("at")))
    grid = psites.select("sample").distinct().select("sample", F.inline(around)).select(
        "sample", "region", F.explode("at").alias("distance"))
    return grid.join(counted, ["sample", "region", "distance"], "left").select(
        "sample", "region", "distance", F.coalesce("n", F.lit(0)).alias("count"))


def calibration_summary(offsets: DataFrame, frames: DataFrame) -> DataFrame:
    """Dominant length, both offsets and the frame-0 share of each library."""

    share = frame_fractions(frames).where("frame = 0").select(
        "sample", half_even(F.col("fraction"), 3).alias("cds_frame0"))
    return dominant_offsets(offsets).join(share, "sample")


# --- Length selection ---------------------------------------------------------------------------

def _frames_wide(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    counted = frames.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(F.col("frame") == k, F.col("n"))), F.lit(0)).alias(f"frame{k}")
        for k in range(3)])
    return counted.withColumn("total", F.col("frame0") + F.col("frame1") + F.col("frame2"))


def periodic_lengths(frames: DataFrame) -> DataFrame:
    """Lengths of each library where frame 0 beats both others at a share of at least 1 %."""

    wide = share_of(_frames_wide(frames, ["sample", "length"]), ["sample"], "total", "share")
    return wide.where(
        (F.col("frame0") > F.col("frame1")) & (F.col("frame0") > F.col("frame2"))
        & (F.col("share") >= MINIMUM_LENGTH_SHARE)).select("sample", "length")


def shared_lengths(frames: DataFrame) -> DataFrame:
    """The lengths periodic in every library."""

    libraries = frames.agg(F.count_distinct("sample")).scalar()
    return periodic_lengths(frames).groupBy("length").agg(
        F.count_distinct("sample").alias("libraries")).where(
        F.col("libraries") == libraries).select("length")


def library_verdicts(frames: DataFrame, offsets: DataFrame,
                     minimum_psites: int = MINIMUM_PSITES) -> DataFrame:
    """Each library judged on the shared lengths: P-sites, frame-0 share and 5' offset."""

    lengths = shared_lengths(frames).withColumn("kept", F.lit(True))
    kept = frames.join(lengths, "length", "left").groupBy("sample").agg(
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("n"))), F.lit(0)).alias("psites"),
        F.coalesce(F.sum(F.when(F.col("kept") & (F.col("frame") == 0), F.col("n"))), F.lit(0))
        .alias("frame0"),
        F.coalesce(F.bool_or("kept"), F.lit(False)).alias("any_length"))
    judged = kept.join(dominant_offsets(offsets), "sample", "left").select(
        "sample", "psites", "any_length",
        F.coalesce(ratio(F.col("frame0"), F.col("psites")), F.lit(0.0)).alias("frame0_share"),
        F.coalesce("dominant_length", F.lit(0)).alias("dominant_length"),
        F.coalesce("offset_from_5", F.lit(0)).alias("offset_from_5"))
    checks = {
        "no_shared_length": lengths.agg(F.count(F.lit(1))).scalar() == 0,
        "psites": F.col("psites") < minimum_psites,
        "frame0_share": F.col("frame0_share") < MINIMUM_FRAME0_SHARE,
        "offset": ~F.col("offset_from_5").between(*OFFSET_FROM_5)}
    failures = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return (judged.withColumn("failures", F.array_join(failures, ";"))
            .withColumn("passes", F.col("failures") == "").drop("any_length"))


def failure_kind() -> Column:
    """Whether a library's failure is one an interval can represent."""

    return (F.when(F.col("passes"), "none")
            .when(~F.col("offset_from_5").between(*OFFSET_FROM_5), "validity")
            .when(F.col("frame0_share") < MINIMUM_FRAME0_SHARE, "validity")
            .otherwise("precision"))


def manifest(dataset: str, frames: DataFrame, offsets: DataFrame,
             minimum_psites: int = MINIMUM_PSITES) -> DataFrame:
    """The calibration manifest as one JSON row; libraries and lengths are tens of rows."""

    judged = library_verdicts(frames, offsets, minimum_psites)
    libraries = judged.agg(
        F.sort_array(F.collect_list(F.struct(
            "sample", "psites", half_even(F.col("frame0_share"), 5).alias("frame0_share"),
            "dominant_length", "offset_from_5", "failures", "passes"))).alias("libraries"),
        F.bool_and("passes").alias("all_pass"))
    lengths = shared_lengths(frames).agg(F.sort_array(F.collect_list("length")))
    return libraries.select(
        F.lit(dataset).alias("dataset"), lengths.scalar().alias("lengths"), "libraries", "all_pass"
    ).select(F.to_json(F.struct(
        "dataset", "lengths", F.array(*[F.lit(x) for x in SURVEY_LENGTHS]).alias("surveyed"),
        "libraries", ((F.size("lengths") > 0) & F.col("all_pass")).alias("passes")),
        {"ignoreNullFields": "false"}).alias("manifest"))


def manifest_gate(verdicts: DataFrame, wanted: str, dataset: Column | str) -> DataFrame:
    """Rows that refuse an analysis: a failing library, or a manifest of another dataset."""

    named = F.lit(dataset) if isinstance(dataset, str) else dataset
    return verdicts.where(~F.col("passes") | (named != wanted)).select("sample", "failures")


def frame_by_length(frames: DataFrame, kept: Collection[int]) -> DataFrame:
    """Frame counts, frame-0 share and library share of each length, and whether it was kept."""

    wide = _frames_wide(frames, ["length"])
    total = wide.agg(F.sum("total")).scalar()
    return wide.select(
        "length", "frame0", "frame1", "frame2",
        half_even(ratio(F.col("frame0"), F.col("total"))).alias("frame0_share"),
        half_even(ratio(F.col("total"), total)).alias("library_share"),
        F.col("length").isin(*kept).alias("kept"))


# --- Counts to ratios ---------------------------------------------------------------------------

def collapse_lengths(counts: DataFrame, lengths: DataFrame | Collection[int]) -> DataFrame:
    """Sum a length-stratified table over the lengths kept; refused when none is left."""

    if "length" not in counts.columns:
        raise ValueError("collapse_lengths needs a `length` column to sum over")
    if isinstance(lengths, DataFrame):
        kept = counts.join(lengths.select("length").distinct(), "length", "left_semi")
    else:
        kept = counts.where(F.col("length").isin(*lengths))
    return kept.groupBy("transcript", "sample").agg(
        *[F.first(c).alias(c) for c in ("extension", "l_cds", "l_utr3")],
        *[F.sum(c).alias(c) for c in COUNT_COLUMNS])


def qualifying(counts: DataFrame, genes: DataFrame | None = None,
               excluded: DataFrame | None = None, samples: DataFrame | None = None,
               minimum_cds: int = MINIMUM_CDS_PSITES,
               minimum_utr3: int = MINIMUM_UTR3_LENGTH) -> DataFrame:
    """Rows of the transcripts that pass in every library asked for.

    The universe is one set of transcripts for all libraries. `samples` narrows the table first,
    and it is the number asked for that must be reached, not the number present.
    """

    asked = counts if samples is None else samples
    libraries = asked.agg(F.count_distinct("sample")).scalar()
    if samples is not None:
        counts = counts.join(samples.select("sample").distinct(), "sample", "left_semi")
    passing = counts.where(
        (F.col("l_utr3") >= minimum_utr3) & (F.col("cds_frame0") >= minimum_cds)
        & F.col("extension").isNotNull())
    if genes is not None:
        programmed = genes.where(F.col("gene").isin(*PROGRAMMED_READTHROUGH)).select("transcript")
        excluded = programmed if excluded is None else excluded.select("transcript").union(
            programmed)
    if excluded is not None:
        passing = passing.join(excluded.select("transcript").distinct(), "transcript", "left_anti")
    everywhere = passing.groupBy("transcript").agg(
        F.count_distinct("sample").alias("libraries")).where(F.col("libraries") == libraries)
    return passing.join(everywhere.select("transcript"), "transcript", "left_semi")


def library_ratios(counts: DataFrame) -> DataFrame:
    """Per library: pooled sums, then ratios and frame shares; the median ratio kept beside them."""

    downstream = sum((F.col(c) for c in EXTENSION_FRAMES[1:]), F.col(EXTENSION_FRAMES[0]))
    # Written once: the pooled sums and the median are two passes over the qualifying rows.
    rows = cut_lineage(counts.select(
        "sample", *CDS_FRAMES, *EXTENSION_FRAMES, "termination",
        ratio(F.col("extension_frame0"), F.col("cds_frame0")).alias("_ratio")))
    pooled = rows.groupBy("sample").agg(
        F.count(F.lit(1)).alias("transcripts"),
        F.avg((downstream > 0).cast("double")).alias("with_downstream"),
        *[F.sum(c).alias(c) for c in (*CDS_FRAMES, *EXTENSION_FRAMES, "termination")])
    cds = F.col("cds_frame0")
    total = sum((F.col(c) for c in CDS_FRAMES[1:]), cds)
    share, coding = ratio(F.col("extension_frame0"), downstream), ratio(cds, total)
    median = quantiles(rows.select("sample", "_ratio"), ["sample"], "_ratio",
                       {"median_readthrough": 0.5})
    return pooled.join(median, "sample", "left").select(
        "sample", "transcripts", "with_downstream", cds.alias("cds_frame0_total"),
        downstream.alias("downstream_total"), F.col("termination").alias("termination_total"),
        ratio(F.col("extension_frame0"), cds).alias("downstream_occupancy"),
        ratio(F.col("termination"), cds).alias("termination_occupancy"),
        share.alias("downstream_share0"), coding.alias("cds_share0"),
        (share - coding).alias("frame_gap"), "median_readthrough")
