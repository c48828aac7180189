"""Result tables shaped for readers: nested rows, summaries and a compact columnar index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.functions.fixed import (
    ABSENT,
    METAPROFILE_REGIONS,
    QUADRANTS,
    QUANTITIES,
    SCALE_READTHROUGH,
    SCALE_TOLERANCE,
)
from stopscan.functions.nucleotides import as_dna, as_rna, is_stop
from stopscan.functions.scalars import (
    half_even,
    lookup,
    met,
    scaled,
    stop_code,
    therapy_name,
)
from stopscan.operators.native_stops import concordance
from stopscan.operators.ranking import first_by, first_seen_codes
from stopscan.session import cut_lineage

JSON_OPTIONS = {"ignoreNullFields": "false"}


def as_json(struct: Column) -> Column:
    """JSON with nulls written out; callers pass NaN through `half_even`, which makes it null."""

    return F.to_json(struct, JSON_OPTIONS)


def refuse_nan(df: DataFrame) -> DataFrame:
    """The table itself, with an error raised on the first row holding a NaN or infinity."""

    floats = [c for c, kind in df.dtypes if kind in ("double", "float")]
    bad = F.lit(False)
    for c in floats:
        bad = bad | met(F.isnan(c) | (F.abs(c) == float("inf")))
    first = df.columns[0]
    kind = dict(df.dtypes)[first]
    guarded = F.when(bad, F.raise_error(F.lit("a payload may not hold NaN or infinity"))
                     .cast(kind)).otherwise(F.col(first))
    return df.withColumn(first, guarded)


def suppressor(stop: Column, residue: Column) -> Column:
    """The design that restores a residue at a stop; null for an unknown stop or residue."""

    known = is_stop(as_dna(stop)) & (F.length(residue) == 1)
    return F.when(known, F.struct(
        F.concat(F.upper(as_rna(stop)), F.lit("-"), residue).alias("design"),
        F.lit(True).alias("restores_exactly")))


def web_rows(landscape: DataFrame, scores: DataFrame, decay: DataFrame | None = None,
             tool: DataFrame | None = None, efficiency: DataFrame | None = None,
             editing: DataFrame | None = None, variants: DataFrame | None = None) -> DataFrame:
    """One nested row per variant: its layers joined, a layer that has nothing left null.

    `variants` narrows the output. A variant's therapies are at most the therapies scored.
    """

    if variants is not None:
        landscape = landscape.join(variants.select("variant_id").distinct(), "variant_id",
                                   "left_semi")
    present = F.col("status") == "present"
    arms = scores.groupBy("variant_id").agg(F.sort_array(F.collect_set(F.struct(
        F.col("therapy_id").alias("id"), therapy_name(F.col("therapy_id")).alias("name"),
        present.alias("available"),
        *[F.when(present, half_even(F.col(c), 5)).alias(n) for n, c in (
            ("readthrough", "readthrough_predicted"), ("low", "readthrough_low"),
            ("high", "readthrough_high"))],
        F.when(~present, F.col("reason")).alias("reason")))).alias("therapies"))
    joined = landscape.join(arms, "variant_id", "left")
    nmd = F.lit(None)
    if decay is not None:
        joined = joined.join(decay.select("variant_id", F.struct(
            "escape_guideline", "escape_full_rules",
            F.col("predictors_disagree").alias("disagree"), F.struct(
                F.col("rule_last_exon").alias("last_exon"),
                F.col("rule_within_last_junction").alias("within_last_junction"),
                F.col("rule_start_proximal").alias("start_proximal"),
                F.col("rule_long_exon").alias("long_exon")).alias("rules")).alias("_rules")),
            "variant_id", "left")
        outside = []
        if tool is not None:
            joined = joined.join(tool.select("variant_id", F.struct(
                F.col("aenmd_available").alias("available"),
                F.col("aenmd_escape").alias("escape"),
                F.when(F.col("aenmd_available"), "").otherwise(F.col("reason")).alias("reason"))
                .alias("_tool")), "variant_id", "left")
            outside.append(F.col("_tool").alias("aenmd"))
        if efficiency is not None:
            ok = met(F.col("nmd_available"))
            joined = joined.join(efficiency.select("variant_id", F.struct(
                ok.alias("available"),
                F.when(ok, half_even(F.col("nmd_efficiency"), 4)).alias("efficiency"),
                F.when(ok, "").otherwise(F.col("reason")).alias("reason")).alias("_deep")),
                "variant_id", "left")
            outside.append(F.col("_deep").alias("nmdetective"))
        nmd = F.when(F.col("_rules").isNotNull(), F.struct("_rules.*", *outside))
    edit = F.lit(None)
    if editing is not None:
        joined = joined.join(editing.where("scoreable").select("variant_id", F.struct(
            "reach_class", "reachable", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in (
                "editor", "strand", "restores")], "window_position", "bystander_free",
            F.coalesce("n_guides", F.lit(0)).alias("candidate_guides")).alias("_edit")),
            "variant_id", "left")
        edit = F.col("_edit")
    best = F.when(F.col("best_readthrough").isNotNull(), F.struct(
        F.col("best_therapy").alias("therapy"),
        half_even(F.col("best_readthrough"), 5).alias("readthrough"),
        half_even(F.col("best_readthrough_low"), 5).alias("low")))
    return joined.select(
        F.col("variant_id").alias("id"), F.col("gene_symbol").alias("gene"), "protein_position",
        F.upper(as_rna(F.col("stop_type"))).alias("stop"), F.col("original_aa").alias("residue"),
        "review_stars", F.col("escapes_decay_by_rule").alias("escapes_decay"),
        half_even(F.col("tolerable_insertion_share"), 3).alias("tolerable_insertion_share"),
        best.alias("best"), F.coalesce("therapies", F.array().cast(
            arms.schema["therapies"].dataType)).alias("therapies"),
        suppressor(F.col("stop_type"), F.col("original_aa")).alias("suppressor"),
        nmd.alias("nmd"), edit.alias("editing"))


def diverse_sample(landscape: DataFrame, scores: DataFrame, order: str = "ordinal",
                   size: int = 48, each: int = 6) -> DataFrame:
    """Variant ids that show every state: a missing therapy, extremes of four measures, blocked
    ones; then filled in table order to `size`.

    Each slice is a top-k of `each` rows; a variant keeps its earliest slice.
    """

    gone = scores.where(F.col("status") != "present").groupBy("variant_id").agg(
        F.min("ordinal").alias("_o")).orderBy("_o", "variant_id").limit(each)
    slices = [gone.select("variant_id", F.col("_o").cast("double").alias("within"))]
    for column, ascending in (("tolerable_insertion_share", True),
                              ("tolerable_insertion_share", False),
                              ("best_readthrough", False), ("best_readthrough_low", True)):
        key = F.col(column) if ascending else -F.col(column)
        slices.append(landscape.select("variant_id", key.alias("within"), F.col(order).alias("_t"))
                      .orderBy(F.asc_nulls_last("within"), "_t").limit(each)
                      .drop("_t"))
    slices.append(landscape.where(~F.col("escapes_decay_by_rule")).select(
        "variant_id", F.col(order).cast("double").alias("within")).orderBy("within").limit(each))
    wanted = None
    for priority, part in enumerate(slices):
        tagged = part.select("variant_id", F.lit(priority).alias("priority"))
        wanted = tagged if wanted is None else wanted.unionByName(tagged)
    kept = wanted.groupBy("variant_id").agg(F.min("priority").alias("priority"))
    rest = landscape.join(kept, "variant_id", "left_anti").orderBy(order).limit(size).select(
        "variant_id", F.lit(len(slices)).alias("priority"), F.col(order).alias("_t"))
    named = kept.withColumn("_t", F.lit(0).cast(dict(landscape.dtypes)[order]))
    return named.unionByName(rest).orderBy("priority", "_t", "variant_id").limit(
        size).drop("_t")


def safety_summary(labelled: DataFrame, predicted: str, measured: str, identity: str,
                   draws: int = 1000) -> DataFrame:
    """Canonical stops scored and analysed, the four groups with empty ones kept, concordance."""

    selected = labelled.where("mane_select")
    matched = selected.where(F.col(predicted).isNotNull() & F.col(measured).isNotNull())
    rank = concordance(matched, predicted, measured, identity, draws)
    usable = F.col(predicted).isNotNull() & F.col(measured).isNotNull()
    return selected.agg(
        F.count(F.lit(1)).alias("canonical_stops_scored"), F.count_if(usable).alias("analysed"),
        *[F.count_if(usable & (F.col("group") == q)).alias(q.replace(" ", "_"))
          for q in QUADRANTS]
    ).select("*", *[rank.select(c).scalar().alias(c) for c in ("rho", "low", "high")])


def sampled_points(df: DataFrame, identity: str, limit: int = 2000, seed: int = 0) -> DataFrame:
    """A fixed sample of rows for a page: the first `limit` by a hash of their id."""

    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(identity).cast("string")))
    return df.orderBy(digest, identity).limit(limit)


def safety_points(labelled: DataFrame, predicted: str, measured: str, identity: str,
                  limit: int = 2000) -> DataFrame:
    matched = labelled.where(F.col("mane_select") & F.col(predicted).isNotNull()
                             & F.col(measured).isNotNull())
    return sampled_points(matched, identity, limit).select(
        identity, half_even(F.col(predicted)).alias("predicted"),
        half_even(F.col(measured)).alias("measured"), "group")


def periodicity(profile: DataFrame, arms: DataFrame) -> DataFrame:
    """Mean scaled count and libraries by region, arm and distance; unknown regions dropped."""

    region = lookup(METAPROFILE_REGIONS, F.col("region"))
    labelled = profile.join(arms.select("sample", "treatment"), "sample", "left").withColumn(
        "region", region).where(F.col("region").isNotNull() & F.col("treatment").isNotNull())
    return labelled.groupBy("region", "treatment", "distance").agg(
        half_even(F.avg("scaled_count"), 8).alias("scaled"),
        F.count_distinct("sample").alias("libraries"))


def contrast_libraries(libraries: DataFrame, arms: DataFrame) -> DataFrame:
    """Per-library values of a contrast; arms are joined only where the table lacks them."""

    labelled = (libraries if "treatment" in libraries.columns
                else libraries.join(arms.select("sample", "treatment"), "sample", "left"))
    return labelled.select("sample", "treatment", "transcripts",
                           *[half_even(F.col(q)).alias(q) for q in QUANTITIES
                             if q in labelled.columns])


def codon_signature(tables: Sequence[DataFrame]) -> DataFrame:
    """Codon tables of several sites stacked and rounded."""

    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out.select("codon", "amino_acid", "site", half_even(F.col("occupancy")).alias("occupancy"),
                      half_even(F.col("occupancy_sd")).alias("occupancy_sd"),
                      F.coalesce("libraries", F.lit(0)).alias("libraries"))


def calibration_totals(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.sum("psites").alias("psites"),
                        F.count_if(F.col("failures") == "").alias("clean_libraries"),
                        F.count(F.lit(1)).alias("libraries"))


def evidence(provenance: Mapping[str, str], sections: Mapping[str, DataFrame | None],
             spark) -> DataFrame:
    """One JSON row of bounded result sections; a section that was not produced is null."""

    columns = [F.lit(v).alias(k) for k, v in provenance.items()]
    parts = [F.struct(*columns).alias("provenance")]
    for name, table in sections.items():
        if table is None:
            parts.append(F.lit(None).cast("string").alias(name))
            continue
        rows = table.agg(F.sort_array(F.collect_list(F.struct(*table.columns)))).scalar()
        parts.append(rows.alias(name))
    return spark.range(1).select(as_json(F.struct(*parts)).alias("payload"))


def index_table(landscape: DataFrame, conditions: DataFrame, decay: DataFrame,
                editing: DataFrame, order: str = "ordinal") -> DataFrame:
    """The compact columnar index: dictionary codes, fixed point, -1 for absent.

    A row per variant; the dictionaries come from first appearance in table order.
    """

    mapped = conditions.where("mapping_status = 'mapped'").select(
        "variant_id", "condition_name", "condition_ordinal")
    first = first_by(mapped, ["variant_id"], ["condition_ordinal"]).select(
        "variant_id", F.regexp_replace("condition_name", "_", " ").alias("condition"))
    extra = mapped.groupBy("variant_id").agg((F.count(F.lit(1)) - 1).alias("extra_conditions"))
    joined = (landscape.join(first, "variant_id", "left").join(extra, "variant_id", "left")
              .join(decay.select("variant_id", "escape_full_rules"), "variant_id", "left")
              .join(editing.where("reach_class <> ''").select("variant_id", "reach_class"),
                    "variant_id", "left"))
    # Written once: the four dictionaries below are all built from it.
    joined = cut_lineage(joined.withColumn("residue", F.coalesce("original_aa", F.lit("?"))))
    for column, name in (("gene_symbol", "gene"), ("residue", "residue_code"),
                         ("condition", "condition_code"), ("reach_class", "reach_code")):
        codes = first_seen_codes(joined, column, order, name)
        joined = joined.join(codes, column, "left")
    absent = F.lit(ABSENT).cast("bigint")
    return joined.select(
        "variant_id", order, F.col("gene").cast("bigint").alias("gene"),
        F.coalesce(F.col("protein_position"), F.lit(0)).cast("bigint").alias("position"),
        stop_code(F.col("stop_type")).cast("bigint").alias("stop"),
        F.col("residue_code").cast("bigint").alias("residue"),
        F.col("escapes_decay_by_rule").cast("bigint").alias("escapes"),
        F.coalesce(F.col("escape_full_rules").cast("bigint"), absent).alias("escapes_full"),
        F.coalesce(F.col("review_stars"), F.lit(0)).cast("bigint").alias("stars"),
        scaled(F.col("best_readthrough"), SCALE_READTHROUGH).alias("best"),
        scaled(F.col("best_readthrough_low"), SCALE_READTHROUGH).alias("best_low"),
        scaled(F.col("tolerable_insertion_share"), SCALE_TOLERANCE).alias("tolerance"),
        F.coalesce("extra_conditions", F.lit(0)).cast("bigint").alias("extra_conditions"),
        F.coalesce(F.col("condition_code").cast("bigint"), absent).alias("condition"),
        F.coalesce(F.col("reach_code").cast("bigint"), absent).alias("reach"))


def index_arms(landscape: DataFrame, scores: DataFrame, therapies: Sequence[str]) -> DataFrame:
    """Each variant's fixed-point arms in therapy order, -1 where a therapy has no prediction."""

    scored = scores.where(F.col("readthrough_predicted").isNotNull())
    columns = {"arm_mid": "readthrough_predicted", "arm_low": "readthrough_low",
               "arm_high": "readthrough_high"}
    wide = scored.groupBy("variant_id").agg(*[
        F.array(*[F.coalesce(F.max(F.when(F.col("therapy_id") == t, scaled(
            F.col(c), SCALE_READTHROUGH))), F.lit(ABSENT).cast("bigint"))
            for t in therapies]).alias(n) for n, c in columns.items()])
    none = F.array(*[F.lit(ABSENT).cast("bigint") for _ in therapies])
    return landscape.select("variant_id").join(wide, "variant_id", "left").select(
        "variant_id", *[F.coalesce(n, none).alias(n) for n in columns])


def research_counts(conditions: DataFrame, contexts: DataFrame) -> DataFrame:
    """The denominators a research page rests on; one row."""

    entity = met(F.col("mapping_status").isin("mapped", "medgen_only"))
    population = contexts.agg(F.count_distinct("variant_id").alias("q"),
                              F.count_if(met(F.col("scoreable"))).alias("s"))
    return conditions.agg(
        F.count_distinct(F.when(entity, F.col("medgen"))).alias("eligible_condition_entities"),
        F.count_if(entity).alias("unique_variant_condition_pairs"),
        F.count_if(~entity).alias("excluded_placeholder_or_unmapped_rows")
    ).select(population.select("q").scalar().alias("qualifying_variants"),
             population.select("s").scalar().alias("scoreable_variants"), "*")
