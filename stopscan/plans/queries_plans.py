"""Queries that run a whole arm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopscan.functions.nucleotides import translate_sequence
from stopscan.plans.amenability import amenability
from stopscan.plans.carriers import Tables
from stopscan.plans.contrast import readthrough_contrast
from stopscan.plans.queries_footprints import GTF_SQL
from stopscan.plans.queries_variants import PLACED_SQL, PREDICTORS_SQL, _guides_sql
from stopscan.plans.registry import query, rounded
from stopscan.plans.research import research_payload

_RUN_SQL = f"""{GTF_SQL},
gone AS (SELECT transcript_id AS transcript FROM overlapping
  UNION SELECT transcript FROM genes WHERE gene = 'VDR'),
col AS (SELECT transcript, sample, any_value(extension) AS extension, any_value(l_utr3) AS l_utr3,
    sum(cds_frame0) AS c0, sum(cds_total) AS ct, sum(extension_frame0) AS x0,
    sum(extension_frame0 + extension_frame1 + extension_frame2) AS xt, sum(termination) AS tm
  FROM counts WHERE length BETWEEN 28 AND 34 GROUP BY 1, 2),
pass AS (SELECT * FROM col WHERE l_utr3 >= 50 AND c0 >= 100 AND extension IS NOT NULL
    AND transcript NOT IN (SELECT transcript FROM gone)),
kp AS (SELECT * FROM pass WHERE transcript IN (SELECT transcript FROM pass GROUP BY 1
    HAVING count(DISTINCT sample) = (SELECT count(*) FROM arms)))
SELECT k.sample, treatment, cast(replicate AS bigint) AS replicate, count(*) AS transcripts,
  round(sum(x0) / sum(c0), 6) AS downstream_occupancy,
  round(sum(tm) / sum(c0), 6) AS termination_occupancy,
  round(sum(x0) / sum(xt) - sum(c0) / sum(ct), 6) AS frame_gap
FROM kp k JOIN arms ON arms.sample = k.sample GROUP BY 1, 2, 3"""


@query("contrast_run", "counts", "genes", "arms", "gtf", sql=f"WITH {_RUN_SQL}")
def contrast_run(t: Tables) -> DataFrame:
    """The measured arm from calibration to per-library values, both exclusions applied."""

    run = readthrough_contrast(
        t("counts"), t("frames"), t("offsets"), t("arms"), t("gtf"), t("genes"), "treated",
        "control", "d1", "d1", minimum_psites=10_000)
    return rounded(run.libraries.select(
        "sample", "treatment", "replicate", "transcripts", "downstream_occupancy",
        "termination_occupancy", "frame_gap"))


@query("research_payload", "conditions", "contexts", sql=f"""
WITH {PREDICTORS_SQL} SELECT 'r1' AS release, (SELECT count(*) FROM contexts WHERE scoreable)
    AS scoreable_variants, (SELECT count(*) FROM predictors WHERE predictors_disagree) AS disagree,
  (SELECT count(DISTINCT upper(stop_type) || original_aa) FROM contexts WHERE scoreable)
    AS variants_frontier, 50 AS condition_coverage_top, 'null' AS escape""")
def whole_research_payload(t: Tables) -> DataFrame:
    payload = research_payload(t("conditions"), t("contexts"), {"release": "r1"})

    def rows(section: str):
        return F.size(F.from_json(F.get_json_object("payload", f"$.{section}"), "array<string>"))

    def first(section: str, field: str):
        return F.get_json_object("payload", f"$.{section}[0].{field}").cast("bigint")

    return rounded(payload.select(
        F.get_json_object("payload", "$.provenance.release").alias("release"),
        first("denominators", "scoreable_variants").alias("scoreable_variants"),
        first("nmd", "disagree").alias("disagree"),
        rows("variants_frontier").alias("variants_frontier"),
        rows("condition_coverage_top").alias("condition_coverage_top"),
        F.regexp_extract("payload", '"escape":([a-z]+)', 1).alias("escape")))


@query("amenability_run", "variants", "exons", sql=f"""
WITH {PLACED_SQL}, {_guides_sql(False)}, ok AS (SELECT * FROM reasoned WHERE ref IN
  ('A', 'C', 'G', 'T') AND alt IN ('A', 'C', 'G', 'T'))
SELECT (SELECT count(*) FROM ok) AS variants,
  (SELECT count(*) FROM ok WHERE reason = '') AS scoreable,
  (SELECT count(*) * 3 FROM ok WHERE reason = '') AS scored,
  (SELECT count(*) FROM ok WHERE reason = '') AS landscape_rows,
  (SELECT count(*) FROM reach WHERE reachable) AS reachable""")
def amenability_run(t: Tables) -> DataFrame:
    """The predicted arm from archive records to editability, counted at each step."""

    run = amenability(**amenability_inputs(t))
    every = F.count(F.lit(1))
    # Counted by value: a filter would be pushed below the guide search and repeat the placement.
    counts = {"variants": (run.variants, every),
              "scoreable": (run.contexts, F.count_if("scoreable")), "scored": (run.scores, every),
              "landscape_rows": (run.landscape, every),
              "reachable": (run.reachability, F.count_if("reachable"))}
    return t.spark.range(1).select(*[
        df.agg(count).scalar().alias(n) for n, (df, count) in counts.items()])


def amenability_inputs(t: Tables) -> dict[str, DataFrame]:
    """Archive records, annotation, sequences and proteins that agree with each other."""

    given = {"CLNVC": "single_nucleotide_variant", "MC": "SO:0001587|nonsense",
             "CLNSIG": "Pathogenic", "CLNREVSTAT": "practice_guideline", "CLNDN": "a",
             "CLNDISDB": "MedGen:C1"}
    records = t("variants").select(
        "chrom", "pos", "ref", "alt", F.col("variant_id").alias("CLNHGVS"),
        F.col("ordinal").cast("string").alias("ALLELEID"),
        F.concat("gene_symbol", F.lit(":"), F.col("gene_id").cast("string")).alias("GENEINFO"),
        *[F.lit(v).alias(k) for k, v in given.items()])
    sequences = t("seqs").select("accession", "sequence")
    coding = F.substring("sequence", F.col("l_utr5") + 1, F.col("l_cds"))
    proteins = t("seqs").select(F.concat(F.lit("np"), "accession").alias("accession"),
                                translate_sequence(coding).alias("sequence"))
    return {"records": records, "features": t("features"), "sequences": sequences,
            "proteins": proteins, "library": t("library")}
