"""Queries over footprints: calibration, counts, ratios, effects, codons, native stops, reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.functions import nucleotides as nuc
from stopscan.functions.fixed import QUADRANTS, QUANTITIES, SENSE_CODONS, STOP_CODONS
from stopscan.functions.scalars import t_quantile_value
from stopscan.operators import codons as cod
from stopscan.operators import detectability as det
from stopscan.operators import effects as eff
from stopscan.operators import expression as exp
from stopscan.operators import footprints as fp
from stopscan.operators import intervals as itv
from stopscan.operators import native_stops as nat
from stopscan.operators import payloads as pay
from stopscan.operators import reads as rd
from stopscan.plans.carriers import ADAPTER, Tables
from stopscan.plans.queries_variants import STOPS_SQL, sql_residue
from stopscan.plans.registry import query, rounded
from stopscan.session import cut_lineage, scratch_path
from stopscan.sources import text as src

LENGTHS = (28, 29, 30, 31, 32)
TARGETS = {"downstream_occupancy": 0.01, "termination_occupancy": -0.02, "frame_gap": 0.05}

# --- Alignments to tables -----------------------------------------------------------------------

PSITES_SQL = """psites AS (SELECT r.sample, r.transcript, r.length, end5,
    end5 + corrected_offset_from_5 - l_utr5 - 1 AS psite_from_start,
    end5 + corrected_offset_from_5 - l_utr5 - l_cds AS psite_from_stop,
    l_cds, l_utr3,
    CASE WHEN end5 + corrected_offset_from_5 - l_utr5 - 1 < 0 THEN '5utr'
         WHEN end5 + corrected_offset_from_5 - l_utr5 - l_cds > 0 THEN '3utr' ELSE 'cds' END
      AS psite_region
  FROM reads r JOIN offsets o ON o.sample = r.sample AND o.length = r.length
  JOIN seqs s ON s.transcript = r.transcript
  WHERE flag & 256 = 0 AND r.length BETWEEN 18 AND 40),
ext AS (SELECT transcript, CASE WHEN gene_id % 9 = 0 THEN NULL ELSE 30 + 3 * (gene_id % 20) END
    AS extension FROM seqs)"""

_FRAME = "((psite_from_start % 3 + 3) % 3)"
_INTERNAL = "psite_region = 'cds' AND psite_from_start >= 18 AND psite_from_stop <= -16"


def psites(t: Tables) -> DataFrame:
    return fp.assign_psites(fp.primary_footprints(t("reads")), t("offsets"),
                            t("seqs").select("transcript", "l_utr5", "l_cds", "l_utr3"))


def extensions(t: Tables) -> DataFrame:
    return t("seqs").select("transcript", F.when(
        F.col("gene_id") % 9 != 0, (30 + 3 * (F.col("gene_id") % 20)).cast("int"))
        .alias("extension"))


@query("psite_assignment", "reads", "offsets", "seqs", sql=f"""
WITH {PSITES_SQL} SELECT sample, transcript, cast(length AS bigint) AS length,
  cast(end5 AS bigint) AS end5, cast(psite_from_start AS bigint) AS psite_from_start,
  cast(psite_from_stop AS bigint) AS psite_from_stop, psite_region FROM psites""")
def psite_assignment(t: Tables) -> DataFrame:
    return rounded(psites(t).select("sample", "transcript", "length", "end5", "psite_from_start",
                                    "psite_from_stop", "psite_region"))


@query("readthrough_counts", "reads", "offsets", "seqs", sql=f"""
WITH {PSITES_SQL}, c AS (SELECT p.sample, p.transcript, p.length,
    {", ".join(f"count(*) FILTER ({_INTERNAL} AND {_FRAME} = {k}) AS cds_frame{k}"
               for k in range(3))},
    count(*) FILTER (psite_from_stop BETWEEN -15 AND 0) AS termination,
    any_value(extension) AS extension,
    {", ".join(f"count(*) FILTER (psite_from_stop >= 1 AND psite_from_stop <= extension - 3 "
               f"AND {_FRAME} = {k}) AS extension_frame{k}" for k in range(3))},
    any_value(l_cds) AS l_cds, any_value(l_utr3) AS l_utr3
  FROM psites p LEFT JOIN ext ON ext.transcript = p.transcript GROUP BY 1, 2, 3)
SELECT sample, transcript, cast(length AS bigint) AS length, cds_frame0, cds_frame1, cds_frame2,
  termination, cast(extension AS bigint) AS extension, extension_frame0, extension_frame1,
  extension_frame2, cast(l_cds AS bigint) AS l_cds, cast(l_utr3 AS bigint) AS l_utr3,
  cds_frame0 + cds_frame1 + cds_frame2 AS cds_total FROM c
WHERE cds_frame0 + cds_frame1 + cds_frame2 > 0 OR termination > 0 OR extension_frame0 > 0
  OR extension_frame1 > 0 OR extension_frame2 > 0""")
def readthrough_counts(t: Tables) -> DataFrame:
    return rounded(fp.readthrough_counts(psites(t), extensions(t)))


@query("frame_counts", "reads", "offsets", "seqs", sql=f"""
WITH {PSITES_SQL} SELECT sample, cast(length AS bigint) AS length,
  cast({_FRAME} AS bigint) AS frame, count(*) AS n FROM psites WHERE {_INTERNAL}
GROUP BY 1, 2, 3""")
def frame_counts(t: Tables) -> DataFrame:
    return rounded(fp.frame_counts(psites(t)))


@query("codon_counts", "reads", "offsets", "seqs", sql=f"""
WITH {PSITES_SQL} SELECT sample, transcript, cast(length AS bigint) AS length,
  cast(psite_from_start // 3 AS bigint) AS codon_index, count(*) AS n FROM psites
WHERE psite_region = 'cds' AND psite_from_start % 3 = 0 GROUP BY 1, 2, 3, 4""")
def codon_counts(t: Tables) -> DataFrame:
    return rounded(fp.codon_counts(psites(t)))


@query("region_fractions", "reads", "offsets", "seqs", sql=f"""
WITH {PSITES_SQL}, c AS (SELECT sample, psite_region AS region, count(*) AS n FROM psites
  GROUP BY 1, 2) SELECT sample, region, n,
  round(n / sum(n) OVER (PARTITION BY sample), 6) AS fraction FROM c""")
def region_fractions(t: Tables) -> DataFrame:
    return rounded(fp.region_fractions(psites(t)))


@query("offset_shift_check", "reads", "offsets", "seqs", sql=f"""
WITH {PSITES_SQL}, d AS (SELECT * FROM offsets QUALIFY row_number() OVER (PARTITION BY sample
  ORDER BY total_percentage DESC, length) = 1)
SELECT p.sample, cast(p.length AS bigint) AS length, cast(k AS bigint) AS shift,
  round(avg(CASE WHEN ((psite_from_start + k) % 3 + 3) % 3 = 0 THEN 1.0 ELSE 0.0 END), 6)
    AS frame0
FROM psites p JOIN d ON d.sample = p.sample AND d.length = p.length
CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) AS s(k)
WHERE psite_region = 'cds' GROUP BY 1, 2, 3""")
def offset_shift_check(t: Tables) -> DataFrame:
    return rounded(fp.offset_shift_check(psites(t), t("offsets")))


@query("metaprofile", "reads", "offsets", "seqs", sql=f"""
WITH {PSITES_SQL}, grid AS (
  SELECT sample, 'Distance from start (nt)' AS region, unnest(range(-25, 50)) AS distance
    FROM (SELECT DISTINCT sample FROM psites) AS a
  UNION ALL SELECT sample, 'Distance from stop (nt)', unnest(range(-49, 26))
    FROM (SELECT DISTINCT sample FROM psites) AS b),
hits AS (SELECT sample, 'Distance from start (nt)' AS region, psite_from_start AS distance
    FROM psites WHERE psite_from_start BETWEEN -25 AND 49
  UNION ALL SELECT sample, 'Distance from stop (nt)', psite_from_stop FROM psites
    WHERE psite_from_stop BETWEEN -49 AND 25)
SELECT g.sample, g.region, cast(g.distance AS bigint) AS distance, count(h.sample) AS count
FROM grid g LEFT JOIN hits h ON h.sample = g.sample AND h.region = g.region
  AND h.distance = g.distance GROUP BY 1, 2, 3""")
def metaprofile(t: Tables) -> DataFrame:
    return rounded(fp.metaprofile(psites(t)))


@query("periodicity", "reads", "offsets", "seqs", "arms", sql=f"""
WITH {PSITES_SQL}, hits AS (SELECT sample, 'start' AS region, psite_from_start AS distance
    FROM psites WHERE psite_from_start BETWEEN -25 AND 49
  UNION ALL SELECT sample, 'stop', psite_from_stop FROM psites
    WHERE psite_from_stop BETWEEN -49 AND 25),
grid AS (SELECT sample, 'start' AS region, unnest(range(-25, 50)) AS distance FROM arms
  UNION ALL SELECT sample, 'stop', unnest(range(-49, 26)) FROM arms),
c AS (SELECT g.sample, g.region, g.distance, count(h.sample) AS n FROM grid g LEFT JOIN hits h
  ON h.sample = g.sample AND h.region = g.region AND h.distance = g.distance GROUP BY 1, 2, 3)
SELECT region, treatment, cast(distance AS bigint) AS distance,
  round(round_even(avg(n / 1000.0), 8), 6) AS scaled, count(DISTINCT c.sample) AS libraries
FROM c JOIN arms ON arms.sample = c.sample GROUP BY 1, 2, 3""")
def periodicity(t: Tables) -> DataFrame:
    profile = fp.metaprofile(psites(t)).withColumn("scaled_count", F.col("count") / 1000.0)
    return rounded(pay.periodicity(profile, t("arms")))


@query("calibration_summary", "offsets", "frames", sql="""
WITH d AS (SELECT * FROM offsets QUALIFY row_number() OVER (PARTITION BY sample
  ORDER BY total_percentage DESC, length) = 1)
SELECT d.sample, cast(length AS bigint) AS dominant_length,
  cast(corrected_offset_from_5 AS bigint) AS offset_from_5,
  cast(corrected_offset_from_3 AS bigint) AS offset_from_3, round_even(f, 3) AS cds_frame0
FROM d JOIN (SELECT sample, sum(n) FILTER (frame = 0) / sum(n) AS f FROM frames GROUP BY sample)
  AS s ON s.sample = d.sample""")
def calibration_summary(t: Tables) -> DataFrame:
    return rounded(fp.calibration_summary(t("offsets"), t("frames")))


# --- Length selection ---------------------------------------------------------------------------

_LENGTHS_SQL = """w AS (SELECT sample, length, coalesce(sum(n) FILTER (frame = 0), 0) AS f0,
    coalesce(sum(n) FILTER (frame = 1), 0) AS f1, coalesce(sum(n) FILTER (frame = 2), 0) AS f2,
    sum(n) AS total FROM frames GROUP BY 1, 2),
p AS (SELECT sample, length FROM (SELECT *, total / sum(total) OVER (PARTITION BY sample) AS share
  FROM w) AS x WHERE f0 > f1 AND f0 > f2 AND share >= 0.01),
shared AS (SELECT length FROM p GROUP BY length HAVING count(DISTINCT sample) =
  (SELECT count(DISTINCT sample) FROM frames))"""


@query("shared_lengths", "frames", sql=f"""
WITH {_LENGTHS_SQL} SELECT cast(length AS bigint) AS length FROM shared""")
def shared_lengths(t: Tables) -> DataFrame:
    return rounded(fp.shared_lengths(t("frames")))


_VERDICT_SQL = f"""{_LENGTHS_SQL},
d AS (SELECT * FROM offsets QUALIFY row_number() OVER (PARTITION BY sample
  ORDER BY total_percentage DESC, length) = 1),
j AS (SELECT f.sample, cast(coalesce(sum(n) FILTER (s.length IS NOT NULL), 0) AS bigint) AS psites,
    coalesce(sum(n) FILTER (s.length IS NOT NULL AND frame = 0), 0) AS f0
  FROM frames f LEFT JOIN shared s ON s.length = f.length GROUP BY f.sample),
verdicts AS (SELECT j.sample, psites, round(f0 / psites, 6) AS frame0_share,
    cast(d.length AS bigint) AS dominant_length,
    cast(corrected_offset_from_5 AS bigint) AS offset_from_5,
    CASE WHEN psites < 1000000 THEN 'psites' ELSE '' END AS failures, psites >= 1000000 AS passes
  FROM j JOIN d ON d.sample = j.sample)"""


@query("library_verdicts", "frames", "offsets",
       sql=f"WITH {_VERDICT_SQL} SELECT * FROM verdicts")
def library_verdicts(t: Tables) -> DataFrame:
    return rounded(fp.library_verdicts(t("frames"), t("offsets")))


@query("failure_kinds", "frames", "offsets", sql=f"""
WITH {_VERDICT_SQL} SELECT sample, CASE WHEN passes THEN 'none'
  WHEN offset_from_5 NOT BETWEEN 11 AND 14 OR frame0_share < 0.4 THEN 'validity'
  ELSE 'precision' END AS calibration FROM verdicts""")
def failure_kinds(t: Tables) -> DataFrame:
    return fp.library_verdicts(t("frames"), t("offsets")).select(
        "sample", fp.failure_kind().alias("calibration"))


@query("manifest_gate", "frames", "offsets", sql=f"""
WITH {_VERDICT_SQL} SELECT sample, failures FROM verdicts WHERE NOT passes""")
def manifest_gate(t: Tables) -> DataFrame:
    return fp.manifest_gate(fp.library_verdicts(t("frames"), t("offsets")), "d1", "d1")


@query("calibration_manifest", "frames", "offsets", sql=f"""
WITH {_VERDICT_SQL} SELECT 'd1' AS dataset,
  (SELECT string_agg(cast(length AS varchar), ',' ORDER BY length) FROM shared) AS lengths,
  count(*) AS libraries, bool_and(passes) AS passes FROM verdicts""")
def calibration_manifest(t: Tables) -> DataFrame:
    schema = ("dataset string, lengths array<int>, passes boolean, "
              "libraries array<struct<sample:string,psites:bigint>>")
    parsed = fp.manifest("d1", t("frames"), t("offsets")).select(
        F.from_json("manifest", schema).alias("m"))
    return parsed.select(
        "m.dataset", F.array_join(F.transform("m.lengths", lambda x: x.cast("string")), ",")
        .alias("lengths"), F.size("m.libraries").cast("bigint").alias("libraries"), "m.passes")


@query("calibration_totals", "frames", "offsets", sql=f"""
WITH {_VERDICT_SQL} SELECT cast(sum(psites) AS bigint) AS psites,
  count(*) FILTER (failures = '') AS clean_libraries, count(*) AS libraries FROM verdicts""")
def calibration_totals(t: Tables) -> DataFrame:
    return pay.calibration_totals(fp.library_verdicts(t("frames"), t("offsets")))


@query("frame_by_length", "frames", sql="""
WITH w AS (SELECT length, coalesce(sum(n) FILTER (frame = 0), 0) AS f0,
  coalesce(sum(n) FILTER (frame = 1), 0) AS f1, coalesce(sum(n) FILTER (frame = 2), 0) AS f2,
  sum(n) AS total FROM frames GROUP BY length)
SELECT cast(length AS bigint) AS length, cast(f0 AS bigint) AS frame0, cast(f1 AS bigint) AS frame1,
  cast(f2 AS bigint) AS frame2, round_even(f0 / total, 6) AS frame0_share,
  round_even(total / sum(total) OVER (), 6) AS library_share, length IN (28, 29, 30, 31, 32) AS kept
FROM w""")
def frame_by_length(t: Tables) -> DataFrame:
    return rounded(fp.frame_by_length(t("frames"), LENGTHS))


# --- Contrast -----------------------------------------------------------------------------------

_SUMMED = ("cds_frame0", "cds_frame1", "cds_frame2", "extension_frame0", "extension_frame1",
           "extension_frame2", "termination", "cds_total")

COLLAPSED_SQL = f"""collapsed AS (SELECT transcript, sample, any_value(extension) AS extension,
    any_value(l_cds) AS l_cds, any_value(l_utr3) AS l_utr3,
    {", ".join(f"cast(sum({c}) AS bigint) AS {c}" for c in _SUMMED)}
  FROM counts WHERE length IN (28, 29, 30, 31, 32) GROUP BY transcript, sample)"""

QUALIFYING_SQL = f"""{COLLAPSED_SQL},
passing AS (SELECT * FROM collapsed WHERE l_utr3 >= 50 AND cds_frame0 >= 100
    AND extension IS NOT NULL AND transcript NOT IN
      (SELECT transcript FROM genes WHERE gene = 'VDR')),
kept AS (SELECT * FROM passing WHERE transcript IN (SELECT transcript FROM passing
    GROUP BY transcript HAVING count(DISTINCT sample) = (SELECT count(*) FROM arms)))"""

RATIOS_SQL = f"""{QUALIFYING_SQL},
ratios AS (SELECT sample, count(*) AS transcripts,
    avg(CASE WHEN extension_frame0 + extension_frame1 + extension_frame2 > 0 THEN 1.0 ELSE 0.0 END)
      AS with_downstream,
    cast(sum(cds_frame0) AS bigint) AS cds_frame0_total,
    cast(sum(extension_frame0 + extension_frame1 + extension_frame2) AS bigint)
      AS downstream_total,
    cast(sum(termination) AS bigint) AS termination_total,
    sum(extension_frame0) / sum(cds_frame0) AS downstream_occupancy,
    sum(termination) / sum(cds_frame0) AS termination_occupancy,
    sum(extension_frame0) / sum(extension_frame0 + extension_frame1 + extension_frame2)
      AS downstream_share0,
    sum(cds_frame0) / sum(cds_total) AS cds_share0,
    sum(extension_frame0) / sum(extension_frame0 + extension_frame1 + extension_frame2)
      - sum(cds_frame0) / sum(cds_total) AS frame_gap,
    quantile_cont(extension_frame0 / cds_frame0, 0.5) AS median_readthrough
  FROM kept GROUP BY sample)"""

_T = ", ".join(f"({df}, {t_quantile_value(0.975, df)!r}::DOUBLE)" for df in range(1, 40))
LONG_SQL = f"""{RATIOS_SQL},
long AS (SELECT q AS quantity, r.sample, treatment, replicate, CASE q
    WHEN 'downstream_occupancy' THEN downstream_occupancy
    WHEN 'termination_occupancy' THEN termination_occupancy ELSE frame_gap END AS v
  FROM ratios r JOIN arms ON arms.sample = r.sample CROSS JOIN
    (VALUES ('downstream_occupancy'), ('termination_occupancy'), ('frame_gap')) AS x(q)),
tt AS (SELECT * FROM (VALUES {_T}) AS t(df, t))"""

UNPAIRED_SQL = f"""{LONG_SQL},
g AS (SELECT quantity, avg(v) FILTER (treatment = 'treated') AS ma,
    avg(v) FILTER (treatment = 'control') AS mb,
    var_samp(v) FILTER (treatment = 'treated') / count(*) FILTER (treatment = 'treated') AS va,
    var_samp(v) FILTER (treatment = 'control') / count(*) FILTER (treatment = 'control') AS vb,
    count(*) FILTER (treatment = 'treated') AS na, count(*) FILTER (treatment = 'control') AS nb,
    min(v) FILTER (treatment = 'treated') > max(v) FILTER (treatment = 'control')
      OR max(v) FILTER (treatment = 'treated') < min(v) FILTER (treatment = 'control')
      AS consistent FROM long GROUP BY quantity),
effects AS (SELECT quantity, ma - mb AS mean_difference, ma - mb - t * sqrt(va + vb) AS ci_low,
    ma - mb + t * sqrt(va + vb) AS ci_high, consistent, na AS n_treated, nb AS n_control
  FROM g JOIN tt ON tt.df = greatest(1, floor((va + vb) ** 2
    / (va ** 2 / (na - 1) + vb ** 2 / (nb - 1)))))"""


def kept_counts(t: Tables) -> DataFrame:
    return fp.qualifying(fp.collapse_lengths(t("counts"), LENGTHS), genes=t("genes"),
                         samples=t("arms"))


@query("collapse_lengths", "counts", sql=f"""
WITH {COLLAPSED_SQL} SELECT transcript, sample, cast(extension AS bigint) AS extension,
  cast(l_cds AS bigint) AS l_cds, cast(l_utr3 AS bigint) AS l_utr3, {", ".join(_SUMMED)}
FROM collapsed""")
def collapse_lengths(t: Tables) -> DataFrame:
    return rounded(fp.collapse_lengths(t("counts"), LENGTHS))


@query("qualifying_transcripts", "counts", "genes", "arms", sql=f"""
WITH {QUALIFYING_SQL} SELECT transcript, sample, cds_frame0, termination, extension_frame0
FROM kept""")
def qualifying_transcripts(t: Tables) -> DataFrame:
    return kept_counts(t).select("transcript", "sample", "cds_frame0", "termination",
                                 "extension_frame0")


def _r(columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns.split())


@query("library_ratios", "counts", "genes", "arms", sql=f"""
WITH {RATIOS_SQL} SELECT sample, transcripts, cds_frame0_total, downstream_total,
  termination_total, {_r("with_downstream downstream_occupancy termination_occupancy "
                         "downstream_share0 cds_share0 frame_gap median_readthrough")}
FROM ratios""")
def library_ratios(t: Tables) -> DataFrame:
    return rounded(fp.library_ratios(kept_counts(t)))


@query("contrast_effects", "counts", "genes", "arms", sql=f"""
WITH {UNPAIRED_SQL} SELECT quantity, consistent, n_treated, n_control,
  {_r("mean_difference ci_low ci_high")} FROM effects""")
def contrast_effects(t: Tables) -> DataFrame:
    ratios = fp.library_ratios(kept_counts(t))
    return rounded(eff.unpaired_effects(ratios, t("arms"), "treated", "control"))


@query("paired_effects", "counts", "genes", "arms", sql=f"""
WITH {LONG_SQL}, d AS (SELECT quantity, replicate,
    max(v) FILTER (treatment = 'treated') - max(v) FILTER (treatment = 'control') AS d
  FROM long GROUP BY 1, 2),
s AS (SELECT quantity, avg(d) AS m, stddev_samp(d) AS sd, count(*) AS n, min(d) AS lo,
    max(d) AS hi FROM d GROUP BY quantity)
SELECT quantity, round(m, 6) AS mean_difference, round(m - t * sd / sqrt(n), 6) AS ci_low,
  round(m + t * sd / sqrt(n), 6) AS ci_high, lo > 0 OR hi < 0 AS consistent, n AS replicates
FROM s JOIN tt ON tt.df = n - 1""")
def paired_effects(t: Tables) -> DataFrame:
    ratios = fp.library_ratios(kept_counts(t))
    return rounded(eff.paired_effects(ratios, t("arms"), "treated", "control"))


@query("contrast_signature", "counts", "genes", "arms", sql=f"""
WITH {UNPAIRED_SQL}, x AS (SELECT * FROM effects WHERE quantity = 'downstream_occupancy'),
y AS (SELECT * FROM effects WHERE quantity = 'termination_occupancy'),
z AS (SELECT * FROM effects WHERE quantity = 'frame_gap')
SELECT x.mean_difference > 0 AND x.consistent AS downstream_rose,
  y.mean_difference < 0 AND y.consistent AS termination_fell,
  z.mean_difference > 0 AND z.consistent AND z.ci_low > 0 AS frame_moved_to_coding,
  x.mean_difference > 0 AND x.consistent AND y.mean_difference < 0 AND y.consistent
    AND z.mean_difference > 0 AND z.consistent AND z.ci_low > 0 AS complete,
  y.mean_difference >= 0 AND x.mean_difference <= 0 AS stalling,
  y.consistent AS termination_arms_separate FROM x, y, z""")
def contrast_signature(t: Tables) -> DataFrame:
    ratios = fp.library_ratios(kept_counts(t))
    return eff.signature(eff.unpaired_effects(ratios, t("arms"), "treated", "control"))


@query("contrast_libraries", "counts", "genes", "arms", sql=f"""
WITH {RATIOS_SQL} SELECT r.sample, treatment, transcripts,
  round_even(downstream_occupancy, 6) AS downstream_occupancy,
  round_even(termination_occupancy, 6) AS termination_occupancy,
  round_even(frame_gap, 6) AS frame_gap FROM ratios r JOIN arms ON arms.sample = r.sample""")
def contrast_libraries(t: Tables) -> DataFrame:
    return rounded(pay.contrast_libraries(fp.library_ratios(kept_counts(t)), t("arms")))


@query("contrast_guards", "counts", "arms", sql="""
SELECT 'without_counts' AS guard, count(*) AS rows FROM (SELECT DISTINCT s_suppkey % 9 AS k
  FROM supplier) AS a WHERE k >= 6
UNION ALL SELECT 'treated', count(*) FROM arms WHERE treatment <> 'control'
UNION ALL SELECT 'repeated', count(*) FROM (SELECT sample FROM counts GROUP BY sample
  HAVING count(*) > 1) AS r""")
def contrast_guards(t: Tables) -> DataFrame:
    asked = t.table("supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 9).cast(
        "string")).alias("sample"))
    parts = {"without_counts": eff.libraries_without_counts(asked, t("counts")),
             "treated": eff.treated_libraries(t("counts"), t("arms"), "control"),
             "repeated": eff.repeated_samples(t("counts"))}
    out = None
    for name, found in parts.items():
        row = found.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("guard"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


# --- Detectability ------------------------------------------------------------------------------

COUNTING_SQL = f"""{RATIOS_SQL},
pool AS (SELECT sample, sum(cds_frame0) AS c0, sum(cds_total) AS ct, sum(extension_frame0) AS x0,
    sum(extension_frame0 + extension_frame1 + extension_frame2) AS xt, sum(termination) AS tm
  FROM kept GROUP BY sample),
counting AS (SELECT sample,
    greatest(x0, 1) / greatest(c0, 1) * sqrt(1.0 / greatest(x0, 1) + 1.0 / greatest(c0, 1))
      AS downstream_occupancy,
    greatest(tm, 1) / greatest(c0, 1) * sqrt(1.0 / greatest(tm, 1) + 1.0 / greatest(c0, 1))
      AS termination_occupancy,
    sqrt(x0 / xt * (1 - x0 / xt) / xt + c0 / ct * (1 - c0 / ct) / ct) AS frame_gap FROM pool)"""


@query("counting_error", "counts", "genes", "arms", sql=f"""
WITH {COUNTING_SQL} SELECT sample, {_r("downstream_occupancy termination_occupancy frame_gap")}
FROM counting""")
def counting_error(t: Tables) -> DataFrame:
    return rounded(det.counting_error(kept_counts(t)))


_TT = ", ".join(f"({n}, {t_quantile_value(0.975, 2 * n - 2) + t_quantile_value(0.8, 2 * n - 2)!r}"
                "::DOUBLE)" for n in range(2, 1001))


@query("detectability", "counts", "genes", "arms", sql=f"""
WITH {COUNTING_SQL}, l AS (SELECT q AS quantity, treatment, CASE q
    WHEN 'downstream_occupancy' THEN r.downstream_occupancy
    WHEN 'termination_occupancy' THEN r.termination_occupancy ELSE r.frame_gap END AS v, CASE q
    WHEN 'downstream_occupancy' THEN c.downstream_occupancy
    WHEN 'termination_occupancy' THEN c.termination_occupancy ELSE c.frame_gap END AS e, target
  FROM ratios r JOIN counting c ON c.sample = r.sample JOIN arms ON arms.sample = r.sample
  CROSS JOIN (VALUES ('downstream_occupancy', 0.01::DOUBLE),
    ('termination_occupancy', -0.02::DOUBLE), ('frame_gap', 0.05::DOUBLE)) AS x(q, target)),
a AS (SELECT quantity, any_value(target) AS target, avg(v) FILTER (treatment = 'treated')
      - avg(v) FILTER (treatment = 'control') AS d,
    greatest(0, var_samp(v) FILTER (treatment = 'treated')
      - avg(e * e) FILTER (treatment = 'treated')) AS fa,
    greatest(0, var_samp(v) FILTER (treatment = 'control')
      - avg(e * e) FILTER (treatment = 'control')) AS fb,
    avg(e * e) FILTER (treatment = 'treated') AS ca,
    avg(e * e) FILTER (treatment = 'control') AS cb,
    count(*) FILTER (treatment = 'treated') AS na, count(*) FILTER (treatment = 'control') AS nb
  FROM l GROUP BY quantity),
kk AS (SELECT * FROM (VALUES {_TT}) AS t(n, k)),
b AS (SELECT a.*, k, k * sqrt((fa + ca) / na + (fb + cb) / nb) AS mde,
    k * sqrt(fa / na + fb / nb) AS floor_effect, fa / na + fb / nb AS fl,
    ca / na + cb / nb AS ce FROM a JOIN kk ON 2 * kk.n = na + nb)
SELECT quantity, target AS reference_effect, round(d, 6) AS observed_difference,
  round(mde, 6) AS minimum_detectable_effect, round(floor_effect, 6) AS irreducible_effect,
  round((fa + fb) / (fa + fb + ca + cb), 6) AS between_library_share,
  round(CASE WHEN floor_effect >= abs(target) THEN 'inf'::DOUBLE WHEN mde <= abs(target) THEN 1.0
    ELSE ce / ((abs(target) / k) ** 2 - fl) END, 6) AS depth_multiplier_at_least,
  na + nb - 2 AS variance_degrees_of_freedom,
  (SELECT min(n) FROM kk WHERE kk.k * sqrt((fa + fb + ca + cb) / n) <= abs(target))
    AS replicates_required FROM b""")
def detectability(t: Tables) -> DataFrame:
    kept = cut_lineage(kept_counts(t))
    found = det.detectability(fp.library_ratios(kept), det.counting_error(kept), t("arms"),
                              "treated", "control", TARGETS)
    return rounded(found)


@query("bootstrap_intervals")
def bootstrap_intervals(t: Tables) -> DataFrame:
    return rounded(det.bootstrap_intervals(kept_counts(t), draws=2000))


@query("detectability_by_library")
def detectability_by_library(t: Tables) -> DataFrame:
    kept = cut_lineage(kept_counts(t))
    kinds = fp.library_verdicts(t("frames"), t("offsets")).select(
        "sample", fp.failure_kind().alias("calibration"))
    return rounded(det.per_library_table(
        fp.library_ratios(kept), t("arms"), det.counting_error(kept),
        det.bootstrap_intervals(kept, draws=500), kinds))


# --- Intervals ----------------------------------------------------------------------------------

GTF_SQL = """cds AS (SELECT *, beg - 1 AS s FROM gtf WHERE feature = 'CDS'),
ext AS (SELECT transcript_id, min(s) AS cs, max(fin) AS ce FROM cds GROUP BY 1),
down AS (SELECT u.*, u.beg - 1 AS s FROM gtf u JOIN ext ON ext.transcript_id = u.transcript_id
  WHERE feature = 'UTR' AND CASE WHEN strand = '+' THEN u.beg - 1 >= ce ELSE u.fin <= cs END),
overlapping AS (SELECT DISTINCT d.transcript_id FROM down d JOIN cds c ON c.chrom = d.chrom
  AND c.strand = d.strand AND d.s < c.fin AND c.s < d.fin AND c.gene_id <> d.gene_id)"""


@query("overlapping_other_genes", "gtf", sql=f"WITH {GTF_SQL} SELECT * FROM overlapping")
def overlapping_other_genes(t: Tables) -> DataFrame:
    return itv.overlapping_other_genes(t("gtf"))


@query("downstream_regions", "gtf", sql=f"""
WITH {GTF_SQL} SELECT chrom, s AS start, fin AS "end", strand, gene_id, transcript_id FROM down""")
def downstream_regions(t: Tables) -> DataFrame:
    return itv.downstream_regions(*itv.coding_and_untranslated(t("gtf")))


@query("overlap_counts", "gtf", sql=f"""
WITH {GTF_SQL}, asked AS (SELECT DISTINCT chrom, strand, s, fin FROM down)
SELECT a.chrom, a.strand, a.s AS start, a.fin AS "end", count(c.s) AS overlaps FROM asked a
LEFT JOIN cds c ON c.chrom = a.chrom AND c.strand = a.strand AND a.s < c.fin AND c.s < a.fin
GROUP BY 1, 2, 3, 4""")
def overlap_counts(t: Tables) -> DataFrame:
    coding, untranslated = itv.coding_and_untranslated(t("gtf"))
    return itv.overlap_counts(itv.downstream_regions(coding, untranslated), coding,
                              ["chrom", "strand"])


@query("gtf_tables", "gtf", sql="""
SELECT DISTINCT transcript_id AS transcript, 'N' || gene_id AS gene,
  transcript_id LIKE '%7' AS selected FROM gtf WHERE feature = 'CDS'""")
def gtf_tables(t: Tables) -> DataFrame:
    """Annotation written as GTF text, read back as the gene map and the selected set."""

    tag = F.when(F.col("transcript_id").endswith("7"), ' tag "basic"; tag "MANE_Select";')
    attrs = F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "'), "transcript_id",
                     F.lit('"; gene_name "N'), "gene_id", F.lit('";'), F.coalesce(tag, F.lit("")))
    rows = t("gtf").where("feature = 'CDS'")
    line = F.concat_ws("\t", "chrom", F.lit("src"), F.lit("transcript"),
                       F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."),
                       "strand", F.lit("."), attrs)
    path = scratch_path(t.spark, "gtf")
    rows.select(line.alias("value")).write.text(path)
    features = src.read_gff(t.spark, path)
    chosen = src.select_transcripts(features).withColumn("selected", F.lit(True))
    return src.transcript_genes(features).join(chosen, "transcript", "left").withColumn(
        "selected", F.coalesce("selected", F.lit(False)))


# --- Native stops -------------------------------------------------------------------------------

_CODON_AT = "substring(sequence, l_utr5 + l_cds + 1 + 3 * i, 3)"
EXTENSION_SQL = f"""ext AS (SELECT transcript, l_utr5, l_cds, sequence,
    CASE WHEN substring(sequence, l_utr5 + l_cds - 2, 3) IN {STOPS_SQL} THEN
      (SELECT min(3 + 3 * i) FROM (SELECT unnest(range(0, 60)) AS i) AS r
       WHERE {_CODON_AT} IN {STOPS_SQL}) END AS extension FROM seqs)"""


@query("extension_windows", "seqs", sql=f"""
WITH {EXTENSION_SQL} SELECT transcript, cast(extension AS bigint) AS extension FROM ext""")
def extension_windows(t: Tables) -> DataFrame:
    return rounded(nat.extension_windows(t("seqs").drop("sequence"),
                                         t("seqs").select("accession", "sequence")))


@query("extension_peptides", "seqs", sql=f"""
WITH {EXTENSION_SQL} SELECT transcript, cast(extension AS bigint) AS extension_nt,
  cast(extension / 3 - 1 AS bigint) AS extension_aa,
  array_to_string(list_transform(range(0, cast(extension / 3 - 1 AS bigint)),
    lambda i: {sql_residue(_CODON_AT)}), '') AS extension_peptide
FROM ext WHERE extension IS NOT NULL""")
def extension_peptides(t: Tables) -> DataFrame:
    annotation, fasta = t("seqs").drop("sequence"), t("seqs").select("accession", "sequence")
    return rounded(nat.extension_peptides(annotation, fasta))


@query("native_stop_features", "seqs", sql=f"""
SELECT transcript, lower(translate(substring(sequence, l_utr5 + l_cds - 2, 3), 'T', 'U'))
    AS stop_type, lower(translate(substring(sequence, l_utr5 + l_cds - 5, 3), 'T', 'U'))
    AS up_123nt, lower(translate(substring(sequence, l_utr5 + l_cds + 1, 3), 'T', 'U')) AS down_123nt
FROM seqs WHERE substring(sequence, l_utr5 + l_cds - 2, 3) IN {STOPS_SQL}""")
def native_stop_features(t: Tables) -> DataFrame:
    return nat.native_stop_features(t("seqs").drop("sequence"),
                                    t("seqs").select("accession", "sequence"))


ATLAS_SQL = """k AS (SELECT c.*, treatment FROM counts c JOIN arms ON arms.sample = c.sample
    WHERE length IN (28, 29, 30, 31, 32) AND l_utr3 >= 50
      AND transcript NOT IN (SELECT transcript FROM genes WHERE gene = 'VDR')),
p AS (SELECT transcript, sum(extension_frame0) FILTER (treatment = 'treated') AS xt,
    sum(cds_frame0) FILTER (treatment = 'treated') AS ct,
    sum(extension_frame0) FILTER (treatment = 'control') AS xc,
    sum(cds_frame0) FILTER (treatment = 'control') AS cc FROM k GROUP BY transcript),
atlas AS (SELECT transcript, CASE WHEN ct > 0 THEN xt / ct END AS treated_occupancy,
    cast(coalesce(ct, 0) AS bigint) AS treated_depth,
    CASE WHEN ct > 0 AND xt > 0 THEN sqrt(1 / xt + 1 / ct) END AS treated_rel_se,
    CASE WHEN cc > 0 THEN xc / cc END AS control_occupancy,
    cast(coalesce(cc, 0) AS bigint) AS control_depth,
    CASE WHEN cc > 0 AND xc > 0 THEN sqrt(1 / xc + 1 / cc) END AS control_rel_se,
    coalesce(ct, 0) >= 100 AND coalesce(cc, 0) >= 100 AS included FROM p)"""


def atlas(t: Tables) -> DataFrame:
    overlapping = t.spark.createDataFrame([], "transcript_id string")
    return nat.native_stop_occupancy(
        t("counts"), t("arms"), ("treated", "control"), LENGTHS,
        nat.excluded_transcripts(overlapping, t("genes")))


@query("native_stop_atlas", "counts", "genes", "arms", sql=f"""
WITH {ATLAS_SQL} SELECT transcript, treated_depth, control_depth, included,
  {_r("treated_occupancy treated_rel_se control_occupancy control_rel_se")} FROM atlas""")
def native_stop_atlas(t: Tables) -> DataFrame:
    return rounded(atlas(t))


@query("atlas_summary", "counts", "genes", "arms", sql=f"""
WITH {ATLAS_SQL} SELECT count(*) AS transcripts, count(*) FILTER (included) AS included,
  count(*) FILTER (included AND control_occupancy < 0.05) AS tight,
  round(avg(treated_occupancy - control_occupancy) FILTER (included), 6) AS treated_mean_lift
FROM atlas""")
def atlas_summary(t: Tables) -> DataFrame:
    return rounded(nat.atlas_summary(atlas(t), "control", ("treated", "control")))


@query("excluded_transcripts", "gtf", "genes", sql=f"""
WITH {GTF_SQL} SELECT transcript_id AS transcript FROM overlapping
UNION SELECT transcript FROM genes WHERE gene = 'VDR'""")
def excluded_transcripts(t: Tables) -> DataFrame:
    return nat.excluded_transcripts(itv.overlapping_other_genes(t("gtf")), t("genes"))


@query("labelled_atlas", "counts", "genes", "arms", "seqs", sql=f"""
WITH {ATLAS_SQL} SELECT s.transcript, round(s.gene_id % 100 / 100.0, 6) AS predicted,
  round(control_occupancy, 6) AS control_occupancy, round(treated_occupancy, 6)
    AS treated_occupancy, treated_depth,
  round(treated_occupancy - control_occupancy, 6) AS measured_lift,
  s.gene_id % 3 <> 0 AS mane_select,
  coalesce(treated_occupancy - control_occupancy IS NOT NULL, false) AS measurable
FROM seqs s LEFT JOIN (SELECT * FROM atlas WHERE included) AS a ON a.transcript = s.transcript""")
def labelled_atlas(t: Tables) -> DataFrame:
    predicted = t("seqs").select("transcript", (F.col("gene_id") % 100 / 100.0).alias("predicted"))
    chosen = t("seqs").where("gene_id % 3 <> 0").select("transcript")
    return rounded(nat.labelled_atlas(predicted, atlas(t), chosen, "treated", "control"))


_PAIRS_SQL = """m AS (SELECT * FROM paired_scores WHERE mane_select AND predicted IS NOT NULL
    AND measured IS NOT NULL),
cut AS (SELECT quantile_cont(predicted, 0.75) AS c FROM m),
labelled AS (SELECT p.*, CASE WHEN NOT (mane_select AND predicted IS NOT NULL
      AND measured IS NOT NULL) THEN '' WHEN predicted >= c AND measured >= 0.05 THEN 'both'
    WHEN predicted >= c THEN 'predicted only' WHEN measured >= 0.05 THEN 'measured only'
    ELSE 'neither' END AS grp FROM paired_scores p, cut)"""


def quadrants(t: Tables) -> DataFrame:
    return nat.four_quadrants(t("paired_scores"), "predicted", "measured")


@query("four_quadrants", "paired_scores", sql=f"""
WITH {_PAIRS_SQL} SELECT id, grp AS "group" FROM labelled""")
def four_quadrants(t: Tables) -> DataFrame:
    return quadrants(t).select("id", "group")


@query("spearman", "paired_scores", sql="""
WITH m AS (SELECT * FROM paired_scores WHERE predicted IS NOT NULL AND measured IS NOT NULL),
r AS (SELECT mane_select, rank() OVER (PARTITION BY mane_select ORDER BY predicted)
    + (count(*) OVER (PARTITION BY mane_select, predicted) - 1) / 2 AS a,
  rank() OVER (PARTITION BY mane_select ORDER BY measured)
    + (count(*) OVER (PARTITION BY mane_select, measured) - 1) / 2 AS b FROM m)
SELECT mane_select, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY mane_select""")
def spearman(t: Tables) -> DataFrame:
    return rounded(nat.spearman(t("paired_scores"), ["mane_select"], "predicted", "measured"))


@query("concordance", "paired_scores", sql=f"""
WITH own AS (SELECT * FROM paired_scores WHERE mane_select),
{nat.concordance_sql("own", "predicted", "measured", "id")} SELECT n, rho, low, high FROM agreed""")
def concordance(t: Tables) -> DataFrame:
    return nat.concordance(t("paired_scores").where("mane_select"), "predicted", "measured", "id")


@query("safety_summary", "paired_scores", sql=f"""
WITH {_PAIRS_SQL}, own AS (SELECT * FROM labelled WHERE mane_select),
{nat.concordance_sql("own", "predicted", "measured", "id", 1000)},
counted AS (SELECT count(*) AS canonical_stops_scored,
  count(*) FILTER (predicted IS NOT NULL AND measured IS NOT NULL) AS analysed,
  {", ".join(f"""count(*) FILTER (grp = '{q}' AND predicted IS NOT NULL AND measured IS NOT NULL)
    AS {q.replace(" ", "_")}""" for q in QUADRANTS)} FROM own)
SELECT counted.*, rho, low, high FROM counted, agreed""")
def safety_summary(t: Tables) -> DataFrame:
    return pay.safety_summary(quadrants(t), "predicted", "measured", "id")


@query("safety_points", "paired_scores", sql=f"""
WITH {_PAIRS_SQL} SELECT id, round_even(predicted, 6) AS predicted,
  round_even(measured, 6) AS measured, grp AS "group" FROM labelled
WHERE grp <> '' ORDER BY md5('0|' || cast(id AS varchar)), id LIMIT 200""")
def safety_points(t: Tables) -> DataFrame:
    return rounded(pay.safety_points(quadrants(t), "predicted", "measured", "id", 200))


# --- Codon occupancy ----------------------------------------------------------------------------

_SENSE = ", ".join(f"'{c}'" for c in SENSE_CODONS)


def _codon_sql(shift: int) -> str:
    return f"""pos AS (SELECT transcript, sequence, l_utr5,
    least(cast(floor((l_cds - 17) / 3) AS bigint) - 5,
          cast(floor((length(sequence) - l_utr5 - 18) / 3) AS bigint)) AS positions FROM seqs),
hit AS (SELECT 's' || cast(l_suppkey % 6 AS varchar) AS sample,
    't' || cast(l_partkey AS varchar) AS transcript, l_orderkey % 75 + {shift} AS idx,
    cast(sum(l_quantity) AS bigint) AS n FROM lineitem GROUP BY 1, 2, 3),
ins AS (SELECT hit.*, positions, substring(sequence, l_utr5 + 1 + 3 * idx, 3) AS codon
  FROM hit JOIN pos ON pos.transcript = hit.transcript
  WHERE idx BETWEEN 6 AND positions + 5),
dep AS (SELECT sample, transcript, sum(n) / any_value(positions) AS mean FROM ins
  GROUP BY 1, 2 HAVING sum(n) >= 100 AND any_value(positions) >= 64),
obs AS (SELECT i.sample, codon, sum(n / mean) AS ps FROM ins i JOIN dep
  ON dep.sample = i.sample AND dep.transcript = i.transcript GROUP BY 1, 2),
held AS (SELECT transcript, substring(sequence, l_utr5 + 1 + 3 * k, 3) AS codon, count(*) AS n
  FROM (SELECT *, unnest(range(6, positions + 6)) AS k FROM pos) AS e GROUP BY 1, 2),
avail AS (SELECT sample, codon, sum(n) AS n FROM dep JOIN held ON held.transcript = dep.transcript
  GROUP BY 1, 2),
tab AS (SELECT l.sample, c.codon, {sql_residue('c.codon')} AS amino_acid,
    CASE WHEN {shift} = 1 THEN 'a' ELSE 'p' END AS site,
    coalesce(ps, 0) / a.n AS occupancy, cast(coalesce(a.n, 0) AS bigint) AS positions, transcripts
  FROM (SELECT sample, count(*) AS transcripts FROM dep GROUP BY 1) AS l
  CROSS JOIN (SELECT unnest([{_SENSE}]) AS codon) AS c
  LEFT JOIN avail a ON a.sample = l.sample AND a.codon = c.codon
  LEFT JOIN obs ON obs.sample = l.sample AND obs.codon = c.codon)"""


def codon_counts_of(t: Tables) -> DataFrame:
    return t.dealt(t.table("lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 6).cast("string")).alias("sample"),
        F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("transcript"),
        F.lit(30).alias("length"), (F.col("l_orderkey") % 75).cast("int").alias("codon_index"),
        F.col("l_quantity").cast("bigint").alias("n")), "lineitem", "transcript")


def codon_windows(t: Tables) -> DataFrame:
    # Dealt like the counts, so that both meet without another exchange.
    return t.dealt(cod.scorable_windows(t("seqs").drop("sequence"),
                                        t("seqs").select("accession", "sequence")),
                   "lineitem", "transcript")


def codon_library(t: Tables, site: str = "a") -> DataFrame:
    return cod.library_table(codon_counts_of(t), codon_windows(t), site, lengths=(30,))


@query("codon_occupancy", "seqs", sql=f"""
WITH {_codon_sql(1)} SELECT sample, codon, amino_acid, site, round(occupancy, 6) AS occupancy,
  positions, transcripts FROM tab""")
def codon_occupancy(t: Tables) -> DataFrame:
    return rounded(codon_library(t))


@query("codon_occupancy_p_site", "seqs", sql=f"""
WITH {_codon_sql(0)} SELECT sample, codon, amino_acid, site, round(occupancy, 6) AS occupancy,
  positions, transcripts FROM tab""")
def codon_occupancy_p_site(t: Tables) -> DataFrame:
    return rounded(codon_library(t, "p"))


@query("codon_table", "seqs", sql=f"""
WITH {_codon_sql(1)} SELECT codon, amino_acid, site, round(avg(occupancy), 6) AS occupancy,
  round(stddev_samp(occupancy), 6) AS occupancy_sd, min(positions) AS positions,
  count(*) AS libraries FROM tab GROUP BY 1, 2, 3""")
def codon_table(t: Tables) -> DataFrame:
    return rounded(cod.aggregate_libraries(codon_library(t)))


@query("control_codon_table", "seqs", sql=f"""
WITH {_codon_sql(1)} SELECT codon, amino_acid, site, round(avg(occupancy), 6) AS occupancy,
  round(stddev_samp(occupancy), 6) AS occupancy_sd, min(positions) AS positions,
  count(*) AS libraries FROM tab WHERE sample IN (SELECT 's' || cast(s_suppkey % 6 AS varchar)
    FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY 1, 2, 3""")
def control_codon_table(t: Tables) -> DataFrame:
    """Every second library is the control; the others would be refused."""

    k = F.col("s_suppkey")
    arms = t.table("supplier").select(
        F.concat(F.lit("s"), (k % 6).cast("string")).alias("sample"),
        F.when(k % 2 == 0, "control").otherwise("treated").alias("treatment")).distinct()
    counts = codon_counts_of(t).join(F.broadcast(arms.where("treatment = 'control'").select(
        "sample")), "sample", "left_semi")
    return rounded(cod.control_table(counts, arms, "control", codon_windows(t), lengths=(30,)))


@query("codon_extremes", "seqs", sql=f"""
WITH {_codon_sql(1)}, agg AS (SELECT codon, amino_acid, avg(occupancy) AS occupancy FROM tab
  GROUP BY 1, 2)
(SELECT 'slowest' AS "end", codon, amino_acid, round(occupancy, 6) AS occupancy FROM agg
  ORDER BY agg.occupancy DESC, codon LIMIT 5)
UNION ALL (SELECT 'fastest', codon, amino_acid, round(occupancy, 6) FROM agg
  ORDER BY agg.occupancy, codon LIMIT 5)""")
def codon_extremes(t: Tables) -> DataFrame:
    return rounded(cod.extremes(cod.aggregate_libraries(codon_library(t))))


@query("codon_spread", "seqs", sql=f"""
WITH {_codon_sql(1)}, agg AS (SELECT codon, stddev_samp(occupancy) / avg(occupancy) AS s FROM tab
  GROUP BY 1) SELECT round(median(s), 6) AS median_spread FROM agg""")
def codon_spread(t: Tables) -> DataFrame:
    return rounded(cod.relative_spread(cod.aggregate_libraries(codon_library(t))))


@query("residue_occupancy", "codon_table", sql=f"""
SELECT amino_acid, round(coalesce(avg(occupancy) FILTER (site = 'a'), 0), 6) AS a,
  round(coalesce(avg(occupancy) FILTER (site = 'p'), 0), 6) AS p,
  count(*) FILTER (site = 'a') AS codons
FROM (SELECT *, {sql_residue('codon')} AS amino_acid FROM codon_table) AS c GROUP BY 1""")
def residue_occupancy(t: Tables) -> DataFrame:
    return rounded(cod.residue_occupancy(t("codon_table").withColumn(
        "amino_acid", nuc.residue(F.col("codon")))))


@query("codon_signature", "codon_table", sql=f"""
SELECT codon, {sql_residue('codon')} AS amino_acid, site, round_even(occupancy, 6) AS occupancy,
  round_even(occupancy_sd, 6) AS occupancy_sd, libraries FROM codon_table""")
def codon_signature(t: Tables) -> DataFrame:
    table = t("codon_table").withColumn("amino_acid", nuc.residue(F.col("codon")))
    return rounded(pay.codon_signature([table.where("site = 'a'"), table.where("site = 'p'")]))


# --- Reads --------------------------------------------------------------------------------------

_FIXED = ADAPTER.lstrip("N")
_PARTIAL = " ".join(
    f"WHEN mo <= {k} AND right(sequence, {k}) = '{_FIXED[:k]}' THEN length(sequence) - {k}"
    for k in range(len(_FIXED) - 1, 0, -1))
SURVEY_SQL = f"""loc AS (SELECT f.sample, cut_5p, CASE WHEN position('{_FIXED}' IN sequence) > 0
      THEN position('{_FIXED}' IN sequence) - 1 {_PARTIAL} END AS rs
  FROM (SELECT f0.*, r.cut_5p, greatest(1, adapter_overlap - 2) AS mo FROM fastq f0
        JOIN runs r ON r.sample = f0.sample WHERE assay = 'riboseq') AS f),
foot AS (SELECT sample, rs - cut_5p - 2 AS fp FROM loc),
ord AS (SELECT sample, fp, row_number() OVER (PARTITION BY sample ORDER BY fp) AS k
  FROM foot WHERE fp IS NOT NULL),
tot AS (SELECT sample, count(*) AS reads, count(fp) AS n FROM foot GROUP BY sample),
idx AS (SELECT *, greatest(1, least(n - 1, (n + 1) // 10)) AS j1,
    greatest(1, least(n - 1, (n + 1) * 9 // 10)) AS j9 FROM tot),
survey AS (SELECT i.sample, '{ADAPTER}' AS adapter_3p, any_value(reads) AS reads_surveyed,
    any_value(n) AS n, round_even(any_value(n) / any_value(reads), 5) AS adapter_rate,
    cast(round_even((max(fp) FILTER (k = j1) * (10 - ((n + 1) - j1 * 10))
      + max(fp) FILTER (k = j1 + 1) * ((n + 1) - j1 * 10)) / 10, 0) AS bigint) AS footprint_p10,
    cast(round_even((max(fp) FILTER (k = (n + 1) // 2) + max(fp) FILTER (k = (n + 2) // 2)) / 2,
      0) AS bigint) AS footprint_median,
    cast(round_even((max(fp) FILTER (k = j9) * (10 - ((n + 1) * 9 - j9 * 10))
      + max(fp) FILTER (k = j9 + 1) * ((n + 1) * 9 - j9 * 10)) / 10, 0) AS bigint) AS footprint_p90
  FROM idx i JOIN ord ON ord.sample = i.sample GROUP BY i.sample, i.n, i.j1, i.j9)"""


def surveyed(t: Tables) -> DataFrame:
    return rd.adapter_survey(rd.located_adapters(t("fastq"), t("runs")))


@query("adapter_survey", "fastq", "runs", sql=f"""
WITH {SURVEY_SQL} SELECT * EXCLUDE (n) FROM survey""")
def adapter_survey(t: Tables) -> DataFrame:
    return rounded(surveyed(t))


@query("refused_adapters", "fastq", "runs", sql=f"""
WITH {SURVEY_SQL} SELECT sample, CASE WHEN adapter_rate < 0.9 THEN 'adapter_rate'
  ELSE 'footprint' END AS refused_for FROM survey
WHERE adapter_rate < 0.9 OR footprint_median NOT BETWEEN 24 AND 26""")
def refused_adapters(t: Tables) -> DataFrame:
    return rd.refused_adapters(surveyed(t), minimum_rate=0.9, plausible=(24, 26))


@query("fastq_scan", "fastq", sql="""
SELECT sequence, count(*) AS reads FROM fastq GROUP BY sequence""")
def fastq_scan(t: Tables) -> DataFrame:
    """Reads written as four-line records and read back, whole records only."""

    path = scratch_path(t.spark, "fastq")
    record = F.concat(F.lit("@r\n"), "sequence", F.lit("\n+\n"), F.translate(
        "sequence", "ACGT", "IIII"))
    t("fastq").select(record.alias("value")).write.text(path)
    return src.read_fastq(t.spark, path).groupBy("sequence").agg(F.count(F.lit(1)).alias("reads"))


@query("fasta_scan", "seqs", sql="SELECT accession, sequence FROM seqs")
def fasta_scan(t: Tables) -> DataFrame:
    """Sequences written as wrapped lower-case FASTA and read back under a header key."""

    path = scratch_path(t.spark, "fasta")
    body = F.regexp_replace(F.lower("sequence"), "(.{60})", "$1\n")
    t("seqs").select(F.concat(F.lit(">"), "accession", F.lit("|ENSG|x extra words\n"), body)
                     .alias("value")).write.text(path)
    return src.sequences(src.read_fasta(t.spark, path), src.first_field())


@query("contaminants", "seqs", sql="""
SELECT '>' || accession || '|a|b|c|d|e|f|rRNA|' || chr(10) || sequence AS value FROM seqs
WHERE gene_id % 6 = 0
UNION ALL SELECT '>extra' || accession || chr(10) || sequence FROM seqs WHERE gene_id % 50 = 1""")
def contaminants(t: Tables) -> DataFrame:
    biotype = F.when(F.col("gene_id") % 6 == 0, "rRNA").otherwise("protein_coding")
    fasta = t("seqs").select(F.concat("accession", F.lit("|a|b|c|d|e|f|"), biotype, F.lit("|"))
                             .alias("header"), "sequence")
    extra = t("seqs").where("gene_id % 50 = 1").select(
        F.concat(F.lit("extra"), "accession").alias("header"), "sequence")
    return src.contaminants(fasta, extra)


@query("written_contaminants", "seqs", sql="""
SELECT accession || '|a->b|b|c|d|e|f|rRNA|' AS header, sequence,
  count(*) OVER () AS records FROM seqs WHERE gene_id % 6 = 0""")
def written_contaminants(t: Tables) -> DataFrame:
    """The sink, read back: headers may hold the mark that opens a record."""

    fasta = t("seqs").select(F.concat(
        "accession", F.lit("|a->b|b|c|d|e|f|"), F.when(F.col("gene_id") % 6 == 0, "rRNA").otherwise(
            "lncRNA"), F.lit("|")).alias("header"), "sequence")
    path = scratch_path(t.spark, "contaminants")
    records = src.write_contaminants(fasta, path)
    return src.read_fasta(t.spark, path).withColumn("records", F.lit(records).cast("bigint"))


_TRIM_SQL = """rep AS (SELECT 's' || cast(l_suppkey % 6 AS varchar) AS sample,
    count(*) AS reads_raw, count(*) FILTER (l_linenumber <= 6) AS reads_cleaned,
    count(*) FILTER (l_suppkey % 6 * 2 + 1 > l_linenumber) AS reads_with_adapter,
    cast(sum(l_quantity) AS bigint) AS basepairs_raw,
    cast(sum(l_quantity) FILTER (l_linenumber <= 6) AS bigint) AS basepairs_cleaned
  FROM lineitem GROUP BY 1),
trim AS (SELECT *, round_even(reads_cleaned / reads_raw, 5) AS reads_retained,
    round_even(reads_with_adapter / reads_raw, 5) AS adapter_rate FROM rep)"""


def trim_reports(t: Tables) -> DataFrame:
    """Per-library counts written as JSON reports and read back."""

    k, line = F.col("l_suppkey") % 6, F.col("l_linenumber")
    totals = t.table("lineitem").groupBy(F.concat(F.lit("s"), k.cast("string")).alias("sample")).agg(
        F.struct(F.count(F.lit(1)).alias("input"), F.count_if(line <= 6).alias("output"),
                 F.count_if(k * 2 + 1 > line).alias("read1_with_adapter")).alias("read_counts"),
        F.struct(F.sum("l_quantity").cast("bigint").alias("input"),
                 F.sum(F.when(line <= 6, F.col("l_quantity"))).cast("bigint").alias("output"))
        .alias("basepair_counts"))
    path = scratch_path(t.spark, "reports")
    totals.write.partitionBy("sample").json(path)
    return src.read_trim_reports(t.spark, path, src.folder_value("sample"))


@query("trim_summary", sql=f"WITH {_TRIM_SQL} SELECT * FROM trim")
def trim_summary(t: Tables) -> DataFrame:
    return rd.trim_summary(trim_reports(t))


@query("refused_trimming", sql=f"""
WITH {_TRIM_SQL} SELECT sample, adapter_rate FROM trim WHERE reads_with_adapter < 0.5 * reads_raw
  AND sample <> 's0'""")
def refused_trimming(t: Tables) -> DataFrame:
    expected = t("arms").where("sample <> 's0'")
    return rd.refused_trimming(rd.trim_summary(trim_reports(t)), expected)


@query("alignment_summary", sql="""
SELECT 's' || cast(l_suppkey % 6 AS varchar) AS sample, count(*) AS reads_input,
  count(*) FILTER (l_linenumber <= 4) AS reads_unique,
  round_even(100.0 * count(*) FILTER (l_linenumber <= 4) / count(*), 2) AS unique_rate,
  round_even(100.0 * count(*) FILTER (l_linenumber = 5) / count(*), 2) AS multimapped_rate,
  round_even(100.0 * count(*) FILTER (l_linenumber = 6) / count(*), 2) AS over_multimapped_rate,
  round_even(100.0 * count(*) FILTER (l_linenumber = 7) / count(*), 2)
    AS unmapped_too_short_rate, round_even(avg(l_quantity), 2) AS mapped_length_mean,
  round_even(round_even(100.0 * count(*) FILTER (l_linenumber <= 4) / count(*), 2)
    + round_even(100.0 * count(*) FILTER (l_linenumber = 5) / count(*), 2)
    + round_even(100.0 * count(*) FILTER (l_linenumber = 6) / count(*), 2), 2) AS mapped_rate
FROM lineitem GROUP BY 1""")
def alignment_summary(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")

    def rate(check) -> Column:
        return F.bround(100.0 * F.count_if(check) / F.count(F.lit(1)), 2).cast("string")

    def row(label: str, value, percent: str = "") -> Column:
        return F.concat(F.lit(" " * 9 + label + " |\t"), value, F.lit(percent))

    lines = t.table("lineitem").groupBy(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 6).cast("string")).alias("sample")).agg(F.array(
            row("Number of input reads", F.count(F.lit(1)).cast("string")),
            row("Uniquely mapped reads number", F.count_if(line <= 4).cast("string")),
            row("Uniquely mapped reads %", rate(line <= 4), "%"),
            row("% of reads mapped to multiple loci", rate(line == 5), "%"),
            row("% of reads mapped to too many loci", rate(line == 6), "%"),
            row("% of reads unmapped: too short", rate(line == 7), "%"),
            row("Average mapped length", F.bround(F.avg("l_quantity"), 2).cast("string")),
            F.lit("UNIQUE READS:")).alias("lines"))
    path = scratch_path(t.spark, "logs")
    lines.select("sample", F.explode("lines").alias("value")).write.partitionBy("sample").text(path)
    logs = src.read_aligner_logs(t.spark, path, src.folder_value("sample"))
    return rounded(rd.alignment_summary(logs))


@query("course_qc", "runs", sql="""
WITH st AS (SELECT p || '_' || cast(k AS varchar) || '_x' AS name, 40 + k % 9 AS gc,
    10 + k % 31 AS dup FROM (SELECT c_custkey AS k,
      (CASE WHEN c_custkey // 10 % 2 = 0 THEN 's' ELSE 'srr' END)
        || cast(c_custkey % 10 AS varchar) AS p FROM customer) AS c),
st2 AS (SELECT split_part(name, '_', 1) AS p, avg(gc) AS gc, avg(dup) AS dup FROM st GROUP BY 1),
tr AS (SELECT 's' || cast(s_suppkey % 10 AS varchar) AS sample, count(*) * 1000 AS raw
  FROM supplier GROUP BY 1)
SELECT r.sample, r.run_accession, raw AS reads_raw, raw - 100 AS reads_cleaned,
  round_even(100 * ((raw - 100) / raw), 3) AS reads_retained_percent,
  round_even(100 * 0.25, 3) AS adapter_percent, round_even(a.gc, 3) AS gc_raw_percent,
  round_even(b.gc, 3) AS gc_cleaned_percent, round_even(a.dup, 3) AS duplicates_raw_percent,
  round_even(b.dup, 3) AS duplicates_cleaned_percent
FROM runs r JOIN tr ON tr.sample = r.sample JOIN st2 a ON a.p = r.run_accession
JOIN st2 b ON b.p = r.sample WHERE assay = 'rnaseq'""")
def course_qc(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    # Keys name libraries and runs by turns, so both sides of the summary find their rows.
    prefix = F.concat(F.when(F.floor(k / 10) % 2 == 0, "s").otherwise("srr"), (k % 10).cast("string"))
    stats = t.table("customer").select(
        F.concat(prefix, F.lit("_"), k.cast("string"), F.lit("_x")).alias("Sample"),
        (40 + k % 9).cast("double").alias("percent_gc"),
        (10 + k % 31).cast("double").alias("percent_duplicates"))
    trimming = t.table("supplier").groupBy(
        F.concat(F.lit("s"), (F.col("s_suppkey") % 10).cast("string")).alias("sample")).agg(
        (F.count(F.lit(1)) * 1000).alias("reads_raw")).select(
        "*", (F.col("reads_raw") - 100).alias("reads_cleaned"),
        ((F.col("reads_raw") - 100) / F.col("reads_raw")).alias("reads_retained"),
        F.lit(0.25).alias("adapter_rate"))
    return rounded(rd.course_qc(t("runs"), stats, trimming, "d1"))


@query("run_files", "runs", sql="""
SELECT sample, 'fastq_1' AS read, fastq_1_url AS url, fastq_1_md5 AS md5 FROM runs
UNION ALL SELECT sample, 'fastq_2', fastq_2_url, fastq_2_md5 FROM runs
WHERE fastq_2_url IS NOT NULL""")
def run_files(t: Tables) -> DataFrame:
    return src.run_files(t("runs"))


@query("dataset_arms", "runs", sql="""
SELECT sample, 'tr' || right(sample, 1) AS treatment, cast(1 AS bigint) AS replicate FROM runs
WHERE assay = 'riboseq'""")
def dataset_arms(t: Tables) -> DataFrame:
    runs = t("runs").withColumns({
        "treatment": F.concat(F.lit("tr"), F.right("sample", F.lit(1))), "replicate": F.lit(1)})
    return rounded(eff.arms_of(runs, "d1"))


@query("file_manifest", sql="""
WITH lines AS (SELECT c_nationkey, c_custkey || ':' || c_name || chr(10) AS line, c_custkey
               FROM customer),
held AS (SELECT 'n' || c_nationkey AS name, sum(strlen(line))::BIGINT AS bytes,
  sha256(string_agg(line, '' ORDER BY c_custkey)) AS sha256, FALSE AS missing
  FROM lines GROUP BY c_nationkey)
SELECT * FROM held UNION ALL
SELECT name, NULL, NULL, TRUE FROM (SELECT 'n' || n_nationkey AS name FROM nation
                                    UNION SELECT 'absent')
WHERE name NOT IN (SELECT name FROM held)""")
def file_manifest(t: Tables) -> DataFrame:
    """A file per nation listing its customers, by size and digest, and expected names not there.

    Digests are of known bytes; a chunk of 2,048 bytes makes the longer files be read in pieces.
    """

    path = scratch_path(t.spark, "manifest")
    lines = t.table("customer").select(
        F.col("c_nationkey").alias("name"), "c_custkey",
        F.concat_ws(":", F.col("c_custkey").cast("string"), "c_name").alias("value"))
    # All customers of a nation are one file, in order, so one task writes each.
    lines.repartition("name").sortWithinPartitions("name", "c_custkey").select(
        "name", "value").write.partitionBy("name").text(path)
    listed = src.file_manifest(t.spark, [path], chunk=2048).where("path like '%/part-%'").select(
        F.concat(F.lit("n"), F.regexp_extract("path", "name=([^/]+)/", 1)).alias("path"), "bytes",
        "sha256")
    listed = cut_lineage(listed, name="manifest-digests")
    expected = t.table("nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name")).union(
        t.spark.range(1).select(F.lit("absent")))
    gone = src.missing_files(listed, expected).select(
        "name", F.lit(None).cast("bigint").alias("bytes"),
        F.lit(None).cast("string").alias("sha256"), F.lit(True).alias("missing"))
    return listed.select(F.col("path").alias("name"), "bytes", "sha256",
                         F.lit(False).alias("missing")).unionByName(gone)


@query("tsv_roundtrip", "contexts", sql="""
SELECT variant_id, ordinal, gene_symbol, scoreable, stop_type, original_aa,
  cast(nt_to_last_junction AS bigint) AS nt_to_last_junction,
  cast(review_stars AS bigint) AS review_stars FROM contexts""")
def tsv_roundtrip(t: Tables) -> DataFrame:
    rows = t("contexts").select("variant_id", "ordinal", "gene_symbol", "scoreable", "stop_type",
                                "original_aa", "nt_to_last_junction", "review_stars")
    path = scratch_path(t.spark, "tables")
    src.write_tsv(rows, f"{path}/one.contexts.tsv")
    back = src.gather(t.spark, path, "contexts", ", ".join(f"{n} {k}" for n, k in rows.dtypes))
    return rounded(back)


# --- Expression ---------------------------------------------------------------------------------

_TPM_SQL = """tpm AS (SELECT gene_id, library,
  (count / (length / 1000.0)) / sum(count / (length / 1000.0)) OVER (PARTITION BY library) * 1e6
    AS tpm FROM gene_counts)"""
_CLASS_SQL = """CASE WHEN coalesce(gene_symbol, '') LIKE 'MT-%' THEN 'mitochondrial'
  WHEN regexp_matches(coalesce(gene_symbol, ''), '^(RN7SL|RN7SK|RNU[0-9])') THEN 'structural'
  ELSE 'nuclear' END"""


@query("gene_count_scan", "gene_counts", sql="""
SELECT gene_id, length, library, sum(count) OVER (PARTITION BY gene_id, library)::BIGINT AS count
FROM gene_counts
UNION ALL SELECT gene_id, any_value(length), l, 0 FROM gene_counts,
  (VALUES ('lib0'), ('lib1'), ('lib2'), ('lib3')) AS x(l) GROUP BY gene_id, l
  HAVING count(*) FILTER (library = l) = 0""")
def gene_count_scan(t: Tables) -> DataFrame:
    """Counts written as a wide table headed by alignment paths, and read back in long form."""

    libraries = [f"lib{k}" for k in range(4)]
    wide = t("gene_counts").groupBy("gene_id", "length").pivot("library", libraries).sum("count")
    named = wide.select(F.col("gene_id").alias("Geneid"), F.col("length").alias("Length"), *[
        F.coalesce(c, F.lit(0)).alias(f"results/reads/{c}.sorted.bam") for c in libraries])
    path = scratch_path(t.spark, "genecounts")
    src.write_tsv(named, path)
    return src.read_gene_counts(t.spark, path)


@query("library_depth", "gene_counts", sql="""
SELECT library, cast(sum(count) AS bigint) AS depth FROM gene_counts GROUP BY library""")
def library_depth(t: Tables) -> DataFrame:
    return exp.library_depth(t("gene_counts"))


@query("tpm", "gene_counts", sql=f"""
WITH {_TPM_SQL} SELECT gene_id, library, round(tpm, 6) AS tpm FROM tpm""")
def tpm(t: Tables) -> DataFrame:
    return rounded(exp.tpm(t("gene_counts")))


@query("composition", "gene_counts", "symbols", sql=f"""
WITH {_TPM_SQL} SELECT {_CLASS_SQL} AS gene_class, library, round(sum(tpm) / 1e4, 6) AS percent
FROM tpm LEFT JOIN symbols ON symbols.gene_id = tpm.gene_id GROUP BY 1, 2""")
def composition(t: Tables) -> DataFrame:
    return rounded(exp.composition(exp.tpm(t("gene_counts")), t("symbols")))


@query("top_expressed", "gene_counts", "symbols", sql=f"""
WITH {_TPM_SQL}, m AS (SELECT tpm.gene_id, coalesce(gene_symbol, split_part(tpm.gene_id, '.', 1))
    AS gene_symbol, sum(tpm) / (SELECT count(DISTINCT library) FROM gene_counts) AS mean_tpm
  FROM tpm LEFT JOIN symbols ON symbols.gene_id = tpm.gene_id GROUP BY 1, 2),
r AS (SELECT * FROM m WHERE {_CLASS_SQL} NOT IN ('mitochondrial', 'structural')
  ORDER BY mean_tpm DESC, gene_id LIMIT 20)
SELECT r.gene_id, gene_symbol, round(mean_tpm, 6) AS mean_tpm, library, round(tpm, 6) AS tpm
FROM r JOIN tpm ON tpm.gene_id = r.gene_id""")
def top_expressed(t: Tables) -> DataFrame:
    return rounded(exp.top_expressed(exp.tpm(t("gene_counts")), t("symbols"),
                                     exclude=("mitochondrial", "structural")))
