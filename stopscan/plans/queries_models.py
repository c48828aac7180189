"""Queries over the measured library: fits, splits, controls, kinetics, support, roadmap, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.functions.binomial import MODELS
from stopscan.functions.fixed import PERMUTATIONS_REQUIRED, SEED
from stopscan.operators import contracts as ct
from stopscan.operators import decay as dec
from stopscan.operators import evaluation as ev
from stopscan.operators import kinetics as kin
from stopscan.operators import model as mod
from stopscan.operators import payloads as pay
from stopscan.operators import roadmap as road
from stopscan.operators import support as sup
from stopscan.operators.landscape import landscape
from stopscan.operators.permutation import permuted_sql
from stopscan.operators.ranking import quantiles
from stopscan.operators.resampling import bootstrap_mean_ci, bootstrap_mean_sql
from stopscan.plans.carriers import Tables
from stopscan.plans.queries_variants import (
    DNA_SQL,
    LANDSCAPE_SQL,
    PREDICTORS_SQL,
    sql_residue,
)
from stopscan.plans.registry import query, rounded
from stopscan.session import cut_lineage, scratch_path
from stopscan.streaming import incremental as inc

CELLS = {"C": (("stop",), ("down",), ("stop", "down"))}
"""A saturated formula of two factors: its fit is the cell mean, which SQL can state."""

# A library of few levels, so the two-factor cells are all filled.
COARSE_SQL = """coarse AS (SELECT therapy_id, drug, row, gene, stop_type,
    substring(up_123nt, 1, 1) AS up_123nt, substring(down_123nt, 1, 1) AS down_123nt, RT_binomial
  FROM library)"""


def coarse(t: Tables) -> DataFrame:
    return t("library").withColumns({
        "up_123nt": F.substring("up_123nt", 1, 1), "down_123nt": F.substring("down_123nt", 1, 1)})


def folds(t: Tables) -> DataFrame:
    """The coarse library, its rows marked with the random rounds they train in."""

    return ev.mark_folds(coarse(t), "published_random_cv")


# --- Splits -------------------------------------------------------------------------------------


def _rounds_sql(group: str, source: str = "library") -> str:
    return f"""grp AS (SELECT DISTINCT therapy_id, {group} AS g FROM {source}),
size AS (SELECT therapy_id, floor(count(*) * 0.9) AS keep FROM grp GROUP BY 1),
rk AS (SELECT grp.therapy_id, round, g, row_number() OVER (PARTITION BY grp.therapy_id, round
    ORDER BY md5('721|' || cast(round AS varchar) || '|' || g)) AS k
  FROM grp, (SELECT unnest(range(1, 11)) AS round) AS r),
rounds AS (SELECT l.therapy_id, round, row FROM {source} l JOIN rk ON rk.therapy_id = l.therapy_id
    AND rk.g = {group} JOIN size ON size.therapy_id = l.therapy_id WHERE k <= keep)"""


_GROUPS = {"published_random_cv": "cast(row AS varchar)", "grouped_by_gene": "gene",
           "grouped_by_sequence_cluster": "up_123nt || '|' || down_123nt"}


def _register_split(config: str, group: str) -> None:
    @query(f"split_{config}", "library", sql=f"""
WITH {_rounds_sql(group)} SELECT therapy_id, cast(round AS bigint) AS round, row FROM rounds""")
    def split(t: Tables) -> DataFrame:
        return rounded(ev.split(t("library"), config))


for _config, _group in _GROUPS.items():
    _register_split(_config, _group)


@query("stratified_partitions", "library", sql="""
WITH q AS (SELECT therapy_id, quantile_cont(RT_binomial, [0.2, 0.4, 0.6, 0.8]) AS c FROM library
  GROUP BY 1),
s AS (SELECT l.therapy_id, row, len(list_filter(c, lambda x: RT_binomial > x)) AS st
  FROM library l JOIN q ON q.therapy_id = l.therapy_id),
n AS (SELECT therapy_id, st, ceil(count(*) * 0.9) AS keep FROM s GROUP BY 1, 2),
rk AS (SELECT s.*, round, row_number() OVER (PARTITION BY therapy_id, st, round
    ORDER BY md5('721|' || cast(round AS varchar) || '|' || cast(row AS varchar))) AS k
  FROM s, (SELECT unnest(range(1, 4)) AS round) AS r)
SELECT rk.therapy_id, cast(round AS bigint) AS round, row FROM rk JOIN n
  ON n.therapy_id = rk.therapy_id AND n.st = rk.st WHERE k <= keep""")
def stratified_partitions(t: Tables) -> DataFrame:
    return rounded(ev.stratified_partitions(t("library"), rounds=3))


# --- Model --------------------------------------------------------------------------------------


@query("fit_cells", "library", sql=f"""
WITH {COARSE_SQL} SELECT therapy_id, stop_type, down_123nt, round(avg(RT_binomial), 8) AS predicted
FROM coarse GROUP BY 1, 2, 3""")
def fit_cells(t: Tables) -> DataFrame:
    grid = mod.fit(coarse(t), terms=CELLS["C"])
    return rounded(grid.groupBy("therapy_id", "stop_type", "down_123nt").agg(
        F.max("predicted").alias("predicted")), 8)


@query("fit_readthrough_model")
def fit_readthrough_model(t: Tables) -> DataFrame:
    return rounded(mod.fit(t("library")))


#: The columns of the declared formula, as the groups whose sums its likelihood equations fix.
EQUATIONS = {"stop": ("stop_type",), "down": ("down_123nt",), "up": ("up_123nt",),
             "stop:down": ("stop_type", "down_123nt")}


def _equations_sql() -> str:
    return " UNION ALL ".join(f"""SELECT therapy_id, '{term}' AS term, {" || '|' || ".join(columns)}
  AS level, count(*) AS n, round(sum(RT_binomial), 6) AS observed, TRUE AS met
FROM library GROUP BY 1, 2, 3""" for term, columns in EQUATIONS.items())


@query("score_equations", "library", sql=_equations_sql())
def score_equations(t: Tables) -> DataFrame:
    """At the maximum of the likelihood, and nowhere else, fitted sums equal the observed sums over
    the rows of every column of the design."""

    rows = t("library").join(mod.fit(t("library")), ["therapy_id", *mod.CELL])
    cells = cut_lineage(rows.groupBy("therapy_id", *mod.CELL).agg(
        F.count(F.lit(1)).alias("n"), F.sum("RT_binomial").alias("observed"),
        F.sum("predicted").alias("fitted")))
    out = None
    for term, columns in EQUATIONS.items():
        summed = cells.groupBy("therapy_id", F.lit(term).alias("term"), F.concat_ws(
            "|", *columns).alias("level")).agg(*[F.sum(c).alias(c) for c in (
                "n", "observed", "fitted")])
        out = summed if out is None else out.unionByName(summed)
    return rounded(out.select("therapy_id", "term", "level", "n", "observed", (F.abs(
        F.col("observed") - F.col("fitted")) <= 1e-5 * F.col("n")).alias("met")))


@query("model_coefficients")
def model_coefficients(t: Tables) -> DataFrame:
    return rounded(mod.coefficients(coarse(t)), 5)


HELD_SQL = f"""{COARSE_SQL}, {_rounds_sql("cast(row AS varchar)", "coarse")},
tr AS (SELECT c.therapy_id, round, stop_type, down_123nt, avg(RT_binomial) AS m, count(*) AS nt
  FROM coarse c JOIN rounds r ON r.therapy_id = c.therapy_id AND r.row = c.row GROUP BY 1, 2, 3, 4),
held AS (SELECT c.therapy_id, x.round, c.row, m AS predicted, RT_binomial AS observed, nt,
    c.stop_type, c.down_123nt
  FROM coarse c CROSS JOIN (SELECT unnest(range(1, 11)) AS round) AS x
  LEFT JOIN rounds r ON r.therapy_id = c.therapy_id AND r.round = x.round AND r.row = c.row
  JOIN tr ON tr.therapy_id = c.therapy_id AND tr.round = x.round
    AND tr.stop_type = c.stop_type AND tr.down_123nt = c.down_123nt WHERE r.row IS NULL)"""


@query("held_out_predictions", "library", sql=f"""
WITH {HELD_SQL} SELECT therapy_id, cast(round AS bigint) AS round, row,
  round(predicted, 6) AS predicted, round(observed, 6) AS observed FROM held""")
def held_out_predictions(t: Tables) -> DataFrame:
    return rounded(mod.held_out_predictions(folds(t), terms=CELLS["C"]))


@query("cross_validation", "library", sql=f"""
WITH {HELD_SQL} SELECT therapy_id, cast(round AS bigint) AS round, 'C' AS model,
  round(corr(predicted, observed) ** 2, 6) AS r2, count(*) AS held_out, TRUE AS converged
FROM held GROUP BY 1, 2""")
def cross_validation(t: Tables) -> DataFrame:
    return rounded(mod.evaluate(mod.fold_cells(folds(t)), models=CELLS))


@query("r_squared", "library", sql=f"""
WITH {HELD_SQL} SELECT therapy_id, cast(round AS bigint) AS round,
  round(corr(predicted, observed) ** 2, 6) AS r2, count(*) AS held_out FROM held GROUP BY 1, 2""")
def r_squared(t: Tables) -> DataFrame:
    found = mod.held_out_predictions(folds(t), terms=CELLS["C"])
    return rounded(mod.r_squared(found, ["therapy_id", "round"]))


@query("relative_error", "library", sql=f"""
WITH {HELD_SQL} SELECT therapy_id,
  round(quantile_cont(abs(predicted - observed) / predicted, 0.95), 6) AS spread
FROM held GROUP BY 1""")
def relative_error(t: Tables) -> DataFrame:
    return rounded(mod.relative_error(mod.held_out_predictions(folds(t), terms=CELLS["C"])))


@query("score_contexts", "contexts", "library", sql=f"""
WITH {COARSE_SQL}, m AS (SELECT therapy_id, stop_type, down_123nt, avg(RT_binomial) AS p
  FROM coarse GROUP BY 1, 2, 3),
sp AS (SELECT therapy_id, 0.1 * (1 + cast(right(therapy_id, 1) AS int)) * 4.0 AS s FROM
  (SELECT DISTINCT therapy_id FROM library) AS d),
c AS (SELECT *, CASE WHEN ordinal % 17 = 0 THEN 'zz' ELSE substring(down_123nt, 1, 1) END AS dn
  FROM contexts WHERE scoreable)
SELECT variant_id, gene_symbol, cast(protein_position AS bigint) AS protein_position, c.stop_type,
  sp.therapy_id, 'HEK293T' AS biological_context, round(p, 8) AS readthrough_predicted,
  round(CASE WHEN p IS NOT NULL THEN greatest(p * (1 - s), 0) END, 8) AS readthrough_low,
  round(p * (1 + s), 8) AS readthrough_high,
  CASE WHEN p IS NULL THEN 'missing' ELSE 'present' END AS status,
  CASE WHEN p IS NULL THEN 'not_available' ELSE '' END AS reason,
  cast(review_stars AS bigint) AS review_stars
FROM c CROSS JOIN sp LEFT JOIN m ON m.therapy_id = sp.therapy_id AND m.stop_type = c.stop_type
  AND m.down_123nt = dn""")
def score_contexts(t: Tables) -> DataFrame:
    model = mod.fit(coarse(t), terms=CELLS["C"])
    spreads = t("library").select("therapy_id").distinct().withColumn(
        "spread", F.lit(0.1) * (1 + F.right("therapy_id", F.lit(1)).cast("int")) * 4.0)
    placed = t("contexts").withColumns({
        "up_123nt": F.substring("up_123nt", 1, 1),
        "down_123nt": F.when(F.col("ordinal") % 17 == 0, "zz").otherwise(
            F.substring("down_123nt", 1, 1))})
    return rounded(mod.score(placed, model, spreads), 8)


@query("stratified_gain", "library", sql=f"""
WITH {HELD_SQL}, rc AS (SELECT c.therapy_id, x.round, c.row, coalesce(tr.nt, 0) AS nt
  FROM coarse c CROSS JOIN (SELECT unnest(range(1, 11)) AS round) AS x
  LEFT JOIN tr ON tr.therapy_id = c.therapy_id AND tr.round = x.round
    AND tr.stop_type = c.stop_type AND tr.down_123nt = c.down_123nt),
md AS (SELECT therapy_id, round, median(nt) AS med FROM rc WHERE nt > 0 GROUP BY 1, 2)
SELECT h.therapy_id, cast(h.round AS bigint) AS round, 'C' AS model,
  CASE WHEN nt < med THEN 'thin' ELSE 'supported' END AS support,
  round(corr(predicted, observed) ** 2, 6) AS r2, count(*) AS held_out
FROM held h JOIN md ON md.therapy_id = h.therapy_id AND md.round = h.round
GROUP BY 1, 2, 4 HAVING count(*) >= 3""")
def stratified_gain(t: Tables) -> DataFrame:
    return rounded(mod.stratified_gain(mod.fold_cells(folds(t)), models=CELLS))


@query("reliability", sql="""
WITH s AS (SELECT 'tr' || cast(l_suppkey % 3 AS varchar) AS treatment, l_orderkey AS identifier,
    1 + l_linenumber % 2 AS replicate, max(l_quantity + l_orderkey % 40) AS f FROM lineitem
  GROUP BY 1, 2, 3),
w AS (SELECT treatment, identifier, max(f) FILTER (replicate = 1) AS a,
    max(f) FILTER (replicate = 2) AS b FROM s GROUP BY 1, 2),
r AS (SELECT treatment, count(*) AS n, corr(a, b) AS r FROM w WHERE a IS NOT NULL
  AND b IS NOT NULL GROUP BY 1)
SELECT treatment, n AS variants, round(r, 6) AS r, round(r * r, 6) AS single_replicate,
  round(2 * r / (1 + r), 6) AS ceiling FROM r""")
def reliability(t: Tables) -> DataFrame:
    read = t.table("lineitem").select(
        F.concat(F.lit("tr"), (F.col("l_suppkey") % 3).cast("string")).alias("treatment"),
        F.col("l_orderkey").alias("identifier"),
        (F.col("l_linenumber") % 2 + 1).alias("replicate"),
        (F.col("l_quantity") + F.col("l_orderkey") % 40).alias("fitness"))
    samples = t.dealt(read, "lineitem", "treatment", "identifier").groupBy(
        "treatment", "identifier", "replicate").agg(F.max("fitness").alias("fitness_rep"))
    merged = samples.groupBy("treatment", "identifier").agg(
        (F.avg("fitness_rep") / 100).alias("RT_binomial"))
    return rounded(mod.reliability(samples.join(merged, ["treatment", "identifier"])))


@query("model_parity", "library", sql=f"""
WITH {HELD_SQL}, m AS (SELECT therapy_id, round, corr(predicted, observed) ** 2 AS r2 FROM held
  GROUP BY 1, 2)
SELECT therapy_id AS drug, round_even(avg(r2), 6) AS r2_mean,
  round_even(stddev_samp(r2), 6) AS r2_sd, count(*) AS rounds,
  CASE WHEN therapy_id <> 'th2' THEN 0.9::DOUBLE END AS ceiling FROM m GROUP BY 1""")
def model_parity(t: Tables) -> DataFrame:
    metrics = mod.evaluate(mod.fold_cells(folds(t)), models=CELLS).withColumnRenamed(
        "therapy_id", "drug")
    ceilings = t("library").select(F.col("therapy_id").alias("treatment")).distinct().where(
        "treatment <> 'th2'").withColumn("ceiling", F.lit(0.9))
    return rounded(mod.model_parity(metrics, ceilings))


@query("eligible_labels", sql="""
SELECT o_orderkey AS identifier, 'tr' || cast(o_custkey % 6 AS varchar) AS treatment FROM orders
WHERE 1 + o_orderkey % 2 = 2 AND o_orderkey % 40 > 15 AND o_custkey % 9 <> 0
  AND o_totalprice > 20000""")
def eligible_labels(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    samples = t.table("orders").select(
        o.alias("identifier"), F.concat(F.lit("tr"), (F.col("o_custkey") % 6).cast("string"))
        .alias("treatment"), (o % 2 + 1).alias("replicate"), (o % 40).alias("reads_allbins"),
        F.when(F.col("o_custkey") % 9 == 0, "yes").otherwise("no").alias("viral"),
        F.when(F.col("o_totalprice") > 20000, F.col("o_totalprice")).alias("RT"))
    return mod.eligible_labels(samples).select("identifier", "treatment")


@query("reporter_offsets", "contexts", sql="""
WITH m AS (SELECT substring(lower(translate(md5(variant_id), '0123456789abcdef',
    'ACGTACGTACGTACGT')), 1, 30) || translate(up_123nt || stop_type || down_123nt, 'u', 't')
    || 'acgtacgtac' AS s, translate(up_123nt || stop_type || down_123nt, 'u', 't') AS motif
  FROM contexts WHERE scoreable)
SELECT k AS "offset" FROM (SELECT unnest(range(1, 42)) AS k) AS r
WHERE NOT EXISTS (SELECT 1 FROM m WHERE substring(s, k, 9) <> motif)""")
def reporter_offsets(t: Tables) -> DataFrame:
    nts = F.lower(F.translate(F.md5("variant_id"), "0123456789abcdef", "ACGTACGTACGTACGT"))
    motif = F.translate(F.concat("up_123nt", "stop_type", "down_123nt"), "u", "t")
    measured = t("contexts").where("scoreable").select(
        "up_123nt", "stop_type", "down_123nt",
        F.concat(F.substring(nts, 1, 30), motif, F.lit("acgtacgtac")).alias("nt_seq"))
    return rounded(mod.reporter_offsets(measured, 49))


# --- Kinetics -----------------------------------------------------------------------------------

_SCORES_SQL = "sc AS (SELECT codon, occupancy FROM codon_table WHERE site = 'a')"


@query("attach_kinetics", "library", "codon_table", sql=f"""
WITH {_SCORES_SQL} SELECT row, round(a.occupancy, 6) AS k_up, round(b.occupancy, 6) AS k_down
FROM library l LEFT JOIN sc a ON a.codon = {DNA_SQL.format('up_123nt')}
LEFT JOIN sc b ON b.codon = {DNA_SQL.format('down_123nt')}""")
def attach_kinetics(t: Tables) -> DataFrame:
    """Every row of the library; a stop triplet has no score, and a strict attach refuses it."""

    scores = kin.codon_scores(t("codon_table"))
    return rounded(kin.attach(t("library"), scores, strict=False).select("row", "k_up", "k_down"))


@query("unscored_triplets", "library", "codon_table", sql=f"""
WITH {_SCORES_SQL}, x AS (SELECT 'up_123nt' AS column_name, {DNA_SQL.format('up_123nt')} AS codon
  FROM library UNION ALL SELECT 'down_123nt', {DNA_SQL.format('down_123nt')} FROM library)
SELECT column_name, codon, count(*) AS rows FROM x
WHERE codon NOT IN (SELECT codon FROM sc) GROUP BY 1, 2""")
def unscored_triplets(t: Tables) -> DataFrame:
    return kin.unscored_triplets(t("library"), kin.codon_scores(t("codon_table")))


@query("repeated_codons", sql="""
SELECT codon, count(*) AS rows FROM (SELECT substring('ACGT', 1 + cast(p_partkey % 4 AS int), 1) ||
  'CC' AS codon FROM part) AS p GROUP BY 1 HAVING count(*) > 1""")
def repeated_codons(t: Tables) -> DataFrame:
    codon = F.concat(F.substring(F.lit("ACGT"), (F.col("p_partkey") % 4 + 1).cast("int"),
                                 F.lit(1)), F.lit("CC"))
    return kin.repeated_codons(t.table("part").select(codon.alias("codon"), F.lit("a")
                                                      .alias("site")))


def _permuted_sql(family: str) -> str:
    return f"""{_SCORES_SQL}, pr AS (SELECT p, codon, occupancy, {family} AS fam FROM sc,
    (SELECT unnest(range(0, 20)) AS p) AS r),
rk AS (SELECT *, row_number() OVER (PARTITION BY p, fam ORDER BY codon) AS a,
    row_number() OVER (PARTITION BY p, fam ORDER BY md5('721|' || cast(p AS varchar) || '|'
      || codon), codon) AS b FROM pr)
SELECT x.p AS permutation, x.codon, round(y.occupancy, 6) AS occupancy FROM rk x JOIN rk y
  ON y.p = x.p AND y.fam = x.fam AND y.b = x.a"""


def permuted(t: Tables, family: str) -> DataFrame:
    indices = t.spark.range(20).withColumnRenamed("id", "permutation")
    return rounded(kin.permuted_scores(kin.codon_scores(t("codon_table")), family, indices))


@query("permuted_scores_global", "codon_table", sql="WITH " + _permuted_sql("'*'"))
def permuted_scores_global(t: Tables) -> DataFrame:
    return permuted(t, "global")


@query("permuted_scores_context_matched", "codon_table",
       sql="WITH " + _permuted_sql(sql_residue("codon")))
def permuted_scores_context_matched(t: Tables) -> DataFrame:
    return permuted(t, "context_matched")


@query("shuffle_within_gene", "library", sql=f"""
WITH k AS (SELECT drug, gene, row, RT_binomial AS ku, RT_binomial * 2 AS kd FROM library),
{permuted_sql("k", ("drug", "gene"), ("ku", "kd"), SEED)}
SELECT drug, gene, row, round(ku, 6) AS k_up, round(kd, 6) AS k_down FROM moved""")
def shuffle_within_gene(t: Tables) -> DataFrame:
    attached = t("library").select("drug", "gene", "row", F.col("RT_binomial").alias("k_up"),
                                   (F.col("RT_binomial") * 2).alias("k_down"))
    return rounded(kin.shuffled_within_gene(attached))


def sense_library(t: Tables) -> DataFrame:
    """Every row of the library, with its whole triplets. The codon table scores no stop, and a measured
    library holds none beside its own, so a triplet that spells one ends in c."""

    def sense(column: str) -> Column:
        triplet = F.col(column)
        return F.when(triplet.isin("uaa", "uag", "uga"), F.concat(
            F.substring(triplet, 1, 2), F.lit("c"))).otherwise(triplet)

    return t("library").withColumns({c: sense(c) for c in ("up_123nt", "down_123nt")})


def drug_folds(t: Tables) -> DataFrame:
    """The library and its rounds, written once: several fits read it."""

    return cut_lineage(ev.mark_folds(sense_library(t), "grouped_by_gene", ("drug",)))


@query("head_to_head")
def head_to_head(t: Tables) -> DataFrame:
    scores, marked = kin.codon_scores(t("codon_table")), drug_folds(t)
    out = kin.head_to_head(marked, scores)
    for kind in kin.FAMILIES:
        out = out.unionByName(kin.head_to_head(
            marked, scores, kind, {m: MODELS[m] for m in ("B", "K1", "K2")}))
    return rounded(out, 5)


#: Permutations of each family: those that a complete null has.
NULL_PERMUTATIONS = PERMUTATIONS_REQUIRED


@query("null_gains")
def null_gains(t: Tables) -> DataFrame:
    scores, marked = kin.codon_scores(t("codon_table")), drug_folds(t)
    wanted = inc.index_range(t.spark, kin.FAMILIES, NULL_PERMUTATIONS)
    return rounded(kin.null_gains(marked, scores, kin.baseline_scores(marked), wanted, chunk=64), 5)


@query("observed_gains")
def observed_gains(t: Tables) -> DataFrame:
    """The baseline is written by the first run and read by the second."""

    marked, path = drug_folds(t), scratch_path(t.spark, "baseline")
    kin.kept_baseline(marked, path)
    return rounded(kin.observed_gains(marked, kin.codon_scores(t("codon_table")),
                                      kin.kept_baseline(marked, path)), 5)


NULL_SQL = """nul AS (SELECT 'f' || cast(o_custkey % 3 AS varchar) AS shuffle,
    o_custkey AS permutation, 'th' || cast(o_orderkey % 4 AS varchar) AS drug,
    avg(floor(o_totalprice)) / 1000000.0 AS gain FROM orders GROUP BY 1, 2, 3),
obs AS (SELECT 'th' || cast(o_orderkey % 4 AS varchar) AS drug, o_orderkey % 10 AS round,
    max(floor(o_totalprice)) / 1000000.0 - 0.1 * (o_orderkey % 4) AS gain
  FROM orders GROUP BY 1, 2, o_orderkey % 4),
mx AS (SELECT shuffle, permutation, max(gain) AS g FROM nul GROUP BY 1, 2),
og AS (SELECT drug, avg(gain) AS gain FROM obs GROUP BY 1),
report AS (SELECT shuffle, drug, any_value(gain) AS gain, count(*) AS permutations,
    avg(g) AS null_mean, stddev_samp(g) AS null_sd, max(g) AS null_max,
    (1 + count(*) FILTER (g >= gain)) / (count(*) + 1) AS p_familywise,
    1 / (count(*) + 1) AS resolution FROM mx, og GROUP BY shuffle, drug)"""


def null_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    drug = F.concat(F.lit("th"), (o % 4).cast("string"))
    null = t.table("orders").groupBy(
        F.concat(F.lit("f"), (c % 3).cast("string")).alias("shuffle"), c.alias("permutation"),
        drug.alias("drug")).agg((F.avg(F.floor("o_totalprice")) / 1000000.0).alias("gain"))
    observed = t.table("orders").groupBy(drug.alias("drug"), (o % 10).alias("round"),
                                         (o % 4).alias("k")).agg(
        (F.max(F.floor("o_totalprice")) / 1000000.0).alias("gain")).select(
        "drug", "round", (F.col("gain") - F.lit(0.1) * F.col("k")).alias("gain"))
    return observed, null


@query("familywise_pvalues", sql=f"""
WITH {NULL_SQL} SELECT shuffle, drug, permutations, round(gain, 6) AS gain,
  round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(null_max, 6) AS null_max,
  round(p_familywise, 6) AS p_familywise, round(resolution, 6) AS resolution,
  CASE WHEN p_familywise > 0.05 THEN 'inside the null' ELSE 'clears the null' END AS verdict
FROM report""")
def familywise_pvalues(t: Tables) -> DataFrame:
    return rounded(kin.verdict_label(kin.familywise_pvalues(*null_tables(t))))


@query("best_drug_per_shuffle", sql=f"""
WITH {NULL_SQL} SELECT shuffle, drug, round(gain, 6) AS gain,
  round(p_familywise, 6) AS p_familywise FROM report
QUALIFY row_number() OVER (PARTITION BY shuffle ORDER BY report.gain DESC, drug) = 1""")
def best_drug_per_shuffle(t: Tables) -> DataFrame:
    return rounded(kin.best_drug_per_shuffle(kin.familywise_pvalues(*null_tables(t))))


@query("null_status", sql=f"""
WITH {NULL_SQL} SELECT max(permutations) AS permutations_completed,
  999 AS permutations_required,
  CASE WHEN max(permutations) >= 999 THEN 'complete' ELSE 'incomplete' END AS analysis_status,
  round_even(1 / (max(permutations) + 1), 6) AS resolution FROM report""")
def null_status(t: Tables) -> DataFrame:
    return rounded(kin.null_status(kin.familywise_pvalues(*null_tables(t))))


@query("repeated_permutations", sql="""
SELECT shuffle, permutation, drug, count(*) AS rows FROM (SELECT 'f' || cast(o_custkey % 3
  AS varchar) AS shuffle, o_custkey AS permutation, 'th' || cast(o_orderkey % 4 AS varchar) AS drug
  FROM orders) AS n GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def repeated_permutations(t: Tables) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return kin.repeated_permutations(t.table("orders").select(
        F.concat(F.lit("f"), (c % 3).cast("string")).alias("shuffle"), c.alias("permutation"),
        F.concat(F.lit("th"), (o % 4).cast("string")).alias("drug")))


@query("resumed_append", sql="""
SELECT 'f' || cast(p_partkey % 3 AS varchar) AS shuffle, p_partkey AS permutation,
  p_size * 2 AS gain FROM part""")
def resumed_append(t: Tables) -> DataFrame:
    """A run cut short and resumed: the table ends with every key once."""

    keyed = t.table("part").select(
        F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")).alias("shuffle"),
        F.col("p_partkey").alias("permutation"), "p_size")
    path = scratch_path(t.spark, "resumed")
    keys = ["shuffle", "permutation"]

    def compute(left: DataFrame) -> DataFrame:
        return keyed.join(left, keys).select(*keys, (F.col("p_size") * 2).cast("bigint")
                                             .alias("gain"))

    inc.resume(t.spark, path, keyed.where("permutation % 5 < 2"), keys, compute)
    return inc.resume(t.spark, path, keyed, keys, compute)


# --- Gains and controls -------------------------------------------------------------------------

GAINS_SQL = """m AS (SELECT 'th' || cast(o_orderkey % 4 AS varchar) AS drug, o_custkey % 10 AS round,
    (['B', 'K1', 'K2'])[1 + o_orderkey // 4 % 3] AS model,
    avg(floor(o_totalprice)) / 500000.0 AS r2 FROM orders GROUP BY 1, 2, 3),
gains AS (SELECT a.drug, a.round, a.model, a.r2 - b.r2 AS gain FROM m a JOIN m b
    ON b.drug = a.drug AND b.round = a.round AND b.model = 'B' WHERE a.model <> 'B')"""


def scored_rounds(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    model = F.element_at(F.lit(["B", "K1", "K2"]), (F.floor(o / 4) % 3 + 1).cast("int"))
    return t.table("orders").groupBy(
        F.concat(F.lit("th"), (o % 4).cast("string")).alias("drug"),
        (F.col("o_custkey") % 10).alias("round"), model.alias("model")).agg(
        (F.avg(F.floor("o_totalprice")) / 500000.0).alias("r2"))


@query("improvement", sql=f"""
WITH {GAINS_SQL} SELECT drug, round, model, round(gain, 6) AS gain FROM gains""")
def improvement(t: Tables) -> DataFrame:
    return rounded(ev.improvement(scored_rounds(t), ["drug"]))


@query("leakage", sql=f"""
WITH {GAINS_SQL} SELECT a.drug, a.round, round(a.gain - b.gain, 6) AS gain FROM gains a
JOIN gains b ON b.drug = a.drug AND b.round = a.round AND b.model = 'K2' WHERE a.model = 'K1'""")
def leakage(t: Tables) -> DataFrame:
    gains = ev.improvement(scored_rounds(t), ["drug"])
    return rounded(ev.leakage(gains.where("model = 'K1'"), gains.where("model = 'K2'")))


def interval_sql(columns: str, places: int = 6) -> str:
    return f"""SELECT {columns}, round(point, {places}) AS point, round(ci_low, {places}) AS ci_low,
  round(ci_high, {places}) AS ci_high, ci_low <= 0 AND ci_high >= 0 AS includes_zero FROM spread"""


@query("bootstrap_mean_ci", sql=f"""
WITH {GAINS_SQL}, {bootstrap_mean_sql("gains", ["drug", "model"], ["round"], "gain", 2000, 721)}
{interval_sql("drug, model")}""")
def bootstrap_ci(t: Tables) -> DataFrame:
    gains = ev.improvement(scored_rounds(t), ["drug"])
    return rounded(bootstrap_mean_ci(gains, ["drug", "model"], ["round"], "gain", 2000))


_READ_IDENTITY = ("transcript", "length", "flag", "value")


@query("bootstrap_large_group", "reads", sql=f"""
WITH rd AS (SELECT sample, transcript, length, flag, cast(t AS DOUBLE) AS value FROM reads),
{bootstrap_mean_sql("rd", ["sample"], _READ_IDENTITY, "value", 50, 721, 5000)}
{interval_sql("sample", 4)}""")
def bootstrap_large_group(t: Tables) -> DataFrame:
    """The mean of one column over whole libraries, resampled bucket by bucket."""

    rows = t("reads").select("sample", "transcript", "length", "flag",
                             F.col("t").cast("double").alias("value"))
    return rounded(bootstrap_mean_ci(rows, ["sample"], _READ_IDENTITY, "value", 50,
                                     bucket_rows=5000), 4)


@query("control_outcomes", sql=f"""
WITH {GAINS_SQL}, lk AS (SELECT a.drug, a.round, b.gain - a.gain AS gain FROM gains a JOIN gains b
  ON b.drug = a.drug AND b.round = a.round AND b.model = 'K2' WHERE a.model = 'K1'),
cs AS (SELECT 'grouped_gain' AS control, drug, round, gain FROM gains WHERE model = 'K1'
  UNION ALL SELECT 'global', drug, round, gain FROM gains WHERE model = 'K2'
  UNION ALL SELECT 'grouped_split_leakage', drug, round, gain FROM lk),
{bootstrap_mean_sql("cs", ["control", "drug"], ["round"], "gain", 1000, 721, named=["drug"])}
SELECT control, CASE WHEN control = 'grouped_gain' THEN drug ELSE 'worst case' END AS drug,
  round(point, 6) AS gain, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high,
  ci_low <= 0 AND ci_high >= 0 AS includes_zero FROM spread
QUALIFY row_number() OVER (PARTITION BY control ORDER BY point DESC, drug) = 1""")
def control_outcomes(t: Tables) -> DataFrame:
    gains = ev.improvement(scored_rounds(t), ["drug"])
    one, two = gains.where("model = 'K1'"), gains.where("model = 'K2'")
    return rounded(ev.control_outcomes(one, {"global": two}, two, draws=1000))


@query("head_to_head_intervals", sql=f"""
WITH {GAINS_SQL}, gs AS (SELECT drug, 'none' AS shuffle, model, round, gain FROM gains),
{bootstrap_mean_sql("gs", ["drug", "shuffle", "model"], ["round"], "gain", 1000, 721)},
b AS (SELECT drug, avg(r2) AS r2 FROM m WHERE model = 'B' GROUP BY 1)
SELECT s.drug, shuffle, model, round(point, 6) AS gain, round(ci_low, 6) AS ci_low,
  round(ci_high, 6) AS ci_high, NOT (ci_low <= 0 AND ci_high >= 0) AS excludes_zero,
  round(r2, 6) AS baseline_r2, 0.9::DOUBLE AS ceiling, round(0.9 - r2, 6) AS headroom,
  round(CASE WHEN 0.9 - r2 <> 0 THEN point / (0.9 - r2) END, 6) AS share_of_headroom
FROM spread s JOIN b ON b.drug = s.drug""")
def head_to_head_intervals(t: Tables) -> DataFrame:
    scored = scored_rounds(t).withColumn("shuffle", F.lit("none"))
    ceilings = scored.select(F.col("drug").alias("treatment")).distinct().withColumn(
        "ceiling", F.lit(0.9))
    return rounded(ev.head_to_head_intervals(scored, ceilings, draws=1000))


@query("passing_rule", sql="""
WITH c AS (SELECT o_orderkey, (o_orderkey % 7 - 2) / 10.0 AS gain,
    (o_orderkey % 7 - 2) / 10.0 - 0.15 AS lo, (o_orderkey % 7 - 2) / 10.0 + 0.15 AS hi,
    o_custkey % 4 AS shuffles, o_custkey % 3 <> 0 AS incl, o_orderkey % 5 = 0 AS conf FROM orders),
r AS (SELECT *, gain > 0 AND NOT (lo <= 0 AND hi >= 0) AS x, shuffles > 0 AND incl AS y,
    NOT conf AS z FROM c)
SELECT o_orderkey, x AS gain_excludes_zero, y AS shuffles_collapse, z AS survives_support,
  x AND y AND z AS supported, array_to_string(list_filter([
    CASE WHEN NOT x THEN 'gain_excludes_zero' END, CASE WHEN NOT y THEN 'shuffles_collapse' END,
    CASE WHEN NOT z THEN 'survives_support' END], lambda s: s IS NOT NULL), ';') AS failures FROM r""")
def passing_rule(t: Tables) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    gain = (o % 7 - 2) / F.lit(10.0)
    rows = t.table("orders").select(
        "o_orderkey", gain.alias("gain"), (gain - 0.15).alias("ci_low"),
        (gain + 0.15).alias("ci_high"), (c % 4).alias("shuffles"),
        (c % 3 != 0).alias("all_shuffles_include_zero"),
        (o % 5 == 0).alias("confined_to_unsupported"))
    return ev.passing_rule(rows).select(
        "o_orderkey", "gain_excludes_zero", "shuffles_collapse", "survives_support", "supported",
        "failures")


# --- Support ------------------------------------------------------------------------------------

_TERMS = {"stop": "stop_type", "upstream": "up_123nt", "downstream": "down_123nt"}


def _norm(columns: str = "") -> str:
    terms = ", ".join(f"{DNA_SQL.format(c)} AS {c}" for c in _TERMS.values())
    return terms + columns


SUPPORT_SQL = f"""lib AS (SELECT {_norm(", gene, row, RT_binomial")} FROM library
    WHERE therapy_id = 'th0'),
sc AS (SELECT variant_id, gene_symbol, {_norm()} FROM contexts WHERE scoreable),
atlas AS (SELECT variant_id,
    coalesce((SELECT count(*) FROM lib l WHERE l.stop_type = sc.stop_type), 0) AS support_stop,
    coalesce(u.n, 0) AS support_upstream, coalesce(d.n, 0) AS support_downstream,
    coalesce(i.n, 0) AS support_interaction_cell, coalesce(f.n, 0) AS support_complete_context
  FROM sc LEFT JOIN (SELECT up_123nt, count(*) AS n FROM lib GROUP BY 1) AS u
    ON u.up_123nt = sc.up_123nt
  LEFT JOIN (SELECT down_123nt, count(*) AS n FROM lib GROUP BY 1) AS d
    ON d.down_123nt = sc.down_123nt
  LEFT JOIN (SELECT stop_type, down_123nt, count(*) AS n FROM lib GROUP BY 1, 2) AS i
    ON i.stop_type = sc.stop_type AND i.down_123nt = sc.down_123nt
  LEFT JOIN (SELECT stop_type, up_123nt, down_123nt, count(*) AS n FROM lib GROUP BY 1, 2, 3) AS f
    ON f.stop_type = sc.stop_type AND f.up_123nt = sc.up_123nt AND f.down_123nt = sc.down_123nt),
sup AS (SELECT *, support_interaction_cell = 0 AS aliased_interaction,
    support_complete_context > 0 AS measured_exactly,
    least(support_stop, support_upstream, support_downstream, support_interaction_cell)
      AS weakest_term FROM atlas)"""


def support_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t("contexts").where("scoreable"), t("library").where("therapy_id = 'th0'")


@query("support_atlas", "contexts", "library", sql=f"WITH {SUPPORT_SQL} SELECT * FROM sup")
def support_atlas(t: Tables) -> DataFrame:
    return sup.support_atlas(*support_sides(t))


@query("support_report", "contexts", "library", sql=f"""
WITH {SUPPORT_SQL} SELECT count(*) AS variants, count(*) FILTER (measured_exactly) AS measured,
  count(*) FILTER (aliased_interaction) AS aliased,
  count(*) FILTER (weakest_term = 0) AS unsupported, {", ".join(
    f"quantile_cont({c}, {p}) AS {c}_{n}" for c in (
        "support_upstream", "support_downstream", "support_interaction_cell")
    for n, p in (("median", 0.5), ("p5", 0.05)))} FROM sup""")
def support_report(t: Tables) -> DataFrame:
    return rounded(sup.support_report(sup.support_atlas(*support_sides(t))))


@query("context_analogues", "contexts", "library", sql=f"""
WITH {SUPPORT_SQL}, p AS (SELECT sc.*, gene, RT_binomial, row,
    upper(gene) = upper(gene_symbol) AS same FROM sc JOIN lib ON lib.stop_type = sc.stop_type
    AND lib.up_123nt = sc.up_123nt AND lib.down_123nt = sc.down_123nt),
r AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY same DESC, RT_binomial DESC,
    row) AS rank FROM p)
SELECT variant_id, gene_symbol, stop_type, up_123nt, down_123nt, gene AS analogue_gene,
  round(RT_binomial, 6) AS analogue_readthrough, 'library th0' AS source, same AS same_gene, rank
FROM r WHERE rank <= 3""")
def context_analogues(t: Tables) -> DataFrame:
    return rounded(sup.context_analogues(*support_sides(t), "library th0", limit=3))


# --- Roadmap ------------------------------------------------------------------------------------

LEDGER_SQL = """ledger AS (SELECT 'c' || cast(c_custkey AS varchar) AS claim_id,
  (['supported', 'refuted', 'inconclusive'])[1 + c_custkey % 3] AS verdict FROM customer)"""

PROGRAMMES_SQL = """prog AS (SELECT o_orderpriority || '/' || o_orderstatus AS experiment_id,
    (['uag_stops', 'all_scoreable', 'decay_escaping'])[1 + min(o_orderkey) % 3] AS reach_rule,
    'c' || cast(min(o_custkey) AS varchar) || '; none; c' || cast(max(o_custkey) AS varchar)
      || ';c' || cast(count(*) AS varchar) AS resolves,
    (['none', 'indirect', 'partial', 'direct'])[1 + count(*) % 4] AS evidence_grade,
    (['low', 'moderate', 'high', 'very high'])[1 + max(o_orderkey) % 4] AS complexity
  FROM orders GROUP BY o_orderpriority, o_orderstatus)"""


def ledger(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    return t.table("customer").select(
        F.concat(F.lit("c"), c.cast("string")).alias("claim_id"),
        F.element_at(F.lit(["supported", "refuted", "inconclusive"]), (c % 3 + 1).cast("int"))
        .alias("verdict"))


def programmes(t: Tables) -> DataFrame:
    o, c, n = F.col("o_orderkey"), F.col("o_custkey"), F.count(F.lit(1))

    def pick(values: list[str], at) -> Column:
        return F.element_at(F.lit(values), (at % len(values) + 1).cast("int"))

    return t.table("orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        pick(["uag_stops", "all_scoreable", "decay_escaping"], F.min(o)).alias("reach_rule"),
        F.concat(F.lit("c"), F.min(c).cast("string"), F.lit("; none; c"), F.max(c).cast("string"),
                 F.lit(";c"), n.cast("string")).alias("resolves"),
        pick(["none", "indirect", "partial", "direct"], n).alias("evidence_grade"),
        pick(["low", "moderate", "high", "very high"], F.max(o)).alias("complexity")
    ).select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("experiment_id"),
             "reach_rule", "resolves", "evidence_grade", "complexity")


@query("verdict_counts", sql=f"""
WITH {LEDGER_SQL} SELECT v AS verdict, count(claim_id) AS rows FROM
  (SELECT unnest(['supported', 'refuted', 'inconclusive', 'untestable']) AS v) AS x
LEFT JOIN ledger ON verdict = v GROUP BY 1""")
def verdict_counts(t: Tables) -> DataFrame:
    return road.verdict_counts(ledger(t))


@query("ledger_violations", sql="""
SELECT 'verdict' AS column_name, 'isin' AS check_name, count(*) FILTER (c_custkey % 5 = 0)
  AS failures FROM customer
UNION ALL SELECT 'detail', 'not_blank', count(*) FILTER (c_custkey % 7 = 0) FROM customer
UNION ALL SELECT 'claim_id', 'unique', count(*) FROM (SELECT c_custkey // 2 AS k FROM customer
  GROUP BY 1 HAVING count(*) > 1) AS d""")
def ledger_violations(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    filled = {n: F.lit("x") for n in ct.CLAIMS_LEDGER.columns}
    filled |= {"claim_id": F.floor(c / 2).cast("string"),
               "verdict": F.when(c % 5 == 0, "maybe").otherwise("refuted"),
               "detail": F.when(c % 7 == 0, "").otherwise("d")}
    return ct.violations(t.table("customer").select(*[v.alias(n) for n, v in filled.items()]),
                         ct.CLAIMS_LEDGER)


@query("programme_violations", sql="""
SELECT 'reach_rule' AS column_name, 'isin' AS check_name, count(*) FILTER (o_orderkey % 4 = 0)
  AS failures FROM orders
UNION ALL SELECT 'complexity', 'isin', count(*) FILTER (o_orderkey % 6 = 1) FROM orders
UNION ALL SELECT 'question', 'not_null', count(*) FILTER (o_orderkey % 9 = 2) FROM orders""")
def programme_violations(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    filled = {n: F.lit("x") for n in ct.EXPERIMENT_PROGRAMMES.columns}
    filled |= {"experiment_id": o.cast("string"), "evidence_grade": F.lit("none"),
               "reach_rule": F.when(o % 4 == 0, "all").otherwise("uag_stops"),
               "complexity": F.when(o % 6 == 1, "extreme").otherwise("low"),
               "question": F.when(o % 9 != 2, "q")}
    return ct.violations(t.table("orders").select(*[v.alias(n) for n, v in filled.items()]),
                         ct.EXPERIMENT_PROGRAMMES)


ROADMAP_SQL = f"""{LANDSCAPE_SQL}, {LEDGER_SQL}, {PROGRAMMES_SQL},
flag AS (SELECT c.variant_id, c.gene_symbol, c.stop_type, coalesce(l.escapes_decay_by_rule, false)
    AS e FROM contexts c LEFT JOIN landscape l ON l.variant_id = c.variant_id WHERE c.scoreable),
sel AS (SELECT 'uag_stops' AS rule, variant_id, gene_symbol FROM flag WHERE stop_type = 'uag'
  UNION ALL SELECT 'all_scoreable', variant_id, gene_symbol FROM flag
  UNION ALL SELECT 'decay_escaping', variant_id, gene_symbol FROM flag WHERE e),
rea AS (SELECT rule, count(DISTINCT variant_id) AS nv, count(DISTINCT gene_symbol) AS ng FROM sel
  GROUP BY 1),
rec AS (SELECT rule, count(DISTINCT medgen) AS nc FROM sel JOIN conditions d
  ON d.variant_id = sel.variant_id GROUP BY 1),
cl AS (SELECT experiment_id, list_sort(list_distinct(list_filter(list_transform(
    string_split(resolves, ';'), lambda x: trim(x)), lambda x: x <> '' AND x <> 'none'))) AS names
  FROM prog),
proposed AS (SELECT p.*, nv AS potential_variants, ng AS potential_genes,
    nc AS potential_conditions, (SELECT count(*) FROM ledger WHERE verdict = 'inconclusive'
      AND list_contains(names, claim_id)) AS open_questions_addressed,
    array_to_string(names, '; ') AS claims_named, CASE evidence_grade WHEN 'none' THEN 3
      WHEN 'indirect' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END AS evidence_gap,
    CASE complexity WHEN 'low' THEN 3 WHEN 'moderate' THEN 2 WHEN 'high' THEN 1 ELSE 0 END
      AS feasibility
  FROM prog p JOIN rea ON rea.rule = reach_rule JOIN rec ON rec.rule = reach_rule
  JOIN cl ON cl.experiment_id = p.experiment_id)"""


def proposed(t: Tables) -> DataFrame:
    table = landscape(t("contexts"), t("scores"))
    placed = road.with_decay_verdict(t("contexts"), table)
    return road.propose(programmes(t), placed, t("conditions"), ledger(t))


@query("propose_programmes", "scores", "conditions", sql=f"""
WITH {ROADMAP_SQL} SELECT * REPLACE (cast(evidence_gap AS bigint) AS evidence_gap,
  cast(feasibility AS bigint) AS feasibility) FROM proposed""")
def propose_programmes(t: Tables) -> DataFrame:
    return proposed(t)


_AXES = ("potential_variants", "potential_genes", "potential_conditions",
         "open_questions_addressed", "evidence_gap", "feasibility")


@query("pareto_frontier", "scores", "conditions", sql=f"""
WITH {ROADMAP_SQL}, dom AS (SELECT a.experiment_id, string_agg(b.experiment_id, '; '
    ORDER BY b.experiment_id) AS beaten FROM proposed a JOIN proposed b ON
    {" AND ".join(f"b.{x} >= a.{x}" for x in _AXES)} AND
    ({" OR ".join(f"b.{x} > a.{x}" for x in _AXES)}) GROUP BY 1)
SELECT p.experiment_id, beaten IS NULL AS on_frontier, coalesce(beaten, 'none') AS dominated_by
FROM proposed p LEFT JOIN dom ON dom.experiment_id = p.experiment_id""")
def pareto_frontier(t: Tables) -> DataFrame:
    return road.frontier(proposed(t)).select("experiment_id", "on_frontier", "dominated_by")


# --- Payloads -----------------------------------------------------------------------------------


def ordered_landscape(t: Tables) -> DataFrame:
    return landscape(t("contexts"), t("scores")).join(
        t("contexts").select("variant_id", "ordinal"), "variant_id")


def editing_of(t: Tables) -> DataFrame:
    o = F.col("ordinal")
    return t("contexts").select(
        "variant_id", "scoreable", F.when(~F.col("scoreable"), "").when(
            o % 3 == 0, "base_editable_exact").when(o % 3 == 1, "base_editable_alternative")
        .otherwise("not_base_editable_under_panel").alias("reach_class"),
        (o % 3 != 2).alias("reachable"), F.when(o % 3 == 2, "").otherwise("BE4max").alias("editor"),
        F.when(o % 3 == 2, "").otherwise("sense").alias("strand"),
        F.when(o % 3 == 2, "").otherwise("exact_wildtype").alias("restores"),
        F.when(o % 3 != 2, (o % 5 + 4).cast("int")).alias("window_position"),
        (o % 2 == 0).alias("bystander_free"), (o % 3).cast("int").alias("n_guides"))


@query("web_rows", "scores", sql=f"""
WITH {LANDSCAPE_SQL}, {PREDICTORS_SQL}, arms AS (SELECT variant_id, count(*) AS arms,
    count(*) FILTER (status = 'present') AS available,
    max(round_even(readthrough_predicted, 5)) AS top FROM scores GROUP BY 1)
SELECT l.variant_id AS id, l.gene_symbol AS gene, upper(l.stop_type) AS stop,
  round_even(tolerable_insertion_share, 3) AS share, l.escapes_decay_by_rule AS escapes_decay,
  best_therapy AS best_therapy, round_even(best_readthrough, 5) AS best_readthrough,
  coalesce(arms, 0) AS therapies, coalesce(available, 0) AS available, top,
  upper(l.stop_type) || '-' || original_aa AS suppressor, p.escape_full_rules,
  p.rule_long_exon AS long_exon, CASE l.ordinal % 3 WHEN 0 THEN 'base_editable_exact'
    WHEN 1 THEN 'base_editable_alternative' ELSE 'not_base_editable_under_panel' END AS reach_class,
  CASE WHEN l.ordinal % 3 <> 2 THEN 'BE4max' END AS editor
FROM landscape l LEFT JOIN arms ON arms.variant_id = l.variant_id
LEFT JOIN predictors p ON p.variant_id = l.variant_id""")
def web_rows(t: Tables) -> DataFrame:
    """The nested rows, written as JSON and read back as the columns a page shows."""

    rows = pay.web_rows(landscape(t("contexts"), t("scores")), t("scores"),
                        dec.decay_predictors(t("contexts")), editing=editing_of(t))
    schema = rows.schema
    back = rows.select(pay.as_json(F.struct(*rows.columns)).alias("j")).select(
        F.from_json("j", schema).alias("r")).select("r.*")
    arms = F.col("therapies")
    return back.select(
        "id", "gene", "stop", F.col("tolerable_insertion_share").alias("share"), "escapes_decay",
        F.col("best.therapy").alias("best_therapy"),
        F.col("best.readthrough").alias("best_readthrough"),
        F.size(arms).cast("bigint").alias("therapies"),
        F.size(F.filter(arms, lambda a: a["available"])).cast("bigint").alias("available"),
        F.array_max(F.transform(arms, lambda a: a["readthrough"])).alias("top"),
        F.col("suppressor.design").alias("suppressor"),
        F.col("nmd.escape_full_rules").alias("escape_full_rules"),
        F.col("nmd.rules.long_exon").alias("long_exon"),
        F.col("editing.reach_class").alias("reach_class"),
        F.col("editing.editor").alias("editor"))


@query("diverse_sample", "scores", sql=f"""
WITH {LANDSCAPE_SQL}, w AS (
  SELECT variant_id, 0 AS pr FROM (SELECT variant_id, min(ordinal) AS o FROM scores
    WHERE status <> 'present' GROUP BY 1 ORDER BY o LIMIT 6) AS a
  UNION ALL SELECT variant_id, 1 FROM (SELECT * FROM landscape
    ORDER BY tolerable_insertion_share NULLS LAST, ordinal LIMIT 6) AS b
  UNION ALL SELECT variant_id, 2 FROM (SELECT * FROM landscape
    ORDER BY tolerable_insertion_share DESC NULLS LAST, ordinal LIMIT 6) AS c
  UNION ALL SELECT variant_id, 3 FROM (SELECT * FROM landscape
    ORDER BY best_readthrough DESC NULLS LAST, ordinal LIMIT 6) AS d
  UNION ALL SELECT variant_id, 4 FROM (SELECT * FROM landscape
    ORDER BY best_readthrough_low NULLS LAST, ordinal LIMIT 6) AS e
  UNION ALL SELECT variant_id, 5 FROM (SELECT * FROM landscape WHERE NOT escapes_decay_by_rule
    ORDER BY ordinal LIMIT 6) AS f),
k AS (SELECT variant_id, min(pr) AS priority FROM w GROUP BY 1),
rest AS (SELECT variant_id, 6 AS priority FROM landscape
  WHERE variant_id NOT IN (SELECT variant_id FROM k)
  ORDER BY ordinal LIMIT (SELECT 48 - count(*) FROM k))
SELECT variant_id, cast(priority AS bigint) AS priority FROM k UNION ALL
SELECT variant_id, cast(priority AS bigint) FROM rest""")
def diverse_sample(t: Tables) -> DataFrame:
    return rounded(pay.diverse_sample(ordered_landscape(t), t("scores")))


INDEX_SQL = f"""{LANDSCAPE_SQL}, {PREDICTORS_SQL},
mp AS (SELECT variant_id, arg_min(replace(condition_name, '_', ' '), condition_ordinal) AS name,
    count(*) - 1 AS extra FROM conditions WHERE mapping_status = 'mapped' GROUP BY 1),
ix AS (SELECT l.*, name, extra, p.escape_full_rules AS full_rules, CASE l.ordinal % 3
    WHEN 0 THEN 'exact' WHEN 1 THEN 'alt' ELSE 'no' END AS reach
  FROM landscape l LEFT JOIN mp ON mp.variant_id = l.variant_id
  LEFT JOIN predictors p ON p.variant_id = l.variant_id)"""


def _code(column: str) -> str:
    return (f"(SELECT code FROM (SELECT v, row_number() OVER (ORDER BY o, v) - 1 AS code FROM "
            f"(SELECT {column} AS v, min(ordinal) AS o FROM ix WHERE {column} IS NOT NULL "
            f"GROUP BY 1) AS s) AS d WHERE d.v = ix.{column})")


@query("variant_index", "scores", "conditions", sql=f"""
WITH {INDEX_SQL} SELECT variant_id, ordinal, {_code('gene_symbol')} AS gene,
  cast(protein_position AS bigint) AS position,
  cast(list_position(['uaa', 'uag', 'uga'], stop_type) - 1 AS bigint) AS stop,
  {_code('original_aa')} AS residue, cast(escapes_decay_by_rule AS bigint) AS escapes,
  cast(full_rules AS bigint) AS escapes_full, cast(review_stars AS bigint) AS stars,
  coalesce(cast(round_even(best_readthrough * 100000, 0) AS bigint), 0) AS best,
  coalesce(cast(round_even(best_readthrough_low * 100000, 0) AS bigint), 0) AS best_low,
  coalesce(cast(round_even(tolerable_insertion_share * 1000, 0) AS bigint), 0) AS tolerance,
  coalesce(extra, 0) AS extra_conditions, coalesce({_code('name')}, -1) AS condition,
  {_code('reach')} AS reach FROM ix""")
def variant_index(t: Tables) -> DataFrame:
    return pay.index_table(ordered_landscape(t), t("conditions"),
                           dec.decay_predictors(t("contexts")), editing_of(t))


@query("index_arms", "scores", sql="""
WITH a AS (SELECT c.variant_id, t, cast(round_even(readthrough_predicted * 100000, 0) AS bigint)
    AS m, cast(round_even(readthrough_high * 100000, 0) AS bigint) AS h FROM contexts c
  CROSS JOIN (VALUES ('th0'), ('th1'), ('th2')) AS x(t)
  LEFT JOIN scores s ON s.variant_id = c.variant_id AND s.therapy_id = t WHERE c.scoreable)
SELECT variant_id, string_agg(cast(coalesce(m, -1) AS varchar), ',' ORDER BY t) AS arm_mid,
  string_agg(cast(coalesce(h, -1) AS varchar), ',' ORDER BY t) AS arm_high FROM a GROUP BY 1""")
def index_arms(t: Tables) -> DataFrame:
    arms = pay.index_arms(landscape(t("contexts"), t("scores")), t("scores"),
                          ("th0", "th1", "th2"))
    return arms.select("variant_id", *[
        F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
        for c in ("arm_mid", "arm_high")])


@query("evidence_payload", "offsets", "frames", sql="""
SELECT count(DISTINCT sample) AS libraries, 'null' AS kinetics FROM frames""")
def evidence_payload(t: Tables) -> DataFrame:
    """One JSON payload of bounded sections; the section that was not produced is null."""

    from stopscan.operators.footprints import calibration_summary

    payload = pay.evidence({"release": "r1"}, {
        "calibration": pay.refuse_nan(calibration_summary(t("offsets"), t("frames"))),
        "kinetics": None}, t.spark)
    return payload.select(
        F.size(F.from_json(F.get_json_object("payload", "$.calibration"), "array<string>"))
        .cast("bigint").alias("libraries"),
        F.regexp_extract("payload", '"kinetics":([a-z]+)', 1).alias("kinetics"))


@query("research_counts", "conditions", "contexts", sql="""
SELECT (SELECT count(DISTINCT variant_id) FROM contexts) AS qualifying_variants,
  (SELECT count(*) FROM contexts WHERE scoreable) AS scoreable_variants,
  count(DISTINCT medgen) FILTER (mapping_status IN ('mapped', 'medgen_only'))
    AS eligible_condition_entities,
  count(*) FILTER (mapping_status IN ('mapped', 'medgen_only')) AS unique_variant_condition_pairs,
  count(*) FILTER (mapping_status NOT IN ('mapped', 'medgen_only'))
    AS excluded_placeholder_or_unmapped_rows FROM conditions""")
def research_counts(t: Tables) -> DataFrame:
    return pay.research_counts(t("conditions"), t("contexts"))


@query("quantile_report", sql="""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1""")
def quantile_report(t: Tables) -> DataFrame:
    """Exact quantiles of groups that each hold a third of all rows."""

    return rounded(quantiles(t.table("lineitem"), ["l_returnflag"], "l_extendedprice",
                             {"median": 0.5, "p95": 0.95}))


@query("therapy_names", "library", sql="""
SELECT name, count(*) AS rows FROM (SELECT CASE row % 3 WHEN 0 THEN 'SRI-41315'
  WHEN 1 THEN 'G418 (geneticin)' ELSE 'other' END AS name FROM library) AS l GROUP BY 1""")
def therapy_names(t: Tables) -> DataFrame:
    from stopscan.functions.scalars import therapy_name

    named = F.element_at(F.lit(["SRI", "G418", "other"]), (F.col("row") % 3 + 1).cast("int"))
    return t("library").groupBy(therapy_name(named).alias("name")).agg(
        F.count(F.lit(1)).alias("rows"))


@query("named_items", "conditions_raw", sql="""
SELECT variant_id, CASE WHEN ordinal % 4 = 0 THEN 'none' ELSE
  CASE WHEN ordinal % 3 = 0 THEN 'a' ELSE 'a; b' END END AS items FROM conditions_raw""")
def named_items(t: Tables) -> DataFrame:
    from stopscan.functions.scalars import joined_or_none, named_items as items

    o = F.col("ordinal")
    text = F.when(o % 4 == 0, " none ;").when(o % 3 == 0, "a; none").otherwise(" a ;b;")
    return t("conditions_raw").select("variant_id", joined_or_none(items(text)).alias("items"))
