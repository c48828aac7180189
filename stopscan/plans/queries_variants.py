"""Queries over variants: archive scan, conditions, placement, decay, editing, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopscan.functions import nucleotides as nuc
from stopscan.functions import scalars as sc
from stopscan.functions.fixed import (
    BLOSUM62,
    CHROMOSOME_ORDER,
    CODON_BASES,
    CODON_RESIDUES,
    PRIMARY_PANEL,
    SENSITIVITY_PANEL,
    STOP_CODONS,
    TRIAGE,
)
from stopscan.operators import contracts as ct
from stopscan.operators import coverage as cov
from stopscan.operators import decay as dec
from stopscan.operators import editing as ed
from stopscan.operators import landscape as land
from stopscan.operators import placement as plc
from stopscan.operators import text_index as tix
from stopscan.operators import variants as var
from stopscan.plans.carriers import Tables
from stopscan.plans.registry import query, rounded
from stopscan.session import cut_lineage, scratch_path
from stopscan.sources import text as src

# --- Shared SQL of the oracles ------------------------------------------------------------------


def sql_residue(codon: str) -> str:
    """A codon's residue, spelled for the oracle as a table lookup."""

    pairs = []
    codons = [a + b + c for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES]
    for aa in sorted(set(CODON_RESIDUES)):
        held = ", ".join(f"'{c}'" for c, r in zip(codons, CODON_RESIDUES) if r == aa)
        pairs.append(f"WHEN {codon} IN ({held}) THEN '{aa}'")
    return "CASE " + " ".join(pairs) + " END"


def sql_scores() -> str:
    """The substitution table as rows `(a, b, s)`."""

    rows, seen = [], []
    for line in BLOSUM62.split("\n"):
        if line:
            aa, *values = line.split()
            seen.append(aa)
            for other, value in zip(seen, values):
                rows.append(f"('{aa}', '{other}', {value})")
                if aa != other:
                    rows.append(f"('{other}', '{aa}', {value})")
    return "(VALUES " + ", ".join(rows) + ") AS m(a, b, s)"


STOPS_SQL = "(" + ", ".join(f"'{s}'" for s in STOP_CODONS) + ")"
DNA_SQL = "translate({}, 'acgtuACGTU', 'ACGTTACGTT')"

NEAR_SQL = f"""near AS (SELECT stop, aa FROM (
  SELECT DISTINCT s.stop AS stop, {sql_residue("c.codon")} AS aa FROM
    (VALUES ('TAA'), ('TAG'), ('TGA')) AS s(stop) JOIN
    (SELECT x || y || z AS codon FROM (VALUES ('A'),('C'),('G'),('T')) AS a(x),
       (VALUES ('A'),('C'),('G'),('T')) AS b(y), (VALUES ('A'),('C'),('G'),('T')) AS d(z)) AS c
    ON (CASE WHEN substring(s.stop,1,1) <> substring(c.codon,1,1) THEN 1 ELSE 0 END
      + CASE WHEN substring(s.stop,2,1) <> substring(c.codon,2,1) THEN 1 ELSE 0 END
      + CASE WHEN substring(s.stop,3,1) <> substring(c.codon,3,1) THEN 1 ELSE 0 END) = 1) AS q
  WHERE aa <> '*')"""

ESCAPES_SQL = """coalesce(in_last_exon, false) OR
  coalesce(nt_to_last_junction > 0 AND nt_to_last_junction <= 50, false)"""

# --- Archive scan -------------------------------------------------------------------------------

_KEPT_SQL = """kept AS (SELECT *, split_part(geneinfo, ':', 2) AS gid FROM vcf_rows
  WHERE clnvc = 'single_nucleotide_variant' AND mc LIKE '%SO:0001587%'
    AND split_part(clnsig, '|', 1) IN
      ('Pathogenic', 'Likely_pathogenic', 'Pathogenic/Likely_pathogenic')
    AND alt NOT LIKE '%,%' AND regexp_full_match(split_part(geneinfo, ':', 2), '[0-9]+'))"""

_STARS_SQL = """CASE clnrevstat WHEN 'practice_guideline' THEN 4
  WHEN 'reviewed_by_expert_panel' THEN 3
  WHEN 'criteria_provided,_multiple_submitters,_no_conflicts' THEN 2
  WHEN 'criteria_provided,_single_submitter' THEN 1
  WHEN 'criteria_provided,_conflicting_classifications' THEN 1 ELSE 0 END"""


def archive(t: Tables) -> DataFrame:
    """Archive records written as VCF text and read back through the scan."""

    rows = t("vcf_rows")
    info = F.concat_ws(
        ";", F.concat(F.lit("ALLELEID="), F.col("ordinal").cast("string")),
        *[F.concat(F.lit(k + "="), F.col(c)) for k, c in (
            ("CLNVC", "clnvc"), ("MC", "mc"), ("CLNSIG", "clnsig"), ("GENEINFO", "geneinfo"),
            ("CLNREVSTAT", "clnrevstat"))],
        F.concat(F.lit("CLNHGVS=v"), F.col("ordinal").cast("string")))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt",
                       F.lit("."), F.lit("."), info)
    path = scratch_path(t.spark, "archive")
    # Every archive opens with header lines; here each file does, as in a directory of parts.
    columns = "\t".join(("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"))
    head = F.when(F.col("ordinal") % 1000 == 0, F.array(
        F.lit("##fileformat=VCFv4.1"), F.lit('##INFO=<ID=MC,Number=.,Type=String>'),
        F.lit(columns), F.lit(""))).otherwise(F.array())
    rows.select(F.explode(F.concat(head, F.array(line))).alias("value")).write.text(path)
    return var.pathogenic_nonsense(src.read_vcf(t.spark, path))


@query("pathogenic_nonsense", "vcf_rows", sql=f"""
WITH {_KEPT_SQL} SELECT 'v' || cast(ordinal AS varchar) AS variant_id, ordinal AS allele_id, chrom,
  pos, ref, alt, split_part(geneinfo, ':', 1) AS gene_symbol, cast(gid AS bigint) AS gene_id,
  clnsig AS clinical_significance, clnrevstat AS review_status,
  cast({_STARS_SQL} AS bigint) AS review_stars, '' AS conditions, '' AS condition_xrefs
FROM kept WHERE alt IN ('A', 'C', 'G', 'T')""")
def pathogenic_nonsense(t: Tables) -> DataFrame:
    return rounded(var.split_alleles(archive(t))[0])


@query("population_report", "vcf_rows", sql=f"""
WITH {_KEPT_SQL} SELECT count(*) FILTER (alt <> 'R') AS variants,
  count(DISTINCT gid) FILTER (alt <> 'R') AS genes,
  count(*) FILTER (alt <> 'R' AND {_STARS_SQL} >= 2) AS two_stars_or_more,
  count(*) FILTER (alt = 'R') AS ambiguous_alleles FROM kept""")
def population_report(t: Tables) -> DataFrame:
    return var.population_report(archive(t))


@query("ambiguous_alleles", "vcf_rows", sql=f"""
WITH {_KEPT_SQL} SELECT count(*) FILTER (alt = 'R') AS ambiguous_alleles FROM kept""")
def ambiguous_alleles(t: Tables) -> DataFrame:
    return var.split_alleles(archive(t))[1]


@query("review_stars", "vcf_rows", sql=f"""
SELECT clnrevstat AS review_status, cast({_STARS_SQL} AS bigint) AS review_stars,
  count(*) AS records FROM vcf_rows GROUP BY 1, 2""")
def review_stars(t: Tables) -> DataFrame:
    return rounded(t("vcf_rows").groupBy(
        F.col("clnrevstat").alias("review_status"),
        sc.review_stars(F.col("clnrevstat")).alias("review_stars")).agg(
        F.count(F.lit(1)).alias("records")))


@query("chromosome_order", "vcf_rows", sql=f"""
SELECT chrom, pos, ref, alt, cast(list_position({list(CHROMOSOME_ORDER)}, chrom) AS bigint)
  AS chrom_rank FROM vcf_rows WHERE length(ref) = 1 AND length(alt) = 1""")
def chromosome_order(t: Tables) -> DataFrame:
    return plc.alleles_by_chromosome(t("vcf_rows"), CHROMOSOME_ORDER).select(
        "chrom", "pos", "ref", "alt", "chrom_rank")


_TRIAGE_ROWS = ", ".join("('{}', '{}', {}, '{}')".format(k, v[0], v[1], v[2].replace("'", "''"))
                         for k, v in TRIAGE.items())


@query("triage", sql=f"""
SELECT variant_id, consequence, transcript_supported,
  CASE WHEN NOT transcript_supported THEN 'unsupported_transcript'
       ELSE coalesce(k.cls, 'unsupported') END AS triage_class,
  transcript_supported AND coalesce(k.ok, false) AS applies,
  CASE WHEN NOT transcript_supported THEN
       'the variant''s transcript is outside the supported set, so no analysis is offered'
       ELSE coalesce(k.why, consequence || ' is outside the supported variant classes') END
    AS reason
FROM (SELECT o_orderkey AS variant_id, o_custkey % 4 <> 0 AS transcript_supported,
        (['stop_gained', 'missense_variant', 'frameshift_variant', 'splice_acceptor_variant',
          'splice_donor_variant', 'splice_region_variant', 'synonymous_variant', 'stop_lost',
          'inframe_deletion', 'inframe_insertion'])[1 + o_orderkey % 10] AS consequence
      FROM orders) AS v
LEFT JOIN (VALUES {_TRIAGE_ROWS}) AS k(name, cls, ok, why) ON k.name = v.consequence""")
def triage(t: Tables) -> DataFrame:
    from stopscan.functions.fixed import CONSEQUENCES

    named = F.element_at(F.lit(list(CONSEQUENCES)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return var.triage(t.table("orders").select(
        F.col("o_orderkey").alias("variant_id"), named.alias("consequence"),
        (F.col("o_custkey") % 4 != 0).alias("transcript_supported")))


# --- Conditions ---------------------------------------------------------------------------------

_IDS_SQL = """list_transform(list_filter(string_split(coalesce(entry, ''), ','),
  lambda x: starts_with(x, '{0}:') AND length(x) > {1}), lambda x: substring(x, {2}))"""


def _ids(source: str) -> str:
    n = len(source) + 1
    listed = _IDS_SQL.format(source, n, n + 1)
    return (f"array_to_string(list_filter({listed}, lambda x, i: list_position({listed}, x) = i), "
            f"';')")


CONDITIONS_SQL = f"""named AS (
  SELECT variant_id, gene_symbol, i - 1 AS condition_ordinal,
    (string_split(conditions, '|'))[i] AS condition_name,
    (string_split(condition_xrefs, '|'))[i] AS entry
  FROM (SELECT *, unnest(generate_series(1, len(string_split(conditions, '|')))) AS i
        FROM conditions_raw WHERE conditions <> '') AS n),
coded AS (SELECT variant_id, gene_symbol, condition_ordinal, condition_name,
    coalesce(({_IDS_SQL.format("MedGen", 7, 8)})[1], '') AS medgen, {_ids("OMIM")} AS omim,
    {_ids("Orphanet")} AS orphanet, {_ids("MONDO")} AS mondo, {_ids("MeSH")} AS mesh FROM named),
parsed AS (SELECT *, CASE WHEN medgen IN ('CN517202', 'CN169374', 'C3661900') THEN 'placeholder'
    WHEN medgen = '' THEN 'unmapped' WHEN omim = '' AND orphanet = '' THEN 'medgen_only'
    ELSE 'mapped' END AS mapping_status FROM coded)"""


@query("normalize_conditions", "conditions_raw", sql=f"""
WITH {CONDITIONS_SQL} SELECT variant_id, gene_symbol,
  cast(condition_ordinal AS bigint) AS condition_ordinal, condition_name, medgen, omim, orphanet,
  mondo, mesh, mapping_status, CASE mapping_status
    WHEN 'placeholder' THEN 'ClinVar placeholder (' ||
      CASE medgen WHEN 'CN169374' THEN 'not specified' ELSE 'not provided' END || ')'
    WHEN 'unmapped' THEN 'no MedGen concept on the condition'
    WHEN 'medgen_only' THEN 'MedGen concept with no OMIM or Orphanet cross-reference'
    ELSE '' END AS reason FROM parsed""")
def normalize_conditions(t: Tables) -> DataFrame:
    return rounded(var.normalize_conditions(t("conditions_raw").drop("ordinal")))


@query("condition_status_counts", "conditions_raw", sql=f"""
WITH {CONDITIONS_SQL} SELECT mapping_status, count(*) AS rows, count(DISTINCT medgen) AS concepts
FROM parsed GROUP BY mapping_status""")
def condition_status_counts(t: Tables) -> DataFrame:
    return var.condition_status_counts(var.normalize_conditions(t("conditions_raw")))


@query("condition_search", "conditions", "contexts", sql="""
WITH found AS (SELECT c.variant_id, c.ordinal, d.condition_name
  FROM contexts c JOIN conditions d ON d.variant_id = c.variant_id AND d.condition_ordinal = 0
  WHERE contains(lower(c.gene_symbol || ' ' || coalesce(c.stop_type, '') || ' ' ||
                       d.condition_name), 'disease_1'))
SELECT variant_id, ordinal, condition_name, (SELECT count(*) FROM found) AS total
FROM found ORDER BY ordinal LIMIT 12""")
def condition_search(t: Tables) -> DataFrame:
    named = t("contexts").join(t("conditions").where("condition_ordinal = 0").select(
        "variant_id", "condition_name"), "variant_id")
    return var.search(named, " Disease_1 ", ["gene_symbol", "stop_type", "condition_name"],
                      "ordinal").select("variant_id", "ordinal", "condition_name", "total")


@query("search_documents", sql="""
WITH found AS (SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'the'))
SELECT doc_id, lang, source, (SELECT count(*) FROM found) AS total
FROM found ORDER BY doc_id LIMIT 12""")
def search_documents(t: Tables) -> DataFrame:
    return var.search(t.table("documents"), "THE", ["text"], "doc_id").select(
        "doc_id", "lang", "source", "total")


#: Searched one after another through one index: a common word, a rare one, two characters, nothing.
SEARCHES = ("The ", "er and", " q", "no such passage")


@query("indexed_search", sql=f"""
WITH q AS (SELECT unnest({list(SEARCHES)!r}) AS query),
found AS (SELECT query, doc_id, lang, source FROM q JOIN documents
          ON contains(lower(coalesce(text, '') || ' ' || coalesce(source, '')),
                      lower(trim(query)))),
ranked AS (SELECT *, count(*) OVER (PARTITION BY query) AS total,
  row_number() OVER (PARTITION BY query ORDER BY doc_id) AS place FROM found)
SELECT query, doc_id, lang, source, total FROM ranked WHERE place <= 12""")
def indexed_search(t: Tables) -> DataFrame:
    """Several searches of all documents, whose posting lists are written once."""

    index = tix.build_index(t.table("documents").select("doc_id", "lang", "source", "text"),
                            ["text", "source"])
    shown = [tix.indexed_search(t.spark, index, q, "doc_id").select(
        F.lit(q).alias("query"), "doc_id", "lang", "source", "total") for q in SEARCHES]
    return reduce(DataFrame.unionByName, shown)


# --- Annotation and placement -------------------------------------------------------------------


def annotation(t: Tables) -> DataFrame:
    """Annotation features written as nine-column text and read back through the scan."""

    rows = t("features")
    tag = F.when(F.col("ordinal") % 7 == 0, "tag=MANE Plus").otherwise("tag=MANE Select")
    attrs = F.concat(
        F.lit("ID=x;Parent=rna-"), "transcript_id", F.lit(";Dbxref=GeneID:"),
        F.col("gene_id").cast("string"), F.lit(",Other:1;"), tag,
        F.when(F.col("feature") == "CDS", F.concat(F.lit(";protein_id="), "protein_id"))
        .otherwise(""))
    line = F.concat_ws("\t", "chrom", F.lit("BestRefSeq"), "feature",
                       F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."),
                       "strand", F.lit("."), attrs)
    path = scratch_path(t.spark, "annotation")
    rows.select(line.alias("value")).write.text(path)
    return plc.annotated_features(src.read_gff(t.spark, path))


@query("annotated_features", "features", sql="""
SELECT chrom, feature, beg AS start, fin AS "end", strand, '.' AS phase, transcript_id, gene_id,
  CASE WHEN feature = 'CDS' THEN protein_id END AS protein_id
FROM features WHERE ordinal % 7 <> 0 AND chrom IN ({})""".format(
    ", ".join(f"'chr{c}'" for c in range(1, 23))))
def annotated_features(t: Tables) -> DataFrame:
    return annotation(t)


def models(t: Tables) -> DataFrame:
    return plc.transcript_models(t("features"), t("seqs").select("accession", "sequence"))


@query("transcript_models", "features", "seqs", sql="""
SELECT transcript_id, any_value(gene_id) AS gene_id, any_value(chrom) AS chrom,
  any_value(strand) AS strand, count(*) FILTER (feature = 'exon') AS exons,
  min(beg) FILTER (feature = 'CDS') AS cds_start, max(fin) FILTER (feature = 'CDS') AS cds_end,
  cast(any_value(length(sequence)) AS bigint) AS bases,
  cast(any_value(l_utr5) AS bigint) AS coding_offset,
  cast(any_value(l_utr5 + l_cds - 1) AS bigint) AS coding_end_offset,
  any_value(cast(e0 AS varchar) || ',' || cast(e0 + e1 AS varchar)) AS junctions
FROM features JOIN seqs ON accession = transcript_id GROUP BY transcript_id""".replace(
    "any_value(gene_id)", "any_value(features.gene_id)"))
def transcript_models(t: Tables) -> DataFrame:
    return rounded(models(t).select(
        "transcript_id", "gene_id", "chrom", "strand",
        F.size("exons").cast("bigint").alias("exons"), "cds_start", "cds_end",
        F.length("sequence").alias("bases"), "coding_offset", "coding_end_offset",
        F.array_join(F.transform("junctions", lambda j: j.cast("string")), ",")
        .alias("junctions")))


PLACED_SQL = f"""tx AS (SELECT s.gene_id, accession, l_utr5, l_cds, sequence, e0, e1,
    s.gene_id % 2 = 0 AS forward FROM seqs s),
off AS (SELECT v.variant_id, v.gene_id, v.ordinal, v.ref, v.alt, v.pos,
    max(CASE WHEN v.pos BETWEEN e.beg AND e.beg + e.len - 1 THEN
      CASE WHEN e.strand = '+' THEN e.off + v.pos - e.beg
           ELSE e.off + e.beg + e.len - 1 - v.pos END END) AS o
  FROM variants v LEFT JOIN exons e ON e.gene_id = v.gene_id GROUP BY 1, 2, 3, 4, 5, 6),
cod AS (SELECT off.*, tx.accession, tx.l_utr5, tx.l_cds, tx.sequence, tx.e0, tx.e1,
    CASE WHEN forward THEN ref ELSE translate(ref, 'ACGT', 'TGCA') END AS expected,
    CASE WHEN forward THEN alt ELSE translate(alt, 'ACGT', 'TGCA') END AS sub,
    cast(l_utr5 + 3 * floor((o - l_utr5) / 3) AS bigint) AS cs
  FROM off LEFT JOIN tx ON tx.gene_id = off.gene_id),
mut AS (SELECT *, CASE WHEN o >= l_utr5 AND cs + 2 <= l_utr5 + l_cds - 1
      THEN substring(sequence, cs + 1, 3) END AS codon FROM cod),
placed AS (SELECT *, substring(codon, 1, o - cs) || sub || substring(codon, o - cs + 2, 3)
    AS mutated FROM mut),
reasoned AS (SELECT *, CASE WHEN accession IS NULL THEN 'no_mane_transcript'
    WHEN o IS NULL THEN 'outside_transcript'
    WHEN substring(sequence, o + 1, 1) <> expected THEN 'reference_mismatch'
    WHEN codon IS NULL THEN 'outside_transcript'
    WHEN mutated NOT IN {STOPS_SQL} OR codon IN {STOPS_SQL} THEN 'not_a_premature_stop'
    WHEN cs < 72 OR length(sequence) - cs - 3 < 72 THEN 'truncated_context' ELSE '' END AS reason
  FROM placed)"""

_RNA = "lower(translate({}, 'T', 'U'))"


@query("stop_contexts", "variants", "exons", sql=f"""
WITH {PLACED_SQL} SELECT variant_id, gene_id, reason = '' AS scoreable, reason,
  CASE WHEN reason = '' THEN accession END AS transcript_id,
  CASE WHEN reason = '' THEN cast((cs - l_utr5) / 3 + 1 AS bigint) END AS protein_position,
  CASE WHEN reason = '' THEN {_RNA.format('mutated')} END AS stop_type,
  CASE WHEN reason = '' THEN codon END AS reference_codon,
  CASE WHEN reason = '' THEN {sql_residue('codon')} END AS original_aa,
  CASE WHEN reason = '' THEN {_RNA.format('substring(sequence, cs - 2, 3)')} END AS up_123nt,
  CASE WHEN reason = '' THEN {_RNA.format('substring(sequence, cs + 4, 3)')} END AS down_123nt,
  CASE WHEN reason = '' THEN {_RNA.format('substring(sequence, cs - 71, 72)')} END AS upstream,
  CASE WHEN reason = '' THEN {_RNA.format('substring(sequence, cs + 4, 72)')} END AS downstream,
  CASE WHEN reason = '' THEN cast(3 AS bigint) END AS exon_count,
  CASE WHEN reason = '' THEN cs >= e0 + e1 END AS in_last_exon,
  CASE WHEN reason = '' THEN cast(e0 + e1 - cs AS bigint) END AS nt_to_last_junction,
  CASE WHEN reason = '' THEN cast(cs - l_utr5 AS bigint) END AS nt_from_start,
  CASE WHEN reason = '' THEN cast(CASE WHEN cs < e0 THEN e0 WHEN cs < e0 + e1 THEN e1
    ELSE length(sequence) - e0 - e1 END AS bigint) END AS ptc_exon_length
FROM reasoned""")
def stop_contexts(t: Tables) -> DataFrame:
    found = plc.stop_contexts(t("variants"), plc.one_model_per_gene(models(t)))
    return rounded(found.drop("protein_id", "gene_symbol", "review_stars"))


@query("context_failures", "variants", "exons", sql=f"""
WITH {PLACED_SQL} SELECT reason, count(*) AS variants FROM reasoned WHERE reason <> ''
GROUP BY reason""")
def context_failures(t: Tables) -> DataFrame:
    return plc.failure_counts(plc.stop_contexts(
        t("variants"), plc.one_model_per_gene(models(t))))


@query("protein_disagreements", "variants", "exons", sql=f"""
WITH {PLACED_SQL}, prot AS (SELECT *, {sql_residue('codon')} AS translated,
    CASE WHEN gene_id % 5 = 0 AND (cs - l_utr5) / 3 % 2 = 0 THEN 'X'
         ELSE {sql_residue('codon')} END AS in_protein FROM reasoned WHERE reason = '')
SELECT variant_id, accession AS transcript_id,
  cast((cs - l_utr5) / 3 + 1 AS bigint) AS protein_position, codon, translated, in_protein
FROM prot WHERE translated <> in_protein""")
def protein_disagreements(t: Tables) -> DataFrame:
    coding = F.substring("sequence", F.col("l_utr5") + 1, F.col("l_cds"))
    peptide = nuc.translate_sequence(coding)
    # Every other residue of some proteins is spoiled, so there is something to find.
    spoiled = F.array_join(F.transform(
        F.split(peptide, ""), lambda aa, i: F.when((i % 2 == 0) & (aa != ""), "X").otherwise(aa)),
        "")
    proteins = cut_lineage(t("seqs").select(
        F.concat(F.lit("np"), "accession").alias("accession"),
        F.when(F.col("gene_id") % 5 == 0, spoiled).otherwise(peptide).alias("sequence")))
    contexts = plc.stop_contexts(t("variants"), plc.one_model_per_gene(models(t)))
    return rounded(plc.protein_disagreements(contexts, proteins))


@query("sequence_scalars", "seqs", sql=f"""
SELECT accession, {_RNA.format('sequence')} AS rna,
  translate(reverse(sequence), 'ACGT', 'TGCA') AS antisense,
  array_to_string(list_transform(range(0, l_cds // 3),
    lambda i: {sql_residue('substring(sequence, l_utr5 + 1 + 3 * i, 3)')}), '') AS peptide FROM seqs""")
def sequence_scalars(t: Tables) -> DataFrame:
    coding = F.substring("sequence", F.col("l_utr5") + 1, F.col("l_cds"))
    return t("seqs").select(
        "accession", nuc.as_rna(F.col("sequence")).alias("rna"),
        nuc.reverse_complement(F.col("sequence")).alias("antisense"),
        nuc.translate_sequence(coding).alias("peptide"))


# --- Decay --------------------------------------------------------------------------------------

PREDICTORS_SQL = """ruled AS (SELECT variant_id, gene_symbol,
    coalesce(in_last_exon, false) AS rule_last_exon,
    coalesce(nt_to_last_junction > 0 AND nt_to_last_junction <= 50, false)
      AS rule_within_last_junction,
    nt_from_start < 150 AS rule_start_proximal, ptc_exon_length > 407 AS rule_long_exon
  FROM contexts WHERE scoreable),
predictors AS (SELECT *, rule_last_exon OR rule_within_last_junction AS escape_guideline,
    rule_last_exon OR rule_within_last_junction OR rule_start_proximal OR rule_long_exon
      AS escape_full_rules,
    NOT (rule_last_exon OR rule_within_last_junction) AND (rule_start_proximal OR rule_long_exon)
      AS predictors_disagree FROM ruled)"""


@query("decay_predictors", "contexts", sql=f"WITH {PREDICTORS_SQL} SELECT * FROM predictors")
def decay_predictors(t: Tables) -> DataFrame:
    return dec.decay_predictors(t("contexts"))


@query("disagreement_atlas", "contexts", sql=f"""
WITH {PREDICTORS_SQL} SELECT count(*) AS scoreable,
  count(*) FILTER (escape_guideline) AS escape_guideline,
  count(*) FILTER (escape_full_rules) AS escape_full_rules,
  count(*) FILTER (predictors_disagree) AS disagree,
  count(*) FILTER (predictors_disagree AND rule_start_proximal AND NOT rule_long_exon)
    AS driven_by_start_proximal,
  count(*) FILTER (predictors_disagree AND NOT rule_start_proximal AND rule_long_exon)
    AS driven_by_long_exon,
  count(*) FILTER (predictors_disagree AND rule_start_proximal AND rule_long_exon)
    AS driven_by_both,
  round_even(count(*) FILTER (escape_guideline) / count(*), 4) AS guideline_fraction,
  round_even(count(*) FILTER (escape_full_rules) / count(*), 4) AS full_rules_fraction,
  round_even(count(*) FILTER (predictors_disagree) / count(*), 4) AS disagree_fraction
FROM predictors""")
def disagreement_atlas(t: Tables) -> DataFrame:
    return dec.disagreement_atlas(dec.decay_predictors(t("contexts")))


_TOOL_SQL = """vin AS (SELECT 'v' || cast(o_orderkey AS varchar) AS variant_id, o_orderkey,
    o_orderkey % ((SELECT count(*) FROM part) + 100) AS gene_id,
    cast(1 + o_custkey % 22 AS varchar) || ':' || lpad(cast(o_custkey AS varchar), 9, '0')
      || '|A|G' AS key FROM orders),
mane AS (SELECT p_partkey AS gene_id, 'ENST' || cast(p_partkey AS varchar) AS mane_enst
  FROM part WHERE p_partkey % 9 <> 0),
rules AS (SELECT vin.key, 'ENST' || cast(gene_id AS varchar) AS transcript,
    min(o_orderkey) AS o FROM vin WHERE gene_id % 5 <> 0 AND o_orderkey % 3 <> 0 GROUP BY 1, 2),
verdicts AS (SELECT variant_id, r.o IS NOT NULL AS aenmd_available,
    CASE WHEN r.o IS NOT NULL THEN '' WHEN m.mane_enst IS NULL THEN 'no_mane_ensembl'
      WHEN m.mane_enst IN (SELECT transcript FROM rules) THEN 'variant_filtered'
      ELSE 'transcript_absent' END AS reason,
    r.o IS NOT NULL AS aenmd_is_ptc, coalesce(r.o % 2 = 0, false) AS aenmd_is_last,
    coalesce(r.o % 7 = 0, false) AS aenmd_is_penultimate,
    coalesce(r.o % 11 = 0, false) AS aenmd_is_css_proximal, false AS aenmd_is_single,
    coalesce(r.o % 13 = 0, false) AS aenmd_is_407plus
  FROM vin LEFT JOIN mane m ON m.gene_id = vin.gene_id
  LEFT JOIN rules r ON r.key = vin.key AND r.transcript = m.mane_enst),
tool AS (SELECT *, aenmd_is_last OR aenmd_is_penultimate OR aenmd_is_css_proximal
    OR aenmd_is_407plus AS aenmd_escape FROM verdicts)"""


def tool_verdicts(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    genes = t.table("part").agg(F.count(F.lit(1)) + 100).scalar()
    named = t.table("orders").select(
        F.concat(F.lit("v"), o.cast("string")).alias("variant_id"), o.alias("ordinal"),
        (o % genes).alias("gene_id"), (F.col("o_custkey") % 22 + 1).cast("string").alias("chrom"),
        F.col("o_custkey").alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"))
    key = sc.variant_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"))
    raw = named.where((F.col("gene_id") % 5 != 0) & (F.col("ordinal") % 3 != 0)).select(
        key.alias("key"), F.concat(F.lit("ENST"), F.col("gene_id").cast("string"), F.lit(".4"))
        .alias("transcript"), "ordinal", F.lit(True).alias("is_ptc"),
        (F.col("ordinal") % 2 == 0).alias("is_last"),
        (F.col("ordinal") % 7 == 0).alias("is_penultimate"),
        (F.col("ordinal") % 11 == 0).alias("is_css_proximal"), F.lit(False).alias("is_single"),
        (F.col("ordinal") % 13 == 0).alias("is_407plus"))
    summary = t.table("part").select(
        F.concat(F.lit("GeneID:"), F.col("p_partkey").cast("string")).alias("NCBI_GeneID"),
        F.concat(F.lit("ENST"), F.col("p_partkey").cast("string"), F.lit(".2"))
        .alias("Ensembl_nuc"),
        F.when(F.col("p_partkey") % 9 == 0, "MANE Plus Clinical").otherwise("MANE Select")
        .alias("MANE_status"), F.col("p_partkey").alias("ordinal"))
    return dec.external_verdicts(dec.rule_table(raw), named,
                                 dec.select_transcript_by_gene(summary))


@query("external_verdicts", sql=f"WITH {_TOOL_SQL} SELECT * FROM tool")
def external_verdicts(t: Tables) -> DataFrame:
    return tool_verdicts(t)


@query("tool_agreement", "contexts", sql=f"""
WITH {PREDICTORS_SQL}, {_TOOL_SQL}, both_ AS (SELECT p.*, tool.aenmd_escape
  FROM predictors p JOIN tool ON tool.variant_id = p.variant_id WHERE aenmd_available)
SELECT (SELECT count(*) FROM predictors) AS scoreable,
  (SELECT count(*) FROM tool WHERE aenmd_available) AS aenmd_available,
  count(*) AS both_available,
  (SELECT round_even(count(*) FILTER (aenmd_available) / count(*), 4) FROM tool)
    AS aenmd_available_fraction,
  count(*) FILTER (aenmd_escape) AS aenmd_escape,
  round_even(count(*) FILTER (aenmd_escape) / count(*), 4) AS aenmd_escape_fraction,
  count(*) FILTER (escape_full_rules = aenmd_escape) AS full_rules_vs_aenmd_agree,
  round_even(count(*) FILTER (escape_full_rules = aenmd_escape) / count(*), 4)
    AS full_rules_vs_aenmd_agree_fraction,
  count(*) FILTER (escape_full_rules AND NOT aenmd_escape) AS full_escape_aenmd_decay,
  count(*) FILTER (NOT escape_full_rules AND aenmd_escape) AS full_decay_aenmd_escape,
  round_even(count(*) FILTER (escape_guideline = aenmd_escape) / count(*), 4)
    AS guideline_vs_aenmd_agree_fraction FROM both_""")
def tool_agreement(t: Tables) -> DataFrame:
    return dec.tool_agreement(dec.decay_predictors(t("contexts")), tool_verdicts(t))


def efficiencies(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    return dec.efficiency_table(t.table("orders").select(
        F.concat(F.lit("v"), o.cast("string")).alias("variant_id"),
        (o % 3 != 1).alias("nmd_available"), F.lit("not_placed").alias("reason"),
        F.when(o % 3 != 1, (F.floor("o_totalprice") % 4000 - 1000) / 1000.0)
        .alias("nmd_efficiency")))


@query("efficiency_separation", "contexts", sql=f"""
WITH {PREDICTORS_SQL}, eff AS (SELECT 'v' || cast(o_orderkey AS varchar) AS variant_id,
    (cast(floor(o_totalprice) AS bigint) % 4000 - 1000) / 1000.0 AS e FROM orders
    WHERE o_orderkey % 3 <> 1),
j AS (SELECT p.*, e FROM predictors p JOIN eff ON eff.variant_id = p.variant_id)
SELECT (SELECT count(*) FROM predictors) AS scoreable, (SELECT count(*) FROM eff) AS available,
  (SELECT round_even((SELECT count(*) FROM eff) / count(*), 4) FROM orders) AS available_fraction,
  round_even(median(e), 4) AS efficiency_median, count(*) AS both_available,
  round_even(avg(e) FILTER (escape_guideline), 4) AS guideline_escape_mean_efficiency,
  round_even(avg(e) FILTER (NOT escape_guideline), 4) AS guideline_decay_mean_efficiency,
  round_even(avg(e) FILTER (NOT escape_guideline) - avg(e) FILTER (escape_guideline), 4)
    AS guideline_separation,
  round_even(avg(e) FILTER (escape_full_rules), 4) AS full_rules_escape_mean_efficiency,
  round_even(avg(e) FILTER (NOT escape_full_rules), 4) AS full_rules_decay_mean_efficiency,
  round_even(avg(e) FILTER (NOT escape_full_rules) - avg(e) FILTER (escape_full_rules), 4)
    AS full_rules_separation FROM j""")
def efficiency_separation(t: Tables) -> DataFrame:
    return dec.efficiency_separation(dec.decay_predictors(t("contexts")), efficiencies(t))


# --- Editing ------------------------------------------------------------------------------------

_EDITORS = ", ".join(
    f"({i}, '{n}', '{arm}', '{f}', '{to}', {lo}, {hi}, '{nuc.pam_pattern(pam)}', {relaxed})"
    for relaxed, panel in (("false", PRIMARY_PANEL), ("true", SENSITIVITY_PANEL))
    for i, (n, f, to, lo, hi, pam, arm) in enumerate(panel))


def _guides_sql(relaxed: bool) -> str:
    """The whole search as joins: candidates by editor, strand and position, then placements."""

    which = "" if relaxed else "WHERE NOT relaxed"
    aa_old = sql_residue("oldc")
    aa_new = sql_residue("newc")
    return f"""editors AS (SELECT * FROM (VALUES {_EDITORS})
    AS e(eo, editor, arm, ef, et, lo, hi, pam, relaxed) {which}),
stops AS (SELECT variant_id, gene_id, o, cs, codon, mutated, sequence, l_utr5, l_cds, e0, e1,
    greatest(cs - 26, 0) AS low FROM reasoned
  WHERE reason IN ('', 'truncated_context')),
win AS (SELECT *, substring(substring(sequence, 1, cs) || mutated || substring(sequence, cs + 4),
      low + 1, cs + 29 - low) AS w FROM stops),
cand AS (SELECT win.*, editor, arm, relaxed, eo, strand, p, lo, hi, pam, length(w) AS n,
    CASE WHEN strand = 0 THEN ef ELSE translate(ef, 'ACGT', 'TGCA') END AS sf,
    CASE WHEN strand = 0 THEN et ELSE translate(et, 'ACGT', 'TGCA') END AS st,
    cs - low + p AS target, CASE WHEN strand = 0 THEN w
      ELSE translate(reverse(w), 'ACGT', 'TGCA') END AS rd
  FROM win CROSS JOIN editors CROSS JOIN (VALUES (0), (1)) AS s(strand)
    CROSS JOIN (VALUES (0), (1), (2)) AS q(p)),
hits AS (SELECT *, substring(mutated, 1, p) || st || substring(mutated, p + 2) AS nc,
    CASE WHEN strand = 0 THEN target ELSE n - 1 - target END AS tr
  FROM cand WHERE substring(mutated, p + 1, 1) = sf
    AND (substring(mutated, 1, p) || st || substring(mutated, p + 2)) NOT IN {STOPS_SQL}),
tries AS (SELECT *, unnest(range(tr - 19, tr + 1)) AS s FROM hits),
fits AS (SELECT *, tr - s + 1 AS wp FROM tries WHERE s >= 0 AND s + 23 <= n
    AND regexp_matches(substring(rd, s + 21, 3), pam)
    AND NOT ((strand = 0 AND e0 > low AND e0 < low + n AND s < e0 - low AND e0 - low < s + 23)
      OR (strand = 0 AND e0 + e1 > low AND e0 + e1 < low + n AND s < e0 + e1 - low
          AND e0 + e1 - low < s + 23)
      OR (strand = 1 AND e0 > low AND e0 < low + n AND s < n - e0 + low AND n - e0 + low < s + 23)
      OR (strand = 1 AND e0 + e1 > low AND e0 + e1 < low + n AND s < n - e0 - e1 + low
          AND n - e0 - e1 + low < s + 23))),
guides AS (SELECT *, row_number() OVER () AS gid,
    CASE WHEN strand = 0 THEN s + lo - 1 ELSE n - s - hi END AS wl,
    CASE WHEN strand = 0 THEN s + hi - 1 ELSE n - s - lo END AS wh
  FROM fits WHERE wp BETWEEN lo AND hi),
touched AS (SELECT gid, w, st, target, l_utr5 - low AS cl, l_utr5 + l_cds - 1 - low AS ce, i
  FROM (SELECT *, unnest(range(wl, wh + 1)) AS i FROM guides) AS g
  WHERE i <> target AND substring(w, i + 1, 1) = sf),
read AS (SELECT gid, i, CASE WHEN i >= cl AND i <= ce AND cl + 3 * floor((i - cl) / 3) >= 0
      THEN substring(w, cast(cl + 3 * floor((i - cl) / 3) AS bigint) + 1, 3) END AS oldc,
    i - cast(cl + 3 * floor((i - cl) / 3) AS bigint) AS ph, st FROM touched),
edits AS (SELECT gid, i, CASE WHEN length(oldc) = 3 THEN oldc END AS oldc,
    CASE WHEN length(oldc) = 3 THEN substring(oldc, 1, ph) || st || substring(oldc, ph + 2) END
      AS newc FROM read),
missense AS (SELECT gid, count(*) FILTER ({aa_old} <> {aa_new}) AS m FROM edits GROUP BY gid),
full_guides AS (SELECT g.*, coalesce(m, 0) AS m,
    CASE WHEN nc = codon THEN 'exact_wildtype' ELSE 'alternative_sense' END AS restores
  FROM guides g LEFT JOIN missense ON missense.gid = g.gid),
per AS (SELECT variant_id, count(*) AS n_guides,
    count(*) FILTER (restores = 'exact_wildtype') AS n_exact, bool_or(m = 0) AS free,
    bool_or(arm = 'primary') AS prim FROM full_guides GROUP BY variant_id),
best AS (SELECT * FROM full_guides QUALIFY row_number() OVER (PARTITION BY variant_id
    ORDER BY restores <> 'exact_wildtype', m > 0, m, relaxed, eo, strand, p, s) = 1),
reach AS (SELECT v.variant_id, v.gene_id, st.variant_id IS NOT NULL AS scoreable,
    CASE WHEN st.variant_id IS NULL THEN 'unscoreable_context' WHEN per.variant_id IS NOT NULL
      THEN '' WHEN st.variant_id NOT IN (SELECT variant_id FROM hits)
      THEN 'no_stop_removing_edit' WHEN st.variant_id IN (SELECT variant_id FROM fits)
      THEN 'target_outside_window' ELSE 'no_pam' END AS reason,
    cast((st.cs - st.l_utr5) / 3 + 1 AS bigint) AS protein_position, st.mutated AS stop_type,
    per.variant_id IS NOT NULL AS reachable, coalesce(prim, false) AS primary_reachable,
    per.variant_id IS NOT NULL AND NOT coalesce(prim, false) AS requires_relaxed_pam,
    CASE WHEN st.variant_id IS NULL THEN '' WHEN n_exact > 0 THEN 'base_editable_exact'
      WHEN n_guides > 0 THEN 'base_editable_alternative'
      ELSE 'not_base_editable_under_panel' END AS reach_class,
    CASE WHEN st.variant_id IS NOT NULL THEN coalesce(n_guides, 0) END AS n_guides,
    CASE WHEN st.variant_id IS NOT NULL THEN coalesce(n_exact, 0) END AS n_exact,
    CASE WHEN st.variant_id IS NOT NULL THEN coalesce(free, false) END AS bystander_free,
    CASE WHEN st.variant_id IS NOT NULL THEN coalesce(editor, '') END AS editor,
    CASE WHEN st.variant_id IS NOT NULL THEN coalesce(arm, '') END AS arm,
    CASE WHEN st.variant_id IS NOT NULL THEN coalesce(
      CASE best.strand WHEN 0 THEN 'sense' WHEN 1 THEN 'antisense' END, '') END AS strand,
    CASE WHEN st.variant_id IS NOT NULL THEN coalesce(restores, '') END AS restores,
    wp AS window_position
  FROM variants v LEFT JOIN stops st ON st.variant_id = v.variant_id
  LEFT JOIN per ON per.variant_id = v.variant_id LEFT JOIN best ON best.variant_id = v.variant_id)"""


def guided(t: Tables, panel: tuple = PRIMARY_PANEL) -> DataFrame:
    return ed.stop_guides(t("variants").drop("gene_symbol"), plc.one_model_per_gene(models(t)),
                          panel)


@query("editing_reachability", "variants", "exons", sql=f"""
WITH {PLACED_SQL}, {_guides_sql(False)} SELECT * FROM reach""")
def editing_reachability(t: Tables) -> DataFrame:
    return rounded(ed.reachability(guided(t)))


@query("editing_reachability_relaxed", "variants", "exons", sql=f"""
WITH {PLACED_SQL}, {_guides_sql(True)} SELECT * FROM reach""")
def editing_reachability_relaxed(t: Tables) -> DataFrame:
    return rounded(ed.reachability(guided(t, PRIMARY_PANEL + SENSITIVITY_PANEL)))


@query("editing_guides", "variants", "exons", sql=f"""
WITH {PLACED_SQL}, {_guides_sql(False)} SELECT variant_id, editor, arm,
  CASE strand WHEN 0 THEN 'sense' ELSE 'antisense' END AS strand,
  substring(rd, s + 1, 20) AS protospacer, substring(rd, s + 21, 3) AS pam, wp AS window_position,
  restores, nc AS new_codon, (SELECT count(*) FROM touched WHERE touched.gid = g.gid) AS bystanders,
  m AS missense FROM full_guides g""")
def editing_guides(t: Tables) -> DataFrame:
    # A filter on the guides would be pushed below the search and search every variant again.
    rows = guided(t).select("variant_id", F.explode_outer("guides").alias("g")).where(
        F.col("g").isNotNull())
    missense = F.size(F.filter("g.bystanders", lambda b: ~b["silent"]))
    return rounded(rows.select(
        "variant_id", *[f"g.{c}" for c in (
            "editor", "arm", "strand", "protospacer", "pam", "window_position", "restores",
            "new_codon")],
        F.size("g.bystanders").alias("bystanders"), missense.alias("missense")))


@query("escape_summary", "variants", "exons", sql=f"""
WITH {PLACED_SQL}, {_guides_sql(False)} SELECT count(*) AS total,
  count(*) FILTER (scoreable) AS scoreable, count(*) FILTER (NOT scoreable) AS unscoreable,
  count(*) FILTER (reach_class = 'base_editable_exact') AS exact,
  count(*) FILTER (reach_class = 'base_editable_alternative') AS alternative,
  count(*) FILTER (reach_class = 'not_base_editable_under_panel') AS not_editable,
  count(*) FILTER (reachable) AS reachable,
  count(*) FILTER (bystander_free) AS reachable_bystander_free,
  count(*) FILTER (bystander_free AND n_exact > 0) AS exact_bystander_free FROM reach""")
def escape_summary(t: Tables) -> DataFrame:
    return ed.escape_summary(ed.reachability(guided(t)))


@query("panel_comparison", "variants", "exons", sql=f"""
WITH {PLACED_SQL}, {_guides_sql(True)}, prim AS (SELECT variant_id, CASE
    WHEN count(*) FILTER (restores = 'exact_wildtype') > 0 THEN 'base_editable_exact'
    ELSE 'base_editable_alternative' END AS cls FROM full_guides WHERE NOT relaxed GROUP BY 1)
SELECT 'primary' AS panel, coalesce(cls, 'not_base_editable_under_panel') AS measure,
  count(*) AS variants FROM reach LEFT JOIN prim USING (variant_id) WHERE scoreable GROUP BY 1, 2
UNION ALL SELECT 'relaxed', reach_class, count(*) FROM reach WHERE scoreable GROUP BY 1, 2
UNION ALL SELECT 'relaxed', 'incremental', count(*) FROM reach WHERE requires_relaxed_pam
  GROUP BY 1, 2
UNION ALL SELECT 'residual', reason, count(*) FROM reach
  WHERE reach_class = 'not_base_editable_under_panel' GROUP BY 1, 2""")
def panel_comparison(t: Tables) -> DataFrame:
    return ed.panel_comparison(guided(t, PRIMARY_PANEL + SENSITIVITY_PANEL))


@query("pam_match", "seqs", sql="""
SELECT rule, count(*) AS windows, count(*) FILTER (regexp_matches(pam, pattern)) AS matched
FROM (SELECT substring(sequence, 50, 3) AS pam FROM seqs) AS s
CROSS JOIN (VALUES ('NGG', '^[ACGT]GG'), ('NG', '^[ACGT]G'), ('NRN', '^[ACGT][AG][ACGT]'))
  AS r(rule, pattern) GROUP BY rule""")
def pam_match(t: Tables) -> DataFrame:
    window = t("seqs").select(F.substring("sequence", 50, 3).alias("pam"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"),
                               F.col("pam").rlike(nuc.pam_pattern(r)).alias("ok"))
                      for r in ("NGG", "NG", "NRN")])
    return window.select(F.inline(rules)).groupBy("rule").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if("ok").alias("matched"))


# --- Landscape ----------------------------------------------------------------------------------

BEST_SQL = """best AS (SELECT * FROM scores WHERE status = 'present' QUALIFY row_number() OVER (
    PARTITION BY variant_id ORDER BY readthrough_predicted DESC, therapy_id) = 1)"""

LANDSCAPE_SQL = f"""{BEST_SQL}, {NEAR_SQL},
shares AS (SELECT a AS aa, stop, avg(CASE WHEN s >= 0 THEN 1.0 ELSE 0.0 END) AS share
  FROM near JOIN {sql_scores()} ON m.b = near.aa GROUP BY a, stop),
landscape AS (SELECT c.variant_id, c.ordinal, gene_symbol, protein_position, stop_type,
    original_aa, review_stars, {ESCAPES_SQL} AS escapes_decay_by_rule, nt_to_last_junction,
    therapy_id AS best_therapy, readthrough_predicted AS best_readthrough,
    readthrough_low AS best_readthrough_low, share AS tolerable_insertion_share
  FROM contexts c LEFT JOIN best ON best.variant_id = c.variant_id
  LEFT JOIN shares ON shares.aa = original_aa AND shares.stop = {DNA_SQL.format('stop_type')}
  WHERE scoreable)"""


def landscape_of(t: Tables) -> DataFrame:
    return land.landscape(t("contexts"), t("scores"))


@query("landscape", "scores", sql=f"""
WITH {LANDSCAPE_SQL} SELECT variant_id, gene_symbol,
  cast(protein_position AS bigint) AS protein_position, stop_type, original_aa,
  cast(review_stars AS bigint) AS review_stars, escapes_decay_by_rule,
  cast(nt_to_last_junction AS bigint) AS nt_to_last_junction, best_therapy,
  round(best_readthrough, 6) AS best_readthrough,
  round(best_readthrough_low, 6) AS best_readthrough_low,
  round(tolerable_insertion_share, 6) AS tolerable_insertion_share FROM landscape""")
def landscape(t: Tables) -> DataFrame:
    return rounded(landscape_of(t))


@query("threshold_summary", "scores", sql=f"""
WITH {LANDSCAPE_SQL} SELECT t AS readthrough_threshold, count(*) AS variants,
  count(*) FILTER (escapes_decay_by_rule) AS escapes_decay,
  count(*) FILTER (best_readthrough >= t) AS reaches_threshold,
  count(*) FILTER (best_readthrough_low >= t) AS reaches_threshold_lower_bound,
  count(*) FILTER (tolerable_insertion_share >= 0.5) AS most_insertions_tolerable,
  count(*) FILTER (escapes_decay_by_rule AND best_readthrough >= t
    AND tolerable_insertion_share >= 0.5) AS all_conditions,
  count(*) FILTER (escapes_decay_by_rule AND best_readthrough_low >= t
    AND tolerable_insertion_share >= 0.5) AS all_conditions_lower_bound
FROM landscape CROSS JOIN (VALUES (0.005::DOUBLE), (0.01::DOUBLE), (0.02::DOUBLE)) AS x(t)
GROUP BY t""")
def threshold_summary(t: Tables) -> DataFrame:
    return land.threshold_summary(landscape_of(t))


@query("escape_map", "scores", sql=f"""
WITH best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY variant_id
  ORDER BY readthrough_predicted DESC NULLS LAST, therapy_id) = 1)
SELECT c.variant_id, c.gene_symbol, therapy_id AS best_therapy,
  round(readthrough_predicted, 6) AS best_readthrough,
  round(readthrough_low, 6) AS best_readthrough_low,
  round(readthrough_high, 6) AS best_readthrough_high
FROM contexts c LEFT JOIN best ON best.variant_id = c.variant_id""")
def escape_map(t: Tables) -> DataFrame:
    return rounded(ed.escape_map(t("contexts").select("variant_id", "gene_symbol"), t("scores")))


@query("interval_overlap", "scores", sql="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY variant_id
    ORDER BY readthrough_predicted DESC, therapy_id) AS k FROM scores
  WHERE readthrough_predicted IS NOT NULL)
SELECT a.variant_id, a.therapy_id AS first_therapy, b.therapy_id AS second_therapy,
  round(CASE WHEN b.k = 2 THEN greatest(a.readthrough_low, b.readthrough_low) END, 6)
    AS overlap_low,
  round(CASE WHEN b.k = 2 THEN least(a.readthrough_high, b.readthrough_high) END, 6)
    AS overlap_high,
  coalesce(least(a.readthrough_high, b.readthrough_high)
    > greatest(a.readthrough_low, b.readthrough_low) AND b.k = 2, false) AS overlaps
FROM r a LEFT JOIN r b ON b.variant_id = a.variant_id AND b.k = 2 WHERE a.k = 1""")
def interval_overlap(t: Tables) -> DataFrame:
    return rounded(land.interval_overlap(t("scores")))


@query("near_cognate_residues", "contexts", sql=f"""
WITH {NEAR_SQL} SELECT stop_type, n AS variants, residues FROM
  (SELECT stop_type, count(*) AS n FROM contexts WHERE scoreable GROUP BY 1) AS c
  JOIN (SELECT stop, string_agg(aa, ',' ORDER BY aa) AS residues FROM near GROUP BY stop) AS r
  ON r.stop = {DNA_SQL.format('stop_type')}""")
def near_cognate_residues(t: Tables) -> DataFrame:
    return t("contexts").where("scoreable").groupBy("stop_type").agg(
        F.count(F.lit(1)).alias("variants")).withColumn(
        "residues", land.near_cognate_residues(F.col("stop_type")))


@query("substitution_similarity", "contexts", sql=f"""
SELECT original_aa, inserted_aa, n AS pairs, cast(m.s AS bigint) AS similarity,
  m.s >= 0 AS conservative FROM (SELECT original_aa, substring('ACDEFGHIKLMNPQRSTVWY',
    cast(1 + ordinal % 20 AS int), 1) AS inserted_aa, count(*) AS n FROM contexts
    WHERE scoreable GROUP BY 1, 2) AS c
JOIN {sql_scores()} ON m.a = original_aa AND m.b = inserted_aa""")
def substitution_similarity(t: Tables) -> DataFrame:
    inserted = F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), (F.col("ordinal") % 20 + 1).cast("int"),
                           F.lit(1))
    counted = t("contexts").where("scoreable").groupBy(
        "original_aa", inserted.alias("inserted_aa")).agg(F.count(F.lit(1)).alias("pairs"))
    a, b = F.col("original_aa"), F.col("inserted_aa")
    return rounded(counted.select("*", land.similarity(a, b).alias("similarity"),
                                  land.conservative(a, b).alias("conservative")))


# --- Coverage -----------------------------------------------------------------------------------

_DESIGN = "upper(stop_type) || '-' || original_aa"


@query("covered_sets", "contexts", sql=f"""
SELECT DISTINCT {_DESIGN} AS design_id, gene_symbol AS element FROM contexts WHERE scoreable""")
def covered_sets(t: Tables) -> DataFrame:
    return cov.covered_sets(t("contexts"), "gene_symbol")


@query("is_partition", "contexts", sql=f"""
SELECT objective, count(*) AS total, count(DISTINCT element) AS in_union,
  count(*) = count(DISTINCT element) AS partition
FROM (SELECT DISTINCT 'variants' AS objective, {_DESIGN} AS d, variant_id AS element FROM contexts
      WHERE scoreable UNION ALL
      SELECT DISTINCT 'genes', {_DESIGN}, gene_symbol FROM contexts WHERE scoreable) AS s
GROUP BY objective""")
def is_partition(t: Tables) -> DataFrame:
    both = [cov.is_partition(cov.covered_sets(t("contexts"), c)).select(
        F.lit(n).alias("objective"), "*") for n, c in (
        ("variants", "variant_id"), ("genes", "gene_symbol"))]
    return both[0].unionByName(both[1])


@query("coverage_frontier_variants", "contexts", sql=f"""
SELECT row_number() OVER w AS rank, design_id, split_part(design_id, '-', 1) AS recognized_stop,
  split_part(design_id, '-', 2) AS inserted_aa, n AS marginal,
  cast(sum(n) OVER w AS bigint) AS cumulative,
  round(sum(n) OVER w / sum(n) OVER (), 6) AS cumulative_fraction,
  cast(sum(n) OVER () - sum(n) OVER w AS bigint) AS uncovered
FROM (SELECT {_DESIGN} AS design_id, count(DISTINCT variant_id) AS n FROM contexts
      WHERE scoreable GROUP BY 1) AS s WINDOW w AS (ORDER BY n DESC, design_id)""")
def coverage_frontier_variants(t: Tables) -> DataFrame:
    return rounded(cov.coverage_frontier(t("contexts"), "variants"))


def _greedy_sql(sets: str) -> str:
    """Greedy cover as a recursive query: each step's list of chosen designs, then its gain."""

    return f"""WITH {sets}, total AS (SELECT count(DISTINCT element) AS n FROM fam),
sig AS (SELECT by_, count(*) AS c FROM (SELECT element, list_sort(list(DISTINCT design_id)) AS by_
    FROM fam GROUP BY element) AS e GROUP BY by_),
steps AS (SELECT 0 AS rank, cast([] AS VARCHAR[]) AS chosen, cast(0 AS bigint) AS gain
  UNION ALL SELECT rank + 1, list_append(chosen, d), g FROM (
    SELECT rank, chosen, d, g, row_number() OVER (ORDER BY g DESC, d) AS k FROM (
      SELECT rank, chosen, d, cast(sum(c) AS bigint) AS g FROM (
        SELECT rank, chosen, unnest(by_) AS d, c FROM steps, sig
        WHERE NOT list_has_any(by_, chosen)) AS u GROUP BY rank, chosen, d) AS q) AS r
  WHERE k = 1)
SELECT cast(rank AS bigint) AS rank, chosen[rank] AS design_id,
  split_part(chosen[rank], '-', 1) AS recognized_stop,
  split_part(chosen[rank], '-', 2) AS inserted_aa, gain AS marginal,
  cast(sum(gain) OVER (ORDER BY rank) AS bigint) AS cumulative,
  round(sum(gain) OVER (ORDER BY rank) / (SELECT n FROM total), 6) AS cumulative_fraction,
  cast((SELECT n FROM total) - sum(gain) OVER (ORDER BY rank) AS bigint) AS uncovered
FROM steps WHERE rank > 0"""


@query("coverage_frontier_genes", "contexts", sql=_greedy_sql(
    f"fam AS (SELECT DISTINCT {_DESIGN} AS design_id, gene_symbol AS element FROM contexts "
    "WHERE scoreable)"))
def coverage_frontier_genes(t: Tables) -> DataFrame:
    return rounded(cov.coverage_frontier(t("contexts"), "genes"))


@query("disease_reach_frontier", "conditions", "contexts", sql=_greedy_sql(
    f"fam AS (SELECT DISTINCT {_DESIGN} AS design_id, medgen AS element FROM conditions d "
    "JOIN contexts c ON c.variant_id = d.variant_id WHERE scoreable "
    "AND mapping_status IN ('mapped', 'medgen_only'))"))
def disease_reach_frontier(t: Tables) -> DataFrame:
    return rounded(cov.disease_reach_frontier(t("conditions"), t("contexts")))


@query("panel_readout", "contexts", sql=f"""
SELECT * FROM (SELECT row_number() OVER w AS rank, cast(sum(n) OVER w AS bigint) AS cumulative,
  round(sum(n) OVER w / sum(n) OVER (), 6) AS cumulative_fraction,
  cast(sum(n) OVER () - sum(n) OVER w AS bigint) AS uncovered
FROM (SELECT {_DESIGN} AS design_id, count(DISTINCT variant_id) AS n FROM contexts
      WHERE scoreable GROUP BY 1) AS s WINDOW w AS (ORDER BY n DESC, design_id)) AS f
WHERE rank IN (1, 3, 5, 10)""")
def panel_readout(t: Tables) -> DataFrame:
    return rounded(cov.panel_readout(cov.coverage_frontier(t("contexts"), "variants")))


@query("coverage_by_design", "contexts", sql=f"""
WITH c AS (SELECT upper(stop_type) AS recognized_stop, original_aa, count(*) AS n FROM contexts
  WHERE stop_type IS NOT NULL GROUP BY 1, 2)
SELECT recognized_stop || '-' || b AS design_id, recognized_stop, b AS inserted_aa,
  cast(sum(n) AS bigint) AS variants_at_stop,
  cast(coalesce(sum(n) FILTER (original_aa = b), 0) AS bigint) AS restores_exactly,
  cast(coalesce(sum(n) FILTER (s >= 0), 0) AS bigint) AS conservative
FROM c JOIN {sql_scores()} ON m.a = original_aa GROUP BY recognized_stop, b""")
def coverage_by_design(t: Tables) -> DataFrame:
    return cov.coverage_by_design(t("contexts"))


DISEASE_SQL = f"""named AS (SELECT * FROM conditions
    WHERE mapping_status IN ('mapped', 'medgen_only')),
merged AS (SELECT d.*, coalesce(c.scoreable, false) AS covered,
    CASE WHEN c.scoreable THEN {_DESIGN} ELSE '' END AS design_id
  FROM named d LEFT JOIN contexts c ON c.variant_id = d.variant_id),
names AS (SELECT medgen, condition_name FROM (SELECT medgen, condition_name, count(*) AS n
    FROM merged GROUP BY 1, 2) AS q QUALIFY row_number() OVER (PARTITION BY medgen
    ORDER BY n DESC, condition_name) = 1),
entities AS (SELECT medgen, coalesce(arg_min(omim, ordinal) FILTER (omim <> ''), '') AS omim,
    coalesce(arg_min(orphanet, ordinal) FILTER (orphanet <> ''), '') AS orphanet,
    count(DISTINCT variant_id) AS eligible_variants,
    count(DISTINCT variant_id) FILTER (covered) AS model_covered,
    count(DISTINCT gene_symbol) AS genes,
    count(DISTINCT design_id) FILTER (covered AND design_id <> '') AS designs_contributing,
    coalesce(string_agg(DISTINCT design_id, ';' ORDER BY design_id)
      FILTER (covered AND design_id <> ''), '') AS designs FROM merged GROUP BY medgen),
coverage AS (SELECT e.medgen, condition_name, omim, orphanet, eligible_variants, model_covered,
    round_even(model_covered / eligible_variants, 4) AS covered_fraction,
    model_covered >= 1 AS reach, model_covered = eligible_variants AS complete, genes,
    designs_contributing, designs, CASE WHEN omim <> '' OR orphanet <> '' THEN 'mapped'
      ELSE 'medgen_only' END AS mapping_completeness
  FROM entities e JOIN names ON names.medgen = e.medgen)"""


@query("disease_coverage", "conditions", "contexts",
       sql=f"WITH {DISEASE_SQL} SELECT * FROM coverage")
def disease_coverage(t: Tables) -> DataFrame:
    return rounded(cov.disease_coverage(t("conditions"), t("contexts")))


@query("condition_coverage_top", "conditions", "contexts", sql=f"""
WITH {DISEASE_SQL} SELECT medgen, condition_name, eligible_variants, model_covered, genes
FROM coverage ORDER BY eligible_variants DESC, medgen LIMIT 50""")
def condition_coverage_top(t: Tables) -> DataFrame:
    return cov.disease_coverage(t("conditions"), t("contexts")).select(
        "medgen", "condition_name", "eligible_variants", "model_covered", "genes").orderBy(
        F.desc("eligible_variants"), "medgen").limit(50)


# --- Contracts ----------------------------------------------------------------------------------


@query("contract_violations", sql="""
WITH l AS (SELECT o_orderkey % 4000 AS k, o_orderkey, o_totalprice / 400000.0 AS e,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice - 1500.0 END AS sd FROM orders)
SELECT * FROM (
  SELECT 'stop_codon' AS column_name, 'isin' AS check_name,
    count(*) FILTER (o_orderkey % 5 = 4) AS failures FROM l
  UNION ALL SELECT 'gene_id', 'not_null', count(*) FILTER (o_orderkey % 11 = 0) FROM l
  UNION ALL SELECT 'readthrough_efficiency', 'le_1', count(*) FILTER (e > 1) FROM l
  UNION ALL SELECT 'replicate_sd', 'ge_0', count(*) FILTER (sd < 0) FROM l
  UNION ALL SELECT 'extra', 'undeclared_column', 1
  UNION ALL SELECT 'censored', 'type_int', 1) AS v WHERE failures > 0""")
def contract_violations(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    labels = t.table("orders").select(
        o.cast("string").alias("variant_id"),
        F.when(o % 11 != 0, F.col("o_custkey").cast("string")).alias("gene_id"),
        F.lit("th").alias("therapy_id"),
        F.element_at(F.lit(["UAA", "UAG", "UGA", "UAA", "TAA"]), (o % 5 + 1).cast("int"))
        .alias("stop_codon"), (F.col("o_totalprice") / 400000.0).alias("readthrough_efficiency"),
        F.when(o % 7 != 0, F.col("o_totalprice") - 1500.0).alias("replicate_sd"),
        F.lit(1).alias("censored"), F.lit("x").alias("extra"))
    return ct.violations(labels, ct.READTHROUGH_LABELS)


@query("run_sheet_violations", sql="""
WITH c AS (SELECT c_custkey, 's' || cast(c_custkey % 900 AS varchar) AS sample FROM customer)
SELECT * FROM (
  SELECT 'sample' AS column_name, 'unique' AS check_name, count(*) AS failures FROM
    (SELECT sample FROM c GROUP BY sample HAVING count(*) > 1) AS d
  UNION ALL SELECT 'adapter_3p', 'matches', count(*) FILTER (c_custkey % 8 = 7) FROM c
  UNION ALL SELECT 'replicate', 'gt_0', count(*) FILTER (c_custkey % 6 = 0) FROM c
  UNION ALL SELECT '*', 'overlap_exceeds_degenerate_prefix',
    count(*) FILTER (c_custkey % 5 <= 2 AND c_custkey % 8 <> 7) FROM c
  UNION ALL SELECT '*', 'second_read_matches_layout',
    count(*) FILTER ((c_custkey % 3 = 0) <> (c_custkey % 2 = 0)) FROM c) AS v
WHERE failures > 0""")
def run_sheet_violations(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    runs = t.table("customer").select(
        F.lit("d1").alias("dataset"), F.concat(F.lit("s"), (k % 900).cast("string"))
        .alias("sample"), k.cast("string").alias("run_accession"), F.lit("x").alias("cell_line"),
        F.lit(None).cast("string").alias("variant"), F.lit("a").alias("treatment"),
        (k % 6).cast("int").alias("replicate"), F.lit("riboseq").alias("assay"),
        F.when(k % 2 == 0, "paired").otherwise("single").alias("layout"),
        F.lit(10).cast("bigint").alias("read_count"),
        F.when(k % 8 == 7, "acgt").otherwise("NNACGT").alias("adapter_3p"),
        F.lit(None).cast("string").alias("adapter_3p_2"),
        F.when(k % 8 == 7, F.lit(3)).otherwise(k % 5).cast("int").alias("adapter_overlap"),
        F.lit(0).alias("cut_5p"), F.lit("f").alias("fastq_1"),
        F.when(k % 3 == 0, "g").alias("fastq_2"))
    found = ct.violations(runs, ct.STAGED_RUNS)
    return found.where("not (column_name = 'adapter_overlap')")


@query("label_summary", sql="""
SELECT count(*) AS labels, count(*) FILTER (toxic = 1) AS censored FROM labels""")
def label_summary(t: Tables) -> DataFrame:
    return ct.label_summary(t.table("labels").select((F.col("toxic") == 1).alias("censored")))
