"""The operators' input shapes, derived from the given tables in SQL that Spark and DuckDB share.

The given tables hold no sequences or alignments. Each shape below is one expression over whole
tables (a nucleotide string is the digest of a key spelled in four letters), so a query's work
grows with the tables, and the same text gives an independent engine the same input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def nt(text: str) -> str:
    """Thirty-two bases from a digest."""

    return f"translate(md5({text}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def codon_rna(text: str) -> str:
    return f"translate(substring(md5({text}), 1, 3), '0123456789abcdef', 'acguacguacguacgu')"


def text(column: str) -> str:
    return f"cast({column} AS string)"


RAW_NT = 416
_RAW = " || ".join(nt(f"'s{i}|' || {text('p_partkey')}") for i in range(RAW_NT // 32))

CARRIERS: dict[str, str] = {}

CARRIERS["seqs"] = f"""
SELECT gene_id, accession, accession AS transcript, l_utr5, l_cds,
       cast({RAW_NT} - l_utr5 - l_cds AS int) AS l_utr3, e0, e1,
       substring(raw, 1, l_utr5 + l_cds - 3) ||
       CASE gene_id % 4 WHEN 0 THEN 'TAA' WHEN 1 THEN 'TAG' WHEN 2 THEN 'TGA'
            ELSE substring(raw, l_utr5 + l_cds - 2, 3) END ||
       substring(raw, l_utr5 + l_cds + 1, {RAW_NT}) AS sequence
FROM (SELECT p_partkey AS gene_id, 't' || {text('p_partkey')} AS accession, {_RAW} AS raw,
             cast(30 + p_partkey % 30 AS int) AS l_utr5,
             cast(3 * (70 + p_partkey % 20) AS int) AS l_cds,
             cast(110 + p_partkey % 20 AS int) AS e0, cast(120 + p_partkey % 30 AS int) AS e1
      FROM {{part}}) AS r"""

CARRIERS["exons"] = f"""
SELECT gene_id, transcript, k, off, len, l_utr5, l_cds,
       'chr' || {text('1 + gene_id % 22')} AS chrom,
       CASE WHEN gene_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
       CASE WHEN gene_id % 2 = 0 THEN 1000 * (gene_id % 1000) + off + 50 * k + 1
            ELSE 1000 * (gene_id % 1000) + {RAW_NT} - off - len + 50 * (2 - k) + 1 END AS beg
FROM (SELECT gene_id, transcript, l_utr5, l_cds, k,
             CASE k WHEN 0 THEN 0 WHEN 1 THEN e0 ELSE e0 + e1 END AS off,
             CASE k WHEN 0 THEN e0 WHEN 1 THEN e1 ELSE {RAW_NT} - e0 - e1 END AS len
      FROM (SELECT *, EACH(0, 1, 2) AS k FROM seqs) AS x) AS e"""

CARRIERS["features"] = """
SELECT chrom, 'exon' AS feature, beg, beg + len - 1 AS fin, strand, gene_id,
       transcript AS transcript_id, 'np' || transcript AS protein_id,
       gene_id * 10 + k AS ordinal FROM exons
UNION ALL
SELECT chrom, 'CDS',
       CASE WHEN strand = '+' THEN beg + lo - off ELSE beg + off + len - 1 - hi END,
       CASE WHEN strand = '+' THEN beg + hi - off ELSE beg + off + len - 1 - lo END,
       strand, gene_id, transcript, 'np' || transcript, gene_id * 10 + 3 + k
FROM (SELECT *, greatest(off, l_utr5) AS lo, least(off + len, l_utr5 + l_cds) - 1 AS hi
      FROM exons) AS c WHERE lo <= hi"""

#: Every part is a gene, and a hundred more genes have no sequence.
_GENES = "((SELECT count(*) FROM {part}) + 100)"

CARRIERS["variants"] = f"""
SELECT variant_id, gene_id, gene_symbol, review_stars, chrom, pos, ordinal,
       CASE WHEN forward THEN base ELSE translate(base, 'ACGT', 'TGCA') END AS ref,
       CASE WHEN forward THEN made ELSE translate(made, 'ACGT', 'TGCA') END AS alt
FROM (SELECT SORTED(seqs) variant_id, o.gene_id AS gene_id, gene_symbol, review_stars, ordinal,
             'chr' || {text('1 + o.gene_id % 22')} AS chrom, o.gene_id % 2 = 0 AS forward,
             CASE WHEN ordinal % 23 = 0 THEN 1000 * (o.gene_id % 1000) + e0 + 25
                  WHEN o.gene_id % 2 = 0 THEN 1000 * (o.gene_id % 1000) + off + 1 + 50 *
                       (CASE WHEN off < e0 THEN 0 WHEN off < e0 + e1 THEN 1 ELSE 2 END)
                  ELSE 1000 * (o.gene_id % 1000) + {RAW_NT} - off + 50 *
                       (2 - (CASE WHEN off < e0 THEN 0 WHEN off < e0 + e1 THEN 1 ELSE 2 END))
                  END AS pos,
             CASE WHEN ordinal % 19 = 0 THEN 'N'
                  ELSE coalesce(substring(sequence, cast(off + 1 AS int), 1), 'A') END AS base,
             CASE WHEN (off - l_utr5) % 3 = 0 THEN 'T'
                  ELSE substring('AG', cast(1 + ordinal % 2 AS int), 1) END AS made
      FROM (SELECT 'v' || {text('o_orderkey')} AS variant_id, o_orderkey AS ordinal,
                   (o_orderkey * 13) % {_GENES} AS gene_id,
                   'G' || {text(f'(o_orderkey * 13) % {_GENES}')} AS gene_symbol,
                   cast(o_orderkey % 5 AS int) AS review_stars,
                   cast(100 + (o_orderkey * 37) % 230 AS int) AS off
            FROM {{orders}}) AS o LEFT JOIN seqs ON seqs.gene_id = o.gene_id) AS v"""

CARRIERS["arms"] = f"""
SELECT sample, CASE WHEN k % 2 = 0 THEN 'treated' ELSE 'control' END AS treatment,
       cast(floor(k / 2) + 1 AS int) AS replicate
FROM (SELECT DISTINCT 's' || {text('s_suppkey % 6')} AS sample, s_suppkey % 6 AS k
      FROM {{supplier}}) AS s"""

_COUNT_ROW = f"""
SELECT 't' || {text('l_partkey')} AS transcript, 's' || {text('l_suppkey % 6')} AS sample,
       cast(27 + l_linenumber AS int) AS length, l_partkey AS gene_id,
       CASE WHEN l_orderkey % 5 < 3 THEN 0 ELSE cast(l_orderkey % 3 AS int) END AS frame,
       (l_orderkey + l_linenumber) % 8 AS zone,
       cast(l_quantity * 5 AS bigint) AS n
FROM {{lineitem}}"""


def _zone(frame: int, low: int, high: int) -> str:
    return (f"cast(sum(CASE WHEN frame = {frame} AND zone BETWEEN {low} AND {high} "
            f"THEN n ELSE 0 END) AS bigint)")


CARRIERS["counts"] = f"""
SELECT transcript, sample, length, cds_frame0, cds_frame1, cds_frame2,
       cds_frame0 + cds_frame1 + cds_frame2 AS cds_total, termination,
       extension_frame0, extension_frame1, extension_frame2,
       CASE WHEN gene_id % 11 = 0 THEN NULL ELSE cast(30 + 3 * (gene_id % 40) AS int) END
         AS extension,
       cast(300 + 3 * (gene_id % 200) AS int) AS l_cds, cast(gene_id % 400 AS int) AS l_utr3
FROM (SELECT transcript, sample, length, gene_id,
             {", ".join(f"{_zone(k, 0, 5)} AS cds_frame{k}" for k in range(3))},
             cast(sum(CASE WHEN zone = 6 THEN n ELSE 0 END) AS bigint) AS termination,
             {", ".join(f"{_zone(k, 7, 7)} AS extension_frame{k}" for k in range(3))}
      FROM ({_COUNT_ROW}) AS r GROUP BY transcript, sample, length, gene_id) AS c"""

CARRIERS["frames"] = f"""
SELECT sample, length, frame, cast(sum(n) AS bigint) AS n
FROM ({_COUNT_ROW}) AS r WHERE zone <= 5 GROUP BY sample, length, frame"""

CARRIERS["genes"] = f"""
SELECT 't' || {text('p_partkey')} AS transcript,
       CASE WHEN p_partkey % 29 = 0 THEN 'VDR' ELSE 'G' || {text('p_partkey')} END AS gene
FROM {{part}}"""

CARRIERS["reads"] = f"""
SELECT sample, transcript, length, flag, t,
       cast(t + 31 + l_partkey % 30 - (12 + length % 2) AS int) AS end5
FROM (SELECT 's' || {text('l_suppkey % 6')} AS sample, 't' || {text('l_partkey')} AS transcript,
             cast(27 + l_linenumber AS int) AS length, l_partkey,
             CASE WHEN l_orderkey % 17 = 0 THEN 256 ELSE 0 END AS flag,
             3 * ((l_orderkey * 7 + l_linenumber * 11) % 120) - 30 +
             CASE WHEN l_orderkey % 5 < 3 THEN 0 ELSE l_orderkey % 3 END AS t
      FROM {{lineitem}}) AS r"""

CARRIERS["offsets"] = """
SELECT sample, length, cast(count(*) AS double) AS total_percentage,
       cast(12 + length % 2 AS int) AS corrected_offset_from_5,
       cast(length - 13 AS int) AS corrected_offset_from_3
FROM reads GROUP BY sample, length"""

CARRIERS["contexts"] = f"""
SELECT 'v' || {text('o_orderkey')} AS variant_id, o_orderkey AS ordinal,
       'G' || {text('o_custkey % 300')} AS gene_symbol, o_orderkey % 10 <> 0 AS scoreable,
       CASE WHEN o_orderkey % 20 = 0 THEN 'reference_mismatch'
            WHEN o_orderkey % 10 = 0 THEN 'outside_transcript' ELSE '' END AS reason,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL
            ELSE substring('uaauaguga', cast(1 + 3 * (o_orderkey % 3) AS int), 3) END AS stop_type,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL
            ELSE substring('ACDEFGHIKLMNPQRSTVWY', cast(1 + o_custkey % 20 AS int), 1) END
         AS original_aa,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {codon_rna("'u' || " + text('o_custkey'))}
         END AS up_123nt,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {codon_rna("'d' || " + text('o_orderkey'))}
         END AS down_123nt,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey % 7 = 0 END AS in_last_exon,
       CASE WHEN o_orderkey % 10 = 0 OR o_custkey % 13 = 0 THEN NULL
            ELSE cast((o_orderkey * 31) % 500 - 100 AS int) END AS nt_to_last_junction,
       cast((o_orderkey * 7) % 1200 AS int) AS nt_from_start,
       cast(50 + (o_orderkey * 13) % 500 AS int) AS ptc_exon_length,
       cast(o_orderkey % 5 AS int) AS review_stars,
       cast(1 + o_orderkey % 900 AS int) AS protein_position
FROM {{orders}}"""

CARRIERS["scores"] = f"""
SELECT variant_id, 'th' || {text('t')} AS therapy_id, ordinal * 3 + t AS ordinal,
       CASE WHEN miss THEN NULL ELSE mid / 10000.0 END AS readthrough_predicted,
       CASE WHEN miss THEN NULL ELSE mid * 0.7 / 10000.0 END AS readthrough_low,
       CASE WHEN miss THEN NULL ELSE mid * 1.3 / 10000.0 END AS readthrough_high,
       CASE WHEN miss THEN 'missing' ELSE 'present' END AS status,
       CASE WHEN miss THEN 'not_available' ELSE '' END AS reason
FROM (SELECT variant_id, ordinal, t, (ordinal + t) % 7 = 0 OR ordinal % 53 = 0 AS miss,
             cast(10 + (ordinal * (17 + t)) % 400 AS double) AS mid
      FROM (SELECT variant_id, ordinal, EACH(0, 1, 2) AS t FROM contexts WHERE scoreable) AS x)
  AS s"""

CARRIERS["conditions_raw"] = f"""
SELECT 'v' || {text('o_orderkey')} AS variant_id, o_orderkey AS ordinal,
       'G' || {text('o_custkey % 300')} AS gene_symbol,
       CASE WHEN o_orderkey % 31 = 0 THEN ''
            WHEN o_orderkey % 3 = 0 THEN 'disease_' || {text('o_custkey % 97')}
            ELSE 'disease_' || {text('o_custkey % 97')} || '|syndrome_' || {text('o_orderkey % 53')}
            END AS conditions,
       CASE WHEN o_orderkey % 9 = 0 THEN 'MedGen:C3661900'
            WHEN o_orderkey % 9 = 1 THEN 'Other:1'
            ELSE 'MedGen:C' || {text('o_custkey % 97')} ||
                 CASE WHEN o_custkey % 4 = 0 THEN '' ELSE ',OMIM:' || {text('o_custkey % 97')} ||
                      ',OMIM:PS' || {text('o_custkey % 11')} || ',OMIM:' || {text('o_custkey % 97')}
                 END END ||
       CASE WHEN o_orderkey % 4 = 0 THEN ''
            ELSE '|MONDO:MONDO:' || {text('o_orderkey % 53')} || ',MedGen:S' ||
                 {text('o_orderkey % 53')} || ',Orphanet:Orphanet:' || {text('o_orderkey % 53')} ||
                 ',MeSH:D' || {text('o_orderkey % 7')} END AS condition_xrefs
FROM {{orders}}"""

CARRIERS["conditions"] = f"""
SELECT 'v' || {text('o_orderkey')} AS variant_id, o_orderkey * 2 + j AS ordinal,
       'G' || {text('o_custkey % 300')} AS gene_symbol, j AS condition_ordinal,
       CASE WHEN j = 0 THEN 'disease_' || {text('o_custkey % 97')}
            ELSE 'syndrome_' || {text('o_orderkey % 53')} || '_' || {text('o_custkey % 2')} END
         AS condition_name,
       CASE WHEN j = 0 AND o_orderkey % 9 = 0 THEN 'C3661900'
            WHEN j = 0 AND o_orderkey % 9 = 1 THEN ''
            WHEN j = 0 THEN 'C' || {text('o_custkey % 97')}
            ELSE 'S' || {text('o_orderkey % 53')} END AS medgen,
       CASE WHEN j = 0 AND o_custkey % 4 <> 0 THEN {text('100 + o_custkey % 97')} ELSE '' END
         AS omim,
       CASE WHEN j = 1 AND o_orderkey % 53 > 20 AND o_orderkey % 2 = 0
            THEN 'Orphanet:' || {text('o_orderkey % 53')} ELSE '' END AS orphanet,
       CASE WHEN j = 0 AND o_orderkey % 9 = 0 THEN 'placeholder'
            WHEN j = 0 AND o_orderkey % 9 = 1 THEN 'unmapped'
            WHEN j = 0 AND o_custkey % 4 = 0 THEN 'medgen_only'
            WHEN j = 1 AND o_orderkey % 53 <= 20 THEN 'medgen_only' ELSE 'mapped' END
         AS mapping_status
FROM (SELECT *, EACH(0, 1) AS j FROM {{orders}}) AS x
WHERE j = 0 OR o_orderkey % 3 <> 0"""

CARRIERS["library"] = f"""
SELECT 'th' || {text('o_custkey % 3')} AS therapy_id, 'th' || {text('o_custkey % 3')} AS drug,
       o_orderkey AS row, 'g' || {text('o_custkey % 50')} AS gene,
       substring('uaauaguga', cast(1 + 3 * (o_orderkey % 3) AS int), 3) AS stop_type,
       {codon_rna("'x' || " + text('o_orderkey'))} AS up_123nt,
       {codon_rna("'y' || " + text('o_orderkey % 997'))} AS down_123nt,
       (200 + 400 * (o_orderkey % 3) + cast(floor(o_totalprice) AS bigint) % 1000
         + 20 * (o_custkey % 5)) / cast(20000 AS double) AS RT_binomial
FROM {{orders}}"""

CARRIERS["codon_table"] = f"""
SELECT * FROM (
  SELECT substring('ACGT', cast(1 + c % 4 AS int), 1) ||
         substring('ACGT', cast(1 + floor(c / 4) % 4 AS int), 1) ||
         substring('ACGT', cast(1 + floor(c / 16) AS int), 1) AS codon,
         CASE WHEN s = 0 THEN 'a' ELSE 'p' END AS site, avg(p_size) / cast(25 AS double) AS occupancy,
         stddev_samp(p_size) / cast(25 AS double) AS occupancy_sd, count(*) AS libraries
  FROM (SELECT p_partkey % 64 AS c, floor(p_partkey / 64) % 2 AS s, p_size FROM {{part}}) AS q
  GROUP BY c, s) AS t WHERE codon NOT IN ('TAA', 'TAG', 'TGA')"""

CARRIERS["gtf"] = f"""
SELECT chrom, feature, beg, fin, strand, gene_id, transcript_id FROM (
  SELECT 'chr' || {text('o_custkey % 3')} AS chrom, 'CDS' AS feature, pos0 AS beg,
         pos0 + w - 1 AS fin, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
         'g' || {text('o_custkey % 200')} AS gene_id, 't' || {text('o_orderkey')} AS transcript_id
  FROM (SELECT *, 1000 + (o_orderkey * 97) % 9000000 AS pos0, 100 + o_orderkey % 400 AS w
        FROM {{orders}}) AS a
  UNION ALL
  SELECT 'chr' || {text('o_custkey % 3')}, 'UTR',
         CASE WHEN o_orderkey % 4 < 2 THEN pos0 + w ELSE pos0 - 90 - o_orderkey % 60 END,
         CASE WHEN o_orderkey % 4 < 2 THEN pos0 + w + 80 + o_orderkey % 500 ELSE pos0 - 1 END,
         CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END,
         'g' || {text('o_custkey % 200')}, 't' || {text('o_orderkey')}
  FROM (SELECT *, 1000 + (o_orderkey * 97) % 9000000 AS pos0, 100 + o_orderkey % 400 AS w
        FROM {{orders}}) AS b) AS g"""

CARRIERS["gene_counts"] = f"""
SELECT 'ENSG' || {text('l_partkey')} || '.1' AS gene_id, 'lib' || {text('l_suppkey % 4')}
         AS library, 500 + l_partkey % 3000 AS length, cast(sum(l_quantity) AS bigint) AS count
FROM {{lineitem}} GROUP BY l_partkey, l_suppkey % 4"""

CARRIERS["symbols"] = f"""
SELECT 'ENSG' || {text('p_partkey')} || '.1' AS gene_id,
       CASE WHEN p_partkey % 40 = 0 THEN 'MT-ND' || {text('p_partkey % 7')}
            WHEN p_partkey % 40 = 1 THEN 'RNU6-' || {text('p_partkey')}
            WHEN p_partkey % 40 = 2 THEN 'RN7SL' || {text('p_partkey')}
            ELSE 'SYM' || {text('p_partkey')} END AS gene_symbol
FROM {{part}} WHERE p_partkey % 17 <> 3"""

ADAPTER = "NNCTGTAGGCACCATCAAT"

CARRIERS["fastq"] = f"""
SELECT sample, l_orderkey AS record,
       substring(substring(nts, 1, cast(22 + l_linenumber + l_orderkey % 5 AS int)) ||
         CASE WHEN l_orderkey % 10 = 0 THEN {nt("'z' || " + text('l_partkey'))}
              ELSE substring('ACGTGCAT', cast(1 + l_orderkey % 4 AS int), 2)
                   || '{ADAPTER[2:]}' END, 1, 36) AS sequence
FROM (SELECT 's' || {text('l_suppkey % 6')} AS sample, l_orderkey, l_linenumber, l_partkey,
             {nt("'q' || " + text('l_orderkey') + " || '|' || " + text('l_partkey'))} AS nts
      FROM {{lineitem}}) AS r"""

CARRIERS["runs"] = f"""
SELECT sample, 'srr' || {text('k')} AS run_accession, 'd1' AS dataset,
       CASE WHEN k < 6 THEN 'riboseq' ELSE 'rnaseq' END AS assay, '{ADAPTER}' AS adapter_3p,
       cast(k % 2 AS int) AS cut_5p, cast(5 + k % 3 AS int) AS adapter_overlap,
       'u1' || {text('k')} AS fastq_1_url, 'm1' || {text('k')} AS fastq_1_md5,
       CASE WHEN k % 2 = 0 THEN 'u2' || {text('k')} END AS fastq_2_url,
       CASE WHEN k % 2 = 0 THEN 'm2' || {text('k')} END AS fastq_2_md5
FROM (SELECT DISTINCT 's' || {text('s_suppkey % 10')} AS sample, s_suppkey % 10 AS k
      FROM {{supplier}}) AS s"""

CARRIERS["vcf_rows"] = f"""
SELECT o_orderkey AS ordinal, {text('1 + o_custkey % 22')} AS chrom, 1000 + o_orderkey AS pos,
       substring('ACGT', cast(1 + o_orderkey % 4 AS int), 1) AS ref,
       CASE WHEN o_orderkey % 37 = 0 THEN 'R' WHEN o_orderkey % 41 = 0 THEN 'A,C'
            ELSE substring('CGTA', cast(1 + o_orderkey % 4 AS int), 1) END AS alt,
       CASE WHEN o_orderkey % 7 = 0 THEN 'Deletion' ELSE 'single_nucleotide_variant' END AS clnvc,
       CASE WHEN o_orderkey % 3 = 0 THEN 'SO:0001583|missense_variant'
            ELSE 'SO:0001587|nonsense' END AS mc,
       CASE o_orderkey % 5 WHEN 0 THEN 'Benign' WHEN 1 THEN 'Pathogenic'
            WHEN 2 THEN 'Likely_pathogenic|other' WHEN 3 THEN 'Pathogenic/Likely_pathogenic'
            ELSE 'Uncertain_significance' END AS clnsig,
       'G' || {text('o_custkey % 300')} || ':' ||
         CASE WHEN o_orderkey % 43 = 0 THEN 'x' ELSE {text('o_custkey % 300')} END AS geneinfo,
       CASE o_orderkey % 6 WHEN 0 THEN 'practice_guideline' WHEN 1 THEN 'reviewed_by_expert_panel'
            WHEN 2 THEN 'criteria_provided,_multiple_submitters,_no_conflicts'
            WHEN 3 THEN 'criteria_provided,_single_submitter'
            WHEN 4 THEN 'criteria_provided,_conflicting_classifications'
            ELSE 'no_assertion_criteria_provided' END AS clnrevstat
FROM {{orders}}"""

CARRIERS["paired_scores"] = f"""
SELECT SORTED(o) c_custkey AS id, 't' || {text('c_custkey')} AS transcript, c_custkey % 5 <> 0 AS mane_select,
       CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE cast(floor(c_acctbal) AS double) / 100 END AS predicted,
       CASE WHEN n IS NULL THEN NULL ELSE cast(n % 23 AS double) / 100 END AS measured
FROM {{customer}} LEFT JOIN (SELECT o_custkey, cast(sum(floor(o_totalprice)) AS bigint) AS n
                             FROM {{orders}} GROUP BY o_custkey) AS o ON o_custkey = c_custkey"""


def needed(names: list[str]) -> list[str]:
    """The named carriers and those they read, in dependency order."""

    found: list[str] = []

    def add(name: str) -> None:
        for other in CARRIERS:
            if other != name and re.search(rf"\b{other}\b", CARRIERS[name]) and (
                    list(CARRIERS).index(other) < list(CARRIERS).index(name)):
                add(other)
        if name not in found:
            found.append(name)

    for name in names:
        add(name)
    return found


def _with(names: list[str]) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CARRIERS[n]})" for n in needed(names))


def _each(text: str, call: str, bracket: tuple[str, str]) -> str:
    """Spell `EACH(a, b)` (one row per listed value) for one of the two engines."""

    return re.sub(r"EACH\(([^)]*)\)", rf"{call}{bracket[0]}\1{bracket[1]}", text)


def _sorted(text: str, hint: str) -> str:
    """Spell `SORTED(name)`, a join that must not broadcast `name`, or leave it out.

    A derived sequence is many times wider than the planner takes a string to be, and a compressed
    file holds many more rows than its size tells, so what looks small would not fit the driver.
    """

    return re.sub(r"SORTED\((\w+)\) ", hint, text)


#: Keys of the tables whose rows are expanded to sequences, and the rows one task expands.
WIDENED = {"part": "p_partkey"}
ROWS_PER_TASK = 20_000
#: Rows of a table that one task groups by keys nearly as many as the rows.
DEALT_ROWS = 400_000


def oracle(body: str, *names: str) -> str:
    """Oracle SQL over carriers, with the given tables under their own names."""

    start = _with(list(names)) if names else ""
    if names and body.lstrip().upper().startswith("WITH "):
        start, body = start + ", ", body.lstrip()[5:]
    text = _sorted(_each(f"{start} {body}", "unnest", ("([", "])")), "")
    return re.sub(r"\{(\w+)\}", r"\1", text)


class Tables:
    """The given tables and the carriers over them, as DataFrames of one session and folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """The table as `sql` reads it. A few megabytes of keys are one split of a scan but gigabytes
        of bases, so rows that become sequences are dealt to tasks by their number, not their bytes.
        """

        table = self.table(name)
        if name not in WIDENED:
            return table
        tasks = -(-table.count() // ROWS_PER_TASK)
        return table.repartition(tasks, WIDENED[name]) if tasks > 1 else table

    def dealt(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """Rows taken from the table `name`, dealt by `keys` to as many tasks as it has rows for.

        What is grouped by these keys then meets in its task, whose size follows neither from the
        splits of a scan nor from how far small compressed blocks are put together.
        """

        tasks = -(-self.table(name).count() // DEALT_ROWS)
        return df.repartition(tasks, *keys) if tasks > 1 else df

    def sql(self, body: str, *names: str) -> DataFrame:
        head = _with(list(names)).replace("WITH RECURSIVE", "WITH", 1) if names else ""
        text = f"{head} {body}"
        text = _sorted(_each(text, "explode", ("(array(", "))")), r"/*+ MERGE(\1) */ ")
        used = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{t: self.spread(t) for t in used})

    def __call__(self, name: str) -> DataFrame:
        df = self.sql(f"SELECT * FROM {name}", name)
        for short, full in (("beg", "start"), ("fin", "end")):
            if short in df.columns:
                df = df.withColumnRenamed(short, full)
        return df
