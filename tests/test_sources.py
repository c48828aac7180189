"""Text formats read back from files, also when a file is split between tasks."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from stopscan.functions.nucleotides import adapter_start, residue
from stopscan.operators import reads as rd
from stopscan.sources import text as src

LINKER = "CTGTAGGCACCATCAAT"


def test_lines_keep_their_number_when_a_file_is_split(spark, tmp_path):
    path = tmp_path / "x.fastq"
    path.write_text("".join(f"@r{i}\n{'ACGT'[i % 4] * 20}\n+\n{'I' * 20}\n" for i in range(400)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = src.read_fastq(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 4
        found = sorted((r.record, r.sequence) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == [(i, "ACGT"[i % 4] * 20) for i in range(400)]


def test_fasta_keys_and_contaminants(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">T1.1|G|a|b|c|d|e|rRNA| extra\nacg\nt\n>T2|G|a|b|c|d|e|lncRNA|\nGG\n")
    fasta = src.read_fasta(spark, str(path))
    assert {(r.accession, r.sequence) for r in src.sequences(fasta, src.first_field()).collect()
            } == {("T1.1", "ACGT"), ("T2", "GG")}
    assert src.write_contaminants(fasta, str(tmp_path / "out"), fasta.where(
        "header like 'T2%'").withColumn("header", F.lit("x"))) == 2
    marked = fasta.where("header like 'T1%'").withColumn("header", F.concat("header", F.lit(" a>b>c")))
    assert src.write_contaminants(marked, str(tmp_path / "marked")) == 1
    with pytest.raises(ValueError, match="structural"):
        src.write_contaminants(fasta.where("header like 'T2%'"), str(tmp_path / "none"))


def survey(spark, reads, adapter=LINKER, cut=0, overlap=1):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(reads)],
                               "sample string, record bigint, sequence string")
    runs = spark.createDataFrame([("a", "riboseq", adapter, cut, overlap)],
                                 "sample string, assay string, adapter_3p string, cut_5p int, "
                                 "adapter_overlap int")
    return rd.adapter_survey(rd.located_adapters(df, runs)).first()


def test_adapter_survey_measures_what_alignment_will_see(spark):
    bare = survey(spark, ["A" * 30 + LINKER] * 20)
    assert (bare.adapter_rate, bare.footprint_median, bare.footprint_p10) == (1.0, 30, 30)
    padded = survey(spark, ["TTTT" + "A" * 30 + "ACGTAC" + LINKER] * 20, "N" * 6 + LINKER, 4, 8)
    assert (padded.adapter_rate, padded.footprint_median) == (1.0, 30)
    partial = survey(spark, ["A" * 30 + LINKER[:5]] * 20, overlap=5)
    assert (partial.adapter_rate, partial.footprint_median) == (1.0, 30)
    assert survey(spark, ["A" * 30 + LINKER[:5]] * 20, overlap=6).adapter_rate == 0.0
    few = survey(spark, ["A" * n + LINKER for n in (28, 30)])
    assert (few.footprint_p10, few.footprint_median) == (None, 29)
    spread = survey(spark, ["A" * n + LINKER for n in range(20, 41)])
    # Exclusive deciles of 20..40: positions 2.2 and 19.8.
    assert (spread.footprint_p10, spread.footprint_median, spread.footprint_p90) == (21, 30, 39)


def test_a_full_copy_wins_over_a_later_partial_one(spark):
    df = spark.createDataFrame([("AACTGCCCT",), ("AAAACT",), ("AAAA",)], "r string")
    found = [r[0] for r in df.select(adapter_start(F.col("r"), F.lit("CTG"), F.lit(1))).collect()]
    assert found == [2, 4, None]


def test_reports_and_logs(spark, tmp_path):
    for name, hit in (("b.cutadapt.json", 990), ("a.json", 32)):
        (tmp_path / name).write_text(json.dumps({
            "read_counts": {"input": 1000, "output": 900, "read1_with_adapter": hit},
            "basepair_counts": {"input": 5, "output": 4}}, indent=1))
    summary = rd.trim_summary(src.read_trim_reports(spark, str(tmp_path / "*.json"))).collect()
    assert [(r["sample"], r.adapter_rate, r.reads_retained) for r in summary] == [
        ("a", 0.032, 0.9), ("b", 0.99, 0.9)]
    (tmp_path / "lib.Log.final.out").write_text(
        "  Number of input reads |\t25344634\n Uniquely mapped reads % |\t73.00%\n"
        "% of reads mapped to multiple loci |\t14.00%\n"
        "% of reads mapped to too many loci |\t3.00%\nAverage mapped length |\t30.55\nUNIQUE:\n")
    row = rd.alignment_summary(src.read_aligner_logs(spark, str(tmp_path / "*.out"))).first()
    assert (row["sample"], row.reads_input, row.mapped_rate, row.mapped_length_mean) == (
        "lib", 25344634, 90.0, 30.55)


def test_gene_counts_are_named_by_library(spark, tmp_path):
    (tmp_path / "c.tsv").write_text(
        "# made by a counter\nGeneid\tChr\tLength\tx/y/one.sorted.bam\tx/two.sorted.bam\n"
        "g1\t1\t1000\t5\t7\n")
    found = src.read_gene_counts(spark, str(tmp_path / "c.tsv")).orderBy("library").collect()
    assert [(r.gene_id, r.length, r.library, r["count"]) for r in found] == [
        ("g1", 1000, "one", 5), ("g1", 1000, "two", 7)]


def test_manifest_lists_size_digest_and_missing(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    listed = src.file_manifest(spark, [str(tmp_path)])
    row = listed.first()
    assert row.bytes == 5 and row.sha256.startswith("2cf24dba5fb0a30e26e83b2ac5b9e29e")
    wanted = spark.createDataFrame([("a.txt",), ("b.txt",)], "name string")
    assert [r.name for r in src.missing_files(listed, wanted).collect()] == ["b.txt"]


def test_residues_of_odd_codons(spark):
    df = spark.createDataFrame([("TGG",), ("TAA",), ("AC",), ("ACN",), (None,)], "c string")
    assert [r[0] for r in df.select(residue(F.col("c"))).collect()] == ["W", "*", None, "X", None]


def test_a_mark_inside_a_fasta_header_opens_no_record(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">t1 5'->3' strand\nACGT\nac\n>t2 a>b\nTT\n")
    found = src.read_fasta(spark, str(tmp_path / "x.fa")).collect()
    assert sorted(map(tuple, found)) == [("t1 5'->3' strand", "ACGTAC"), ("t2 a>b", "TT")]


def test_a_repeated_info_key_takes_its_first_value(spark):
    line = "1\t5\t.\tA\tT\t.\t.\tCLNSIG=Benign;CLNSIG=Pathogenic;CLNVC=x=y"
    row = src.parse_vcf(spark.createDataFrame([(line,)], "value string")).first()
    assert row.CLNSIG == "Benign" and row.CLNVC == "x=y"


def test_digests_of_files_above_and_below_a_chunk(spark, tmp_path):
    held = {"small": b"abc", "empty": b"", "long name.fastq.gz": bytes(range(256)) * 300,
            "exact": b"x" * 1000}
    for name, body in held.items():
        (tmp_path / name).write_bytes(body)
    found = src.file_manifest(spark, [str(tmp_path)], chunk=1000)
    rows = {r.path.rsplit("/", 1)[-1].replace("%20", " "): (r.bytes, r.sha256)
            for r in found.collect()}
    # Spark's listing leaves out files of no bytes.
    assert rows == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in held.items() if b}
    assert src.file_manifest(spark, [str(tmp_path)]).select("sha256").exceptAll(
        found.select("sha256")).isEmpty()
    gone = src.missing_files(found, spark.createDataFrame([("small",), ("absent",)], "name string"))
    assert [r.name for r in gone.collect()] == ["absent"]
