"""Readers and writers of the text formats: TSV, VCF, GFF, GTF, FASTA, FASTQ, reports and logs.

Every reader is a DataFrame over files, split by Spark and given an explicit schema; parsing is
Column expressions. `read_numbered_lines` restores file order where a format needs it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopscan.functions.fixed import STRUCTURAL_BIOTYPES
from stopscan.session import cut_lineage, within

INFO_FIELDS = ("CLNVC", "MC", "CLNSIG", "GENEINFO", "CLNREVSTAT", "CLNHGVS", "ALLELEID",
               "CLNDN", "CLNDISDB")
#: Bytes of a file that one task holds while it takes a digest.
DIGEST_BYTES = 64 << 20
#: Splits of files whose line counts are broadcast.
SPLIT_ROWS = 100_000


def read_tsv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """A headed tab-separated table under a declared schema; a glob reads many files as one."""

    return (spark.read.option("sep", "\t").option("header", True).option("mode", "FAILFAST")
            .option("quote", "").schema(schema).csv(path))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def file_name() -> Column:
    return F.substring_index(F.col("_metadata.file_path"), "/", -1)


def folder_value(key: str) -> Column:
    """The value a `key=value` folder of the file's path names."""

    return F.regexp_extract(F.col("_metadata.file_path"), f"{key}=([^/]+)/", 1)


def gather(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    """Every library's table of one kind in a folder, stacked by a single read."""

    return read_tsv(spark, f"{folder.rstrip('/')}/*.{kind}.tsv", schema)


def read_numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines with their file and 0-based number in it, also where a file is split.

    Lines are numbered inside a split by a running id; the lines of earlier splits of the file are
    added from a table with one row per split.
    """

    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"), "value")
    splits = lines.groupBy("file", "block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    splits = cut_lineage(splits.withColumn(
        "_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0))))
    # Joined by shuffle, a whole split would meet in one task; the few rows of splits travel instead.
    known = F.broadcast(splits) if within(splits, SPLIT_ROWS) else splits
    return lines.join(known, ["file", "block"]).select(
        "file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line"), "value")


def _fields(count: int = 9) -> list[Column]:
    """The tab-separated fields of a line; null where it has fewer, for a filter on a field may run
    before the one that drops header lines."""

    part = F.split("value", "\t")
    return [F.get(part, F.lit(n)) for n in range(count)]


def parse_vcf(lines: DataFrame) -> DataFrame:
    """VCF lines to their fixed columns and the archive's INFO fields; of a repeated key, the first."""

    kept = lines.where(~F.startswith("value", F.lit("#")) & (F.col("value") != ""))
    part = _fields()
    entries = F.split(part[7], ";")

    def field(name: str) -> Column:
        found = F.filter(entries, lambda e: F.startswith(e, F.lit(f"{name}=")))
        return F.substring(F.get(found, F.lit(0)), len(name) + 2, 1 << 30)

    return kept.select(
        part[0].alias("chrom"), part[1].cast("bigint").alias("pos"), part[3].alias("ref"),
        part[4].alias("alt"), *[field(f).alias(f) for f in INFO_FIELDS],
        *[c for c in lines.columns if c != "value"])


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    return parse_vcf(spark.read.text(path))


def parse_features(lines: DataFrame) -> DataFrame:
    """Nine-column annotation lines, GFF or GTF alike; comments dropped before any split."""

    kept = lines.where(~F.startswith("value", F.lit("#")) & (F.col("value") != ""))
    part = _fields()
    return kept.select(
        part[0].alias("chrom"), part[1].alias("source"), part[2].alias("feature"),
        part[3].cast("bigint").alias("start"), part[4].cast("bigint").alias("end"),
        part[5].alias("score"), part[6].alias("strand"), part[7].alias("phase"),
        part[8].alias("attrs"), *[c for c in lines.columns if c != "value"])


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return parse_features(spark.read.text(path))


def gtf_attribute(key: str) -> Column:
    return F.nullif(F.regexp_extract("attrs", f'{key} "([^"]+)"', 1), F.lit(""))


def gtf_features(features: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """GTF rows of the wanted feature types with gene and transcript ids and the gene name."""

    return features.where(F.col("feature").isin(*wanted)).select(
        "chrom", "feature", "start", "end", "strand", "attrs",
        gtf_attribute("gene_id").alias("gene_id"),
        gtf_attribute("transcript_id").alias("transcript_id"),
        gtf_attribute("gene_name").alias("gene_name"))


def gene_symbols(features: DataFrame) -> DataFrame:
    named = gtf_features(features, ("gene",)).where("gene_id is not null and gene_name is not null")
    return named.groupBy("gene_id").agg(F.max("gene_name").alias("gene_symbol"))


def transcript_genes(features: DataFrame) -> DataFrame:
    named = gtf_features(features, ("transcript",)).where(
        "transcript_id is not null and gene_name is not null")
    return named.groupBy(F.col("transcript_id").alias("transcript")).agg(
        F.max("gene_name").alias("gene"))


def select_transcripts(features: DataFrame) -> DataFrame:
    """Transcripts tagged as the one selected per gene; `tag` repeats, so its text is matched."""

    return gtf_features(features, ("transcript",)).where(
        F.contains("attrs", F.lit('tag "MANE_Select"')) & F.col("transcript_id").isNotNull()
    ).select(F.col("transcript_id").alias("transcript")).distinct()


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """`(header, sequence)` per record, upper-cased; a record opens where a line does."""

    records = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    # Only the first record of a file still has its mark.
    return parse_fasta(records.select(F.regexp_replace("value", "^>", "").alias("value")))


def parse_fasta(records: DataFrame) -> DataFrame:
    header = F.trim(F.substring_index("value", "\n", 1))
    body = F.substring("value", F.length(F.substring_index("value", "\n", 1)) + 1,
                       F.length("value"))
    return records.select(header.alias("header"),
                          F.upper(F.regexp_replace(body, r"\s", "")).alias("sequence"))


def first_token() -> Column:
    """The accession as the first word of a header."""

    return F.split_part("header", F.lit(" "), F.lit(1))


def first_field() -> Column:
    """The accession as the first `|` field of a header."""

    return F.split_part(first_token(), F.lit("|"), F.lit(1))


def sequences(fasta: DataFrame, key: Column | None = None) -> DataFrame:
    """`(accession, sequence)` under a header key."""

    return fasta.select((first_token() if key is None else key).alias("accession"), "sequence")


def contaminants(fasta: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Structural RNA records (8th `|` field) with any extra records appended, one line each."""

    biotype = F.get(F.split("header", r"\|"), F.lit(7))
    kept = fasta.where(biotype.isin(*STRUCTURAL_BIOTYPES))
    if extra is not None:
        kept = kept.unionByName(extra)
    return kept.select(F.concat(F.lit(">"), "header", F.lit("\n"), "sequence").alias("value"))


def write_contaminants(fasta: DataFrame, path: str, extra: DataFrame | None = None) -> int:
    """Write the records and return how many; a FASTA with no structural RNA is refused."""

    if contaminants(fasta).limit(1).count() == 0:
        raise ValueError("no structural RNA found; is this a pipe-delimited transcript FASTA?")
    contaminants(fasta, extra).write.text(path)
    # A record opens where a line does: a header may hold the mark, too.
    return fasta.sparkSession.read.text(path).where(F.startswith("value", F.lit(">"))).count()


def read_fastq(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """`(file, record, sequence)`: the second line of each four, records numbered from 0."""

    return read_numbered_lines(spark, path).where("line % 4 = 1").select(
        "file", F.floor(F.col("line") / 4).alias("record"), F.col("value").alias("sequence"))


TRIM_REPORT = ("read_counts struct<input:bigint,output:bigint,read1_with_adapter:bigint>, "
               "basepair_counts struct<input:bigint,output:bigint>")


def read_trim_reports(spark: SparkSession, path: str | Sequence[str],
                      sample: Column | None = None) -> DataFrame:
    """Trimming reports, one JSON document per library, the library named by the file."""

    raw = spark.read.schema(TRIM_REPORT).option("multiLine", True).json(path)
    return raw.select(
        (F.regexp_replace(file_name(), r"(\.cutadapt)?\.json$", "") if sample is None else sample)
        .alias("sample"),
        F.col("read_counts.input").alias("reads_raw"),
        F.col("read_counts.output").alias("reads_cleaned"),
        F.col("read_counts.read1_with_adapter").alias("reads_with_adapter"),
        F.col("basepair_counts.input").alias("basepairs_raw"),
        F.col("basepair_counts.output").alias("basepairs_cleaned"))


def read_aligner_logs(spark: SparkSession, path: str | Sequence[str],
                      sample: Column | None = None) -> DataFrame:
    """`(sample, value)` lines of aligner logs, the library named by the file's first part."""

    return spark.read.text(path).select(
        (F.split_part(file_name(), F.lit("."), F.lit(1)) if sample is None else sample)
        .alias("sample"), "value")


def read_gene_counts(spark: SparkSession, path: str) -> DataFrame:
    """A gene count table in long form `(gene_id, length, library, count)`.

    Library columns are named by alignment path; the schema comes from the header line.
    """

    wide = (spark.read.option("sep", "\t").option("header", True).option("comment", "#")
            .csv(path))
    libraries = {c: c.rsplit("/", 1)[-1].replace(".sorted.bam", "")
                 for c in wide.columns if c.endswith(".bam")}
    named = wide.select(
        F.col("Geneid").alias("gene_id"), F.col("Length").cast("bigint").alias("length"),
        *[F.col(f"`{c}`").cast("bigint").alias(n) for c, n in libraries.items()])
    return named.unpivot(["gene_id", "length"], list(libraries.values()), "library", "count")


def file_manifest(spark: SparkSession, paths: Sequence[str],
                  chunk: int = DIGEST_BYTES) -> DataFrame:
    """`(path, bytes, sha256)` of every file under `paths` that is not empty, of any size.

    Spark's listing leaves out empty files, so an expected file of no bytes counts as missing.
    A file of up to `chunk` bytes is one value that Spark reads and digests. A longer one is never
    held: a task reads it `chunk` bytes at a time, for which its file system must be one that Arrow
    opens by its address (local folders, HDFS, S3 and the like).
    """

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    short = files.where(F.col("length") <= chunk).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for path in batch.column(0).to_pylist():
                if path.startswith("file:"):
                    system, at = pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
                else:
                    system, at = pa.fs.FileSystem.from_uri(path)
                held = hashlib.sha256()
                with system.open_input_stream(at, compression=None) as stream:
                    while piece := stream.read(chunk):
                        held.update(piece)
                told.append(held.hexdigest())
            yield batch.append_column("sha256", pa.array(told, pa.string()))

    # Files differ in size, so each is dealt by itself; only names and lengths travel.
    long = files.where(F.col("length") > chunk).select("path", F.col("length").alias("bytes"))
    return short.unionByName(long.repartition("path").mapInArrow(
        digests, "path string, bytes bigint, sha256 string"))


def missing_files(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected file names the manifest does not hold."""

    held = manifest.select(F.substring_index("path", "/", -1).alias("name"))
    return expected.select("name").join(held, "name", "left_anti")


def run_files(runs: DataFrame) -> DataFrame:
    """Up to two published files per run, `(sample, read, url, md5)`, absent ones dropped."""

    pairs = F.array(*[
        F.struct(F.lit(r).alias("read"), F.col(f"{r}_url").alias("url"),
                 F.col(f"{r}_md5").alias("md5")) for r in ("fastq_1", "fastq_2")])
    return runs.select("sample", F.inline(F.filter(pairs, lambda f: f["url"].isNotNull())))
