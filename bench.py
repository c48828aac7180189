"""Time the headline queries on one folder and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stopscan.plans import load
from stopscan.session import build_session

HEADLINE = (
    "contrast_effects", "library_ratios", "qualifying_transcripts", "readthrough_counts",
    "metaprofile", "native_stop_atlas", "codon_occupancy", "overlapping_other_genes",
    "pathogenic_nonsense", "normalize_conditions", "stop_contexts", "editing_reachability",
    "decay_predictors", "landscape", "threshold_summary", "disease_coverage",
    "coverage_frontier_variants", "coverage_frontier_genes", "score_contexts",
    "cross_validation", "split_grouped_by_gene", "shuffle_within_gene", "context_analogues",
    "support_atlas", "familywise_pvalues", "detectability", "bootstrap_intervals", "tpm",
    "top_expressed", "adapter_survey", "web_rows", "variant_index", "quantile_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cores=cores, partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.read.parquet(f"{folder}/region.parquet").count()
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {timings[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
