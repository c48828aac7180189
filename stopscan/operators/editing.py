"""Which premature stops a base editor can reach, as geometry on a declared editor panel.

Every search is local to a variant's row: candidate edits, placements and bystanders are arrays
built by higher-order functions, so no row leaves its partition until the summary is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.functions.fixed import (
    EDIT_MARGIN_NT,
    PRIMARY_PANEL,
    PROTOSPACER_NT,
    STOP_CODONS,
)
from stopscan.functions.nucleotides import (
    pam_pattern,
    residue,
    reverse_complement,
)
from stopscan.functions.scalars import let, met
from stopscan.operators.placement import placed

GUIDE_NT = PROTOSPACER_NT + 3
_NO_INTS = "array<int>"


def editor_table(panel: Sequence[tuple]) -> Column:
    """The panel, both strands and three stop positions, as one array literal in search order."""

    rows = []
    pairs = {"A": "T", "C": "G", "G": "C", "T": "A"}
    for name, before, after, low, high, pam, arm in panel:
        for strand in ("sense", "antisense"):
            sense_from, sense_to = (before, after) if strand == "sense" else (
                pairs[before], pairs[after])
            for position in range(3):
                rows.append(F.struct(
                    F.lit(name).alias("editor"), F.lit(arm).alias("arm"),
                    F.lit(strand).alias("strand"), F.lit(low).alias("lo"), F.lit(high).alias("hi"),
                    F.lit(pam_pattern(pam)).alias("pam"), F.lit(position).alias("position"),
                    F.lit(sense_from).alias("sense_from"), F.lit(sense_to).alias("sense_to")))
    return F.array(*rows)


def _span(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast(_NO_INTS))


def _edited_stop(g: Column, c: Column) -> Column:
    stop = g["stop_codon"]
    return F.concat(F.substring(stop, F.lit(1), c["position"]), c["sense_to"],
                    F.substring(stop, c["position"] + 2, F.lit(3)))


def _removes_stop(g: Column, c: Column) -> Column:
    original = F.substring(g["stop_codon"], c["position"] + 1, F.lit(1))
    return (original == c["sense_from"]) & ~_edited_stop(g, c).isin(*STOP_CODONS)


def _on_strand(g: Column, c: Column) -> Column:
    """The candidate as its own strand reads it: sequence, target and junctions."""

    sense, target = c["strand"] == "sense", g["stop_local"] + c["position"]
    return F.struct(
        F.when(sense, g["window"]).otherwise(g["antisense"]).alias("read"),
        F.when(sense, target).otherwise(g["length"] - 1 - target).alias("target"),
        F.when(sense, g["junctions"]).otherwise(
            F.transform(g["junctions"], lambda j: g["length"] - j)).alias("junctions"))


def _starts(g: Column, c: Column, r: Column, lo: Column, hi: Column) -> Column:
    """Protospacer starts on the candidate's own strand whose window `lo..hi` holds the target."""

    low = F.greatest(r["target"] - hi + 1, F.lit(0))
    high = F.least(r["target"] - lo + 1, g["length"] - GUIDE_NT)

    def usable(s: Column) -> Column:
        crossed = F.exists(r["junctions"], lambda j: (s < j) & (j < s + GUIDE_NT))
        return F.rlike(F.substring(r["read"], s + PROTOSPACER_NT + 1, F.lit(3)),
                       c["pam"]) & ~crossed

    return F.filter(_span(low, high), usable)


def _bystanders(g: Column, c: Column, low: Column, high: Column) -> Column:
    """In-window bases other than the target the editor also changes, with what each does."""

    target, window, coding = g["stop_local"] + c["position"], g["window"], g["coding"]

    def consequence(i: Column) -> Column:
        start = coding + F.floor((i - coding) / 3).cast("int") * 3
        return let(start, lambda s: let(
            F.when((i >= coding) & (i <= g["coding_end"]) & (s >= 0)
                   & (s + 3 <= g["length"]), F.substring(window, s + 1, F.lit(3))),
            lambda old: F.struct(
                i.alias("offset"), old.alias("old"),
                F.concat(F.substring(old, F.lit(1), i - s), c["sense_to"],
                         F.substring(old, i - s + 2, F.lit(3))).alias("new"))))

    def read(b: Column) -> Column:
        before, after = residue(b["old"]), residue(b["new"])
        return F.struct(
            b["offset"].alias("offset"), F.coalesce(before, F.lit("")).alias("aa_from"),
            F.coalesce(after, F.lit("")).alias("aa_to"),
            F.coalesce(before == after, F.lit(True)).alias("silent"),
            b["old"].isNotNull().alias("coding"))

    touched = F.filter(_span(low, high), lambda i: (i != target) & (
        F.substring(window, i + 1, F.lit(1)) == c["sense_from"]))
    return F.transform(F.transform(touched, consequence), read)


def _guide(g: Column, c: Column, r: Column, s: Column) -> Column:
    sense = c["strand"] == "sense"
    low = F.when(sense, s + c["lo"] - 1).otherwise(g["length"] - s - c["hi"])
    high = F.when(sense, s + c["hi"] - 1).otherwise(g["length"] - s - c["lo"])
    codon = _edited_stop(g, c)
    return F.struct(
        c["editor"].alias("editor"), c["arm"].alias("arm"), c["strand"].alias("strand"),
        F.substring(r["read"], s + 1, F.lit(PROTOSPACER_NT)).alias("protospacer"),
        F.substring(r["read"], s + PROTOSPACER_NT + 1, F.lit(3)).alias("pam"),
        (r["target"] - s + 1).alias("window_position"),
        F.when(codon == g["codon"], "exact_wildtype").otherwise("alternative_sense")
        .alias("restores"),
        codon.alias("new_codon"), _bystanders(g, c, low, high).alias("bystanders"))


def _missense(guide: Column) -> Column:
    return F.size(F.filter(guide["bystanders"], lambda b: ~b["silent"]))


def stop_guides(variants: DataFrame, models: DataFrame,
                panel: Sequence[tuple] = PRIMARY_PANEL) -> DataFrame:
    """Every variant with its stop-removing guides and, where it has none, the reason."""

    found = placed(variants, models)
    start, length = F.col("codon_start"), F.length("sequence")
    low = F.greatest(start - EDIT_MARGIN_NT, F.lit(0))
    high = F.least(start + 3 + EDIT_MARGIN_NT, length)
    mutant = F.concat(F.substring("sequence", F.lit(1), start), F.col("mutated"),
                      F.substring("sequence", start + 4, length))
    window = F.substring(mutant, low + 1, high - low)
    site = F.struct(
        F.col("mutated").alias("stop_codon"), F.col("codon").alias("codon"),
        window.alias("window"), reverse_complement(window).alias("antisense"),
        (high - low).alias("length"), (start - low).alias("stop_local"),
        (F.col("coding_offset") - low).alias("coding"),
        (F.col("coding_end_offset") - low).alias("coding_end"),
        F.transform(F.filter("junctions", lambda j: (j > low) & (j < high)),
                    lambda j: j - low).alias("junctions"))

    def search(g: Column) -> Column:
        candidates = F.transform(
            F.filter(editor_table(panel), lambda c: _removes_stop(g, c)),
            lambda c: F.struct(c.alias("edit"), _on_strand(g, c).alias("strand")))
        return let(candidates, lambda found: F.struct(
            F.flatten(F.transform(found, lambda x: F.transform(
                _starts(g, x["edit"], x["strand"], x["edit"]["lo"], x["edit"]["hi"]),
                lambda s: _guide(g, x["edit"], x["strand"], s)))).alias("guides"),
            (F.size(found) > 0).alias("editable"),
            F.exists(found, lambda x: F.size(_starts(
                g, x["edit"], x["strand"], F.lit(1), F.lit(PROTOSPACER_NT))) > 0)
            .alias("covered")))

    guided = found.withColumn("scoreable", F.col("makes_stop")).withColumn(
        "_found", F.when(F.col("scoreable"), let(site, search)))
    reason = (F.when(~F.col("scoreable"), "unscoreable_context")
              .when(F.size("_found.guides") > 0, "")
              .when(~F.col("_found.editable"), "no_stop_removing_edit")
              .when(F.col("_found.covered"), "target_outside_window")
              .otherwise("no_pam"))
    carried = [c for c in ("variant_id", "gene_id", "gene_symbol") if c in variants.columns]
    position = F.floor((start - F.col("coding_offset")) / 3) + 1
    return guided.select(
        *carried, "scoreable", reason.alias("reason"),
        F.when(F.col("scoreable"), position.cast("int")).alias("protein_position"),
        F.when(F.col("scoreable"), F.col("mutated")).alias("stop_type"),
        F.when(F.col("scoreable"), F.col("codon")).alias("reference_codon"),
        F.col("_found.guides").alias("guides"))


def _reach_class(guides: Column) -> Column:
    return (F.when(~F.col("scoreable"), "")
            .when(F.exists(guides, lambda g: g["restores"] == "exact_wildtype"),
                  "base_editable_exact")
            .when(F.size(guides) > 0, "base_editable_alternative")
            .otherwise("not_base_editable_under_panel"))


def _listed(guided: DataFrame) -> Column:
    return F.coalesce("guides", F.array().cast(guided.schema["guides"].dataType))


def reachability(guided: DataFrame) -> DataFrame:
    """One summary row per variant: class, counts and a representative guide.

    The representative restores exactly if any does, then changes no other residue, then changes
    fewest, then was found first.
    """

    guides = _listed(guided)
    exact = F.filter(guides, lambda g: g["restores"] == "exact_wildtype")
    best = F.array_min(F.transform(guides, lambda g, i: F.struct(
        (g["restores"] != "exact_wildtype").alias("inexact"), (_missense(g) > 0).alias("missense"),
        _missense(g).alias("changes"), i.alias("found"), g.alias("guide"))))["guide"]
    any_guide = F.size(guides) > 0
    primary = F.exists(guides, lambda g: g["arm"] == "primary")
    carried = [c for c in guided.columns if c not in ("guides", "reference_codon")]
    ok = F.col("scoreable")
    chosen = {c: F.when(ok, F.coalesce(F.col("_best")[c], F.lit("")))
              for c in ("editor", "arm", "strand", "restores")}
    return guided.withColumn("_best", best).select(
        *carried, any_guide.alias("reachable"), primary.alias("primary_reachable"),
        (any_guide & ~primary).alias("requires_relaxed_pam"),
        _reach_class(guides).alias("reach_class"),
        F.when(ok, F.size(guides)).alias("n_guides"), F.when(ok, F.size(exact)).alias("n_exact"),
        F.when(ok, F.exists(guides, lambda g: _missense(g) == 0)).alias("bystander_free"),
        *[c.alias(n) for n, c in chosen.items()],
        F.col("_best.window_position").alias("window_position"))


def escape_summary(reach: DataFrame) -> DataFrame:
    """The denominators: all, scoreable, exact, alternative, not editable, bystander-free; one row."""

    ok, kind, free = F.col("scoreable"), F.col("reach_class"), met(F.col("bystander_free"))
    exact, alternative = kind == "base_editable_exact", kind == "base_editable_alternative"
    return reach.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("scoreable"),
        F.count_if(~ok).alias("unscoreable"),
        F.count_if(ok & exact).alias("exact"), F.count_if(ok & alternative).alias("alternative"),
        F.count_if(ok & (kind == "not_base_editable_under_panel")).alias("not_editable"),
        F.count_if(ok & (exact | alternative)).alias("reachable"),
        F.count_if(ok & free).alias("reachable_bystander_free"),
        F.count_if(ok & exact & free).alias("exact_bystander_free"))


def panel_comparison(guided: DataFrame) -> DataFrame:
    """Class counts under two panels, what only the relaxed one reaches, and what stays out.

    `guided` was searched with both panels: guides of the arm `primary` are those of the primary one.
    Variants are counted by their two classes and reason, and only these few counts are spread.
    """

    def tag(panel: str, measure: Column) -> Column:
        return F.struct(F.lit(panel).alias("panel"), measure.alias("measure"))

    guides = _listed(guided)
    primary = F.filter(guides, lambda g: g["arm"] == "primary")
    classes = guided.select(
        "scoreable", "reason", _reach_class(primary).alias("first"),
        _reach_class(guides).alias("second"),
        ((F.size(guides) > 0) & (F.size(primary) == 0)).alias("incremental"))
    counted = classes.groupBy(*classes.columns).agg(F.count(F.lit(1)).alias("n"))
    ok, second = F.col("scoreable"), F.col("second")
    rows = F.array_compact(F.array(
        F.when(ok, tag("primary", F.col("first"))), F.when(ok, tag("relaxed", second)),
        F.when(ok & F.col("incremental"), tag("relaxed", F.lit("incremental"))),
        F.when(second == "not_base_editable_under_panel", tag("residual", F.col("reason")))))
    # Outer, since a filter on what is spread would be pushed below the search and repeat it.
    return counted.select("n", F.inline_outer(rows)).where("panel is not null").groupBy(
        "panel", "measure").agg(F.sum("n").alias("variants"))


def escape_map(reach: DataFrame, scores: DataFrame) -> DataFrame:
    """Editability with the best predicted therapy and its interval beside it.

    All score rows take part and a missing prediction sorts last; ties go to the first therapy.
    """

    columns = ("therapy_id", "readthrough_predicted", "readthrough_low", "readthrough_high")
    best = scores.groupBy("variant_id").agg(F.min_by(
        F.struct(*columns),
        F.struct(F.col("readthrough_predicted").isNull(),
                 -F.coalesce("readthrough_predicted", F.lit(0.0)), "therapy_id")).alias("b"))
    renamed = best.select("variant_id", *[F.col(f"b.{a}").alias(b) for a, b in zip(columns, (
        "best_therapy", "best_readthrough", "best_readthrough_low", "best_readthrough_high"))])
    return reach.join(renamed, "variant_id", "left")
