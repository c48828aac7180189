"""Constants, closed sets and lookup tables the results depend on."""

from __future__ import annotations

# --- Fixed values: standard genetic code, residues in T, C, A, G codon order -------------------
CODON_BASES = "TCAG"
CODON_RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOP_CODONS = ("TAA", "TAG", "TGA")
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def genetic_code() -> dict[str, str]:
    """Codon (DNA spelling) to residue, stops as `*`."""

    codons = (a + b + c for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES)
    return dict(zip(codons, CODON_RESIDUES))


SENSE_CODONS = tuple(sorted(c for c, aa in genetic_code().items() if aa != "*"))

# --- Fixed values: BLOSUM62, the published lower triangle --------------------------------------
BLOSUM62 = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""


def substitution_scores() -> dict[tuple[str, str], int]:
    """Every ordered residue pair's score, mirrored from the triangle above."""

    scores: dict[tuple[str, str], int] = {}
    seen: list[str] = []
    for line in BLOSUM62.split("\n"):
        if not line:
            continue
        residue, *values = line.split()
        seen.append(residue)
        for other, value in zip(seen, values):
            scores[residue, other] = scores[other, residue] = int(value)
    return scores


def near_cognate(stop: str) -> tuple[str, ...]:
    """Residues whose codons are one base away from a stop, sorted and distinct."""

    code = genetic_code()
    near = {aa for codon, aa in code.items()
            if sum(a != b for a, b in zip(codon, stop)) == 1 and aa != "*"}
    return tuple(sorted(near))


# --- Fixed values: assay geometry and thresholds -----------------------------------------------
CONTEXT_WINDOW_NT = 72
LAST_JUNCTION_NT = 50
START_PROXIMAL_NT = 150
LONG_EXON_NT = 407
TOLERABLE_SHARE = 0.5
READTHROUGH_THRESHOLDS = (0.005, 0.01, 0.02)
MINIMUM_UTR3_LENGTH = 50
MINIMUM_CDS_PSITES = 100
MINIMUM_SCORABLE_CODONS = 64
FIRST_SCORABLE_CODON = 6
CDS_FROM_START_NT = 18
CDS_FROM_STOP_NT = -16
TERMINATION_FROM_STOP_NT = -15
MINIMUM_LENGTH_SHARE = 0.01
MINIMUM_PSITES = 1_000_000
MINIMUM_FRAME0_SHARE = 0.40
OFFSET_FROM_5 = (11, 14)
SURVEY_LENGTHS = (18, 40)
MINIMUM_ADAPTER_RATE = 0.5
PLAUSIBLE_FOOTPRINT = (20, 40)
SITE_SHIFT = {"a": 1, "p": 0}
CONFIDENCE = 0.95
POWER = 0.80
MAXIMUM_REPLICATES = 1000
PERMUTATIONS_REQUIRED = 999
SEED = 721
ROUNDS = 10
TRAIN_FRACTION = 0.9
SCALE_READTHROUGH = 100_000
SCALE_TOLERANCE = 1_000
ABSENT = -1

QUANTITIES = ("downstream_occupancy", "termination_occupancy", "frame_gap")
CDS_FRAMES = ("cds_frame0", "cds_frame1", "cds_frame2")
EXTENSION_FRAMES = ("extension_frame0", "extension_frame1", "extension_frame2")
COUNT_COLUMNS = (*CDS_FRAMES, *EXTENSION_FRAMES, "termination", "cds_total")

# --- Fixed values: variant archive vocabulary --------------------------------------------------
NONSENSE_TERM = "SO:0001587"
PATHOGENIC_CLASSES = ("Pathogenic", "Likely_pathogenic", "Pathogenic/Likely_pathogenic")
REVIEW_STARS = {
    "practice_guideline": 4,
    "reviewed_by_expert_panel": 3,
    "criteria_provided,_multiple_submitters,_no_conflicts": 2,
    "criteria_provided,_single_submitter": 1,
    "criteria_provided,_conflicting_classifications": 1,
}
PLACEHOLDER_CONCEPTS = {
    "CN517202": "not provided",
    "CN169374": "not specified",
    "C3661900": "not provided",
}
ENTITY_STATUS = ("mapped", "medgen_only")
PRIMARY_CHROMOSOMES = tuple(f"chr{n}" for n in (*range(1, 23), "X", "Y"))
CHROMOSOME_ORDER = tuple(str(n) for n in (*range(1, 23), "X", "Y", "MT"))
UTR_FEATURES = ("UTR", "three_prime_utr", "3UTR")

# --- Fixed values: consequence -> (class, applies, reason) -------------------------------------
TRIAGE = {
    "stop_gained": (
        "supported_nonsense", True,
        "a premature stop codon truncates the protein; "
        "readthrough may restore the full-length product"),
    "missense_variant": (
        "missense", False,
        "an amino-acid substitution, not a premature stop; "
        "readthrough has nothing to read through"),
    "frameshift_variant": (
        "frameshift", False,
        "a shifted reading frame changes the downstream sequence; readthrough cannot restore it"),
    "splice_acceptor_variant": (
        "splice", False,
        "a splice-site change alters the transcript itself, which readthrough does not address"),
    "splice_donor_variant": (
        "splice", False,
        "a splice-site change alters the transcript itself, which readthrough does not address"),
    "splice_region_variant": (
        "splice", False,
        "a splice-region change may alter the transcript, which readthrough does not address"),
    "synonymous_variant": (
        "synonymous", False,
        "a silent change leaves the protein unchanged; there is nothing to rescue"),
    "stop_lost": (
        "stop_loss", False,
        "the native stop is lost, extending the protein; readthrough would not help"),
}
TRIAGE_NO_TRANSCRIPT = (
    "unsupported_transcript", False,
    "the variant's transcript is outside the supported set, so no analysis is offered")
CONSEQUENCES = (*TRIAGE, "inframe_deletion", "inframe_insertion")
TRIAGE_CLASSES = ("supported_nonsense", "missense", "frameshift", "splice", "synonymous",
                  "stop_loss", "unsupported_transcript", "unsupported")

# --- Fixed values: genes, biotypes and names ---------------------------------------------------
PROGRAMMED_READTHROUGH = (
    "AQP4", "MAPK10", "OPRK1", "OPRL1", "VDR", "MTCH2", "AGO1", "LDHB", "SACM1L", "MDH1",
    "EEF1B2", "TMED2", "CDKN2A", "BRI3", "SLC35A4",
)
STRUCTURAL_BIOTYPES = (
    "rRNA", "rRNA_pseudogene", "Mt_rRNA", "Mt_tRNA", "snRNA", "snoRNA", "scaRNA", "misc_RNA",
    "vault_RNA", "sRNA", "scRNA",
)
MITOCHONDRIAL_SYMBOL = r"^MT-"
STRUCTURAL_SYMBOL = r"^(RN7SL|RN7SK|RNU\d|RNA5S|RNA5-8S|RNA18S|RNA28S|RMRP|RPPH1|RNY\d)"
THERAPY_NAMES = {
    "CC90009": "CC-90009",
    "Clitocine": "Clitocine",
    "DAP": "2,6-diaminopurine",
    "G418": "G418 (geneticin)",
    "SJ6986": "SJ6986",
    "SRI": "SRI-41315",
}
ESCAPE_RULES = ("is_last", "is_penultimate", "is_css_proximal", "is_single", "is_407plus")
VERDICTS = ("supported", "refuted", "inconclusive", "untestable")
EVIDENCE_GAP = {"none": 3, "indirect": 2, "partial": 1, "direct": 0}
FEASIBILITY = {"low": 3, "moderate": 2, "high": 1, "very high": 0}
QUADRANTS = ("both", "predicted only", "measured only", "neither")
SUPPORT_STRATA = ("unsupported", "thin", "supported")
METAPROFILE_REGIONS = {
    "Distance from start (nt)": "start",
    "Distance from stop (nt)": "stop",
}
ALIGNER_FIELDS = {
    "Number of input reads": "reads_input",
    "Uniquely mapped reads number": "reads_unique",
    "Uniquely mapped reads %": "unique_rate",
    "% of reads mapped to multiple loci": "multimapped_rate",
    "% of reads mapped to too many loci": "over_multimapped_rate",
    "% of reads unmapped: too short": "unmapped_too_short_rate",
    "Average mapped length": "mapped_length_mean",
}

# --- Fixed values: base editors (name, from, to, window low, window high, PAM, arm) -------------
PROTOSPACER_NT = 20
EDIT_MARGIN_NT = 26
PRIMARY_PANEL = (
    ("BE4max", "C", "T", 4, 8, "NGG", "primary"),
    ("ABE7.10", "A", "G", 4, 7, "NGG", "primary"),
)
RELAXED_PAMS = (("SpCas9-NG", "NG"), ("SpG", "NGN"), ("SpRY", "NRN"))
SENSITIVITY_PANEL = tuple(
    (f"{name}+{fusion}", before, after, low, high, pam, "sensitivity")
    for name, before, after, low, high, _, _ in PRIMARY_PANEL
    for fusion, pam in RELAXED_PAMS
)
PAM_BASES = {"N": "[ACGT]", "G": "G", "R": "[AG]", "Y": "[CT]"}

# The terms whose library support is counted.
SUPPORT_KEYS: dict[str, tuple[str, ...]] = {
    "stop": ("stop_type",),
    "upstream": ("up_123nt",),
    "downstream": ("down_123nt",),
    "interaction_cell": ("stop_type", "down_123nt"),
    "complete_context": ("stop_type", "up_123nt", "down_123nt"),
}
