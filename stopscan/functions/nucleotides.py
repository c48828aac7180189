"""Sequence scalars as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopscan.functions.fixed import CODON_BASES, CODON_RESIDUES, PAM_BASES, STOP_CODONS
from stopscan.functions.scalars import let


def as_dna(sequence: Column) -> Column:
    """Upper-case DNA spelling."""

    return F.translate(sequence, "acgtuACGTU", "ACGTTACGTT")


def as_rna(sequence: Column) -> Column:
    """Lower-case RNA spelling."""

    return F.translate(sequence, "acgtuACGTU", "acguuacguu")


def complement(bases: Column) -> Column:
    return F.translate(bases, "ACGT", "TGCA")


def reverse_complement(sequence: Column) -> Column:
    return complement(F.reverse(sequence))


def base_at(sequence: Column, offset: Column, width: int = 1) -> Column:
    """`width` bases from a 0-based offset; null for a negative offset, short past the end."""

    return F.when(offset >= 0, F.substring(sequence, offset + 1, F.lit(width)))


def is_stop(codon: Column) -> Column:
    return codon.isin(*STOP_CODONS)


def residue(codon: Column) -> Column:
    """One residue per DNA codon: the codon read as a base-4 number indexes the residue string.

    Short codons give null and codons with an unknown base give `X`.
    """

    digit = [F.instr(F.lit(CODON_BASES), F.substring(codon, k, 1)) - 1 for k in (1, 2, 3)]
    known = (digit[0] >= 0) & (digit[1] >= 0) & (digit[2] >= 0)
    index = digit[0] * 16 + digit[1] * 4 + digit[2] + 1
    return F.when(
        F.length(codon) == 3,
        F.when(known, F.substring(F.lit(CODON_RESIDUES), index, F.lit(1))).otherwise(F.lit("X")),
    )


def codons_of(sequence: Column) -> Column:
    """Whole codons of a sequence in order, a trailing partial codon left out."""

    def cut(bases: Column) -> Column:
        whole = F.floor(F.length(bases) / 3).cast("int")
        starts = F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.substring(bases, k * 3 - 2, F.lit(3)))

    # Bound, so a derived sequence is not derived again for every codon.
    return let(sequence, cut)


def translate_sequence(sequence: Column) -> Column:
    """The peptide a DNA sequence encodes, codon by codon."""

    return F.array_join(F.transform(codons_of(sequence), residue), "")


def next_stop_distance(sequence: Column, stop_start: Column) -> Column:
    """Bases from a native stop to the next stop in its frame; null when there is none.

    Null too where the coding sequence does not end in a stop, whose frame would be unreliable.
    """

    tail = F.upper(F.substring(sequence, stop_start + 4, F.length(sequence)))
    found = F.array_position(F.transform(codons_of(tail), is_stop), True)
    return F.when(
        is_stop(F.upper(base_at(sequence, stop_start, 3))) & (found > 0), (found * 3).cast("int")
    )


def pam_pattern(rule: str) -> str:
    """The anchored regular expression a PAM rule stands for; bases past the rule are free."""

    return "^" + "".join(PAM_BASES[symbol] for symbol in rule)


def degenerate_prefix(adapter: Column) -> Column:
    """How many Ns an adapter opens with."""

    return F.length(adapter) - F.length(F.ltrim(adapter, F.lit("N")))


def adapter_start(read: Column, fixed: Column, minimum: Column) -> Column:
    """0-based start of an exact 3' adapter in a read, null where absent.

    A full copy anywhere wins; otherwise the longest adapter prefix that ends the read, at least
    `minimum` bases of it.
    """

    full = F.instr(read, fixed)
    longest = F.least(F.length(fixed) - 1, F.length(read))
    overlaps = F.filter(
        F.when(longest >= minimum, F.sequence(longest, minimum, F.lit(-1))).otherwise(
            F.array().cast("array<int>")),
        lambda k: F.endswith(read, F.substring(fixed, F.lit(1), k)),
    )
    partial = F.length(read) - F.get(overlaps, F.lit(0))
    return F.when(full > 0, full - 1).otherwise(partial)
