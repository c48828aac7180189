"""Text, number and lookup scalars as Column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stopscan.functions.fixed import (
    MITOCHONDRIAL_SYMBOL,
    REVIEW_STARS,
    STRUCTURAL_SYMBOL,
    THERAPY_NAMES,
)


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once.

    A lambda variable is bound, not substituted, so a long derivation stays as large as it is
    written instead of being copied into every place that reads it.
    """

    return F.get(F.transform(F.array(value), body), F.lit(0))


def met(predicate: Column) -> Column:
    """A predicate on a missing value counts as not met."""

    return F.coalesce(predicate, F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null on a zero denominator."""

    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """A small fixed mapping as a folded map literal."""

    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(literal, key)
    return found if default is None else F.coalesce(found, default)


def review_stars(status: Column) -> Column:
    return lookup(REVIEW_STARS, status, F.lit(0))


def therapy_name(therapy: Column) -> Column:
    return lookup(THERAPY_NAMES, therapy, therapy)


def gene_class(symbol: Column) -> Column:
    return (
        F.when(F.coalesce(symbol, F.lit("")).rlike(MITOCHONDRIAL_SYMBOL), "mitochondrial")
        .when(F.coalesce(symbol, F.lit("")).rlike(STRUCTURAL_SYMBOL), "structural")
        .otherwise("nuclear")
    )


def half_even(value: Column, places: int = 6) -> Column:
    """Rounding to `places`, halves to even, nulls and NaN kept as null."""

    return F.bround(F.when(~F.isnan(value), value), places)


def scaled(value: Column, scale: int) -> Column:
    """Fixed point, halves to even; a missing value is zero."""

    return F.coalesce(F.bround(value * scale, 0).cast("bigint"), F.lit(0).cast("bigint"))


def stop_code(stop: Column, order: tuple[str, ...] = ("UAA", "UAG", "UGA")) -> Column:
    """The position of a stop codon in `order`; an unknown one is refused."""

    name = F.upper(F.trim(stop))
    return F.when(name.isin(*order), F.array_position(F.lit(list(order)), name) - 1).otherwise(
        F.raise_error(F.concat(F.lit("unrecognised stop codon "), F.coalesce(name, F.lit("null"))))
        .cast("bigint")
    )


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """`chrom:000000123|ref|alt`."""

    return F.format_string("%s:%09d|%s|%s", chrom, pos.cast("long"), ref, alt)


def named_items(text: Column) -> Column:
    """A `;` list, trimmed, without blanks and without the literal `none`."""

    trimmed = F.transform(F.split(text, ";"), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: (x != "") & (x != "none"))


def joined_or_none(items: Column, sep: str = "; ") -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, sep)).otherwise("none")


def xref_ids(entry: Column, source: str) -> Column:
    """The ids one source lists in a comma-separated `Source:ID` entry, first seen first."""

    prefix = source + ":"
    kept = F.filter(F.split(entry, ","),
                    lambda x: F.startswith(x, F.lit(prefix)) & (F.length(x) > len(prefix)))
    return F.array_distinct(F.transform(kept, lambda x: F.substring(x, len(prefix) + 1, 1 << 30)))


def without_version(accession: Column) -> Column:
    return F.split_part(accession, F.lit("."), F.lit(1))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""

    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return total


def _t_tail(t: float, df: float) -> float:
    """P(T > t) of Student's t for t >= 0."""

    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else None
    if log_front is None:
        return 0.5 if t == 0 else 0.0
    if x < (a + 1) / (a + b + 2):
        return 0.5 * math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 0.5 * (1.0 - math.exp(log_front) * _beta_fraction(b, a, 1 - x) / b)


def t_quantile_value(p: float, df: float) -> float:
    """The p-quantile of Student's t, p >= 0.5, by bisection on the upper tail."""

    low, high = 0.0, 1.0
    while _t_tail(high, df) > 1.0 - p:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if _t_tail(middle, df) > 1.0 - p:
            low = middle
        else:
            high = middle
        if high - low <= 1e-15 * high:
            break
    return (low + high) / 2.0


def t_quantile(p: float, df: Column) -> Column:
    """Student's t quantile of a column of degrees of freedom; for result-sized tables only."""

    @F.pandas_udf("double")
    def quantile(values: pd.Series) -> pd.Series:
        known = {v: t_quantile_value(p, float(v)) for v in values.dropna().unique() if v >= 1}
        return values.map(known).astype(float)

    return quantile(df.cast("double"))
