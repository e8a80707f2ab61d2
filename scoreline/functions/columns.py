"""Column expressions. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python and Unicode count as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)


def strip(c: Column) -> Column:
    """Unicode strip on both ends; plain trim() removes spaces only."""
    return F.btrim(c, F.lit(WHITESPACE))


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def text_to_double(text: Column) -> Column:
    """Stripped text to number, NaN or null. The JVM would also read '12d' and '12f'."""
    suffixed = F.substring(text, -1, 1).isin("d", "D", "f", "F") & text.rlike("[0-9.][dDfF]$")
    return F.when(~suffixed, text.try_cast("double"))


def double_to_whole(number: Column) -> Column:
    """A fraction is cut off; NaN and what no 64-bit integer can hold become null."""
    return F.when(F.abs(number) < F.lit(2.0**63), number.try_cast("bigint"))


def parse_double(c: Column) -> Column:
    return text_to_double(strip(c.cast("string")))


def lenient_double(c: Column) -> Column:
    """Unreadable, blank or NaN becomes 0.0."""
    return F.coalesce(null_if_nan(parse_double(c)), F.lit(0.0))


def strict_double(c: Column) -> Column:
    """Unreadable, blank or NaN becomes null, which the callers report as an error."""
    return null_if_nan(parse_double(c))


def whole_number(c: Column) -> Column:
    """Integer coercion; anything unreadable becomes null."""
    return double_to_whole(parse_double(c))


def text_to_flag(text: Column) -> Column:
    return F.when(text == "Yes", F.lit(1)).when(text == "No", F.lit(0)).cast("bigint")


def yes_no(c: Column) -> Column:
    """Yes/No to 1/0; anything else becomes null."""
    return text_to_flag(strip(c))


def ground_truth(c: Column) -> Column:
    """Yes/No is kept, everything else counts as unlabelled."""
    return F.when(c.isin("Yes", "No"), c)


def ground_truth_int(c: Column) -> Column:
    """Yes/No, true/false or an integer to 0/1/n; everything else counts as unlabelled."""
    return (
        F.when(c.isin("Yes", "true"), F.lit(1).cast("bigint"))
        .when(c.isin("No", "false"), F.lit(0).cast("bigint"))
        .otherwise(F.when(c.rlike("^-?[0-9]+$"), c.try_cast("bigint")))
    )


def threshold_label(probability: Column, threshold: Column | float = 0.5) -> Column:
    """Yes from the threshold on (inclusive); NaN has no label."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    label = F.when(probability >= limit, "Yes").otherwise("No")
    return F.when(~F.isnan(F.coalesce(probability.cast("double"), F.lit(0.0))), label)


def risk_band(probability: Column, mid: float = 0.40, high: float = 0.70) -> Column:
    """Bands start above their threshold (exclusive); null is unknown."""
    return (
        F.when(probability.isNull(), "unknown")
        .when(probability > high, "high")
        .when(probability > mid, "medium")
        .otherwise("low")
    )


def psi_band(psi: Column, moderate: float = 0.10, significant: float = 0.25) -> Column:
    """Bands start at their threshold (inclusive)."""
    return (
        F.when(psi < moderate, "none").when(psi < significant, "moderate").otherwise("significant")
    )


def severity(value: Column, threshold: Column, critical: float = 2.0, info: float = 1.2) -> Column:
    """How far a breached value lies past its threshold."""
    ratio = value / F.when(threshold > 0, threshold)
    return (
        F.when(ratio.isNull(), "warning")
        .when(ratio >= critical, "critical")
        .when(ratio >= info, "warning")
        .otherwise("info")
    )


_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)


def parse_timestamp(c: Column) -> Column:
    """ISO-8601 text to an instant, zone-less text as UTC, unreadable text to null."""
    text = c.cast("string")
    # The cast alone would also read a bare year or a time of day.
    return F.when(text.rlike(_ISO), text.try_cast("timestamp"))


def iso_second(c: Column) -> Column:
    """UTC instant as text, second resolution, Z suffix."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def now_second() -> Column:
    """Processing time, one value per (micro-)batch."""
    return F.date_trunc("second", F.current_timestamp())


def round_half_even(c: Column, digits: int) -> Column:
    """Round the exact binary value half to even, as Python and IEEE do.

    The built-in round works on the shortest decimal text, so 2.675 goes up although the
    double lies below the tie. The error of the scaled product (Dekker's split product)
    tells on which side of a tie the double really is.
    """
    scale = float(10**digits)
    x = c.cast("double")
    scaled = x * scale
    wide = x * 134217729.0
    upper = wide - (wide - x)
    error = (upper * scale - scaled) + (x - upper) * scale
    base = F.floor(scaled).cast("double")
    rest = scaled - base
    odd = F.pmod(base, F.lit(2.0)) == 1.0
    tie_up = (rest == 0.5) & ((error > 0) | ((error == 0) & odd))
    rounded = (base + F.when((rest > 0.5) | tie_up, 1.0).otherwise(0.0)) / scale
    # Below 2**52 / scale every step above is exact; beyond, doubles lie further apart than that.
    beyond = F.coalesce(F.bround(x.try_cast("decimal(38,10)"), digits).cast("double"), x)
    return F.when(F.abs(scaled) < 2.0**52, rounded).otherwise(beyond)


def four_digits(c: Column) -> Column:
    """Text of the exact binary value with four digits; format_string alone rounds its decimal text."""
    return F.format_string("%.4f", round_half_even(c, 4))


def count_where(test: Column) -> Column:
    """Rows that pass a test."""
    return F.count(F.when(test, F.lit(1)))


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """Division that answers 0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.when(bottom != 0, bottom))
