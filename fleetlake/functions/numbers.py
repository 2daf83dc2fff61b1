"""Sizes, ratios and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, as_col

# Unit names, and the figure from which the next unit is used.
SIZE_UNITS = ["kB", "MB", "GB", "TB"]
SIZE_SWITCH = 10240
UNIT_POWERS = {"k": 1, "m": 2, "g": 3, "t": 4, "p": 5, "e": 6}


def size_pretty(size: ColumnLike, wide: bool = False) -> Column:
    """Bytes as text in the first unit whose half-up value stays below 10240.

    Figures are 64-bit integers, with ``wide`` decimals of up to 38 digits.
    """
    figure = as_col(size).cast("decimal(38,0)" if wide else "bigint")
    # What 64 bits do not hold is null here and has the largest unit.
    n = F.nullif(figure.try_cast("bigint"), F.lit(-(1 << 63))) if wide else figure
    magnitude = F.abs(n)
    sign = F.when(n < 0, F.lit("-")).otherwise(F.lit(""))

    def in_unit(power: int) -> Column:
        return F.shiftright(F.shiftright(magnitude, 10 * power - 1) + 1, 1)

    text = F.when(magnitude < SIZE_SWITCH, F.concat(n.cast("string"), F.lit(" bytes")))
    for power, unit in enumerate(SIZE_UNITS, start=1):
        rendered = F.concat(sign, in_unit(power).cast("string"), F.lit(" " + unit))
        if unit != SIZE_UNITS[-1]:
            text = text.when(in_unit(power) < SIZE_SWITCH, rendered)
        else:
            text = text.when(n.isNotNull(), rendered)
    if wide:
        unit = F.lit(1 << 10 * len(SIZE_UNITS)).cast("decimal(20,0)")
        shifted = F.abs(figure) + F.lit(1 << 10 * len(SIZE_UNITS) - 1)
        # A quotient of decimals is rounded, so the remainder goes first.
        most = ((shifted - shifted % unit) / unit).cast("decimal(38,0)").cast("string")
        text = text.when(figure.isNotNull(), F.concat(F.when(figure < 0, F.lit("-")).otherwise(F.lit("")), most, F.lit(" " + SIZE_UNITS[-1])))
    return text


def bytes_to(size: ColumnLike, unit: str) -> Column:
    """Bytes in a larger unit (``k m g t p e``) as a double."""
    return as_col(size).cast("double") / F.lit(float(1024 ** UNIT_POWERS[unit.lower()]))


def bytes_text(size: ColumnLike, unit: str = "g", digits: int = 2) -> Column:
    """Bytes in a larger unit with a fixed number of decimals, as in ``1.50GB``."""
    value = F.round(bytes_to(size, unit), digits).cast(f"decimal(38,{digits})")
    return F.concat(value.cast("string"), F.lit(unit.upper() + "B"))


def fmt_num(value: ColumnLike, pattern: str = "999,999,999,999") -> Column:
    """A number in a digit pattern, right-aligned with one place for the sign."""
    digits = F.coalesce(F.nullif(F.trim(F.to_char(as_col(value), F.lit(pattern))), F.lit("")), F.when(as_col(value) == 0, F.lit("0")))
    return F.lpad(digits, len(pattern) + 1, " ")


def ratio(num: ColumnLike, den: ColumnLike, digits: int | None = None, scale: float = 1.0) -> Column:
    """``scale * num / den``; null, not an error, when ``den`` is zero or null."""
    value = F.try_divide(as_col(num).cast("double") * F.lit(scale), as_col(den).cast("double"))
    return value if digits is None else F.round(value, digits)


def severity(value: ColumnLike, bounds: list, labels: list[str]) -> Column:
    """The label of the first bound the value stays below; the last label beyond all."""
    if len(labels) != len(bounds) + 1:
        raise ValueError("one label more than bounds is needed")
    x = as_col(value)
    verdict = F.when(x < F.lit(bounds[0]), F.lit(labels[0]))
    for bound, label in list(zip(bounds, labels))[1:]:
        verdict = verdict.when(x < F.lit(bound), F.lit(label))
    return verdict.when(x >= F.lit(bounds[-1]), F.lit(labels[-1]))
