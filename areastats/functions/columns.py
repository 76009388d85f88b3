"""Column expressions shared by the operators.

All of them stay inside whole-stage code generation; none needs a Python worker.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: half the circumference of the sphere used by web maps, in metres.
MERCATOR_HALF_WIDTH = 20037508.34


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- predicates ---------------------------------------------------------------


def not_in(c: str | Column, codes: Iterable, drop_null: bool = False) -> Column:
    """True for rows whose code is not listed; NULL codes are kept unless asked otherwise."""
    c = as_column(c)
    cond = ~c.isin(list(codes))
    return cond if drop_null else cond | c.isNull()


def differs(c: str | Column, value, drop_null: bool = False) -> Column:
    """True for rows unlike `value`; NULL is unlike everything unless `drop_null`."""
    c = as_column(c)
    cond = c != F.lit(value)
    return cond if drop_null else cond | c.isNull()


def in_range(c: str | Column, low, high) -> Column:
    """Half-open range: low <= c < high."""
    c = as_column(c)
    return (c >= F.lit(low)) & (c < F.lit(high))


# -- recoding and text --------------------------------------------------------


def map_values(c: str | Column, mapping: Mapping, default: str = "keep") -> Column:
    """Replace whole values in one step (results are not mapped again).

    `default` says what an unlisted value becomes: "keep" or "null". Meant for
    mappings written in code; use `operators.lookup` for mappings held in a table.
    """
    if default not in ("keep", "null"):
        raise ValueError(f"default must be 'keep' or 'null', not {default!r}")
    c = as_column(c)
    if not mapping:
        return c if default == "keep" else F.lit(None)
    # One CASE rather than a map literal: it widens int and bigint keys by itself.
    branches = [(c == F.lit(old), F.lit(new)) for old, new in mapping.items()]
    expr = F.when(*branches[0])
    for cond, value in branches[1:]:
        expr = expr.when(cond, value)
    return expr.otherwise(c) if default == "keep" else expr


def replace_text(c: str | Column, replacements: Mapping[str, str]) -> Column:
    """Replace literal substrings anywhere in the value, one after the other."""
    return reduce(
        lambda acc, item: F.replace(acc, F.lit(item[0]), F.lit(item[1])),
        replacements.items(),
        as_column(c),
    )


def to_number(c: str | Column) -> Column:
    """Number held in a text; NULL when the text is not a number."""
    return as_column(c).try_cast("double")


def decimal_comma(c: str | Column) -> Column:
    """Number written with a decimal comma; sentinels such as '-' give NULL."""
    return to_number(replace_text(c, {",": "."}))


def code_prefix_fill(c: str | Column, code: str | Column, length: int) -> Column:
    """`c`, or where it is NULL the first characters of `code`."""
    return F.coalesce(as_column(c), F.substring(as_column(code), 1, length))


def pad_code(c: str | Column, width: int) -> Column:
    """Numeric code as text with leading zeros; longer codes are left whole."""
    text = as_column(c).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


# -- arithmetic ---------------------------------------------------------------


def row_sum(cols: Iterable[str | Column]) -> Column:
    """Sum across columns of one row; NULL if any part is NULL."""
    return reduce(add, [as_column(c) for c in cols])


def percent(part: str | Column, whole: str | Column) -> Column:
    """100 * part / whole; NULL when the whole is zero."""
    return F.try_divide(as_column(part), as_column(whole)) * 100


def gap_percent(high: str | Column, low: str | Column) -> Column:
    """How far `low` lies below `high`, in percent of `high`."""
    return percent(as_column(high) - as_column(low), high)


def round_to(c: str | Column, digits: int = 2, mode: str = "half_even") -> Column:
    """Round to `digits`; ties go to the even digit, or away from zero with "half_up"."""
    if mode not in ("half_even", "half_up"):
        raise ValueError(f"unknown rounding mode {mode!r}")
    return (F.bround if mode == "half_even" else F.round)(as_column(c), digits)


# -- geography ----------------------------------------------------------------


def mercator_x(lon: str | Column) -> Column:
    return as_column(lon).cast("double") * MERCATOR_HALF_WIDTH / 180


def mercator_y(lat: str | Column) -> Column:
    angle = (F.lit(90) + as_column(lat).cast("double")) * math.pi / 360
    return F.log(F.tan(angle)) / (math.pi / 180) * MERCATOR_HALF_WIDTH / 180


# -- ordering cells -----------------------------------------------------------


def log_cell(c: str | Column, per_unit: int = 1024) -> Column:
    """Integer cell of a number; a larger number never falls in a lower cell.

    A cell is as wide as a fixed part of the numbers in it, for small numbers as for large ones.
    The logarithms of doubles lie between -745 and 710, so there are at most 1,455 * per_unit
    cells on either side of zero; zero and the two infinities have cells of their own.
    """
    c = as_column(c)
    size = F.abs(c)
    cell = (
        F.when(size == 0, F.lit(0))
        .when(size == float("inf"), F.lit(1500 * per_unit))
        .otherwise(F.floor((F.log(size) + 746) * per_unit).cast("int"))
    )
    return F.when(c < 0, -cell).otherwise(cell)


# -- distributions ------------------------------------------------------------

# Lanczos coefficients of the gamma function for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
#: Steps of the continued fraction; it settles within about the square root of the degrees of freedom.
FRACTION_STEPS = 1000


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z >= 0.5."""
    series = reduce(add, [F.lit(c) / (z + (i - 1.0)) for i, c in enumerate(LANCZOS) if i], F.lit(LANCZOS[0]))
    t = z + 6.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z - 0.5) * F.ln(t) - t + F.ln(series)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function for 0 < x < 1, by its continued fraction."""
    # The fraction converges quickly on one side of the mean; the other side is 1 minus its mirror image.
    mirrored = x >= (a + 1.0) / (a + b + 2.0)
    p, q, v = F.when(mirrored, b).otherwise(a), F.when(mirrored, a).otherwise(b), F.when(mirrored, 1.0 - x).otherwise(x)
    given = F.struct(p.alias("p"), q.alias("q"), v.alias("v"))

    def step(s: Column, m: Column) -> Column:
        p, q, v = s["g"]["p"], s["g"]["q"], s["g"]["v"]
        even = m * (q - m) * v / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * v / ((p + 2 * m) * (p + 2 * m + 1))
        d1, c1 = 1.0 / (1.0 + even * s["d"]), 1.0 + even / s["c"]
        d2, c2 = 1.0 / (1.0 + odd * d1), 1.0 + odd / c1
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"), s["g"].alias("g"))

    first = 1.0 / (1.0 - (p + q) * v / (p + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"), given.alias("g"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), lambda m: m.cast("double"))
    fraction = F.aggregate(steps, start, step, lambda s: s["h"])
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1.0 - x))
    side = front * fraction / p
    return F.when(mirrored, 1.0 - side).otherwise(side)


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation over n pairs; NULL below three pairs, 0 for a perfect one."""
    x = 1.0 - r * r
    inside = F.when((n > 2) & (x > 0) & (x < 1), F.struct(((n - 2) / 2.0).alias("a"), x.alias("x")))
    tail = incomplete_beta(inside["a"], F.lit(0.5), inside["x"])
    return F.when((n > 2) & (x <= 0), F.lit(0.0)).when((n > 2) & (x >= 1), F.lit(1.0)).when(inside.isNotNull(), tail)
