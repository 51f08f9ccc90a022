"""Exact decimal rounding and fixed-point formatting as Spark Column expressions.

Spark's ``round`` / ``format_string`` round HALF_UP on the *shortest decimal text*
of a double (``format_string('%.1f', 0.15)`` gives ``0.2``), while the numbers this
engine must reproduce are rounded on the exact binary value with ties to even
(``0.15`` is ``0.1499999...`` and gives ``0.1``; ``12.25`` is an exact tie and gives
``12.2``), as Python's ``round`` and ``f"{x:.1f}"`` do.

* ties to even: ``format_number`` (Java's DecimalFormat, HALF_EVEN on the exact
  binary value) gives exactly Python's text; parsing it back gives Python's ``round``.
* ties up (JavaScript ``toFixed``): the rounding direction is decided exactly with an
  error-free product (Dekker's TwoProduct) in plain double arithmetic.

Both stay inside whole-stage codegen - no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1, Veltkamp split of a 53-bit mantissa


def _split(a: float) -> tuple[float, float]:
    c = _SPLITTER * a
    hi = c - (c - a)
    return hi, a - hi


def _scaled_integer(x: Column, digits: int, ties: str) -> Column:
    """The integer n nearest to x * 10**digits, computed on the exact product."""
    scale = float(10**digits)
    s_hi, s_lo = _split(scale)
    x = x.cast("double")
    p = x * F.lit(scale)
    c = x * F.lit(_SPLITTER)
    a_hi = c - (c - x)
    a_lo = x - a_hi
    # exact residual: x * scale == p + err
    err = ((a_hi * F.lit(s_hi) - p) + a_hi * F.lit(s_lo) + a_lo * F.lit(s_hi)) + a_lo * F.lit(s_lo)
    f = F.floor(p)
    frac = p - f
    if ties == "even":
        tie = F.when(F.pmod(f, F.lit(2)) == 0, f).otherwise(f + 1)
    elif ties == "up":  # JavaScript toFixed: the larger n
        tie = f + 1
    else:
        raise ValueError(f"ties must be 'even' or 'up', got {ties!r}")
    n = (
        F.when(frac > 0.5, f + 1)
        .when(frac < 0.5, f)
        .when(err > 0, f + 1)
        .when(err < 0, f)
        .otherwise(tie)
    )
    return n.cast("bigint")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def round_exact(x: Column, digits: int, ties: str = "even") -> Column:
    """Round like Python's ``round(x, digits)``: nearest double to the decimal result."""
    if isinstance(x, str):
        x = F.col(x)
    x = x.cast("double")
    if ties == "even":
        out = format_fixed(x, digits).cast("double")
    else:
        out = _scaled_integer(x, digits, ties).cast("double") / F.lit(float(10**digits))
    return F.when(_finite(x), out).otherwise(x)


def format_fixed(x: Column, digits: int, ties: str = "even") -> Column:
    """Text of x with exactly ``digits`` decimals, like Python ``f"{x:.{digits}f}"``."""
    if isinstance(x, str):
        x = F.col(x)
    if ties == "even":
        return F.translate(F.format_number(x.cast("double"), digits), ",", "")
    n = _scaled_integer(x, digits, ties)
    scale = 10**digits
    mag = F.abs(n)
    sign = F.when(n < 0, F.lit("-")).otherwise(F.lit(""))
    whole = (mag / F.lit(scale)).cast("bigint") if digits else mag
    if digits == 0:
        text = F.concat(sign, whole.cast("string"))
    else:
        fraction = F.lpad(F.pmod(mag, F.lit(scale)).cast("string"), digits, "0")
        text = F.concat(sign, whole.cast("string"), F.lit("."), fraction)
    return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(text)


def format_percent(x: Column, digits: int = 1) -> Column:
    """``f"{100 * x:.1f}%"``: the product is taken in double first, as the reference does."""
    if isinstance(x, str):
        x = F.col(x)
    return F.concat(format_fixed(F.lit(100.0) * x.cast("double"), digits), F.lit("%"))


def sql_round(expr: str, digits: int) -> str:
    """DuckDB text for Python's ``round(x, digits)`` (printf is correctly rounded there)."""
    return f"CAST(printf('%.{digits}f', CAST({expr} AS DOUBLE)) AS DOUBLE)"
