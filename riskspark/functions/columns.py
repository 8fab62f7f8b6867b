"""Generic NULL-aware column helpers (all JVM-side expressions)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.config import NULL_TOKENS

# A string pandas' to_numeric would accept (sign, decimals, exponent, inf).
NUMERIC_PATTERN = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: Spark ``trim`` removes spaces only, not tabs/newlines."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def nan_to_null(c: Column) -> Column:
    """NaN -> NULL (Spark orders NaN above every number and says NaN = NaN)."""
    return F.nanvl(c, F.lit(None).cast(T.DoubleType()))


def num(c: Column, dtype: T.DataType | None = None) -> Column:
    """NULL-safe float (B13): numbers pass, numeric text is parsed, everything else NULL.

    ``try_cast`` alone would accept '1d' / '1f' and give NaN for 'nan', which
    pandas rejects, so text is guarded by a strict numeric pattern first.
    """
    if dtype is not None and isinstance(dtype, T.NumericType):
        return nan_to_null(c.cast(T.DoubleType()))
    if dtype is not None and isinstance(dtype, T.BooleanType):
        return c.cast(T.DoubleType())
    s = c.cast(T.StringType())
    parsed = F.when(s.rlike(NUMERIC_PATTERN), strip_ws(s).try_cast(T.DoubleType()))
    return nan_to_null(parsed)


def num_col(df: DataFrame, name: str) -> Column:
    """``num`` of a column by name, or a typed NULL when the column is absent."""
    if name not in df.columns:
        return F.lit(None).cast(T.DoubleType())
    return num(F.col(name), df.schema[name].dataType)


def clip01(x: Column) -> Column:
    """Clamp to [0, 1]; NULL stays NULL (greatest/least would skip it)."""
    return F.when(x.isNull(), F.lit(None).cast(T.DoubleType())).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def null_token(c: Column) -> Column:
    """Text -> NULL when it is one of pandas' default missing-value tokens."""
    return F.when(c.isin(*NULL_TOKENS), F.lit(None).cast(T.StringType())).otherwise(c)


def map_lookup(mapping: dict, key: Column, default=None) -> Column:
    """Dictionary lookup as a map literal (constant-folded by Catalyst)."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    v = F.element_at(m, key) if mapping else F.lit(None)
    # element_at on a map returns NULL for a missing key (try_element_at semantics
    # are needed only under ANSI for arrays; maps give NULL).
    return v if default is None else F.coalesce(v, F.lit(default))


def safe_div(a: Column, b: Column, zero=0.0) -> Column:
    """a / b with ``zero`` on zero or NULL division."""
    return F.coalesce(F.try_divide(a, b), F.lit(zero))


def _tie_goes_up(a: Column, scale: float) -> Column:
    """Whether ``a * scale``, computed as a tie at .5, lies above it (exact ties: odd ones go up).

    A Dekker split gives the rounding error of the product.
    """
    t = a * F.lit(scale)
    c = F.lit(134217729.0) * a
    high = c - (c - a)
    error = (high * F.lit(scale) - t) + (a - high) * F.lit(scale)
    return F.when(error != 0, error > 0).otherwise(F.floor(t) % 2 == 1)


def _units(x: Column, digits: int) -> Column:
    """``|x|`` in units of ``10^-digits``, rounded as Python does: by the exact binary value.

    Spark's ``round`` and ``bround`` and Java's ``%.nf`` round the shortest decimal
    form (0.38375 -> 0.3838, though the double is 0.38374999..). Off a tie the
    computed product is on the right side of .5; a computed tie is settled by the
    product's rounding error. That rare branch is a lambda, which keeps the
    generated code small.
    """
    scale = float(10 ** digits)
    a = F.abs(x)
    t = a * F.lit(scale)
    whole = F.floor(t)
    part = t - whole
    tie = F.element_at(F.transform(F.array(a), lambda v: _tie_goes_up(v, scale)), 1)
    return (whole + F.when((part > 0.5) | ((part == 0.5) & tie), 1).otherwise(0)).cast("long")


def py_round(x: Column, digits: int) -> Column:
    """Python ``round(x, digits)`` for finite doubles; NULL stays NULL."""
    k = _units(x, digits).cast(T.DoubleType()) / F.lit(float(10 ** digits))
    return F.when(x < 0, -k).otherwise(k)


def py_fixed(x: Column, digits: int, plus: bool = False) -> Column:
    """Python ``f"{x:.{digits}f}"`` (``:+.{digits}f`` with ``plus``) for finite doubles."""
    k = _units(x, digits)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit("+" if plus else ""))
    if digits == 0:
        return F.concat(sign, k.cast("string"))
    int_part = (k / F.lit(10 ** digits)).cast("long").cast("string")
    frac_part = F.lpad((k % F.lit(10 ** digits)).cast("string"), digits, "0")
    return F.concat(sign, int_part, F.lit("."), frac_part)
