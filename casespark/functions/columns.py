"""Reusable Column expressions.  All JVM-side (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a plain decimal number, optionally signed, optional exponent.
# Anything else (``1d``, ``1_0``, ``0x10``, ``<0.1``, ``inf``) is not a number.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_draw(seed, *parts) -> Column:
    """Deterministic 32-bit draw: first 8 hex digits of md5('seed:a:b…') as a long.

    Reproducible in any SQL engine with md5 (the oracle uses the same rule),
    and statistically independent across (seed, parts) unlike linear hashes.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def render_list(arr, sep: str = ",") -> Column:
    """Array -> text in array order (final projections carry no arrays)."""
    return F.concat_ws(sep, _c(arr))


def ordered_by(struct_arr, field: str) -> Column:
    """Sort an array of structs by its leading fields, then keep one field."""
    return F.transform(F.array_sort(_c(struct_arr)), lambda s: s[field])


def safe_ratio(num, den) -> Column:
    """num / den as double; NULL when den is 0 or NULL (never raises)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def numeric_text(c) -> Column:
    """Text -> double following pandas ``to_numeric(errors='coerce')`` on plain numbers."""
    t = _c(c)
    return F.when(t.rlike(NUMERIC_TEXT), F.trim(t).try_cast("double"))


def floor_bucket(c, width: int) -> Column:
    """Floor division bucket start (negative values go down: -5 -> -width)."""
    return (F.floor(_c(c).cast("double") / F.lit(float(width))) * F.lit(width)).cast("long")


def null_safe_ne(c, value) -> Column:
    """True unless c equals value; NULL c is kept (pandas ``!=`` keeps NaN)."""
    return ~_c(c).eqNullSafe(F.lit(value))


def round6(c) -> Column:
    return F.round(_c(c).cast("double"), 6)


def set_size(arr) -> Column:
    return F.size(F.array_distinct(_c(arr)))


def finalize(df, digits: int = 6):
    """Final projection contract: doubles rounded, everything else unchanged."""
    from pyspark.sql.types import DoubleType, FloatType
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
                       else F.col(f.name) for f in df.schema.fields])


def let(expr, fn):
    """Bind ``expr`` once and use it several times inside ``fn`` (a lambda over the value).

    Catalyst substitutes aliases when it pushes filters or collapses projections,
    so an expensive expression referenced twice is evaluated twice; a one-element
    ``transform`` keeps a single evaluation."""
    return F.element_at(F.transform(F.array(expr), fn), 1)


# 32-bit integer mixer ("lowbias32" constants) and the golden-ratio step.
_M32 = 0xFFFFFFFF
_MIX_A, _MIX_B, _GOLDEN = 0x7FEB352D, 0x846CA68B, 0x9E3779B9


def _mul32(h: Column, c: int) -> Column:
    """(h * c) mod 2^32 without 64-bit overflow (ANSI mode raises on overflow)."""
    lo = h * F.lit(c & 0xFFFF)
    hi = (h * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
    return (lo + hi).bitwiseAND(F.lit(_M32))


def mix32(x: Column) -> Column:
    """Avalanche a 32-bit value held in a long (every output bit depends on every input bit)."""
    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = _mul32(x, _MIX_A)
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = _mul32(x, _MIX_B)
    return x.bitwiseXOR(F.shiftright(x, 16))


def stream_draw(base: Column, i: Column) -> Column:
    """i-th 32-bit draw of a per-row stream seeded by ``base`` (e.g. one md5 draw per row):
    cheap integer ops instead of one md5 per (row, i)."""
    return mix32((base + (i.cast("long") * F.lit(_GOLDEN)).bitwiseAND(F.lit(_M32))).bitwiseAND(F.lit(_M32)))


def _tod_micros(t: Column) -> Column:
    text = t.cast("string")                          # 'yyyy-MM-dd HH:mm:ss[.ffffff]', zone-free for NTZ
    frac = F.when(F.length(text) > 20, F.rpad(F.substring(text, 21, 6), 6, "0")).otherwise(F.lit("0")).cast("long")
    return ((F.hour(t) * 60 + F.minute(t)) * 60 + F.second(t)).cast("long") * F.lit(1_000_000) + frac


def micros_between(a, b) -> Column:
    """(b - a) in microseconds between wall-clock timestamps.

    Built from calendar fields only (days apart + time of day), so it does not depend
    on the session time zone: NTZ differences and casts to TIMESTAMP go through the
    session zone in Spark, which shifts wall-clock times that fall in a DST gap."""
    a = _c(a).cast("timestamp_ntz")
    b = _c(b).cast("timestamp_ntz")
    days = F.datediff(F.to_date(b), F.to_date(a)).cast("long")
    return days * F.lit(86_400_000_000) + _tod_micros(b) - _tod_micros(a)


def hours_between(a, b) -> Column:
    """(b - a) in hours as double; NULL when either side is NULL."""
    return micros_between(a, b) / F.lit(3.6e9)


def ts_text(c, length: int = 19) -> Column:
    """'yyyy-MM-dd HH:mm:ss' text of a wall-clock timestamp (date_format consults the session
    zone and moves times inside a DST gap; the NTZ string cast does not)."""
    return F.substring(_c(c).cast("timestamp_ntz").cast("string"), 1, length)
