"""Column expressions: hash-derived numbers, phases, packed vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0
PI2 = 6.283185307179586


def text(*parts: Column | str | int) -> Column:
    """Parts joined by ``|``; strings name columns' values only as Columns."""
    out = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *out)


def uniform(s: Column) -> Column:
    """[0, 1) from the first 32 bits of md5."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("double") / F.lit(TWO32)


def gauss(s: Column) -> Column:
    """Standard normal by Box-Muller; 1 - u keeps the logarithm finite."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(F.concat(s, F.lit("a"))))) * F.cos(F.lit(PI2) * uniform(F.concat(s, F.lit("b"))))


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(x, lift(low)), lift(high))


def bucket(x: Column, low: float, high: float, n: int) -> Column:
    """Histogram bin 0 .. n-1, the last closed on the right; null outside."""
    b = F.least(F.floor((x - F.lit(low)) / F.lit((high - low) / n)), F.lit(n - 1)).cast("int")
    return F.when((x >= low) & (x <= high), b)


def spread_bits(x: Column) -> Column:
    """The low ten bits of x, two places apart (for Z-order keys)."""
    x = x.bitwiseAND(0x3FF)
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(mask)
    return x


def morton(x: Column, y: Column, z: Column) -> Column:
    """Z-order key of three ten-bit numbers."""
    a, b, c = (spread_bits(v.cast("long")) for v in (x, y, z))
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2))


def quantize(phase: Column, bits: int) -> Column:
    """Phase code, half to even."""
    return F.pmod(F.rint(phase / F.lit(PI2) * F.lit(float(1 << bits))), F.lit(float(1 << bits))).cast("int")


def dequantize(code: Column, bits: int) -> Column:
    return code.cast("double") * F.lit(PI2 / (1 << bits))


def check_bits(bits: int) -> int:
    if not 1 <= bits <= 16:
        raise ValueError("a width is from 1 to 16 bits")
    return bits
