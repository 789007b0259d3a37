"""Column expressions whose results match the evaluation rules exactly: white space, lengths, rounding, random draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as white space (a superset of what Java's \s has).
WS = r"[\t\n\x0B\x0C\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
ASTRAL = r"[^\x{10000}-\x{10FFFF}]"


def squeeze(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, WS + "+", "")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def units(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(c) + F.length(F.regexp_replace(c, ASTRAL, ""))


def round_half_up(c: Column, digits: int) -> Column:
    """Half-way values go up, on the binary value: not Spark's round()."""
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for b = 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


_LOW = 0xFFFFFFFF


def _imul(x: Column, y: Column) -> Column:
    """The low 32 bits of a product of 32-bit numbers; halves keep it in 64 bits."""
    low = x.bitwiseAND(F.lit(0xFFFF)) * y
    high = F.shiftleft((F.shiftrightunsigned(x, 16) * y).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(_LOW))


def random_draw(seed: Column, ordinal: Column) -> Column:
    """Draw number `ordinal` (from 0) of a 32-bit seed, 0 to 1. The generator's state is a counter, so draws need no order."""
    t = (seed.cast("long") + (ordinal.cast("long") + 1) * F.lit(0x6D2B79F5)).bitwiseAND(F.lit(_LOW))
    t = _imul(t.bitwiseXOR(F.shiftrightunsigned(t, 15)), t.bitwiseOR(F.lit(1).cast("long")))
    mixed = (t + _imul(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(F.lit(_LOW))
    t = t.bitwiseXOR(mixed)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)).cast("double") / 4294967296.0


def draws(seed: int, n: int) -> list[float]:
    """The first n draws of a seed, on the driver."""
    out = []
    for k in range(1, n + 1):
        t = seed + k * 0x6D2B79F5 & _LOW
        t = (t ^ t >> 15) * (t | 1) & _LOW
        t ^= t + (t ^ t >> 7) * (t | 61) & _LOW
        out.append((t ^ t >> 14) / 4294967296)
    return out


def permutation(n: int, seed: int) -> list[int]:
    """The seeded order of n things: for i from the last down, a drawn place at or before i is swapped with i."""
    order = list(range(n))
    for i, r in zip(range(n - 1, 0, -1), draws(seed, n)):
        j = int(r * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def rater_seed(rater: Column) -> Column:
    return F.conv(F.left(F.sha2(F.concat_ws("\x1f", F.lit("rater"), rater), 256), F.lit(8)), 16, 10).cast("long")


def hashed(*parts: Column | str) -> Column:
    """SHA-256 over parts with a separator between; null parts count as empty, so that none is skipped."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.lit(p) if isinstance(p, str) else p, F.lit("")) for p in parts]), 256)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)
