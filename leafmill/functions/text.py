"""String column helpers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.arrays import let

# The characters that count as white space.
WHITE = (
    " \t\n\u000b\u000c\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The predefined class is several times faster than the same set spelled out.
WHITE_RUN = r"(?U)\s+"
NOT_WHITE = f"[^{WHITE}]"


def strip(c: Column) -> Column:
    """Remove all Unicode white space at both ends (``trim`` alone only knows U+0020)."""
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space; the ends are clean."""
    return strip(F.regexp_replace(c, WHITE_RUN, " "))


def blank(c: Column) -> Column:
    """NULL, empty or white space only."""
    return F.coalesce(~c.rlike(NOT_WHITE), F.lit(True))


def none_if_blank(c: Column) -> Column:
    return F.when(~blank(c), c)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def capped(c: Column, limit: int, tail: str = "...") -> Column:
    """First ``limit`` characters plus ``tail`` when longer."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(tail))).otherwise(c)


def count_text(c: Column, piece: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def text_bool(c: Column) -> Column:
    """'true' in any case is true, everything else (NULL included) is false."""
    return F.coalesce(F.lower(strip(c)) == "true", F.lit(False))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def stem(path: Column) -> Column:
    """Base name without its last suffix."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def fixed_text(x: Column, digits: int) -> Column:
    """A double with ``digits`` decimals, its exact binary value rounded, exact halves to even.

    The fraction is a whole number of 2**-60 parts (finer parts decide nothing at up to 9
    decimals). Their product with 10**digits is taken in two halves of 30 bits, each within
    a long, so quotient and remainder are exact. Values of 2**53 and more have no fraction;
    from 9e18 on Spark's formatter takes over.
    """
    size = F.abs(x.cast("double"))
    whole = F.floor(size)
    parts = ((size - whole) * F.lit(float(1 << 60))).cast("bigint")
    low, unit = F.lit((1 << 30) - 1).cast("bigint"), F.lit(10**digits).cast("bigint")
    below = parts.bitwiseAND(low) * unit
    above = F.shiftright(parts, 30) * unit + F.shiftright(below, 30)
    down = F.shiftright(above, 30)
    rest = F.shiftleft(above.bitwiseAND(low), 30) + below.bitwiseAND(low)
    odd = (down if digits else whole).bitwiseAND(F.lit(1).cast("bigint"))
    # what is over half a unit carries, and the half itself where it stands after an odd digit
    total = down + F.shiftright(rest + F.lit((1 << 59) - 1).cast("bigint") + odd, 60)
    if digits:
        fraction = lambda t: F.concat(F.lit("."), F.lpad((t % unit).cast("string"), digits, "0"))
        shown = let(total, lambda t: F.concat((whole + F.call_function("div", t, unit)).cast("string"), fraction(t)))
    else:
        shown = (whole + total).cast("string")
    return F.when(size < 9e18, F.concat(F.when(x < 0, "-").otherwise(""), shown)).otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def grain(key: str, own: str) -> Column:
    """Inside a roll-up: ``own`` for rows of one key (a NULL key too), ``total`` for the row over all."""
    return F.when(F.grouping(key) == 0, F.lit(own)).otherwise(F.lit("total")).alias("grain")


def percent_text(part: Column, whole: Column) -> Column:
    """``12.34%``; ``0%`` where there is nothing to count."""
    return F.when(whole == 0, F.lit("0%")).otherwise(F.concat(fixed_text((part * F.lit(100.0)) / whole, 2), F.lit("%")))
