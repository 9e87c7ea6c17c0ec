"""Stable identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the 64-bit FNV-1a parameters in 32-bit halves ---------------
OFFSET_HIGH = 0xCBF29CE4
OFFSET_LOW = 0x84222325
PRIME_LOW = 0x1B3  # the prime is 2**40 + 0x1B3
# ------------------------------------------------------------------------------


def source_key(name: Column, url: Column) -> Column:
    """The identity a source merges on."""
    return F.concat(F.trim(name), F.lit("|"), F.trim(url))


def source_id(name: Column, url: Column) -> Column:
    """The first 16 hex digits of the key's SHA-256."""
    return F.substring(F.sha2(source_key(name, url), 256), 1, 16)


def highlight_id(url: Column, text: Column) -> Column:
    """``h`` and the FNV-1a 64 of url, NUL, passage.

    The state is kept in two 32-bit halves so that no step leaves BIGINT range,
    which ANSI mode would refuse.
    """
    data = F.concat(F.encode(url, "UTF-8"), F.lit(b"\x00"), F.encode(text, "UTF-8"))
    # One character per byte, so that each is one number away.
    octets = F.split(F.decode(data, "ISO-8859-1"), "")
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    start = F.struct(F.lit(OFFSET_HIGH).cast("bigint").alias("hi"), F.lit(OFFSET_LOW).cast("bigint").alias("lo"))

    def step(acc: Column, octet: Column) -> Column:
        lo = acc["lo"].bitwiseXOR(F.ascii(octet).cast("bigint"))
        low = lo * PRIME_LOW
        high = acc["hi"] * PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(lo, 8)
        return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    def finish(acc: Column) -> Column:
        return F.concat(F.lit("h"), F.lower(F.lpad(F.hex(acc["hi"]), 8, "0")), F.lower(F.lpad(F.hex(acc["lo"]), 8, "0")))

    return F.aggregate(octets, start, step, finish)
