"""FITS headers as columns: cards, values and what they declare, all in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CARD = 80
# fixed values of the format and of the size guard
BITPIX = (8, 16, 32, 64, -32, -64)
MAX_DIM, MAX_BYTES = 100_000, 2 << 30
PATTERN_KEYS = ("BAYERPAT", "BAYRPAT", "COLORTYP", "CFAPAT")
PATTERNS = ("RGGB", "BGGR", "GRBG", "GBRG")
WCS_KEYS = ("CTYPE1", "CTYPE2", "CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2")


def header_values(header: Column) -> Column:
    """A map of the cards that carry values, up to END; of repeated keys the last counts."""
    n = F.floor(F.length(header) / CARD).cast("int")
    whole = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(header, i * CARD + 1, F.lit(CARD)))).otherwise(F.array().cast("array<string>"))
    end = F.array_position(F.transform(whole, lambda c: F.rtrim(F.substring(c, 1, 8))), "END").cast("int")
    cards = F.filter(F.when(end > 0, F.slice(whole, F.lit(1), end - 1)).otherwise(whole), lambda c: F.instr(F.substring(c, 1, 10), "=") > 0)
    text = lambda c: F.trim(F.regexp_replace(F.trim(F.substring_index(F.substring(c, F.instr(c, "=") + 1, F.lit(CARD)), "/", 1)), "^'|'$", ""))
    pairs = F.transform(cards, lambda c: F.struct(F.trim(F.substring(c, 1, 8)).alias("key"), text(c).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def colour_pattern(values: Column) -> Column:
    """The first known mosaic pattern among the usual keys, else RGGB."""
    named = [F.upper(F.trim(values[k])) for k in PATTERN_KEYS]
    return F.coalesce(*(F.when(v.isin(*PATTERNS), v) for v in named), F.lit("RGGB"))


def has_wcs(values: Column) -> Column:
    return F.forall(F.array(*map(F.lit, WCS_KEYS)), lambda k: F.map_contains_key(values, k))


def declared_bytes(values: Column) -> Column:
    """Bytes of the declared image (0 if an axis is not positive); null if the guard refuses it.

    Compressed images declare their real size in keys that begin with Z.
    """
    packed = F.coalesce(F.startswith(values["ZIMAGE"], F.lit("T")), F.lit(False)) | (F.coalesce(values["XTENSION"] == "BINTABLE", F.lit(False)) & F.map_contains_key(values, F.lit("ZNAXIS")))
    either = lambda k: F.when(packed, values[f"Z{k}"]).otherwise(values[k]).try_cast("long")
    naxis, bits = F.coalesce(either("NAXIS"), F.lit(0)), F.coalesce(either("BITPIX"), F.lit(8))
    axes = F.slice(F.array(*(F.coalesce(either(f"NAXIS{i}"), F.lit(0)) for i in range(1, 5))), F.lit(1), F.greatest(F.least(naxis, F.lit(4)), F.lit(0)).cast("int"))
    size = F.aggregate(axes, F.lit(1.0), lambda a, d: a * d) * F.abs(bits) / 8
    fine = naxis.between(0, 4) & bits.isin(*BITPIX) & F.forall(axes, lambda d: d <= MAX_DIM)
    size = F.when((naxis == 0) | F.exists(axes, lambda d: d <= 0), F.lit(0.0)).otherwise(size)
    return F.when(fine & (size <= MAX_BYTES), size.cast("long"))
