"""Bit-packed identifiers and metadata, and compact dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layout of combined ids and of document metadata (shift, mask), and of compact dates.
RANK_SHIFT, DOMAIN_SHIFT, ORDINAL_MASK, DOMAIN_MASK = 57, 26, (1 << 26) - 1, (1 << 31) - 1
METADATA = {"avg_sent_len": (56, 0x03), "rank": (48, 0xFF), "size": (40, 0xFF), "topology": (32, 0xFF), "year": (24, 0xFF), "sets": (16, 0x0F), "quality": (8, 0x0F), "flags": (0, 0xFF)}
YEAR_BASE, SIZE_STEP, DATE_BASE = 1996, 5, "1989-03-12"


def encode_id(rank: Column, domain: Column, ordinal: Column) -> Column:
    return F.shiftleft(rank.cast("long"), RANK_SHIFT).bitwiseOR(F.shiftleft(domain.cast("long"), DOMAIN_SHIFT)).bitwiseOR(ordinal.cast("long"))


def rank_bits(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(63), (score * 64).cast("int")))


def domain_of(doc_id: Column) -> Column:
    return F.shiftrightunsigned(doc_id, DOMAIN_SHIFT).bitwiseAND(F.lit(DOMAIN_MASK))


def ordinal_of(doc_id: Column) -> Column:
    return doc_id.bitwiseAND(F.lit(ORDINAL_MASK))


def without_rank(doc_id: Column) -> Column:
    return doc_id.bitwiseAND(F.lit((1 << RANK_SHIFT) - 1))


def encode_metadata(**fields: Column) -> Column:
    """Fields in their encoded units, each clamped to its mask."""
    out = F.lit(0).cast("long")
    for name, value in fields.items():
        shift, mask = METADATA[name]
        out = out.bitwiseOR(F.shiftleft(F.greatest(F.lit(0).cast("long"), F.least(F.lit(mask).cast("long"), value.cast("long"))), shift))
    return out


def field(metadata: Column, name: str) -> Column:
    shift, mask = METADATA[name]
    raw = F.shiftrightunsigned(metadata, shift).bitwiseAND(F.lit(mask).cast("long"))
    return {"year": raw + YEAR_BASE, "size": raw * SIZE_STEP}.get(name, raw)


def date_short(day: Column) -> Column:
    """Days since the base date, 1 to 32767; unknown dates are 0."""
    return F.coalesce(F.greatest(F.lit(1), F.least(F.lit(32767), F.datediff(day, F.lit(DATE_BASE).cast("date")))), F.lit(0))


def year_byte(year: Column) -> Column:
    return F.greatest(F.lit(0), year - YEAR_BASE)


def is_valid_year(year: Column) -> Column:
    return year.between(F.lit(1995), F.year(F.current_date()) + 1)


def feature_bits(flags: list[Column]) -> Column:
    out = F.lit(0)
    for i, on in enumerate(flags[:32]):
        out = out.bitwiseOR(F.when(on, F.lit(1 << i)).otherwise(F.lit(0)))
    return out


def has_feature(bits: Column, i: int) -> Column:
    return bits.bitwiseAND(F.lit(1 << i)) != 0


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
