"""Routing key of an entry: its trace id, else a 32-bit FNV-1a hash of its source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET_BASIS = 2166136261
FNV_PRIME = 16777619
FNV_MASK = 4294967295


def fnv1a_32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes of `text`, as an unsigned value in a bigint."""
    # Latin-1 turns every byte into exactly one character, whose code is the byte.
    chars = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    # Splitting '' gives [''], which would hash as one zero byte.
    byte_codes = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(
        byte_codes,
        F.lit(FNV_OFFSET_BASIS).cast("long"),
        lambda h, b: h.bitwiseXOR(b) * F.lit(FNV_PRIME).cast("long") % F.lit(FNV_MASK + 1).cast("long"),
    )


def routing_key(source: Column, trace_id: Column) -> Column:
    """`trace_id` when present and not empty, else the decimal hash of the source."""
    hashed = fnv1a_32(F.coalesce(source, F.lit(""))).cast("string")
    return F.when(F.coalesce(trace_id, F.lit("")) != "", trace_id).otherwise(hashed)
