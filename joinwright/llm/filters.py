"""Membership filters of bounded size, built and tested with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and bits of the largest filter (16 MB). Beyond that more rows pass; none is lost.
BITS_A_KEY, MOST_BITS, CHUNK = 16, 1 << 27, 32768


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def build_filter(keys: DataFrame, column: str, count: int) -> tuple[DataFrame, int]:
    """(chunk, bitmap) rows of 4 KB, and the filter's bits: at most MOST_BITS, whatever ``count`` is."""
    bits = min(MOST_BITS, max(1, -(-count * BITS_A_KEY // CHUNK)) * CHUNK)
    slot = _slot(F.col(column), bits)
    chunks = keys.groupBy(F.bitmap_bucket_number(slot).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))
    return chunks, bits


def maybe_in(rows: DataFrame, key: Column, chunks: DataFrame, bits: int) -> DataFrame:
    """``rows`` with the boolean ``maybe``: false only for keys that the filter doesn't hold."""
    rows = rows.withColumn("_slot", _slot(key, bits)).withColumn("chunk", F.bitmap_bucket_number("_slot"))
    place = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(chunks), "chunk", "left").withColumn("maybe", bit).drop("chunk", "_slot", "bitmap")
