"""Bloom filters over long keys, in DataFrame functions only: bitmaps of 4 KB that are built by partial
aggregation, broadcast, and looked up by chunk.

A filter has at most `most` bits (32 MB by default), so it may be broadcast whatever the tables. Beyond
its capacity of one key in sixteen bits more rows pass it; what follows is exact in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

CHUNK_BITS = 32768  # what one bitmap of bitmap_construct_agg holds
BITS_A_KEY, MIN_BITS, MAX_BITS = 16, 2**18, 2**28


def bits_for(keys: int, most: int = MAX_BITS) -> int:
    """Bits of a filter: about 16 a key, a power of two, within fixed bounds."""
    return max(min(MIN_BITS, most), min(most, 1 << max(1, BITS_A_KEY * keys - 1).bit_length()))


def _slots(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits).cast("long")) for seed in (1, 2)]


def build(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """(chunk, bits): the filter of the keys."""
    slots = keys.select(F.explode(F.array(*_slots(F.col(column), bits))).alias("slot"))
    return slots.groupBy(F.expr(f"slot div {CHUNK_BITS}").alias("chunk")).agg(F.expr(f"bitmap_construct_agg(slot % {CHUNK_BITS})").alias("bits"))


def tested(df: DataFrame, column: str, bloom: DataFrame, bits: int, flag: str) -> DataFrame:
    """df with a boolean: the filter may hold the row's key. The filter has at most bits / CHUNK_BITS rows of 4 KB."""
    out = []
    for i, slot in enumerate(_slots(F.col(column), bits)):
        p, c, b = (free_name(df.columns, f"{x}{i}") for x in ("_slot", "_chunk", "_bits"))
        side = F.broadcast(bloom.select(F.col("chunk").alias(c), F.col("bits").alias(b)))
        df = df.withColumn(p, slot).join(side, F.expr(f"`{p}` div {CHUNK_BITS}") == F.col(c), "left")
        byte = f"substring(`{b}`, cast((`{p}` % {CHUNK_BITS}) div 8 + 1 as int), 1)"
        out.append((p, c, b, F.expr(f"coalesce(bit_get(cast(conv(hex({byte}), 16, 10) as bigint), cast(`{p}` % 8 as int)), 0) = 1")))
    df = df.withColumn(flag, out[0][3] & out[1][3])
    return df.drop(*(x for t in out for x in t[:3]))


def split(df: DataFrame, column: str, keys: DataFrame, most: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is not among the keys, all others): the former need no join. keys (a stored table) has the column."""
    bits = bits_for(keys.count(), most)
    bloom = cut(build(keys, column, bits), "bloom")
    flag = free_name(df.columns, "_maybe")
    marked = tested(df, column, bloom, bits, flag)
    return marked.where(~F.col(flag)).drop(flag), marked.where(F.col(flag)).drop(flag)
