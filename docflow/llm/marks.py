"""Rows that may have an id of a list, found without shuffling the rows.

The list becomes a bitmap of hashed ids of bounded size, which is sent to all tasks. A row whose bit is not set is not in the list; the
few others are left for an exact join. A list too long for the bitmap marks more rows, which costs time only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each id, and the limits of a bitmap (8 MB at most). Spark's bitmaps come in blocks of the least size.
BITS, LEAST, MOST = 32, 1 << 15, 1 << 26


def with_mark(rows: DataFrame, id_col: str, ids: DataFrame, name="maybe") -> DataFrame:
    """The rows with a boolean ``name``: false only if the id is null or not among ``ids``, a written table of one column of the same type."""
    bits = LEAST
    while bits < min(MOST, BITS * ids.count()):
        bits *= 2
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    listed = ids.select(spot(ids.columns[0]).alias("spot"))
    blocks = listed.groupBy(F.bitmap_bucket_number("spot").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("_bits"))
    block = F.when(F.col(id_col).isNotNull(), F.bitmap_bucket_number(spot(id_col)))
    at = F.bitmap_bit_position(spot(id_col)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    return rows.join(F.broadcast(blocks), block == F.col("_block"), "left").select(*[F.col(f"`{c}`") for c in rows.columns], marked.alias(name))
