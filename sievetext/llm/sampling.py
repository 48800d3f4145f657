"""Bounded samples of tables that grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows looked at for each row wanted, where only some rows are usable.
OVERSAMPLE = 4


def hashed_share(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` * OVERSAMPLE rows of ``df``: those whose key hashes lowest.

    Cutting at a hash keeps what reaches the driver bounded however many partitions there
    are; a null key counts like any other.
    """
    total = df.count()
    share = min(1.0, OVERSAMPLE * rows / max(total, 1))
    return df if share == 1.0 else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
