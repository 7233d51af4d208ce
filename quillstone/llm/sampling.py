"""Seeded samples of a bounded number of rows, for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Parts of the hash range, and how many more rows than wanted are let through before the cut.
PARTS, MARGIN = 1 << 30, 1.3


def bounded_sample(rows: DataFrame, place: Column, total: int, size: int) -> list[Row]:
    """At most ``size`` of the ``total`` rows, those whose ``place`` (a 64-bit hash) is smallest within its range.

    Rows that cannot be among them are dropped where they are read, so what reaches the driver is about ``MARGIN`` times
    ``size`` rows however many tasks there are.
    """
    part = F.pmod(place, F.lit(PARTS))
    share = min(1.0, MARGIN * (size + 100) / max(total, 1))
    return rows.withColumn("_part", part).filter(F.col("_part") < int(share * PARTS)).orderBy("_part", *rows.columns).limit(size).drop("_part").collect()
