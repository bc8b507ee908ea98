"""A bitmap of hashes as a constant of fixed size: a filter that is cheap to ship and never misses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap(hashes: DataFrame, bits: int) -> Column:
    """A constant with the bits of the column ``hash`` set; at most ``bits / 64`` longs reach the driver."""
    bucket = F.pmod("hash", F.lit(bits))
    mask = F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(hash, {bits}) % 64 AS INT))")).alias("mask")
    cells = np.zeros(bits // 64, np.int64)
    for r in hashes.groupBy((bucket / 64).cast("int").alias("cell")).agg(mask).collect():
        cells[r["cell"]] = r["mask"]
    # as one text: a literal array would cost a call to the JVM for every cell; Spark folds this to an array once
    return F.split(F.lit(",".join(map(str, cells.tolist()))), ",").cast("array<bigint>")


def is_set(cells: Column, h: Column, bits: int) -> Column:
    bucket = F.pmod(h, F.lit(bits))
    return F.getbit(F.get(cells, (bucket / 64).cast("int")), (bucket % 64).cast("int")) == 1
