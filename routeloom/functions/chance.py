"""Random draws as functions of a row: the same for the same row, however it is partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws are whole numbers below this.
RANGE = 1 << 48


def drawn(*parts: Column | str | int) -> Column:
    """A whole number in [0, RANGE) from the MD5 of the parts, columns and seeds, joined by ':'."""
    texts = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 12), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1)."""
    return drawn(*parts) / float(RANGE)
