"""Bounded samples of labelled rows, chosen by a hash so that every run and every size of table takes the same kind of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

_UNIT = 1 << 53


def hash_share(*keys: str) -> Column:
    """A number in [0, 1) from the keys, in steps of 2^-53: fine enough for any number of rows."""
    return F.xxhash64(*keys).bitwiseAND(F.lit(_UNIT - 1)) / F.lit(float(_UNIT))


def sample(df: DataFrame, keys: list[str], rows: int) -> list[Row]:
    """At most ``rows`` rows of ``df``, those whose keys hash lowest. The cluster passes on about twice as many (never more than sixteen
    times), so the driver's part is bounded whatever the table holds. An empty table gives none; a table of more rows than ``rows``
    that gives none is an error, never an untrained model."""
    total = df.count()
    share = min(1.0, 2.0 * rows / max(1, total))
    got = df.withColumn("__share", hash_share(*keys)).filter(F.col("__share") < share).limit(16 * rows).collect()
    if not got and total > rows:
        raise RuntimeError(f"no row of {total} was sampled: the keys {keys} hash to one value")
    got.sort(key=lambda r: (r["__share"], str(r)))
    return got[:rows]
