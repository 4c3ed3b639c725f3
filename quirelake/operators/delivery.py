"""Records that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], by: str = "loaded_at", tie: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``by`` (nulls last), ties settled by the values of ``tie`` (default: all other
    sortable columns, greatest first). Rows whose key is null count as one key. An empty table gives an empty table; columns keep
    names and order. One shuffle on the keys; a key holds a handful of deliveries, so no task grows with a hot book."""
    ties = tie if tie is not None else [c for c, t in df.dtypes if c not in (*keys, by) and "map" not in t and t != "variant"]
    order = [F.col(f"`{by}`").desc_nulls_last(), *(F.col(f"`{c}`").desc_nulls_last() for c in ties)]
    mark = "__rank"
    while mark in df.columns:
        mark += "_"
    ranked = df.withColumn(mark, F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order)))
    return ranked.filter(F.col(mark) == 1).drop(mark)
