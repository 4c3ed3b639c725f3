"""What depends on the order of a book's lines, worked out in blocks of line numbers: each block by itself, and what earlier blocks hand on
from one row a block. So a book is never one task, however large its share of all lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536  # line numbers


def block(line: Column | None = None) -> Column:
    return F.floor((F.col("line_idx") if line is None else line) / BLOCK)


def within(*keys: str):
    """The window of a block's lines in order; expects the column __block."""
    return Window.partitionBy("book_id", *keys, "__block").orderBy("line_idx")


def _handed(df: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``edges``, one row for each of its keys and blocks; null keys meet."""
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "__block")]
    carried = [F.col(f"r.{c}") for c in edges.columns if c not in (*keys, "__block")]
    return df.alias("l").join(edges.alias("r"), on, "left").select("l.*", *carried)


def previous(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds __first (no line of the book is before) and prev_<column> of each of ``columns`` to lines with __block."""
    w = within()
    last = df.groupBy("book_id", "__block").agg(F.max(F.struct("line_idx", *columns)).alias("row"))
    over = Window.partitionBy("book_id").orderBy("__block")
    edges = last.select("book_id", "__block", F.lag("row").over(over).alias("__row"))
    own = F.lag("line_idx").over(w)
    out = _handed(df, edges, ["book_id"]).withColumn("__own", own)
    at_edge = F.col("__own").isNull()
    values = {f"prev_{c}": F.when(at_edge, F.col("__row")[c]).otherwise(F.lag(c).over(w)) for c in columns}
    return out.select("*", *(v.alias(k) for k, v in values.items()), (at_edge & F.col("__row").isNull()).alias("__first")).drop("__row", "__own")


def running(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds sum_<column>, the sum up to and with each line, for number columns of lines with __block."""
    total = df.groupBy("book_id", "__block").agg(*(F.sum(c).alias(f"__t_{c}") for c in columns))
    before = Window.partitionBy("book_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    edges = total.select("book_id", "__block", *(F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in columns))
    w = within().rowsBetween(Window.unboundedPreceding, 0)
    out = _handed(df, edges, ["book_id"])
    return out.select("*", *((F.sum(c).over(w) + F.col(f"__b_{c}")).alias(f"sum_{c}") for c in columns)).drop(*(f"__b_{c}" for c in columns))


def last_seen(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Adds ``name``, the last value of ``column`` that isn't null among the lines of the same book and ``key`` up to and with each line."""
    kept = F.max(F.when(F.col(column).isNotNull(), F.struct("line_idx", F.col(column).alias("v"))))
    each = df.groupBy("book_id", key, "__block").agg(kept.alias("h"))
    before = Window.partitionBy("book_id", key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    edges = each.select("book_id", key, "__block", F.last(F.col("h.v"), ignorenulls=True).over(before).alias("__v"))
    own = F.last(column, ignorenulls=True).over(within(key).rowsBetween(Window.unboundedPreceding, 0))
    return _handed(df, edges, ["book_id", key]).withColumn(name, F.coalesce(own, "__v")).drop("__v")


def overlapping(df: DataFrame, margin: int) -> DataFrame:
    """Lines in parts of BLOCK lines each (column __part), with __ghost set on copies of the ``margin`` lines before and after a part, so
    that a window over (book_id, __part) sees every line's neighbours; drop the ghosts afterwards."""
    size = max(BLOCK, margin)
    counted = running(df.withColumns({"__block": block(), "__one": F.lit(1)}), ["__one"])
    at, place = F.floor((F.col("sum___one") - 1) / size), (F.col("sum___one") - 1) % size
    parts = F.filter(F.array(at, F.when(place < margin, at - 1), F.when(place >= size - margin, at + 1)), lambda x: x.isNotNull())
    spread = counted.withColumn("__home", at).withColumn("__part", F.explode(parts))
    return spread.withColumn("__ghost", F.col("__part") != F.col("__home")).drop("__block", "__one", "sum___one", "__home")


def ranks(df: DataFrame, by: str, then: str) -> DataFrame:
    """Adds __rank, each row's place (from 1) in its book by the number columns ``by`` and ``then``: places within a value of ``by`` and a block of
    ``then``, and the rows before these."""
    marked = df.withColumn("__block", block(F.col(then)))
    total = marked.groupBy("book_id", by, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("book_id").orderBy(by, "__block").rowsBetween(Window.unboundedPreceding, -1)
    edges = total.select("book_id", by, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("book_id", by, "__block").orderBy(then))
    return _handed(marked, edges, ["book_id", by]).withColumn("__rank", own + F.col("__before")).drop("__block", "__before")
