"""Lines packed into groups that go to the model together; their neighbours as context; numbered texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import LINE_BREAK
from quirelake.operators import ordered
from quirelake.session import cut


def segments(lines: DataFrame) -> DataFrame:
    """Adds segment, the number of the run of lines of a book that may be merged: same kind, no headings, and the same file, item and section where both are known."""
    known = [c for c in ("file_name", "item_id", "section_group") if c in lines.columns]
    rows = cut(lines.withColumns({"__block": ordered.block(), "__kind": F.coalesce(F.col("kind"), F.lit("body"))}))
    near = ordered.previous(rows, ["__kind", *known])
    apart = F.col("__first") | (F.col("__kind") != F.col("prev___kind")) | (F.col("__kind") == "heading")
    for c in known:
        apart = apart | F.coalesce(F.col(f"prev_{c}") != F.col(c), F.lit(False))
    summed = ordered.running(near.withColumn("__apart", apart.cast("int")), ["__apart"])
    return summed.select(*lines.columns, F.col("sum___apart").cast("int").alias("segment"))


def merge_groups(lines: DataFrame, most: int, size: Column | None = None) -> DataFrame:
    """Adds group_start, the first line of each line's group: greedily, a line joins the group before it if it is at most ``most``
    characters, the group stays within ``most``, and both are in one segment. Lines longer than ``most`` stand alone or open a group.

    Greedy packing is no prefix sum, so each segment is folded; cutting into segments first keeps the folds short and parallel.
    Null texts count no characters. ``size`` is what counts instead of characters, where it is given."""
    size = F.coalesce(F.length("text"), F.lit(0)) if size is None else size
    runs = segments(lines).groupBy("book_id", "segment").agg(F.array_sort(F.collect_list(F.struct("line_idx", size.alias("n")))).alias("run"))
    start = F.struct(F.lit(None).cast("int").alias("start"), F.lit(0).alias("chars"), F.array().cast("array<struct<line_idx:int,group_start:int>>").alias("done"))

    def step(acc, x):
        joins = acc["start"].isNotNull() & (x["n"] <= most) & (acc["chars"] + x["n"] <= most)
        first = F.when(joins, acc["start"]).otherwise(x["line_idx"])
        return F.struct(first.alias("start"), F.when(joins, acc["chars"] + x["n"]).otherwise(x["n"]).alias("chars"), F.concat(acc["done"], F.array(F.struct(x["line_idx"].alias("line_idx"), first.alias("group_start")))).alias("done"))

    return runs.select("book_id", F.inline(F.aggregate("run", start, step, lambda acc: acc["done"])))


def numbered(groups: DataFrame) -> DataFrame:
    """(book_id, group_start, lines, numbered): the texts of each group, numbered from 1."""
    rows = groups.groupBy("book_id", "group_start").agg(F.array_sort(F.collect_list(F.struct("line_idx", F.coalesce("text", F.lit("")).alias("text")))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"])), "\n")
    return rows.select("book_id", "group_start", F.size("rows").alias("lines"), text.alias("numbered"))


def parse_numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, value) of the numbered lines of a model's answer; the last line of a number holds, lines without a number are dropped."""
    lines = df.select(key, F.posexplode(F.split(text, LINE_BREAK)).alias("pos", "line"))
    pattern = r"^[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]*(?:\[?[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]*([0-9]+)[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]*\]?[\).:：、-]?)[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]*(.+?)[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]*$"
    found = lines.select(key, "pos", F.regexp_extract("line", pattern, 1).alias("n"), F.regexp_extract("line", pattern, 2).alias("value")).filter("n <> '' and value <> ''")
    return found.withColumn("number", F.expr("try_cast(n as bigint)")).filter("number >= 1").groupBy(key, "number").agg(F.max_by("value", "pos").alias("value"))


def context(lines: DataFrame, window: int) -> DataFrame:
    """(book_id, line_idx, context): up to ``window`` lines before and after each line, labelled by their distance."""
    return with_context(lines.select("book_id", "line_idx", "text"), window).drop("text")


def with_context(lines: DataFrame, window: int) -> DataFrame:
    """Lines with their context (``context``) as a column more: it is put together last, and never shuffled."""
    if window <= 0:
        return lines.withColumn("context", F.lit(""))
    rows = ordered.overlapping(cut(lines), window)
    before, after = sides(window)
    return rows.select(*lines.columns, "__ghost", F.concat_ws("\n", *before, *after).alias("context")).filter("not __ghost").drop("__ghost")


def sides(window: int) -> tuple[list[Column], list[Column]]:
    """The labelled lines before and after each line of ``ordered.overlapping`` parts, null where there is none."""
    w = Window.partitionBy("book_id", "__part").orderBy("line_idx")

    def near(step, label: str, k: int) -> Column:
        return F.when(step("line_idx", k).over(w).isNotNull(), F.concat(F.lit(label), step(F.coalesce("text", F.lit("")), k).over(w)))

    return [near(F.lag, f"Previous block -{k}: ", k) for k in range(window, 0, -1)], [near(F.lead, f"Next block +{k}: ", k) for k in range(1, window + 1)]


def batches(records: DataFrame, size: int) -> DataFrame:
    """Adds batch: records of like token_count together, ``size`` to a batch, so that little is padded. Batches are counted within a book."""
    ranked = ordered.ranks(records, "token_count", "group_start")
    return ranked.withColumn("batch", F.floor((F.col("__rank") - 1) / size).cast("int")).drop("__rank")
