"""Work that is already done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


CHUNK = 4_096  # lines hashed together


def fingerprint(lines: DataFrame) -> DataFrame:
    """(book_id, line_count, source_sha256): SHA-256 over the SHA-256 of each run of CHUNK line numbers, in order; each line is closed by a
    newline. Only a chunk's text is ever in one row, so a book may be of any size."""
    rows = F.array_sort(F.collect_list(F.struct("line_idx", F.coalesce("text", F.lit("")).alias("text"))))
    text = F.concat_ws("", F.transform(rows, lambda x: F.concat(x["text"], F.lit("\n"))))
    chunks = lines.groupBy("book_id", F.floor(F.col("line_idx") / CHUNK).alias("chunk")).agg(F.sha2(text, 256).alias("hash"), F.count("*").alias("n"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "hash"))), lambda x: x["hash"])
    return chunks.groupBy("book_id").agg(F.sum("n").cast("int").alias("line_count"), F.sha2(F.array_join(order, ""), 256).alias("source_sha256"))


def completed(records: DataFrame, lines: DataFrame) -> DataFrame:
    """(book_id, line_idx, text): the record written last of each existing line, if its text isn't empty. Empty and null texts are retried."""
    last = records.filter(F.col("index").isNotNull()).groupBy("book_id", "index").agg(F.max_by("text", F.struct("written_at", "text")).alias("text"))
    done = last.filter(F.length(F.trim("text")) > 0).select("book_id", F.col("index").alias("line_idx"), "text")
    return done.join(lines.select("book_id", "line_idx"), ["book_id", "line_idx"], "left_semi")


def missing(lines: DataFrame, done: DataFrame) -> DataFrame:
    """Lines without a result."""
    return lines.join(done.select("book_id", "line_idx"), ["book_id", "line_idx"], "left_anti")


def regroup(groups: DataFrame, done: DataFrame) -> DataFrame:
    """(book_id, line_idx, group_start) of the lines still to do: whole groups stay, groups done in part fall apart into single lines."""
    flag = done.select("book_id", "line_idx", F.lit(1).alias("ok"))
    marked = groups.join(flag, ["book_id", "line_idx"], "left")
    any_done = marked.groupBy("book_id", "group_start").agg(F.max("ok").alias("part"))
    left = marked.filter("ok is null").drop("ok").join(any_done, ["book_id", "group_start"])
    return left.select("book_id", "line_idx", F.when(F.col("part") == 1, F.col("line_idx")).otherwise(F.col("group_start")).alias("group_start"))


def line_check(units: DataFrame, lines: DataFrame) -> DataFrame:
    """(book_id, expected, found, complete): lines claimed by units against lines of the book."""
    want = units.groupBy("book_id").agg(F.sum("lines").cast("long").alias("expected"))
    have = lines.groupBy("book_id").agg(F.count("*").alias("found"))
    both = want.join(have, "book_id", "full")
    return both.select("book_id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found")).withColumn("complete", F.col("expected") == F.col("found"))
