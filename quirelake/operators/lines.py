"""Texts as ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEWLINE = r"\r\n|\r|\n"


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_idx, text) of every line; universal newlines; a closing newline ends the last line. Null texts have no lines, empty ones none either."""
    parts = F.split(F.col(text), NEWLINE)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return df.filter(F.col(text).isNotNull()).select(F.col(key), F.posexplode(whole).alias("line_idx", "text"))


def read_lines(spark: SparkSession, path: str, extension: str = "") -> DataFrame:
    """(path, line_idx, text) of the text files in a folder (or of one file)."""
    reader = spark.read
    if extension:
        reader = reader.option("pathGlobFilter", f"*.{extension}")
    files = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return text_lines(files, "path", "value")


def write_lines(df: DataFrame, path: str, order: str = "line_idx", text: str = "text") -> None:
    """One line a row, in order, in one file; streams through the driver's iterator without holding the table."""
    from quirelake.functions.text import encode_string

    with open(path, "w", encoding="utf-8", newline="\n") as f:
        for row in df.orderBy(order).select(encode_string(F.coalesce(F.col(text), F.lit(""))).alias("t")).toLocalIterator():
            f.write(row.t + "\n")


def parallel(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Lines of two files side by side (line_idx, pred, refs); they must have equally many lines."""
    a, b = pred.count(), gold.count()
    if a != b:
        raise ValueError(f"prediction has {a} lines, reference {b}")
    left = pred.select(F.col("line_idx").alias("i"), F.trim("text").alias("pred"))
    right = gold.select(F.col("line_idx").alias("j"), F.array(F.trim("text")).alias("refs"))
    return left.join(right, F.col("i") == F.col("j")).select(F.col("i").alias("line_idx"), "pred", "refs")
