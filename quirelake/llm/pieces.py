"""Problem 2: oversized texts cut at natural boundaries, with overlap.

Method: every position of a text gets a boundary strength; a sparse table of range maxima answers which cut is the strongest within
the lengths a piece may have, ties broken rightward; the next piece starts the overlap before the cut, again at the strongest
boundary around that place. The table is built over blocks of the text, so memory doesn't grow with very long texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.operators.delivery import latest

PARAGRAPH, LINE, SENTENCE, CLAUSE, PHRASE, WORD, LETTER, NONE = 7, 6, 5, 4, 3, 2, 1, 0
_CLOSE = r"[\"'”’»›」』）)\]】》]*"
_RULES = (  # weakest first; the strength holds for the position after the match
    (WORD, regex.compile(r"[\s​]+")),
    (PHRASE, regex.compile(rf"[,،、，]{_CLOSE}\s+|[、，]|\s[–—]\s+")),
    (CLAUSE, regex.compile(rf"[;:؛；：]{_CLOSE}(?:\s+|(?<=[；：]))|\p{{L}}{{1,3}}\.\s+")),
    (SENTENCE, regex.compile(rf"(?<![\s.]\p{{L}}{{1,3}})(?:[.!?…؟।॥]+{_CLOSE}\s+|[。！？｡]+{_CLOSE}\s*)")),
    (LINE, regex.compile(r"\s*[\n\r \x85]\s*")),
    (PARAGRAPH, regex.compile(r"\s*\n[ \t]*\n\s*|\s* \s*")),
)
_INSIDE = regex.compile(r"(?<=.)[\p{M}‍︎️\U0001f3fb-\U0001f3ff]|(?<=‍).|(?<=\r)\n", regex.S)
BLOCK = 1 << 16


def strengths(text: str) -> np.ndarray:
    """The strength of a cut before each character (and at the end)."""
    out = np.full(len(text) + 1, LETTER, np.int8)
    for m in _INSIDE.finditer(text):
        out[m.start()] = NONE
    for strength, pattern in _RULES:
        ends = [m.end() for m in pattern.finditer(text)]
        if ends:
            out[ends] = np.maximum(out[ends], strength)
    return out


class RangeMaximum:
    """Sparse table over ``values``: the place of the greatest value in [a, b], the rightmost of equal ones."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while 2 * width <= min(longest, len(values)):
            prev = self.levels[-1]
            left, right = prev[:-width], prev[width:]
            self.levels.append(np.where(values[left] > values[right], left, right))
            width *= 2

    def best(self, a: int, b: int) -> int:
        k = min((b - a + 1).bit_length() - 1, len(self.levels) - 1)
        i, j = int(self.levels[k][a]), int(self.levels[k][b - (1 << k) + 1])
        return i if self.values[i] > self.values[j] else j


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The (start, end) of the pieces of ``text``, none longer than ``limit``. A text within the limit is one piece; an empty one has
    none. Consecutive pieces share about ``overlap`` characters (between three quarters and one and a half times, less where pieces would not
    move on); nothing is left out."""
    if limit < 1 or overlap < 0 or overlap >= limit:
        raise ValueError("limit must be positive and overlap less than limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    out, start = [], 0
    base, table, values = 0, None, None
    least = max(1, limit // 2, min(2 * overlap, limit - max(1, limit // 8)))  # there are always lengths to choose from
    while True:
        if n - start <= limit:
            out.append((start, n))
            return out
        if table is None or start + limit > base + len(values) - 1:
            base = max(0, start - limit)
            values = strengths(text[base : start + BLOCK + limit])
            values[0] = LETTER
            table = RangeMaximum(values, limit + 1)
        end = base + table.best(start + least - base, start + limit - base)
        out.append((start, end))
        low, high = max(start + 1, end - overlap - overlap // 2), max(start + 1, end - overlap + overlap // 4)
        start = base + table.best(low - base, high - base) if overlap and low <= high else end


def split_units(units: DataFrame, limit: int, overlap: int, long_only: bool = False) -> DataFrame:
    """The pieces of every text of ``units``: its original_text where segments is null (segment_no 0), else the original_text of each
    segment (from 1). Returns unit_id, segment_no, piece_no (from 1), pieces, start_pos, end_pos, line (the piece's line within its
    unit, from 0; not with ``long_only``) and piece. ``long_only`` gives only the texts longer than ``limit``.

    Of several deliveries of a unit the last holds. Null and empty texts have no piece. Only texts above the limit go to Python."""

    def too_long(c):
        return F.length(c) > limit

    texts = F.when(F.col("segments").isNull(), F.array(F.struct(F.lit(0).alias("no"), F.col("original_text").alias("text")))).otherwise(
        F.transform("segments", lambda s, i: F.struct((i + 1).alias("no"), s["original_text"].alias("text")))
    )
    rows = units.select("unit_id", "loaded_at", texts.alias("texts"))
    if long_only:
        rows = rows.withColumn("texts", F.filter("texts", lambda x: too_long(x["text"])))
    once = latest(rows, ["unit_id"], tie=["texts"])
    each = once.select("unit_id", F.explode("texts").alias("x")).select("unit_id", F.col("x.no").alias("segment_no"), F.col("x.text").alias("text")).filter(F.length("text") > 0)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for unit, no, text in batch.itertuples(index=False):
                spans = cut(text, limit, overlap)
                rows += [(unit, no, k, len(spans), a, b, text[a:b]) for k, (a, b) in enumerate(spans, 1)]
            yield pd.DataFrame(rows, columns=["unit_id", "segment_no", "piece_no", "pieces", "start_pos", "end_pos", "piece"])

    schema = "unit_id long, segment_no int, piece_no int, pieces int, start_pos int, end_pos int, piece string"
    if long_only:
        return each.filter(too_long(F.col("text"))).mapInPandas(split, schema)
    parts = each.filter(too_long(F.col("text"))).mapInPandas(split, schema)
    one = each.filter(~too_long(F.col("text"))).select(
        "unit_id", "segment_no", F.lit(1).alias("piece_no"), F.lit(1).alias("pieces"), F.lit(0).alias("start_pos"), F.length("text").alias("end_pos"), F.col("text").alias("piece")
    )
    place = Window.partitionBy("unit_id").orderBy("segment_no", "piece_no")
    return parts.unionByName(one).withColumn("line", F.row_number().over(place) - 1)
