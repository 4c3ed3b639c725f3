"""Units of a book on its lines: what each line is, which section it is in, under which chapter heading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.operators import ordered
from quirelake.session import cut

# Hints of ids and classes, and tags, in the order they win.
HINTS = {
    "toc": ("nav", "toc", "contents", "table-of-contents"),
    "note": ("note", "notes", "footnote", "footnotes", "endnote", "endnotes"),
    "bibliography": ("bibliography", "biblio", "references", "reference", "works-cited", "workscited"),
    "index": ("index", "indices"),
}
HEADINGS, CELLS, CAPTIONS = ("h1", "h2", "h3", "h4", "h5", "h6"), ("td", "th"), ("caption", "figcaption")


def hint_kind(c):
    """Kind named by a hint text: a hint equal to one of its tokens, or a hyphenated hint anywhere."""
    low = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit("-"))
    tokens = F.split(low, "[^a-z0-9]+")
    out = F.lit(None).cast("string")
    for kind, hints in reversed(HINTS.items()):
        hit = F.arrays_overlap(tokens, F.array(*map(F.lit, hints)))
        for h in hints:
            if "-" in h:
                hit = hit | F.contains(low, F.lit(h))
        out = F.when(hit, kind).otherwise(out)
    return out


def infer_kind(item_hints, tag, block_hints):
    """Kind of a block: its item's hints, then its tag, then its own hints, else body."""
    by_tag = F.when(tag.isin(*HEADINGS), "heading").when(tag.isin(*CELLS), "table_cell").when(tag.isin(*CAPTIONS), "caption")
    return F.coalesce(hint_kind(item_hints), by_tag, hint_kind(block_hints), F.lit("body"))


def unit_lines(units: DataFrame) -> DataFrame:
    """One row a line of a unit: units with ``lines`` rows cover [line, line + lines); null or non-positive ``lines`` cover one."""
    n = F.greatest(F.coalesce(F.col("lines"), F.lit(1)), F.lit(1))
    return units.filter(F.col("line").isNotNull()).withColumn("line_idx", F.explode(F.sequence("line", F.col("line") + n - 1)))


def sections(lines: DataFrame) -> DataFrame:
    """Adds section_group, chapter_heading and book_title to lines (book_id, line_idx, item_id, kind, text).

    section_group rises by one at each new item and after each heading; metadata lines have 0. chapter_heading is the last non-empty
    heading of the item so far, the heading's own row included. book_title is the first non-empty opf_title. Worked out in blocks of
    lines (``ordered``); the lines are stored once, as each block's edge is read from them."""
    filled = F.coalesce(F.col("text"), F.lit("")) != ""
    rows = ordered.previous(cut(lines.withColumn("__block", ordered.block())), ["item_id"])
    starts = F.col("item_id").isNotNull() & (F.col("__first") | ~F.col("item_id").eqNullSafe(F.col("prev_item_id")))
    marked = rows.withColumns({"__starts": starts.cast("int"), "__heads": F.coalesce(F.col("kind") == "heading", F.lit(False)).cast("int")}).drop("prev_item_id", "__first")
    summed = ordered.running(marked, ["__starts", "__heads"])
    headed = ordered.last_seen(summed.withColumn("__head", F.when((F.col("__heads") == 1) & filled, F.col("text"))), "item_id", "__head", "__heading")
    titles = lines.filter((F.col("kind") == "opf_title") & filled).groupBy("book_id").agg(F.min_by("text", "line_idx").alias("book_title"))
    known, group = F.col("item_id").isNotNull(), F.col("sum___heads") - F.col("__heads") + F.col("sum___starts")
    placed = headed.withColumns({"section_group": F.when(known, group).otherwise(0).cast("int"), "chapter_heading": F.when(known, F.col("__heading"))})
    return placed.join(titles, "book_id", "left").select(*lines.columns, "section_group", "chapter_heading", "book_title")
