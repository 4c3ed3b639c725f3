"""Groups of lines to a translator and its answers back to lines: prompts within a token budget, and what is done where an answer is no use.

An answer to a group must hold each of its numbers; otherwise each line is asked for by itself, and what comes then is taken as it is. A
line too long for a prompt is asked for in chunks. A stored result is as good as a new one: lines that have one are not asked for."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.operators import chunking, cleaning, grouping, ordered
from quirelake.session import cut

SLOT = "\x00"  # stands in a prompt's frame for the text
# Fixed value: a numbered line of an answer.
NUMBERED_LINE = re.compile(r"^\s*(?:\[?\s*(\d+)\s*\]?[\).:：、-]?)\s*(.+?)\s*$")


class Tokenizer(Protocol):
    """Counts tokens. It is made on the executor, once a task."""

    def count(self, text: str) -> int: ...


class Quarter:
    """A deterministic counter for want of a tokenizer: a token for every four characters begun."""

    def count(self, text: str) -> int:
        return -(-len(text) // 4)


def estimated_tokens(c: Column) -> Column:
    """What ``Quarter`` counts, in the JVM; null texts have none."""
    return F.coalesce(F.ceil(F.length(c) / 4.0), F.lit(0)).cast("int")


def numbered(texts: list[str]) -> str:
    return "\n".join(f"[{i}] {t}" for i, t in enumerate(texts, 1))


def parsed(answer: str, expected: int) -> list[str] | None:
    """The texts of an answer's numbered lines, the last of a number holding; None unless every number from 1 to ``expected`` is there."""
    found = {int(m[1]): m[2] for line in answer.splitlines() if (m := NUMBERED_LINE.match(line))}
    texts = [found.get(k, "") for k in range(1, expected + 1)]
    return texts if all(texts) else None


def group_contexts(lines: DataFrame, groups: DataFrame, window: int) -> DataFrame:
    """(book_id, group_start, context): up to ``window`` lines before each group's first and after its last line, labelled by their distance."""
    rows = lines.select("book_id", "line_idx", "text").join(groups.select("book_id", "line_idx", "group_start"), ["book_id", "line_idx"], "left")
    edges = with_sides(rows, window).filter("group_start is not null")
    return edges.groupBy("book_id", "group_start").agg(context_of_sides().alias("context"))


def with_sides(lines: DataFrame, window: int) -> DataFrame:
    """Adds before to the first line of each group and after to its last: up to ``window`` lines, labelled by their distance; null elsewhere,
    so that little is carried on. Lines need group_start; a group's lines are neighbours."""
    if window <= 0:
        return lines.withColumns({"before": F.lit(None).cast("string"), "after": F.lit(None).cast("string")})
    rows = ordered.overlapping(cut(lines), window)
    before, after = grouping.sides(window)
    w = Window.partitionBy("book_id", "__part").orderBy("line_idx")
    first, last = (~step("group_start").over(w).eqNullSafe(F.col("group_start")) for step in (F.lag, F.lead))
    sides = rows.select(*lines.columns, "__ghost", F.when(first, F.concat_ws("\n", *before)).alias("before"), F.when(last, F.concat_ws("\n", *after)).alias("after"))
    return sides.filter("not __ghost").drop("__ghost")


def context_of_sides() -> Column:
    """The context of a group from the columns of ``with_sides``, to aggregate with."""
    b, a = F.max("before"), F.max("after")
    return F.concat_ws("\n", F.when(b != "", b), F.when(a != "", a))


def budget_groups(lines: DataFrame, budget: int, cost: Column | None = None) -> DataFrame:
    """(book_id, line_idx, group_start, over): lines grouped greedily while their tokens (``cost``, by default estimated, and four for each
    number) stay within ``budget``; over marks a line that is too long by itself and has to be asked for in chunks."""
    own = (estimated_tokens(F.col("text")) if cost is None else cost) + 4
    sized = lines.withColumn("cost", own)
    groups = grouping.merge_groups(sized, budget, size=F.col("cost"))
    return sized.select("book_id", "line_idx", "cost").join(groups, ["book_id", "line_idx"]).select("book_id", "line_idx", "group_start", (F.col("cost") > budget).alias("over"))


def resolve(records: DataFrame, make: Callable, budget: int, counter: Callable[[], Tokenizer] = Quarter, chunk: int = 3000) -> DataFrame:
    """(book_id, line_idx, text, asked) of every line of records (book_id, group_start, line_idxs, texts, frame, bare, max_new_tokens):
    ``make`` gives the translator (generate(prompts, max_new_tokens) -> answers), frame is the group's prompt with SLOT for the text, bare
    one without context and terms, for chunks that find no room beside these. asked tells how the line came out: 'group', 'single', 'raw'
    or 'chunks'. ValueError where not even a character fits. The stage is not deterministic in general: store its result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, tokens = make(), counter()

        def one(frame: str, texts: list[str], most: int) -> tuple[str, list[str] | None]:
            answer = model.generate([frame.replace(SLOT, numbered(texts))], most)[0]
            return answer, parsed(answer, len(texts))

        def single(frame: str, bare: str, text: str, most: int) -> tuple[str, str]:
            if tokens.count(frame.replace(SLOT, numbered([text]))) > budget:
                return long_line(frame, bare, text, most), "chunks"
            answer, got = one(frame, [text], most)
            return (got[0], "single") if got else (answer, "raw")

        def long_line(frame: str, bare: str, text: str, most: int) -> str:
            def fits(parts: list[str]) -> bool:
                return tokens.count(frame.replace(SLOT, numbered(parts))) <= budget

            out: list[str] = []
            held: list[str] = []
            if tokens.count(frame.replace(SLOT, "")) > budget // 2:  # context and terms leave no room
                frame = bare
            for part in [*chunking.budget_chunks(text, lambda t: fits([t]), chunk), None]:
                if held and (part is None or not fits([*held, part])):
                    answer, got = one(frame, held, most)
                    out += got or [y[0] if y else x for p in held for x, y in [one(frame, [p], most)]]
                    held = []
                if part is not None:
                    held.append(part)
            return " ".join(out)

        for batch in batches:
            rows = []
            for book, _, idxs, texts, frame, bare, most in batch.itertuples(index=False):
                texts, most = list(texts), int(most)
                whole = tokens.count(frame.replace(SLOT, numbered(texts))) <= budget
                got = one(frame, texts, most)[1] if whole and len(texts) > 1 else None
                results = [(t, "group") for t in got] if got else [single(frame, bare, t, most) for t in texts]
                rows += [(book, i, t, how) for i, (t, how) in zip(idxs, results)]
            yield pd.DataFrame(rows, columns=["book_id", "line_idx", "text", "asked"])

    columns = ["book_id", "group_start", "line_idxs", "texts", "frame", "bare", "max_new_tokens"]
    # hashed, not ranged: finding ranges would work the prompts out twice
    ordered = records.select(*columns).repartition("book_id", "group_start").sortWithinPartitions("max_new_tokens")
    got = ordered.mapInPandas(run, "book_id long, line_idx int, text string, asked string")
    return got.withColumn("text", cleaning.clean_output("text"))
