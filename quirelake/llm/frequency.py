"""Problem 6: how often every distinct value or term occurs, and in how many records.

Method: a suffix array with common-prefix intervals. The suffixes of all values (of tokens, between a start and an end mark) are
range-sorted over the cluster; one pass over each partition closes the intervals of common prefixes, each of which is one n-gram. Its
occurrences are the suffixes in it; its records are the suffixes less the adjacencies within a record: a suffix whose predecessor of the
same record lies in the interval too counts for nothing. An interval from start mark to end mark is a whole value. Intervals at the
borders of a partition may go on in the next; their sums are added and their records told apart by name, so no hot n-gram needs a task
of its own.

A suffix carries at most ``depth`` tokens (the whole value only at its start), so the work is linear in the bytes of the values.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.session import cut

START, END, GAP = "\x02", "\x03", "\x01"
DEPTH = 16  # tokens of the longest n-gram
_NOBODY = -(1 << 63)  # the record of rows without one


def value_suffixes(tokens: list[str], depth: int) -> list[str]:
    """The suffixes of START tokens END, tokens parted by GAP: the first whole, the others at most ``depth`` tokens long."""
    marked = [*tokens, END]
    return [GAP.join([START, *marked]), *(GAP.join(marked[i : i + depth]) for i in range(len(tokens)))]


def intervals(rows: Iterator[tuple[str, int, tuple]]) -> Iterator[tuple[list[str], bool, int, list, list[int] | None]]:
    """Closes the common-prefix intervals of sorted (suffix, record, (sums..., least)) rows: (n-gram with its marks, whole value?, records,
    [sums..., least], names of the records where the interval touches a border of the rows, else None)."""
    stack: list[list] = []  # an open interval for each depth: records, [sums..., least]; on closing it adds itself to the one around it
    starts: list[int] = []  # the row each began at
    last: dict[int, int] = {}  # the row each record was seen at last
    before: list[str] = []

    def close(at_end: bool) -> Iterator[tuple[list[str], bool, int, list, list[int] | None]]:
        n = len(stack)
        records, sums = stack.pop()
        began = starts.pop()
        if stack:
            around = stack[-1]
            around[0] += records
            around[1] = sums[:] if around[1] is None else _add(around[1], sums)
        whole = before[0] == START and before[n - 1] == END
        if whole or before[0] != START and before[n - 1] != END:
            names = [r for r, i in last.items() if i >= began] if at_end or began == 0 else None
            yield before[:n], whole, records, sums, names

    for i, (suffix, record, measures) in enumerate(rows):
        own = suffix.split(GAP)
        common = 0
        for x, y in zip(before, own):
            if x != y:
                break
            common += 1
        while len(stack) > common:
            yield from close(False)
        while len(stack) < len(own):
            stack.append([0, None])
            starts.append(i)
        top = stack[-1]
        top[1] = list(measures) if top[1] is None else _add(top[1], measures)
        if record != _NOBODY:
            top[0] += 1
            if record in last and (shared := bisect_right(starts, last[record])):
                stack[shared - 1][0] -= 1  # the adjacency within the record
            last[record] = i
        before = own
    while stack:
        yield from close(True)


def _add(a: list, b: list | tuple) -> list:
    return [*(x + y for x, y in zip(a[:-1], b[:-1])), min(a[-1], b[-1])]


def term_counts(df: DataFrame, tokens: str, measures: list[str], named: str, record: str | None = None, depth: int = DEPTH) -> DataFrame:
    """Counts of all n-grams of ``tokens`` (array<string>) up to ``depth`` tokens, and of all whole values of any length.

    Returns ngram, n, whole, records (distinct ``record`` values, by default the ``named`` ones), occurrences, the sums of ``measures``
    over the occurrences and the least ``named``. Rows whose tokens are null or empty give nothing, null measures count 0, null records
    are none; tokens must not hold the characters 1 to 3. Equal suffixes of a record are added up before they are sorted, so a value
    held by a third of all rows is no more rows than records."""
    numbers = [f"m{i}" for i in range(len(measures))]
    columns = ["r", *numbers, "k"]
    plain = df.filter(F.size(tokens) > 0).select(
        F.col(tokens).alias("t"), F.coalesce(F.col(record or named).cast("long"), F.lit(_NOBODY)).alias("rec"), F.lit(1).cast("long").alias("r"), *(F.coalesce(F.col(m).cast("long"), F.lit(0)).alias(f"m{i}") for i, m in enumerate(measures)), F.col(named).cast("long").alias("k")
    )
    sums = [F.sum("r").alias("r"), *(F.sum(m).alias(m) for m in numbers), F.min("k").alias("k")]
    kinds = ", ".join(f"{c} long" for c in columns)

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, *rest) for t, *rest in batch.itertuples(index=False) for s in value_suffixes(list(t), depth)]
            yield pd.DataFrame(rows, columns=["s", "rec", *columns])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        names = ["ngram", "n", "whole", "border", "records", "rec", *columns]
        flow = ((s, rec, rest) for batch in batches for s, rec, *rest in batch.itertuples(index=False))
        none = [0] * (len(columns) - 1)
        for gram, whole, records, got, told in intervals(flow):
            text, n = GAP.join(gram[1:-1] if whole else gram), len(gram) - 2 * whole
            out.append((text, n, whole, told is not None, 0 if told is not None else records, None, *got))
            for rec in told or ():
                out.append((text, n, whole, True, 0, rec, *none, got[-1]))
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=names).astype({"rec": "Int64"})
                out = []
        yield pd.DataFrame(out, columns=names).astype({"rec": "Int64"})

    ordered = plain.mapInPandas(suffixes, f"s string, rec long, {kinds}").groupBy("s", "rec").agg(*sums).repartitionByRange("s", "rec").sortWithinPartitions("s", "rec")
    parts = cut(ordered.mapInPandas(scan, f"ngram string, n int, whole boolean, border boolean, records long, rec long, {kinds}"))
    named_once = parts.filter("border").groupBy("ngram", "n", "whole", "rec").agg(*sums)
    borders = named_once.groupBy("ngram", "n", "whole").agg(F.count("rec").alias("records"), *sums)
    every = parts.filter("not border").select("ngram", "n", "whole", "records", *columns).unionByName(borders)
    return every.select(F.translate("ngram", GAP, " ").alias("ngram"), "n", "whole", "records", F.col("r").alias("occurrences"), *(F.col(c).alias(m) for c, m in zip(numbers, measures)), F.col("k").alias(named))
