"""Texts cut into chunks a model takes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where texts may be cut, strongest first.
SEPARATORS = ("\n", ". ", "? ", "! ", "; ", ", ", " ")
HALVING = ("\n\n", *SEPARATORS)


def chunks(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, cut after the last of the strongest separator that lies beyond a third, else at ``most``."""
    if most <= 0 or len(text) <= most:
        return [text]
    out, rest, least = [], text.strip(), most // 3
    while len(rest) > most:
        places = ((rest.rfind(s, 0, most), len(s.rstrip() or s)) for s in SEPARATORS)
        at, keep = next(((p, k) for p, k in places if p >= least), (most, 0))
        piece, rest = rest[: at + keep].strip(), rest[at + keep :].strip()
        if piece:
            out.append(piece)
    if rest:
        out.append(rest)
    return out or [text]


def halves(text: str, fits: Callable[[str], bool]) -> list[str]:
    """``text`` halved at the separator nearest its middle until every part fits; in order, without recursion. ValueError if a single character doesn't fit."""
    out, stack = [], [text.strip()]
    while stack:
        t = stack.pop()
        if not t or fits(t):
            out.append(t)
            continue
        middle, best = len(t) // 2, None
        for s in HALVING:
            p = t.find(s)
            while p >= 0:
                end = p + len(s)
                if best is None or abs(end - middle) < abs(best - middle):
                    best = end
                p = t.find(s, end)
        at = best if best is not None and 0 < best < len(t) else middle
        left, right = t[:at].strip(), t[at:].strip()
        if not left or not right:
            raise ValueError("the prompt's fixed parts exceed the token budget")
        stack += [right, left]
    return out


def budget_chunks(text: str, fits: Callable[[str], bool], most: int) -> list[str]:
    """The whole text if it fits, else its chunks, each halved until it fits."""
    return [text] if fits(text) else [p for c in chunks(text, most) for p in halves(c, fits)]


def chunks_column(c: Column | str, most: int) -> Column:
    """array<string> of the chunks; only texts above ``most`` go to Python. Null texts have none."""
    c = F.col(c) if isinstance(c, str) else c

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunks(t, most) if t is not None else None)

    long = F.length(c) > most
    return F.when(~long, F.array(c)).when(long, cut(F.when(long, c)))
