"""Corpus metrics of translations. Prediction and references stand in one row, so each row is measured by itself, in one Arrow pass over
its tokens, and only numbers are summed up by system: no n-gram is shuffled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import normalize_text

ORDERS = (1, 2, 3, 4)
SHIFT_SIZE, SHIFT_DISTANCE = 10, 50  # of TER, as the metric is defined


def words(c: Column) -> Column:
    """Words, and single marks and CJK characters, of the lower-cased text."""
    spaced = F.regexp_replace(F.lower(c), r"([^\p{L}\p{N}_ ]|[\x{3040}-\x{30ff}\x{3400}-\x{9fff}])", " $1 ")
    return F.filter(F.split(normalize_text(spaced), " "), lambda w: w != "")


def words_13a(c: Column) -> Column:
    """The tokens of mteval-v13a: marks and symbols stand alone, stops and commas unless between digits, dashes after digits; case is kept."""
    t = F.regexp_replace(F.regexp_replace(c, "<skipped>", ""), "-\n", "")
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    for name, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pattern, new in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        t = F.regexp_replace(t, pattern, new)
    return F.filter(F.split(normalize_text(t), " "), lambda w: w != "")


def scored(pairs: DataFrame, tokens=words) -> DataFrame:
    """(system, id, p, refs): the tokens of the prediction and of each reference that isn't empty. Rows without prediction or reference are left out."""
    rows = pairs.select("system", "id", "pred", F.filter("refs", lambda r: F.length(r) > 0).alias("refs")).filter(F.col("pred").isNotNull() & (F.size("refs") > 0))
    return rows.select("system", "id", tokens(F.col("pred")).alias("p"), F.transform("refs", tokens).alias("refs"))


def grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*(tokens[i:] for i in range(n))))


def _measured(rows: DataFrame, schema: str, measure) -> DataFrame:
    """system and what ``measure(p, refs)`` gives for each row."""
    columns = ["system", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(s, *measure(list(p), [list(r) for r in refs])) for s, p, refs in zip(batch["system"], batch["p"], batch["refs"])], columns=columns)

    return rows.select("system", "p", "refs").mapInPandas(run, f"system string, {schema}")


def bleu(pairs: DataFrame, tokens=words, smooth: bool = False) -> DataFrame:
    """(system, bleu, pairs) over (system, id, pred, refs): n-gram matches up to 4, each clipped by the reference that has it most often,
    corpus sums, brevity penalty against the references closest in length. An order without a match makes it 0, or with ``smooth`` counts
    a half, a quarter, ... of a match."""

    def measure(p: list[str], refs: list[list[str]]) -> tuple:
        out = [len(p), min((abs(len(r) - len(p)), len(r)) for r in refs)[1]]
        for n in ORDERS:
            most: Counter = Counter()
            for r in refs:
                most |= grams(r, n)
            own = grams(p, n)
            out += [sum((own & most).values()), max(0, len(p) - n + 1)]
        return tuple(out)

    schema = "pl long, rl long, " + ", ".join(f"m{n} long, t{n} long" for n in ORDERS)
    sums = _measured(scored(pairs, tokens), schema, measure).groupBy("system").agg(F.count("*").alias("pairs"), *(F.sum(c).alias(c) for c in ["pl", "rl", *(f"{k}{n}" for n in ORDERS for k in "mt")]))
    log, missed = F.lit(0.0), F.lit(0)
    for n in ORDERS:
        m, t = F.col(f"m{n}"), F.col(f"t{n}")
        missed = missed + F.when(m == 0, 1).otherwise(0)
        part = F.when(m > 0, m).otherwise(F.pow(F.lit(2.0), -missed)) if smooth else m
        log = log + F.when(t > 0, F.log(part / t)) / len(ORDERS)
    penalty = F.when(F.col("pl") >= F.col("rl"), 0.0).otherwise(1 - F.col("rl") / F.col("pl"))
    return sums.select("system", F.coalesce(F.exp(log + penalty), F.lit(0.0)).alias("bleu"), "pairs")


def rouge(pairs: DataFrame, n: int) -> DataFrame:
    """(system, rouge): mean F of n-gram overlap of each pair, with its best reference."""

    def measure(p: list[str], refs: list[list[str]]) -> tuple:
        own = grams(p, n)
        best = 0.0
        for r in refs:
            other = grams(r, n)
            size = sum(own.values()) + sum(other.values())
            best = max(best, 2 * sum((own & other).values()) / size if size else 0.0)
        return (best,)

    return _measured(scored(pairs), "f double", measure).groupBy("system").agg(F.avg("f").alias("rouge"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit a word of ``b``."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def distance(a: list[str], at: dict[str, int], n: int, states: list[tuple[int, int, int]] | None = None, start: int = 0) -> int:
    """Word edits from ``a`` to a text of ``n`` words, each word's places in it given as bits of ``at`` (Myers' bit vectors). ``states`` takes
    up the state before each word; with ``start`` the search goes on from the state there."""
    if not n:
        return len(a)
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = states[start] if start else (full, 0, n)
    note = states is not None and not start
    for x in a[start:] if start else a:
        if note:
            states.append((up, down, score))
        eq = at.get(x, 0)
        d0 = ((((eq & up) + up) ^ up) | eq | down) & full
        hp, hn = (down | ~(d0 | up)) & full, up & d0
        score += bool(hp & top) - bool(hn & top)
        hp = (hp << 1 | 1) & full
        up, down = ((hn << 1) | ~(d0 | hp)) & full, hp & d0
    return score


def edits(a: list[str], b: list[str]) -> int:
    """Word edits from ``a`` to ``b``; a block that only moved costs one. The shift that lowers the distance most is made until none lowers
    it by more than it costs. A shift of n words saves at most 2n edits, and words that are missing can't be shifted in, so the search
    stops where nothing is left to gain; no longest block is left out. ``distance`` goes on from the states before the block that moves."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    n = len(b)
    least = max(len(a), n) - (Counter(a) & Counter(b)).total()
    shifts, now = 0, distance(a, at, n)
    while now - least > 1:
        places: dict[str, list[int]] = {}
        for j, y in enumerate(b):
            places.setdefault(y, []).append(j)
        blocks = []
        for i, x in enumerate(a):
            for j in places.get(x, ()):
                if i == j or abs(i - j) > SHIFT_DISTANCE or i and j and a[i - 1] == b[j - 1]:
                    continue  # in place already, too far, or inside a longer block
                size = 1
                while size < SHIFT_SIZE and i + size < len(a) and j + size < n and a[i + size] == b[j + size]:
                    size += 1
                blocks.append((-size, abs(i - j), i, j))
        states: list[tuple[int, int, int]] = []
        distance(a, at, n, states)
        best = None
        for size, _, i, j in sorted(blocks):
            if best is not None and now - best[0] >= min(-2 * size, now - least):
                break
            rest = a[:i] + a[i - size :]
            moved = rest[:j] + a[i : i - size] + rest[j:]
            d = distance(moved, at, n, states, min(i, j, len(a) - 1))
            if d + 1 < now and (best is None or d < best[0]):
                best = (d, moved)
        if best is None:
            break
        now, a, shifts = best[0], best[1], shifts + 1
    return now + shifts


def meteor(a: list[str], b: list[str]) -> float:
    """Exact-match METEOR (no stems, no synonyms)."""
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    chunks, last, hits = 0, -2, 0
    for w in a:
        free = places.get(w)
        if not free:
            last = -2
            continue
        j = free.pop(free.index(last + 1) if last + 1 in free else 0)
        hits += 1
        chunks += j != last + 1
        last = j
    if not hits:
        return 0.0
    p, r = hits / len(a), hits / len(b)
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / hits) ** 3)


def sentence_metrics(pairs: DataFrame) -> DataFrame:
    """(system, rouge_l, ter, meteor): ROUGE-L and METEOR are means over pairs, each with its best reference; TER is the edits to the
    nearest reference for each word of the references' mean length."""

    def measure(p: list[str], refs: list[list[str]]) -> tuple:
        rl = max(2 * lcs(p, r) / max(1, len(p) + len(r)) for r in refs)
        mt = max(meteor(p, r) if p and r else 0.0 for r in refs)
        return rl, min(edits(p, r) for r in refs), sum(map(len, refs)) / len(refs), mt

    got = _measured(scored(pairs), "rl double, e long, n double, mt double", measure)
    return got.groupBy("system").agg(F.avg("rl").alias("rouge_l"), (F.sum("e") / F.sum("n")).alias("ter"), F.avg("mt").alias("meteor"))
