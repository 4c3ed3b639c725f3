"""Problem 1: predictions that break off inside a word or sentence.

Method: for each source (system) and unit of length (characters, bytes, words) the discrete hazard of breaking off at a length, given
that it was reached, by window functions; each is tested against the hazards of neighbouring lengths, with false-discovery control
(Benjamini-Hochberg) within the source. The share of a length's breaks above what its neighbours lead one to expect is the prior odds
that an incomplete ending there is a truncation; at other lengths (transfers break off anywhere) the odds are even, or the system's
share of broken texts where the text needs no stop. The texts that broke off at significant lengths and a bounded sample of finished
ones teach what a missing end looks like: shares of the reference (or length) missing, the last word a part of one, last words that
finish sentences elsewhere. An incomplete ending is a truncation where prior and evidence together are more likely than not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.pairs import MISSING, RATIO, Pair, ending, finished, first_ref, ref_endings, scales, target, visible
from quirelake.llm.sampling import hash_share
from quirelake.operators.delivery import latest
from quirelake.session import cut, spread

NEIGHBOURS = 6  # lengths on either side
FALSE_DISCOVERY = 0.01
SOUND_PAIRS = 20_000  # bound (on average) of the sample of finished texts
PSEUDO = 10.0  # weight of what is assumed before anything is seen

VIEW = "chars int, bytes int, words int, ends boolean, needs boolean, broken boolean, by_ref int, by_original int, tail string"
UNSEEN = (0, 0, 0, True, True, False, -1, -1, None)


def view(p: Pair) -> tuple:
    """What the hazards and the evidence need of a pair, as VIEW."""
    by_ref, by_original = p.cells()
    needs = p.should_end
    slight = p.partial or p.missing >= 0.02 or p.added if p.has_ref else needs or p.ratio < 0.6
    broken = bool(p.words) and not p.ends and not p.other
    tail = " ".join(p.core.split()[-3:])
    size = len(p.core)
    return size, size if p.core.isascii() else len(p.core.encode("utf-8", "surrogatepass")), len(p.words), p.ends or not broken, needs, broken and slight, by_ref if not p.other else -1, by_original if not p.other else -1, tail


def viewed(pairs: DataFrame, look: Callable[..., Column], schema: str, plain_too: bool, *more: str) -> DataFrame:
    """pair_id, system, sampled, the fields of ``schema`` (VIEW first), ending and ref_endings of each pair as last delivered. ``look`` is a
    pandas UDF over path, language, original, prediction, reference and ``more``. Unless ``plain_too``, of the plainly finished texts it
    sees a sample of about SOUND_PAIRS and the JVM counts the rest. What is shuffled to settle deliveries are these small rows, not texts."""
    share = min(1.0, SOUND_PAIRS / max(1, pairs.count()))
    done, drawn = finished(F.col("pred")), hash_share("pair_id") < share
    asked = F.lit(True) if plain_too else ~done | drawn
    given = [F.when(asked, c) for c in (F.col("pred_path"), F.col("target_lang"), F.col("original_text"), F.col("pred"), first_ref(F.col("refs")), *map(F.col, more))]
    rows = spread(pairs.select("pair_id", "system", "pred_path", "target_lang", "original_text", "pred", "refs", "loaded_at", *more))
    native = {"chars": F.length("pred"), "bytes": F.octet_length("pred"), "words": F.regexp_count("pred", F.lit(r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]|[\p{L}\p{N}]+"))}
    counts = {} if plain_too else {f"n_{k}": F.when(~asked, c) for k, c in native.items()}
    last = F.when(done, ending(F.col("pred"))).alias("last")
    seen = rows.select("pair_id", "system", "loaded_at", F.xxhash64("pred").alias("tie"), drawn.alias("sampled"), *(c.alias(k) for k, c in counts.items()), last, ref_endings(F.col("refs")).alias("ref_endings"), look(*given).alias("v"))
    fields = [F.coalesce(f"n_{c}", F.col("v")[c]).alias(c) if f"n_{c}" in counts else F.col("v")[c].alias(c) for c in (x.split()[0] for x in schema.split(", ")) if c != "tail"]
    small = seen.select("pair_id", "system", "loaded_at", "tie", "sampled", *fields, F.coalesce("last", ending(F.col("v")["tail"])).alias("ending"), "ref_endings")
    return latest(small, ["pair_id"], tie=["tie"]).drop("loaded_at", "tie")


def looked_at(pairs: DataFrame) -> DataFrame:
    """What ``weighed`` takes. Null and unreadable predictions have no length and are never broken."""
    scale = pairs.sparkSession.sparkContext.broadcast(scales(pairs))

    @F.pandas_udf(VIEW)
    def look(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in VIEW.split(", ")]
        for batch in batches:
            rows = [view(Pair(o, t, r, scale.value.get(target(p, n), 1.0))) if visible(t) else UNSEEN for p, n, o, t, r in zip(*batch)]
            yield pd.DataFrame(rows, columns=columns)

    return viewed(pairs, look, VIEW, False)


def lengths(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.selectExpr(*columns, "stack(3, 'chars', chars, 'bytes', bytes, 'words', words) as (unit, length)")


def hazards(looked: DataFrame) -> DataFrame:
    """(system, unit, length, reached, broken, expected, p, significant) of every length at which a text of the system ends."""
    long = lengths(looked.filter("chars > 0"), "system", "broken")
    ended = long.groupBy("system", "unit", "length").agg(F.count("*").alias("ended"), F.count_if("broken").alias("broken"))
    own = Window.partitionBy("system", "unit").orderBy("length")
    reached = F.sum("ended").over(own.rowsBetween(0, Window.unboundedFollowing))
    risk = ended.withColumn("reached", reached)
    before, after = own.rangeBetween(-NEIGHBOURS, -1), own.rangeBetween(1, NEIGHBOURS)

    def around(c):
        return F.coalesce(F.sum(c).over(before), F.lit(0)) + F.coalesce(F.sum(c).over(after), F.lit(0))

    near = risk.withColumn("expected", (around("broken") + 0.5) / (around("reached") + 1.0))
    rate = F.col("broken") / F.col("reached")
    # Chernoff's bound of the binomial tail: exp(-n KL(rate, expected))
    rest = F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - F.col("expected")))).otherwise(0.0)
    bound = F.when((F.col("broken") > 0) & (rate > F.col("expected")), F.exp(-F.col("reached") * (rate * F.log(rate / F.col("expected")) + rest))).otherwise(1.0)
    tested = near.withColumn("p", bound)
    ranked = Window.partitionBy("system").orderBy("p", "unit", "length")
    steps = tested.withColumn("rank", F.row_number().over(ranked)).withColumn("tests", F.count("*").over(Window.partitionBy("system")))
    passed = F.max(F.when(F.col("p") <= F.col("rank") / F.col("tests") * FALSE_DISCOVERY, F.col("rank"))).over(Window.partitionBy("system"))
    return steps.withColumn("significant", F.coalesce(F.col("rank") <= passed, F.lit(False))).drop("rank", "tests", "ended")


# What is assumed of the cells before anything is seen, with the weight PSEUDO: breaks fall evenly over a text; finished texts miss little.
_WIDTHS = [b - a for a, b in zip((0.0, *MISSING), (*MISSING, 1.0))]
_CLOSE = (0.6, 0.1, 0.1, 0.07, 0.05, 0.04, 0.02, 0.02)
_SHORT = (0.3, 0.15, 0.15, 0.15, 0.1, 0.1, 0.05, 0.01, 0.005)
_FULL = (0.002, 0.005, 0.01, 0.06, 0.12, 0.2, 0.25, 0.2, 0.15)


def assumed(truncated: bool) -> dict[int, float]:
    out: dict[int, float] = {}
    for i, (t, c) in enumerate(zip(_WIDTHS, _CLOSE)):
        for tail in (0, 1):
            for part in (0, 1):
                lost = (0.5 if i == 0 else 0.97) if truncated else 0.1
                partly = 0.5 if truncated else 0.01
                out[i * 4 + tail * 2 + part] = (t if truncated else c) * (lost if tail else 1 - lost) * (partly if part else 1 - partly)
    for i in range(len(RATIO) + 1):
        out[100 + i] = out[120 + i] = (_SHORT if truncated else _FULL)[i]
    return out


class Evidence:
    """Log likelihood ratios of truncated against complete for each cell, learned from counts; (cut, cell) or (cut, known) -> n."""

    def __init__(self, cells: dict[tuple[bool, int], float], known: dict[tuple[bool, bool], float]):
        self.cell: dict[int, float] = {}
        share = {}
        for cut_off in (True, False):
            before = assumed(cut_off)
            for ids in ([k for k in before if k < 100], [k for k in before if 100 <= k < 120], [k for k in before if k >= 120]):
                total = sum(cells.get((cut_off, k), 0.0) for k in ids) + PSEUDO
                whole = sum(before[k] for k in ids)
                for k in ids:
                    share[cut_off, k] = (cells.get((cut_off, k), 0.0) + PSEUDO * before[k] / whole) / total
            yes, no = known.get((cut_off, True), 0.0), known.get((cut_off, False), 0.0)
            share[cut_off, "known"] = (yes + PSEUDO * (0.1 if cut_off else 0.8)) / (yes + no + PSEUDO)
        for k in assumed(True):
            self.cell[k] = math.log(share[True, k] / share[False, k])
        self.known = math.log(share[True, "known"] / share[False, "known"])
        self.unknown = math.log((1 - share[True, "known"]) / (1 - share[False, "known"]))


def weighed(looked: DataFrame) -> DataFrame:
    """``looked`` (VIEW rows, settled and stored) with prior, odds (log), at_limit and truncated."""
    marks = hazards(looked).filter("significant").select(F.col("system").alias("s"), "unit", "length", (1 - F.col("expected") * F.col("reached") / F.col("broken")).alias("above"))
    b = lengths(looked.filter("broken"), "pair_id", "system").alias("b")
    hit = b.join(marks.alias("l"), F.expr("b.system <=> l.s and b.unit = l.unit and b.length = l.length")).groupBy("pair_id").agg(F.max("above").alias("above"))
    # how often the same last words end finished texts (predictions and references) and stand at the end of unfinished ones
    stands = F.concat(F.array(F.struct("ending", "ends")), F.transform("ref_endings", lambda e: F.struct(e.alias("ending"), F.lit(True).alias("ends"))))
    words = looked.filter("ends or broken or size(ref_endings) > 0").select(F.inline(stands)).filter("ending is not null").groupBy("ending").agg(F.count_if("ends").alias("fin"), F.count_if(~F.col("ends")).alias("open"))
    asked = looked.filter("not ends or sampled").join(words, "ending", "left").join(hit, "pair_id", "left")
    own = F.coalesce(F.col("fin"), F.lit(0)) - F.when(F.col("ends"), 1).otherwise(0)
    known = (own > 0) & (own >= F.coalesce(F.col("open"), F.lit(0)))
    rows = cut(asked.select("pair_id", "system", "ends", "needs", "broken", "by_ref", "by_original", "chars", known.alias("known"), F.col("above")))
    evidence = learn(rows)
    llr = F.create_map(*[F.lit(x) for kv in evidence.cell.items() for x in kv])
    rate = looked.filter("chars > 0").groupBy(F.col("system").alias("s")).agg((F.count_if("broken") / F.count("*")).alias("rate"))
    open_rows = rows.filter("not ends").join(rate, F.expr("system <=> s"), "left").drop("s")
    even = F.when(F.col("needs"), 0.5).otherwise(F.least(F.greatest("rate", F.lit(0.001)), F.lit(0.5)))
    prior = F.greatest(even, F.least(F.coalesce("above", F.lit(0.0)), F.lit(0.99)))
    cell = F.when(F.col("by_ref") >= 0, F.col("by_ref")).otherwise(F.col("by_original"))
    last_words = F.when(F.col("known"), evidence.known).when(F.col("needs"), evidence.unknown).otherwise(0.0)  # headings end in no sentence's words
    odds = F.log(prior / (1 - prior)) + F.coalesce(F.try_element_at(llr, cell), F.lit(0.0)) + last_words
    judged = open_rows.select("pair_id", prior.alias("prior"), odds.alias("odds"), F.col("above").isNotNull().alias("at_limit"), (odds > 0).alias("truncated"))
    out = looked.drop("ending", "ref_endings").join(judged, "pair_id", "left")
    return out.withColumns({"truncated": F.coalesce("truncated", F.lit(False)), "at_limit": F.coalesce("at_limit", F.lit(False))})


def learn(rows: DataFrame) -> Evidence:
    """Evidence from the texts broken off at significant lengths (each counts as much as its length's share above expectation) and from
    finished texts. Both views of a text are counted. What comes to the driver is a row a cell."""
    two = rows.filter("(ends and chars > 0) or (broken and above is not null)").selectExpr("not ends as cut", "known", "coalesce(above, 1.0) as w", "stack(2, by_ref, by_original) as cell")
    counted = two.filter("cell >= 0").groupBy("cut", "cell", "known").agg(F.sum("w").alias("n")).collect()
    cells: dict[tuple[bool, int], float] = {}
    known: dict[tuple[bool, bool], float] = {}
    for r in counted:
        cells[r["cut"], r["cell"]] = cells.get((r["cut"], r["cell"]), 0.0) + r["n"]
        if r["cell"] >= 100:
            known[r["cut"], r["known"]] = known.get((r["cut"], r["known"]), 0.0) + r["n"]
    return Evidence(cells, known)


def truncated(pairs: DataFrame) -> DataFrame:
    """(pair_id, system, truncated, at_limit) of every pair, taken as last delivered. Null systems are one source."""
    return weighed(cut(looked_at(pairs))).select("pair_id", "system", "truncated", "at_limit")


def rates(pairs: DataFrame) -> DataFrame:
    """The share of truncated pairs of each system, and how many of them lie at lengths its hazards mark."""
    t = F.col("truncated").cast("int")
    marked = F.count_if(F.col("truncated") & F.col("at_limit"))
    return truncated(pairs).groupBy("system").agg(F.count("*").alias("pairs"), F.sum(t).alias("truncated"), marked.alias("at_limits"), (F.sum(t) / F.count("*")).alias("share"))
