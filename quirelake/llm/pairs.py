"""What problems 1 and 5 look at in a pair: endings, coverage of the reference, likeness to the original, language."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.canonical import INVISIBLE

_CJK = "぀-ヿ㐀-鿿豈-﫿"
_DROP = re.compile(f"[{INVISIBLE}]+")
_TOKEN = re.compile(rf"[{_CJK}]|(?:(?![{_CJK}])[^\W_])+")
_STOPS = ".!?。！？।؟"
_CLOSERS = "\"'”’“»›」』）)"
_ENDS = re.compile(rf"[{_STOPS}]\s*[{_CLOSERS}]*\Z|[{_CLOSERS}]\s*[{_STOPS}]\Z")
_ADDED = re.compile(r"(?:\s|…|\.\.\.+|\s*[\(\[（【<{][^()\[\]<>{}]{0,24}[\)\]）】>}])+\Z")
_ABBREVIATION = re.compile(r"(?:^|[\s(«“„(])(?:[^\W\d_]{1,2}|Mr|Dr|Mrs|Hr|Sra?|Mme|bzw|vgl|approx|vol|etc|cf|pág|ej)\.\Z")
# In the JVM: ends that are sure to be a sentence's, with nothing added after them (Python's rules then say the same).
_FINISHED = r"""(?:[\p{L}\p{N}]{4,}(?<!approx)[.!?]|[。！？।؟])["'”’“»›」』]*\s*\z"""
_JAVA_TOKEN = rf"[{_CJK}]|[\p{{L}}\p{{N}}&&[^{_CJK}]]+"

MISSING = (0.005, 0.02, 0.05, 0.1, 0.18, 0.3, 0.5)  # borders of the share of the reference that is missing
SHORT = 40  # characters; the lengths of shorter texts say little
RATIO = (0.3, 0.45, 0.6, 0.75, 0.85, 0.95, 1.05, 1.2)  # borders of the length against the expected one


def tokens(text: str) -> list[str]:
    if not text.isascii():
        text = _DROP.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    return _TOKEN.findall(text.casefold())


def visible(text: str | None) -> bool:
    """Whether there is anything to read: a letter or a digit."""
    return bool(text) and any(map(str.isalnum, text))


def core(pred: str) -> tuple[str, bool]:
    """``pred`` without what was added after its end, and whether dots or a note were."""
    flat = (pred if pred.isascii() else _DROP.sub("", pred)).rstrip()
    cut = _ADDED.sub("", flat)
    return (cut, len(cut) < len(flat)) if visible(cut) else (flat, False)


def stopped(text: str) -> bool:
    """Whether the text ends as sentences do."""
    return bool(_ENDS.search(text, max(0, len(text) - 40))) and not _ABBREVIATION.search(text, max(0, len(text) - 40))


def weight(words: Counter) -> int:
    return sum(len(w) * n for w, n in words.items())


class Pair:
    """A prediction beside its original and reference; what only some pairs need is worked out when it is asked for."""

    __slots__ = ("original", "ref", "scale", "core", "added", "ends", "words", "have", "missing", "covered", "partial", "has_ref", "tail", "_source")

    def __init__(self, original: str | None, pred: str, ref: str | None, scale: float):
        self.original, self.ref, self.scale = original or "", ref, scale
        self.core, self.added = core(pred)
        self.ends = stopped(self.core) and not (self.added and pred.rstrip().endswith("…"))
        self.words = tokens(self.core)
        self.have = have = Counter(self.words)
        self.has_ref = visible(ref)
        want = tokens(ref) if self.has_ref else []
        total = Counter(want)
        size, own = sum(map(len, want)), sum(map(len, self.words))
        common = sum(len(w) * min(n, total[w]) for w, n in have.items() if w in total)
        self.missing = 1 - common / size if size else 0.0
        self.covered = common / own if own and size else 0.0
        last = self.words[-1] if self.words else ""
        self.partial = bool(last) and last not in total and any(w.startswith(last) for w in total)
        self.tail = sum(w in have for w in want[-3:]) / min(3, len(want)) if want else 1.0
        self._source = None

    @property
    def should_end(self) -> bool:
        return stopped((self.ref or self.original).rstrip())

    def _shared(self) -> tuple[float, float]:
        if self._source is None:
            source = Counter(tokens(self.original))
            n, own = weight(source), weight(self.have)
            common = weight(source & self.have)
            self._source = common / n if n else 0.0, common / own if own else 0.0
        return self._source

    @property
    def kept(self) -> float:
        """Share of the original that stands in the prediction."""
        return self._shared()[0]

    @property
    def copied(self) -> float:
        """Share of the prediction that stands in the original."""
        return self._shared()[1]

    @property
    def ratio(self) -> float:
        return self._ratio(len(self.ref) if self.has_ref else len(self.original) * self.scale)

    def _ratio(self, expected: float) -> float:
        return len(self.core) / expected if expected else 9.0

    @property
    def other(self) -> bool:
        """Another text than the reference altogether."""
        return self.has_ref and self.covered < 0.5 and self.missing > 0.6 and not self.partial

    def cells(self) -> tuple[int, int]:
        """The evidence of a missing end as cells of two tables: against the reference (-1 without one), and against the original."""
        against_ref = bisect_right(MISSING, self.missing) * 4 + (self.tail < 1) * 2 + self.partial if self.has_ref else -1
        expected = len(self.original) * self.scale
        return against_ref, (100 if expected >= SHORT else 120) + bisect_right(RATIO, self._ratio(expected))


def finished(c: Column) -> Column:
    """Sure to end as a sentence does, told in the JVM; false says nothing."""
    return F.coalesce(c.rlike(_FINISHED), F.lit(False))


def first_ref(refs: Column) -> Column:
    return F.try_element_at(F.filter(refs, lambda r: F.length(r) > 0), F.lit(1))


def ending(c: Column) -> Column:
    """A hash of the last two words, numbers aside; null where there are fewer."""
    tail = F.substring_index(F.regexp_replace(c, r"\s+\z", ""), " ", -3)
    words = F.regexp_extract_all(F.lower(tail), F.lit(_JAVA_TOKEN), F.lit(0))
    plain = F.transform(F.slice(words, -2, 2), lambda w: F.when(w.rlike(r"^\p{N}+\z"), "9").otherwise(w))
    return F.when(F.size(words) > 1, F.xxhash64(F.array_join(plain, " ")))


def ref_endings(refs: Column) -> Column:
    """The endings of the finished references, as an array."""
    return F.filter(F.transform(F.filter(F.coalesce(refs, F.array().cast("array<string>")), finished), ending), lambda e: e.isNotNull())


def target(path: str | None, named: str | None) -> str:
    """The language asked for: the pair of languages that ends the path, else the column."""
    m = re.search(r"[.\-_/]([a-z]{2,3})-([a-z]{2,3})(?:-[A-Za-z]+)?(?:\.[a-z]+)*$", path or "")
    return m.group(2) if m else (named or "").split("-")[0].lower()


def scales(pairs: DataFrame) -> dict[str, float]:
    """Characters of a reference for each character of its original, by the languages in pred_path: codes of two or three small letters,
    so never more than 18,253 rows."""
    ref = first_ref(F.col("refs"))
    lang = F.regexp_extract("pred_path", r"[a-z]{2,3}-([a-z]{2,3})[^/]*$", 1)
    sizes = pairs.select(lang.alias("lang"), F.length(ref).alias("r"), F.length("original_text").alias("o")).filter("r > 0 and o > 0")
    return {x["lang"]: x["scale"] for x in sizes.groupBy("lang").agg((F.sum("r") / F.sum("o")).alias("scale")).collect()}
