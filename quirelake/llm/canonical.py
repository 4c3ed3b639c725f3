"""Problem 4: one form for texts that look alike but differ in characters.

Method: a longest-match transducer over grapheme clusters. Its arcs are computed once, by rule, from the Unicode tables, for single
characters and for clusters of a base and its marks: widths (wide, narrow and half-width kana with their sound marks), composed against
combining accents and Hangul, kinds of blanks, invisible characters, ligatures, presentation forms, radicals, Roman numerals, and
look-alike letters of Latin, Cyrillic, Greek, Armenian and Cherokee. When it is compiled the mapping is checked: an arc whose output would
be rewritten again is an error. The arcs compile into one regular expression, longest first, so that a text is rewritten in one pass;
texts of characters the transducer never rewrites (most) are returned as they are. Clusters beyond the compiled ones (several marks in odd
orders, marks parted by invisible characters) go through the rule the arcs were computed by.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.operators.delivery import latest
from quirelake.session import cut, spread

PORTION = 2_000  # records of a form that one task pairs with the others

# Letters that look the same in common typefaces, written as Latin.
LOOK_ALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "H", "Ӏ": "I", "Ԍ": "G",
    # Cyrillic small letters
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q",
    "ԝ": "w", "һ": "h", "ү": "y", "ӏ": "l",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X",
    # Greek small letters and signs
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ɡ": "g", "ı": "i", "µ": "μ",
    # Armenian
    "Օ": "O", "օ": "o", "Լ": "L", "հ": "h", "ց": "g", "զ": "q", "ո": "n", "ս": "u",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
# Characters without any look of their own, kinds of blanks, kinds of hyphens.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u3164\ufeff\uffa0"
BLANKS = "\u0009\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u0085\u2028\u2029"
HYPHENS = "\u2010\u2011\u2043\ufe63"

_MARKS = "\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u064b-\u065f\u0670\u093c\u094d\u09bc\u0b3c\u1dc0-\u1dff\u20d0-\u20ff\u3099-\u309a\uff9e-\uff9f"


_FOLDED = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")
_JAMO = "[\u1100-\u1112][\u1161-\u1175][\u11a8-\u11c2]?"


def _single(ch: str) -> str:
    """The form of one code point by itself."""
    if ch in INVISIBLE:
        return ""
    if ch in BLANKS:
        return " "
    if ch in HYPHENS:
        return "-"
    kind = unicodedata.decomposition(ch).partition(" ")[0]
    code = ord(ch)
    if kind in _FOLDED or 0xFB00 <= code <= 0xFB06 or 0xFB13 <= code <= 0xFB17 or 0x2E80 <= code <= 0x2FDF or 0x2160 <= code <= 0x217F or code in (0x0E33, 0x0EB3):
        ch = unicodedata.normalize("NFKC", ch)
    base = unicodedata.normalize("NFD", ch)
    return unicodedata.normalize("NFC", "".join(LOOK_ALIKES.get(x, x) for x in base))


def cluster_form(cluster: str) -> str:
    """The form of a base and its marks (or of any short run): invisible characters go, widths fold, accents compose, look-alikes become Latin."""
    kana = cluster.replace("\uff9e", "\u3099").replace("\uff9f", "\u309a")
    whole = unicodedata.normalize("NFC", "".join(unicodedata.normalize("NFD", _single(x)) for x in kana))
    return "".join(_single(x) for x in whole)


@lru_cache(maxsize=1)
def transducer() -> tuple[re.Pattern, dict[str, str]]:
    """The compiled pattern (longest clusters first) and the arcs of single characters and clusters. ValueError where arcs conflict."""
    points = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4]
    arcs = {ch: y for ch in points for y in [_single(ch)] if y != ch}
    arcs["\t"] = " "
    singles = sorted(map(ord, arcs))
    for ch in points:  # what composes
        apart = unicodedata.normalize("NFD", ch)
        if len(apart) > 1 and unicodedata.combining(apart[1]):
            arcs[apart] = cluster_form(apart)
    for kana in range(0xFF66, 0xFF9E):  # half-width kana with their sound marks
        for mark in "\uff9e\uff9f":
            arcs[chr(kana) + mark] = cluster_form(chr(kana) + mark)
    parts, run = [], []
    for c in singles:
        if run and c == run[-1] + 1:
            run.append(c)
            continue
        if run:
            parts.append((run[0], run[-1]))
        run = [c]
    parts.append((run[0], run[-1]))
    text = "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in parts)
    unseen = re.escape(INVISIBLE)
    pattern = re.compile(f"{_JAMO}|[^{_MARKS}{unseen}](?:[{unseen}]*[{_MARKS}])+|[{text}]")
    wrong = [x for x, y in arcs.items() if y and _rewrite(y, pattern, arcs) != y]
    if wrong:
        raise ValueError(f"conflicting arcs: {wrong[:20]!r}")
    return pattern, arcs


def _rewrite(text: str, pattern: re.Pattern, arcs: dict[str, str]) -> str:
    def arc(m: re.Match) -> str:
        x = m.group()
        y = arcs.get(x)
        if y is None:
            y = _memo.get(x)
            if y is None:
                y = _memo[x] = cluster_form(x)
        return y

    return pattern.sub(arc, text)


def conflicts() -> list[str]:
    """Arcs whose output would be rewritten again; compiling the transducer fails on them, so there are none."""
    return [x for x, y in transducer()[1].items() if y and canonical(y) != y]


def canonical(text: str | None) -> str | None:
    """The one form of ``text``. None stays None; number of blanks, case and accents are kept."""
    if text is None or text.isascii() and "\t" not in text:
        return text
    if len(_memo) > 50_000:
        _memo.clear()
    return _rewrite(text, *transducer())


_memo: dict[str, str] = {}
_WORD = re.compile(r"[^\W\d_]+(?:[^\W\d_]|[̀-ͯ])*")
_BACK_CYRILLIC = {v: k for k, v in reversed(LOOK_ALIKES.items()) if "Ѐ" <= k <= "ԯ"}
_BACK_GREEK = {v: k for k, v in reversed(LOOK_ALIKES.items()) if "Ͱ" <= k <= "Ͽ"}


def _script(ch: str) -> str:
    c = ord(unicodedata.normalize("NFD", ch)[0])
    return "C" if 0x400 <= c <= 0x52F else "G" if 0x370 <= c <= 0x3FF else "L" if c < 0x250 and chr(c).isalpha() else ""


def caseless(text: str | None) -> str | None:
    """The canonical form, letter case aside. A word is folded in the script it is written in: one that has a Cyrillic (Greek) letter
    without a Latin twin is Cyrillic (Greek), one with a Latin letter without a twin is Latin, else the phrase's other words and the
    word's own letters decide; so Cyrillic capitals with Latin twins still meet their small letters."""
    if text is None:
        return None
    form = canonical(text)
    if form.isascii() and text.isascii():
        return form.casefold()
    if not any(_script(x) in "CG" and _script(x) for x in text):
        return canonical(form.casefold())
    raw_words, out, last = [x for x in (_script(c) for c in text) if x], [], 0
    own = {s: sum(_script(c) == s for c in form) for s in "CG"}
    twins = {"C": _BACK_CYRILLIC, "G": _BACK_GREEK}
    for m in _WORD.finditer(form):
        word = m.group()
        out.append(form[last : m.start()])
        last = m.end()
        here = next((s for s in "CG" if any(_script(c) == s for c in word)), "")
        if not here:
            bases = [unicodedata.normalize("NFD", c)[0] for c in word]
            latin = any(_script(c) == "L" and c not in _BACK_CYRILLIC and c not in _BACK_GREEK for c in bases)
            if not latin:
                here = "C" if own["C"] else "G" if own["G"] else "C" if raw_words.count("C") > raw_words.count("L") else ""
        if here:
            back = twins[here]
            word = unicodedata.normalize("NFC", "".join(back.get(c, c) for c in unicodedata.normalize("NFD", word)))
        out.append(word.casefold())
    out.append(form[last:])
    return canonical("".join(out))


@F.pandas_udf(T.StringType())
def _canonical_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([canonical(x) for x in batch], dtype=object)


@F.pandas_udf(T.StringType())
def _caseless_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([caseless(x) for x in batch], dtype=object)


def canonical_column(column: Column | str, fold: bool = False) -> Column:
    """``column`` in its canonical form. Pure ASCII without tabs, the bulk of Latin text, stays in the JVM: the transducer has no arc for it."""
    column = F.col(column) if isinstance(column, str) else column
    plain = column.rlike(r"\A[\x00-\x08\x0a-\x7f]*\z")
    through = _caseless_udf if fold else _canonical_udf
    return F.when(plain, F.lower(column) if fold else column).otherwise(through(F.when(~plain, column)))


def same_look_pairs(df: DataFrame, key: str, text: str, field: str, by: str) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b: the records whose non-blank texts look the same and differ in characters. Of several
    deliveries of one ``key`` the one with the greatest ``by`` holds (ties: the greater hash). Null and blank texts give no row; equal texts give no pair, so copies of one spelling are never paired with each
    other. An empty table gives none.

    Spellings are compared by 128 bits of the canonical form; each text goes through the transducer once, and only its hashes are
    shuffled. Forms of one spelling are left out before records meet; a form of very many records is spread over several tasks."""
    hashed = (
        spread(df.select(F.col(key).alias("id"), F.col(text).alias("t"), F.col(by).alias("at")))
        .select("id", "t", "at", canonical_column("t").alias("f"))
        .select("id", "at", F.when(F.length(F.regexp_replace("f", r"[\s]+", "")) > 0, F.md5("f")).alias("form"), F.xxhash64("t").alias("raw"), (F.col("f") != F.col("t")).alias("odd"))
    )
    once = cut(latest(hashed, ["id"], by="at", tie=["raw"]).filter("form is not null and id is not null"))
    # records of a form are counted by spelling first: a spelling held by a third of all rows is one row here
    spellings = once.groupBy("form", "raw").agg(F.count("*").alias("n"), F.max("odd").alias("odd"))
    mixed = spellings.groupBy("form").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max("odd").alias("odd")).filter("odd and k > 1")
    kept = once.join(mixed.select("form", F.ceil(F.col("n") / PORTION).cast("int").alias("parts")), "form")
    a = kept.select("form", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("id_a"), F.col("raw").alias("raw_a"))
    b = kept.select("form", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("id_b"), F.col("raw").alias("raw_b"))
    return a.join(b, ["form", "part"]).filter("id_a < id_b and raw_a != raw_b").select(F.lit(field).alias("field"), "id_a", "id_b")
