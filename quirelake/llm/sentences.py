"""Problem 3: sentence boundaries across languages and scripts.

Method: candidates are the terminators of all scripts, with the quotes and brackets that close after them; text within a closed
quotation or bracket holds none. Each candidate is classified by a maximum-entropy model over its neighbouring tokens, their case,
length, digits and script. It is trained on reliable boundaries of the corpus itself: the ends of texts (followed by the starts of
other texts) are boundaries; candidates that go on in small letters or with a comma, and those whose left side is frequent inside
texts but never ends one (abbreviations, initials, speech awaiting its clause), are none. Thai has no terminators: there a blank
between two Thai letters parts sentences.

What a candidate's features see of a text is fixed: two tokens within the 30 characters before it (of a token beyond ASCII its last 12
characters), the 8 characters before an opening quote, and 10 characters after it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import sampling
from quirelake.llm.canonical import canonical
from quirelake.llm.linear import Logistic, slots
from quirelake.operators.delivery import latest
from quirelake.session import spread

TRAIN_ROWS = 10_000  # bound of the labelled sample
ONE_SENTENCE_KINDS = ("heading", "toc", "index", "bibliography", "table_cell")
ONE_SENTENCE_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "td", "th")

_TERM = ".!?…。！？｡।॥؟۔‼⁇⁈⁉．"
_CLOSERS = "\"'”’»›」』）)\\]】》〉"
_STARTS = "“„«「『‹\"(（【["
# Each alternative looks back at the character the class has taken, so that the search for a start is one class.
_CANDIDATE = re.compile(
    rf"[{re.escape(_STARTS + _TERM)}\n](?:(?<=“)[^“”„]*”|(?<=„)[^„“”]*[“”]|(?<=«)[^«»]*»|(?<=「)(?:[^「」]|「[^「」]*」)*」|(?<=『)[^『』]*』|(?<=‹)[^‹›]*›"
    rf'|(?<=")[^"]*"|(?<=\()[^()]*\)|(?<=（)[^（）]*）|(?<=【)[^【】]*】|(?<=\[)[^\[\]]*\]|(?<=[{re.escape(_TERM)}])[{re.escape(_TERM)}]*[{_CLOSERS}]*|(?<=\n)\n*)'
)
_BLANK = re.compile(r"\s*")
_GLUED = re.compile(rf".*\w{{4,}}[{re.escape(_TERM)}]+[{_CLOSERS}]*(.+)$")
_CODE = re.compile(r"[a-z]*[\d_][\w-]*")
_THAI_GAP = re.compile("[ก-๎]\\s+(?=[ก-๎])")
_CONTINUES = ",;:—–-，、；：،؛)）»”』」"
_STRIP = "\"'“”„«»‹›「」『』（）()[]【】《》¿¡…"


def _char_class(ch: str) -> str:
    if not ch:
        return "end"
    c = ord(ch)
    if ch.isdigit():
        return "digit"
    if 0x3040 <= c <= 0x30FF or 0xFF66 <= c <= 0xFF9D:
        return "kana"
    if 0x2E80 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF or c >= 0x20000:
        return "han"
    if 0x0E00 <= c <= 0x0E7F:
        return "thai"
    if 0x0900 <= c <= 0x0DFF:
        return "indic"
    if 0x0590 <= c <= 0x08FF:
        return "semitic"
    if ch.isupper() or ch.istitle():
        return "upper"
    if ch.islower():
        return "lower"
    if ch in "“„«‹「『\"'‘《":
        return "opens"
    if ch in "([（【":
        return "bracket"
    if ch in "¿¡":
        return "spanish"
    if ch in _CONTINUES:
        return "goes on"
    return "letter" if ch.isalpha() else "sign"


class _Remembered(dict):
    """A function's results, at most so many at a time."""

    def __init__(self, function, most: int = 100_000):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) > self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value


def _token(word: str) -> str:
    """A token as a feature: short ones (and those with inner stops) as they are, numbers and the rest by class and length."""
    if not word:
        return "-"
    if not word.isascii():
        word = canonical(word[-12:])
        if not word:
            return "-"
    kind = _char_class(word[-1])
    if kind in ("han", "kana", "thai"):
        return kind
    if word[-1].isdigit():
        return "9" if word.isdigit() else "9x"
    if len(word) <= 4 or len(word) <= 7 and "." in word:
        return word
    return _char_class(word[0]) + (">9" if len(word) > 9 else "")


def _left_token(word: str) -> str:
    word = word.strip(_STRIP)
    if glued := _GLUED.match(word):
        word = glued.group(1)
    return _token(word)


def _right_token(right: str) -> tuple[str, str]:
    """Class of the first character and, where it is short, the first word."""
    if not right.isascii():
        right = canonical(right)
    r = _char_class(right[:1])
    if r == "lower" and _CODE.match(right):
        r = "code"
    word = right.split(None, 1)[0].rstrip(".,;:!?") if right and r not in ("han", "kana", "thai") else right[:1]
    return r, word if len(word) <= 6 else ""


_LEFT, _SECOND, _RIGHT = _Remembered(_left_token), _Remembered(_token), _Remembered(_right_token)
_STARTS_CHUNK = frozenset(_STARTS)


def _place(text: str, m: re.Match) -> tuple | None:
    """The key of a candidate: everything its classification looks at. None where the match can't end a sentence."""
    chunk = m.group()
    a, b = m.span()
    first = chunk[0]
    if first not in _STARTS_CHUNK:
        kind, term, opener = "t", chunk[:4], ""
        left = text[a - 30 if a > 30 else 0 : a].rsplit(None, 2)
        n = len(left)
        l1 = _LEFT[left[-1]] if n else "-"
        if l1 == "thai" and chunk[0] == ".":  # Thai closes no sentence with a stop, only abbreviations
            return None
        l2 = _SECOND[left[-2]] if n > 1 else ""
        head = n < 2 and a < 40
    else:
        inner = chunk[:-1].rstrip()
        if not inner or inner[-1] not in _TERM:
            return None
        stop = len(inner)
        while stop and inner[stop - 1] in _TERM:
            stop -= 1
        kind, term, head, l1, l2 = ("b" if first in "([（【" else "q"), inner[stop:][:3] + chunk[-1], False, "-", ""
        before = text[max(0, a - 8) : a].rstrip()
        opener = "start" if not before else "colon" if before[-1] in ":：" else "after stop" if before[-1] in _TERM + _CLOSERS else _char_class(before[-1])
    gap = 0
    right = text[b : b + 12]
    if right and right[0].isspace():
        gap = 1
        right = text[_BLANK.match(text, b).end() :][:10] if right.isspace() else right.lstrip()
    right = right[:10]
    r, word = _RIGHT[right]
    if not gap and kind == "t" and r in ("lower", "digit", "goes on", "end") and right:
        if not (r == "lower" and chunk[-1] in "。！？।؟"):
            return None
    return (kind, term, l1, l2, opener, gap, r, word, head)


def _features(key: tuple) -> list[int]:
    kind, term, l1, l2, opener, gap, r, word, head = key
    lc = l1 if l1 in ("han", "kana", "thai", "lower", "upper", "9", "lower>9", "upper>9", "indic", "semitic") else f"short{len(l1)}{_char_class(l1[:1])}"
    base = f"{kind}{term}"
    return slots([f"b {base}", f"l {base} {l1}", f"c {base} {lc}", f"r {base} {r}", f"o {base} {opener}", f"g {gap} {r} {kind}", f"lr {l1} {r}", f"cr {base} {lc} {r}", f"ll {l2} {l1}", f"w {kind} {word}", f"lw {l1} {word}", f"h {head} {l1}", f"or {opener} {r} {base}"])


def _left(key: tuple) -> tuple:
    return (*key[:3], key[3] if key[2][:1] == "9" else "", key[4], key[8])


def train(texts: list[str]) -> Logistic:
    """The model from a bounded list of whole texts (each of one or more sentences). Few or no texts: a model that still cuts at every terminator not continued in small letters."""
    inside: list[tuple] = []
    ends: list[tuple] = []
    starts: dict[bool, list[tuple]] = {}
    for text in texts:
        text = text.strip()
        if not text:
            continue
        r, word = _right_token(text[:10])
        starts.setdefault(r in ("han", "kana"), []).append((r, word))
        for m in _CANDIDATE.finditer(text):
            if m.group()[0] == "\n":
                continue
            key = _place(text, m)
            if key is not None:
                (ends if m.end() == len(text) else inside).append(key)
    left_inside, left_end = Counter(map(_left, inside)), Counter(map(_left, ends))
    cases: Counter = Counter()
    for i, key in enumerate(ends):
        wide = key[1][0] in "。！？｡" or key[2] in ("han", "kana")
        pool = starts.get(wide) or starts.get(not wide)
        r, word = pool[(i * 7919) % len(pool)]
        cases[(*key[:5], 0 if wide or i % 8 == 0 else 1, r, word, key[8]), 1] += 1
    for key in inside:
        left = _left(key)
        never = left_inside[left] >= 16 and left_end[left] <= 0.004 * left_inside[left]
        if key[6] in ("lower", "goes on") or never or key[7] == "と":
            cases[key, 0] += 1
    model = Logistic()
    positive = sum(n for (_, y), n in cases.items() if y)
    if not positive:
        model.weights[-1] = 1.0
        return model
    order = sorted(cases)
    share = np.array([cases[k] ** 0.5 for k in order])  # frequent keys shall not drown the rest
    y = np.array([k[1] for k in order])
    share = share / np.where(y == 1, share[y == 1].sum(), share[y == 0].sum())
    return model.fit([_features(k) for k, _ in order], y, share, rounds=80)


class Splitter:
    """Splits texts with a trained model; decisions are remembered by the candidate's key."""

    def __init__(self, model: Logistic):
        self.model, self.memo = model, {}

    def ends(self, key: tuple) -> bool:
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            known = self.memo[key] = self.model.score(_features(key)) > 0
        return known

    def spans(self, text: str, one: bool = False) -> list[int]:
        """start, end, start, end, ... of the sentences of ``text``, without blanks at their ends. Blank texts have none."""
        stop = len(text.rstrip())
        start = len(text) - len(text.lstrip())
        if start >= stop:
            return []
        if one:
            return [start, stop]
        out, ends, known = [], self.ends, self.memo
        cuts = []
        for m in _CANDIDATE.finditer(text, start, stop):
            if m.end() >= stop:
                break
            if m.group()[0] == "\n":
                cuts.append(m.start())
                continue
            key = _place(text, m)
            if key is not None and (known[key] if key in known else ends(key)):
                cuts.append(m.end())
        if not text.isascii() and _THAI_GAP.search(text):
            cuts = sorted({*cuts, *(m.start() + 1 for m in _THAI_GAP.finditer(text, start, stop))})
        for c in cuts:
            end = c
            while end > start and text[end - 1].isspace():
                end -= 1
            if end > start:
                out += (start, end)
            start = max(start, _BLANK.match(text, c).end())
        if start < stop:
            out += (start, stop)
        return out


def sample(units: DataFrame, rows: int = TRAIN_ROWS) -> list[str]:
    """At most ``rows`` running texts, chosen by a hash of their id so that the choice is the same everywhere."""
    running = units.filter("unit_id is not null and length(original_text) > 0").filter(~F.coalesce(F.col("kind"), F.lit("")).isin(*ONE_SENTENCE_KINDS))
    return [r["original_text"] for r in sampling.sample(running.select("unit_id", "original_text"), ["unit_id"], rows)]


def sentences(units: DataFrame, model: Logistic) -> DataFrame:
    """(unit_id, sentence_no, start_pos, end_pos) for every non-blank original_text; of several deliveries the last holds. Units of the
    kinds that are one sentence each (headings, contents, index, bibliography, cells; by tag where kind is null) give one row. Null,
    empty and blank texts give none."""
    one = F.col("kind").isin(*ONE_SENTENCE_KINDS) | (F.col("kind").isNull() & F.coalesce(F.col("tag"), F.lit("")).isin(*ONE_SENTENCE_TAGS))
    rows = units.select("unit_id", "loaded_at", "original_text", F.coalesce(one, F.lit(False)).alias("one"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(model)
        for batch in batches:
            texts, ones = batch.column("original_text").to_pylist(), batch.column("one").to_pylist()
            spans = pa.array([splitter.spans(t, o) if t else [] for t, o in zip(texts, ones)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("unit_id"), batch.column("loaded_at"), spans], ["unit_id", "loaded_at", "spans"])

    cut = spread(rows).mapInArrow(split, "unit_id long, loaded_at timestamp, spans array<int>")
    once = latest(cut, ["unit_id"], tie=["spans"])
    each = F.transform(F.sequence(F.lit(1), (F.size("spans") / 2).cast("int")), lambda i: F.struct(i.alias("sentence_no"), F.element_at("spans", 2 * i - 1).alias("start_pos"), F.element_at("spans", 2 * i).alias("end_pos")))
    return once.filter(F.size("spans") > 0).select("unit_id", F.inline(each))
