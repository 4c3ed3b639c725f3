"""Problem 9: text read in a wrong encoding, found and restored.

Method: a noisy channel. The language side is counted over the whole corpus: characters in their context of two (hashed to fixed
tables) and word frequencies. The channel side are pairs of encodings: the text as bytes of the one it was read in, decoded as the one
it was written in. Lines with a surprising character are put through all pairs; a lattice of the byte readings, in which each lost
byte (U+FFFD) is a wildcard for the characters it can stand for, is searched (Viterbi with a beam) for the most likely text; words of
the corpus win ties. A reading replaces the text where it is more likely by a margin.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.session import spread

BITS3, BITS2, BITSW = 20, 18, 19  # of the tables for small corpora
MOST_BITS, LOAD = 24, 0.3  # tables fuller than LOAD are counted again, larger by two bits, up to MOST_BITS
MARGIN, MARGIN_UTF8 = 4.5, -4.0  # nats by which a reading must be more likely; in UTF-8, which bytes seldom are by chance, for each character
SURPRISE = -6.5  # log probability of a character that makes a line worth a look
BEAM = 24

# The encodings texts are written in and read in.
READ_AS = ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "mac-roman", "cp437", "cp850", "gbk", "big5", "cp932", "euc-jp", "euc-kr", "cp1250", "mac-cyrillic", "cp1256", "cp874", "iso8859-5", "cp1253")
WRITTEN_IN = ("utf-8", "cp1252", "cp1251", "koi8-r", "cp866", "mac-roman", "mac-cyrillic", "cp850", "gbk", "big5", "cp932", "euc-jp", "cp1256", "cp874", "cp1250")

MANY_BYTES = ("utf-8", "gbk", "big5", "cp932", "euc-jp")
SELF_PROVING = ("utf-8",)  # bytes seldom are valid in it by chance

# Bytes that are lost for good: U+FFFD beside a letter, a digit or another one (alone between blanks or quotes it may be meant), control characters.
_LOST = re.compile("(?<=[^\\W_])\ufffd|\ufffd(?=[^\\W_\ufffd]|\ufffd)|[\u0080-\u0084\u0086-\u009f]")
# What garbling leaves and clean text seldom has: signs, letters of other alphabets, capitals and accents in runs. It only decides which lines are looked at.
_SIGNS = "\u00a2-\u00a9\u00ac\u00ae-\u00b9\u00bc-\u00be\u00d7\u00f7\u0100-\u0151\u0154-\u0400\u0402-\u040f\u0450\u0452-\u052f\u2020-\u2022\u2030-\u203a\u20ac\u2116\u2122\u2190-\u2bff\ue000-\uf8ff\uff61-\uff9f"
_RUNS = "[\u00c0-\u00ff]{3}|[а-яё][А-Я]|[А-ЯЁ]{4}|[\u3100-\u33ff\ufe30-\ufe6b]"
_ODD = re.compile(f"[{_SIGNS}\u00c2\u00c3\u00d0\u00d1\u00d8\u00d9]|{_RUNS}")
_UNSURE = re.compile(f"[{_SIGNS}\u0080-\u009f\ufffd]|{_RUNS}")  # lines the language side does not learn from
_M = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _slots(codes: np.ndarray, more: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of (a, b, c), (b, c) and (a, b) for every character c, in tables of ``more`` bits more; two line starts go before the first."""
    c = np.concatenate([np.array([10, 10], np.uint64), codes])
    with np.errstate(over="ignore"):
        two = (c[1:] + (c[:-1] << np.uint64(21))) * _M
        three = ((c[2:] ^ (c[1:-1] << np.uint64(21))) + (c[:-2] * np.uint64(0xC2B2AE3D27D4EB4F))) * _M
    two = (two >> np.uint64(64 - BITS2 - more)).astype(np.int64)
    return (three >> np.uint64(64 - BITS3 - more)).astype(np.int64), two[1:], two[:-1]


def _word_slot(word: str, more: int = 0) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << (BITSW + more)) - 1)


_WORD = re.compile(r"[^\W\d_]+")
_LAST_WORD = re.compile(r"[^\W\d_]+$")


def language(documents: DataFrame) -> Language:
    """Counts over all texts, but for lines with signs that garbling leaves: (kind, slot, n) rows are summed on the cluster. The tables they
    fill grow until less than LOAD of each is in use, so that few contexts share a slot, and end at 2^MOST_BITS slots (64 MB)."""
    more = 0
    while True:
        made = _counted(documents, more).toPandas()
        load = max((int((made.kind == k).sum()) / (1 << (bits + more)) for k, bits in ((2, BITS2), (3, BITS3), (4, BITSW))), default=0.0)
        if load <= LOAD or BITS3 + more >= MOST_BITS:
            return Language(*(made[made.kind == k] for k in (1, 2, 3, 4)), more)
        more += 2


def _counted(documents: DataFrame, more: int) -> DataFrame:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        three, two = np.zeros(1 << (BITS3 + more), np.int64), np.zeros(1 << (BITS2 + more), np.int64)
        words: np.ndarray = np.zeros(1 << (BITSW + more), np.int64)
        letters: Counter = Counter()
        for batch in batches:
            texts = ["\n".join(x for x in t.split("\n") if not _UNSURE.search(x)) if _UNSURE.search(t) else t for t in batch["text"]]
            a, b, _ = _slots(_codes("\n\n".join(texts)), more)
            slots, n = np.unique(a, return_counts=True)
            three[slots] += n
            two += np.bincount(b, minlength=len(two))
            local: Counter = Counter()
            for text in texts:
                local.update(_WORD.findall(text))
                letters.update(text)
            for w, n in local.items():
                words[_word_slot(w, more)] += n
        for kind, counts in ((3, three), (2, two), (4, words)):
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"kind": kind, "slot": at, "n": counts[at]})
        yield pd.DataFrame({"kind": 1, "slot": [ord(c) for c in letters], "n": list(letters.values())})

    return spread(documents.select("text").filter(F.length("text") > 0)).mapInPandas(count, "kind int, slot int, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n"))


class Language:
    """Log probabilities of characters after two others, and of words."""

    def __init__(self, one: pd.DataFrame, two: pd.DataFrame, three: pd.DataFrame, words: pd.DataFrame, more: int = 0):
        self.more = more
        self.line_start = int(_slots(_codes("x"), more)[2][0])
        self.one = np.zeros(0x110000, np.float32)
        self.one[one.slot.to_numpy()] = one.n.to_numpy()
        self.two = np.zeros(1 << (BITS2 + more), np.float32)
        self.two[two.slot.to_numpy()] = two.n.to_numpy()
        self.three = np.zeros(1 << (BITS3 + more), np.float32)
        self.three[three.slot.to_numpy()] = three.n.to_numpy()
        self.words = np.zeros(1 << (BITSW + more), np.float32)
        self.words[words.slot.to_numpy()] = words.n.to_numpy()
        self.total = max(1.0, float(self.one.sum()))
        known = np.flatnonzero(self.one >= max(3, self.total * 2e-6))
        ranked = known[np.argsort(-self.one[known], kind="stable")]
        self.letters = [chr(c) for c in ranked.tolist() if c > 127 and c != 0xFFFD and not 0x80 <= c < 0xA0]
        self.one[0xFFFD] = 0
        self.alphabet = set(self.letters)
        self.common = {c for c in self.letters if self.one[ord(c)] >= max(5, self.total * 3e-5)} | set(map(chr, range(32, 127)))
        self.fits: dict[tuple, list[str]] = {}
        self.everyday: dict[tuple[str, str], frozenset[str]] = {}
        self.known = self.alphabet | set(map(chr, range(128))) | set(map(chr, range(0x80, 0xA0)))

    def logs(self, text: str) -> np.ndarray:
        """log P of each character."""
        codes = _codes(text)
        a, b, before2 = _slots(codes, self.more)
        before1 = np.concatenate([[10], codes[:-1].astype(np.int64)])
        c2 = self.two[before2]
        c2[before2 == self.line_start] = self.one[10]
        p = 0.9 * self.three[a] / (c2 + 2.0) + 0.09 * self.two[b] / (self.one[before1] + 2.0) + 0.01 * self.one[codes.astype(np.int64)] / self.total + 1e-8
        return np.log(np.minimum(p, 1.0))

    def next_logs(self, tails: list[str], choices: list[str]) -> np.ndarray:
        """log P of each of ``choices`` (single characters) after each of ``tails`` (two characters)."""
        a = np.array([ord(t[0]) for t in tails], np.uint64)[:, None]
        b = np.array([ord(t[1]) for t in tails], np.uint64)[:, None]
        c = np.array([ord(x) for x in choices], np.uint64)[None, :]
        with np.errstate(over="ignore"):
            three = ((((c ^ (b << np.uint64(21))) + a * np.uint64(0xC2B2AE3D27D4EB4F)) * _M) >> np.uint64(64 - BITS3 - self.more)).astype(np.int64)
            two = (((c + (b << np.uint64(21))) * _M) >> np.uint64(64 - BITS2 - self.more)).astype(np.int64)
            before = (((b + (a << np.uint64(21))) * _M) >> np.uint64(64 - BITS2 - self.more)).astype(np.int64)
        p = 0.9 * self.three[three] / (self.two[before] + 2.0) + 0.09 * self.two[two] / (self.one[b.astype(np.int64)] + 2.0) + 0.01 * self.one[c.astype(np.int64)] / self.total + 1e-8
        return np.log(np.minimum(p, 1.0))

    def fitting(self, part: tuple[int | None, ...]) -> list[str]:
        """The known letters whose UTF-8 has these bytes; None stands for any byte."""
        if part not in self.fits:
            raws = ((c, c.encode("utf-8", "surrogatepass")) for c in self.letters)
            self.fits[part] = [c for c, raw in raws if len(raw) == len(part) and all(x is None or x == y for x, y in zip(part, raw))]
        return self.fits[part]

    def allowed(self, wrong: str, right: str) -> frozenset[str]:
        """The characters of one single-byte encoding that another reads as everyday ones."""
        if (wrong, right) not in self.everyday:
            self.everyday[wrong, right] = frozenset(c for c, image in _MAPS[wrong, right].items() if image in self.common and not "\uff61" <= image <= "\uff9f")
        return self.everyday[wrong, right]

    def word(self, word: str) -> float:
        return float(self.words[_word_slot(word, self.more)])

    def value(self, text: str) -> float:
        return float(self.logs(text).sum())

    def values(self, texts: list[str]) -> np.ndarray:
        """The value of each text, counted in one go."""
        if not texts:
            return np.zeros(0)
        logs = self.logs("\n\n".join(texts))
        starts = np.cumsum([0, *(len(t) + 2 for t in texts[:-1])])
        sums = np.array([float(logs[a : a + len(t)].sum()) for a, t in zip(starts.tolist(), texts)])
        return sums


def _table(encoding: str) -> dict[str, int] | None:
    """character -> byte of a single-byte encoding; bytes without a character stand for themselves. None for other encodings."""
    out: dict[str, int] = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            if encoding in ("gbk", "big5", "cp932", "euc-jp", "euc-kr"):
                return None
            out.setdefault(chr(b), b)
    return out


def _image(byte: int, encoding: str) -> str | None:
    try:
        return bytes([byte]).decode(encoding)
    except UnicodeDecodeError:
        return None


_TABLES = {e: _table(e) for e in READ_AS}


def to_bytes(text: str, encoding: str) -> bytes | None:
    """``text`` as the bytes it was read from. None if it can't have been read in ``encoding``."""
    table = _TABLES[encoding]
    try:
        if table is None:
            return text.encode(encoding)
        return bytes([table[ch] for ch in text])
    except (UnicodeEncodeError, KeyError):
        return None


_MAPS = {(w, r): {c: image for c, b in _TABLES[w].items() if b > 127 and (image := _image(b, r)) is not None} for w in READ_AS if _TABLES[w] is not None for r in WRITTEN_IN if r not in MANY_BYTES and r != w}


def readings(text: str, lang: Language, rights: tuple[str, ...] = WRITTEN_IN) -> dict[str, str]:
    """All texts that the encoding pairs make of ``text`` without loss and out of known characters, with the encoding each was written
    in. UTF-8 that was garbled twice is read twice. A pair of single-byte encodings is a map of characters: the distinct characters of
    the text tell whether it fits, and only then is the text rewritten."""
    out: dict[str, str] = {}
    seen: set[bytes] = set()
    strange = max(1, len(text) // 25)
    kinds = set(text)
    high = {c for c in kinds if c > "\x7f"}
    for wrong in READ_AS:
        table = _TABLES[wrong]
        if table is not None and not high <= table.keys():
            continue
        raw = to_bytes(text, wrong)
        if raw is None or raw.isascii() or raw in seen:
            continue
        seen.add(raw)
        for right in rights:
            if right == wrong:
                continue
            if table is not None and right not in MANY_BYTES:
                images, allowed = _MAPS[wrong, right], lang.allowed(wrong, right)
                if not all(c in allowed or images.get(c) in kinds for c in high):
                    continue  # what single bytes bring in must be everyday characters
                new = raw.decode(right)
                if new not in out and new != text and len(set(new) - lang.known) <= strange:
                    out[new] = right
                continue
            try:
                new = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if right == "utf-8" and (again := to_bytes(new, wrong)) and not again.isascii():
                try:
                    out[again.decode()] = right
                except UnicodeDecodeError:
                    pass
            if new in out or new == text or len(set(new) - lang.known) > strange:
                continue
            brought = set(new) - kinds
            if right not in MANY_BYTES and not brought <= lang.common or any("\uff61" <= c <= "\uff9f" for c in brought):
                continue
            out[new] = right
    return out


def lossy_readings(text: str, lang: Language) -> list[list]:
    """Lattices (for each character its possible texts, None: a wildcard) of ``text`` with U+FFFD or undecodable rests."""
    out = []
    if 0 < text.count("�") <= max(8, len(text) // 3):  # above that nothing is known of most letters: filling them in would be inventing
        out.append([[ch] if ch != "�" else None for ch in text])
    for wrong in READ_AS:
        raw = bytearray()
        holes = []
        for ch in text:
            if ch == "�":
                holes.append(len(raw))
                raw.append(0xFF)
                continue
            part = to_bytes(ch, wrong)
            if part is None:
                break
            raw += part
        else:
            if bytes(raw).isascii():
                continue
            lattice = _utf8_lattice(bytes(raw), set(holes), lang)
            if lattice is None or lattice in out:
                continue
            certain = [x[0] for x in lattice if x and len(x) == 1 and x[0] > "\x7f"]
            if 2 * sum(c not in lang.known for c in certain) > len(certain):
                continue  # what the bytes give for certain are mostly characters the corpus doesn't know
            out.append(lattice)
    return out


def _utf8_lattice(raw: bytes, holes: set[int], lang: Language) -> list | None:
    """The UTF-8 reading of bytes of which those at ``holes`` are lost; a character with lost bytes becomes the known letters that fit
    the others, or U+FFFD where there are none. None where the characters
    that bytes give are not more than those without a byte or with bytes that fit nothing: such a text can only be invented."""
    i, n, out, good = 0, len(raw), [], 0
    while i < n:
        b = raw[i]
        size = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        if i in holes:  # a lost first byte: the bytes after it can only belong to its character
            j = i + 1
            while j < min(n, i + 4) and j not in holes and 0x80 <= raw[j] < 0xC0:
                j += 1
            chars = lang.fitting((None, *raw[i + 1 : j])) if j > i + 1 else None
            good += bool(chars)
            out.append(chars or None)
            i = j if chars else i + 1
            continue
        if not size:
            out.append(None)
            i += 1
            continue
        if size == 1:
            out.append([chr(b)])
            i += 1
            continue
        part, j = [], i + 1
        while j < n and len(part) < size - 1 and (j in holes or 0x80 <= raw[j] < 0xC0):
            part.append(None if j in holes else raw[j])
            j += 1
        if len(part) < size - 1:
            part += [None] * (size - 1 - len(part))
        if None in part:
            chars = lang.fitting((b, *part)) or ["�"]
        else:
            try:
                chars = [bytes([b, *part]).decode()]
            except UnicodeDecodeError:
                return None
        good += chars != ["�"]
        out.append(chars)
        i = j
    return out if good > out.count(None) + out.count(["�"]) else None


def viterbi(lattice: list, lang: Language) -> str:
    """The most likely text of a lattice; paths that agree in their last two characters are merged. A wildcard may be any known letter,
    or nothing at all (one more lost byte of a character already read). A path that ends a word of the corpus gains."""
    wild = [*lang.letters, ""]
    states: dict[str, tuple[float, str]] = {"\n\n": (0.0, "")}
    for options in lattice:
        if options is None:
            choices = wild
        elif len(options) == 1:
            choices = options
            if len(states) == 1:
                ((tail, (value, text)),) = states.items()
                states = {(tail + choices[0])[-2:]: (value, text + choices[0])}
                continue
        else:
            choices = options
        tails = list(states)
        full = [c for c in choices if c]
        logs = lang.next_logs(tails, full)
        grown: dict[str, tuple[float, str]] = {}
        for i, tail in enumerate(tails):
            value, text = states[tail]
            bonus = 0.0
            if len(states) > 1 and not full[0].isalpha() and (word := _LAST_WORD.search(text)) and lang.word(word.group()) >= 3:
                bonus = 3.0
            row = logs[i]
            best = np.argpartition(-row, BEAM)[:BEAM] if len(row) > BEAM else np.arange(len(row))
            for j in best[np.argsort(-row[best], kind="stable")].tolist():
                c = full[j]
                new = (tail + c)[-2:]
                total = value + bonus + float(row[j]) - (1.5 if len(full) > 1 and not c.isalpha() else 0.0)
                if total > grown.get(new, (-1e18,))[0]:
                    grown[new] = (total, text + c)
            if len(full) < len(choices) and value - 6.0 > grown.get(tail, (-1e18,))[0]:
                grown[tail] = (value - 6.0, text)
        states = dict(sorted(grown.items(), key=lambda x: (-x[1][0], x[1][1]))[:BEAM])
    return max(states.values(), key=lambda x: (x[0], x[1]))[1]


def _likeliest(texts: dict[str, str], now: float, lang: Language) -> tuple[float, str] | None:
    """The most likely of the readings that beat ``now`` by their margin; bytes seldom are valid UTF-8 by chance, so there it may even be less likely."""
    if not texts:
        return None
    values = lang.values(list(texts))
    least = np.array([now + (MARGIN_UTF8 * (len(new) - sum(map(str.isascii, new))) if right == "utf-8" else MARGIN) for new, right in texts.items()])
    values[values <= least] = -np.inf
    k = int(values.argmax())
    return (float(values[k]), list(texts)[k]) if values[k] > -np.inf else None


def surprising_lines(text: str, lang: Language) -> list[bool]:
    """For each line whether its characters beyond ASCII are so unlikely that it may be garbled."""
    lines = text.split("\n")
    logs = lang.logs(text)
    high = _codes(text) > 127
    bad = high & (logs < SURPRISE)
    starts = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
    pad = lambda x: np.concatenate([np.cumsum(x), [0]])
    total_high, total_bad, total_log = pad(high), pad(bad), pad(np.where(high, logs, 0.0))
    out = []
    for a, line in zip(starts.tolist(), lines):
        b = a + len(line)
        if b == a:
            out.append(False)
            continue
        n, k, v = (float(t[b - 1] - (t[a - 1] if a else 0)) for t in (total_high, total_bad, total_log))
        out.append(n > 0 and (k >= 0.12 * n and k > 0 or v < -4.0 * n or bool(_ODD.search(line))))
    return out


def _lossy(line: str, now: float, lang: Language, bytes_only: bool = False) -> str | None:
    """The likeliest of the texts of the lattices of a line with lost bytes that beat ``now`` by their margin, as for readings without loss."""
    best, value = None, -np.inf
    if "�" in line:
        for lattice in lossy_readings(line, lang):
            read = lattice != [[ch] if ch != "�" else None for ch in line]  # bytes read as UTF-8, not letters filled in
            if bytes_only and not read:
                continue
            new = viterbi(lattice, lang)
            own = lang.value(new)
            least = now + (MARGIN_UTF8 * (len(new) - sum(map(str.isascii, new))) if read else MARGIN)
            if own > least and own > value:
                best, value = new, own
    return best


def restore_line(line: str, lang: Language) -> tuple[str, bool]:
    """(text as it was, garbled?) of one line."""
    if line.isascii():
        return line, False
    now = lang.value(line)
    best, value, past = line, now, {line}
    while (found := _likeliest(readings(best, lang), value, lang)) is not None and found[1] not in past:  # text may have been garbled more than once
        value, best = found
        past.add(best)
    if value > now:
        return best, True
    # only a part of the line was garbled: the decoding that proves itself is tried on its words
    words = re.split(r"(\s+)", line)
    if len(words) > 1:
        mixed = {}
        for k, w in enumerate(words):
            if not w.isascii():
                mixed.update({"".join([*words[:k], new, *words[k + 1 :]]): right for new, right in readings(w, lang, SELF_PROVING).items()})
        found = _likeliest(mixed, now, lang)
        if found is not None:
            partly = restore_line(found[1], lang)[0]
            filled = _lossy(line, now, lang)
            return max([partly, filled or partly], key=lang.value), True
    if not _LOST.search(line):  # a sign that may be meant, unless the bytes around it make another text
        regained = _lossy(line, now, lang, bytes_only=True)
        return regained or line, regained is not None
    return _lossy(line, now, lang) or line, True  # a line that no reading explains is lost


def garbled(documents: DataFrame, lang: Language) -> DataFrame:
    """(doc_id, restored, spans) of the documents with at least one garbled stretch; spans is the number of garbled lines. Lines that
    can't be regained stay as they are. Null and empty texts are never garbled; an empty table gives none."""
    shared = documents.sparkSession.sparkContext.broadcast(lang)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            rows = []
            for doc, text in batch.itertuples(index=False):
                lines, bad = text.split("\n"), 0
                lost = "\ufffd" in text or _LOST.search(text) is not None
                for i, (line, odd) in enumerate(zip(lines, surprising_lines(text, model))):
                    if odd or lost and ("\ufffd" in line or _LOST.search(line)):
                        lines[i], hit = restore_line(line, model)
                        bad += hit
                if bad:
                    rows.append((doc, "\n".join(lines), bad))
            yield pd.DataFrame(rows, columns=["doc_id", "restored", "spans"])

    plain = F.col("text").rlike(r"\A[\x00-\x7f]*\z")
    return spread(documents.select("doc_id", "text").filter((F.length("text") > 0) & ~plain)).mapInPandas(scan, "doc_id long, restored string, spans int")
