"""Problem 8: evaluation passages inside training text, found and removed.

Method: the hash set of all normalised test n-grams goes to every executor; each document's token windows are scanned against it; hits
are verified along their diagonal: the longest stretch of the item in which at most one word in ten is replaced must hold at least half
of the item's words. The stretches, as offsets of the document's characters, are then cut out, or documents that are mostly test material
dropped. Windows are of five words; of fewer where half an item is less. What is broadcast is bounded: items of more than BLOCK_TOKENS
tokens in all are taken in blocks, each against all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.canonical import INVISIBLE
from quirelake.session import cut, spread

GRAM = 5
SHARE, REPLACED = 0.5, 0.1
BLOCK_TOKENS = 2_000_000  # of items, broadcast at once: about 100 MB
AT_ONCE = 1 << 20  # pairs of places expanded at once

_TOKEN = regex.compile(r"\p{Han}|[[\p{L}\p{M}\p{N}]--\p{Han}]+", regex.V1)
_HAN = regex.compile(r"\p{Han}").match
_DROP = re.compile(f"[{INVISIBLE}]+")
_LINE_HYPHEN = regex.compile(r"(?<=\p{Ll})[-‐]\s*\n\s*(?=\p{Ll})")
_CHUNK = regex.compile(r"\S+")


def _plain(text: str) -> str:
    if not text.isascii():
        text = _DROP.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    return text


def normal_tokens(text: str) -> list[str]:
    """Words (single characters in Han script), case, punctuation, spacing, line ends, width and invisible characters aside."""
    text = _plain(text)
    if "-\n" in text or "‐\n" in text:
        text = _LINE_HYPHEN.sub("", text)
    return _TOKEN.findall(text.casefold())


def token_places(text: str) -> list[tuple[int, int]]:
    """The (start, end) of each of the normal tokens in the text as it is. A chunk between blanks whose length changes when it is
    normalised is mapped character by character, or, where characters compose, taken whole."""
    out: list[tuple[int, int]] = []
    chunks = [m.span() for m in _CHUNK.finditer(text)]
    joined: list[tuple[int, int, str]] = []
    for a, b in chunks:
        if joined and _LINE_HYPHEN.search(_plain(text[joined[-1][0] : b])) and "\n" in text[joined[-1][1] : a]:
            a0, _, _ = joined.pop()
            joined.append((a0, b, _LINE_HYPHEN.sub("", _plain(text[a0:b]))))
        else:
            joined.append((a, b, _plain(text[a:b])))
    for a, b, flat in joined:
        flat = flat.casefold()
        own = [m.span() for m in _TOKEN.finditer(flat)]
        if len(flat) == b - a:
            out += [(a + x, a + y) for x, y in own]
            continue
        ends = np.cumsum([len(_plain(c).casefold()) for c in text[a:b]])
        if ends[-1] == len(flat):
            out += [(a + int(np.searchsorted(ends, x, "right")), a + int(np.searchsorted(ends, y - 1, "right")) + 1) for x, y in own]
        else:
            out += [(a, b)] * len(own)
    return out


def window(tokens: int, sizes: np.ndarray) -> tuple[int, int]:
    """Words of the longest window that any stretch counting as a leak must hold unreplaced, and how many such windows it holds at least.
    ``sizes``: what each token counts."""
    need = SHARE * int(sizes.sum())
    upto = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.searchsorted(upto, upto[:-1] + need - 1e-9)
    least = int((ends - np.arange(tokens))[ends <= tokens].min(initial=tokens))  # tokens of the shortest stretch that is half of the item
    replaced = int(REPLACED * need + 1e-9)
    gram = max(1, min(GRAM, -(-(least - replaced) // (replaced + 1))))
    hits = least - gram + 1 - (replaced + 1) * gram  # one more replaced, as a longer stretch may have
    return gram, max(1, hits // 2 if sizes.max(initial=1) > 1 else hits)


class Index:
    """The test n-grams by their length: sorted hashes, and for each the items and places that hold it."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: list[int] = []
        self.vocabulary: dict[str, int] = {}
        self.tokens: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.least: list[int] = []
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for item, text in items:
            words = normal_tokens(text or "")
            if not words:
                continue
            k = len(self.ids)
            tokens = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in words], np.int64)
            # a word counts 1; in Chinese, where characters count, a token counts its characters
            han = sum(map(bool, map(_HAN, words))) > len(words) / 2
            sizes = np.array([len(t) for t in words]) if han else np.ones(len(words), np.int64)
            self.ids.append(item)
            self.tokens.append(tokens)
            self.sizes.append(sizes)
            n, hits = window(len(words), sizes)
            self.least.append(hits)
            h = self.hashes(tokens, n)
            parts.setdefault(n, []).append((h, np.full(len(h), k), np.arange(len(h))))
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, rows in parts.items():
            grams, owner, place = (np.concatenate(x) for x in zip(*rows))
            order = np.argsort(grams, kind="stable")
            self.grams[n] = grams[order], owner[order], place[order]

    @staticmethod
    def hashes(tokens: np.ndarray, gram: int) -> np.ndarray:
        """Of all windows of ``gram`` tokens; windows with a word no item has (0) hash to -1."""
        n = len(tokens) - gram + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            h = np.zeros(n, np.uint64)
            known = np.ones(n, bool)
            for j in range(gram):
                part = tokens[j : j + n]
                known &= part > 0
                h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (part.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(j + 1))
        out = (h >> np.uint64(1)).astype(np.int64)
        out[~known] = -1
        return out

    def diagonals(self, tokens: np.ndarray) -> list[tuple[int, int]]:
        """(item, shift) of the diagonals with as many windows as a leak must have; expanded in bounded portions, however many items share a window."""
        found: Counter = Counter()
        for n, (grams, owner, place) in self.grams.items():
            h = self.hashes(tokens, n)
            left = np.searchsorted(grams, h)
            at = np.flatnonzero((h >= 0) & (left < len(grams)) & (grams[np.minimum(left, len(grams) - 1)] == h))
            if not len(at):
                continue
            left = left[at]
            count = np.searchsorted(grams, h[at], "right") - left
            upto = np.concatenate([[0], np.cumsum(count)])
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + AT_ONCE)) - 1)
                c = count[i:j]
                k = np.repeat(left[i:j] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(int(c.sum()))
                pairs, hits = np.unique((owner[k] << 32) + np.repeat(at[i:j], c) - place[k] + (1 << 31), return_counts=True)
                found.update(dict(zip(pairs.tolist(), hits.tolist())))
                i = j
        split = ((x >> 32, (x & 0xFFFFFFFF) - (1 << 31), n) for x, n in found.items())
        return sorted((item, shift) for item, shift, n in split if n >= self.least[item])

    def found(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, matched words of the item's stretch, first token, last token + 1) of the items that ``text`` holds."""
        get = self.vocabulary.get
        tokens = np.fromiter((get(t, 0) for t in normal_tokens(text)), np.int64)
        best: dict[int, tuple[int, int, int]] = {}
        for item, shift in self.diagonals(tokens):
            got = stretch(self.tokens[item], tokens, shift, self.sizes[item])
            if got and got[0] > best.get(item, (0,))[0]:
                best[item] = got
        return [(self.ids[k], *v) for k, v in sorted(best.items())]


def stretch(item: np.ndarray, tokens: np.ndarray, shift: int, sizes: np.ndarray) -> tuple[int, int, int] | None:
    """The longest stretch of ``item`` laid at ``shift`` of ``tokens`` that begins and ends with a match and has at most one word in
    ten replaced: (its size, first token, last token + 1); None if it is less than half of the item."""
    a, b = max(0, -shift), min(len(item), len(tokens) - shift)
    need = SHARE * int(sizes.sum())
    upto = np.concatenate([[0], np.cumsum(sizes)])
    if upto[b] - upto[a] < need:
        return None
    where = np.flatnonzero(item[a:b] == tokens[a + shift : b + shift]) + a
    matched = np.concatenate([[0], np.cumsum(sizes[where])])
    if matched[-1] < need * (1 - REPLACED):
        return None
    # matched - (1 - REPLACED) * length must not fall from the start to the end: for each start the last end that is no lower
    starts = matched[:-1] - (1 - REPLACED) * upto[where]
    ends = matched[1:] - (1 - REPLACED) * upto[where + 1] + 1e-9
    highest = np.maximum.accumulate(ends[::-1])  # of the ends from the last on
    last = len(where) - 1 - np.searchsorted(highest, starts)
    ok = np.flatnonzero((last >= np.arange(len(where))) & (last < len(where)))
    if not len(ok):
        return None
    total = upto[where[last[ok]] + 1] - upto[where[ok]]
    i = int(total.argmax())
    if total[i] < need:
        return None
    return int(total[i]), int(where[ok[i]]) + shift, int(where[last[ok[i]]]) + shift + 1


def _blocks(items: DataFrame) -> Iterator[Index]:
    """The items as indexes of bounded size. Their tokens are counted on the cluster before any comes to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": [sum(len(normal_tokens(t)) for t in batch["text"] if t)]})

    total = items.select("text").mapInPandas(count, "n long").agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // BLOCK_TOKENS)
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Index([(r[0], r[1]) for r in part.select("item_id", "text").filter("text is not null").orderBy("item_id", "text").collect()])


SCHEMA = "doc_id long, item_id long, words int, start_pos int, end_pos int"


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, words, start_pos, end_pos): each document with each item it holds at least half of, and where. Null and empty texts
    hold nothing; items without words are in no document; of an item under ten words half must occur unchanged. Empty tables give none."""
    spark = documents.sparkSession
    texts = spread(documents.select("doc_id", "text").filter(F.length("text") > 0))
    out = None
    indexes = _blocks(items)
    index = next(indexes, None)
    while index is not None:
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            found = shared.value.found
            for batch in batches:
                rows = []
                for doc, text in batch.itertuples(index=False):
                    if hits := found(text):
                        places = token_places(text)
                        rows += [(doc, item, words, places[a][0], places[b - 1][1]) for item, words, a, b in hits]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

        part = texts.mapInPandas(scan, SCHEMA)
        index = next(indexes, None)
        if index is not None or out is not None:  # several blocks: each result is stored, its index given back
            part = cut(part)
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def cleaned(documents: DataFrame, items: DataFrame, most: float = 0.5) -> DataFrame:
    """(doc_id, removed, dropped, text) of the documents with leaks: their text without the leaked stretches (overlapping ones count once,
    each leaves a line end), the number of characters removed; dropped, with a null text, where these are more than ``most`` of it."""
    found = leaks(documents, items)
    span = F.struct("start_pos", "end_pos")
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(span)).alias("spans"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, own in batch.itertuples(index=False):
                kept, at, removed = [], 0, 0
                for a, b in ((x["start_pos"], x["end_pos"]) for x in own):
                    if b <= at:
                        continue
                    kept.append(text[at:a].rstrip())
                    removed += b - max(a, at)
                    at = b
                kept.append(text[at:].lstrip(" ,.;:!?。！？，"))
                drop = removed > most * len(text)
                rows.append((doc, removed, drop, None if drop else "\n".join(x for x in kept if x)))
            yield pd.DataFrame(rows, columns=["doc_id", "removed", "dropped", "text"])

    return documents.select("doc_id", "text").filter(F.length("text") > 0).join(spans, "doc_id").mapInPandas(remove, "doc_id long, removed int, dropped boolean, text string")
