"""Problem 7: documents put into containers of a fixed number of tokens.

Method: lexical retrieval packing. Documents are laid out by their most telling term, so that shards of neighbouring documents are
about the same things; each shard builds a BM25 index of its items, takes the largest unused item as seed, and fills the seed's window
greedily with the unused items that BM25 ranks nearest. What retrieval leaves half empty is topped up with the best-fitting items
left. Document frequencies and the mean length are of all documents; they are kept in a hashed table of fixed size.

Token counts come from a public byte-level tokenizer whose vocabulary file is a parameter.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.session import cut, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
TERM_BITS = 18
SHARD = 1_500  # items of one index
FULL = 0.97  # containers less full are taken apart and fitted again
K1, B = 1.2, 0.75
# Fixed value: how the vocabulary's texts are split before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_TERM = re.compile(r"[一-鿿ぁ-ヿ]{2}|[^\W\d_一-鿿ぁ-ヿ]{2,}")


def tokenizer(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Slots(dict):
    """word -> slot, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        slot = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << TERM_BITS) - 1)
        return slot


_SLOTS = _Slots()


def term_slots(text: str) -> Counter:
    return Counter(map(_SLOTS.__getitem__, _TERM.findall(text.casefold())))


def frequencies(documents: DataFrame) -> tuple[np.ndarray, float, int]:
    """Document frequency of each term slot, mean number of terms, number of documents."""

    def count(batches):
        df, terms, docs = np.zeros(1 << TERM_BITS, np.int64), 0, 0
        for batch in batches:
            for text in batch["text"]:
                c = term_slots(text)
                df[list(c)] += 1
                terms += sum(c.values())
                docs += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"slot": [*at, -1, -2], "n": [*df[at], terms, docs]}, dtype="int64")

    made = spread(documents.select("text").filter(F.length("text") > 0)).mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << TERM_BITS, np.float32)
    real = made[made.slot >= 0]
    df[real.slot.to_numpy()] = real.n.to_numpy()
    terms, docs = (int(made.n[made.slot == k].sum()) for k in (-1, -2))
    return df, terms / max(1, docs), docs


def pack(sizes: list[int], terms: list[Counter], capacity: int, idf: np.ndarray, mean: float) -> list[list[int]]:
    """Containers (lists of places) of items, each at most ``capacity``; by BM25 from the largest unused item on, then best fit."""
    items = np.repeat(np.arange(len(terms)), [len(c) for c in terms])
    slot = np.array([t for c in terms for t in sorted(c)], np.int64)
    n = np.array([c[t] for c in terms for t in sorted(c)], np.float64)
    norm = K1 * (1 - B + B * np.array([sum(c.values()) for c in terms]) / max(1.0, mean))
    weight = idf[slot].astype(np.float64) * n * (K1 + 1) / (n + norm[items])
    by_slot = np.argsort(slot, kind="stable")
    owner, weight = items[by_slot], weight[by_slot]
    used, slot_of = np.unique(slot, return_inverse=True)
    ends = np.searchsorted(slot[by_slot], used, "right").tolist()  # where the postings of each term end
    first = np.searchsorted(items, np.arange(len(terms) + 1)).tolist()
    all_sizes, free_items = np.array(sizes), np.ones(len(sizes), bool)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    unused = set(order)
    out: list[list[int]] = []
    for seed in order:
        if seed not in unused:
            continue
        unused.discard(seed)
        free_items[seed] = False
        box, free = [seed], capacity - sizes[seed]
        runs = [slice(ends[t - 1] if t else 0, ends[t]) for t in slot_of[first[seed] : first[seed + 1]].tolist()]
        scores = np.zeros(len(sizes))
        if runs:
            scores = np.bincount(np.concatenate([owner[r] for r in runs]), np.concatenate([weight[r] for r in runs]), len(sizes))
        near = np.flatnonzero((scores > 0) & free_items & (all_sizes <= free))
        for i in near[np.argsort(-scores[near], kind="stable")].tolist():
            if sizes[i] <= free:
                box.append(i)
                unused.discard(i)
                free_items[i] = False
                free -= sizes[i]
                if free < 8:
                    break
        out.append(box)
    return _fitted(out, sizes, capacity)


def _fitted(boxes: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Little space left: containers less than ``FULL`` full are taken apart again and their items, largest first, put where they leave
    the least room (best fit), in the fuller containers or new ones."""
    used = [sum(sizes[i] for i in b) for b in boxes]
    out = [list(b) for b, u in zip(boxes, used) if u >= FULL * capacity]
    loose = sorted((i for b, u in zip(boxes, used) if u < FULL * capacity for i in b), key=lambda i: (-sizes[i], i))
    rooms = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(out))
    for i in loose:
        at = bisect.bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
            out[k].append(i)
        else:
            room, k = capacity, len(out)
            out.append([i])
        bisect.insort(rooms, (room - sizes[i], k))
    return out


def containers(documents: DataFrame, capacity: int, vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """(container, doc_id, part, parts, tokens, start_token, fill): where each document, or each part of one longer than
    ``capacity`` tokens, goes. A longer document fills containers of its own and its rest is an item like others. Null and empty texts
    are items of no tokens and get container null. fill is the share of the container's capacity in use."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = documents.sparkSession
    df, mean, docs = frequencies(documents)
    idf = np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, mean))

    def measure(batches):
        idf = shared.value[0].tolist()
        alone = max(idf) - 0.5  # a term of one document alone brings it next to none
        enc = tokenizer(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in batch.itertuples(index=False):
                n = len(enc.encode_ordinary(text)) if text else 0
                c = term_slots(text or "")
                rated = [(idf[t] * k, t) for t, k in c.items()]
                shared_terms = [x for x in rated if idf[x[1]] < alone]
                lead = max(shared_terms or rated)[1] if rated else -1
                keys = list(c)
                parts = max(1, -(-n // capacity))
                for k in range(parts):
                    size = n - k * capacity if k == parts - 1 else capacity
                    rest = k == parts - 1
                    rows.append((doc, k + 1, parts, size, k * capacity, lead, keys if rest and size < capacity else [], [c[t] for t in keys] if rest and size < capacity else []))
            yield pd.DataFrame(rows, columns=["doc_id", "part", "parts", "tokens", "start_token", "lead", "terms", "counts"])

    items = cut(spread(documents.select("doc_id", "text")).mapInPandas(measure, "doc_id long, part int, parts int, tokens int, start_token int, lead int, terms array<int>, counts array<int>"))
    small = items.filter(f"tokens > 0 and tokens < {capacity}")
    shards = max(1, -(-small.count() // shard))
    partitions = min(shards, 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # each is cut into shards

    def fill(batches):
        idf, mean = shared.value
        held = pd.DataFrame()
        for batch in batches:
            held = pd.concat([held, batch], ignore_index=True) if len(held) else batch
            while len(held) >= 2 * shard:  # what is left at the end is then a shard of its own size too
                yield one(held.iloc[:shard].reset_index(drop=True), idf, mean)
                held = held.iloc[shard:].reset_index(drop=True)
        if len(held):
            yield one(held, idf, mean)

    def one(t, idf, mean):
        terms = [Counter(dict(zip(map(int, a), map(int, b)))) for a, b in zip(t["terms"], t["counts"])]
        boxes = pack([int(x) for x in t["tokens"]], terms, capacity, idf, mean)
        rows = []
        for b in boxes:
            name = f"{t.doc_id[b[0]]}-{t.part[b[0]]}"
            used = sum(int(t.tokens[i]) for i in b) / capacity
            rows += [(name, t.doc_id[i], t.part[i], t.parts[i], t.tokens[i], t.start_token[i], used) for i in b]
        return pd.DataFrame(rows, columns=["container", "doc_id", "part", "parts", "tokens", "start_token", "fill"])

    laid = small.repartitionByRange(partitions, "lead", "tokens", "doc_id").sortWithinPartitions("lead", "tokens", "doc_id").drop("lead")
    schema = "container string, doc_id long, part int, parts int, tokens int, start_token int, fill double"
    packed = laid.mapInPandas(fill, schema)
    name = F.concat_ws("-", "doc_id", "part")
    whole = items.filter(f"tokens = {capacity}").select(name.alias("container"), "doc_id", "part", "parts", "tokens", "start_token", F.lit(1.0).alias("fill"))
    empty = items.filter("tokens = 0").select(F.lit(None).cast("string").alias("container"), "doc_id", "part", "parts", "tokens", "start_token", F.lit(None).cast("double").alias("fill"))
    return packed.unionByName(whole).unionByName(empty)
