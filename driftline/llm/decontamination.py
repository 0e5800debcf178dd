"""Benchmark decontamination by spaced-seed hashing.

A mask fixes which words of a window count; the others are ignored, so a window hashes alike after
a substitution at an ignored place. Windows of benchmark items are hashed under every mask, and the
windows of documents meet them on equal hashes. Each hit fixes an alignment of a document and an
item; the words of both are compared along it, substitutions included, and the best of the stretches
that are long enough and agree well enough is the overlap.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import (
    map_batches, mix, offsets_of, rows_a_batch, text_key, without_texts, word_hash_memo,
)
from driftline.staging import scratch_path, staged

#: 1: the word counts, 0: it is ignored. Six words count in each.
MASKS = ("111111", "1101111", "11011011", "111001011", "1010110011")
MIN_MATCHED = 10
MIN_AGREEMENT = 0.75
WORDS_PER_PASS = 1 << 21
#: Documents whose windows are hashed at a time.
ROWS_AT_A_TIME = 1_000
#: Pairs of equal windows that are listed at a time.
HITS_AT_A_TIME = 1 << 20
_BITS = 22

OVERLAP = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_matched long"


def _windows(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, salt, dtype=np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
    return out


def word_hashes(text: str, memo) -> np.ndarray:
    """Hashes of the words of a text: lower case for A-Z, cut at ASCII white space."""
    words = text.encode("utf-8", "replace").lower().split()
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


class Seeds:
    """Benchmark items and their windows under all masks, sorted by hash.

    An item with fewer words than a mask counts gives one window of all its words.
    """

    def __init__(self, item_ids, texts, masks=MASKS):
        memo = word_hash_memo()
        self.ids = item_ids
        self.words = [word_hashes(t or "", memo) for t in texts]
        weight = min(m.count("1") for m in masks)
        short = sorted({len(w) for w in self.words if 0 < len(w) < weight})
        self.masks = [*masks, *("1" * n for n in short)]
        hashes, befores, items, places = [], [], [], []
        for salt, mask in enumerate(self.masks):
            for i, words in enumerate(self.words):
                if salt >= len(masks) and len(words) != len(mask):
                    continue
                found = _windows(words, mask, salt)
                hashes.append(found)
                befores.append(np.concatenate([np.zeros(min(1, len(found)), np.uint64), found[:-1]]))
                items.append(np.full(len(found), i))
                places.append(np.arange(len(found)))
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(self.hashes)
        self.hashes = self.hashes[order]
        # the item's window one word before, under the same mask
        self.before = np.concatenate([np.zeros(0, np.uint64), *befores])[order]
        self.items = np.concatenate([np.zeros(0, np.int64), *items])[order].astype(np.int64)
        self.places = np.concatenate([np.zeros(0, np.int64), *places])[order].astype(np.int64)
        self.maybe = np.zeros(1 << _BITS, dtype=bool)
        self.maybe[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, firsts: np.ndarray):
        """Arrays (place in ``words``, item, place in the item) of equal windows; ``firsts`` marks the
        first word of each text.

        Of equal windows that follow each other in both texts only the first is returned: they have the
        same alignment. So repetitive texts give one hit for each alignment, not one for each pair of words.
        """
        out = [[np.zeros(0, np.int64)] * 3]
        for salt, mask in enumerate(self.masks):
            windows = _windows(words, mask, salt)
            at = np.flatnonzero(self.maybe[(windows >> np.uint64(64 - _BITS)).astype(np.int64)])
            low = np.searchsorted(self.hashes, windows[at], side="left")
            count = np.searchsorted(self.hashes, windows[at], side="right") - low
            at, low, count = at[count > 0], low[count > 0], count[count > 0]
            ends = offsets_of(count)
            start = 0
            while start < len(at):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + HITS_AT_A_TIME, side="right")) - 1)
                n = count[start:stop]
                within = np.arange(n.sum()) - np.repeat(offsets_of(n)[:-1], n)
                seed, place = np.repeat(low[start:stop], n) + within, np.repeat(at[start:stop], n)
                new = firsts[place] | (self.places[seed] == 0) | (windows[place - 1] != self.before[seed])
                out.append([place[new], self.items[seed[new]], self.places[seed[new]]])
                start = stop
        return [np.concatenate(x) for x in zip(*out, strict=True)]


def best_stretch(same: np.ndarray, agreement: float, least: int) -> tuple[int, int, int] | None:
    """Start, end and matches of the stretch with the highest sum, where a match is worth
    ``1 - agreement`` and a mismatch costs ``agreement``, among those with ``least`` matches or more;
    null if none of them agrees at least that well."""
    matches = offsets_of(np.where(same, 1, 0))
    sums = matches - agreement * np.arange(len(same) + 1)
    lowest = np.minimum.accumulate(sums)
    # a stretch to an end has enough matches if it starts at this place or before
    last = np.searchsorted(matches, matches - least, side="right") - 1
    gain = np.where(last >= 0, sums - lowest[last], -np.inf)
    end = int(np.argmax(gain))
    if gain[end] < -1e-9:  # rounding of the sums
        return None
    start = int(np.argmax(sums == lowest[last[end]]))
    return start, end, int(matches[end] - matches[start])


def overlaps(words, bounds, seeds: Seeds, min_matched: int, agreement: float):
    """Verified overlaps of concatenated documents: (document, item, starts, words, matches).

    The best alignment of each document and item that has ``min_matched`` matching words, or all
    words of a shorter item.
    """
    firsts = np.zeros(len(words) + 1, dtype=bool)
    firsts[bounds] = True
    at, item, place = seeds.hits(words, firsts)
    doc = np.searchsorted(bounds, at, side="right") - 1
    # one alignment: the place where the item's first word would stand
    keys = np.unique(np.stack([doc, item, at - place], axis=1), axis=0)
    best = {}
    for d, i, first in keys.tolist():
        own = seeds.words[i]
        low = max(first, int(bounds[d]))
        high = min(first + len(own), int(bounds[d + 1]))
        if high <= low:
            continue
        same = words[low:high] == own[low - first:high - first]
        stretch = best_stretch(same, agreement, min(min_matched, len(own)))
        if stretch is None:
            continue
        start, end, matched = stretch
        found = (matched, -(end - start), low - int(bounds[d]) + start, low - first + start)
        if (d, i) not in best or found[:2] > best[d, i][:2]:
            best[d, i] = found
    return [(d, i, a, b, -n, m) for (d, i), (m, n, a, b) in sorted(best.items())]


def _item_blocks(benchmark: DataFrame, words_per_pass: int):
    """The items in blocks of about ``words_per_pass`` words, each small enough to be broadcast."""
    spark = benchmark.sparkSession
    path = scratch_path(spark, "benchmark-items")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    items.write.parquet(path)
    items = spark.read.schema(items.schema).parquet(path)
    total = items.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    blocks = max(1, -(-total // words_per_pass))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        yield spark.sparkContext.broadcast(
            (rows.column("item_id").to_pylist(), rows.column("text").to_pylist())
        )


def _batch_words(texts, memo):
    arrays = [word_hashes(t or "", memo) for t in texts]
    return np.concatenate([np.zeros(0, np.uint64), *arrays]), offsets_of([len(a) for a in arrays])


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, min_matched: int = MIN_MATCHED,
    agreement: float = MIN_AGREEMENT, words_per_pass: int = WORDS_PER_PASS,
) -> DataFrame:
    """Rows (doc_id, item_id, doc_start, item_start, n_words, n_matched): overlaps in words, one for
    each document and item that share one. Documents without an overlap have no row.

    Items are broadcast in blocks of ``words_per_pass`` words and the documents are scanned once for
    each block, without a shuffle. Null or empty texts match nothing, a null item or document id stays
    null, repeated documents and items match each, other columns are ignored, and an empty table on
    either side gives no rows.
    """
    found = None
    for sent in _item_blocks(benchmark, words_per_pass):
        part = map_batches(
            docs.select(F.col("doc_id").cast("long"), "text"), _finder(sent, min_matched, agreement), OVERLAP,
            ROWS_AT_A_TIME,
        )
        found = part if found is None else found.unionByName(part)
    return found


def _finder(sent, min_matched, agreement):
    names = [c.split()[0] for c in OVERLAP.split(", ")]

    def run(batches):
        seeds, memo = Seeds(*sent.value), word_hash_memo()
        for batch in batches:
            words, bounds = _batch_words(batch.column(1).to_pylist(), memo)
            rows = overlaps(words, bounds, seeds, min_matched, agreement)
            if rows:
                doc, item, *rest = map(list, zip(*rows, strict=True))
                columns = [batch.column(0).take(pa.array(doc)), pa.array([seeds.ids[i] for i in item], pa.int64()), *(pa.array(r, pa.int64()) for r in rest)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, min_matched: int = MIN_MATCHED,
    agreement: float = MIN_AGREEMENT, words_per_pass: int = WORDS_PER_PASS,
) -> DataFrame:
    """The documents without an overlap, all columns kept.

    A document is judged by its text alone. The texts go to Python a few at a time and only the keys of those
    that share a passage come back, a table that is written out; the documents are then read once more and
    meet it by text, broadcast unless many are dropped. Null or empty texts stay, repeated rows stay or go
    together. An empty benchmark keeps all documents.
    """
    texts = docs.where("text is not null").select(text_key(F.col("text")).alias("key"), "text")
    found = None
    with rows_a_batch(docs.sparkSession, ROWS_AT_A_TIME):
        for sent in _item_blocks(benchmark, words_per_pass):
            judged = map_batches(texts, _judge(sent, min_matched, agreement), "key binary", ROWS_AT_A_TIME)
            part = staged(judged, "contaminated-texts")
            sent.unpersist()
            found = part if found is None else found.unionByName(part)
    return without_texts(docs, found)


def _judge(sent, min_matched, agreement):
    """Keys of the texts (key, text) that share a passage with an item."""
    def run(batches):
        seeds, memo = Seeds(*sent.value), word_hash_memo()
        for batch in batches:
            words, bounds = _batch_words(batch.column("text").to_pylist(), memo)
            shared = sorted({row[0] for row in overlaps(words, bounds, seeds, min_matched, agreement)})
            yield batch.select(["key"]).take(pa.array(shared, pa.int64()))
    return run
