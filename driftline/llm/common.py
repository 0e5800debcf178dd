"""What the operators of this subpackage share."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Batches = Iterator[pa.RecordBatch]

#: Keys of texts that are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 modulo 4. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def map_batches(df: DataFrame, fn: Callable[[Batches], Batches], schema, rows: int | None = None) -> DataFrame:
    """``mapInArrow``; batches without rows are not handed to ``fn``.

    With ``rows``, ``fn`` gets slices of at most so many rows: a step that gives one batch for each
    that it takes then holds, and sends, little at a time. Python workers outlive their tasks, so a
    task gives back what it has freed when it ends.
    """
    def run(batches: Batches) -> Batches:
        try:
            yield from fn(
                b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows or max(b.num_rows, 1))
            )
        finally:
            give_back_memory()

    return df.mapInArrow(run, schema)


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int):
    """Steps that run within send batches of at most so many rows to Python, so that executors hold
    little outside their heap; the session's own setting is put back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back_memory() -> None:
    """Return memory that Arrow and the C library hold for reuse to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def offsets_of(lengths) -> np.ndarray:
    """Start of each item, and the end of the last, in the concatenation of items of these lengths."""
    ends = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=ends[1:])
    return ends


class Memo(dict):
    """Results by key, emptied when ``limit`` keys are held, so that its memory is bounded."""

    def __init__(self, fn, limit: int = 1 << 18):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def word_hash_memo() -> Memo:
    """Hashes of words; few enough are held that each worker spends some ten MB on them."""
    import xxhash

    return Memo(lambda word: xxhash.xxh3_64_intdigest(word), 1 << 16)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` words, from the hashes of the words."""
    n = len(words) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast if a count finds at most ``rows`` rows; else joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def text_key(text: Column) -> Column:
    """The 32 bytes of a text's SHA-256; null for a null text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def without_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has no key in ``keys`` (a column ``key``); null texts stay."""
    dropped = broadcast_up_to(keys.distinct(), BROADCAST_KEYS)
    return docs.join(dropped, text_key(docs["text"]) == dropped["key"], "left_anti")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component): the smallest node that links (a, b) reach, for all nodes that have one.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each points neighbours to the
    smallest node known, and a logarithmic number of rounds is enough in practice. Every step is written
    out; nothing is collected but two numbers that tell whether a round changed anything.
    """
    from driftline.staging import staged

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        sided = both if large else both.where("b < a")
        least = staged(sided.groupBy("a").agg(F.min("b").alias("least")), "star-least")
        least = least.withColumn("least", F.least("least", "a"))
        joined = sided.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
                least.select("a", F.col("least").alias("b"))
            )
        return staged(out.where("a <> b").distinct(), "star-edges")

    edges = staged(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        edges = star(star(edges, True), False)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
