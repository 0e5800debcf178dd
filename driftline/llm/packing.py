"""Packing of token sequences: shortest-pack-first over the length histogram.

Documents become identifiers, are cut into pieces of at most ``width`` and counted by length. The
histogram (at most ``width`` numbers) is packed on the driver: lengths are placed longest first,
each into the emptiest open pack that still takes it, and packs that look alike are kept as one
pattern with a count. The patterns, a few thousand at any input size, then meet the documents
again by rank: the r-th piece of a length fills the r-th place that patterns have for that length.
"""

import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from driftline.llm.common import Memo, map_batches
from driftline.staging import staged

WIDTH = 1024
END_ID = 0
RANKS_PER_SLICE = 2048

#: Text in these characters is split alike by the fast encoder, which is given the same ranks.
_PLAIN = "[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u024f]*"


def encoder(json_text: str, rank_lines: bytes | None, pattern: str | None):
    """A function from text to little-endian unsigned 32-bit identifiers.

    A plain text goes to the fast encoder as a whole, if its rank file is given. In other texts a
    blank before other text starts a new word in this family of models, so text is cut there and a
    bounded memo spares repeated words; each word goes to the fast encoder if it is plain, else to the
    tokenizer itself. Special strings have their own identifiers, as by the tokenizer's default.
    """
    import base64
    import re

    from tokenizers import Tokenizer

    slow = Tokenizer.from_str(json_text)
    slow.no_truncation()
    slow.no_padding()
    specials = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    fast = None
    if rank_lines and pattern:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_lines.splitlines())}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)
    plain = re.compile(_PLAIN)

    def is_plain(text: str) -> bool:
        return fast is not None and plain.fullmatch(text) is not None

    def ids_of(text: str) -> bytes:
        if is_plain(text):
            try:
                return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            except ValueError:  # its pattern matcher gives up on very long runs of white space
                pass
        return np.asarray(slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    memo = Memo(lambda word: ids_of(" " + word))
    after_blank, inner_blank = re.compile(r" \s|\s $"), re.compile(r" (?=\S)")

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if is_plain(text):
            return ids_of(text)
        if after_blank.search(text) or text[-1] == " ":
            words = inner_blank.split(text)
        else:
            words = text.split(" ")
        first = words[0]
        head = ids_of(first) if first else b""
        return head + b"".join(map(memo.__getitem__, words[1:]))

    return encode


def pack_histogram(counts: dict[int, int], width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a pack, longest first) with the number of packs of each.

    A placement adds at most two patterns, whatever the counts are.
    """
    packs = defaultdict(list)  # tokens in a pack -> [pattern, packs]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            used = min((u for u in packs if u + length <= width), default=0)
            if not used:
                # placed one by one, each new pack would be filled before the next is opened
                times = width // length
                full, rest = divmod(left, times)
                if full:
                    packs[length * times].append([(length,) * times, full])
                if rest:
                    packs[length * rest].append([(length,) * rest, 1])
                break
            pattern, free = packs[used].pop()
            placed = min(free, left)
            if placed < free:
                packs[used].append([pattern, free - placed])
            elif not packs[used]:
                del packs[used]
            packs[used + length].append([(*pattern, length), placed])
            left -= placed
    return [(pattern, n) for group in packs.values() for pattern, n in group]


def _places(patterns, width: int):
    """For each length: first ranks of runs of places, the first sequence and the offset of each run."""
    runs = {n: ([], [], []) for n in range(1, width + 1)}
    taken, first = defaultdict(int), 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            starts, sequences, offsets = runs[length]
            starts.append(taken[length])
            sequences.append(first)
            offsets.append(offset)
            taken[length] += n
            offset += length
        first += n
    return {k: tuple(np.array(x, dtype=np.int64) for x in v) for k, v in runs.items() if v[0]}


def pieces(
    docs: DataFrame, tokenizer_path: str, width: int = WIDTH, end_id: int = END_ID,
    rank_path: str | None = None, pattern: str | None = None, keep_ids: bool = False,
) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's identifiers and
    ``end_id``, cut into pieces of ``width`` and a remainder. ``ids`` are little-endian unsigned
    32-bit numbers."""
    sent = docs.sparkSession.sparkContext.broadcast((
        Path(tokenizer_path).read_text(), Path(rank_path).read_bytes() if rank_path else None, pattern,
    ))
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]

    def run(batches):
        encode = encoder(*sent.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, width):
                    part = ids[4 * start:4 * (start + width)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n, *[part] * keep_ids))
            columns = zip(*rows, strict=True)
            kinds = [pa.int64()] * 5 + [pa.binary()] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def pack(cut: DataFrame, width: int = WIDTH) -> DataFrame:
    """The pieces with (sequence_id, offset): their sequence and their place in it, gapless from 0.

    ``cut`` is written to the shared folder once, as it is read for the histogram and again for the
    ranks. Ranks are counted in slices of a length, by a hash of document and start, so a length that
    most pieces have is many tasks' work. Repeated rows are packed each; no rows give no rows.
    """
    spark = cut.sparkSession
    cut = staged(cut, "pieces")
    # at most ``width`` rows
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(pack_histogram(counts, width), width))
    slices = spark.createDataFrame(
        [(length, -(-n // RANKS_PER_SLICE)) for length, n in counts.items()], "length long, slices int"
    )
    sliced = cut.join(F.broadcast(slices), "length").withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "start"), F.col("slices"))
    )
    sizes = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "slice").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        sliced.withColumn("place", F.row_number().over(own)).join(first, ["length", "slice"])
        .withColumn("rank", F.col("first") + F.col("place") - 1)
        .select(*cut.columns, "rank")
    )

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length):
                starts, sequences, offsets = places.value[int(n)]
                own = length == n
                at = np.searchsorted(starts, rank[own], side="right") - 1
                sequence[own] = sequences[at] + rank[own] - starts[at]
                offset[own] = offsets[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return map_batches(ranked, run, f"{schema}, sequence_id long, `offset` long")
