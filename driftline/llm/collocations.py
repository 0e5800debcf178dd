"""Phrase collocations, counted on a prefix-free parse.

The words of a piece are cut into chunks where the hash of ``OVERLAP`` words is 0 modulo ``TRIGGER``,
so equal passages are cut alike wherever they stand; neighbouring chunks share the ``OVERLAP`` trigger
words. The distinct chunks with their frequencies are the dictionary. Phrases are counted inside the
distinct chunks, each weighted by the chunk's frequency; a phrase that starts in the shared words is
counted by the later chunk only, so every occurrence counts once.

A phrase is frequent only if both phrases that are one word shorter are. So counts go up by length, and
positions that a filter of the frequent shorter phrases excludes are not counted. Filters are bitmaps of
at most ``FILTER_BITS``: a false hit costs work and changes nothing, as the last passes count texts. Once
the frequent pairs are known, the dictionary is cut down to the runs of them.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.llm.common import map_batches, mix, shingle_hashes
from driftline.staging import staged

MAX_WORDS = 5
MIN_COUNT = 100
PER_LANGUAGE = 2000
OVERLAP = MAX_WORDS - 1
#: One position in so many ends a chunk; longer stretches without a trigger are cut after LONGEST words.
TRIGGER = 16
LONGEST = 4096
#: A filter has 32 bits for each frequent phrase, and 2**27 (16 MB) at most.
BITS_PER_PHRASE, FILTER_BITS = 32, 27
ROWS_AT_A_TIME = 1000
BYTES_AT_A_TIME = 1 << 20
HELD = 1 << 20

# What ends a piece, and the byte that stands for it, which UTF-8 never uses.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BREAK = b"\xff"
_LOWER = bytes.maketrans(
    bytes(range(65, 91)) + b"\t" + PIECE_ENDS, bytes(range(97, 123)) + b" " + BREAK * len(PIECE_ENDS)
)
_BLANKS = re.compile(b"  +")
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---- words of a buffer ----------------------------------------------------------

class Hasher:
    """64-bit hashes of words that lie in one buffer of bytes, for all words at once."""

    def __init__(self):
        self.powers = np.ones(1, dtype=np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, blank: np.ndarray) -> np.ndarray:
        """``starts`` are the words' first bytes; every byte up to the next start is the word's or ``blank``."""
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        lengths = np.diff(np.append(starts, len(data)))
        if lengths.max() > len(self.powers):
            self.powers = np.cumprod(np.append(np.uint64(1), np.full(int(lengths.max()), _STEP)), dtype=np.uint64)
        place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
        values = (data[starts[0]:] + np.uint64(1)) * self.powers[place]
        values[blank[starts[0]:]] = 0
        return mix(np.add.reduceat(values, starts - starts[0]))


# ---- parse --------------------------------------------------------------------

def chunks_of(text: bytes, hasher: Hasher) -> list[tuple[bytes, int]]:
    """(chunk, own) for all chunks of a lower-cased text: ``own`` words of a chunk start phrases that it counts."""
    text = _BLANKS.sub(b" ", text) if b"  " in text else text
    data = np.frombuffer(text, dtype=np.uint8)
    ends_piece = data == BREAK[0]
    blank = ends_piece | (data == 32)
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1])) if len(data) else np.zeros(0, np.int64)
    if not len(starts):
        return []
    stops = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    piece = np.cumsum(ends_piece)[starts]
    cut = np.append(True, piece[1:] != piece[:-1])
    ends = np.append(np.flatnonzero(cut)[1:], len(starts))[np.cumsum(cut) - 1]  # of each word's piece
    if len(starts) >= OVERLAP:
        triggers = np.flatnonzero(shingle_hashes(hasher(data, starts, blank), OVERLAP) % np.uint64(TRIGGER) == 0)
        cut[triggers[ends[triggers] - triggers >= OVERLAP]] = True
    first = np.flatnonzero(cut)
    ends = ends[first]
    own_ends = np.minimum(ends, np.append(first[1:], len(starts)))
    if (own_ends - first).max() > LONGEST:
        first = np.concatenate([np.arange(a, b, LONGEST) for a, b in zip(first, own_ends, strict=True)])
        ends = ends[np.searchsorted(ends, first, side="right")]
        own_ends = np.minimum(ends, np.append(first[1:], len(starts)))
    lasts = np.minimum(own_ends + OVERLAP, ends)
    return [
        (text[a:b], own) for a, b, own in
        zip(starts[first].tolist(), stops[lasts - 1].tolist(), (own_ends - first).tolist(), strict=True)
    ]


def _parse(batches):
    hasher = Hasher()
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        groups: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(langs, texts, strict=True):
            for part in _whole_pieces(text.translate(_LOWER)):
                groups.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part)
                if sizes[lang] >= BYTES_AT_A_TIME:
                    yield from _chunk_rows(lang, groups.pop(lang), hasher)
                    del sizes[lang]
        for lang, group in groups.items():
            yield from _chunk_rows(lang, group, hasher)


def _whole_pieces(text: bytes):
    """A long text in parts, cut where a piece ends."""
    at = 0
    while len(text) - at > BYTES_AT_A_TIME:
        cut = text.rfind(BREAK, at, at + BYTES_AT_A_TIME) + 1 or text.find(BREAK, at) + 1
        if not cut:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _chunk_rows(lang, texts, hasher):
    found = chunks_of(BREAK.join(texts), hasher)
    if found:
        chunks, own = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(lang), len(own)), pa.array(chunks, pa.binary()).cast(pa.string()), pa.array(own, pa.int32())],
            names=["lang", "chunk", "own"],
        )


def parse(docs: DataFrame) -> DataFrame:
    """The dictionary: rows (lang, chunk, own, n), each distinct chunk of a language with its frequency."""
    given = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")
    ).where("text <> ''")
    chunks = map_batches(given, _parse, "lang string, chunk string, own int", ROWS_AT_A_TIME)
    return staged(chunks.groupBy("lang", "chunk", "own").agg(F.count("*").alias("n")), "parse-dictionary")


# ---- counts -------------------------------------------------------------------

def _slices(batches):
    """Batches of chunks, cut to about BYTES_AT_A_TIME of text or one chunk."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(int(np.searchsorted(ends, done + BYTES_AT_A_TIME, side="right")), at + 1)
            yield batch.slice(at, stop - at)
            at = stop


class _Words:
    """The words of a batch of chunks, and the hashes of the phrases that start at each.

    ``left`` counts the words from here to the chunk's end, ``counted`` marks starts that are the chunk's own.
    """

    def __init__(self, batch: pa.RecordBatch, hasher: Hasher):
        chunks = batch.column(1).cast(pa.binary())
        bounds = np.frombuffer(chunks.buffers()[1], dtype=np.int32)[chunks.offset:chunks.offset + len(chunks) + 1].astype(np.int64)
        self.data = np.frombuffer(chunks.buffers()[2], dtype=np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        blank = self.data == 32
        begins = np.append(False, blank[:-1])
        begins[bounds[:-1]] = True
        self.starts = np.flatnonzero(begins)
        self.rows = np.searchsorted(bounds, self.starts, side="right") - 1
        lengths = np.bincount(self.rows, minlength=len(chunks))
        place = np.arange(len(self.starts)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.left = lengths[self.rows] - place
        self.stops = np.append(self.starts[1:], len(self.data)) - (self.left > 1)
        self.counted = place < batch.column(2).to_numpy()[self.rows]
        self.weight = batch.column(3).to_numpy()
        self.langs = batch.column(0)
        coded = self.langs.dictionary_encode()
        salts = np.array([xxhash.xxh3_64_intdigest(t) for t in coded.dictionary.to_pylist()], dtype=np.uint64)
        self.salt = mix(salts)[coded.indices.to_numpy()][self.rows]
        self.words = hasher(self.data, self.starts, blank)

    def levels(self, filters: list[np.ndarray]):
        """(length, hashes, possible) for lengths from 1 on, one more than there are filters.

        ``possible`` marks the starts of phrases both of whose shorter phrases pass the filters.
        """
        hashes = mix(self.salt * _STEP + self.words)
        possible = np.ones(len(hashes), dtype=bool)
        for length in range(1, len(filters) + 2):
            if length > 1:
                passed = possible & _passes(filters[length - 2], hashes)
                possible = passed & np.append(passed[1:], False) & (self.left >= length)
                hashes = hashes.copy()
                hashes[:1 - length] = mix(hashes[:1 - length] * _STEP + self.words[length - 1:])
            yield length, hashes, possible

    def phrase(self, start: int, length: int) -> bytes:
        return self.data[self.starts[start]:self.stops[start + length - 1]].tobytes()

    def lang(self, start: int) -> str:
        return self.langs[int(self.rows[start])].as_py()


def _passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and the sum of its weights, in whole numbers."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], order[at], np.add.reduceat(weights, at) if len(at) else weights


def _counter(sent):
    """Rows (gram, n): hashed phrases one word longer than the last filter's."""
    def run(batches):
        filters, hasher, held, size = sent.value, Hasher(), [], 0

        def rows():
            keys, _, n = _sums(*(np.concatenate(c) for c in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["gram", "n"])

        for batch in _slices(batches):
            words = _Words(batch, hasher)
            *_, (_, hashes, possible) = words.levels(filters)
            at = np.flatnonzero(possible & words.counted)
            held.append((hashes[at], words.weight[words.rows[at]]))
            size += len(at)
            if size >= HELD:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()
    return run


def _texts(sent, lengths):
    """Rows (lang, phrase, words, n) of the phrases of some lengths that pass all filters."""
    def run(batches):
        filters, hasher, counts = sent.value, Hasher(), {}

        def rows():
            langs, phrases = zip(*counts, strict=True)
            sizes, n = zip(*counts.values(), strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                 pa.array(sizes, pa.int32()), pa.array(n, pa.int64())], names=["lang", "phrase", "words", "n"],
            )

        for batch in _slices(batches):
            words = _Words(batch, hasher)
            for length, hashes, possible in words.levels(filters[:-1]):
                if length not in lengths:
                    continue
                at = np.flatnonzero(possible & words.counted & _passes(filters[length - 1], hashes))
                _, place, n = _sums(hashes[at], words.weight[words.rows[at]])
                for start, more in zip(at[place].tolist(), n.tolist(), strict=True):
                    key = words.lang(start), words.phrase(start, length)
                    counts[key] = (length, more + counts.get(key, (0, 0))[1])
            if len(counts) >= HELD // 4:
                yield rows()
                counts = {}
        if counts:
            yield rows()
    return run


def _runs(sent):
    """Rows (lang, chunk, own, n): the longest runs of words of which each pair passes the filters."""
    def run(batches):
        filters, hasher = sent.value, Hasher()
        for batch in _slices(batches):
            words = _Words(batch, hasher)
            *_, (_, hashes, possible) = words.levels(filters[:1])
            pair = possible & _passes(filters[1], hashes)  # of this word and the next
            first = np.flatnonzero(pair & ~np.append(False, pair[:-1]))
            last = np.flatnonzero(pair & ~np.append(pair[1:], False)) + 1
            # the starts that the chunk counts are its leading words
            own = np.add.reduceat(np.append(words.counted, False).astype(np.int64), np.stack([first, last + 1], 1).ravel())[::2] if len(first) else first
            kept = own > 0
            first, last, own = first[kept], last[kept], own[kept]
            rows = words.rows[first]
            texts = [words.data[a:b].tobytes() for a, b in zip(words.starts[first].tolist(), words.stops[last].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [words.langs.take(pa.array(rows)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(own, pa.int32()),
                 pa.array(words.weight[rows])], names=["lang", "chunk", "own", "n"],
            )
    return run


def _filter(frequent: DataFrame) -> np.ndarray:
    """Bitmap of the leading bits of hashed phrases, set in groups of 64 before the driver gets them."""
    bits = min(FILTER_BITS, max(6, int(frequent.count() * BITS_PER_PHRASE).bit_length()))
    bit = F.shiftrightunsigned("gram", 64 - bits)
    rows = (
        frequent.groupBy(F.shiftright(bit, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - bits}) & 63 as int))")).alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(1 << (bits - 6), dtype=np.uint64)
    bitmap[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bitmap


def _counted(dictionary: DataFrame, filters: list[np.ndarray], min_count: int) -> np.ndarray:
    """Filter of the frequent phrases one word longer than those of the last filter."""
    sent = dictionary.sparkSession.sparkContext.broadcast(list(filters))
    grams = map_batches(dictionary, _counter(sent), "gram long, n long")
    frequent = staged(
        grams.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("gram"), "frequent-grams"
    )
    sent.destroy()
    return _filter(frequent)


def _with_texts(dictionary: DataFrame, filters: list[np.ndarray], lengths: range, min_count: int) -> DataFrame:
    sent = dictionary.sparkSession.sparkContext.broadcast(filters)
    texts = map_batches(dictionary, _texts(sent, lengths), "lang string, phrase string, words int, n long")
    found = staged(
        texts.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count), "frequent-phrases"
    )
    sent.destroy()
    return found


def frequent_phrases(dictionary: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """Rows (lang, phrase, words, f): phrases of two to ``max_words`` words with at least ``min_count``
    occurrences, and the single words of which they are made."""
    if not 2 <= max_words <= MAX_WORDS:
        raise ValueError(f"chunks share {OVERLAP} words, so phrases have two to {MAX_WORDS}")
    spark = dictionary.sparkSession
    filters = [_counted(dictionary, [], min_count)]
    filters.append(_counted(dictionary, filters, min_count))
    sent = spark.sparkContext.broadcast(list(filters))
    runs = map_batches(dictionary, _runs(sent), "lang string, chunk string, own int, n long")
    short = staged(runs.groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n")), "runs-dictionary")
    sent.destroy()
    while len(filters) < max_words and filters[-1].any():
        filters.append(_counted(short, filters, min_count))
    phrases = _with_texts(short, filters, range(2, max_words + 1), min_count)
    made_of = phrases.where("words = 2").select("lang", F.explode(F.split("phrase", " ")).alias("chunk")).distinct()
    wanted = _counted(made_of.select("lang", "chunk", F.lit(1).alias("own"), F.lit(1).cast("long").alias("n")), [], 1)
    return phrases.unionByName(_with_texts(dictionary, [wanted], range(1, 2), min_count))


# ---- scores -------------------------------------------------------------------

def _part(first: int | Column, count: Column) -> Column:
    return F.array_join(F.slice("parts", first, count), " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (lang, phrase, a, l, r, n, score) of phrases of two words and more, at their lowest cut.

    The score of a cut is floor(1000 * a * n / (l * r)) in decimals of 38 digits, which holds for counts
    below 10**15.
    """
    counts = phrases.select("lang", F.col("phrase").alias("part"), "f")
    longer = phrases.where("words > 1").withColumn("parts", F.split("phrase", " "))
    cuts = longer.select("lang", "phrase", "words", "parts", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    sided = cuts.select(
        "lang", "phrase", "a", "cut", _part(1, F.col("cut")).alias("left"),
        _part(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"),
    )
    both = (
        sided.join(counts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(counts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .join(totals, "lang")
    )
    whole = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r", "n")}
    both = both.withColumn("_over", F.lit(1000).cast("decimal(4,0)") * (whole["a"] * whole["n"])).withColumn("_under", whole["l"] * whole["r"])
    lowest = both.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("_over div _under").alias("score"), "cut", "a", "l", "r", "n")).alias("best"))
    return lowest.select("lang", "phrase", *(f"best.{c}" for c in ("a", "l", "r", "n", "score")))


def contained(phrases: DataFrame) -> DataFrame:
    """Rows (lang, phrase, a): phrases that a phrase one word longer holds with the same count.

    That is enough for all longer ones: the phrases between have the same count as well.
    """
    longer = phrases.where("words > 2").withColumn("parts", F.split("phrase", " "))
    inner = F.array(_part(1, F.col("words") - 1), _part(2, F.col("words") - 1))
    return longer.select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("a")).distinct()


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, per_language: int = PER_LANGUAGE
) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the ``per_language`` best phrases of each language.

    Texts are lower-cased in A-Z, split into pieces at ``. , ; : ! ?`` and line ends and into words at blanks
    and tabs. A null language is ``und``, together with one of that name; null and empty texts and texts
    without words add nothing, every row of a repeated document counts, other columns are not read, and an
    empty table gives no rows. Equal scores rank by the higher count, then by the phrase's bytes.
    """
    dictionary = parse(docs)
    phrases = frequent_phrases(dictionary, max_words, min_count)
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))
    kept = scored(phrases, totals).join(contained(phrases), ["lang", "phrase", "a"], "left_anti")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_language)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
