"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of order four over lower-case letters and blanks (everything between
letters is one blank). Counts come from all rows to learn from; discounting, continuation counts
and interpolation are joins and aggregations, one step for each order. What the tasks need to score
is kept in sorted arrays of hashes, one for each order, with the log-probabilities of all languages
beside them. A text gets the language of the lowest cross-entropy per character; one that no model
explains, measured against how each model explains its own language, is rejected.

The arrays grow with the corpus and lose nothing: hashing is one to one. They are cut into parts by the
letter before a window's last, so that a part holds all that its windows look up, of whatever order;
a part is bounded, and texts are scored part after part. A letter is told by the lower 16 bits of its
code point, so the rarer letters beyond U+FFFF share values with others.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from driftline.llm.common import map_batches, mix, offsets_of, rows_a_batch
from driftline.staging import staged

ORDER = 4
UNKNOWN = "und"
#: Values (entries by languages) of a part of the model, which is broadcast at a time.
PART_VALUES = 1 << 24
#: Texts that a task takes at a time.
ROWS_AT_A_TIME = 1_000
#: A text is rejected when its cross-entropy exceeds its language's mean by this share of it plus
#: this many standard errors (characters within an order depend on each other).
SLACK, STANDARD_ERRORS = 0.5, 6.0
#: Characters that count as independent evidence for the score at most.
EVIDENCE = 100
_BLANK = 32
_FLUSH = 1 << 21
#: Characters that a task turns into windows at a time, or one text if it is longer.
_CHARACTERS = 1 << 18


def _folded() -> np.ndarray:
    """For each code point its lower-case letter, 16 bits of it; 32 for what is no letter."""
    out = np.full(0x110000, _BLANK, dtype=np.uint16)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            out[point] = (ord(low[0]) & 0xFFFF) or 1
    return out


def _grams(texts: list[str | None], fold: np.ndarray):
    """Packed four-character windows of all texts, and the bounds of each text's windows.

    A window ends at each character of a text; before its first character stand blanks. Runs of
    blanks count as one. A text without letters has no windows.
    """
    joined = "".join("    " + (t or "") for t in texts)
    points = fold[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.uint64)
    starts = offsets_of([len(t or "") + 4 for t in texts])
    blank = points == _BLANK
    repeated = np.zeros(len(points), dtype=bool)
    repeated[1:] = blank[1:] & blank[:-1]
    for k in range(4):  # the blanks before a text stay
        repeated[starts[:-1] + k] = False
    inside = np.flatnonzero(~repeated)
    points = points[inside]
    bounds = np.searchsorted(inside, starts)
    packed = points.copy()
    for k in range(1, ORDER):
        packed[k:] |= points[:-k] << np.uint64(16 * k)
    real = np.ones(len(points), dtype=bool)
    for k in range(4):
        real[bounds[:-1] + k] = False
    # a blank right after the leading ones repeats them; texts without letters lose all windows
    after = bounds[:-1] + 4
    after = after[after < bounds[1:]]
    real[after[points[after] == _BLANK]] = False
    return packed[real], offsets_of(np.add.reduceat(real, bounds[:-1]) if len(texts) else [])


def _parts(texts):
    """Slices of a list of texts with at most _CHARACTERS characters each, or a single text."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > _CHARACTERS and i > start:
            yield slice(start, i)
            start, size = i, len(text or "")
    if start < len(texts):
        yield slice(start, len(texts))


def _count_batches(sent_fold):
    def run(batches):
        fold = sent_fold.value
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows():
            for lang, (grams, counts) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(counts)],
                    names=["lang", "gram", "n"],
                )

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist())
            texts = batch.column(1).to_pylist()
            for lang in set(langs.tolist()):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for part in _parts(own):
                    found = np.unique(_grams(own[part], fold)[0], return_counts=True)
                    held[lang] = _add(held[lang], found) if lang in held else found
            if sum(len(g) for g, _ in held.values()) > _FLUSH:
                yield from rows()
                held = {}
        yield from rows()

    return run


def _add(a, b):
    grams = np.concatenate([a[0], b[0]])
    counts = np.concatenate([a[1], b[1]])
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 16)


def _shorter(gram: Column, order: int) -> Column:
    """A gram of ``order`` characters without its first."""
    return gram.bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))


class Tables:
    """One part of the model: for each order, sorted hashes with values for all languages."""

    def __init__(self, grams, contexts, unknown: float, languages: int):
        self.grams, self.contexts, self.unknown, self.languages = grams, contexts, unknown, languages

    def log_probabilities(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of each window's last character after the others; one column for each language."""
        if order == 0:
            return np.broadcast_to(self.unknown, (len(packed), self.languages)).astype(np.float32)
        out, missing = _look_up(*self.grams[order], packed)
        if len(missing):
            # backed off: the weight that the context leaves to lower orders, times the lower order
            rest = packed[missing]
            lower = self.log_probabilities(rest & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
            weight, unseen = _look_up(*self.contexts[order], rest >> np.uint64(16))
            weight[unseen] = 0
            out[missing] = weight + lower
        return out


class Model:
    """Learned languages, how each explains its own text, and the tables of its parts.

    ``values`` has a row for each gram and context of all orders. ``places`` tells for each letter the
    first of its parts and their number; a letter with several is cut by the letter before it.
    """

    def __init__(self, languages, unknown=0.0, mean=None, spread=None, values=None, places=None, parts=0):
        self.languages, self.unknown, self.mean, self.spread = languages, unknown, mean, spread
        self.values, self.places, self.parts = values, places, parts

    def tables(self, part: int) -> Tables:
        """All that the windows of a part look up; at most about PART_VALUES values."""
        letters = np.flatnonzero(self.places[1])
        places = self.values.sparkSession.createDataFrame(
            [(int(i), int(self.places[0][i]), int(self.places[1][i])) for i in letters],
            "letter int, first int, parts int",
        )
        own = F.col("letter").isNull() | (F.lit(part) == F.col("first") + F.col("before") % F.col("parts")) | (
            F.col("before").isNull() & F.lit(part).between(F.col("first"), F.col("first") + F.col("parts") - 1)
        )
        rows = (  # at most 65,536 letters
            self.values.join(F.broadcast(places), "letter", "left").where(own)
            .drop("letter", "before", "first", "parts").toArrow()
        )
        orders, context = rows.column("order").to_numpy(), rows.column("context").to_numpy()
        hashes = _hash(rows.column("gram").to_numpy().view(np.uint64))
        matrix = np.stack([rows.column(f"v{i}").to_numpy() for i in range(len(self.languages))], axis=1)

        def sorted_rows(order: int, of_context: bool):
            at = np.flatnonzero((orders == order) & (context == of_context))
            at = at[np.argsort(hashes[at])]
            return hashes[at], matrix[at]

        grams, contexts = ({o: sorted_rows(o, c) for o in range(1, ORDER + 1)} for c in (False, True))
        return Tables(grams, contexts, self.unknown, len(self.languages))

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """Of each window's last character, from all parts."""
        out = np.zeros((len(packed), len(self.languages)), np.float32)
        part = _part_of(packed, self.places)
        for k in np.unique(part).tolist():
            out[part == k] = self.tables(k).log_probabilities(packed[part == k])
        return out


def _part_of(packed: np.ndarray, places) -> np.ndarray:
    first, parts = places
    letter = (packed >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)
    before = (packed >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64)
    return first[letter] + before % np.maximum(parts[letter], 1)


def _hash(packed: np.ndarray) -> np.ndarray:
    """One to one, so that equal hashes are equal grams."""
    return mix(mix(packed * np.uint64(0x9E3779B97F4A7C15)))


def _look_up(hashes, values, packed):
    if not len(hashes):
        return np.zeros((len(packed), values.shape[1]), np.float32), np.arange(len(packed))
    wanted = _hash(packed)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return values[at], np.flatnonzero(hashes[at] != wanted)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Models of all languages in ``lang_col``, from the whole text of all rows of ``docs``.

    Rows with a null language or text teach nothing. Without rows, no language is learned.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sent = docs.sparkSession.sparkContext.broadcast(_folded())
    counts = map_batches(
        known.select(F.col(lang_col).cast("string"), text_col), _count_batches(sent), "lang string, gram long, n long",
        ROWS_AT_A_TIME,
    ).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    with rows_a_batch(docs.sparkSession, ROWS_AT_A_TIME):
        top = staged(counts, "language-grams")
    sent.unpersist()
    languages = sorted(r[0] for r in top.select("lang").distinct().collect())
    if not languages:
        return Model([])

    # by order: counts of the highest, then in how many contexts a shorter gram continues
    tables = {ORDER: top}
    for order in range(ORDER - 1, 0, -1):
        above = tables[order + 1]
        tables[order] = above.groupBy("lang", _shorter(F.col("gram"), order + 1).alias("gram")).agg(
            F.count("*").alias("n")
        )
    langs = F.explode(F.array(*map(F.lit, languages))).alias("lang")
    letters = tables[1].select("gram").distinct().count() + 1
    below, weights = None, {}
    for order in range(1, ORDER + 1):
        table = staged(tables[order], f"language-order-{order}")
        singles = table.groupBy("lang").agg(
            F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")
        ).select("lang", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2")))
                 .otherwise(0.5).alias("discount"))
        totals = (
            table.groupBy("lang", _context(F.col("gram")).alias("context"))
            .agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            .join(F.broadcast(singles), "lang")
        )
        weights[order] = staged(totals, f"language-contexts-{order}")
        every = table.select("gram").distinct().select("gram", langs)
        lower = F.lit(1.0 / letters) if order == 1 else F.col("p_lower")
        joined = (
            every.join(table, ["lang", "gram"], "left")
            .withColumn("context", _context(F.col("gram")))
            .join(weights[order], ["lang", "context"], "left")
        )
        if order > 1:
            joined = joined.withColumn("shorter", _shorter(F.col("gram"), order)).join(
                below.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("p_lower")),
                ["lang", "shorter"],
            )
        seen = F.greatest(F.coalesce("n", F.lit(0)) - F.col("discount"), F.lit(0.0))
        p = F.when(F.col("total").isNull(), lower).otherwise(
            seen / F.col("total") + F.col("discount") * F.col("kinds") / F.col("total") * lower
        )
        below = staged(joined.select("lang", "gram", p.alias("p"), F.coalesce("n", F.lit(0)).alias("n")), f"language-p-{order}")
        tables[order] = below

    values = staged(reduce(DataFrame.unionByName, [
        rows for order in range(1, ORDER + 1) for rows in (
            _by_gram(tables[order].select("gram", "lang", F.log("p").alias("value")), languages, order, False),
            _by_gram(weights[order].select(
                F.col("context").alias("gram"), "lang",
                F.log(F.col("discount") * F.col("kinds") / F.col("total")).alias("value"),
            ), languages, order, True),
        )
    ]), "language-values")
    places, parts = _places(values, max(1, PART_VALUES // len(languages)))
    # how a language's own text fares: mean and spread of minus log p over all its characters
    own = {
        r["lang"]: r for r in tables[ORDER].groupBy("lang").agg(
            F.sum("n").alias("n"), F.sum(-F.log("p") * F.col("n")).alias("s"),
            F.sum(F.log("p") * F.log("p") * F.col("n")).alias("ss"),
        ).collect()
    }
    mean = np.array([own[k]["s"] / own[k]["n"] for k in languages])
    spread = np.sqrt(np.maximum(np.array([own[k]["ss"] / own[k]["n"] for k in languages]) - mean**2, 0))
    return Model(languages, np.log(1.0 / letters), mean, spread, values, places, parts)


def _by_gram(table: DataFrame, languages, order: int, context: bool) -> DataFrame:
    """A row for each gram or context: its order, the two letters that decide its part (null where it
    has none), and the values of all languages."""
    at = 0 if context else 16  # bits before the letter

    def letter(least: int, bits: int) -> Column:
        found = F.shiftrightunsigned("gram", bits).bitwiseAND(F.lit(0xFFFF)).cast("int")
        return found if order >= least else F.lit(None).cast("int")

    return table.groupBy("gram").agg(
        *(F.coalesce(F.max(F.when(F.col("lang") == k, F.col("value"))), F.lit(0.0)).cast("float").alias(f"v{i}")
          for i, k in enumerate(languages)),
    ).select(F.lit(order).alias("order"), F.lit(context).alias("context"), letter(2, at).alias("letter"),
             letter(3, at + 16).alias("before"), "*")


def _places(values: DataFrame, limit: int):
    """First part and number of parts of each letter, and the number of all parts. Letters fill a part
    up to ``limit`` rows; one with more rows gets parts of its own."""
    counts = values.where("letter is not null").groupBy("letter").agg(F.count("*").alias("n"))
    first, parts = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    part = filled = 0
    for letter, n in sorted(map(tuple, counts.collect())):  # at most 65,536 letters
        if filled and filled + n > limit:
            part, filled = part + 1, 0
        first[letter], parts[letter] = part, -(-n // limit)
        part, filled = part + parts[letter] - 1, filled + n if n <= limit else limit
    return (first, parts), int(part) + 1


def _add_part(sums: np.ndarray, tables: Tables, places, part: int, packed, bounds) -> None:
    """Add the log-probabilities of a part's windows to the sums of their texts."""
    n = np.diff(bounds)
    if places[0].any() or places[1].max() > 1:  # more than one part
        own = _part_of(packed, places) == part
        n = np.bincount(np.repeat(np.arange(len(n)), n)[own], minlength=len(n))
        packed = packed[own]
    some = np.flatnonzero(n)
    if len(some):
        logs = tables.log_probabilities(packed)
        sums[some] += np.add.reduceat(logs, offsets_of(n)[some], axis=0, dtype=np.float64)


def _decided(languages, mean, spread, sums: np.ndarray, n: np.ndarray):
    """Languages, scores and rejections of texts with these log-probabilities and numbers of windows."""
    lang = np.full(len(n), UNKNOWN, dtype=object)
    score, rejected = np.zeros(len(n)), np.ones(len(n), dtype=bool)
    some = n > 0
    if languages and some.any():
        entropy = -sums[some] / n[some, None]
        best = entropy.argmin(axis=1)
        least = entropy.min(axis=1)
        odds = np.exp(-(entropy - least[:, None]) * np.minimum(n[some], EVIDENCE)[:, None])
        lang[some] = np.array(languages, dtype=object)[best]
        score[some] = 1 / odds.sum(axis=1)
        limit = mean[best] * (1 + SLACK) + STANDARD_ERRORS * spread[best] * np.sqrt(ORDER / n[some])
        rejected[some] = least > limit
    return lang, score, rejected


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected (replaced if there already).

    A null text or one without letters is ``und`` with score 0 and rejected, as is every text when no
    language was learned. A text's score is the share of its language in the odds of all. Repeated
    rows are predicted each. The model is broadcast a part at a time; with more than one, the rows are
    written out with the sums so far after each but the last.
    """
    spark = docs.sparkSession
    new = ["lang_pred", "score", "rejected"]
    out = docs.drop(*new)
    names, at = out.columns, out.columns.index(text_col)
    carried = "sums"
    while carried in names:
        carried = f"_{carried}"
    last = max(model.parts, 1) - 1
    for part in range(last + 1):
        tables = model.tables(part) if model.parts else None
        sent = spark.sparkContext.broadcast(
            (model.languages, model.mean, model.spread, model.places, tables, _folded())
        )
        schema = T.StructType([f for f in out.schema.fields if f.name != carried])
        if part < last:
            schema.add(carried, T.ArrayType(T.DoubleType()))
        else:
            schema.add(new[0], T.StringType()).add(new[1], T.DoubleType()).add(new[2], T.BooleanType())
        out = map_batches(out, _scorer(sent, part, last, at, len(names), schema.names), schema, ROWS_AT_A_TIME)
        if part < last:
            with rows_a_batch(spark, ROWS_AT_A_TIME):
                out = staged(out, "language-sums")
            sent.unpersist()
    return out


def _scorer(sent, part: int, last: int, at: int, width: int, names: list[str]):
    """Adds a part's sums to the rows, or decides where it is the last; the first ``width`` columns stay."""
    def run(batches):
        languages, mean, spread, places, tables, fold = sent.value
        k = len(languages)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            sums, n = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
            if batch.num_columns > width:
                sums += batch.column(width).flatten().to_numpy().reshape(len(texts), k)
            for piece in _parts(texts):
                packed, bounds = _grams(texts[piece], fold)
                n[piece] = np.diff(bounds)
                if tables is not None:
                    _add_part(sums[piece], tables, places, part, packed, bounds)
            if part < last:
                new = [pa.array(list(sums), pa.list_(pa.float64()))]
            else:
                lang, score, rejected = _decided(languages, mean, spread, sums, n)
                new = [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=names)
    return run
