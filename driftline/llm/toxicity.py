"""Toxicity scores by a counterfactually regularised classifier.

A logistic model over the words of a text and their beginnings (stems of coined words). Identity
terms of labelled texts are swapped for others of their kind; the squared change of the score that
a swap makes is a penalty beside the loss, so that the mere mention of a group does not raise it.
"""

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import Memo, map_batches
from driftline.staging import staged

#: Labelled rows of a class that are learned from at most, by the hash of their id.
ROWS_PER_CLASS = 8_000
#: Features that are kept at most, those that tell the classes apart best.
MAX_FEATURES = 50_000
MIN_ROWS = 4
FEATURE_BITS = 40
PREFIXES = (3, 4, 5, 6)
#: Terms of a row name groups of one kind; each is swapped for the next.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "lesbian", "bisexual", "straight"), ("transgender", "cisgender"),
    ("immigrants", "natives"), ("immigrant", "native"), ("refugees", "citizens"),
    ("african", "american", "european", "chinese", "mexican", "indian", "arab"),
    ("disabled", "deaf", "blind", "able-bodied"), ("elderly", "young"),
)
_WORD = re.compile(r"\w+(?:-\w+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def swaps(terms: Sequence[Sequence[str]]) -> dict[str, str]:
    return {t: row[(i + 1) % len(row)] for row in terms for i, t in enumerate(row)}


def _hash(feature: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(feature) >> (64 - FEATURE_BITS)


def _word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings."""
    return (_hash("=" + word), *(_hash(word[:n]) for n in PREFIXES if len(word) > n))


def _features(words) -> set[int]:
    memo = Memo(_word_features)
    return {f for w in words for f in memo[w]}


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """Rows (text, toxic, weight): at most ``rows_per_class`` labelled texts of each class, by the hash of
    their id. ``weight`` restores the shares of the classes among all labelled rows."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learnable = docs.where(F.col("doc_id").isNotNull()).select("doc_id")
    known = staged(known.join(learnable, "doc_id", "left_semi"), "toxicity-labels")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label, n in sorted(sizes.items()):
        part = (
            known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
            .withColumn("weight", F.lit(n / min(n, rows_per_class)))
        )
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return docs.select("text", F.lit(0).alias("toxic"), F.lit(1.0).alias("weight")).limit(0)
    # at most 2 * rows_per_class ids
    chosen = staged(chosen, "toxicity-chosen")
    return staged(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
        .dropDuplicates(["doc_id"]).select("text", "toxic", "weight"), "toxicity-sample",
    )


def _choose_features(sample: DataFrame, max_features: int) -> np.ndarray:
    """Features that tell the classes apart best, by chi-squared of presence; sorted."""
    def run(batches):
        for batch in batches:
            found, toxic = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _features(set(words_of(text)))
                found.extend(own)
                toxic.extend([label] * len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), pa.array(toxic, pa.int32())], names=["feature", "toxic"]
            )

    counts = map_batches(sample.select("text", F.col("toxic").cast("int")), run, "feature long, toxic int").groupBy(
        "feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    n = sample.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).first()
    p, q = float(n["p"] or 0), float(n["q"] or 0)
    if not p or not q:
        return np.zeros(0, dtype=np.int64)
    a, b = F.col("a"), F.col("b")
    chi = (p + q) * F.pow(a * (q - b) - b * (p - a), 2) / (p * q * (a + b) * (p + q - a - b + 1e-9))
    best = (
        counts.where(a + b >= MIN_ROWS).withColumn("chi", chi).where("chi > 10.83")
        .orderBy(F.desc("chi"), "feature").limit(max_features).select("feature").toArrow()
    )
    return np.sort(best.column("feature").to_numpy())


def _rows(sample: DataFrame, features: np.ndarray, swap: dict[str, str]):
    """Of each sampled text: chosen features, those after the swap (empty if nothing is swapped)."""
    sent = sample.sparkSession.sparkContext.broadcast(features)

    def run(batches):
        known = {int(f): i for i, f in enumerate(sent.value)}
        place = Memo(lambda w: tuple(known[f] for f in _word_features(w) if f in known))
        for batch in batches:
            own, other = [], []
            for text in batch.column(0).to_pylist():
                words = set(words_of(text))
                own.append(sorted({i for w in words for i in place[w]}))
                changed = {swap.get(w, w) for w in words}
                other.append(sorted({i for w in changed for i in place[w]}) if changed != words else None)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, kind), pa.array(other, kind), batch.column(1), batch.column(2)],
                names=["own", "other", "toxic", "weight"],
            )

    return map_batches(
        sample.select("text", F.col("toxic").cast("double"), F.col("weight").cast("double")), run,
        "own array<int>, other array<int>, toxic double, weight double",
    ).toArrow()


class _Sparse:
    def __init__(self, rows):
        self.counts = np.array([len(r) for r in rows], dtype=np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.counts)
        self.column = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(self.counts.sum()))

    def times(self, w):
        return np.bincount(self.row, weights=w[self.column], minlength=len(self.counts))

    def transposed(self, v, n):
        return np.bincount(self.column, weights=v[self.row], minlength=n)


def train(rows, others, toxic, weight, n: int, pairing: float = 10.0, ridge: float = 2e-4, lasso: float = 2e-4, steps: int = 400):
    """Weights and intercept that minimise the mean of loss + pairing * (score - swapped score)**2.

    Accelerated proximal gradient; the step is halved until it descends.
    """
    x, y = _Sparse(rows), np.asarray(toxic, dtype=float)
    weight = np.asarray(weight, dtype=float) / max(np.sum(weight), 1e-9)
    paired = [i for i, o in enumerate(others) if o is not None]
    xs, xo = _Sparse([rows[i] for i in paired]), _Sparse([others[i] for i in paired])
    pair_weight = weight[paired] * pairing

    def value(w):
        z = x.times(w[:-1]) + w[-1]
        gap = xs.times(w[:-1]) - xo.times(w[:-1])
        loss = np.sum(weight * (np.logaddexp(0, z) - y * z)) + np.sum(pair_weight * gap**2)
        loss += ridge / 2 * np.sum(w[:-1] ** 2)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        slope = x.transposed(error, n) + ridge * w[:-1]
        if len(paired):
            slope += xs.transposed(2 * pair_weight * gap, n) - xo.transposed(2 * pair_weight * gap, n)
        return loss, np.r_[slope, error.sum()]

    share = min(max(float(np.sum(weight * y)), 1e-6), 1 - 1e-6) if len(y) else 1e-6
    w = np.r_[np.zeros(n), np.log(share / (1 - share))]
    if not len(y) or not n:
        return w[:-1], float(w[-1])
    z, momentum, step = w.copy(), 1.0, 1.0
    for _ in range(steps):
        loss, slope = value(z)
        while True:
            new = z - step * slope
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * lasso, 0)
            move = new - z
            if step < 1e-6 or value(new)[0] <= loss + slope @ move + move @ move / (2 * step) + 1e-12:
                break
            step /= 2
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z = new + (momentum - 1) / following * (new - w)
        w, momentum, step = new, following, step * 1.1
    return w[:-1], float(w[-1])


def fit(
    docs: DataFrame, labels: DataFrame, identity_terms=IDENTITY_TERMS, rows_per_class: int = ROWS_PER_CLASS,
    max_features: int = MAX_FEATURES, pairing: float = 10.0,
) -> dict:
    """A model (features, weights, intercept), learned from a bounded sample of labelled rows.

    At most 2 * ``rows_per_class`` texts are read, at most ``max_features`` features are kept, and
    the driver gets their numbers only. Rows without a label or an id teach nothing; an id with
    several labels counts as toxic if one says so; without both classes all scores are the base rate.
    """
    sample = labelled_sample(docs, labels, rows_per_class)
    features = _choose_features(sample, max_features)
    rows = _rows(sample, features, swaps(identity_terms))
    toxic = rows.column("toxic").to_numpy()
    weights, intercept = train(
        rows.column("own").to_pylist(), rows.column("other").to_pylist(), toxic,
        rows.column("weight").to_numpy(), len(features), pairing,
    )
    used = np.flatnonzero(weights)
    return {"features": features[used], "weights": weights[used], "intercept": intercept}


def score(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on); replaced if there already.

    Whole texts count; a null or empty text scores the intercept; repeated rows are scored each.
    """
    base = docs.drop("score", "predicted")
    at = base.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = dict(zip(map(int, sent.value["features"]), map(float, sent.value["weights"]), strict=True))
        place = Memo(lambda w: tuple(f for f in _word_features(w) if f in known))
        for batch in batches:
            logits = []
            for text in batch.column(at).to_pylist():
                found = {f for w in set(words_of(text or "")) for f in place[w]}
                logits.append(sum(known[f] for f in sorted(found)))
            logits = np.array(logits, dtype=float) + sent.value["intercept"]
            scores = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    schema = type(base.schema)([*base.schema.fields]).add("score", "double").add("predicted", "integer")
    return map_batches(base, run, schema)
