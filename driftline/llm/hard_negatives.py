"""Hard negatives by a GNAT-style multiway hyperplane tree over embeddings.

Every row gets one more component that gives all rows the same norm M; an anchor gets 0 there. Then
distance**2 = |anchor|**2 + M**2 - 2 * score, so a window of scores is an annulus around the anchor.
A node deals its rows to the nearest of its split points, and each split point stores the least and
largest distance to the rows of every sibling. A sibling is left out for an anchor if, for any split
point, that range does not meet the anchor's distance widened by the annulus. Leaves are compared in
whole numbers, so the result is exact.

The top node has split points from a bounded sample; all rows are dealt to its cells by a range shuffle,
which cuts a large cell into as many parts as it needs. Tasks build the trees below from blocks of bounded
size and search them for all anchors, which are sent in passes of bounded size. The first search finds an
anchor's positives, the second its negatives in the window of each positive.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from driftline.llm.common import map_batches
from driftline.staging import staged

#: Rows that split points of the top node are chosen from, and how many are chosen.
SAMPLE_ROWS, TOP_POINTS = 4096, 64
#: Rows of a tree that a task builds, split points of an inner node, rows of a leaf (copies: any number).
BLOCK_ROWS, SPLIT_POINTS, LEAF_ROWS = 8192, 16, 256
ROWS_PER_TASK = 1 << 16
ANCHORS_PER_PASS = 1 << 13
#: Windows whose scores against a leaf are held at a time.
WINDOWS_AT_A_TIME = 256
#: Below all scores.
NONE = -(1 << 62)
#: Distances are compared with this part of M to spare, far above what floating point loses.
SLACK = 1e-5


# ---- the tree -----------------------------------------------------------------

def lifted(rows: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that makes the square of each norm ``top``."""
    x = rows.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0.0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def spread_points(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` of the points, each the farthest from those before it; copies are not taken."""
    chosen = [0]
    nearest = distances(points, points[:1])[:, 0]
    while len(chosen) < min(count, len(points)):
        place = int(np.argmax(nearest))
        if nearest[place] <= SLACK * np.linalg.norm(points[0]):
            break
        chosen.append(place)
        nearest = np.minimum(nearest, distances(points, points[place:place + 1])[:, 0])
    return points[chosen]


class Node:
    """A leaf holds the places of its rows; an inner node split points, children, and the ranges between."""

    def __init__(self, places: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.places, self.children = places, []
        if len(places) <= leaf_rows:
            return
        split = spread_points(points, SPLIT_POINTS)
        far = distances(points, split)
        cell = np.argmin(far, axis=1)
        used = np.unique(cell)
        if len(used) < 2:
            return  # copies of one vector
        self.split, self.used = split, used
        inside = [cell == c for c in used]
        self.least = np.stack([far[i].min(axis=0) for i in inside])
        self.most = np.stack([far[i].max(axis=0) for i in inside])
        self.children = [Node(places[i], points[i], leaf_rows) for i in inside]


def meets(far, near, wide, least, most, spare) -> np.ndarray:
    """Anchors that may match a row of a cell, whose distances to the split points lie in [least, most].

    ``far`` are the anchors' distances to the split points, [near, wide] their annuli. A match x has
    |far - d(x)| <= its distance to a split point <= far + d(x) for its d(x) in the annulus.
    """
    low = np.maximum(far - wide[:, None], near[:, None] - far)
    return ((most + spare >= low) & (least - spare <= far + wide[:, None])).all(axis=1)


class Search:
    """Windows of scores to fill with the ``k`` best rows of a task.

    Window i belongs to anchor ``owner[i]`` and takes scores from ``low[i]`` to ``high[i]``, of rows with
    the anchor's label if ``same``, else with another, never of the anchor's id.
    """

    def __init__(self, ids, labels, vectors, owner, low, high, top, same, k):
        self.ids, self.labels, self.owner, self.low, self.high = ids, labels, owner, low, high
        self.top, self.same, self.k = top, same, k
        self.spare = SLACK * np.sqrt(top)
        self.vectors = vectors
        self.points = np.concatenate([vectors.astype(np.float64), np.zeros((len(vectors), 1))], axis=1)
        self.reach = np.einsum("ij,ij->i", self.points, self.points) + top
        self.scores = np.full((len(owner), k), NONE)
        self.found = np.full((len(owner), k), np.iinfo(np.int64).max)
        self.compared = 0

    def _annuli(self, windows):
        need = np.maximum(self.low[windows], self.scores[windows, -1]).astype(np.float64)
        reach = self.reach[self.owner[windows]]
        near = np.sqrt(np.maximum(reach - 2.0 * self.high[windows].astype(np.float64), 0.0))
        wide = np.sqrt(np.maximum(reach - 2.0 * need, 0.0))
        return near, wide

    def block(self, ids, labels, rows, top_points):
        """Search the rows of one block; its distances to the top node's split points come first."""
        points = lifted(rows, self.top)
        windows = np.arange(len(self.owner))
        far = distances(points, top_points)
        windows = windows[self._meeting(windows, top_points, far.min(axis=0), far.max(axis=0))]
        if len(windows):
            self.block_rows = ids, labels, rows
            self._node(Node(np.arange(len(ids)), points), windows)

    def _meeting(self, windows, split, least, most):
        near, wide = self._annuli(windows)
        return meets(distances(self.points[self.owner[windows]], split), near, wide, least, most, self.spare)

    def _node(self, node, windows):
        if not node.children:
            for at in range(0, len(windows), WINDOWS_AT_A_TIME):
                self._leaf(node.places, windows[at:at + WINDOWS_AT_A_TIME])
            return
        far = distances(self.points[self.owner[windows]], node.split)
        for j in np.argsort(far[:, node.used].mean(axis=0)):  # any order is right; close cells narrow bounds early
            near, wide = self._annuli(windows)
            left = meets(far, near, wide, node.least[j], node.most[j], self.spare)
            if left.any():
                self._node(node.children[j], windows[left])

    def _leaf(self, places, windows):
        ids, labels, rows = (a[places] for a in self.block_rows)
        anchors, back = np.unique(self.owner[windows], return_inverse=True)
        scores = inner_products(self.vectors[anchors], rows)
        self.compared += scores.size
        other = labels != self.labels[anchors][:, None] if self.same else labels == self.labels[anchors][:, None]
        scores[other | (ids == self.ids[anchors][:, None])] = NONE
        scores = scores[back]
        need = np.maximum(self.low[windows], self.scores[windows, -1])
        scores[(scores < need[:, None]) | (scores > self.high[windows][:, None])] = NONE
        some = (scores > NONE).any(axis=1)
        windows, scores = windows[some], scores[some]
        if not len(windows):
            return
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :self.k]
        both = np.concatenate([self.scores[windows], np.take_along_axis(scores, order, 1)], axis=1)
        from_ids = np.concatenate([self.found[windows], ids[order]], axis=1)
        best = np.lexsort((from_ids, -both), axis=1)[:, :self.k]
        self.scores[windows] = np.take_along_axis(both, best, 1)
        self.found[windows] = np.take_along_axis(from_ids, best, 1)

    def rows(self):
        """(window, score, id) of all that was found."""
        window, place = np.nonzero(self.scores > NONE)
        return window, self.scores[window, place], self.found[window, place]


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact 64-bit inner products; in floating point where no sum can pass 2**53."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


# ---- rows ---------------------------------------------------------------------

def labelled_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """Rows (vec_id, label, terms), terms being floor(scale * component).

    Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    """
    whole = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(whole, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                F.transform(whole, lambda v: F.floor(v * scale).cast("long")).alias("terms"))
    )


def _dense(lists, width: int) -> np.ndarray:
    """Lists as rows of one array, 0 where a list is short."""
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width) < counts[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _collected(df: DataFrame, column: str, width: int):
    rows = df.toArrow()
    lists = rows.column(column).combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return rows, _dense(lists, width)


class Index:
    """All rows, staged in the order of the top node's cells."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        self.all = staged(vectors.select("vec_id", "label", "terms"), "negative-vectors")
        square = F.aggregate("terms", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
        n, top, width = self.all.agg(F.count("*"), F.max(square), F.max(F.size("terms"))).first()
        self.n, self.top, self.width = n, (top or 0.0) * (1 + 1e-9) + 1.0, max(width or 1, 1)
        # a cut by hash that leaves about SAMPLE_ROWS rows, of which SAMPLE_ROWS at most are taken
        cut = max(1, n // SAMPLE_ROWS)
        sample = self.all.where(F.pmod(F.xxhash64("vec_id", "terms"), F.lit(cut)) == 0).limit(SAMPLE_ROWS)
        _, rows = _collected(sample if n else self.all, "terms", self.width)
        if n and not len(rows):
            _, rows = _collected(self.all.limit(SAMPLE_ROWS), "terms", self.width)
        self.points = spread_points(lifted(rows, self.top), TOP_POINTS) if len(rows) else np.zeros((1, self.width + 1))
        sent = spark.sparkContext.broadcast((self.points, self.top, self.width))
        celled = map_batches(self.all, _cells(sent), "vec_id long, label long, terms array<long>, cell int")
        tie = F.monotonically_increasing_id()
        parts = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
        self.rows = staged(
            celled.withColumn("_tie", tie).repartitionByRange(parts, "cell", "vec_id", "_tie")
            .sortWithinPartitions("cell", "vec_id", "_tie").drop("_tie"),
            "negative-tree",
        )
        sent.destroy()


def _cells(sent):
    def run(batches):
        points, top, width = sent.value
        for batch in batches:
            cell = np.argmin(distances(lifted(_dense(batch.column(2), width), top), points), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])
    return run


def _blocks(batches, width):
    """(ids, labels, rows) of up to BLOCK_ROWS rows of one cell."""
    held, cell = [], None
    for batch in batches:
        cells = batch.column(3).to_numpy()
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        for start, end in zip(cuts, cuts[1:]):
            while start < end:
                room = BLOCK_ROWS - sum(b.num_rows for b in held)
                if held and (cells[start] != cell or room <= 0):
                    yield _block(held, width)
                    held, room = [], BLOCK_ROWS
                cell = cells[start]
                part = batch.slice(start, min(end - start, room))
                held.append(part)
                start += part.num_rows
    if held:
        yield _block(held, width)


def _block(held, width):
    one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return one.column(0).to_numpy(), one.column(1).to_numpy(), _dense(one.column(2), width)


def _searcher(sent):
    def run(batches):
        given, top_points, width = sent.value
        search = Search(**given)
        for ids, labels, rows in _blocks(batches, width):
            search.block(ids, labels, rows, top_points)
        window, score, found = search.rows()
        if len(window):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (window, score, found)], names=["window", "score", "found"])
    return run


def _best(index: Index, given: dict, windows, schema: str, label: str) -> DataFrame:
    """The k best of each window over all tasks, with the columns of the window, as a staged table."""
    spark = index.rows.sparkSession
    sent = spark.sparkContext.broadcast((given, index.points, index.width))
    local = map_batches(index.rows, _searcher(sent), "window long, score long, found long")
    order = Window.partitionBy("window").orderBy(F.desc("score"), "found")
    best = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= given["k"])
    # one row for each window of this pass, so bounded by ANCHORS_PER_PASS times the windows of an anchor
    named = spark.createDataFrame(windows, f"window long, {schema}")
    out = staged(best.join(F.broadcast(named), "window").drop("window"), label)
    sent.destroy()
    return out


def _united(parts, empty: DataFrame) -> DataFrame:
    out = empty
    for part in parts:
        out = out.unionByName(part)
    return out


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5,
    least_percent: int = 80, most_percent: int = 100, anchors_per_pass: int = ANCHORS_PER_PASS,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` and ``anchors`` have (vec_id, label, terms) as from ``labelled_vectors``. A score is the
    64-bit integer inner product with the anchor; a missing term is 0; higher scores come first, then
    smaller ids. The positives of an anchor are its best rows with its label and another id. For each, the
    negatives are the best rows with another label and id whose score is from ``least_percent`` to
    ``most_percent`` percent of the positive's; a negative positive score therefore has none. Fewer rows,
    also none, are given where there are fewer. Of an anchor id's rows the least (label, terms) is searched
    for; candidates that share an id are ranked each, a positive that occurs twice is searched for once.
    Empty tables give no rows.
    """
    spark = vectors.sparkSession
    index = Index(vectors)
    asked = staged(
        anchors.groupBy("vec_id").agg(F.min(F.struct("label", "terms")).alias("_row"))
        .select("vec_id", "_row.label", "_row.terms"), "negative-anchors",
    )
    slices = -(-max(asked.count(), 1) // anchors_per_pass)
    of_pass = F.pmod(F.xxhash64("vec_id"), F.lit(slices))

    def sent_to(part, extra=None):
        rows = asked.where(of_pass == part)
        rows = rows.join(extra, "vec_id") if extra is not None else rows
        rows, terms = _collected(rows.orderBy("vec_id"), "terms", max(index.width, 1))
        base = {"ids": rows.column("vec_id").to_numpy(), "labels": rows.column("label").to_numpy(), "vectors": terms, "top": index.top}
        return rows, base

    found, schema = [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for part in range(slices if index.n else 0):
        _, given = sent_to(part)
        ids = given["ids"].tolist()
        if not ids:
            continue
        one = np.arange(len(ids))
        given |= {"owner": one, "low": np.full(len(ids), NONE), "high": np.full(len(ids), -NONE), "same": True, "k": positives}
        near = _best(index, given, list(enumerate(ids)), "vec_id long", "positives")
        wanted = near.where("score >= 0").groupBy("vec_id").agg(F.sort_array(F.collect_set(F.struct("found", "score"))).alias("wanted"))
        rows, given = sent_to(part, wanted)
        windows = [
            (place, anchor, w["found"], w["score"])
            for place, (anchor, ws) in enumerate(zip(given["ids"].tolist(), rows.column("wanted").to_pylist(), strict=True)) for w in ws
        ]
        if not windows:
            continue
        owner, _, _, score = (list(c) for c in zip(*windows, strict=True))
        given |= {
            "owner": np.array(owner), "low": np.array([-(-least_percent * s // 100) for s in score]),
            "high": np.array([most_percent * s // 100 for s in score]), "same": False, "k": negatives,
        }
        named = [(i, *w[1:]) for i, w in enumerate(windows)]
        best = _best(index, given, named, "anchor_id long, positive_id long, positive_score long", "negatives")
        found.append(best.select(
            "anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ))
    return _united(found, spark.createDataFrame([], schema))
