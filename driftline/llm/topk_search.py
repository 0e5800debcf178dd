"""Exact top-k search by inner product, term at a time.

A component is a term; its postings are the candidates with a weight other than 0 there. The
candidates of a block have one dense score array for each query; the non-zero terms of the sparse
query rows scatter their weighted postings into these arrays, the k best are selected in the block,
and the blocks' selections are merged.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from driftline.llm.common import map_batches
from driftline.staging import scratch_path

QUERIES_PER_PASS = 1 << 15
BLOCK_ROWS = 2048
QUERY_BLOCK = 256


def integer_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """Rows (vec_id, terms): floor(scale * component). Rows with a null id, a null vector, or a null
    or non-finite component take no part."""
    x = F.col("embedding")
    whole = F.transform(x, lambda v: v.cast("double"))
    finite = F.forall(whole, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        df.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(finite)
        .select(F.col("vec_id").cast("long").alias("vec_id"),
                F.transform(whole, lambda v: F.floor(v * scale).cast("long")).alias("terms"))
    )


def _dense(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of terms as one array, padded with 0."""
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), max(width, int(counts.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1]) < counts[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores; ``ids`` ascend, so among equal scores the first places win."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def _search_block(q_ids, q_terms, ids, terms, k):
    """Selections of one block of candidates for all queries: query ids, candidate ids, scores."""
    order = np.argsort(ids, kind="stable")
    ids, terms = ids[order], terms[order]
    width = min(q_terms.shape[1], terms.shape[1])
    postings = [(p, terms[p, t]) for t in range(width) for p in [np.flatnonzero(terms[:, t])]]
    found = ([], [], [])
    for at in range(0, len(q_ids), QUERY_BLOCK):
        block_ids, block = q_ids[at:at + QUERY_BLOCK], q_terms[at:at + QUERY_BLOCK]
        scores = np.zeros((len(block), len(ids)), dtype=np.int64)
        for t, (places, weights) in enumerate(postings):
            rows = np.flatnonzero(block[:, t])
            if len(rows) == len(block) and len(places) == len(ids):
                scores += block[:, t, None] * weights
            elif len(rows) and len(places):
                scores[np.ix_(rows, places)] += block[rows, t, None] * weights
        for r, query in enumerate(block_ids):
            row, row_ids = scores[r], ids
            if ids[0] <= query <= ids[-1] and (own := ids == query).any():
                row, row_ids = row[~own], ids[~own]
            best = _select(row, row_ids, k)
            found[0].append(np.full(len(best), query))
            found[1].append(row_ids[best])
            found[2].append(row[best])
    return [np.concatenate(f) for f in found]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, queries_per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k candidates of the highest integer inner product.

    ``vectors`` and ``queries`` have (vec_id, terms). A query's own id is no candidate; equal scores
    rank by the smaller id; fewer candidates give fewer rows; a missing term is 0. Queries are sent
    to the tasks ``queries_per_pass`` at a time, so what is broadcast is bounded; each pass scans the
    candidates once. Each task passes on k rows a query. Repeated query ids are searched once;
    candidates with the same id are ranked each. Scores are 64-bit.
    """
    spark = vectors.sparkSession
    asked = queries.dropDuplicates(["vec_id"])
    path = scratch_path(spark, "topk-queries")
    asked.write.parquet(path)
    asked = spark.read.schema(queries.schema).parquet(path)
    # equal slices by the hash of the id, each of about queries_per_pass rows
    slices = -(-max(asked.count(), 1) // queries_per_pass)
    found = None
    for part in range(slices):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == part).orderBy("vec_id").toArrow()
        q_ids = rows.column("vec_id").to_numpy()
        lists = rows.column("terms").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sent = spark.sparkContext.broadcast((q_ids, _dense(lists, 1) if len(q_ids) else None))
        local = map_batches(vectors.select("vec_id", "terms"), _searcher(sent, k), "query_id long, vec_id long, score long")
        found = local if found is None else found.unionByName(local)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _searcher(sent, k):
    def run(batches):
        q_ids, q_terms = sent.value
        if not len(q_ids):
            return
        best = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                got = _search_block(q_ids, q_terms, ids, _dense(part.column(1), q_terms.shape[1]), k)
                best = _merge(best, got, k)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in best], names=["query_id", "vec_id", "score"])
    return run


def _merge(a, b, k):
    """The k best of each query in two selections."""
    q, v, s = b if a is None else (np.concatenate(pair) for pair in zip(a, b, strict=True))
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    keep = place < k
    return q[keep], v[keep], s[keep]
