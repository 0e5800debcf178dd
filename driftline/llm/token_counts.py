"""Token counts of a byte-pair model, by merging and without producing identifiers.

A text is a list of symbols, linked to their neighbours. A heap holds the adjacent pairs that the
model can merge; the pair of the lowest rank, and of these the leftmost, is merged until none is
left. The count is initial symbols minus merges; a symbol that the model lacks counts its bytes.

Pieces hold the blank mark at their start only (checked when a model is read), so no merge crosses
from other text into a blank. Blank-led segments are therefore counted apart, and a bounded memo
spares repeated ones.
"""

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from driftline.llm.common import Memo, map_batches

BLANK = "▁"
_NORMAL = 1


def read_model(path: str) -> dict[str, int]:
    """Ranks of the pieces of a sentencepiece BPE model (equal scores share a rank).

    Raises ``ValueError`` for a model whose counts this operator cannot give: not BPE, with a
    normalisation table, without byte fallback, or with a blank inside a piece.
    """
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    pieces = [(p.piece, p.score) for p in model.pieces if p.type == _NORMAL]
    supported = (
        train.model_type == 2 and train.byte_fallback and not train.treat_whitespace_as_suffix
        and not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces
        and not norm.remove_extra_whitespaces
        and not any(p.type in (4, 5) for p in model.pieces)
        and not any(re.search(f"[^{BLANK}]{BLANK}", p) for p, _ in pieces)
    )
    if not supported:
        raise ValueError(f"{path}: not a byte-pair model of the kind that can be counted")
    order = {score: i for i, score in enumerate(sorted({s for _, s in pieces}, reverse=True))}
    return {piece: order[score] for piece, score in pieces}


def count_segment(segment: str, ranks: dict[str, int]) -> int:
    """Tokens of one segment: symbols minus merges, unknown symbols as bytes."""
    symbols = list(segment)
    n = len(symbols)
    following = list(range(1, n + 1))
    preceding = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(symbols[i] + symbols[i + 1])
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    count = n
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = following[i]
        if j >= n or symbols[i] != left or symbols[j] != right:
            continue  # one of the two was merged meanwhile
        symbols[i] = merged = left + right
        symbols[j] = ""
        count -= 1
        k = following[i] = following[j]
        if k < n:
            preceding[k] = i
            rank = ranks.get(merged + symbols[k])
            if rank is not None:
                heapq.heappush(heap, (rank, i, merged, symbols[k]))
        h = preceding[i]
        if h >= 0:
            rank = ranks.get(symbols[h] + merged)
            if rank is not None:
                heapq.heappush(heap, (rank, h, symbols[h], merged))
    return count + sum(len(s.encode()) - 1 for s in symbols if s and s not in ranks)


def segments(text: str) -> list[str]:
    """Blank-led segments of a text, each without its first blank mark."""
    marked = text.replace(" ", BLANK)
    if BLANK * 2 not in marked and not marked.startswith(BLANK):
        return marked.split(BLANK)
    return [s[1:] for s in re.findall(f"{BLANK}+[^{BLANK}]*", BLANK + marked)]


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one for each row of ``docs``.

    The model is read by the driver; its pieces travel with the tasks (a vocabulary, not data). A
    null or empty text has no bytes and no tokens; a null id is kept; repeated rows are counted
    each; other columns are ignored whatever their names.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        vocabulary = ranks.value
        count = Memo(lambda s: count_segment(BLANK + s, vocabulary))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [sum(map(count.__getitem__, segments(t))) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.select(id_col, text_col), run,
        f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean",
    )
