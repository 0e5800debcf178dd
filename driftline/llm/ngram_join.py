"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two documents link when their sets of word shingles overlap enough. A document with n shingles can
only link with documents that share at least T = ceil(threshold * n) of them, so those are the
documents that occur at least T times on the inverted lists of its shingles. DivideSkip sets the
longest lists aside, merges the short ones with a heap that skips ahead, and looks candidates up in
the long lists by binary search.

Before that, work is kept apart that needs no search. Documents with equal sets are one class. Each
class is compared with one likely relative (several equal minima of its shingles), which joins most large
groups of near copies by one comparison for each member. For the rest, shingles are ordered by how
many documents have them; two linked sets share a shingle among the first n - T + 1 of each, and
only lists of such shingles that reach different groups send a document to a block of others to be
searched. What two sets share lies behind the first shingle they share in each, so the place of a shingle
limits how large the other set may be; lists send a document only where sets of such sizes live.
Shingles that one document alone has are never listed, and groups are not searched within.
All links between groups are found; a link inside a group changes nothing.
"""

import hashlib
import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import (
    broadcast_up_to, components, map_batches, mix, rows_a_batch, shingle_hashes, word_hash_memo,
)
from driftline.staging import staged

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
MINIMA = 8
#: Minima that a likely relative shares at least. Sets that link share six on average; others that link are
#: found by the search.
RELATIVE_MINIMA = 3
#: Shingles with a hash below this come first in the order, and their frequencies are counted over all
#: documents. A prefix is a quarter of a set, so most end among them; for sets whose prefix does not,
#: mostly small ones, the other shingles are counted too, over such sets.
FIRST_BELOW = 3 << 61
#: Frequencies are told apart up to here.
FREQUENT = 64
POSTINGS_PER_BUCKET = 100_000
POSTINGS_PER_FLUSH = 500_000
RESIDENTS_PER_BLOCK = 600
#: Who lives in a block has sets of like size: within a class, sizes differ by this factor at most.
SIZE_STEP = 1.1
VISITORS_PER_PART = 2_400
MEMBERS_PER_GROUP = 1_000
BROADCAST_ROWS = 1 << 20
#: Rows that a step turns into sets, or compares, at a time.
ROWS_AT_A_TIME = 1_000


def shingles(text: str | None, memo, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: runs of ``size`` words, the whole of a shorter text.

    Words are cut at ASCII white space, A-Z count as a-z. 64 bits stand for a shingle.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(words) < size:
        return mix(shingle_hashes(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(shingle_hashes(hashes, size))


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares with any set it links with, at least."""
    return -(-NUMERATOR * n // DENOMINATOR)


def links_with(n: int, m: int, shared: int) -> bool:
    return DENOMINATOR * shared >= NUMERATOR * (n + m - shared)


# ---- T-occurrence search ---------------------------------------------------------------------


class InvertedLists:
    """Lists of the sets that have a shingle, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        keys = np.concatenate([np.zeros(0, np.uint64), *sets])
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(keys, kind="stable")
        self.owners = owners[order]
        self.keys, self.starts = np.unique(keys[order], return_index=True)
        self.ends = np.r_[self.starts[1:], len(keys)]

    def of(self, wanted: np.ndarray) -> list[list[int]]:
        if not len(self.keys):
            return []
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return [self.owners[self.starts[i]:self.ends[i]].tolist() for i in at[self.keys[at] == wanted]]


def _holds(values: list[int], wanted: int) -> bool:
    at = bisect_left(values, wanted)
    return at < len(values) and values[at] == wanted


def occurring(lists: list[list[int]], least: int, known=None):
    """DivideSkip: (owner, occurrences) of all owners on at least ``least`` of the sorted lists.

    ``known(owner)`` true leaves an owner out before its long lists are probed.
    """
    if least < 1 or len(lists) < least:
        return
    lists = sorted(lists, key=len)
    # the more lists are set aside, the fewer to merge but the more to probe for each candidate
    aside = min(least - 1, int(least / (0.0085 * np.log2(max(len(lists[-1]), 2)) + 1)))
    short, long = lists[:len(lists) - aside], lists[len(lists) - aside:]
    need = least - aside
    heap = [(values[0], i, 0) for i, values in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= need:
        owner, popped = heap[0][0], []
        while heap and heap[0][0] == owner:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            if known is None or not known(owner):
                found = len(popped)
                for i, values in enumerate(long):
                    if found + len(long) - i < least:
                        break
                    found += _holds(values, owner)
                if found >= least:
                    yield owner, found
            for _, i, at in popped:
                if at + 1 < len(short[i]):
                    heapq.heappush(heap, (short[i][at + 1], i, at + 1))
            continue
        # fewer than needed: no owner before the need-th smallest head can be on enough lists
        while heap and len(popped) < need - 1:
            popped.append(heapq.heappop(heap))
        if not heap:
            break
        reach = heap[0][0]
        for _, i, at in popped:
            at = bisect_left(short[i], reach, at)
            if at < len(short[i]):
                heapq.heappush(heap, (short[i][at], i, at))


# ---- sets and classes ------------------------------------------------------------------------

_SETS = "doc_id long, n long, signature binary, n_first long, minima array<long>, shingles binary"


def _hashes(stored: bytes) -> np.ndarray:
    """A set as it is staged: its sorted hashes, eight bytes each."""
    return np.frombuffer(stored, dtype="<u8")


def n_first(own: np.ndarray) -> int:
    return int(np.searchsorted(own, np.uint64(FIRST_BELOW)))


def prefix_length(n: int) -> int:
    return n - least_overlap(n) + 1


def set_table(docs: DataFrame) -> DataFrame:
    """One row for each document: size and 128-bit signature of its set (null if empty), how many
    hashes are in the first part of the order, minima under several orders, and the set itself.

    Texts are read and hashed here only; later steps read the staged sets.
    """
    factors = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def run(batches):
        memo = word_hash_memo()
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingles(text, memo)
                n = len(own)
                if not n:
                    rows.append((doc_id, 0, None, 0, [], None))
                    continue
                minima = mix(own[None, :] * factors[:, None]).min(axis=1)
                stored = own.astype("<u8", copy=False).tobytes()
                rows.append((
                    doc_id, n, hashlib.blake2b(stored, digest_size=16).digest(), n_first(own), minima.view(np.int64), stored,
                ))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=[f.split()[0] for f in _SETS.split(", ")],
            )

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, _SETS, ROWS_AT_A_TIME)


def _sets_of(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (node and other columns) with the node's staged set."""
    own = sets.select(F.col("doc_id").alias("node"), "shingles")
    return own.join(broadcast_up_to(wanted, BROADCAST_ROWS), "node")


# ---- one likely relative ---------------------------------------------------------------------


def _relatives(classes: DataFrame) -> DataFrame:
    """Rows (node, leader): of the smallest nodes that share a minimum with a node, the one that shares
    most of them, RELATIVE_MINIMA at least. ``leader`` is smaller than ``node``."""
    keys = classes.select("node", F.posexplode("minima").alias("place", "minimum"))
    leaders = staged(
        keys.groupBy("place", "minimum").agg(F.min("node").alias("leader"), F.count("*").alias("size"))
        .where("size > 1").drop("size"), "leaders",
    )
    return (
        keys.join(leaders, ["place", "minimum"]).where("leader < node")
        .groupBy("node", "leader").agg(F.count("*").alias("equal")).where(F.col("equal") >= RELATIVE_MINIMA)
        .groupBy("node").agg(F.max_by("leader", F.struct("equal", -F.col("leader"))).alias("leader"))
    )


def _compare_relatives(sets: DataFrame, relatives: DataFrame) -> DataFrame:
    """Links (a, b) of nodes with their leaders.

    A leader's members are dealt into groups of about MEMBERS_PER_GROUP, and the leader's set goes
    to each; a task holds the set of one leader at a time.
    """
    sizes = relatives.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS_PER_GROUP).cast("int").alias("parts"))
    sizes = staged(sizes, "leader-parts")
    members = relatives.join(sizes, "leader").select(
        "node", "leader", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role")
    )
    heads = sizes.select(
        F.col("leader").alias("node"), "leader",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"),
    )
    wanted = staged(members.unionByName(heads), "relative-groups")
    dealt = _sets_of(sets, wanted).repartition("leader", "part").sortWithinPartitions(
        "leader", "part", "role"
    )

    def run(batches):
        head = leader = None
        for batch in batches:
            out = []
            nodes, leaders, roles = (batch.column(n).to_pylist() for n in ("node", "leader", "role"))
            stored = batch.column("shingles")
            for i, node in enumerate(nodes):
                own = _hashes(stored[i].as_py())
                if roles[i] == 0:
                    head, leader = own, leaders[i]
                elif leaders[i] == leader:
                    shared = len(np.intersect1d(head, own, assume_unique=True))
                    if links_with(len(head), len(own), shared):
                        out.append((node, leader))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_batches(dealt, run, "a long, b long", ROWS_AT_A_TIME)


# ---- frequencies and prefixes ----------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte: first all lowest bytes, and so on; zero bytes then compress away."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


_POSTED = "bucket int, kind int, hashes binary, owners binary"
_PLAIN, _NOTICE, _HEAVY = 0, 1, 2


def _post(sets: DataFrame, buckets: int) -> DataFrame:
    """The shingles of all documents that may be in prefixes, in blobs for each range of hashes.

    A shingle that many documents of one task have is known to be frequent already; its range gets
    a notice in place of its owners, which go anywhere. So no list of owners is long.
    """
    width = (FIRST_BELOW >> 32) // buckets + 1

    def flush(held, owners, turn):
        hashes = np.concatenate(held)
        ids = np.repeat(np.array(owners, dtype=np.int64), [len(h) for h in held])
        order = np.argsort(hashes, kind="stable")
        hashes, ids = hashes[order], ids[order].view(np.uint64)
        _, start, count = np.unique(hashes, return_index=True, return_counts=True)
        heavy = np.repeat(count >= FREQUENT, count)
        rows = []
        if heavy.any():
            rows.append((turn % buckets, _HEAVY, _planes(hashes[heavy]), _planes(ids[heavy])))
            notices = hashes[start[count >= FREQUENT]]
            rows += [(b, _NOTICE, _planes(notices[at:to]), b"") for b, at, to in ranges(notices)]
        plain, ids = hashes[~heavy], ids[~heavy]
        rows += [
            (b, _PLAIN, _planes(np.diff(plain[at:to], prepend=np.uint64(0))), _planes(ids[at:to]))
            for b, at, to in ranges(plain)
        ]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=[f.split()[0] for f in _POSTED.split(", ")],
        )

    def ranges(hashes):
        own = ((hashes >> np.uint64(32)) // np.uint64(width)).astype(np.int64)
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
        return [(int(own[i]), i, j) for i, j in zip(at, [*at[1:], len(own)], strict=True)]

    def run(batches):
        held, owners, size = [], [], 0
        turn = 0
        for batch in batches:
            for doc_id, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _hashes(stored.as_py())
                first = n_first(own)
                if prefix_length(len(own)) <= first:
                    own = own[:first]
                if len(own):
                    held.append(own)
                    owners.append(doc_id)
                    size += len(own)
                if size >= POSTINGS_PER_FLUSH:
                    turn += 1 + owners[0] % 1009
                    yield flush(held, owners, turn)
                    held, owners, size = [], [], 0
        if held:
            yield flush(held, owners, turn + 1 + owners[0] % 1009)

    known = sets.where("doc_id is not null and signature is not null").select("doc_id", "shingles")
    return map_batches(known, run, _POSTED, ROWS_AT_A_TIME)


def _shared_shingles(posted: DataFrame) -> DataFrame:
    """Rows (node, frequency, hash): a document's counted shingles that other documents have too."""
    def run(group: pa.Table) -> pa.Table:
        hashes, owners, notices, out = [], [], [np.zeros(0, np.uint64)], []
        for kind, h, o in zip(*(group.column(n).to_pylist() for n in ("kind", "hashes", "owners")), strict=True):
            if kind == _NOTICE:
                notices.append(_from_planes(h))
            elif kind == _HEAVY:
                out.append((_from_planes(o), _from_planes(h), FREQUENT))
            else:
                hashes.append(np.cumsum(_from_planes(h), dtype=np.uint64))
                owners.append(_from_planes(o))
        if hashes:
            h, o = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(h, kind="stable")
            h, o = h[order], o[order]
            values, count = np.unique(h, return_counts=True)
            count = np.where(np.isin(values, np.concatenate(notices)), FREQUENT, np.minimum(count, FREQUENT))
            frequency = np.repeat(count, np.unique(h, return_counts=True)[1])
            several = frequency > 1
            out.append((o[several], h[several], frequency[several]))
        columns = [np.concatenate([np.zeros(0, np.uint64), *(x[k] for x in out)]).view(np.int64) for k in (0, 1)]
        frequencies = np.concatenate([np.zeros(0, np.int32), *(np.broadcast_to(x[2], len(x[0])) for x in out)])
        return pa.table({
            "node": pa.array(columns[0]), "frequency": pa.array(frequencies.astype(np.int32)), "hash": pa.array(columns[1]),
        })

    return posted.groupBy("bucket").applyInArrow(run, "node long, frequency int, hash long")


def _prefixes(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows (hash, node, n, reach): the shingles in a node's prefix that others may share.

    A prefix takes the first part of the order, then the second, each rarest first. Shingles of
    frequency 1 are not listed, but they count and come first in their part. ``reach`` is the most
    shingles that a set may have to link with the node's if this is the first that both have: at
    place i (from 0) they share n - i at most.
    """
    first = F.when((F.col("hash") >= 0) & (F.col("hash") < FIRST_BELOW), 0).otherwise(1)
    listed = shared.groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct(first.alias("part"), "frequency", "hash"))).alias("shared"),
        F.count_if(first == 0).alias("listed_first"), F.count_if(first == 1).alias("listed_second"),
    )
    length = F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1
    n_first, n_second = F.col("n_first"), F.col("n") - F.col("n_first")
    zero = F.lit(0)
    taken_first = F.greatest(zero, F.least(length, n_first) - (n_first - F.col("listed_first")))
    taken_second = F.greatest(zero, length - n_first - (n_second - F.col("listed_second")))

    def part(start, taken, place):
        entries = F.slice("shared", (start + 1).cast("int"), taken.cast("int"))
        return F.transform(entries, lambda e, i: F.struct(e["hash"].alias("hash"), (place + i).alias("place")))

    entries = F.concat(
        part(zero, taken_first, n_first - F.col("listed_first")),
        part(F.col("listed_first"), taken_second, F.col("n") - F.col("listed_second")),
    )
    reach = F.floor((DENOMINATOR * F.col("n") - (DENOMINATOR + NUMERATOR) * F.col("entry.place")) / NUMERATOR)
    return (
        classes.select("node", "n", "n_first").join(listed, "node")
        .select("node", "n", F.explode(entries).alias("entry"))
        .select("entry.hash", "node", "n", reach.alias("reach"))
    )


# ---- search between groups -------------------------------------------------------------------


def _routes(prefixes: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (node, block, part, component, role): role 0 lives in the block, role 1 is searched there.

    Only lists that reach several groups matter. Blocks are of one class of set sizes; there a group
    lives in one block, a large one in several, and the members of the smaller of two groups are searched where the larger lives, if the sizes of
    those who share a list there are within each other's reach. The visitors of a block are dealt into parts of about VISITORS_PER_PART, and those who live there go to each.
    """
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    known = staged(
        prefixes.join(labels.join(sizes, "component"), "node", "left").select(
            "hash", "node", "n", "reach",
            F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).alias("size"),
        ), "prefix-lists",
    )
    several = staged(
        known.groupBy("hash").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high").select("hash"), "several-groups",
    )
    active = staged(known.join(several, "hash"), "active-lists")
    active = active.withColumn("class", F.floor(F.log("n") / math.log(SIZE_STEP)))
    nodes = staged(active.select("node", "component", "size", "class").distinct(), "active-nodes")
    classes = staged(
        nodes.groupBy("class").agg(F.ceil(F.count("*") / RESIDENTS_PER_BLOCK).alias("blocks")), "size-classes"
    )
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / RESIDENTS_PER_BLOCK).cast("long"))
    block = F.struct("class", F.pmod(F.xxhash64("component", part), F.col("blocks")).alias("place"))

    def housed(rows):
        return rows.join(F.broadcast(classes), "class").withColumn("block", block)  # some hundred classes at most

    living = housed(nodes).select("node", "block", "component", F.lit(0).alias("role"))
    here = staged(
        housed(active).groupBy("hash", "block")
        .agg(F.max(F.struct("size", "component")).alias("largest"),
             F.min("n").alias("least_n"), F.max("reach").alias("most_reach")), "list-blocks",
    )
    visits = (
        active.join(here, "hash").where(F.struct("size", "component") < F.col("largest"))
        .where((F.col("least_n") <= F.col("reach")) & (F.col("n") <= F.col("most_reach")))
        .select("node", "block", "component", F.lit(1).alias("role")).distinct()
    )
    visits = staged(visits, "visits")
    parts = staged(visits.groupBy("block").agg(
        F.ceil(F.count("*") / VISITORS_PER_PART).cast("int").alias("parts")), "block-parts")
    columns = ["node", "block", "part", "component", "role"]
    dealt = visits.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    copied = living.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return staged(dealt.select(*columns).unionByName(copied.select(*columns)), "routes")


def _search(sets: DataFrame, routes: DataFrame) -> DataFrame:
    """Links (a, b) between groups: visitors of a block searched in the inverted lists of those who live
    there. A task holds the lists of one block; the visitors of a part stream by."""
    dealt = (
        _sets_of(sets, routes)
        .repartition("block", "part").sortWithinPartitions("block", "part", "role", "node")
    )

    def run(batches):
        place, nodes, groups, own_sets, lists = None, [], [], [], None
        parent: dict[int, int] = {}

        def root(group):
            while (up := parent.get(group, group)) != group:
                parent[group] = parent.get(up, up)
                group = up
            return group

        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in ("node", "block", "part", "component", "role")]
            stored = batch.column("shingles")
            for i, (node, *at, component, role) in enumerate(zip(*columns, strict=True)):
                if at != place:
                    place, nodes, groups, own_sets, lists, parent = at, [], [], [], None, {}
                own = _hashes(stored[i].as_py())
                if role == 0:
                    nodes.append(node)
                    groups.append(component)
                    own_sets.append(own)
                    continue
                if lists is None:
                    lists = InvertedLists(own_sets)
                same = lambda r: root(groups[r]) == root(component)  # noqa: B023, E731
                for r, shared in occurring(lists.of(own), least_overlap(len(own)), same):
                    if not same(r) and links_with(len(own), lists.sizes[r], shared):
                        out.append((node, nodes[r]))
                        parent[root(groups[r])] = root(component)
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_batches(dealt, run, "a long, b long", ROWS_AT_A_TIME)


def join_components(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each document.

    ``n_shingles`` is the size of the document's set: its distinct shingles of WORDS words, or one for
    a shorter text. ``component_id`` is the smallest doc_id that links of 75 % overlap reach. A null
    or empty text has an empty set and is alone; a null id has a null component and links with nothing;
    repeated rows are one document with several rows (an id is taken to mean one text); other columns
    are ignored; no rows give no rows.
    """
    with rows_a_batch(docs.sparkSession, ROWS_AT_A_TIME):
        sets = staged(set_table(docs), "shingle-sets")
        known = sets.where("doc_id is not null and signature is not null")
        classes = staged(
            known.groupBy("signature").agg(F.min_by(
                F.struct(F.col("doc_id").alias("node"), "n", "n_first", "minima"), F.col("doc_id")).alias("c"))
            .select("signature", "c.*"), "shingle-classes",
        )
        near = staged(_compare_relatives(sets, staged(_relatives(classes), "relatives")), "near-links")
        labels = staged(components(near), "near-components")

        total = known.agg(F.sum("n_first")).first()[0] or 0
        posted = _post(sets, max(8, -(-total // POSTINGS_PER_BUCKET)))
        prefixes = staged(_prefixes(classes, _shared_shingles(posted)), "prefixes")
        more = staged(_search(sets, _routes(prefixes, labels)), "far-links")
        joined = staged(components(near.unionByName(more)), "components")

    by_signature = staged(
        classes.select("signature", "node").join(joined, "node", "left")
        .select("signature", F.coalesce("component", "node").alias("component_id")), "class-components",
    )
    return sets.join(by_signature, "signature", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
