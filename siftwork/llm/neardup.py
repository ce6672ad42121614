"""Near duplicates by SimHash with covering locality-sensitive hashing.

A document's words, weighted by 1 + log of their counts, give a 64-bit SimHash; its word pairs give a
second one that only confirms. The first is cut into parts; of RADIUS bits that differ, all parts but some one
hold k at most. Bit i of those parts gets a vector m(i) of k + 1 bits; the mask of a non-zero vector v holds
the bits with an odd number of ones in m(i) & v. Any k or fewer vectors leave some v orthogonal to all of them, so
two hashes within RADIUS agree under at least one of the parts * (2 ** (k + 1) - 1) masks: no pair within the
radius is missed. More parts mean more masks of more bits: two parts give 126 masks of some 16 bits, three 765 of
21, and one vector a bit over the whole hash 4,095 of 32. The number of different hashes decides which cover keeps
both buckets and shuffle small (COVERS); all of them find the same pairs.

Equal hashes collapse first, so thousands of copies are one node. Nodes go to the tasks of their masked
values as packed bytes; a task compares all pairs inside a bucket and emits a spanning forest only. A task
that a hot bucket makes too large is cut into blocks, every two of which meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, durable, maybe_broadcast, only, tidy
from .wordhash import groups, mix

#: Most bits in which the hashes of words of near duplicates differ. Of sf0.1's pairs with a Jaccard (3-word shingles) of
#: 0.5 at least 10 keeps 0.94 and 11, which takes no more masks in two parts, 0.97.
RADIUS = 11
#: Most bits in which the hashes of word pairs of near duplicates differ.
CONFIRM = 18
#: Packed node entries that one bucket task takes, about; one estimated at HOT times as many is cut into blocks.
TASK_ENTRIES = 1_000_000
HOT = 4
#: One hash in so many tells which tasks are hot; that decides how work is cut, not what is compared.
SAMPLE = 64
#: Entries that numpy works on at once, and words of one text.
CHUNK = 400_000
#: Most partitions of the bucket tasks; beyond it a partition has several tasks, one after the other.
PARTITIONS = 20_000
#: (fewer different hashes than this, parts); beyond all of them masks are taken over the whole hash.
COVERS = ((1 << 25, 2), (1 << 28, 3))


def masks(radius: int = RADIUS, bits: int = 64, parts: int = 3) -> np.ndarray:
    """For all but one of ``parts`` parts of the bits (for all bits, if there is one part), one mask for each non-zero vector of k + 1 bits.

    k is the most of radius bits that some such choice of parts can hold at least. The bits' own vectors all
    have the top bit set and are otherwise spread evenly: then no mask is small, as every one holds about
    half of its parts' bits or all of them.
    """
    near = radius * (parts - 1) // parts if parts > 1 else radius
    half = 1 << near
    out = []
    for left in range(parts):
        places = [i for i in range(bits) if parts == 1 or i * parts // bits != left]
        vectors = half + np.resize(np.random.default_rng(20240229).permutation(half), len(places))
        for v in range(1, 2 * half):
            odd = np.bitwise_count(vectors & v) & 1
            out.append(sum(1 << i for i, o in zip(places, odd.tolist(), strict=True) if o))
    return np.array(out, dtype=np.uint64)


#: A lane of 64 bits counts 8 bits of the hash in its bytes.
_LANE = np.uint64(0x0101010101010101)
#: Weights are 2 + round(2 ln count), 40 at most; sums of so many words, or of so many extra weights, fit a byte.
_WORDS, _MOST = 255, 38


def _ones(owner: np.ndarray, features: np.ndarray, weight: np.ndarray | None, n: int) -> np.ndarray:
    """(n, 64) sums of the features' bits for each owner (sorted), each counted ``weight`` times."""
    votes = np.zeros((n, 64), dtype=np.int64)
    if not len(owner):
        return votes
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    sizes = np.diff(np.append(first, len(owner)))
    place = np.arange(len(owner)) - np.repeat(first, sizes)
    chunk = np.flatnonzero(place % (_WORDS if weight is None else _WORDS // _MOST) == 0)
    mine = owner[chunk]
    heads = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
    for j in range(8):
        lane = (features >> np.uint64(j)) & _LANE
        if weight is not None:
            lane *= weight
        bytes_ = np.add.reduceat(lane, chunk).view(np.uint8).reshape(-1, 8)
        votes[mine[heads], j::8] = np.add.reduceat(bytes_, heads, axis=0, dtype=np.int64)
    return votes


def _votes(owner: np.ndarray, features: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """((n, 64) weights of the bits that are set, sum of weights) over each text's features (hashes, repeated as often as they occur).

    Features are sorted together with their owner in one word of 24 and 40 bits, and hashed anew from
    those 40; sums of bits are kept in the bytes of eight lanes.
    """
    bits = np.uint64(40)
    keys = np.sort((owner.astype(np.uint64) << bits) | (features >> np.uint64(24)))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    owner, features = (keys >> bits).astype(np.int64), mix(keys & np.uint64((1 << 40) - 1))
    extra = np.minimum(np.round(2 * np.log(counts)), _MOST).astype(np.uint64)
    more = np.flatnonzero(extra)
    total = 2 * np.bincount(owner, minlength=n) + np.bincount(owner[more], extra[more], minlength=n).astype(np.int64)
    return 2 * _ones(owner, features, None, n) + _ones(owner[more], features[more], extra[more], n), total


def _simhash(owner: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
    """64-bit SimHash of each of n texts; of very many words, classes of equal ones are weighed one after the other."""
    if not len(features):
        return np.zeros(n, dtype=np.uint64)
    classes = -(-len(features) // CHUNK)
    if classes == 1:
        votes, total = _votes(owner, features, n)
    else:
        votes, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
        kind = ((features >> np.uint64(24)) % np.uint64(classes)).astype(np.uint32)
        for c in range(classes):
            mine = kind == c
            if mine.any():
                v, t = _votes(owner[mine], features[mine], n)
                votes += v
                total += t
    return np.packbits(2 * votes > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of words, hash of word pairs, whether there are words) of each text; words are lower case."""
    n = len(texts)
    one, two, some = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, bool)
    for indices, words, begins in groups(texts):
        sizes = np.diff(begins)
        owner = np.repeat(np.arange(len(indices), dtype=np.int32), sizes)
        one[indices] = _simhash(owner, words, len(indices))
        last = begins[1:][sizes > 0] - 1
        pair = words * np.uint64(0x9E3779B97F4A7C15)
        pair[:-1] += words[1:]
        pair[last[sizes[sizes > 0] == 1]] = words[last[sizes[sizes > 0] == 1]] * np.uint64(0x9E3779B97F4A7C15)
        keep = np.ones(len(words), bool)
        keep[last[sizes[sizes > 0] > 1]] = False  # a text of one word pairs it with nothing
        two[indices] = _simhash(owner[keep], mix(pair[keep]), len(indices))
        some[indices] = sizes > 0
    return one, two, some


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, 2):
        one, two, some = hashes(batch.column(2).to_pylist())
        keep = pa.array(some)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(one[some].view(np.int64)), pa.array(two[some].view(np.int64))], ["doc_id", "key", "h1", "h2"])


def _entries(batches: Iterator[pa.RecordBatch], cover: np.ndarray, tasks: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(task, mask, h1, h2) of every node under every mask, CHUNK at a time; a node goes to the task of its masked value."""
    some = max(1, CHUNK // len(cover))
    for batch in batches:
        h1, h2 = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
        for at in range(0, len(h1), some):
            a, b = h1[at : at + some], h2[at : at + some]
            table = np.tile(np.arange(len(cover), dtype=np.uint32), len(a))  # a node's entries stay together: shuffle files compress
            every = np.repeat(a, len(cover))
            masked = (every & np.tile(cover, len(a))) + table * np.uint64(0x9E3779B97F4A7C15)
            yield (mix(masked) % np.uint64(tasks)).astype(np.int64), table, every, np.repeat(b, len(cover))


def _sizes(cover: np.ndarray, tasks: int):
    """(task, n): how many entries of this partition's nodes each task gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for task, _, _, _ in _entries(batches, cover, tasks):
            for t, n in zip(*(x.tolist() for x in np.unique(task, return_counts=True)), strict=True):
                total[t] = total.get(t, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["task", "n"])

    return run


class Blocks:
    """Numbers of tasks: a task is its own number, and one that is cut into s blocks has s * (s + 1) / 2 more, one for each two blocks."""

    def __init__(self, tasks: int, cut: dict[int, int]):
        self.hot = np.array(sorted(cut), dtype=np.int64)
        self.s = np.array([cut[int(t)] for t in self.hot], dtype=np.int64)
        more = self.s * (self.s + 1) // 2
        self.base = tasks + np.cumsum(more) - more
        self.total = tasks + int(more.sum())

    def spread(self, task: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, entry): where each entry goes, once for every block that its own meets."""
        every = np.arange(len(task))
        if not len(self.hot):
            return task, every
        at = np.minimum(np.searchsorted(self.hot, task), len(self.hot) - 1)
        hot = self.hot[at] == task
        numbers, entries = [task[~hot]], [every[~hot]]
        for i in np.unique(at[hot]).tolist():
            mine = every[hot & (at == i)]
            s, block = int(self.s[i]), (mix(h1[mine] + mix(h2[mine])) % self.s[i].astype(np.uint64)).astype(np.int64)
            for other in range(s):
                low, high = np.minimum(block, other), np.maximum(block, other)
                numbers.append(self.base[i] + high * (high + 1) // 2 + low)
                entries.append(mine)
        return np.concatenate(numbers), np.concatenate(entries)


def _scatter(cover: np.ndarray, tasks: int, blocks: Blocks):
    """Each node goes, once for each mask, to the task of its masked value; entries of a task travel as one blob."""
    kind = np.dtype([("mask", "u1" if len(cover) < 256 else "u2" if len(cover) < 65536 else "u4"), ("h1", "u8"), ("h2", "u8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, table, h1, h2 in _entries(batches, cover, tasks):
            task, picked = blocks.spread(task, h1, h2)
            order = np.argsort(task, kind="stable")
            task, picked = task[order], picked[order]
            entries = np.empty(len(task), dtype=kind)
            entries["mask"], entries["h1"], entries["h2"] = table[picked], h1[picked], h2[picked]
            first = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
            ends = np.append(first[1:], len(task)).astype(np.int32)
            offsets = np.append(first, len(task)).astype(np.int32) * kind.itemsize
            blobs = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries)])
            yield pa.RecordBatch.from_arrays([pa.array(task[first]), blobs], ["task", "entries"])

    return run, kind


def near_edges(entries: np.ndarray, cover: np.ndarray, radius: int, confirm: int) -> np.ndarray:
    """(a1, a2, b1, b2) of a spanning forest of the pairs that share a bucket and are within radius and confirm.

    All pairs of a bucket compete, at growing distances in its order, but for those that are connected
    already; a bucket ends when it is one component, so thousands of near copies cost little more than
    their number.
    """
    bucket = mix((entries["h1"] & cover[entries["mask"]]) + entries["mask"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.lexsort((entries["h1"], bucket))
    bucket = bucket[order]
    twin = np.zeros(len(order), dtype=bool)
    twin[1:] = bucket[1:] == bucket[:-1]
    twin[:-1] |= twin[1:]
    order, bucket = order[twin], bucket[twin]
    if not len(order):
        return np.zeros((0, 4), np.uint64)
    h1, h2 = entries["h1"][order], entries["h2"][order]
    by = np.lexsort((h2, h1))
    fresh = np.concatenate([[True], (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])])
    node = np.empty(len(order), np.int64)
    node[by] = np.cumsum(fresh) - 1
    root = np.arange(int(fresh.sum()))
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(bucket))))
    edges: list[tuple[int, int]] = []
    alive, gap = np.arange(len(order)), 1

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    while len(alive):
        alive = alive[alive + gap < len(order)]
        alive = alive[number[alive] == number[alive + gap]]
        a, b = alive, alive + gap
        apart = root[node[a]] != root[node[b]]
        a, b = a[apart], b[apart]
        close = (np.bitwise_count(h1[a] ^ h1[b]) <= radius) & (np.bitwise_count(h2[a] ^ h2[b]) <= confirm)
        a, b = a[close], b[close]
        if len(a):
            _, one = np.unique(root[node[a]] * len(root) + root[node[b]], return_index=True)
            for i, j in zip(a[one].tolist(), b[one].tolist(), strict=True):
                x, y = find(node[i]), find(node[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    edges.append((i, j))
            while not np.array_equal(up := root[root], root):
                root = up
        if gap & (gap - 1) == 0:
            mine = root[node]
            whole = np.minimum.reduceat(mine, starts) == np.maximum.reduceat(mine, starts)
            alive = alive[~whole[number[alive]]]
        gap += 1
    if not edges:
        return np.zeros((0, 4), np.uint64)
    e = np.array(edges)
    return np.stack([h1[e[:, 0]], h2[e[:, 0]], h1[e[:, 1]], h2[e[:, 1]]], axis=1)


def _buckets(cover: np.ndarray, kind: np.dtype, radius: int, confirm: int):
    """Rows sorted by task; what is held is the entries of one task."""

    def linked(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        e = near_edges(np.frombuffer(b"".join(held), dtype=kind), cover, radius, confirm).view(np.int64)
        if len(e):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, c])) for c in range(4)], ["a1", "a2", "b1", "b2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None
        for batch in batches:
            for task, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if task != now and held:
                    yield from linked(held)
                    held.clear()
                now = task
                held.append(blob.as_py())
        if held:
            yield from linked(held)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an undirected graph (a, b); root is the least node of its component.

    Large-star and small-star rounds until nothing changes; the logarithm of the longest path bounds them in
    practice. Least neighbours are aggregated before any shuffle and joined back, so a hub's edges never meet in one
    task. Every round's edges are written to the shared folder.
    """

    def starred(edges: DataFrame) -> DataFrame:
        """With m, the least of a and its neighbours."""
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
        return edges.join(least, F.col("a") == F.col("_a")).drop("_a")

    now = durable(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = starred(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        stars = starred(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        out = durable(stars.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(stars.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        mark = out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before, now = mark, out
    return durable(out.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(out.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())


def hashed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, key, h1, h2) of the documents that have words, durable; key tells texts of one id apart."""
    docs = only(docs, ["doc_id", "text"])
    return durable(docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_hash_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key bigint, h1 bigint, h2 bigint"))


def near_groups(hashed: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM, task_entries: int = TASK_ENTRIES, parts: int | None = None) -> DataFrame:
    """(h1, h2, g1, g2): the group of every pair of hashes that has near duplicates, itself among them."""
    nodes = durable(hashed.select("h1", "h2").distinct().withColumn("n", F.monotonically_increasing_id()))
    count = nodes.count()
    cover = masks(radius, parts=parts or next((p for most, p in COVERS if count < most), 1))
    tasks = max(1, -(-count * len(cover) // task_entries))
    some = nodes.filter(F.pmod(F.xxhash64("h1", "h2"), F.lit(SAMPLE)) == 0)
    sizes = some.select("h1", "h2").mapInArrow(_sizes(cover, tasks), "task bigint, n bigint").groupBy("task").agg((F.sum("n") * SAMPLE).alias("n")).filter(F.col("n") > HOT * task_entries)
    blocks = Blocks(tasks, {r[0]: -(-2 * r[1] // task_entries) for r in sizes.collect()})  # one in HOT of the tasks at most
    scatter, kind = _scatter(cover, tasks, blocks)
    files = min(blocks.total, PARTITIONS)
    sent = nodes.select("h1", "h2").mapInArrow(scatter, "task bigint, entries binary").repartitionById(files, F.pmod("task", F.lit(files)).cast("int")).sortWithinPartitions("task")
    edges = durable(sent.mapInArrow(_buckets(cover, kind, radius, confirm), "a1 bigint, a2 bigint, b1 bigint, b2 bigint").distinct())
    # From here on a node is its number.
    side = maybe_broadcast(nodes, count, 40)
    for end in ("a", "b"):
        known = side.select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), F.col("n").alias(end))
        edges = edges.join(known, (F.col(f"{end}1") == F.col("_1")) & (F.col(f"{end}2") == F.col("_2"))).drop("_1", "_2")
    linked = components(edges)
    for end, names in (("node", ("h1", "h2")), ("root", ("g1", "g2"))):
        known = side.select(F.col("n").alias("_n"), *[F.col(h).alias(x) for h, x in zip(("h1", "h2"), names, strict=True)])
        linked = linked.join(known, F.col(end) == F.col("_n")).drop("_n")
    return durable(linked.select("h1", "h2", "g1", "g2"))


def _placed(docs: DataFrame, radius: int, confirm: int) -> DataFrame:
    """(doc_id, key, first_id, group_size, own) of the documents in groups, a row for each of theirs; own: it is the first or equals it.

    A group is aggregated, never gathered: its first row and its size come from partial sums and are joined back.
    """
    hashed = hashed_documents(docs)
    found = near_groups(hashed, radius, confirm)
    side = maybe_broadcast(found, found.count(), 64)
    grouped = durable(hashed.join(side, ["h1", "h2"], "left").select("doc_id", "key", F.coalesce("g1", "h1").alias("g1"), F.coalesce("g2", "h2").alias("g2")))
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col("key").alias("k"))
    groups_ = grouped.groupBy(F.col("g1").alias("_g1"), F.col("g2").alias("_g2")).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups_ = durable(groups_)
    side = maybe_broadcast(groups_, groups_.count(), 80)
    own = F.col("doc_id").eqNullSafe(F.col("_first.id")) & (F.col("key") == F.col("_first.k"))
    return grouped.join(side, (F.col("g1") == F.col("_g1")) & (F.col("g2") == F.col("_g2"))).select("doc_id", "key", F.col("_first.id").alias("first_id"), "group_size", own.alias("own"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM) -> DataFrame:
    """(doc_id, duplicate_of, group_size): every document but the first of each group of near duplicates.

    Groups are the connected components of the relation "the hashes of words differ in at most radius bits
    and those of word pairs in at most confirm"; duplicate_of is the least doc_id of the group, and
    group_size its rows. Documents without words (null, empty, blank) are in no group. Of rows that repeat
    an id all but one are listed. Null ids sort after others. A text of any length is hashed whole, in steps. An
    empty table gives an empty one.
    """
    placed = _placed(docs, radius, confirm)
    columns = ["doc_id", F.col("first_id").alias("duplicate_of"), "group_size"]
    again = placed.filter("own").groupBy("doc_id", "key", "first_id", "group_size").agg((F.count(F.lit(1)) - 1).alias("n")).filter("n > 0")
    million = F.lit(1_000_000)
    # A first row that repeats is listed as often as it does beyond once, exploded in two steps of bounded arrays.
    again = again.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(n - 1) div 1000000")))).withColumn("_u", F.explode(F.array_repeat(F.lit(0), F.least(million, F.col("n") - F.col("_t") * million).cast("int"))))
    return placed.filter("NOT own").select(*columns).unionByName(again.select(*columns))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM) -> DataFrame:
    """``docs`` with the first document of each group of :func:`near_duplicates`; all columns unchanged.

    First is the least doc_id (null after all others), then the least hash of the text. Documents without words
    (null, empty, blank) all stay. Of rows with the same id and text the one stays whose columns have the least hash, so
    that every run keeps the same. An empty table gives an empty one.
    """
    names = tidy(docs, ["doc_id", "text"]).columns
    docs = tidy(docs, ["doc_id", "text"], ("_id", "_key", "_own", "_rows", "_kept"))
    lost = durable(_placed(docs, radius, confirm).groupBy("doc_id", "key").agg(F.max(F.col("own").cast("int")).alias("_own"), F.count(F.lit(1)).alias("_rows")).filter("_own = 0 OR _rows > 1").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_own"))
    side = maybe_broadcast(lost, lost.count(), 32)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    repeated = lost.filter("_own = 1")
    if repeated.isEmpty():
        return docs.join(side, same, "left_anti").toDF(*names)
    marked = docs.join(side, same, "left")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = marked.filter("_own = 1").groupBy("_id", "_key").agg(F.min_by(whole, F.xxhash64(*plain)).alias("_kept")).select("_kept.*")
    return marked.filter(F.col("_own").isNull()).drop("_id", "_key", "_own").unionByName(one).toDF(*names)
