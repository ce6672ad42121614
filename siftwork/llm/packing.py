"""Best-fit packing of documents into sequences by a linear grouping scheme.

Only integers travel. The driver sees two histograms, of piece lengths and of the room left in bins,
both bounded by the capacity and not by the corpus; from them it plans ranges, and every executor turns
a piece's rank among equal lengths into its bin by arithmetic.

1. A document longer than the capacity is cut into full pieces and a rest. Full pieces fill bins alone.
2. Large pieces, sorted by length, form groups of equal cardinality, and count as the longest of their group.
3. A linear programme over configurations (multisets of the few sizes that fit a bin) is solved by column
   generation and rounded up; actual pieces take the places of their group.
4. Small pieces, longest first, go best-fit into the room that the actual pieces leave, then into new bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, only, ranked

CAPACITY = 2048
GROUPS = 24
#: Pieces of at most this share of the capacity are small.
SMALL = 1 / 8


def _knapsack(capacity: int, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many of each size give the greatest value within the capacity."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    use = [(int(s), float(v), i) for i, (s, v) in enumerate(zip(sizes, values, strict=True)) if v > 1e-12]
    if use:
        s = np.array([u[0] for u in use])
        v = np.array([u[1] for u in use])
        for c in range(int(s.min()), capacity + 1):
            best[c], took[c] = best[c - 1], -1
            fit = s <= c
            gain = best[c - s[fit]] + v[fit]
            j = int(gain.argmax())
            if gain[j] > best[c] + 1e-15:
                best[c], took[c] = gain[j], int(np.flatnonzero(fit)[j])
    counts = np.zeros(len(sizes), dtype=np.int64)
    c = capacity
    while c > 0 and use:
        if took[c] < 0:
            c -= 1
            continue
        size, _, i = use[took[c]]
        counts[i] += 1
        c -= size
    return counts


def configurations(capacity: int, sizes: np.ndarray, demand: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bins, pieces of each size in each of them) that hold the demand: the configuration programme, rounded up."""
    k = len(sizes)
    if not k:
        return []
    columns = [np.where(np.arange(k) == i, capacity // sizes[i], 0).astype(np.float64) for i in range(k)]
    basis = np.array(columns).T
    for _ in range(50 * k + 100):
        price = np.linalg.solve(basis.T, np.ones(k))
        new = _knapsack(capacity, sizes, price).astype(np.float64)
        if new @ price <= 1 + 1e-9:
            break
        amount, step = np.linalg.solve(basis, demand.astype(np.float64)), np.linalg.solve(basis, new)
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(amount, 0) / np.where(up, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    amount = np.linalg.solve(basis, demand.astype(np.float64))
    plan = [(int(np.ceil(max(0.0, x) - 1e-9)), np.round(basis[:, i]).astype(np.int64)) for i, x in enumerate(amount)]
    short = demand - sum(n * c for n, c in plan)
    for i in np.flatnonzero(short > 0):  # only numerical error gets here
        fit = int(capacity // sizes[i])
        plan.append((-(-int(short[i]) // fit), np.where(np.arange(k) == i, fit, 0)))
    return [(n, c) for n, c in plan if n]


class LargePlan:
    """Bins for large pieces, by their rank from the longest down."""

    def __init__(self, capacity: int, counts: dict[int, int], groups: int):
        lengths = sorted(counts, reverse=True)
        self.before = {}
        total = 0
        for length in lengths:
            self.before[length] = total
            total += counts[length]
        self.size = max(1, -(-total // groups))
        firsts = list(range(0, total, self.size))
        ends = np.cumsum([counts[x] for x in lengths]) if lengths else np.zeros(0, np.int64)
        sizes = np.array([lengths[int(np.searchsorted(ends, f, side="right"))] for f in firsts], dtype=np.int64)
        demand = np.array([min(self.size, total - f) for f in firsts], dtype=np.int64)
        merged: dict[int, int] = {}
        for s, d in zip(sizes.tolist(), demand.tolist(), strict=True):  # groups that round to one size are one size
            merged[s] = merged.get(s, 0) + d
        distinct = np.array(sorted(merged, reverse=True), dtype=np.int64)
        self.group_of = np.searchsorted(-distinct, -sizes) if len(sizes) else np.zeros(0, np.int64)
        self.group_first = np.array([firsts[int(np.argmax(self.group_of == g))] for g in range(len(distinct))], dtype=np.int64)
        plan = configurations(capacity, distinct, np.array([merged[int(s)] for s in distinct], dtype=np.int64))
        self.bins = sum(n for n, _ in plan)
        self.starts, self.bases, self.fits = [], [], []
        for g in range(len(distinct)):
            at, base, starts, bases, fits = 0, 0, [], [], []
            for n, config in plan:
                if config[g]:
                    starts.append(at)
                    bases.append(base)
                    fits.append(int(config[g]))
                    at += n * int(config[g])
                base += n
            self.starts.append(np.array(starts, dtype=np.int64))
            self.bases.append(np.array(bases, dtype=np.int64))
            self.fits.append(np.array(fits, dtype=np.int64))

    def place(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        whole = np.array([self.before[int(x)] for x in length], dtype=np.int64) + rank
        group = self.group_of[whole // self.size]
        out = np.empty(len(rank), dtype=np.int64)
        for g in np.unique(group):
            mine = group == g
            slot = whole[mine] - self.group_first[g]
            j = np.searchsorted(self.starts[g], slot, side="right") - 1
            out[mine] = self.bases[g][j] + (slot - self.starts[g][j]) // self.fits[g][j]
        return out


class SmallPlan:
    """Best-fit decreasing of small pieces into classes of bins with equal room, in ranges of ranks.

    After it, a piece (length, rank) has a class of bins and a place in it; class ``capacity + 1``
    stands for new bins.
    """

    def __init__(self, capacity: int, counts: dict[int, int], room: dict[int, int]):
        self.fresh = capacity + 1
        classes: dict[int, list[tuple[int, int, int]]] = {}
        for r, n in room.items():
            if r > 0 and n > 0:
                classes.setdefault(r, []).append((r, 0, n))
        self.new_bins = 0
        self.ranges: dict[int, list[tuple[int, int, int, int]]] = {}
        for length in sorted(counts, reverse=True):
            left, rank, out = counts[length], 0, []
            while left:
                fit = min((r for r in classes if r >= length and classes[r]), default=None)
                if fit is None:
                    each = capacity // length
                    n = -(-left // each)
                    classes.setdefault(capacity, []).append((self.fresh, self.new_bins, self.new_bins + n))
                    self.new_bins += n
                    continue
                cls, a, b = classes[fit].pop()
                if not classes[fit]:
                    del classes[fit]
                each = fit // length
                full = min(b - a, left // each)
                if full:
                    out.append((rank, cls, a, each))
                    rank, left = rank + full * each, left - full * each
                    self._back(classes, fit - each * length, cls, a, a + full)
                if a + full < b:
                    if left and left < each:
                        out.append((rank, cls, a + full, left))
                        rank, used, left = rank + left, left, 0
                        self._back(classes, fit - used * length, cls, a + full, a + full + 1)
                        full += 1
                    self._back(classes, fit, cls, a + full, b)
            self.ranges[length] = out

    @staticmethod
    def _back(classes: dict[int, list[tuple[int, int, int]]], r: int, cls: int, a: int, b: int) -> None:
        if r > 0 and a < b:
            classes.setdefault(r, []).append((cls, a, b))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cls, at = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
        for x in np.unique(length):
            mine = length == x
            table = np.array(self.ranges[int(x)], dtype=np.int64)
            j = np.searchsorted(table[:, 0], rank[mine], side="right") - 1
            cls[mine] = table[j, 1]
            at[mine] = table[j, 2] + (rank[mine] - table[j, 0]) // table[j, 3]
        return cls, at


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> DataFrame:
    """(bin_id, doc_id, piece, start_word, n_words): every word of every document in one bin of at most ``capacity`` words.

    Words are runs of anything but white space. Piece p of a document holds its words from p * capacity
    on. Documents without words (null, empty or blank texts) take no place and are absent. Repeated rows
    and null ids are packed row by row. Equal lengths are told apart by doc_id and piece only, so ties
    fall alike in every run. bin_id is no count: ids of places that rounding left empty don't occur.
    An empty table gives an empty one.
    """
    docs = only(docs, ["doc_id", "text"])
    words = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("bigint")
    sized = docs.select("doc_id", words.alias("_words")).filter("_words > 0")
    pieces = durable(
        sized.select("doc_id", "_words", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_words - 1) div {capacity}"))).alias("piece")).select(
            "doc_id", "piece", (F.col("piece") * capacity).alias("start_word"), F.least(F.lit(capacity).cast("bigint"), F.col("_words") - F.col("piece") * capacity).alias("n_words")
        )
    )
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("n_words").count().collect()}  # at most ``capacity`` rows
    bound = int(capacity * small)
    large = LargePlan(capacity, {x: n for x, n in histogram.items() if bound < x < capacity}, groups)
    full = histogram.get(capacity, 0)
    total = sum(histogram.values())
    placed = durable(ranked(pieces, ["n_words"], ["doc_id", "piece"], total, "_rank"))
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    columns = ["doc_id", "piece", "start_word", "n_words"]
    shape = ", ".join(f"{c} {kinds[c]}" for c in columns)

    def put_large(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["n_words"].to_numpy(), frame["_rank"].to_numpy()
            alone = length == capacity
            ids = rank + large.bins
            if (~alone).any():
                ids = ids.copy()
                ids[~alone] = large.place(length[~alone], rank[~alone])
            yield frame[columns].assign(bin_id=ids)

    big = placed.filter(F.col("n_words") > bound).mapInPandas(put_large, f"{shape}, bin_id bigint")
    big = durable(big.select("bin_id", *columns))
    room = big.filter(F.col("n_words") < capacity).groupBy("bin_id").agg((capacity - F.sum("n_words")).alias("room")).filter("room > 0")
    room = durable(room)
    room_of = {int(r[0]): int(r[1]) for r in room.groupBy("room").count().collect()}  # at most ``capacity`` rows
    tiny = SmallPlan(capacity, {x: n for x, n in histogram.items() if x <= bound}, room_of)

    def put_small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cls, at = tiny.place(frame["n_words"].to_numpy(), frame["_rank"].to_numpy())
            yield frame[columns].assign(_class=cls, _at=at)

    little = placed.filter(F.col("n_words") <= bound).mapInPandas(put_small, f"{shape}, _class bigint, _at bigint")
    bins = ranked(room, ["room"], ["bin_id"], sum(room_of.values()), "_at2").select(F.col("room").alias("_room"), "_at2", F.col("bin_id").alias("_bin"))
    fresh = little.filter(F.col("_class") == tiny.fresh).select((F.col("_at") + large.bins + full).alias("bin_id"), *columns)
    fitted = little.filter(F.col("_class") != tiny.fresh).join(bins, (F.col("_class") == F.col("_room")) & (F.col("_at") == F.col("_at2"))).select(F.col("_bin").alias("bin_id"), *columns)
    return big.unionByName(fitted).unionByName(fresh)
