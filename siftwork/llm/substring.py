"""Repeated passages: exact windows of words behind a count-min prefilter.

Each window of WINDOW words is counted under its anchor, the least of its ANCHOR-word hashes. Equal
windows have equal anchors at different places, so an anchor's count is never below that of any of its
windows; one counter serves the dozen windows around it. Every partition makes a sparse count-min sketch
of its anchors, the sketches merge slice by slice, and the merged one says which anchors may occur twice.
A second pass over the texts groups, by 128-bit hashes, all windows whose anchor may, so no repeated
window is lost; a coarse sketch costs work only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, named, numbered, only
from .wordhash import groups, mix

WINDOW = 50
ANCHOR = 25
#: Rows of the sketch, and counters in a row for each character of the corpus (anchors are about one in 80 characters).
DEPTH = 2
PER_CHARACTER = 1 / 16
#: A row has at most 2 ** MOST_BITS counters, one bit each once merged; beyond it the sketch gets coarser.
MOST_BITS = 28
SLICE_BITS = 20
#: Words that numpy works on at once.
SEGMENT = 1 << 19

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(words: np.ndarray, width: int, which: int) -> np.ndarray:
    """Hash of words[i : i + width] for each i, by prefix sums of a polynomial that wraps."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASES[which], len(words)), dtype=np.uint64)])
    return mix((sums[width:] - sums[:-width]) * _powers(_INVERSES[which], n))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _segments(texts: list[str | None], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, text of each word, place of each word in its text, whether a window may start at the word)."""
    for indices, words, begins in groups(texts):
        sizes = np.diff(begins)
        owner = np.repeat(indices, sizes)
        place = np.arange(len(words)) - np.repeat(begins[:-1], sizes)
        starts = np.repeat(sizes, sizes) - place >= window
        for at in range(0, max(1, len(words)), SEGMENT):
            end = min(len(words), at + SEGMENT + window - 1)
            may = starts[at:end].copy()
            may[SEGMENT:] = False  # these start in the next segment
            if may.any():
                yield words[at:end], owner[at:end], place[at:end], may


def _anchors(words: np.ndarray, may: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the windows, place of each one's anchor); its value is the anchor hash at that place."""
    grams = rolling(words, anchor, 0)
    low = np.uint64((1 << 20) - 1)
    ordered = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # the first of equal hashes wins
    least = _sliding_min(ordered, window - anchor + 1)
    starts = np.flatnonzero(may[: len(least)])
    return starts, grams[(least[starts] & low).astype(np.int64)], (least[starts] & low).astype(np.int64)


def _slots(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(values ^ np.uint64(0xA5A5A5A5 * (row + 1))) >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(bits: int, window: int, anchor: int):
    slice_bits = min(SLICE_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in bounded(batches, 0):
            for words, _, _, may in _segments(batch.column(0).to_pylist(), window):
                _, values, places = _anchors(words, may, window, anchor)
                kept.append(values[np.unique(places, return_index=True)[1]])
        if not kept:
            return
        values = np.concatenate(kept)
        for row in range(DEPTH):
            slots, counts = np.unique(_slots(values, row, bits), return_counts=True)
            cut = np.searchsorted(slots >> slice_bits, np.arange((1 << (bits - slice_bits)) + 1))
            for s in np.flatnonzero(np.diff(cut)):
                a, b = cut[s], cut[s + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row], pa.int32()), pa.array([s], pa.int32()), pa.array([(slots[a:b] & ((1 << slice_bits) - 1)).astype(np.uint32).tobytes()], pa.binary()), pa.array([np.minimum(counts[a:b], 2).astype(np.uint8).tobytes()], pa.binary())],
                    ["row", "slice", "slots", "counts"],
                )

    return run


def _merge(slice_bits: int):
    def run(parts: pa.Table) -> pa.Table:
        total = np.zeros(1 << slice_bits, dtype=np.uint8)
        for slots, counts in zip(parts.column("slots").to_pylist(), parts.column("counts").to_pylist(), strict=True):
            at = np.frombuffer(slots, np.uint32)
            total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), 2)
        return pa.table({"row": parts.column("row").slice(0, 1), "slice": parts.column("slice").slice(0, 1), "twice": pa.array([np.packbits(total >= 2).tobytes()], pa.binary())})

    return run


def _windows(twice, bits: int, window: int, anchor: int):
    """A row for each run of windows at successive words with one anchor that may occur twice; hashes are 16 bytes a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.frombuffer(x, np.uint8) for x in twice.value]
        for batch in bounded(batches, 1):
            ids = batch.column(0)
            for words, owner, place, may in _segments(batch.column(1).to_pylist(), window):
                starts, values, places = _anchors(words, may, window, anchor)
                hit = np.ones(len(starts), dtype=bool)
                for row, filled in enumerate(rows):
                    slot = _slots(values, row, bits)
                    hit &= (filled[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
                starts, values, places = starts[hit], values[hit], places[hit]
                if not len(starts):
                    continue
                hashes = np.empty((len(starts), 2), np.uint64)
                hashes[:, 0], hashes[:, 1] = rolling(words, window, 0)[starts], rolling(words, window, 1)[starts]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(places) != 0)]))
                offsets = np.append(first, len(starts)).astype(np.int32) * 16
                blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(hashes.tobytes())])
                at = starts[first]
                yield pa.RecordBatch.from_arrays([pa.array(values[first].view(np.int64)), ids.take(pa.array(owner[at])), pa.array(place[at]), blobs], ["anchor", "doc_id", "at", "hashes"])

    return run


def _spans(ids: np.ndarray, at: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch | None:
    """Of all runs of some anchors: the stretches of windows that occur again, with what is known of them."""
    sizes = np.array([len(b) // 16 for b in blobs])
    hashes = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 2)
    row = np.repeat(np.arange(len(sizes)), sizes)
    doc, where = ids[row], at[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((where, doc, hashes[:, 1], hashes[:, 0]))
    h = hashes[order]
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)]))
    count = np.diff(np.append(head, len(order)))
    copies, first = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    copies[order], first[order] = np.repeat(count, count), np.repeat(order[head], count)
    again = np.flatnonzero(copies > 1)
    if not len(again):
        return None
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(again) != 1) | (np.diff(row[again]) != 0)]))
    later = (doc[first] != doc) | (where[first] != where)
    ends = np.append(begin[1:], len(again)) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[again[begin]]), pa.array(where[again[begin]]), pa.array(where[again[ends]]), pa.array(np.maximum.reduceat(copies[again], begin)), pa.array(np.minimum.reduceat(doc[first][again], begin)), pa.array(np.maximum.reduceat(later[again].astype(np.int32), begin))],
        ["doc_id", "start", "end", "copies", "first_id", "later"],
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact counts in rows sorted by anchor; what is held is the runs of one anchor, or a batch."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []

    def flush() -> pa.RecordBatch | None:
        out = _spans(np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), [b for x in held for b in x[3]]) if held else None
        held.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        anchors, ids, at, blobs = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)), batch.column(3).to_pylist()
        cut = int(np.flatnonzero(anchors == anchors[-1])[0])
        same = bool(held) and held[-1][0][-1] == anchors[0]
        if cut or not same:
            if cut:
                held.append((anchors[:cut], ids[:cut], at[:cut], blobs[:cut]))
            if (out := flush()) is not None:
                yield out
        held.append((anchors[cut:], ids[cut:], at[cut:], blobs[cut:]))
    if (out := flush()) is not None:
        yield out


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, start, end, copies, first_id, later) of (doc_id bigint, text): stretches of successive windows, all of one anchor, that occur more than once.

    Windows travel by anchor and in runs, so that a shuffled row stands for a dozen of them.
    """
    docs = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    spark = docs.sparkSession
    characters = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = int(min(most_bits, max(12, np.ceil(np.log2(max(1, characters * PER_CHARACTER))))))
    slice_bits = min(SLICE_BITS, bits)
    parts = docs.select("text").mapInArrow(_sketch(bits, window, anchor), "row int, slice int, slots binary, counts binary")
    merged = parts.groupBy("row", "slice").applyInArrow(_merge(slice_bits), "row int, slice int, twice binary")
    filled = [np.zeros((1 << bits) // 8, dtype=np.uint8) for _ in range(DEPTH)]
    step = (1 << slice_bits) // 8
    for row, at, data in merged.toLocalIterator():  # 2 ** most_bits / 8 bytes a row at most
        filled[row][at * step : (at + 1) * step] = np.frombuffer(data, np.uint8)
    twice = spark.sparkContext.broadcast([x.tobytes() for x in filled])
    found = docs.mapInArrow(_windows(twice, bits, window, anchor), "anchor bigint, doc_id bigint, at bigint, hashes binary")
    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_counted, "doc_id bigint, start bigint, `end` bigint, copies bigint, first_id bigint, later int")


def repeated_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, start_word, n_words, copies, first_doc_id, removable): maximal runs of repeated windows.

    Words are runs of anything but ASCII white space, lower case. A run joins windows at successive words
    that each occur at least twice in the corpus, in one document or in several. copies: the most that
    any of its windows has; first_doc_id: the least doc_id in which any of them occurs; removable: the
    run holds a window that isn't that window's first occurrence (by doc_id, then place), so that what
    isn't removable is what a deduplicated corpus keeps. Documents with null id or text and those
    shorter than the window have no rows: a row without an id is outside the corpus, and its windows count
    for nobody. Ids may be of any type that has an order. Rows that repeat a doc_id count as further occurrences,
    and their equal runs are listed once. A text of any length is read whole, in segments. An empty table gives an
    empty one.
    """
    docs, names = numbered(only(docs, ["doc_id", "text"]), "doc_id")
    spans = repeated_spans(docs, window, anchor, most_bits)
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", (reach.isNull() | (F.col("start") > reach + 1)).cast("int"))
    passages = (
        marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "_run")
        .agg(F.min("start").alias("start_word"), (F.max("end") - F.min("start") + window).alias("n_words"), F.max("copies").alias("copies"), F.min("first_id").alias("first_doc_id"), (F.max("later") > 0).alias("removable"))
        .drop("_run")
    )
    return named(passages, names, "doc_id", "first_doc_id")


SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), s AS (
  SELECT doc_id, r.pos::BIGINT AS pos, md5(array_to_string(w[r.pos + 1 : r.pos + 50], ' ')) AS body FROM t, unnest(range(0, len(w) - 49)) AS r(pos) WHERE len(w) >= 50
), c AS (
  SELECT doc_id, pos, count(*) OVER b AS copies, min((doc_id, pos)) OVER b AS f FROM s WINDOW b AS (PARTITION BY body)
), o AS (
  SELECT doc_id, pos, max(copies) AS copies, min(f[1]) AS first_id, max(CASE WHEN f[1] = doc_id AND f[2] = pos THEN 0 ELSE 1 END) AS later FROM c WHERE copies > 1 GROUP BY doc_id, pos
), n AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM o
)
SELECT doc_id, min(pos) AS start_word, max(pos) - min(pos) + 50 AS n_words, max(copies) AS copies, min(first_id) AS first_doc_id, max(later) > 0 AS removable
FROM n GROUP BY doc_id, run
"""
