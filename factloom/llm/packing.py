"""Packing documents into sequences of a fixed capacity by linear grouping.

All pieces of one length are interchangeable, so the packing is planned on the
histogram of lengths, which has at most ``capacity`` entries however large the
corpus is:

1. Large lengths (over 0.3 of the capacity, a parameter) are split, from the
   longest down, into groups of equal cardinality, and rounded up to the
   longest of their group: few sizes remain.
2. A configuration programme over these sizes (which multisets of sizes to use,
   and how often) is solved by column generation with an unbounded knapsack as
   pricing; its whole parts are taken.
3. The actual lengths are substituted, group by group, which leaves room.
4. What is left, and the small lengths, go in by best fit from the longest down,
   on classes of equal sequences instead of single ones.

Then every piece is numbered within its length, distributed, and its number
tells sequence and place.  Only the plan, whose size is bounded by the number of
different lengths and classes, is sent to all tasks.

A document is its ids and an end id; only longer ones are cut, into whole pieces
and a last one.  Null text is empty and gives one piece of length 1.  Rows that
share a doc_id, or have none, are packed each.  The ids of a very long text are held
by one task.  An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import few, written
from .wordpieces import batches, encoder
from .workers import bounded_batches, lean

BASES_SENT = 200_000  # rows of about 50 bytes that a broadcast may hold
PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part string, nth bigint"


def _cut(tokenizer: str, end_id: int, capacity: int):
    def run(tables):
        import uuid

        words = encoder(tokenizer)
        size = words.dtype.itemsize
        end = np.array([end_id], words.dtype).tobytes()
        part, seen = uuid.uuid4().hex[:16], Counter()

        def rows():
            for t in tables:
                yield from zip(t.column(0).to_pylist(), t.column(1).to_pylist())

        for group in batches(rows(), lambda r: len(r[1] or "")):
            out = []
            for (doc_id, _), ids in zip(group, words.encode([t for _, t in group])):
                ids = np.frombuffer(ids + end, words.dtype)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    out.append((doc_id, k, at, len(piece), zlib.crc32(piece.astype("<u4")), part, seen[len(piece)]))
                    seen[len(piece)] += 1
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
        words.forget()

    return run


def _best_pattern(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Unbounded knapsack: the multiset of sizes that is worth most."""
    step, best, took = np.array(sizes), np.zeros(capacity + 1), np.full(capacity + 1, -1)
    first = int(step.min())
    for c in range(first, capacity + 1):
        fits = step <= c
        values = np.where(fits, best[np.where(fits, c - step, 0)] + worth, -np.inf)
        i = int(values.argmax())
        if values[i] > best[c - 1] + 1e-12:
            best[c], took[c] = values[i], i
        else:
            best[c] = best[c - 1]
    pattern, c = [0] * len(sizes), capacity
    while c >= first:
        if (i := int(took[c])) < 0:
            c -= 1
        else:
            pattern[i] += 1
            c -= sizes[i]
    return float(best[capacity]), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Patterns and how often to use each, from the linear configuration programme.

    Columns are generated until none prices in; a run of 8 * len(sizes) columns that
    leave the sum as it was ends it too, as its steps then only change a basis of the
    same worth.
    """
    m = len(sizes)
    patterns = [[capacity // s if i == j else 0 for j in range(m)] for i, s in enumerate(sizes)]
    basis = np.array(patterns, float).T
    amount = np.linalg.solve(basis, np.array(demand, float))
    least, idle = np.inf, 0
    while idle < 8 * m:
        worth = np.linalg.solve(basis.T, np.ones(m))
        value, pattern = _best_pattern(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        enters = np.linalg.solve(basis, np.array(pattern, float))
        ratios = np.where(enters > 1e-9, amount / np.where(enters > 1e-9, enters, 1), np.inf)
        out = int(np.argmin(ratios))
        patterns[out] = pattern
        basis[:, out] = pattern
        amount = np.linalg.solve(basis, np.array(demand, float)).clip(0)
        idle = 0 if amount.sum() < least * (1 - 1e-9) else idle + 1
        least = min(least, amount.sum())
    return [(p, float(x)) for p, x in zip(patterns, amount)]


def plan(histogram: dict[int, int], capacity: int, groups: int = 32, small: float = 0.3) -> list[tuple[dict[int, int], int]]:
    """Classes of equal sequences: (pieces of each length, number of such sequences)."""
    left = Counter(histogram)
    large = sorted((n for n in left if n > small * capacity), reverse=True)
    classes: list[tuple[dict[int, int], int]] = []
    full = left.pop(capacity, 0)  # fills a sequence of its own
    if full:
        classes.append(({capacity: 1}, full))
    large = [n for n in large if n != capacity]
    if total := sum(left[n] for n in large):
        each = -(-total // groups)
        bins: list[list[list[int]]] = [[]]  # each group's (length, count), longest first
        room = each
        for n in large:
            count = left[n]
            while count:
                take = min(count, room)
                bins[-1].append([n, take])
                count -= take
                room -= take
                if not room:
                    bins.append([])
                    room = each
        bins = [b for b in bins if b]
        rounded = [b[0][0] for b in bins]
        for pattern, times in configurations(rounded, [sum(c for _, c in b) for b in bins], capacity):
            times = int(times + 1e-9)
            while times > 0 and any(pattern):
                # substitute: the longest of each group that are still there, in equal runs
                slots: list[tuple[int, int]] = []
                run = times
                for b, k in zip(bins, pattern):
                    if k and (have := sum(c for _, c in b)) < k:
                        run = 0
                    elif k:
                        run = min(run, have // k)
                if not run:
                    break
                # all k slots of a group take the same length while it lasts
                for b, k in zip(bins, pattern):
                    need = k
                    for item in b:
                        if not need:
                            break
                        take = min(need, item[1])
                        if take == need and take:
                            run = min(run, item[1] // take)
                        elif take:
                            run = 1
                        slots.append((item[0], take))
                        need -= take
                run = max(run, 1)
                pieces = Counter()
                for n, k in slots:
                    pieces[n] += k
                for b, k in zip(bins, pattern):
                    need = k * run
                    for item in b:
                        take = min(need, item[1])
                        item[1] -= take
                        need -= take
                    b[:] = [i for i in b if i[1]]
                for n, k in pieces.items():
                    left[n] -= k * run
                classes.append((dict(pieces), run))
                times -= run
    return _best_fit(classes, +left, capacity)


def _best_fit(classes: list[tuple[dict[int, int], int]], left: Counter, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit from the longest down; equal sequences move together."""
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []

    def put(pieces: dict[int, int], count: int) -> None:
        room = capacity - sum(n * k for n, k in pieces.items())
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((pieces, count))

    for pieces, count in classes:
        put(pieces, count)
    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                k = capacity // n
                if todo >= k:
                    put({n: k}, todo // k)
                if todo % k:
                    put({n: todo % k}, 1)
                break
            room = rooms[at]
            pieces, count = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            k = room // n  # a sequence that took one has less room still, so it takes the next
            used = min(count, todo // k)
            rest = 0
            if used < count and (rest := todo - used * k):
                put({**pieces, n: pieces.get(n, 0) + rest}, 1)
            if used:
                put({**pieces, n: pieces.get(n, 0) + k}, used)
            if more := count - used - bool(rest):
                put(pieces, more)
            todo -= used * k + rest
    return [c for room in rooms for c in by_room[room]]


class Places:
    """Where the n-th piece of a length goes."""

    def __init__(self, classes: list[tuple[dict[int, int], int]]):
        table: dict[int, list] = {}
        first = 0
        for pieces, count in classes:
            at = 0
            for n, k in sorted(pieces.items(), reverse=True):
                table.setdefault(n, []).append((count * k, first, k, at))
                at += n * k
            first += count
        self.n_sequences = first
        self.table = {}
        for n, rows in table.items():
            a = np.array(rows, np.int64)
            self.table[n] = (np.concatenate([[0], np.cumsum(a[:, 0])]), a)

    def of(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length).tolist():
            rows = np.flatnonzero(length == n)
            starts, a = self.table[n]
            i = np.searchsorted(starts, nth[rows], "right") - 1
            within = nth[rows] - starts[i]
            _, first, k, at = a[i].T
            sequence[rows] = first + within // k
            offset[rows] = at + within % k * n
        return sequence, offset


def _place(places):
    def run(tables):
        for t in tables:
            length, nth = t.column("length").to_numpy(), t.column("rank").to_numpy()
            sequence, offset = places.value.of(length, nth)
            kept = [t.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = written(docs.select("doc_id", "text").mapInArrow(lean(_cut(tokenizer, end_id, capacity)), PIECE_SCHEMA), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if few(counts, BASES_SENT) else bases.hint("merge")  # a row for each task and length
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        lean(_place(places)), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
