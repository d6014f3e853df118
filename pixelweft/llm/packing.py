"""Best-fit packing of token sequences by linear grouping.

Lengths are at most the capacity, so a histogram of them has at most that many rows whatever the corpus: the plan is
made on the driver from the histogram alone, as runs of equal steps, and each piece finds its place from its rank among
the pieces of its length. Nothing on the driver grows with the number of documents.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, quoted, slices, stage
from .tokens import encoder

#: Pieces of one length that are ranked in one task.
RANK_ROWS = 50_000


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each whole text with the end id, cut every `capacity` ids.

    Null text is empty and gives the end id alone; repeated rows give repeated pieces.
    """
    def cut(batches):
        import pyarrow as pa

        ids_of, end = encoder(vocabulary).many, end_id.to_bytes(4, "little")
        for batch in slices(batches):
            rows = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at: at + 4 * capacity]
                    for row, v in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        row.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Where the pieces of each length go, as runs.

    A run holds `count` pieces of one length, of ranks from `rank` on. `each` of them in turn go to one sequence: piece i
    of the run goes to sequence `sequence + i // each`, at `offset + (i % each) * length`.
    """

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.used: dict[int, int] = {}

    def put(self, length: int, count: int, sequence: int, offset: int, each: int = 1) -> None:
        self.runs.append((length, self.used.get(length, 0), count, sequence, offset, each))
        self.used[length] = self.used.get(length, 0) + count

    def opened(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, np.int64) for x in zip(*sorted(self.runs))) if self.runs else (np.zeros(0, np.int64),) * 6


def _configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """The fullest multiset of rounded sizes, with at most left[i] of size i: a bounded knapsack over the capacity.

    A sum keeps the first way in which it was reached, so the way back never uses a size too often.
    """
    reached = np.zeros(capacity + 1, bool)
    reached[0] = True
    last = np.full(capacity + 1, -1)
    for i, size in enumerate(sizes):
        if size > capacity:
            continue
        used = np.zeros(capacity + 1, np.int64)  # of size i, in the way to each sum
        for k in range(min(left[i], capacity // size)):
            new = np.flatnonzero(reached[:-size] & (used[:-size] == k) & ~reached[size:]) + size
            if not len(new):
                break
            reached[new], used[new], last[new] = True, k + 1, i
    how, at = [0] * len(sizes), int(np.flatnonzero(reached)[-1])
    while at:
        how[last[at]] += 1
        at -= sizes[last[at]]
    return how


def plan_packing(histogram: dict[int, int], capacity: int = 4096, large: float = 0.125, groups: int = 512) -> Plan:
    """Pack histogram[length] pieces of each length.

    Lengths above `large` of the capacity are split, longest first, in `groups` groups of equal count and rounded up to
    the longest of their group; the fullest configurations of these few sizes are used as often as the counts allow; the
    actual pieces, never longer, take the places; then the shorter pieces go, longest first, where they fit best.
    """
    plan, free = Plan(capacity), {}  # free: residual -> [(sequence, count)]
    lengths = sorted((x for x in histogram if histogram[x] > 0), reverse=True)
    big = [x for x in lengths if x > large * capacity]

    # groups of equal cardinality, each a list of [length, count]
    total = sum(histogram[x] for x in big)
    per, members = max(1, -(-total // groups)), [[]]
    room = per
    for x in big:
        n = histogram[x]
        while n:
            if not room:
                members.append([])
                room = per
            k = min(n, room)
            members[-1].append([x, k])
            n, room = n - k, room - k
    members = [m for m in members if m]
    sizes, left = [m[0][0] for m in members], [sum(k for _, k in m) for m in members]

    def draw_run(i: int, n: int):
        """The next n actual pieces of group i, as runs of one length."""
        while n:
            length, k = members[i][0]
            now = min(n, k)
            n -= now
            members[i][0][1] -= now
            if not members[i][0][1]:
                members[i].pop(0)
            yield length, now

    while any(left):
        open_ = [i for i in range(len(sizes)) if left[i]]
        left[open_[0]] -= 1  # the longest size left is in the configuration, so that it finds its partners while there are some
        how = _configuration([sizes[i] for i in open_], [left[i] for i in open_], capacity - sizes[open_[0]])
        left[open_[0]] += 1
        how[0] += 1
        slots = [i for i, n in zip(open_, how) for _ in range(n)]
        times = min(left[i] // n for i, n in zip(open_, how) if n)
        first = plan.opened(times)
        fill = [(first, times, 0)]  # runs of sequences that are equally full
        for i in slots:
            left[i] -= times
            nxt, actual = [], draw_run(i, times)
            length, k = next(actual)
            for seq, n, full in fill:
                while n:
                    if not k:
                        length, k = next(actual)
                    now = min(n, k)
                    plan.put(length, now, seq, full)
                    nxt.append((seq, now, full + length))
                    seq, n, k = seq + now, n - now, k - now
            fill = nxt
        for seq, n, full in fill:
            free.setdefault(capacity - full, []).append((seq, n))

    waiting = sorted(free)
    for x in lengths[len(big):]:
        n = histogram[x]
        at = int(np.searchsorted(waiting, x))
        heap = waiting[at:]
        heapq.heapify(heap)
        while n:
            while heap and not free.get(heap[0]):
                heapq.heappop(heap)
            if heap:
                residual = heap[0]
                seq, bins = free[residual].pop()
            else:
                residual, bins = capacity, -(-n // (capacity // x))
                seq = plan.opened(bins)
            each = residual // x
            now = min(n, bins * each)
            plan.put(x, now, seq, capacity - residual, each)
            n -= now
            whole, rest = divmod(now, each)
            for a, b, used in ((seq, whole, each), (seq + whole, 1 if rest else 0, rest), (seq + whole + bool(rest), bins - whole - bool(rest), 0)):
                if b and residual - used * x:
                    free.setdefault(residual - used * x, []).append((a, b))
        waiting = sorted(r for r, runs in free.items() if runs)
    return plan


def pack(pieces: DataFrame, capacity: int = 4096, **how) -> DataFrame:
    """pieces(doc_id, piece, length, ...) with sequence_id and offset (columns of these names are replaced). Extra columns stay; lengths are 1 to capacity.

    Pieces of equal length are ranked by document and piece within hashed parts of at most about RANK_ROWS rows, whose
    counts are added up beforehand: a length that a third of all pieces share is ranked by many tasks.
    """
    pieces = stage(pieces.drop("sequence_id", "offset"), "pieces")
    part, many, before, place_, own, parts = free_names(pieces.columns, "part", "many", "before", "rank", "piece_length", "parts")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    runs = plan_packing(histogram, capacity, **how).arrays()
    counted = pieces.sparkSession.createDataFrame([(int(x), -(-n // RANK_ROWS)) for x, n in histogram.items()], "length int, parts long").toDF(own, parts)
    dealt = (pieces.join(F.broadcast(counted), F.col("length") == F.col(own), "left").withColumn(part, F.pmod(F.xxhash64("doc_id", "piece"), F.col(parts)))
             .drop(own, parts))  # a row for each length, so at most capacity of them
    sums = dealt.groupBy("length", part).agg(F.count("*").alias(many)).withColumn(
        before, F.sum(many).over(Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)))
    ranked = dealt.join(sums.drop(many), ["length", part]).withColumn(
        place_, F.coalesce(F.col(before), F.lit(0)) + F.row_number().over(
            Window.partitionBy("length", part).orderBy("doc_id", "piece", *[c for c in ("start", "ids_crc32") if c in pieces.columns])) - 1)
    names = [f"c{k}" for k in range(len(pieces.columns))]  # Arrow functions take no names with dots
    at_length = names[pieces.columns.index("length")]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, pieces.schema)) + ", sequence_id long, offset long"
    held = pieces.sparkSession.sparkContext.broadcast(runs)  # bounded by the capacity, not by the pieces

    def place(batches):
        import pyarrow as pa

        length, rank, _, sequence, offset, each = held.value
        key = (length << 44) + rank
        for batch in batches:
            x, r = (batch.column(n).to_numpy().astype(np.int64) for n in (at_length, "place"))
            at = np.searchsorted(key, (x << 44) + r, "right") - 1
            i = r - rank[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(sequence[at] + i // each[at]), pa.array(offset[at] + i % each[at] * x)],
                [*names, "sequence_id", "offset"])

    given = ranked.select(*map(quoted, pieces.columns), place_).toDF(*names, "place")
    return given.mapInArrow(place, schema).toDF(*pieces.columns, "sequence_id", "offset")
