"""Best-fit packing by exact complements.

Documents become token ids plus an end id; those longer than the capacity are cut into pieces. What
decides the packing is only how many pieces there are of each length, a table of at most
``capacity`` counts whatever the corpus. On it the plan is made: combinations of one, two or three
lengths whose sum exactly fills the gap that a piece leaves are consumed as often as the counts
allow; what remains is placed best fit. The plan is a bounded list of ranges "the pieces number
lo.. of length L go to sequences number s.. at offset o", and every piece finds its range by its
number within its length.

Pieces are numbered while they are made: a task counts by length, and running sums over tasks give
each (task, length) its first number. No piece is sorted, grouped or collected.

Null texts are empty: they hold the end id alone. Repeated rows are packed once each. An empty table
gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vouchsafe.llm.common import settle, small_batches, texts_of
from vouchsafe.llm.tokens import TEXT_BYTES, task_encoder, vocabulary_path

CAPACITY = 4096
END_ID = 1


def pieces(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """Each document's pieces: (id, piece, start, length, ids_crc32[, ids], _task, _serial).

    ``ids`` are little-endian unsigned 32-bit ids. ``_serial`` numbers the pieces of one length
    within the task that made them.
    """
    path = vocabulary or vocabulary_path()
    table = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("_text"))
    id_type = table.schema[0].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity
    schema = (
        f"`{id_column}` {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint,"
        f" ids binary, _task int, _serial bigint"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(path) as known:
            yield from cut_with(known.encode, batches)

    def cut_with(encode, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64).tolist()
        for batch in small_batches(batches, "_text", TEXT_BYTES):
            data, offsets = texts_of(batch.column(1))
            raw = data.tobytes()
            at = offsets.tolist()
            rows, piece, start, length, crc, ids, serial = [], [], [], [], [], [], []
            whole = encode([raw[s:e] for s, e in zip(at, at[1:])])
            for row, own in enumerate(whole):
                own += end
                for number, s in enumerate(range(0, len(own), width)):
                    part = own[s : s + width]
                    n = len(part) // 4
                    rows.append(row)
                    piece.append(number)
                    start.append(s // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    ids.append(part if with_ids else None)
                    serial.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([task] * len(rows), pa.int32()),
                    pa.array(serial, pa.int64()),
                ],
                [id_column, "piece", "start", "length", "ids_crc32", "ids", "_task", "_serial"],
            )

    out = table.mapInArrow(cut, schema)
    return out if with_ids else out.drop("ids")


@dataclass
class Plan:
    """Ranges of piece numbers by length, sorted by (length, lo)."""

    length: np.ndarray
    lo: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and numbers."""
        keys = (self.length << 48) | self.lo
        at = np.searchsorted(keys, (length << 48) | number, "right") - 1
        past = number - self.lo[at]
        copies = self.copies[at]
        return self.sequence[at] + past // copies, self.offset[at] + past % copies * length


class _Stock:
    """How many pieces of each length are left, and the patterns taken from them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.patterns: list[tuple[list[tuple[int, int]], int]] = []

    def take(self, *lengths: int) -> bool:
        """Take this combination as often as it is available; false if it is not."""
        need = Counter(lengths)
        times = min(int(self.left[x]) // c for x, c in need.items())
        if times:
            self.patterns.append((sorted(need.items(), reverse=True), times))
            for x, c in need.items():
                self.left[x] -= c * times
        return times > 0

    def pair(self, total: int) -> tuple[int, int] | None:
        """The most available pair of lengths with this sum."""
        low = self.left[1 : total // 2 + 1]
        high = self.left[total - 1 : total - 1 - len(low) : -1] if len(low) else low
        both = np.minimum(low, high)
        if total % 2 == 0 and len(both):
            both[-1] = self.left[total // 2] // 2
        if not len(both) or both.max() == 0:
            return None
        x = int(both.argmax()) + 1
        return x, total - x

    def pair_sums(self) -> np.ndarray:
        """Which sums some pair of the lengths left may have: an index that only over-estimates."""
        own = sum(1 << int(x) for x in np.flatnonzero(self.left))
        sums = 0
        for x in np.flatnonzero(self.left).tolist():
            sums |= own << x
        bits = sums & ((1 << (self.capacity + 1)) - 1)
        size = (self.capacity + 8) // 8
        return np.unpackbits(
            np.frombuffer(bits.to_bytes(size, "little"), np.uint8), bitorder="little"
        ).astype(bool)

    def singles(self) -> None:
        for x in range(self.capacity - 1, (self.capacity - 1) // 2, -1):
            if self.left[x]:
                self.take(x, self.capacity - x)

    def pairs(self) -> None:
        for x in range(self.capacity - 2, 0, -1):
            while self.left[x]:
                found = self.pair(self.capacity - x)
                if found is None or not self.take(x, *found):
                    break

    def triples(self) -> None:
        sums, misses = self.pair_sums(), 0
        for x in range(self.capacity - 3, 0, -1):
            gap = self.capacity - x
            while self.left[x]:
                second = np.flatnonzero(self.left[: min(x, gap - 2) + 1])[::-1]
                second = second[sums[gap - second]]
                for y in second.tolist():
                    found = self.pair(gap - y)
                    if found and self.take(x, y, *found):
                        break
                    misses += 1
                else:
                    break
                if misses > 500:
                    sums, misses = self.pair_sums(), 0

    def best_fit(self) -> None:
        while len(lengths := np.flatnonzero(self.left)):
            gap, chosen = self.capacity, []
            for x in lengths[::-1].tolist():
                if x <= gap:
                    copies = min(int(self.left[x]), gap // x)
                    chosen += [x] * copies
                    gap -= copies * x
            self.take(*chosen)


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of so many pieces of each length; its size is bounded by the capacity alone."""
    stock = _Stock(counts, capacity)
    stock.take(capacity)
    stock.singles()
    stock.pairs()
    stock.triples()
    stock.best_fit()
    used, ranges, sequence = Counter(), [], 0
    for pattern, times in stock.patterns:
        offset = 0
        for length, copies in pattern:
            ranges.append((length, used[length], copies, sequence, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    columns = np.array(sorted(ranges), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequence)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places for settled ``pieces``: adds sequence_id and offset.

    Only the counts by length (at most ``capacity`` rows) and the plan made of them pass through
    the driver; the plan is broadcast, and its size is bounded by the capacity.
    """
    spark = cut.sparkSession
    # One row for each task and length; several tasks' counts of a length are summed in order.
    of_task = cut.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    firsts = of_task.select(
        "_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")
    )
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    plan = spark.sparkContext.broadcast(make_plan(counts, capacity))
    kept = [f for f in cut.schema if f.name[0] != "_"]
    keep = [f.name for f in kept]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("_serial").to_numpy() + batch.column("_first").to_numpy()
            sequence, offset = plan.value.place(length, number)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)],
                [*keep, "sequence_id", "offset"],
            )

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    schema = ", ".join([*names, "sequence_id bigint", "offset bigint"])
    return cut.join(firsts, ["_task", "length"]).mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that carry ``ids``.

    A sequence gathers at most ``capacity`` ids, so no group is unbounded.
    """
    part = F.struct("offset", "ids")
    joined = F.aggregate(
        F.array_sort(F.collect_list(part)),
        F.lit(b"").cast("binary"),
        lambda done, p: F.concat(done, p["ids"]),
    )
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digest form: each piece with the checksum of its ids and its place."""
    cut = settle(pieces(docs, id_column, text_column, with_ids=False), "pieces")
    return pack(cut)
