"""Periodic runs of words, found while a text is read word by word.

Whenever an aligned block of a power of two words is complete, a catcher for it is set up. It compares the
suffixes of the growing text with its block, for as long as a period that it answers for can begin there; a
block of L words answers for the periods 2L to 4L - 1, the smallest one for all below too. A suffix of L words
is known by the names of its halves, so each appended word takes one comparison for a level, and none beyond the
first level at which the suffix is no known block. A match at distance p is a new square or the beginning of one:
it is followed backwards, and then with each appended word until period p breaks. Squares that meet are so one
stretch, and a stretch that is long enough is a run.

Two rules keep repetitive texts cheap without losing a run. A period whose match lies in a stretch of a shorter
period is no smallest period and is not followed. A match of a block that is itself repetitive would recur at
each of its repetitions; instead, ends of repetitive stretches are compared, as within a run the end of an inner
stretch recurs one period later.

Defined cases: a null text, and one without words, has no run and collapses to the empty text. Repeated rows
each get their own result. A text is one row, and memory grows with its words, not with its runs' length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchsafe.llm.common import small_batches, texts_of

#: A run has at least this many words, and at least this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the smallest block. Any run within the bars holds one, with its copy, whatever its period.
SMALLEST = 8
#: From this block on, matches of repetitive blocks are left to the ends of stretches.
REPETITIVE = 32
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class RunFinder:
    """Takes words one at a time; ``finish`` returns the runs as (start, length, period), by start, then period."""

    def __init__(self) -> None:
        self.words: list[int] = []
        self.live: dict[int, int] = {}  # period -> start of the stretch that has it up to now
        self.found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
        self.names: list[dict] = []  # by level: block -> name
        self.blocks: list[list[int]] = []  # by level: the names of the completed blocks, in order
        self.suffixes: list[deque] = []  # by level: (end, name) of late suffixes that are known blocks
        self.ends: list[deque] = []  # by level: where late repetitive stretches that hold a block ended

    def extend(self, words: list[int]) -> None:
        """Append words. Almost all of prose passes in the first test: the last 8 words are no known block."""
        first = len(self.words)
        for word in words[: max(0, SMALLEST - 1 - first)]:
            self.words.append(word)
        rest = len(self.words) - first
        if rest == len(words):
            return
        if not self.names:
            self._level()
        known, complete = self.names[0], SMALLEST - 1
        context = self.words[-complete:] + words[rest:]
        windows = zip(*(context[i:] for i in range(SMALLEST)))
        at = len(self.words)
        for at, (word, window) in enumerate(zip(words[rest:], windows), at):
            self.words.append(word)
            if self.live:
                self._advance(at)
            name = known.get(window)
            if name is not None or at & complete == complete:
                self._suffix(at, window, name)

    def _level(self) -> None:
        self.names.append({})
        self.blocks.append([])
        self.suffixes.append(deque())
        self.ends.append(deque())

    # ------------------------------------------------------------ stretches

    def _advance(self, at: int) -> None:
        """Compare the new word with the one a period before, for every period that is followed."""
        words = self.words
        word = words[at]
        broken = [p for p in self.live if words[at - p] != word]
        ended = [(self.live[p], p) for p in broken]
        for p in broken:
            del self.live[p]
        for start, p in ended:
            self._keep(start, at, p)
        for start, p in ended:
            self._stretch_ended(start, at, p)

    def _keep(self, start: int, end: int, period: int) -> None:
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
            period = min(period, self.found.get((start, end), period))
            self.found[start, end] = period

    def _stretch_ended(self, start: int, at: int, period: int) -> None:
        """A stretch broke at word ``at``: one that broke a period earlier may be its like in a longer run."""
        level, size = 0, SMALLEST
        while size < REPETITIVE or size < 4 * period:
            level, size = level + 1, 2 * size
        while size <= at - start and level < len(self.ends):
            ends = self.ends[level]
            while ends and at - ends[0] >= 4 * size:
                ends.popleft()
            if not ends or ends[-1] != at:
                for earlier in list(ends):
                    if at - earlier >= 2 * size:
                        self._follow(at - earlier, at, 0)
                ends.append(at)
            level, size = level + 1, 2 * size

    def _follow(self, period: int, at: int, matched: int) -> None:
        """Begin to follow a period of which the last ``matched`` words up to ``at`` are known to agree."""
        if period in self.live:
            return
        words = self.words
        back = at - matched
        while back >= period and words[back] == words[back - period]:
            back -= 1
        if back < at:
            self.live[period] = back - period + 1

    # ------------------------------------------------------------ catchers

    def _suffix(self, at: int, window: tuple, name: int | None) -> None:
        """Let the catchers of all levels see the text that now ends at word ``at``."""
        level, size, key = 0, SMALLEST, window
        while True:
            if level == len(self.names):
                self._level()
            names, blocks = self.names[level], self.blocks[level]
            complete = (at + 1) % size == 0
            if level:
                name = names.get(key)
            if name is not None:
                self._catch(level, size, at, name)
            elif complete:
                name = names[key] = len(names)
            else:
                return
            if complete:
                blocks.append(name)
            # the next level's suffix has this one as its right half; its left half ended before this one
            late = self.suffixes[level]
            late.append((at, name))
            while late[0][0] < at - size:
                late.popleft()
            if late[0][0] != at - size:
                return
            key = (late[0][1], name)
            level, size = level + 1, 2 * size

    def _catch(self, level: int, size: int, at: int, name: int) -> None:
        """Compare a suffix with the blocks that began a period of this level before it."""
        covered = at + 1
        for shorter, start in self.live.items():
            if size >= REPETITIVE and 4 * shorter <= size and start <= at - size + 1:
                return  # a repetitive block
            if shorter <= size and start < covered:
                covered = start
        blocks = self.blocks[level]
        nearest = 2 * size if level else 1
        last = min((at + 1 - nearest) // size, len(blocks))
        for block in range(last, max(0, (at + 1 - 4 * size) // size), -1):
            if blocks[block - 1] != name:
                continue
            period = at + 1 - block * size
            # where a shorter period holds throughout the match, this one is no smallest period
            if covered > at - size - period + 1 or period <= SMALLEST:
                self._follow(period, at, size)

    def finish(self) -> list[tuple[int, int, int]]:
        for period, start in self.live.items():
            self._keep(start, len(self.words), period)
        self.live = {}
        return sorted((start, end - start, period) for (start, end), period in self.found.items())


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """The runs of a list of words: (start, length, smallest period)."""
    if len(words) < LEAST_WORDS:
        return []
    numbers: dict = {}
    finder = RunFinder()
    finder.extend([numbers.setdefault(word, len(numbers)) for word in words])
    return finder.finish()


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that are in no run, or in the first period of each run that holds them."""
    out, done = [], 0
    for first, end in sorted((start + period, start + length) for start, length, period in runs):
        out += words[done : max(first, done)]
        done = max(done, end)
    return out + words[done:] if runs else words


def described(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of every row, its number of words, its runs, and its text with the repetitions left out."""
    carry = docs.columns if carry is None else carry
    inputs = docs.select(*carry, F.col(text).cast("binary").alias("_text_bytes"))
    schema = T.StructType(
        [*docs.select(*carry).schema.fields, *T.StructType.fromDDL(f"n_words bigint, runs {RUNS}, collapsed binary").fields]
    )
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text_bytes"):
            at = batch.schema.get_field_index("_text_bytes")
            data, offsets = texts_of(batch.column(at))
            data = data.tobytes()
            counts, runs, collapsed = [], [], []
            for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                words = data[begin:end].split()  # bytes are split at the six ASCII white-space characters
                found = runs_of(words)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), run)) for run in found])
                collapsed.append(b" ".join(kept_words(words, found)))
            yield pa.RecordBatch.from_arrays(
                [*(c for i, c in enumerate(batch.columns) if i != at), pa.array(counts, pa.int64()),
                 pa.array(runs, run_type), pa.array(collapsed, pa.binary())],
                names=schema.names,
            )

    return inputs.mapInArrow(find, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest exponent; of equal ones that with the least start, then period. Null without runs."""
    def better(best: Column, run: Column) -> Column:
        # length / period compared exactly; the runs come by start, then period, so that a later one must be greater
        wins = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | wins, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
