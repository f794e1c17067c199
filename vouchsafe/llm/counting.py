"""Token counts of whole texts, huge ones by overlapping chunks.

A text of more than ``chunk`` bytes is encoded in chunks that overlap. Two neighbouring chunks are
spliced at a boundary that both agree on: a token starts there in both encodings, the tokens from
there to the last boundary of the overlap are the same, and white space stands before it. The
pre-tokenizer drops white space and never looks across it, so nothing after such a place depends on
what is before it, which proves the boundary stable. Where an overlap holds none, it is widened,
at last up to the end of the text. Memory is bounded by the chunk and its overlap.

Null texts are empty and have no tokens. Repeated rows are counted alike. A table without documents
gives an empty one. Extra columns are kept by ``counted``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.common import fresh_name, small_batches, texts_of
from vouchsafe.llm.tokens import Encoder, task_encoder, vocabulary_path

CHUNK = 1 << 15
OVERLAP = 1 << 9
LIMIT = 2048
_SPACE = b" \t\n\r\x0b\x0c"


def _cut(text: bytes, at: int) -> int:
    """The first place from ``at`` on where a character starts."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(text))


def _encoded(tokenizer: Encoder, text: bytes, start: int, end: int) -> tuple[list[int], list[int]]:
    """Ids of text[start:end] and the byte of the whole text at which each token starts."""
    part = text[start:end].decode()
    got = tokenizer.library.encode(part, add_special_tokens=False)
    if part.isascii():
        return got.ids, [start + s for s, _ in got.offsets]
    # offsets count characters
    byte_at, total = [], start
    for c in part:
        byte_at.append(total)
        total += len(c.encode())
    byte_at.append(total)
    return got.ids, [byte_at[s] for s, _ in got.offsets]


def stable_boundary(
    text: bytes, left: tuple[list[int], list[int]], right: tuple[list[int], list[int]], end: int
) -> tuple[int, int] | None:
    """Where both encodings may be spliced: numbers of the token of either that comes after.

    ``right`` starts inside what ``left`` covers up to byte ``end``.
    """
    ids, starts = left
    other_ids, other_starts = right
    # The last token before the end of the left chunk may be cut short: agree only up to it.
    begin = other_starts[0] if other_starts else end
    last = max(text.rfind(c, begin, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
    for j, s in enumerate(other_starts):
        if s >= last:
            return None
        if s == 0 or text[s - 1] not in _SPACE:
            continue
        i = bisect_left(starts, s)
        if i == len(starts) or starts[i] != s or (i and starts[i - 1] == s):
            continue
        n = bisect_left(starts, last) - i
        m = bisect_left(other_starts, last) - j
        if n == m and ids[i : i + n] == other_ids[j : j + m]:
            return i, j
    return None


def spliced_ids(
    tokenizer: Encoder, text: bytes, chunk: int = CHUNK, overlap: int = OVERLAP
) -> Iterator[list[int]]:
    """The ids of a whole text, in runs."""
    start, end = 0, _cut(text, chunk)
    current = _encoded(tokenizer, text, start, end)
    skip = 0
    while end < len(text):
        width = overlap
        while True:
            begin = _cut(text, max(start, end - width))
            # a chunk that had to grow is followed by one as long, so that growing takes no more than twice the work
            next_end = _cut(text, end + max(chunk, end - start))
            following = _encoded(tokenizer, text, begin, next_end)
            found = stable_boundary(text, current, following, end)
            if found and found[0] >= skip:
                break
            if begin == start:
                # The whole chunk holds no stable place: it doubles to the right instead.
                end = next_end
                current = _encoded(tokenizer, text, start, end)
                found = None
                break
            width *= 4
        if found is None:
            continue
        yield current[0][skip : found[0]]
        start, end, current, skip = begin, next_end, following, found[1]
    yield current[0][skip:]


def token_count(
    tokenizer: Encoder, text: bytes, chunk: int = CHUNK, overlap: int = OVERLAP
) -> int:
    return sum(map(len, spliced_ids(tokenizer, text, chunk, overlap)))


def counted(
    docs: DataFrame, text_column: str = "text", into: str = "n_tokens",
    chunk: int = CHUNK, overlap: int = OVERLAP, vocabulary: str | None = None,
) -> DataFrame:
    """``docs`` with the number of tokens of each whole text."""
    path = vocabulary or vocabulary_path()
    text = fresh_name(docs, "_t")
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    own = [F.col(f"`{c}`") for c in kept]
    table = docs.select(*own, F.col(f"`{text_column}`").cast("string").alias(text))
    names = [*kept, into]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(path) as known:
            yield from counts(known, batches)

    def counts(known: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            last = batch.num_columns - 1
            data, offsets = texts_of(batch.column(last))
            raw, at = data.tobytes(), offsets.tolist()
            found = [0] * batch.num_rows
            short = [d for d in range(batch.num_rows) if at[d + 1] - at[d] <= chunk]
            for d, ids in zip(short, known.encode([raw[at[d] : at[d + 1]] for d in short])):
                found[d] = len(ids) // 4
            for d in range(batch.num_rows):
                if at[d + 1] - at[d] > chunk:
                    found[d] = token_count(known, raw[at[d] : at[d + 1]], chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(found, pa.int64())], names
            )

    schema = docs.select(*own, F.lit(0).cast("bigint").alias(into)).schema
    for field in schema:
        field.nullable = True
    return table.mapInArrow(make, schema)
