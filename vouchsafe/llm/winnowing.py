"""Benchmark decontamination by winnowing.

A text's fingerprints are the least k-gram hashes of each run of ``window - k + 1`` consecutive
k-grams, so any span of ``window`` words that a document shares with a benchmark item holds a k-gram
that both selected. Items shorter than the window are one span each; for every such length that
occurs, documents are fingerprinted with k = that length and a run of one.

Document fingerprints are first tested against a bitmap of the benchmark's, of fixed size; those that
stay are joined with the benchmark's on the hash and extended word by word in both directions. Only
spans whose words really agree over the whole window count, so hashes decide nothing.

Null and empty texts have no words. Repeated documents get equal rows. Repeated items count once per
item id; an item without id counts as the empty string. Without benchmark items nothing is hit, without
documents the result is empty. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.common import fresh_name, row_key, settle, small_batches, texts_of
from vouchsafe.llm.words import find_words, gram_texts, grams

WINDOW = 13
GRAM = 7
#: Size of the bitmap as a power of two: 2 MB for 24, whatever the benchmark holds.
BITMAP_BITS = 24

PROBE = "struct<hash:bigint,pos:bigint,size:int,left:int,words:binary>"


def _least(h: np.ndarray, run: int, pick) -> np.ndarray:
    """Least (or greatest) of each ``run`` consecutive values."""
    have = 1
    while have < run:
        step = min(have, run - have)
        h = pick(h[: len(h) - step], h[step:])
        have += step
    return h


def selected(h: np.ndarray, bounds: np.ndarray, k: int, window: int) -> np.ndarray:
    """Places of the grams that are least in some window lying within one text."""
    run = window - k + 1
    if len(h) < run:
        return np.zeros(0, np.int64)
    whole = gram_texts(bounds, window, len(h) - run + 1)
    least = _least(h, run, np.minimum)
    least[~whole] = 0  # a window across texts selects nothing
    padded = np.zeros(len(h) + run - 1, np.uint64)
    padded[run - 1 : run - 1 + len(least)] = least
    return np.flatnonzero((_least(padded, run, np.maximum) == h) & (h != 0))


def _fingerprints(words, lengths: list[int], window: int, k: int):
    """(gram size, places, hashes) for the window and for each shorter length."""
    h = grams(words.hashes, k)
    at = selected(h, words.bounds, k, window)
    yield k, 0, at, h[at]
    for size in lengths:
        h = grams(words.hashes, size)
        at = np.flatnonzero(gram_texts(words.bounds, size, len(h)))
        # short items have hashes of their own, also where the sizes are equal
        yield size, size, at, h[at] ^ np.uint64(0x9E3779B97F4A7C15)


def benchmark_prints(
    items: DataFrame, id_column: str, text_column: str, window: int = WINDOW, k: int = GRAM
) -> DataFrame:
    """Fingerprints of the items: (item, hash, pos, size, left, words).

    ``size`` is 0 for spans of the window and the item's length for shorter items; ``words`` are
    those around the gram which a window can reach, ``left`` of them before it.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            words = find_words(*texts_of(batch.column(1)))
            names = batch.column(0).to_pylist()
            counts = words.counts()
            rows = []
            lengths = sorted(set(counts[(counts > 0) & (counts < window)].tolist()))
            for gram, size, at, hashes in _fingerprints(words, lengths, window, k):
                texts = np.searchsorted(words.bounds, at, "right") - 1
                for i, d, h in zip(at.tolist(), texts.tolist(), hashes.astype(np.int64).tolist()):
                    if size and counts[d] != size:
                        continue
                    rows.append((names[d], h, size, *_around(words, i, d, gram, size, window)))
            yield _batch(rows, ITEM_COLUMNS)

    table = items.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"),
        F.col(f"`{text_column}`").cast("string").alias("_text"),
    )
    return table.mapInArrow(make, "item string, hash bigint, size int, left int, words binary")


ITEM_COLUMNS = {
    "item": pa.string(), "hash": pa.int64(), "size": pa.int32(), "left": pa.int32(),
    "words": pa.binary(),
}


def _batch(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    values = list(zip(*rows)) if rows else [[] for _ in columns]
    arrays = [pa.array(list(v), t) for v, t in zip(values, columns.values())]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _around(words, i: int, d: int, gram: int, size: int, window: int) -> tuple[int, bytes]:
    """The words that windows holding this gram can reach: how many stand before it, and all."""
    reach = 0 if size else window - gram
    first = max(int(words.bounds[d]), i - reach)
    last = min(int(words.bounds[d + 1]), i + gram + reach)
    return i - first, words.text(first, last)


def bitmap_of(prints: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of the hashes: at most 2**bits / 64 rows reach the driver."""
    place = F.col("hash").bitwiseAND((1 << bits) - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    cells = (
        prints.groupBy(F.floor(place / 64).alias("cell")).agg(F.bit_or(one).alias("word")).collect()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    for cell, word in cells:
        out[cell] = word
    return out.view(np.uint8)


def _on(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    place = (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def probes(
    docs: DataFrame, prints: DataFrame, id_column: str, text_column: str,
    window: int = WINDOW, k: int = GRAM, bits: int = BITMAP_BITS,
) -> DataFrame:
    """One row per document: (id, _key, n_words, _probes), the fingerprints on the bitmap."""
    spark = docs.sparkSession
    lengths = sorted(r[0] for r in prints.where("size > 0").select("size").distinct().collect())
    bitmap = spark.sparkContext.broadcast(bitmap_of(prints, bits))
    table = docs.select(
        F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").cast("string").alias("_text"),
        F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("-")).alias("_name"),
    )
    probe = pa.struct(
        [("hash", pa.int64()), ("pos", pa.int64()), ("size", pa.int32()), ("left", pa.int32()),
         ("words", pa.binary())]
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            data, offsets = texts_of(batch.column(1))
            words = find_words(data, offsets)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for gram, size, at, hashes in _fingerprints(words, lengths, window, k):
                on = _on(bitmap.value, hashes, bits)
                at, hashes = at[on], hashes[on]
                texts = np.searchsorted(words.bounds, at, "right") - 1
                for i, d, h in zip(at.tolist(), texts.tolist(), hashes.astype(np.int64).tolist()):
                    left, around = _around(words, i, d, gram, size, window)
                    pos = i - int(words.bounds[d])
                    found[d].append(
                        {"hash": h, "pos": pos, "size": size, "left": left, "words": around}
                    )
            # the key that row_key gives
            names = batch.column(2).to_pylist()
            keys = [
                hashlib.md5(
                    f"{names[d]}\n".encode() + data[offsets[d] : offsets[d + 1]].tobytes()
                ).digest()
                if found[d]
                else None
                for d in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(keys, pa.binary()), pa.array(words.counts()),
                    pa.array([f or None for f in found], pa.list_(probe)),
                ],
                ["_id", "_key", "n_words", "_probes"],
            )

    id_type = table.schema[0].dataType.simpleString()
    return table.mapInArrow(
        make, f"_id {id_type}, _key binary, n_words bigint, _probes array<{PROBE}>"
    )


def extend(candidates: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Grow joined fingerprints word by word: (_key, item, first, last) of spans that really agree."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, item, pos, size, left, words, their_left, theirs in zip(
                *(batch.column(c).to_pylist() for c in (
                    "_key", "item", "pos", "size", "left", "words", "i_left", "i_words"
                ))
            ):
                mine, other = words.split(b" "), theirs.split(b" ")
                gram = size or k
                need = size or window
                if mine[left : left + gram] != other[their_left : their_left + gram]:
                    continue
                back = 0
                for a, b in zip(reversed(mine[:left]), reversed(other[:their_left])):
                    if a != b:
                        break
                    back += 1
                ahead = 0
                for a, b in zip(mine[left + gram :], other[their_left + gram :]):
                    if a != b:
                        break
                    ahead += 1
                if back + gram + ahead >= need:
                    rows.append((key, item, pos - back, pos + gram + ahead))
            yield _batch(rows, {
                "_key": pa.binary(), "item": pa.string(), "first": pa.int64(), "last": pa.int64()
            })

    return candidates.mapInArrow(make, "_key binary, item string, first bigint, last bigint")


def contamination(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = GRAM,
) -> DataFrame:
    """Per document: id, _key (null if nothing is hit), n_words, n_hit, items, spans.

    ``items`` are the ids of the items with a shared window, sorted as strings; ``spans`` the shared
    spans as (first, last) word numbers.
    """
    prints = settle(benchmark_prints(items, item_id, item_text, window, k), "prints")
    per_doc = settle(probes(docs, prints, id_column, text_column, window, k), "probes")
    # Several copies of a document have one key; their probes are equal.
    asked = per_doc.where("_key IS NOT NULL").select("_key", F.explode("_probes").alias("p"))
    asked = asked.select("_key", "p.*").dropDuplicates(["_key", "hash", "pos", "size"])
    theirs = prints.select(
        "item", "hash", "size", F.col("left").alias("i_left"), F.col("words").alias("i_words")
    ).distinct()
    spans = settle(extend(asked.join(theirs, ["hash", "size"]), window, k).distinct(), "spans")

    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("first", "last"))),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda done, s: F.struct(
            (done["n"] + F.greatest(s["last"] - F.greatest(s["first"], done["end"]), F.lit(0)))
            .cast("bigint").alias("n"),
            F.greatest(done["end"], s["last"]).alias("end"),
        ),
    )["n"]
    hit = (
        spans.select("_key", "first", "last").distinct()
        .groupBy("_key").agg(
            merged.alias("n_hit"),
            F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"),
        )
    )
    named = (
        spans.select("_key", "item").distinct()
        .groupBy("_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    found = hit.join(named, "_key")
    # documents without a key ask nothing: they must not meet in one partition of the join
    bare = per_doc.drop("_probes")
    joined = bare.where("_key IS NOT NULL").join(found, "_key", "left").unionByName(
        bare.where("_key IS NULL"), allowMissingColumns=True
    )
    return joined.select(
        F.col("_id").alias(id_column),
        F.when(F.col("n_hit") > 0, F.col("_key")).alias("_key"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "spans",
    )


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = contamination(docs, items, **columns).where(is_contaminated())
    name = fresh_name(docs, "_bad")
    bad = found.select(F.col("_key").alias(name)).distinct()
    key = row_key(columns.get("id_column", "doc_id"), columns.get("text_column", "text"))
    return docs.join(bad, key == F.col(name), "left_anti")
