"""Feature hashing and cosine similarity on Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLAKE2B, SHA256 = "blake2b", "sha256"
_ROWS_PER_BLOCK, _BYTES_PER_BLOCK = 1024, 1 << 20
_KNOWN_TOKENS = 1 << 17


def token_slot(token: str, provider: str) -> tuple[int, int]:
    """The 32-bit slot number and the sign of a token."""
    if not token:
        return 0, 0
    if provider == BLAKE2B:
        digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
        slot = int.from_bytes(digest[:4], "little")
    else:
        digest = hashlib.sha256(token.encode()).digest()
        slot = int.from_bytes(digest[:4], "big")
    return slot, 1 - 2 * (digest[4] & 1)


def blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of few rows and few bytes of text; a longer text is alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(texts):
        reach = ends[start] - sizes[start] + _BYTES_PER_BLOCK
        end = min(max(int(np.searchsorted(ends, reach, "right")), start + 1), start + _ROWS_PER_BLOCK)
        yield start, end
        start = end


def split_tokens(lowered: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The tokens of lower-cased texts and the row of each; empty strings may be among them."""
    split = pc.split_pattern_regex(pc.fill_null(lowered, ""), "[^a-z0-9]+")
    row_of = np.repeat(np.arange(len(split)), np.asarray(pc.list_value_length(split)))
    return row_of, pc.dictionary_encode(split.flatten())


def hash_block(lowered: pa.Array, dim: int, provider: str, known: dict) -> np.ndarray:
    """Unit vectors of a block of lower-cased texts; texts without tokens stay zero.

    ``known`` keeps slots between blocks, as most tokens come again.
    """
    row_of, coded = split_tokens(lowered)
    if len(known) > _KNOWN_TOKENS:
        known.clear()
    slots = []
    for word in coded.dictionary.to_pylist():
        slot = known.get(word)
        if slot is None:
            slot = known[word] = token_slot(word, provider)
        slots.append(slot)
    table = np.array(slots, dtype=np.int64).reshape(-1, 2)
    codes = np.asarray(coded.indices)
    index, sign = table[codes, 0] % dim, table[codes, 1]
    sums = np.bincount(row_of * dim + index, weights=sign, minlength=len(lowered) * dim)
    damped = np.sign(sums) * np.log1p(np.abs(sums))
    vectors = damped.reshape(len(lowered), dim)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def hash_vector(text: Column, dim: int, provider: str = BLAKE2B) -> Column:
    """Dense hashed vector of a whole text, null for a null text. Needs no shuffle.

    It counts as nondeterministic, or a condition on the vector would have every text hashed twice, in two workers.
    """
    known: dict = {}

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(lowered: pa.Array) -> pa.Array:
        vectors = np.empty((len(lowered), dim))
        for start, end in blocks(lowered):
            vectors[start:end] = hash_block(lowered.slice(start, end - start), dim, provider, known)
        offsets = np.arange(0, vectors.size + 1, dim, dtype=np.int32)
        mask = pc.is_null(lowered)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()), mask=mask)

    return embed.asNondeterministic()(F.lower(text))


def vector_of_text(text: str, dim: int, provider: str = BLAKE2B) -> list[float]:
    """The vector of one search query, made on the driver."""
    return hash_block(pa.array([text.lower()]), dim, provider, {})[0].tolist()


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix; every vector must have the collection's dimension."""
    lengths = np.asarray(pc.list_value_length(vectors))
    if vectors.null_count or (lengths != dim).any():
        raise ValueError(f"every vector needs {dim} components")
    return np.asarray(vectors.flatten(), dtype=np.float64).reshape(-1, dim)


def unit_rows(values: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    return np.divide(values, norms, out=np.zeros_like(values), where=norms > 0)


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine similarity to a fixed vector; 0 if either has no length."""
    dim = len(query)
    unit_query = unit_rows(np.array([query], dtype=np.float64))[0]

    @F.arrow_udf(T.DoubleType())
    def score(vectors: pa.Array) -> pa.Array:
        return pa.array(unit_rows(matrix(vectors, dim)) @ unit_query)

    return score(vector)
