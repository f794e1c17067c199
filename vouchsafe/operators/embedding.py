"""Feature-hashed embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchsafe.functions.text import is_blank, tokens
from vouchsafe.functions.vectors import BLAKE2B, SHA256, blocks, hash_block, hash_vector, split_tokens


class Embedder(Protocol):
    """The seam for other embedders: a named column expression of known dimension."""

    dim: int
    model: str

    def vector(self, text: Column) -> Column: ...


class HashingEmbedder:
    def __init__(self, dim: int = 256, model: str = "hashing-tfidf-v1", provider: str = BLAKE2B):
        self.dim, self.model, self.provider = dim, model, provider

    def vector(self, text: Column) -> Column:
        return hash_vector(text, self.dim, self.provider)


def embed(df: DataFrame, embedder: Embedder, text: str = "_search_text") -> DataFrame:
    """Add ``_vector``; blank texts get none. Each row is embedded where it is."""
    return df.withColumn(
        "_vector", embedder.vector(F.when(~is_blank(F.col(text)), F.col(text)))
    )


def coverage() -> Column:
    """Aggregate: share of rows with a vector, 0 for an empty batch."""
    return F.coalesce(F.avg(F.col("_vector").isNotNull().cast("double")), F.lit(0.0))


def embedding_report(embedded: DataFrame, embedder: Embedder) -> DataFrame:
    has_vector = F.col("_vector").isNotNull()
    return embedded.agg(
        F.lit(embedder.model).alias("model"),
        F.lit(embedder.dim).alias("dim"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(has_vector).alias("embedded"),
        F.count_if(~has_vector).alias("skipped_empty_text"),
        coverage().alias("coverage"),
    )


def by_repetition(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key no other row has, and the rest, if there are any. A null key is a key."""
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = counts.where("_n > 1").select("_key")
    if repeated.isEmpty():
        return df, None
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(repeated, same, "left_anti"), df.join(repeated, same, "left_semi")


def _exploded_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows ``(key, token, tf)``, for texts in several rows."""
    return (
        df.select(key, F.explode(tokens(F.col(text))).alias("token"))
        .groupBy(key, "token")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def token_totals(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows ``(token, occurrences, documents)``; ``key`` identifies a text, those of a repeated key are one.

    A block of texts is counted where it is, so what is grouped are sums by token, not the tokens of each text.
    Texts without a key occur, but are no documents.
    """
    single, repeated = by_repetition(df, key)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lowered, has_key = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for start, end in blocks(lowered):
                row_of, coded = split_tokens(lowered.slice(start, end - start))
                codes, distinct = np.asarray(coded.indices), len(coded.dictionary)
                row, code = np.divmod(np.unique(row_of * distinct + codes), distinct)
                occurrences = np.bincount(codes, minlength=distinct)
                documents = np.bincount(code[has_key[start:end][row]], minlength=distinct)
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary, pa.array(occurrences), pa.array(documents)], ["token", *totals]
                )

    totals = ["occurrences", "documents"]
    schema = "token string, occurrences bigint, documents bigint"
    lowered = single.select(F.lower(F.col(text)), F.col(key).isNotNull())
    counts = lowered.mapInArrow(count, schema).where("token <> ''")
    if repeated is not None:
        more = _exploded_counts(repeated, key, text)
        counts = counts.unionByName(
            more.groupBy("token").agg(F.sum("tf").alias(totals[0]), F.count(key).alias(totals[1]))
        )
    return counts.groupBy("token").agg(*(F.sum(c).alias(c) for c in totals))


def sparse_embedding(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """The same embedding as rows ``(key, idx, weight)``, hashed with SHA-256.

    ``key`` identifies a text, those of a repeated key are one. A text in one row is counted and scaled where it is;
    only texts in several rows are shuffled, as the sums of their tokens.
    """
    single, repeated = by_repetition(df.select(key, text), key)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, idx bigint, weight double"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            keys, lowered = batch.columns
            for start, end in blocks(lowered):
                vectors = hash_block(lowered.slice(start, end - start), dim, SHA256, known)
                row, index = np.nonzero(vectors)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row + start)), pa.array(index), pa.array(vectors[row, index])],
                    [key, "idx", "weight"],
                )

    out = single.select(key, F.lower(F.col(text)).alias("_lowered")).mapInArrow(weigh, schema)
    return out if repeated is None else out.unionByName(_sparse_of_repeated(repeated, key, text, dim))


def _sparse_of_repeated(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    digest = F.sha2(F.col("token"), 256)
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    even = F.instr(F.lit("02468ace"), F.substring(digest, 10, 1)) > 0
    # a token is hashed once per text, however often it stands there
    sums = (
        _exploded_counts(df, key, text)
        .select(
            key, (slot % dim).alias("idx"), F.when(even, F.col("tf")).otherwise(-F.col("tf")).alias("s")
        )
        .groupBy(key, "idx")
        .agg(F.sum("s").alias("tf"))
        .where("tf <> 0")
    )
    damped = F.signum("tf") * F.log1p(F.abs("tf"))
    of_text = Window.partitionBy(key)
    return (
        sums.withColumn("w", damped)
        .withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(of_text)))
        .select(key, "idx", (F.col("w") / F.col("norm")).alias("weight"))
    )
