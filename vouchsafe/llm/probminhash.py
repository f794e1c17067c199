"""Near-duplicates by ProbMinHash.

A text is the multiset of its five-word shingles. For each shingle arrivals of a Poisson process with
the shingle's count as rate fall on registers at random; a register keeps the shingle of its first
arrival. A shingle is dropped as soon as its next arrival is later than every register's first, so
most shingles need one arrival. Two texts agree in a register with the probability Jaccard similarity of
their shingle counts, which does not depend on scale and is the plain Jaccard similarity where no
shingle repeats.

Bands of registers make candidates. In a bucket (texts equal in one band) all are compared with one of
them, its centre: with the member that shares buckets with the most texts. Linked texts form classes. Where some member is not
close enough to the centre, the distance 1 - similarity, a metric, tells who can still be close to it. If those are of several
classes, all pairs of different classes among them are compared, in tasks of two blocks of bounded size; a task returns
one link for two classes. So every two texts that share a bucket and are alike end in one class. Links are
verified by their exact similarity.

Texts of fewer than five words have one shingle, all their words; texts without words are linked to
nothing but texts that are equal. Null texts are empty. Equal texts are one node from the start, so a group of
copies costs one row each. A table without documents gives an empty one. Extra columns are ignored by ``near_duplicates`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.common import fresh_name, settle, small_batches, text_or_empty, texts_of
from vouchsafe.llm.components import components
from vouchsafe.llm.words import Words, find_words, gram_texts, grams, mix

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of all texts of a batch, by text and shingle."""
    h = grams(words.hashes, k)
    at = np.flatnonzero(gram_texts(words.bounds, k, len(h)))
    texts = np.searchsorted(words.bounds, at, "right") - 1
    h = h[at]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = np.empty(len(short), np.uint64)
        for i, d in enumerate(short.tolist()):
            own[i] = grams(words.hashes[words.bounds[d] : words.bounds[d + 1]], int(counts[d]))[0]
        texts, h = np.concatenate([texts, short]), np.concatenate([h, own])
    order = np.lexsort((h, texts))
    texts, h = texts[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (texts[1:] != texts[:-1]) | (h[1:] != h[:-1])
    start = np.flatnonzero(first)
    return texts[start], h[start], np.diff(np.append(start, len(h)))


def signatures(
    texts: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int
) -> np.ndarray:
    """The shingle in each register of each text; 0 for texts without shingles."""
    best = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, np.uint64)
    state = shingle.copy()
    arrival = np.zeros(len(shingle))
    who, rate = texts.astype(np.int64), weight.astype(np.float64)
    step = np.uint64(0x9E3779B97F4A7C15)
    while len(who):
        state = state + step
        draw = mix(state)
        arrival = arrival - np.log1p(-((draw >> np.uint64(11)) * 2.0**-53)) / rate
        place = who * registers + (mix(draw ^ step) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, place, arrival)
        won = arrival == best[place]
        kept[place[won]] = shingle[won]
        last = best.reshape(n, registers).max(axis=1)
        go = arrival < last[who]
        who, rate, arrival, state, shingle = who[go], rate[go], arrival[go], state[go], shingle[go]
    return kept.reshape(n, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard similarity of two weighted sets (sorted members, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    members = np.union1d(a[0], b[0])
    x, y = np.zeros(len(members)), np.zeros(len(members))
    x[np.searchsorted(members, a[0])] = a[1]
    y[np.searchsorted(members, b[0])] = b[1]
    both = np.flatnonzero((x > 0) & (y > 0))
    if not len(both):
        return 0.0
    # For member d: sum over e of max(x[e] / x[d], y[e] / y[d]), from sums in the order of y / x.
    with np.errstate(divide="ignore"):
        ratio = np.where(x > 0, y / np.where(x > 0, x, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    sums_x = np.concatenate([[0.0], np.cumsum(x[order])])
    sums_y = np.concatenate([[0.0], np.cumsum(y[order])])
    cut = np.searchsorted(ratio[order], ratio[both], "right")
    total = sums_x[cut] / x[both] + (sums_y[-1] - sums_y[cut]) / y[both]
    return float((1 / total).sum())


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def signed(
    docs: DataFrame, id_column: str, text_column: str, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(id, node, bands): a key of the text, and for texts with words a number for each band."""
    table = docs.select(
        F.col(id_column).alias("_id"),
        text_key(text_or_empty(f"`{text_column}`")).alias("node"),
        F.col(f"`{text_column}`").cast("string").alias("_text"),
    )
    id_type = table.schema[0].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            words = find_words(*texts_of(batch.column(2)))
            n = batch.num_rows
            found = signatures(*shingles(words), n, bands * rows).reshape(n * bands, rows)
            numbers = mix(grams_of_rows(found)).astype(np.int64)
            offsets = np.arange(0, n * bands + 1, bands, dtype=np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(offsets, mask=None), pa.array(numbers)
            )
            some = pa.array(words.counts() > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.compute.if_else(some, lists, None)],
                ["_id", "node", "bands"],
            )

    return table.mapInArrow(make, f"_id {id_type}, node binary, bands array<bigint>")


def grams_of_rows(values: np.ndarray) -> np.ndarray:
    """A hash of each row of a matrix of 64-bit values."""
    out = np.zeros(len(values), np.uint64)
    for j in range(values.shape[1]):
        out = mix(out ^ values[:, j]) * np.uint64(0xD6E8FEB86659FD93)
    return out


def texts_of_nodes(nodes: DataFrame, docs: DataFrame, text_column: str) -> DataFrame:
    """(node, text) of these nodes; of several copies one text goes on."""
    texts = docs.select(
        text_key(text_or_empty(f"`{text_column}`")).alias("node"),
        text_or_empty(f"`{text_column}`").alias("text"),
    )
    return texts.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(a, b, similarity) of pairs of nodes, from their whole texts."""
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("_b"))
    both = pairs.select("a", "b").join(second, "b").join(first, "a")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_b"):
            # pairs of one text come together: it is taken apart once
            a = batch.column("_a").dictionary_encode()
            left = _sets(a.dictionary, k)
            right = _sets(batch.column("_b"), k)
            values = [similarity(left[i], r) for i, r in zip(a.indices.to_pylist(), right)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(values, pa.float64())],
                ["a", "b", "similarity"],
            )

    return both.select("a", "b", "_a", "_b").mapInArrow(
        make, "a binary, b binary, similarity double"
    )


def _sets(column: pa.Array, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    words = find_words(*texts_of(column))
    texts, shingle, weight = shingles(words, k)
    bounds = np.searchsorted(texts, np.arange(len(column) + 1))
    return [
        (shingle[s:e], weight[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())
    ]


def _centred(members: DataFrame) -> DataFrame:
    """(bucket, node, centre, complete): members of buckets with company next to their bucket's centre.

    The centre is the member of the greatest ``weight``, the number of texts that share a bucket with
    it: of a text and its changed copies that is the text itself, which is the most alike to all. Equal
    weights stand in an order that each bucket draws. ``complete`` says that the member has been
    compared with all of its bucket.
    """
    ranked = F.struct(
        (-F.col("weight")).alias("w"), F.xxhash64("bucket", "node").alias("r"), F.col("node").alias("c")
    )
    chosen = members.groupBy("bucket").agg(
        F.min(ranked)["c"].alias("centre"), F.count("*").alias("_n")
    )
    dealt = members.join(chosen.where("_n > 1"), "bucket").where("node != centre")
    return dealt.select("bucket", "node", "centre", (F.col("_n") == 2).alias("complete"))


#: Members and bytes of shingles of a block; they bound a task's memory, not its result.
BLOCK_MEMBERS = 1024
BLOCK_SETS = 2 << 20
#: Shingles that are multiplied at once.
COLUMNS = 2048


@dataclass
class Block:
    """Weighted sets: the members of set i are ``shingle[bounds[i]:bounds[i + 1]]``, in order."""

    roots: list[bytes]
    shingle: np.ndarray
    weight: np.ndarray
    bounds: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(self.shingle, kind="stable")
        self.ordered = self.shingle[self.order]
        self.owner = np.repeat(np.arange(len(self.roots)), np.diff(self.bounds))
        sums = np.bincount(self.owner, self.weight, len(self.roots))
        self.share = self.weight / sums[self.owner]

    def one(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        s, e = self.bounds[i], self.bounds[i + 1]
        return self.shingle[s:e], self.weight[s:e]

    def dense(self, columns: np.ndarray) -> np.ndarray:
        """The sets' shares of some shingles (in order) as a matrix."""
        s = np.searchsorted(self.ordered, columns[0])
        e = np.searchsorted(self.ordered, columns[-1], "right")
        place = np.searchsorted(columns, self.ordered[s:e])
        here = columns[place] == self.ordered[s:e]
        at = self.order[s:e][here]
        out = np.zeros((len(self.roots), len(columns)), np.float32)
        out[self.owner[at], place[here]] = self.share[at]
        return out


def bounds_of(a: Block, b: Block) -> np.ndarray:
    """No pair is more alike than its bound; for sets without repeats that is the similarity.

    With P and Q the shares of the two sets that lie in their common members, each term of the
    similarity is at most pq / (q + (1 - Q) p), and as that is concave and of degree one in (p, q), the sum
    is at most PQ / (P + Q - PQ).
    """
    p = np.zeros((len(a.roots), len(b.roots)), np.float32)
    q = np.zeros_like(p)
    common = np.intersect1d(a.shingle, b.shingle)
    for start in range(0, len(common), COLUMNS):
        x, y = (s.dense(common[start : start + COLUMNS]) for s in (a, b))
        p += x @ (y > 0).astype(np.float32).T
        q += (x > 0).astype(np.float32) @ y.T
    return p * q / np.maximum(p + q - p * q, 1e-30)


def class_links(a: Block, b: Block, threshold: float) -> list[tuple[bytes, bytes]]:
    """Links that join all classes of which ``a`` and ``b`` hold two texts as alike as ``threshold``."""
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while x in up:
            x = up[x]
        return x

    number = {r: i for i, r in enumerate(dict.fromkeys(a.roots + b.roots))}
    left, right = (np.array([number[r] for r in s.roots]) for s in (a, b))
    bound = bounds_of(a, b)
    bound[left[:, None] == right[None, :]] = 0
    rows, columns = np.nonzero(bound >= threshold - 1e-3)
    order = np.argsort(-bound[rows, columns], kind="stable")
    links = []
    for i, j in zip(rows[order].tolist(), columns[order].tolist()):
        x, y = top(a.roots[i]), top(b.roots[j])
        if x != y and similarity(a.one(i), b.one(j)) >= threshold:
            up[x] = y
            links.append((x, y))
    return links


def _block(members: pa.StructScalar) -> Block:
    values = members.values
    parts = []
    for name, kind in (("shingle", np.uint64), ("weight", np.int32)):
        data, offsets = texts_of(values.field(name))
        parts.append(data.view(kind))
    return Block(values.field("root").to_pylist(), *parts, offsets // 4)


def _sets_of(texts: DataFrame) -> DataFrame:
    """(node, shingle, weight): a text's weighted set, packed."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = _sets(batch.column("text"), SHINGLE)
            packed = [
                pa.array([s[i].astype(kind).tobytes() for s in sets], pa.binary())
                for i, kind in ((0, np.uint64), (1, np.int32))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), *packed], ["node", "shingle", "weight"]
            )

    return texts.select("node", "text").mapInArrow(make, "node binary, shingle binary, weight binary")


def _compared(left: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): classes to be joined, from all pairs of a bucket's members that are of different classes.

    ``left`` is (bucket, node, root). Members of a large class have blocks of their own, which are not
    compared with each other; those of the others share blocks.
    """
    nodes = left.select("node").distinct()
    sets = settle(_sets_of(texts.join(nodes, "node", "left_semi")), "sets")
    sized = sets.select(
        "node", F.greatest(F.length("shingle") / BLOCK_SETS, F.lit(1 / BLOCK_MEMBERS)).alias("_load")
    )
    classes = left.join(sized, "node").groupBy("bucket", "root").agg(F.sum("_load").alias("_load"))
    classes = classes.withColumn(
        "own", F.when(F.col("_load") > 0.25, F.col("root")).otherwise(F.lit(b""))
    )
    parts = classes.groupBy("bucket", "own").agg(F.ceil(F.sum("_load")).alias("_parts"))
    of_class = classes.select("bucket", "root", "own").join(parts, ["bucket", "own"])
    part = F.pmod(F.xxhash64("node"), F.col("_parts")).alias("part")
    placed = left.join(of_class, ["bucket", "root"]).select(
        "bucket", F.struct("own", part).alias("block"), "node", "root"
    )
    blocks = settle(
        placed.join(sets, "node").groupBy("bucket", "block").agg(
            F.collect_list(F.struct("root", "shingle", "weight")).alias("members")
        ),
        "blocks",
    )
    keys = blocks.select("bucket", F.col("block").alias("one"))
    pairs = keys.join(keys.withColumnRenamed("one", "two"), "bucket").where(
        "one <= two AND (one.own != two.own OR one.own = X'')"
    )
    first = blocks.select("bucket", F.col("block").alias("one"), F.col("members").alias("_a"))
    second = blocks.select("bucket", F.col("block").alias("two"), F.col("members").alias("_b"))
    both = pairs.join(first, ["bucket", "one"]).join(second, ["bucket", "two"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(0), batch.column(1)):
                found += class_links(_block(x), _block(y), threshold)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], ["a", "b"]
            )

    return both.select("_a", "_b").mapInArrow(make, "a binary, b binary")


def roots_of(
    classes: DataFrame, docs: DataFrame, text_column: str, threshold: float = SIMILARITY
) -> DataFrame:
    """(node, root) for every node that is linked to another; ``classes`` is (node, bands)."""
    numbered = classes.where("bands IS NOT NULL").select(
        "node", F.posexplode("bands").alias("band", "_h")
    )
    every = numbered.select(F.xxhash64("band", "_h").alias("bucket"), "node")
    shared = every.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1")
    met = settle(every.join(shared, "bucket"), "met")  # most texts share no bucket
    weights = settle(met.groupBy("node").agg(F.sum("_n").alias("weight")), "weights")
    dealt = settle(
        _centred(met.drop("_n").join(weights, "node")).select(
            "bucket", "node", "complete",
            F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"),
        ),
        "buckets",
    )
    pairs = dealt.select("a", "b").distinct()
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    texts = settle(texts_of_nodes(nodes.distinct(), docs, text_column), "texts")
    known = settle(verified(pairs, texts), "verified")
    roots = components(known.where(F.col("similarity") >= threshold))

    judged = dealt.where("NOT complete").join(known, ["a", "b"])
    far = judged.where(F.col("similarity") < threshold).groupBy("bucket").agg(
        F.max("similarity").alias("_far")
    )
    # Close to a far member (at most `far` like the centre) can only be who is at most that
    # much more like the centre.
    open_ = judged.join(far, "bucket").where(
        F.col("similarity") <= F.col("_far") + (1 - threshold) + 1e-9
    )
    rooted = settle(
        open_.select("bucket", "node").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node")),
        "rooted",
    )
    # Open is a bucket with members of several classes not all of which have been compared.
    # Of buckets with the same members one goes on.
    of_class = rooted.groupBy("bucket", "root").agg(
        F.count("*").alias("_n"), F.bit_xor(F.xxhash64("node")).alias("_who")
    )
    sizes = of_class.groupBy("bucket").agg(
        F.sum("_n").alias("_n"), F.bit_xor("_who").alias("_who"),
        ((F.sum("_n") * F.sum("_n") - F.sum(F.col("_n") * F.col("_n"))) / 2)
        .cast("bigint").alias("_cross"),
    )
    apart = known.where(F.col("similarity") < threshold)
    one = rooted.select("bucket", F.col("node").alias("a"), F.col("root").alias("_ra"))
    two = rooted.select("bucket", F.col("node").alias("b"), F.col("root").alias("_rb"))
    compared = (
        apart.select("a", "b").join(one, "a").join(two, ["bucket", "b"])
        .where("_ra != _rb").groupBy("bucket").agg(F.count("*").alias("_known"))
    )
    groups = (
        sizes.where("_cross > 0").join(compared, "bucket", "left")
        .where(F.col("_cross") > F.coalesce("_known", F.lit(0)))
        .groupBy("_n", "_who").agg(F.min("bucket").alias("bucket"))
    )
    left = settle(rooted.join(groups, "bucket", "left_semi"), "open")
    if left.isEmpty():
        return roots
    links = settle(_compared(left, texts, threshold), "links")
    if links.isEmpty():
        return roots
    # Every class is named by its least node, so the least of joined names is the joint one's.
    joined = components(links).select(F.col("node").alias("root"), F.col("root").alias("_top"))
    own = joined.select(F.col("root").alias("node"), "root")
    return (
        roots.union(own).distinct().join(joined, "root", "left")
        .select("node", F.coalesce("_top", "root").alias("root"))
    )


def classified(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(_id, node, class_id, first): one row per document; class_id is the least id of its class.

    ``first`` marks the rows of the class's least (id, text); repeated rows share the mark.
    """
    rows = settle(signed(docs, id_column, text_column), "signed")
    classes = settle(
        rows.groupBy("node").agg(F.min("_id").alias("_id"), F.first("bands").alias("bands")),
        "classes",
    )
    roots = roots_of(classes.select("node", "bands"), docs, text_column)
    of_class = (
        classes.join(roots, "node", "left")
        .select("node", F.col("_id").alias("_least"), F.coalesce("root", "node").alias("root"))
    )
    chosen = of_class.groupBy("root").agg(
        F.min(F.struct(F.col("_least").isNull(), "_least", "node")).alias("m")
    )
    named = of_class.join(chosen, "root").select(
        "node", F.col("m._least").alias("class_id"), F.col("m.node").alias("_chosen")
    )
    return rows.select("_id", "node").join(named, "node").select(
        "_id", "node", "class_id",
        ((F.col("node") == F.col("_chosen")) & F.col("_id").eqNullSafe(F.col("class_id")))
        .alias("first"),
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, class_id, kept): one row per document."""
    return classified(docs, id_column, text_column).select(
        F.col("_id").alias(id_column), "class_id", F.col("first").alias("kept")
    )


def deduplicated(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One document of each class, with all its columns; of repeated rows one stays."""
    keep = (
        classified(docs, id_column, text_column).where("first")
        .select("node", F.col("_id").alias("_keep")).distinct()
    )
    key, own = fresh_name(docs, "_node"), [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*own, text_key(text_or_empty(f"`{text_column}`")).alias(key))
    left = keyed.join(
        keep,
        (keyed[key] == keep["node"]) & keyed[f"`{id_column}`"].eqNullSafe(keep["_keep"]),
        "left_semi",
    )
    return left.dropDuplicates([id_column, key]).drop(key)
