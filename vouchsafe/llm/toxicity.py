"""Toxicity: a counterfactual-regularised classifier of whole texts.

A logistic model over the words that a text holds. To the loss on labelled texts comes a penalty for
changes of score when an identity term is swapped for another of its group, so that a neutral mention
of a group neither raises nor lowers a score. A sparsity penalty keeps the words that matter.

The model is fitted on at most ``max_labelled`` labelled texts, those with the least hash of their id;
it is a few thousand words and weights, and every whole text is scored by it.

Null and empty texts get the score of the intercept. Labels that are null are not learned from; an id
with several labels is toxic if one of them says so. Repeated rows are scored alike. Without labelled texts of both kinds every text scores
0; a table without documents gives an empty one. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.common import fresh_name, small_batches, texts_of
from vouchsafe.llm.words import find_words, text_numbers

#: Terms of one group may stand for each other in a sentence without changing what it says of them.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("girls", "boys"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("old", "young", "elderly"),
    ("deaf", "blind", "disabled"),
)
MAX_LABELLED = 20_000
MIN_TEXTS = 5
MAX_WORDS = 8_192


def term_hashes(groups=IDENTITY_TERMS) -> list[np.ndarray]:
    """The word hashes of each group's terms."""
    out = []
    for group in groups:
        raw = [t.encode() for t in group]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.cumsum([0, *map(len, raw)])
        out.append(find_words(data, offsets).hashes)
    return out


@dataclass
class WordModel:
    """Sorted word hashes, their weights, and the intercept."""

    words: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self):
        # A text's word is looked up by its low bits first; most words end there.
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found = find_words(data, offsets)
        return self.of_words(found.hashes, text_numbers(found.bounds), len(offsets) - 1)

    def of_words(self, hashes: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
        logit = np.full(n, self.intercept)
        if len(self.words):
            some = np.flatnonzero(self.low[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            hashes, texts = hashes[some], texts[some]
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[at] == hashes
            held = np.unique(texts[hit] * len(self.words) + at[hit])
            logit += np.bincount(
                held // len(self.words), self.weights[held % len(self.words)], minlength=n
            )
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


@dataclass
class Sparse:
    """Rows of feature numbers: a text's words."""

    columns: np.ndarray
    bounds: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[self.columns])])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, np.repeat(g, np.diff(self.bounds)), minlength=size)


def _screened(
    hashes: np.ndarray, texts: np.ndarray, labels: np.ndarray, always: np.ndarray,
    min_texts: int, max_words: int,
) -> np.ndarray:
    """The words that go with the label most clearly, and ``always`` where they occur."""
    words, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    positive = np.bincount(inverse, labels[texts], minlength=len(words))
    share = labels.mean()
    expected = count * share
    chi = (positive - expected) ** 2 / np.maximum(expected * (1 - share), 1e-12)
    chi[count < min_texts] = -1
    best = np.argsort(-chi, kind="stable")[:max_words]
    best = best[chi[best] > 4]
    return np.union1d(words[best], np.intersect1d(words, always))


def fit(
    hashes: np.ndarray, bounds: np.ndarray, labels: np.ndarray, groups=IDENTITY_TERMS,
    fairness: float = 3.0, l1: float = 2e-4, rounds: int = 500,
    min_texts: int = MIN_TEXTS, max_words: int = MAX_WORDS,
) -> WordModel:
    """Fit on texts given as runs of distinct word hashes.

    Minimises the mean log loss (both labels count alike in sum) plus ``fairness`` times the mean
    squared change of the logit over all swaps of an identity term that a text holds, plus an
    L1 penalty, by accelerated proximal steps.
    """
    labels = labels.astype(float)
    n = len(labels)
    if n == 0 or labels.min() == labels.max():
        return WordModel(np.zeros(0, np.uint64), np.zeros(0), -500.0)
    texts = np.repeat(np.arange(n), np.diff(bounds))
    terms = term_hashes(groups)
    words = _screened(hashes, texts, labels, np.concatenate(terms), min_texts, max_words)
    if not len(words):
        share = labels.mean()
        return WordModel(words, np.zeros(0), float(np.log(share / (1 - share))))
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    hit = words[at] == hashes
    x = Sparse(at[hit], np.searchsorted(texts[hit], np.arange(n + 1)))
    size = len(words)

    # A swap of term a for term b changes the logit by w[b] - w[a]: as many as there are texts
    # that hold a and not b. Terms outside the vocabulary have weight 0 and need no row.
    gone, come, times = [], [], []
    for group in terms:
        place = np.searchsorted(words, group)
        known = [p if p < size and words[p] == h else -1 for p, h in zip(place.tolist(), group)]
        held = np.zeros((len(group), n), bool)
        rows = np.repeat(np.arange(n), np.diff(x.bounds))
        for i, p in enumerate(known):
            if p >= 0:
                held[i, rows[x.columns == p]] = True
        for i, a in enumerate(known):
            for j, b in enumerate(known):
                if i != j and a >= 0 and (m := int((held[i] & ~held[j]).sum())):
                    gone.append(a)
                    come.append(b)
                    times.append(m)
    gone, come = np.array(gone, np.int64), np.array(come, np.int64)
    times = np.array(times, float) / max(1.0, float(sum(times)))

    weight = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (n - labels.sum()))
    def swaps(v: np.ndarray) -> np.ndarray:
        """Slope of half the penalty: its rows are e[come] - e[gone]."""
        if not len(times):
            return np.zeros(size)
        known = come >= 0
        pull = fairness * times * (np.where(known, v[come], 0.0) - v[gone])
        return np.bincount(come[known], pull[known], size) - np.bincount(gone, pull, size)

    # The step follows from the greatest curvature, found by power iteration.
    probe, top = np.ones(size) / np.sqrt(size), 0.0
    probe[: size // 2] *= -1
    for _ in range(50):
        probe = 0.25 * x.back(weight * x.times(probe), size) + 2 * swaps(probe)
        top = float(np.linalg.norm(probe))
        if top == 0:
            break
        probe /= top
    reach = 1.1 * top + 0.5
    w, b, v, vb, t = np.zeros(size), 0.0, np.zeros(size), 0.0, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.times(v) + vb, -500, 500)))
        g = weight * (p - labels)
        slope = x.back(g, size)
        slope += 2 * swaps(v)
        new = v - slope / reach
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / reach, 0)
        new_b = vb - g.sum() / reach
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_next * (new - w)
        vb = new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    kept = w != 0
    return WordModel(words[kept], w[kept], float(b))


def labelled_words(
    docs: DataFrame, labels: DataFrame, label: str, train, max_labelled: int,
    id_column: str = "doc_id", text_column: str = "text",
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes of the labelled texts learned from: (hashes, bounds, labels).

    At most ``max_labelled`` ids are taken, so what is broadcast and what reaches the driver is
    bounded whatever the tables hold; of an id's several documents one is taken.
    """
    chosen = (
        labels.where(train & F.col(label).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(id_column).agg(F.max(label).alias("_label"))
        .orderBy(F.xxhash64(id_column), id_column).limit(max_labelled)
    )
    rows = (
        docs.select(F.col(id_column), F.col(text_column).cast("string").alias("_text"))
        .join(F.broadcast(chosen), id_column)
        .groupBy(id_column).agg(F.max("_label").alias("_label"), F.min("_text").alias("_text"))
        .select("_label", "_text")
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            found = find_words(*texts_of(batch.column(1)))
            texts = text_numbers(found.bounds)
            order = np.lexsort((found.hashes, texts))
            h, t = found.hashes[order], texts[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
            h, t = h[new], t[new]
            bounds = np.searchsorted(t, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int32()),
                    pa.array([h[s:e].tobytes() for s, e in zip(bounds, bounds[1:])], pa.binary()),
                ],
                ["label", "words"],
            )

    got = rows.mapInArrow(make, "label int, words binary").toArrow()
    parts = got.column("words").to_pylist()
    hashes = np.frombuffer(b"".join(parts), np.uint64)
    return hashes, np.cumsum([0, *(len(p) // 8 for p in parts)]), got.column("label").to_numpy()


def train(
    docs: DataFrame, labels: DataFrame, train_rows, label: str = "toxic",
    max_labelled: int = MAX_LABELLED, **settings,
) -> WordModel:
    return fit(*labelled_words(docs, labels, label, train_rows, max_labelled), **settings)


def scored(
    docs: DataFrame, model: WordModel, into: str = "score", text_column: str = "text"
) -> DataFrame:
    """``docs`` with a score of every whole text in the column ``into``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = fresh_name(docs, "_t")
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    own = [F.col(f"`{c}`") for c in kept]
    table = docs.select(*own, F.col(f"`{text_column}`").cast("string").alias(text))
    names = [*kept, into]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            last = batch.num_columns - 1
            score = shared.value.scores(*texts_of(batch.column(last)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(score, pa.float64())], names
            )

    schema = docs.select(*own, F.lit(0.0).alias(into)).schema
    for field in schema:
        field.nullable = True
    return table.mapInArrow(make, schema)
