"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good documents; the rest of the web text is unlabelled. The share of
good text among the unlabelled is estimated first: it can be at most the ratio of how often a set
holds unlabelled and how often it holds positive texts, and the least such ratio over the upper sets of a
first classifier's score is taken. Then the non-negative unbiased risk is minimised: the loss of positives
as such, plus the loss of the unlabelled as negatives less what positives would add to it, which is
not let below zero. The model is additive over binned measures of a text (shares of kinds of characters,
word lengths, repetition, lines); labels of bad texts are not used.

All documents are the unlabelled side: bin edges, prior, risk and intercept are sums over every row,
added up in tasks. Only trusted positives are bounded: at most ``max_positive``, those with the least
hash of their id. The risk is convex with the logistic loss, so a few Newton steps suffice, each of
them one pass over a narrow table of cell numbers; the texts are read once to make it.

Null and empty texts have measures of zero and are scored by them. An id with several labels is positive if one of them says so. Repeated
rows count each and are scored alike; rows without id count too. Very long texts are measured whole, one at a time. Without positives, or
without documents, every text scores 0. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.common import fresh_name, settle, small_batches, texts_of
from vouchsafe.llm.words import IS_SPACE, find_words, grams, gram_texts, text_numbers

MAX_POSITIVE = 10_000
BINS = 16
#: Tasks that add up what the tasks of a pass found, and so the rows that reach the driver.
SUM_TASKS = 8
#: A measure's cell is the place of its magnitude between 2^-16 and 2^16, 256 cells to a doubling.
OCTAVE, OCTAVES = 256, 32
TOP_CELL = OCTAVE * OCTAVES
MEASURES = (
    "log_words", "word_length", "lower", "upper", "digit", "symbol", "stop", "mark", "pipe",
    "same_as_before", "repeated_words", "repeated_grams", "line_words", "repeated_lines",
)


def _mask(text: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(text)] = 1
    return out


_KINDS = (
    _mask(bytes(range(97, 123)) + bytes(range(128, 256))), _mask(bytes(range(65, 91))),
    _mask(bytes(range(48, 58))), _mask(b"#*$%&<>@^~=+{}[]\\_"), _mask(b".?"), _mask(b"!"),
    _mask(b"|"),
)
_IN_WORD, _IN_LINE = ~IS_SPACE, np.ones(256, bool)
_IN_LINE[10] = False


def _distinct(texts: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different values each text has (by 40 bits of them)."""
    keys = np.sort((texts.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=n)


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of measures for each text, in the order of ``MEASURES``."""
    n = len(offsets) - 1
    words = find_words(data, offsets, lower=False, table=_IN_WORD)
    lines = find_words(data, offsets, lower=False, table=_IN_LINE)
    n_words, n_lines = words.counts(), lines.counts()
    per_word, per_line = np.maximum(n_words, 1), np.maximum(n_lines, 1)
    chars = np.bincount(text_numbers(words.bounds), words.ends - words.starts, minlength=n)
    per_char = np.maximum(chars, 1)
    sums = []
    for kind in _KINDS:
        running = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        sums.append(running[offsets[1:]] - running[offsets[:-1]])
    texts = text_numbers(words.bounds)
    same = np.zeros(len(texts), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (texts[1:] == texts[:-1])
    three = grams(words.hashes, 3)
    whole = np.flatnonzero(gram_texts(words.bounds, 3, len(three)))
    n_three = np.bincount(texts[whole], minlength=n)
    return np.stack(
        [
            np.log1p(n_words),
            chars / per_word,
            *(s / per_char for s in sums[:3]),
            *(s / per_word for s in sums[3:]),
            np.bincount(texts[same], minlength=n) / per_word,
            (n_words - _distinct(texts, words.hashes, n)) / per_word,
            (n_three - _distinct(texts[whole], three[whole], n)) / np.maximum(n_three, 1),
            np.log1p(n_words / per_line),
            (n_lines - _distinct(text_numbers(lines.bounds), lines.hashes, n)) / per_line,
        ],
        axis=1,
    )


def cells(x: np.ndarray) -> np.ndarray:
    """The cell numbers of measures, in the order of the measures; what is beyond the range is in the outermost."""
    bits = np.abs(x).astype(np.float32).view(np.int32) >> (23 - OCTAVE.bit_length() + 1)
    least = (127 - OCTAVES // 2) * OCTAVE
    return (np.sign(x) * np.clip(bits - least + 1, 0, TOP_CELL)).astype(np.int16)


@dataclass
class QualityModel:
    """Bin edges of each measure (cell numbers), a weight for each bin, and the intercept."""

    edges: list[np.ndarray]
    weights: np.ndarray
    intercept: float
    prior: float

    def places(self, cell: np.ndarray) -> np.ndarray:
        width = self.weights.shape[1]
        columns = [np.searchsorted(e, cell[:, j], "right") for j, e in enumerate(self.edges)]
        return np.stack(columns, axis=1) + np.arange(len(self.edges)) * width

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.weights.ravel()[self.places(cells(x))].sum(axis=1) + self.intercept

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


#: A kernel takes the halves and cells of some rows and returns sums over them, a vector of fixed length.
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: A pass returns a kernel's sums over all unlabelled rows.
Pass = Callable[[Kernel], np.ndarray]


def histogram(cell: np.ndarray) -> np.ndarray:
    """How many rows each cell of each measure holds."""
    n = 2 * TOP_CELL + 1
    return np.concatenate([np.bincount(c.astype(np.int64) + TOP_CELL, minlength=n) for c in cell.T]).astype(float)


def bin_edges(counts: np.ndarray, bins: int) -> list[np.ndarray]:
    """Edges at even shares of the rows; rare extremes have bins of their own."""
    shares = np.union1d(np.linspace(0, 1, bins + 1)[1:-1], [0.005, 0.02, 0.98, 0.995])
    running = np.cumsum(counts.reshape(-1, 2 * TOP_CELL + 1), axis=1)
    return [np.unique(np.searchsorted(r, shares * r[-1], "left")) - TOP_CELL for r in running]


def _curved(places: np.ndarray, z: np.ndarray, k: int, width: int) -> np.ndarray:
    """Sums of loss, slope and curvature of softplus(z) over rows: a vector.

    Its parts are the rows, the loss, slope and curvature of the intercept, slopes and curvatures of
    all weights, and curvatures of the pairs of bins of each two measures.
    """
    score = _sigmoid(z)
    curve = score * (1 - score)
    local = places - np.arange(k) * width
    size, flat = k * width, places.ravel()
    parts = [
        [len(z), np.logaddexp(0, z).sum(), score.sum(), curve.sum()],
        np.bincount(flat, np.repeat(score, k), size),
        np.bincount(flat, np.repeat(curve, k), size),
    ]
    for i in range(k):
        for j in range(i + 1, k):
            parts.append(np.bincount(local[:, i] * width + local[:, j], curve, width * width))
    return np.concatenate(parts)


def _unpacked(sums: np.ndarray, k: int, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss, slope and curvature, the intercept being the last weight."""
    n, size = max(sums[0], 1.0), k * width
    slope = np.append(sums[4 : 4 + size], sums[2])
    single = sums[4 + size : 4 + 2 * size]
    curve = np.zeros((size + 1, size + 1))
    curve[np.arange(size), np.arange(size)] = single
    curve[size, :size] = curve[:size, size] = single
    curve[size, size] = sums[3]
    at = 4 + 2 * size
    for i in range(k):
        for j in range(i + 1, k):
            block = sums[at : at + width * width].reshape(width, width)
            own, other = slice(i * width, (i + 1) * width), slice(j * width, (j + 1) * width)
            curve[own, other], curve[other, own] = block, block.T
            at += width * width
    return sums[1] / n, slope / n, curve / n


#: Value, slope and curvature at some weights, and the part of the value that comes from negatives.
Measured = tuple[float, np.ndarray, np.ndarray, float]


def _minimise(
    evaluate: Callable[[list[np.ndarray]], list[Measured]], start: list[np.ndarray], rounds: int
) -> tuple[list[np.ndarray], list[Measured]]:
    """Minimise several convex functions side by side by Newton steps; one that does not lead down is halved."""
    at, here = list(start), evaluate(start)
    steps = [-np.linalg.solve(c, s) for _, s, c, _ in here]
    for _ in range(rounds):
        open_ = [-here[m][1] @ steps[m] > 1e-5 for m in range(len(at))]
        if not any(open_):
            break
        new = [w + s if o else w for w, s, o in zip(at, steps, open_)]
        for m, found in enumerate(evaluate(new)):
            if open_[m] and found[0] <= here[m][0]:
                at[m], here[m] = new[m], found
                steps[m] = -np.linalg.solve(found[2], found[1])
            elif open_[m]:
                steps[m] = steps[m] / 2
    return at, here


def class_prior(p: np.ndarray, u: np.ndarray, n_positive: float, n_unlabelled: float) -> float:
    """The share of positives among the unlabelled, from the shares of both above some thresholds.

    For each threshold the unlabelled share above it bounds the prior times the positive share above
    it; the bound, with a margin for small samples, is least where the top is purest.
    """
    margin = np.sqrt(np.log(20) / 2) * (max(n_unlabelled, 1) ** -0.5 + n_positive**-0.5)
    best = np.argmin((u + margin) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.01, 0.99))


def fit_over(
    positive: np.ndarray, over: Pass, bins: int = BINS, rounds: int = 25,
    l2: float = 1e-4, prior: float | None = None, least: float = 0.05, halvings: int = 6,
) -> QualityModel:
    """Fit on the cells of trusted positives and on passes over all unlabelled rows."""
    k = len(MEASURES)
    none = QualityModel([np.zeros(0)] * k, np.zeros((k, 1)), -500.0, 0.0)
    if not len(positive):
        return none
    counts = over(lambda half, cell: histogram(cell))
    if not counts.any():
        return none
    edges = bin_edges(counts, bins)
    width = max(len(e) for e in edges) + 1
    size = k * width
    model = QualityModel(edges, np.zeros((k, width)), 0.0, 0.5)
    p = model.places(positive)
    ridge = np.append(np.ones(size), 0.0)

    def of_positives(places: np.ndarray, w: np.ndarray) -> np.ndarray:
        return w[places].sum(axis=1) + w[-1]

    def over_halves(ws: list[np.ndarray]) -> list[Measured]:
        """Classifiers of positives against unlabelled, one for each half of the rows."""

        def kernel(half: np.ndarray, cell: np.ndarray) -> np.ndarray:
            parts = []
            for h, w in enumerate(ws):
                u = model.places(cell[half == h])
                parts.append(_curved(u, w[u].sum(axis=1) + w[-1], k, width))
            return np.concatenate(parts)

        out = []
        for h, (w, sums) in enumerate(zip(ws, np.split(over(kernel), 2))):
            own = p[h::2]
            loss, slope, curve = _unpacked(sums, k, width)
            # the loss of a positive is that of the mirrored logit
            mirrored = _curved(own, -of_positives(own, w), k, width)
            loss_p, slope_p, curve_p = _unpacked(mirrored, k, width)
            value = loss + loss_p + 0.5e-2 * (ridge * w) @ w
            out.append((value, slope - slope_p + 1e-2 * ridge * w, curve + curve_p + np.diag(1e-2 * ridge), 0.0))
        return out

    if prior is None:
        prior = 0.5
        if len(p) > 1:
            # each half is scored by the other half's classifier, so positives do not look too good
            ws, _ = _minimise(over_halves, [np.zeros(size + 1)] * 2, rounds)
            scored_p = [np.sort(w[p[1 - h :: 2]].sum(axis=1)) for h, w in enumerate(ws)]
            cuts = [np.quantile(z, np.linspace(0, 1 - least, 100)) for z in scored_p]

            def above(half: np.ndarray, cell: np.ndarray) -> np.ndarray:
                parts = []
                for h, w in enumerate(ws):
                    z = np.sort(w[model.places(cell[half != h])].sum(axis=1))
                    parts.append(np.append(len(z) - np.searchsorted(z, cuts[h], "left"), len(z)))
                return np.concatenate(parts).astype(float)

            found = []
            for z, cut, u in zip(scored_p, cuts, np.split(over(above), 2)):
                if u[-1]:
                    share = 1 - np.searchsorted(z, cut, "left") / len(z)
                    found.append((u[-1], class_prior(share, u[:-1] / u[-1], len(z), u[-1])))
            prior = float(np.average([f for _, f in found], weights=[n for n, _ in found]))

    def risk(part: float) -> Callable[[list[np.ndarray]], list[Measured]]:
        """The unbiased risk with a part of what comes from negatives; a part of 1 is all of it."""

        def evaluate(ws: list[np.ndarray]) -> list[Measured]:
            (w,) = ws

            def kernel(half: np.ndarray, cell: np.ndarray) -> np.ndarray:
                u = model.places(cell)
                return _curved(u, w[u].sum(axis=1) + w[-1], k, width)

            loss, slope, curve = _unpacked(over(kernel), k, width)
            z = of_positives(p, w)
            loss_p, slope_p, curve_p = _unpacked(_curved(p, z, k, width), k, width)
            loss_m, slope_m, curve_m = _unpacked(_curved(p, -z, k, width), k, width)
            negative = loss - prior * loss_p
            return [
                (
                    prior * loss_m + part * negative + l2 / 2 * (ridge * w) @ w,
                    -prior * slope_m + part * (slope - prior * slope_p) + l2 * ridge * w,
                    prior * curve_m + part * (curve - prior * curve_p) + np.diag(l2 * ridge),
                    negative,
                )
            ]

        return evaluate

    (w,), (end,) = _minimise(risk(1.0), [np.zeros(size + 1)], rounds)
    bounded = end[3] < 0
    if bounded:
        # The non-negative risk is the greater of two convex ones (all of the part from negatives, none of it).
        # Its minimum lies where that part is zero: at the weight of it for which this holds.
        low, high = 0.0, 1.0
        for _ in range(halvings):
            middle = (low + high) / 2
            (w,), (end,) = _minimise(risk(middle), [w], rounds)
            low, high = (low, middle) if end[3] < 0 else (middle, high)
    model = QualityModel(edges, w[:-1].reshape(k, width), float(w[-1]), prior)
    if bounded:
        model.intercept = _mean_is_prior(w, model, over)
    return model


def _mean_is_prior(w: np.ndarray, model: QualityModel, over: Pass, step: float = 1 / 64) -> float:
    """The intercept with which the mean score of the unlabelled is the prior (so it is at a free minimum)."""
    reach = float(np.abs(w[:-1].reshape(model.weights.shape)).max(axis=1).sum()) + step
    n = int(np.ceil(2 * reach / step)) + 1

    def kernel(half: np.ndarray, cell: np.ndarray) -> np.ndarray:
        z = w[model.places(cell)].sum(axis=1)
        return np.bincount(((z + reach) / step).astype(np.int64), minlength=n).astype(float)

    counts, z = over(kernel), (np.arange(n) + 0.5) * step - reach
    low, high = -30.0 - reach, 30.0 + reach
    for _ in range(60):
        middle = (low + high) / 2
        mean = (counts * _sigmoid(z + middle)).sum() / counts.sum()
        low, high = (middle, high) if mean < model.prior else (low, middle)
    return middle


def fit(positive: np.ndarray, unlabelled: np.ndarray, **settings) -> QualityModel:
    """Fit on the measures of trusted positives and of unlabelled texts that are at hand."""
    k, half, cell = len(MEASURES), np.arange(len(unlabelled)) % 2, cells(unlabelled)
    return fit_over(cells(positive.reshape(-1, k)), lambda kernel: kernel(half, cell), **settings)


def _measured(rows: DataFrame, text: str) -> DataFrame:
    """(_measures) of the texts in the column ``text``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            x = measures(*texts_of(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row.tobytes() for row in x], pa.binary())], ["measures"]
            )

    return rows.select(text).mapInArrow(make, "measures binary")


def sample(
    docs: DataFrame, ids: DataFrame, bound: int, id_column: str, text_column: str
) -> np.ndarray:
    """Measures of the documents with the ``bound`` ids of least hash.

    Only so many ids are broadcast and only so many rows reach the driver; of an id's several
    rows one is taken.
    """
    chosen = (
        ids.where(F.col(id_column).isNotNull()).select(id_column).distinct()
        .orderBy(F.xxhash64(id_column), id_column).limit(bound)
    )
    rows = (
        docs.select(F.col(id_column), F.col(text_column).cast("string").alias("_text"))
        .join(F.broadcast(chosen), id_column)
        .groupBy(id_column).agg(F.min("_text").alias("_text"))
    )
    parts = _measured(rows, "_text").toArrow().column("measures").to_pylist()
    return np.frombuffer(b"".join(parts), float).reshape(-1, len(MEASURES))


def cell_table(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(half, cells) of every document, written once; the half follows from the id."""
    table = docs.select(
        (F.xxhash64(F.col(f"`{id_column}`")) % 2 != 0).cast("byte").alias("half"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = cells(measures(*texts_of(batch.column(1))))
            packed = pa.array([row.tobytes() for row in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["half", "cells"])

    return settle(table.mapInArrow(make, "half byte, cells binary"), "quality-cells")


def passes_over(table: DataFrame) -> Pass:
    """Passes over a table of cells: a row of sums from each task, added up by a fixed number of tasks."""

    def over(kernel: Kernel) -> np.ndarray:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    cell = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int16)
                    sums = kernel(batch.column(0).to_numpy(), cell.reshape(-1, len(MEASURES)))
                    total = sums if total is None else total + sums
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for row in batch.column(0):
                    sums = np.frombuffer(row.as_buffer(), float)
                    total = sums if total is None else total + sums
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        rows = table.mapInArrow(found, "sums binary").repartition(SUM_TASKS).mapInArrow(added, "sums binary")
        parts = [np.frombuffer(part, float) for part in rows.toArrow().column("sums").to_pylist()]
        if parts:
            return np.sum(parts, axis=0)
        return kernel(np.zeros(0, np.int8), np.zeros((0, len(MEASURES)), np.int16))

    return over


def train(
    docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "quality",
    max_positive: int = MAX_POSITIVE, id_column: str = "doc_id", text_column: str = "text",
) -> QualityModel:
    good = labels.where(train_rows & (F.col(label) == 1))
    positive = cells(sample(docs, good, max_positive, id_column, text_column))
    if not len(positive):
        return fit_over(positive, lambda kernel: np.zeros(0))
    return fit_over(positive, passes_over(cell_table(docs, id_column, text_column)))


def scored(
    docs: DataFrame, model: QualityModel, into: str = "score", text_column: str = "text"
) -> DataFrame:
    """``docs`` with a score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = fresh_name(docs, "_t")
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    own = [F.col(f"`{c}`") for c in kept]
    table = docs.select(*own, F.col(f"`{text_column}`").cast("string").alias(text))
    names = [*kept, into]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            last = batch.num_columns - 1
            score = shared.value.scores(measures(*texts_of(batch.column(last))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(score, pa.float64())], names
            )

    schema = docs.select(*own, F.lit(0.0).alias(into)).schema
    for field in schema:
        field.nullable = True
    return table.mapInArrow(make, schema)
