"""The pipeline's stages against plain Python, each on what its predecessor kept."""

import numpy as np
import pytest
from llm_cases import awkward_rows, frame, same_rows
from pyspark.sql import functions as F
from test_llm_texts import base_measures, contaminated, expected_classes
from test_llm_tokens import cut

import __spark_entry__ as entry
import corpus_pipeline
from vouchsafe.llm import probminhash, toxicity, weak_rules
from vouchsafe.llm.common import crc32_of
from vouchsafe.session import ARROW_BYTES, ARROW_BYTES_KEY, prepare

SF = "/root/testdata/sf0.001"


def kept_by_rules(rows):
    """The rules' votes and the label model's verdict, text by text."""
    facts = []
    for i, t in rows:
        n, chars, symbols, dup, repeats, failed = base_measures(t)
        lines = sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in (t or "").split("\n"))
        capitals = sum("A" <= c <= "Z" for c in t or "")
        stops = sum(c in ".!?" for c in t or "")
        per = chars / max(n, 1)
        bad = (10 * symbols > n, 2 * dup > lines, 10 * repeats > 4 * n, per < 2.5 or per > 12,
               10 * capitals > 3 * chars)
        prose = (20 * symbols <= n and 10 * capitals <= chars and 10 * repeats <= 4 * n
                 and 60 * stops >= n and 3 * stops <= n)
        votes = tuple(-1 if b and n else 0 for b in bad) + (1 if prose and n else 0,)
        facts.append((i, t, votes, failed))
    counts = {}
    for _, _, votes, failed in facts:
        if not failed:
            counts[votes] = counts.get(votes, 0) + 1
    model = weak_rules.estimate(counts, 6)
    odds = lambda v: model.base() + sum(w[x] for w, x in zip(model.weights(), v))
    return [(i, t) for i, t, v, failed in facts if not failed and odds(v) >= 0]


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = docs
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = got
        got = stage(spark, got, SF).cache()
        assert got.columns == corpus_pipeline.COLUMNS
        if name == "quality rules":
            rows = kept_by_rules(rows)
        elif name == "toxicity":
            model = toxicity.train(before, labels, crc32_of("doc_id") % 5 != 0)
            raw = [(t or "").encode() for _, t in rows]
            data = np.frombuffer(b"".join(raw), np.uint8)
            score = model.scores(data, np.cumsum([0, *map(len, raw)]))
            rows = [r for r, s in zip(rows, score) if s < 0.5]
        elif name == "near duplicates":
            rows = [r for r, (i, least) in zip(rows, expected_classes(rows)) if i == least]
        else:
            rows = [r for r in rows if not contaminated(r[1], items)[3]]
        same_rows(got.select("doc_id", "text"), rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, got, SF)
    same_rows(
        packed.select("doc_id", "piece", "start", "length", "ids_crc32"), list(cut(rows, 4096))
    )
    same_rows(
        entry.queries()["pipeline"](spark, SF).select("doc_id", "piece", "ids_crc32"),
        [(i, p, c) for i, p, _, _, c in cut(rows, 4096)],
    )


@pytest.mark.parametrize("rows", [awkward_rows(), []])
def test_stages_take_awkward_documents(spark, rows):
    got = frame(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, SF)
        assert got.columns == corpus_pipeline.COLUMNS
        got = got.withColumn("toxicity", F.lit("x")).withColumn("_bad", F.lit(1)).cache()
        assert got.count() <= len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, got, SF).count() >= got.count()


def test_near_duplicates_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    """Few long texts would fit one Arrow batch of Spark's 64 MB, which takes memory outside the heap."""
    sizes, cut_small = tmp_path / "sizes", probminhash.small_batches

    def noted(batches, text):
        def seen():
            for batch in batches:
                with open(sizes, "a") as file:
                    file.write(f"{batch.nbytes}\n")
                yield batch

        return cut_small(seen(), text)

    monkeypatch.setattr(probminhash, "small_batches", noted)
    path = str(tmp_path / "documents")
    text = F.repeat(F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" ")), 6000)
    spark.range(0, 500, 1, 1).select(
        F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"),
        F.lit("web").alias("source"), F.length(text).alias("n_chars"),
    ).write.parquet(path)
    spark.conf.unset(ARROW_BYTES_KEY)
    got = dict(corpus_pipeline.STAGES)["near duplicates"](spark, spark.read.parquet(path), SF)
    assert got.count() == 500
    bytes_of = [int(x) for x in sizes.read_text().split()]
    assert sum(bytes_of) > 16 << 20
    assert max(bytes_of) < 1.25 * ARROW_BYTES


def test_a_limit_of_arrow_batches_that_is_set_stays(spark):
    spark.conf.set(ARROW_BYTES_KEY, "1048576")
    try:
        assert prepare(spark).conf.get(ARROW_BYTES_KEY) == "1048576"
    finally:
        spark.conf.unset(ARROW_BYTES_KEY)
    assert int(prepare(spark).conf.get(ARROW_BYTES_KEY)) == ARROW_BYTES
