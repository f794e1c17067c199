"""Sketches against exact counts and ranks."""

import numpy as np
from pyspark.sql import functions as F

from vouchsafe.operators import sketches as S

SCHEMA = "part string, k string, v double"


def test_merged_sketches_are_near_the_exact_rows(spark, tmp_path):
    rows = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 40)).alias("part"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 90_000).cast("string")).alias("k"),
        F.when(F.col("id") % 5 != 0, F.sqrt(F.col("id") * 7 % 300_007)).alias("v"),
    )
    path = str(tmp_path / "sketches")
    S.sketch(rows, [F.col("part")], F.col("k"), F.col("v")).write.parquet(path)
    whole = S.merge(spark.read.parquet(path), []).withColumn("keys", S.unique_keys())
    shares = (0.01, 0.5, 0.95, 0.999)
    got = whole.select("rows", "rows_with_key", "values", "keys", *[S.quantile(q) for q in shares]).first()
    exact = rows.agg(F.count("*"), F.count("k"), F.count("v"), F.count_distinct("k")).first()
    assert got[:3] == exact[:3]
    assert abs(got.keys / exact[3] - 1) < S.SURE * S.key_error()
    values = np.sort([r.v for r in rows.where("v IS NOT NULL").select("v").collect()])
    for q, estimate in zip(shares, got[4:]):
        assert abs(np.searchsorted(values, estimate, "right") / len(values) - q) < 0.01


def test_verdicts_and_those_left_open(spark):
    rows = (
        [("clear", str(i), 1.0) for i in range(2000)]
        + [("twice", str(i // 2), None) for i in range(2000)]
        + [("near", str(max(i, 20)), None) for i in range(2000)]  # 0.99 exactly
        + [("no key", None, 1.0)]
    )
    got = {
        r.part: r
        for r in S.uniqueness(S.sketch(spark.createDataFrame(rows, SCHEMA), [F.col("part")], F.col("k")), 0.99).collect()
    }
    assert [(got[p].passed, got[p].decided) for p in ("clear", "twice", "no key")] == [
        (True, True), (False, True), (False, True),
    ]
    assert not got["near"].decided and abs(got["near"].score - 0.99) < 0.001


def test_empty_tables_and_groups_without_values(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.sketch(empty, [F.col("part")], F.col("k"), F.col("v")).isEmpty()
    rows = spark.createDataFrame([("a", None, None), ("b", "x", 3.0), (None, "x", float("nan"))], SCHEMA)
    made = S.sketch(rows, [F.col("part")], F.col("k"), F.col("v"))
    got = {r.part: r for r in made.select("*", S.quantile(0.5).alias("q"), S.unique_keys().alias("n")).collect()}
    assert got["a"].q is None and got[None].q is None and got["a"].n == 0 and got["b"].q == 3.0 and got["b"].n == got[None].n == 1
    whole = S.merge(made, []).select(S.unique_keys().alias("n"), "rows", "rows_with_key").first()
    assert tuple(whole) == (1, 3, 2)
