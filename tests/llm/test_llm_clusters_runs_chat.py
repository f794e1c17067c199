"""Vantage-point clusters, periodic runs and chat formatting against plain Python."""

import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import PLAIN, awkward_rows, frame, prose, same_rows
from pyspark.sql import functions as F

from vouchsafe.llm import chat_format, queries, square_runs, vantage_clusters
from vouchsafe.llm.vantage_clusters import VantageTree

# clusters


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 4), st.integers(1, 12), st.integers(0, 10**6))
def test_tree_finds_the_nearest_and_the_least_number(k, dim, spread, seed):
    r = np.random.default_rng(seed)
    centroids, vectors = r.integers(-spread, spread, (k, dim)), r.integers(-spread, spread, (50, dim))
    far = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    number, distance = VantageTree.over(centroids).nearest(vectors)
    assert distance.tolist() == far.min(axis=1).tolist() and number.tolist() == far.argmin(axis=1).tolist()


def test_tree_is_exact_for_large_numbers():
    r = np.random.default_rng(1)
    base = r.integers(-(1 << 26), 1 << 26, (1, 64))
    centroids = base + np.arange(30)[:, None] * 0 + r.integers(-1, 2, (30, 64))
    vectors = -base + r.integers(-1, 2, (40, 64))
    far = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    number, distance = VantageTree.over(centroids).nearest(vectors)
    assert distance.tolist() == far.min(axis=1).tolist() and number.tolist() == far.argmin(axis=1).tolist()


def plain_clusters(rows, dim, k, rounds):
    kept = [
        (i, [max(-(2**26), min(2**26, math.floor(64 * x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for j, vs in members.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


def vector_rows():
    r = random.Random(3)
    rows = [(i, [r.choice([-1, 0, 0.5, 1]) + r.random() / 50 for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(30)] + [(5, rows[5][1]), (5, [0.0] * 4), (None, [0.1] * 4)]
    bad = [None, [], [0.0] * 3, [0.0] * 5, [0.0, None, 0.0, 0.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0]]
    rows += [(300 + i, v) for i, v in enumerate(bad)] + [(400, [1e30, -1e30, 3.0, -0.001]), (401, [-0.0] * 4)]
    return rows


@pytest.mark.parametrize("k", [1, 7, 500])
def test_clusters_are_those_of_a_plain_search(spark, k):
    rows = vector_rows()
    df = spark.createDataFrame(
        [(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, cluster string, distance int"
    ).repartition(5)
    members, centroids = vantage_clusters.clusters(df, dim=4, k=k, rounds=3)
    want, want_centroids = plain_clusters(rows, 4, k, 3)
    assert centroids.tolist() == want_centroids
    same_rows(members, want)
    total, by_cluster = sum(d for _, _, d in want), {}
    for _, c, d in want:
        by_cluster[c] = by_cluster.get(c, 0) + d
    about = vantage_clusters.with_inertia(members, centroids).select("vec_id", "cluster", "cluster_inertia", "inertia")
    same_rows(about, [(i, c, by_cluster[c], total) for i, c, _ in want])


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    members, centroids = vantage_clusters.clusters(df, dim=4)
    assert vantage_clusters.with_inertia(members, centroids).count() == 0
    with pytest.raises(ValueError):
        vantage_clusters.clusters(df, dim=1 << 20, k=100)


# runs


def plain_runs(words):
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def repetitive_texts():
    r = random.Random(11)
    thue = [bin(i).count("1") & 1 for i in range(500)]
    fib, more = [0], [0, 1]
    while len(more) < 500:
        fib, more = more, more + fib
    for trial in range(500):
        n, kind = r.randrange(400), trial % 6
        if kind == 0:
            w = [r.randrange(2) for _ in range(n)]
        elif kind == 1:
            w = []
            while len(w) < n:
                w += [r.randrange(3) for _ in range(r.randrange(1, r.choice([3, 10, 60])))] * r.randrange(1, 8)
        elif kind == 2:
            m, w = r.randrange(1, 90), []
            while len(w) < n:
                w += [0] * (m + r.choice([0, 0, 0, 1])) + [r.choice([1, 1, 1, 2])]
        elif kind == 3:
            inner = [r.randrange(3) for _ in range(r.randrange(1, 6))]
            w = [r.randrange(3) for _ in range(r.randrange(30))] + ((inner * 40)[: r.randrange(1, 40)] + [9]) * 60
        elif kind == 4:
            w = thue[: r.randrange(1, 130)] * 9
        else:
            w = more[:n] + [r.randrange(2) for _ in range(9)] + [7] * r.randrange(40)
        yield w[:400]


def test_runs_are_all_runs():
    found = 0
    for words in repetitive_texts():
        want = plain_runs(words)
        found += len(want)
        assert square_runs.runs_of(words) == want
    assert found > 500


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=20), st.integers(1, 12)), max_size=8))
def test_runs_of_repeated_pieces(pieces):
    words = [w for piece, n in pieces for w in piece * n]
    assert square_runs.runs_of(words) == plain_runs(words)


def test_words_may_come_in_any_portions():
    words = [0, 1, 2] * 30 + [5] * 40 + list(range(20))
    for step in (1, 3, 7, 50):
        finder = square_runs.RunFinder()
        for i in range(0, len(words), step):
            finder.extend(words[i : i + step])
        assert finder.finish() == plain_runs(words)


@pytest.mark.parametrize("words", [[0] * 60_000, ([0] * 200 + [1]) * 300, ([0] * 15_000 + [1]) * 4, list(range(200_000))])
def test_long_repetitive_texts_end(words):
    runs = square_runs.runs_of(words)
    assert all(w == words[s] or p > 1 for s, _, p in runs for w in words[s : s + 1])
    assert bool(runs) == (len(set(words)) < 10)


def row_of_runs(doc_id, text):
    words = PLAIN.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        digest("".join(f"{s},{length},{p}\n" for s, length, p in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_of_runs(spark, tmp_path):
    tenth = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = awkward_rows() + [(i, prose(i, 40 + i % 90)) for i in tenth] + [(tenth[0], None), (tenth[1], " \t")]
    rows = [(i, t) for i, t in rows if len(t or "") < 100_000]
    rows += [(7000, "a b c d\x0be " * 20 + "z" + " q" * 30), (7001, " a b " * 30), (7002, "x\x1cy " * 24)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    same_rows(queries.op12_dyadic_square_runs(spark, str(tmp_path)), [row_of_runs(i, t) for i, t in rows])


def test_descriptions_keep_columns_and_texts(spark):
    rows = [(1, "intro " + "la di da " * 20 + "end"), (2, None), (3, "")]
    found = square_runs.described(frame(spark, rows)).select("doc_id", "score", "n_words", "runs", "collapsed").collect()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["collapsed"] == "intro la di da end" and by_id[1]["n_words"] == 62 and by_id[1]["score"] == "y"
    assert [tuple(r) for r in by_id[1]["runs"]] == [(1, 60, 3)]
    assert by_id[2]["collapsed"] == by_id[3]["collapsed"] == "" and by_id[2]["runs"] == []
    assert square_runs.described(frame(spark, [])).count() == 0


# chat


def variants(spark, records):
    rows = [(i, json.dumps(r) if not isinstance(r, str) else r) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "n int, j string")
    return df.select("n", F.parse_json("j").alias("record"), F.lit("clash").alias("_paths"), F.lit(1).alias("_safe"))


RECORDS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q", "x": [1, {"y": 2}]},
                   {"role": "assistant", "content": None}], "id": 4}, "messages",
     [("system", "s"), ("user", "q"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"text": "b"}]}]},
     "message parts", [("user", "ab")]),
    ({"system": "be kind", "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"},
                                             {"from": "tool", "value": "1"}]}, "conversations",
     [("system", "be kind"), ("user", "hi"), ("assistant", "ho"), ("tool", "1")]),
    ({"prompt": "p", "response": "", "od`d name": {"a.b": 1}}, "prompt and response", [("user", "p"), ("assistant", "")]),
    ({"completion": "c", "prompt": None, "system": None}, "prompt and completion", [("user", ""), ("assistant", "c")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done", "system": ""}, "instruction",
     [("system", ""), ("user", "do"), ("assistant", "done")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question", [("user", "q\n\nc"), ("assistant", "a")]),
    ({"prompt": [{"role": "user", "content": "x"}], "response": "y"}, "chat prompt", [("user", "x"), ("assistant", "y")]),
    ({"prompt": "old", "messages": [{"role": "user", "content": "new"}]}, "messages", [("user", "new")]),
    ({"messages": []}, "messages", []),
    ({"messages": [1, {"role": "user"}]}, None, None),
    ({"instruction": "no output"}, None, None),
    ({"nested": {"prompt": "p", "response": "r"}}, None, None),
    ([{"prompt": "p", "response": "r"}], None, None),
    (3, None, None), ({}, None, None), ("null", None, None),
]


def test_layouts_are_found_by_their_paths(spark):
    found = chat_format.canonical_turns(variants(spark, [r for r, _, _ in RECORDS])).orderBy("n").collect()
    for row, (record, layout, turns) in zip(found, RECORDS):
        assert row["layout"] == layout, record
        assert (row["turns"] if turns is None else [tuple(t) for t in row["turns"]]) == turns, record
    assert found[0]["_paths"] == "clash"
    nothing = spark.createDataFrame([(None,)], "j string").select(F.parse_json("j").alias("record"))
    assert [r["layout"] for r in chat_format.canonical_turns(nothing).collect()] == [None]
    assert chat_format.canonical_turns(nothing.limit(0)).count() == 0


def test_fullest_records_of_all_layouts_are_told_apart():
    fullest = [max(layout.shapes(), key=len) for layout in chat_format.LAYOUTS]
    assert len(set(fullest)) == len(fullest)


MARKS = ["<", "[", "\\", "/", "s>", "INST]", "|turn|>", "|says|>", "|end|>", "<s>", "</s>", "[INST]", "<|im_end|>", "é", "\n", "$1"]


def marked_conversations(n):
    r = random.Random(4)
    some = lambda most: "".join(r.choice([*MARKS, "a ", "𝔘"]) for _ in range(r.randrange(most)))
    roles = ["user", "assistant", "assistant", "system", ""]
    return [[(r.choice([*roles, some(4)]), some(12)) for _ in range(r.randrange(6))] for _ in range(n)]


def test_formatted_turns_are_read_back(spark):
    conversations = marked_conversations(2000)
    df = spark.createDataFrame([(i, c) for i, c in enumerate(conversations)], f"n int, turns {chat_format.TURNS}")
    made = chat_format.formatted(df)
    back = made.select(
        "n", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"),
        chat_format.trained_text(F.col("formatted"), F.col("loss")).alias("trained"),
    ).orderBy("n").collect()
    for row, turns in zip(back, conversations):
        assert [tuple(t) for t in row["turns"]] == turns
        assert row["trained"] == "".join(text for role, text in turns if role == "assistant")
        between = re.split(r"<\|(?:turn|says|end)\|>", row["formatted"])
        assert len(between) == 1 + 3 * len(turns)
        assert not any(mark in part for part in between for mark in ("</s>", "<s>", "[INST]", "[/INST]", "<|im_end|>"))


def test_query_of_conversations(spark, tmp_path):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, "user", "x"), (3, None, "assistant", None),
        (3, 0, "assistant", "<\\/s>"), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (4, 0, "system", None),
        (4, 1, "user", "</s>"), (4, 2, "assistant", "[INST]\\"), (5, 0, "a\nb<|says|>", "t"), (1, 1, "assistant", "b"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, layout string, loss int")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    rows += [(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = queries.op13_fingerprinted_chat_format(spark, str(tmp_path))
    expected = []
    for conv, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        expected.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), digest(said)))
    same_rows(got.drop("formatted_chars"), expected)
    plain = {r["conv_id"]: r["formatted_chars"] for r in got.collect()}
    assert plain[1] == 3 * 23 + len("userassistantassistant") + 3 and plain[-7] == 2 * 23 + 13 + 2 * (21 + 3)
