"""Documents with awkward rows, and plain Python versions of what the operators compute."""

import random
import re

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint,"
    " _text string, node int, score string, length int, _w int, quality_rules int"
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = [f"w{r.randrange(vocabulary)}é" if r.random() < 0.1 else f"wort{r.randrange(vocabulary)}"
             for _ in range(n)]
    for i in range(9, n, 10):
        words[i] += "."
    for i in range(25, n, 26):
        words[i] += "\n"
    return " ".join(words).replace("\n ", "\n")


def awkward_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows, a repeated id."""
    base = prose(1, 300)
    near = base.split(" ")
    near[100] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (3, " ".join(near)), (4, None), (5, ""),
        (6, "   \n\t "), (7, "!!! ???"), (8, "one"), (9, "one two"), (10, "ONE two"),
        (None, prose(2, 80)), (None, None), (11, prose(3, 30_000)), (12, "x" * 30_000),
        (13, "\x00 a\x00b \x0b c"), (14, "a b c " * 400), (15, prose(4, 120)), (15, prose(5, 120)),
        (16, base), (17, "Ünïcode ÉTÉ été \u00a0 \u2003 𝔘𝔫𝔦 e\u0301 \u212a"),
        (18, prose(6, 60) + "\n" + "* # $ % " * 60),
    ]
    return rows


def frame(spark, rows, parts=3):
    """Rows as documents, with extra columns whose names the operators use themselves."""
    full = [(i, t, "en", "s", None, "x", 1, "y", 2, 3, 4) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.repartition(parts) if rows else df


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def same_rows(df, expected):
    got = [tuple(r) for r in df.collect()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(expected, key=key)
