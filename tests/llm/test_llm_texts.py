"""Rules, winnowing, near-duplicates, licences and URLs against plain Python."""

import hashlib
import math
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import PLAIN, awkward_rows, frame, lower, prose, same_rows, words
from pyspark.sql import functions as F

from vouchsafe.llm import license_join, probminhash, url_rules, weak_rules, winnowing
from vouchsafe.llm.common import texts_of
from vouchsafe.llm.words import find_words, gram_texts, grams

import pyarrow as pa


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), min_size=1, max_size=6), st.integers(1, 4))
def test_word_kernel(texts, k):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    found = find_words(*texts_of(pa.array(texts, pa.string())))
    want = [words(t) for t in texts]
    assert found.counts().tolist() == [len(w) for w in want]
    assert found.text(0, len(found.starts)).decode() == " ".join(w for ws in want for w in ws)
    flat = [w for ws in want for w in ws]
    by_word = dict(zip(flat, found.hashes.tolist()))
    assert [by_word[w] for w in flat] == found.hashes.tolist() and len(set(by_word.values())) == len(by_word)
    h = grams(found.hashes, k)
    assert int(gram_texts(found.bounds, k, len(h)).sum()) == sum(max(0, len(w) - k + 1) for w in want)


# quality rules


def base_measures(text):
    own = PLAIN.findall(text or "")
    lines = [x for x in (text or "").split("\n") if PLAIN.search(x)]
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    inside = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 3)}
    n = len(own)
    return (
        n, sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n,
    )


def test_measures_of_awkward_documents(spark):
    rows = awkward_rows() + [(20, "p q r s " * 3 + " ".join(f"u{i} v{i} t{i % 40}" for i in range(200)) * 2)]
    verdict, c = weak_rules.judged(frame(spark, rows))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    same_rows(
        verdict.select("doc_id", *(f"{c}.{x}" for x in names)),
        [(i, *base_measures(t)) for i, t in rows],
    )
    assert verdict.where(f"{c}.kept AND {c}.base_failed").isEmpty()
    kept = weak_rules.keep_good(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    got = {r.doc_id for r in kept.collect()}
    assert {1, 2, 3, 11, 15, 16} <= got and not {4, 5, 6, 7, 8, 14, 18} & got
    assert weak_rules.keep_good(frame(spark, [])).count() == 0


def test_label_model_finds_accuracies():
    r = random.Random(4)
    truth, patterns = [], {}
    says = [(0.02, 0.6), (0.01, 0.5), (0.03, 0.7)]  # P(bad vote | good), P(bad vote | bad)
    for _ in range(6000):
        good = r.random() < 0.8
        votes = tuple(-1 if r.random() < (g if good else b) else 0 for g, b in says)
        votes += ((1 if r.random() < (0.9 if good else 0.1) else 0),)
        patterns[votes] = patterns.get(votes, 0) + 1
        truth.append((good, votes))
    model = weak_rules.estimate(patterns, 4)
    assert abs(model.prior - 0.8) < 0.05
    for j, (g, b) in enumerate(says):
        assert abs(model.given_good[j][-1] - g) < 0.03 and abs(model.given_bad[j][-1] - b) < 0.1
    odds = lambda v: model.base() + sum(w[x] for w, x in zip(model.weights(), v))
    assert sum((odds(v) > 0) == good for good, v in truth) > 0.95 * len(truth)


# winnowing


def contaminated(text, items, window=13):
    own = words(text)
    hit, found = set(), set()
    for item, t in items:
        theirs = words(t)
        n = min(window, len(theirs))
        spans = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if n and tuple(own[i : i + n]) in spans:
                hit.update(range(i, i + n))
                found.add("" if item is None else str(item))
    ids = sorted(found)
    return len(own), len(hit), ids, len(hit) > 0 and 20 * len(hit) >= len(own)


def winnow_cases():
    r = random.Random(11)
    items = [(i, prose(100 + i, 40)) for i in range(8)]
    items += [(1, items[1][1]), (20, None), (21, ""), (22, "drei kleine wörter"), (23, "one"),
              (24, " ".join(f"z{i}" for i in range(7))), (25, prose(100, 40)), (None, prose(130, 20)),
              (26, " ".join(["same"] * 30))]
    rows = awkward_rows()
    for i in range(60):
        own = prose(500 + i, 120, vocabulary=30 if i % 5 == 0 else 400).split()
        item = words(r.choice(items)[1] or "x")
        start = r.randrange(len(item))
        span = item[start : start + r.choice([3, 12, 13, 14, 25, 40])]
        at = r.randrange(len(own))
        rows.append((100 + i, " ".join(own[:at] + [w.upper() for w in span] + own[at:])))
    rows += [(200, "same " * 100), (201, "x DREI, kleine! wörter y"), (202, items[1][1])]
    return rows, items


def test_winnowing_finds_every_shared_window(spark):
    rows, items = winnow_cases()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = winnowing.contamination(frame(spark, rows), bench)
    got = got.select("doc_id", "n_words", "n_hit", F.array_join("items", ",").alias("i"),
                     winnowing.is_contaminated().alias("c"))
    want = []
    for i, t in rows:
        n, hit, ids, bad = contaminated(t, items)
        want.append((i, n, hit, ",".join(ids), bad))
    assert sum(w[2] > 0 for w in want) > 15
    same_rows(got, want)
    clean = winnowing.clean(frame(spark, rows), bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(w[0]) for w in want if not w[4])


def test_winnowing_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = winnowing.contamination(frame(spark, [(1, "a b"), (2, None)]), none)
    same_rows(got.select("doc_id", "n_words", "n_hit"), [(1, 2, 0), (2, 0, 0)])
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert winnowing.contamination(frame(spark, []), some).count() == 0


# near-duplicates


def weights(text):
    own = words(text)
    k = min(5, len(own))
    out = {}
    for i in range(len(own) - k + 1 if own else 0):
        out[tuple(own[i : i + k])] = out.get(tuple(own[i : i + k]), 0) + 1
    return out


def probability_jaccard(a, b):
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys())
    return total


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=30), st.lists(st.sampled_from("abcdefgh"), max_size=30))
def test_similarity_is_the_probability_jaccard(x, y):
    a, b = " ".join(x), " ".join(y)
    left, right = probminhash._sets(pa.array([a, b]), 5)
    assert probminhash.similarity(left, right) == pytest.approx(
        probability_jaccard(weights(a), weights(b)), abs=1e-12
    )


def test_registers_agree_as_often_as_texts_are_alike():
    base = words(prose(5, 400))
    other = base[:330] + words(prose(6, 70)) + base[:30]
    texts = [" ".join(base), " ".join(other)]
    found = find_words(*texts_of(pa.array(texts)))
    sig = probminhash.signatures(*probminhash.shingles(found), 2, 4096)
    want = probability_jaccard(weights(texts[0]), weights(texts[1]))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def expected_classes(rows):
    texts = sorted({t or "" for _, t in rows})
    sets = [weights(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and probability_jaccard(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    group = {}
    for i, t in rows:
        group.setdefault(find(texts.index(t or "")), []).append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in group.items()}
    return [(i, least[find(texts.index(t or ""))]) for i, t in rows]


def test_classes_of_awkward_documents(spark):
    rows = awkward_rows()
    for i in range(25):  # a chain of copies, each changed at another place
        own = prose(900, 200).split(" ")
        for j in range(i % 5):
            own[(37 * i + 11 * j) % 200] = f"other{i}{j}"
        rows.append((300 + i, " ".join(own)))
    rows = [(i, t) for i, t in rows if i != 11]  # brute force is quadratic in words
    got = probminhash.near_duplicates(frame(spark, rows)).cache()
    same_rows(got.select("doc_id", "class_id"), expected_classes(rows))
    left = probminhash.deduplicated(frame(spark, rows))
    assert left.columns == frame(spark, []).columns
    classes = {(c, i is None) for i, c in expected_classes(rows)}
    assert left.count() >= len(classes)
    assert left.where("doc_id IN (2, 16)").isEmpty() and left.where("doc_id = 1").count() == 1
    assert probminhash.near_duplicates(frame(spark, [])).count() == 0
    assert probminhash.deduplicated(frame(spark, [])).count() == 0


def test_a_passage_in_many_texts_makes_no_class(spark):
    shared = prose(1, 60)
    rows = [(i, f"{shared} {prose(1000 + i, 60)}") for i in range(80)]
    rows += [(500 + i, rows[i][1] + " end") for i in range(0, 80, 8)]
    got = probminhash.near_duplicates(frame(spark, rows))
    same_rows(
        got.select("doc_id", "class_id"), [(i, i if i < 500 else i - 500) for i, _ in rows]
    )


def threshold_family(n=600):
    """A text and copies near the threshold; some have a copy of their own at 0.8 or a little less."""
    r, base, rows = random.Random(21), prose(77, 240, 10**6).split(), []
    for i in range(n // 2):
        own = list(base)
        for k in range(r.randrange(4, 9)):
            own[r.randrange(len(own))] = f"neu{i}x{k}"
        twin = list(own)
        for k in range(r.randrange(4, 8)):
            twin[r.randrange(len(own))] = f"zwei{i}x{k}"
        rows += [" ".join(own), " ".join(twin)]
    return [(i, t) for i, t in enumerate(rows)]


def test_all_alike_texts_of_a_bucket_are_linked(spark):
    rows = threshold_family()
    docs = frame(spark, rows)
    bands = {r._id: r.bands for r in probminhash.signed(docs, "doc_id", "text").collect()}
    sets = [set(weights(t)) for _, t in rows]
    assert all(len(s) == 236 for s in sets)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    buckets = {}
    for i, own in bands.items():
        for band, h in enumerate(own):
            buckets.setdefault((band, h), []).append(i)
    meet = {(i, j) for members in buckets.values() for k, i in enumerate(members) for j in members[:k]}
    both = {(i, j): len(sets[i] & sets[j]) for i, j in meet}
    alike = [p for p, n in both.items() if n / (472 - n) >= 0.8]
    assert len(meet) - len(alike) > 50_000
    for i, j in alike:
        root[max(find(i), find(j))] = min(find(i), find(j))
    got = probminhash.near_duplicates(docs).select("doc_id", "class_id")
    same_rows(got, [(i, find(i)) for i, _ in rows])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=30), min_size=2, max_size=6))
def test_no_pair_is_more_alike_than_its_bound(texts):
    sets = probminhash._sets(pa.array([" ".join(t) for t in texts]), 3)
    bounds = np.cumsum([0] + [len(s[0]) for s in sets])
    block = probminhash.Block(
        [bytes([i]) for i in range(len(sets))], *(np.concatenate([s[i] for s in sets]) for i in (0, 1)), bounds
    )
    most = probminhash.bounds_of(block, block)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert probminhash.similarity(x, y) <= most[i, j] + 1e-5
            if x[1].max() == y[1].max() == 1:
                assert probminhash.similarity(x, y) == pytest.approx(most[i, j], abs=1e-5)


# licences


def license_words(text):
    own = words(text)
    at, labels = [], set()
    for phrase, label in license_join.PHRASES:
        p = phrase.split()
        here = [i for i in range(len(own) - len(p) + 1) if own[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    share = 0.0
    more = set(labels)
    for t in license_join.TEMPLATES:
        template = set(t.text.split())
        n = len(t.text.split())
        for i in [i for i, w in enumerate(own) if w in template]:
            block = set(own[i : i + n + math.ceil(n / 4)])
            both = len(block & template)
            if set(t.must.split()) <= block and not set(t.without.split()) & block:
                if both >= math.ceil(0.8 * len(template) - 1e-9):
                    more.add(t.label)
                    share = max(share, both / len(template))
    return (
        len(own), len(at), min(at, default=None), max(at, default=None),
        ",".join(sorted(labels)), ",".join(sorted(more)), 1.0 if at else share,
    )


def test_license_scan_against_every_pair(spark):
    r = random.Random(3)
    rows = awkward_rows()
    for i in range(60):
        own = r.choice(license_join.TEMPLATES).text.split()
        for _ in range(r.randrange(4)):
            own[r.randrange(len(own))] = "anders"
        r.shuffle(own) if i % 3 == 0 else None
        rows.append((100 + i, f"{prose(i, 20)}\n{r.choice([' ', ', ']).join(own).title()}.\n{prose(i, 9)}"))
    rows += [
        (1000, "Released UNDER the-MIT\nlicense; underxthe mit license"),
        (1001, "under the mit license under the mit license CC BY-NC 4.0"),
        (1002, "apache \u212aey license version 2 apache license, version 2.0"),
        (1003, "under the m\u0131t license éunder the mit license under the mit licenseé"),
    ]
    for i in range(40):
        t = r.choice(license_join.TEMPLATES)
        near = r.choice(license_join.TEMPLATES)
        own = t.text.split() + near.text.split()[: r.randrange(12)] + prose(i, 5).split() + t.text.split()
        for _ in range(r.randrange(6)):
            own.insert(r.randrange(len(own)), r.choice(["und", "*", "lesser", "the", "3", "\n//"]))
        rows.append((2000 + i, " ".join(own)))
    got = license_join.scanned(frame(spark, rows))
    got = got.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                     F.array_join("base_labels", ","), F.array_join("labels", ","), "score")
    same_rows(got, [(i, *license_words(t)) for i, t in rows])
    assert license_join.scanned(frame(spark, [])).count() == 0


NOTICES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated"
     " documentation files", "mit"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the"
     "\nfollowing conditions\nare met:", "bsd"),
    ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public"
     " License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option)"
     " any later version.", "gpl-3"),
    ("licensed under CC BY 4.0", ""),
    ("licensed under the GNU Lesser General Public License version 2.1", ""),
    ("This work is licensed under the GNU Lesser General Public License, version 3", "lgpl-3"),
    ("This work is licensed under the GNU Affero General Public License, version 3", ""),
    ("released under the Apache license", ""),
    ("Licensed under the Apache License version 1.0", ""),
    ("Licensed under the Apache License,\nVersion 2.0", "apache-2"),
    ("released " + "x " * 100 + "under " + "y " * 100 + "the license " + "z " * 100 + "mit", ""),
    ("Licensed under\nCC BY-NC\n4.0", "cc-by-nc"),
]


def test_wrapped_notices_are_found_and_near_misses_are_not(spark):
    rows = [(i, f"{prose(i, 30)}\n{text}\n{prose(i + 50, 30)}") for i, (text, _) in enumerate(NOTICES)]
    got = {r.doc_id: ",".join(r.labels) for r in license_join.scanned(frame(spark, rows)).collect()}
    assert [got[i] for i in range(len(NOTICES))] == [label for _, label in NOTICES]


# URLs


def listed(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = lower(rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [
        (len(h + p), h + p, kind)
        for kind, h, p in url_rules.LISTED
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls_against_plain_python(spark):
    urls = [
        None, "", "no scheme", "http://", "http://net/", "http://net", "HTTP://A.NET/x?y#z",
        "https://www.Example.NET/en/1", "https://example.net/en", "https://notexample.net/en/1",
        "http://example.com/de/1?u=http://x.org/fr/", "http://sub.example.com/fr/", "http://a.org/fr/?q",
        "http://b.org#/fr/", "a://b://c/d", "http://x.org/\nfr/", "http://É.org/FR/",
    ]
    urls += [f"http://casino-{i}.example.org/xx/{i}" for i in range(60)]
    urls += [f"http://fine{i}.example.org/xx/{i}" for i in range(60)] + [urls[-1]] * 3
    pages = spark.createDataFrame(
        [(i, u, 1) for i, u in enumerate(urls)], "page_id bigint, url string, host int"
    )
    labels = spark.createDataFrame(
        [(i, int("casino" not in (u or "casino"))) for i, u in enumerate(urls) if i % 2]
        + [(None, 0), (21, None)],
        "doc_id bigint, quality int",
    )
    got = url_rules.judged(pages, labels, bad=F.col("quality") == 0).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = listed(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if "casino" in host else "allow")), urls[r.page_id]
    assert url_rules.judged(pages.limit(0), labels, bad=F.col("quality") == 0).count() == 0
    plain = url_rules.judged(pages, labels.limit(0), bad=F.col("quality") == 0)
    assert plain.count() == len(urls)


def test_listed_pages_count_once_each(spark):
    urls = ["http://spam.example.net/q"] * 25 + [f"http://fine{i}.org/fr/" for i in range(60)]
    urls += ["http://spam.info/x", "http://fine.info/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = url_rules.judged(pages).where("page_id >= 85").select("page_id", "verdict")
    same_rows(got, [(85, "block"), (86, "allow")])


def test_index_looks_up_rules_by_their_rarest_token(spark):
    rules = spark.createDataFrame([(["a", "b"],), (["b", "c"],)], "items array<string>")
    counts = spark.createDataFrame([("a", 5), ("b", 2), ("c", 9)], "token string, n bigint")
    same_rows(
        url_rules.indexed(rules, counts).select(F.array_join("items", ""), "item"),
        [("ab", "b"), ("bc", "b")],
    )


def blocked_by_some_rule(own, kinds, least, confidence):
    """Whether a url's tokens hold those of a frequent and confident rule; ``kinds`` are (tokens, blocked, count)."""
    for chosen in range(1, 1 << len(kinds)):
        common = set(own).intersection(*(t for i, (t, _, _) in enumerate(kinds) if chosen >> i & 1))
        if common:
            held = [(blocked, n) for t, blocked, n in kinds if common <= t]
            bad = sum(n for blocked, n in held if blocked)
            if bad >= least and bad >= confidence * sum(n for _, n in held):
                return True
    return False


def test_long_repeated_paths_end_and_equal_a_plain_miner(spark):
    r = random.Random(12)
    word = lambda i: "".join(chr(97 + (i * 7 + j * 3) % 26) for j in range(4)) + chr(97 + i % 26)
    path = "/".join(word(i) for i in range(40))
    bases = [f"spam.example.net/{path}", f"spam.example.net/{path}/more", "a-b.example.com/de/x/y", "a.example.com/de/x/z/w",
             "b.example.org/fr/x/y", "b.example.org/fr/q/w/k", "c.example.net/en/z/y", "d.example.net/k/w"]
    urls = [f"http://{b}" for b in bases for _ in range(r.choice([25, 30, 3]))] + ["http://spam.example.org/x", None]
    urls += [f"https://open{i}.example.edu/{p}" for i, p in enumerate([path, "x/y", "z/w/k", "/".join(path.split("/")[3:9]), "q", "k/w"])]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    started = time.time()
    got = {x.page_id: x.verdict for x in url_rules.judged(pages, min_support=0.01).collect()}
    assert time.time() - started < 90
    host, where = url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))
    rule, verdict = url_rules.listed_rule(host, where)
    rows = pages.select("page_id", url_rules.tokens_of(host, where).alias("t"), verdict.alias("v")).collect()
    count = {}
    for x in rows:
        if x.v:
            key = (frozenset(x.t), x.v == "block")
            count[key] = count.get(key, 0) + 1
    kinds = [(t, b, n) for (t, b), n in count.items()]
    total = sum(n for _, _, n in kinds)
    least = math.ceil(max(0.01 * total, url_rules.MIN_URLS) - 1e-9)
    for x in rows:
        want = x.v or ("block" if blocked_by_some_rule(x.t, kinds, least, 0.9) else "allow")
        assert got[x.page_id] == want, urls[x.page_id]
    assert sum(got[x.page_id] == "block" for x in rows if not x.v) >= 2


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442") and np.uint64(1)
