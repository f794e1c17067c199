"""License scans by an exact set-similarity join.

A template is a set of words, some of which it can't do without, as they tell it from other licences, and words that
must not stand among them. A block is a window of consecutive words that begins at a word of the template and is a
quarter longer than the template's text, wherever lines end. Every block is found that holds at least the share
``threshold`` of the template's words, all it can't do without, and none that it must not hold.

The words of all templates are ordered by how many documents hold them. A block with the wanted overlap shares a word
with the template's prefix, its |T| - t + 1 rarest words, where t is the overlap wanted; so texts meet templates at
the places of prefix words only. Places with fewer than t of the words around go first (length filter), and a block
counts at the rarest word that it shares (positional filter). The overlap of what stays is counted exactly.

Phrases are the plain base: places where given words stand consecutively.

DataFrame functions only. Null texts are empty. Repeated rows are scanned alike. An empty table gives no rows. Extra
columns are not carried. Memory follows from the templates' lengths, not from a line's or a text's.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.common import row_key, settle, text_or_empty

#: The phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)


class Template(NamedTuple):
    label: str
    text: str
    must: str
    without: str = ""

    @property
    def words(self) -> list[str]:
        return sorted(set(self.text.split()))

    @property
    def width(self) -> int:
        n = len(self.text.split())
        return n + -(-n // 4)


#: License notices as they are commonly written, in words.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files", "permission granted charge documentation"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation"
        " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to"
        " permit persons to whom the software is furnished to do so subject to the following conditions",
        "permission granted sublicense merge"),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission fee granted", "sublicense"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license 2"),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with"
        " the license you may obtain a copy of the license at", "apache license 2 compliance"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template(
        "cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license",
        "commons attribution noncommercial"),
    Template(
        "gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public 3",
        "lesser affero library"),
    Template(
        "gpl-3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
        " free software foundation either version 3 of the license or at your option any later version",
        "gnu general public 3", "lesser affero library"),
    Template(
        "lgpl-3", "this work is licensed under the gnu lesser general public license version 3", "gnu lesser general 3",
        "affero"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met", "redistribution source binary permitted"),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license 2"),
    Template("cc0", "dedicated to the public domain under the creative commons zero waiver", "public domain zero"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered public domain"),
)
THRESHOLD = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words after A-Z are lower-cased."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), SEPARATORS), "")


def _phrase_pattern(phrases) -> str:
    each = (SEPARATORS.join(p.split()) for p, _ in phrases)
    return f"(?i)(?<!{WORD})(?:{'|'.join(each)})(?!{WORD})"


def _places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase stands."""
    first, *rest = phrase.split()

    def stands(word: Column, i: Column) -> Column:
        here = word == first
        for j, w in enumerate(rest, 1):
            here = here & F.coalesce(F.get(words, i + j) == w, F.lit(False))
        return F.when(here, i)

    return F.filter(F.transform(words, stands), lambda i: i.isNotNull())


def wanted_overlap(template: Template, threshold: float) -> int:
    return math.ceil(threshold * len(template.words) - 1e-9)


INDEX = (
    "word string, place int, need int, width int, label string, template array<string>, must array<string>,"
    " without array<string>"
)


def prefixes(counts: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple]:
    """The words of every template's prefix, by the global order: rows of ``INDEX``."""
    out = []
    for t in templates:
        words = sorted(t.words, key=lambda w: (counts.get(w, 0), w))
        need = wanted_overlap(t, threshold)
        for place, word in enumerate(words[: len(words) - need + 1]):
            out.append((word, place, need, t.width, t.label, words, t.must.split(), t.without.split()))
    return out


def _literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _matches(texts: DataFrame, index: DataFrame, prefix_words: list[str], width: int) -> DataFrame:
    """``_key, first_word, label, share`` of the best block at each place of a prefix word in ``_key, _words``."""
    anchors = F.filter(
        F.transform("_words", lambda w, i: F.when(w.isin(prefix_words), F.struct(w.alias("word"), i.alias("at")))),
        lambda a: a.isNotNull(),
    )
    around = F.slice("_words", F.greatest(F.col("a.at") - width + 2, F.lit(1)), 2 * width - 1)
    places = texts.select("_key", "_words", F.explode(anchors).alias("a")).select(
        "_key", F.col("a.word").alias("word"), F.col("a.at").alias("at"), around.alias("_around"),
        F.least("a.at", F.lit(width - 1)).alias("_place"),
    )
    # what a block of this template can reach from the place, and the place in it
    back = F.least("_place", F.col("width") - 1)
    reach = F.slice("_around", F.col("_place") - back + 1, back + F.col("width"))
    near = places.join(index, "word").select(
        "_key", "at", "place", "need", "width", "label", "template", "must", "without",
        back.alias("_back"), reach.alias("_near"),
    )
    near = near.where(
        (F.size(F.array_intersect("template", "_near")) >= F.col("need")) & (F.size(F.array_except("must", "_near")) == 0)
    )
    starts = F.filter(F.sequence(F.lit(0), F.col("_back")), lambda i: F.array_contains("template", F.get("_near", i)))

    def judged(i: Column) -> Column:
        block = F.slice(F.col("_near"), i + 1, F.col("width"))
        fits = (
            # a rarer word of the template would speak for this block
            ~F.arrays_overlap(block, F.slice("template", 1, F.col("place")))
            & ~F.arrays_overlap(block, F.col("without"))
            & (F.size(F.array_except(F.col("must"), block)) == 0)
        )
        return F.when(fits, F.struct(F.size(F.array_intersect(F.col("template"), block)).alias("overlap"), (-i).alias("i")))

    best = near.withColumn("_best", F.array_max(F.transform(starts, judged))).where("_best.overlap >= need")
    return best.select(
        "_key", (F.col("at") - F.col("_back") - F.col("_best.i")).cast("bigint").alias("first_word"), "label",
        (F.col("_best.overlap") / F.size("template")).alias("share"),
    )


def scanned(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, blocks, labels, score.

    ``base_labels`` and ``labels`` are arrays; ``blocks`` are the best blocks found at places of rare words, with
    their first word's number, label and share of the template's words; ``score`` is 1 with a phrase, else the
    greatest share.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    text = F.col("_text")
    rows = docs.select(
        F.col(f"`{id_column}`").alias("_id"), text_or_empty(f"`{text_column}`").cast("string").alias("_text")
    )
    # lower() may turn rare letters into a-z: enough to choose candidates, which are looked at again
    loose = F.array_remove(F.split(F.lower(text), SEPARATORS), "")
    rows = rows.select("_id", "_text", loose.alias("_loose"))
    rows = rows.select(
        "_id", "_text", F.size("_loose").cast("bigint").alias("n_words"),
        F.array_intersect("_loose", _literals(vocabulary)).alias("_known"),
    )
    wanted = F.lit(False)
    for t in templates:
        enough = F.size(F.array_intersect("_known", _literals(t.words))) >= wanted_overlap(t, threshold)
        wanted = wanted | (enough & (F.size(F.array_except(_literals(t.must.split()), "_known")) == 0))
    rows = rows.select("_id", "n_words", "_known", "_text", wanted.alias("_wanted"))
    rows = rows.select(
        "_id", "n_words", "_known",
        F.when(F.col("_wanted"), row_key("_id", "_text")).alias("_key"),
        F.when(F.col("_wanted") | text.rlike(_phrase_pattern(phrases)), words_of(text)).alias("_words"),
    )
    found = [_places(F.col("_words"), p) for p, _ in phrases]
    rows = rows.select(
        "_id", "n_words", "_known", "_key", F.when(F.col("_key").isNotNull(), F.col("_words")).alias("_candidate"),
        F.when(F.col("_words").isNotNull(), F.array(*found)).alias("_at"),
    )
    rows = settle(rows, "scanned")

    # The global order: at most one count for each word of the templates.
    counts = dict(
        rows.select(F.explode("_known").alias("w")).groupBy("w").count().collect()
    )
    prefix = prefixes(counts, templates, threshold)
    index = docs.sparkSession.createDataFrame(prefix, INDEX)
    texts = rows.where("_key IS NOT NULL").select("_key", F.col("_candidate").alias("_words")).dropDuplicates(["_key"])
    width = max(t.width for t in templates)
    matched = _matches(texts, index, sorted({p[0] for p in prefix}), width).groupBy("_key").agg(
        F.array_sort(F.collect_set("label")).alias("_more"), F.max("share").alias("_share"),
        F.array_sort(F.collect_set(F.struct("first_word", "label", "share"))).alias("blocks"),
    )
    # rows without candidates must not meet in one partition of the join
    table = (
        rows.where("_key IS NOT NULL").join(matched, "_key", "left")
        .unionByName(rows.where("_key IS NULL"), allowMissingColumns=True)
    )
    at = F.flatten(F.coalesce("_at", F.array().cast("array<array<int>>")))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*(
        F.when(F.size(F.get("_at", F.lit(i))) > 0, label) for i, (_, label) in enumerate(phrases)
    )))))
    base = F.coalesce(base, F.array().cast("array<string>"))
    more = F.coalesce("_more", F.array().cast("array<string>"))
    return table.select(
        F.col("_id").alias(id_column), "n_words",
        F.size(at).cast("bigint").alias("n_base"),
        F.array_min(at).cast("bigint").alias("first_word"),
        F.array_max(at).cast("bigint").alias("last_word"),
        base.alias("base_labels"), "blocks",
        F.array_sort(F.array_union(base, more)).alias("labels"),
        F.when(F.size(at) > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )
