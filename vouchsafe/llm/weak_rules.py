"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation estimates how accurate
each rule is and how common good documents are, without labels, from the counts of the vote
patterns over all documents that pass the base rules (at most 3 ** rules rows, whatever the corpus). A document is kept by its
posterior probability of being good, so one failed rule does not reject it by itself.

Null and empty texts have no words, so the base rule on length rejects them. Repeated rows
are judged alike. An empty table gives no rows. Extra columns are kept by ``judged``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.common import fresh_name, settle, text_or_empty

SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50


#: Up to this many repeated windows are looked up one by one; more are found by sorting.
FEW_REPEATED = 32


def measured(rows: DataFrame, text: Column, into: str) -> DataFrame:
    """``rows`` with what the rules look at, as a struct column ``into``.

    Every array is a column before it is used again, so that it is computed once and outside
    the lambdas that walk over it.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns]
    step = rows.select(
        *kept,
        F.array_remove(F.split(text, SPACES), "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE)).alias("_l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("bigint").alias("_capitals"),
        F.regexp_count(text, F.lit("[.!?]")).cast("bigint").alias("_stops"),
    )
    words, lines, plain = F.col("_w"), F.col("_l"), ["_symbols", "_capitals", "_stops"]
    hashed = F.transform(
        words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    )
    step = step.select(
        *kept, *plain,
        F.size(words).cast("bigint").alias("_n"),
        F.char_length(F.array_join(words, "")).cast("bigint").alias("_chars"),
        F.size(lines).cast("bigint").alias("_n_lines"),
        F.size(F.array_distinct(lines)).cast("bigint").alias("_n_kinds"),
        F.slice(hashed, 1, F.greatest(F.size(words) - 2, F.lit(0))).alias("_h"),
    )
    plain += ["_n", "_chars", "_n_lines", "_n_kinds"]
    step = step.select(*kept, *plain, "_h", F.sort_array("_h").alias("_s"))
    ordered = F.col("_s")
    step = step.select(
        *kept, *plain, "_h",
        F.array_distinct(F.filter(ordered, lambda h, i: h == F.get(ordered, i + 1))).alias("_d"),
    )
    step = step.select(*kept, *plain, _repeated(F.col("_h"), F.col("_d")).alias("_at"))
    covered = F.array_union(
        F.array_union(F.col("_at"), F.transform("_at", lambda i: i + 1)),
        F.transform("_at", lambda i: i + 2),
    )
    return step.select(
        *kept,
        F.struct(
            F.col("_n").alias("n_words"), F.col("_chars").alias("word_chars"),
            F.col("_symbols").alias("n_symbols"),
            (F.col("_n_lines") - F.col("_n_kinds")).alias("n_dup_lines"),
            F.size(covered).cast("bigint").alias("n_repeat_words"),
            F.col("_n_lines").alias("n_lines"),
            F.col("_capitals").alias("n_capitals"), F.col("_stops").alias("n_stops"),
        ).alias(into),
    )


def _repeated(windows: Column, twice: Column) -> Column:
    """Places of the windows whose hash is in ``twice``, those held at least twice."""
    none = F.array().cast("array<int>")
    by_look = F.array_except(
        F.transform(windows, lambda h, i: F.when(F.array_contains(twice, h), i)),
        F.array(F.lit(None).cast("int")),
    )
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    by_sort = F.transform(
        F.array(placed),
        lambda p: F.transform(
            F.filter(
                p,
                lambda x, j: (x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"]),
            ),
            lambda x: x["i"],
        ),
    )[0]
    return (
        F.when(F.size(twice) == 0, none)
        .when(F.size(twice) <= FEW_REPEATED, by_look)
        .otherwise(by_sort)
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    )


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: Column
    good: Column

    def vote(self) -> Column:
        known = F.col("n_words") > 0
        return (
            F.when(known & self.bad, -1).when(known & self.good, 1).otherwise(0).cast("tinyint")
        )


def default_rules() -> list[Rule]:
    """Passing a lenient rule says little, so rules vote bad or abstain, and one votes good.

    They vote on what the base rules let pass, so none of them is about length.
    """
    words, chars = F.col("n_words"), F.col("word_chars")
    per_word = chars / F.greatest(words, F.lit(1))
    never = F.lit(False)
    return [
        Rule("symbols", 10 * F.col("n_symbols") > words, never),
        Rule("lines", 2 * F.col("n_dup_lines") > F.col("n_lines"), never),
        Rule("repeats", 10 * F.col("n_repeat_words") > 4 * words, never),
        Rule("word_length", (per_word < 2.5) | (per_word > 12), never),
        Rule("capitals", 10 * F.col("n_capitals") > 3 * chars, never),
        Rule("prose", never, (20 * F.col("n_symbols") <= words) & (10 * F.col("n_capitals") <= chars)
             & (10 * F.col("n_repeat_words") <= 4 * words) & (60 * F.col("n_stops") >= words)
             & (3 * F.col("n_stops") <= words)),
    ]


VOTES = (-1, 0, 1)


@dataclass
class Accuracies:
    """The label model: P(good), and for each rule P(vote | good) and P(vote | bad)."""

    prior: float
    given_good: list[dict[int, float]]
    given_bad: list[dict[int, float]]

    def weights(self) -> list[dict[int, float]]:
        return [
            {v: math.log(g[v]) - math.log(b[v]) for v in VOTES}
            for g, b in zip(self.given_good, self.given_bad)
        ]

    def base(self) -> float:
        return math.log(self.prior) - math.log(1 - self.prior)

    def posterior(self, votes: list[Column]) -> Column:
        total = F.lit(self.base())
        for v, w in zip(votes, self.weights()):
            total = total + F.when(v == -1, w[-1]).when(v == 1, w[1]).otherwise(w[0])
        return 1 / (1 + F.exp(-total))


#: Where estimation starts: what a rule says of a good and of a bad document.
START_GOOD = {-1: 0.005, 0: 0.495, 1: 0.5}
START_BAD = {-1: 0.25, 0: 0.6, 1: 0.15}
START_PRIOR = 0.85


def estimate(patterns: dict[tuple[int, ...], int], rules: int, rounds: int = 50) -> Accuracies:
    """Expectation-maximisation over vote patterns and their counts.

    Votes are independent given the class. A rule that never votes one way says nothing by it.
    A bad vote stays at least twice as likely for bad documents and a good vote at least as
    likely for good ones: rules are better than chance, which also fixes which class is which.
    """
    votes_of = [{v for p in patterns for v in (p[j],)} for j in range(rules)]

    def shares(counts: list[dict[int, float]], start: dict[int, float]) -> list[dict[int, float]]:
        out = []
        for j, c in enumerate(counts):
            used = {v: c[v] + start[v] for v in VOTES if v in votes_of[j]}
            total = sum(used.values()) or 1.0
            out.append({v: max(used[v] / total, 1e-6) if v in used else 1.0 for v in VOTES})
        return out

    nothing = [dict.fromkeys(VOTES, 0.0) for _ in range(rules)]
    model = Accuracies(START_PRIOR, shares(nothing, START_GOOD), shares(nothing, START_BAD))
    for _ in range(rounds):
        good = [dict.fromkeys(VOTES, 0.0) for _ in range(rules)]
        bad = [dict.fromkeys(VOTES, 0.0) for _ in range(rules)]
        n_good, n_bad = START_PRIOR, 1 - START_PRIOR
        weights, base = model.weights(), model.base()
        for votes, n in sorted(patterns.items()):
            odds = base + sum(w[v] for w, v in zip(weights, votes))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            n_good += n * p
            n_bad += n * (1 - p)
            for j, v in enumerate(votes):
                good[j][v] += n * p
                bad[j][v] += n * (1 - p)
        given_good, given_bad = shares(good, START_GOOD), shares(bad, START_BAD)
        for j in range(rules):
            g, b = given_good[j], given_bad[j]
            if -1 in votes_of[j]:
                g[-1] = min(g[-1], b[-1] / 2)
            if 1 in votes_of[j]:
                b[1] = min(b[1], g[1])
        prior = min(max(n_good / (n_good + n_bad), 0.01), 0.99)
        model = Accuracies(prior, given_good, given_bad)
    return model


def judged(
    docs: DataFrame, text_column: str = "text", rules: list[Rule] | None = None,
    keep: float = 0.5, carry: list[str] | None = None,
) -> tuple[DataFrame, str]:
    """``docs`` (or its columns ``carry``) with a struct column of the verdict; and its name.

    The struct holds the measures, base_failed, posterior and kept. The measured table is
    written once, as its vote patterns must be counted before any document is judged.
    """
    rules = rules or default_rules()
    column = fresh_name(docs, "quality_rules")
    kept = docs.columns if carry is None else carry
    # the row travels as one struct, so that no name of it meets one of the work's
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row")
    plain = docs.select(row, text_or_empty(f"`{text_column}`").cast("string").alias("_t"))
    table = settle(measured(plain, F.col("_t"), "_m").drop("_t"), "measures")
    inner = table.select("_m.*").columns
    flat = table.select("_m.*")
    votes = [r.vote().alias(f"v{j}") for j, r in enumerate(rules)]
    # What the base rules reject is decided and would only blur the classes.
    counted = flat.where(~base_failed()).select(*votes).groupBy(*(f"v{j}" for j in range(len(rules)))).count().collect()
    model = estimate({tuple(r[:-1]): r[-1] for r in counted}, len(rules))

    # Rules name measures as plain columns: judge a projection in which only they are visible.
    verdict = table.select("_row", "_m.*")
    verdict = verdict.select(
        "_row", F.struct(*inner).alias("_m"), base_failed().alias("base_failed"),
        model.posterior([r.vote() for r in rules]).alias("posterior"),
    )
    verdict = verdict.select(
        "_row.*",
        F.struct(
            "_m.*", "base_failed", "posterior",
            (~F.col("base_failed") & (F.col("posterior") >= keep)).alias("kept"),
        ).alias(column),
    )
    return verdict, column


def keep_good(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents that the rules keep, with their columns as they were."""
    verdict, column = judged(docs, text_column)
    return verdict.where(F.col(f"`{column}`.kept")).select(*(F.col(f"`{c}`") for c in docs.columns))
