"""URL filters: a list of block and allow rules, and association rules for what it leaves open.

A listed rule (host, path) fits its host and all subdomains where the url's path starts with the rule's;
the longest wins. The other verdicts come from association rules: FP-growth mines combinations of URL
tokens that go with blocked pages among labelled ones, rules below the least support or confidence are
pruned, and a url is blocked where all tokens of some rule occur in it. Tokens that always come together are mined
as one item, as else every choice among the words of a repeated path would be a rule. Rules are found by an inverted
index: each stands under its rarest item, and a url looks up its own items.

DataFrame functions and Spark's own FP-growth only. Null urls and urls without ``://`` have an empty
host and path and no tokens, so they are allowed. Repeated rows get equal verdicts. Without labelled
urls there are no mined rules; without pages the result is empty. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.common import settle

#: (verdict, host, path)
LISTED = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: A rule needs this share of the labelled urls, and in small tables so many of them.
MIN_SUPPORT = 0.002
MIN_URLS = 20
MIN_CONFIDENCE = 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKED = "label=block"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: the labels of the host and their parts, and the words of the path.

    Those of the host are marked by their kind, as ``net`` means something else in a path.
    """
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(host, r"[.\-]"), lambda x: x != "")
    words = F.filter(F.split(path, r"[^A-Za-z]+"), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.transform(F.slice(F.reverse(labels), 1, 1), lambda x: F.concat(F.lit("top="), x)),
            F.transform(parts, lambda x: F.concat(F.lit("host="), x)),
            F.transform(words, lambda x: F.concat(F.lit("path="), x)),
        )
    )


def token_classes(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> tuple[DataFrame, int, float]:
    """``token, item`` of the frequent tokens, the number of labelled urls, and the least support.

    Tokens that occur in exactly the same labelled urls are one item, named after the least of them: they have the
    same rules, and item sets need not be mined for every choice among them. Equal urls are one kind with a count;
    that two tokens share all kinds is told by their counts and two sums of the kinds' hashes.
    """
    kinds = labelled.where(F.size("tokens") > 0).groupBy("tokens", "blocked").agg(F.count("*").alias("n"))
    n = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    support = min(1.0, max(min_support, MIN_URLS / n)) if n else 1.0
    kind = F.xxhash64("tokens", "blocked")
    tokens = kinds.select("n", kind.alias("kind"), F.explode("tokens").alias("token")).groupBy("token").agg(
        F.sum("n").alias("n"), F.bit_xor("kind").alias("mixed"), F.sum(F.pmod("kind", F.lit(1 << 31))).alias("total")
    )
    same = F.struct("n", "mixed", "total")
    items = tokens.where(F.col("n") >= support * n).groupBy(same).agg(F.collect_list("token").alias("all"))
    return items.select(F.explode("all").alias("token"), F.array_min("all").alias("item")), n, support


def with_items(rows: DataFrame, key: list[str], classes: DataFrame) -> DataFrame:
    """``key, items`` of rows with ``tokens``; rows without a frequent token are left out."""
    single = rows.select(*key, F.explode("tokens").alias("token")).join(classes, "token")
    return single.groupBy(*key).agg(F.collect_set("item").alias("items"))


def mined_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> tuple[DataFrame, DataFrame]:
    """(items, confidence, support) of rules "all these items, so blocked", and ``token_classes``.

    ``labelled`` has (tokens, blocked). A rule whose part is already a rule stays; it adds nothing.
    """
    classes, n, support = token_classes(labelled, min_support)
    spark = labelled.sparkSession
    if not n:
        return spark.createDataFrame([], "items array<string>, confidence double, support double"), classes
    classes = settle(classes, "classes")
    kinds = labelled.groupBy("tokens", "blocked").agg(F.count("*").alias("n")).withColumn(
        "kind", F.xxhash64("tokens", "blocked")
    )
    single = kinds.select("kind", "blocked", "n", "tokens")
    named = with_items(single, ["kind", "blocked", "n"], classes)
    # urls without a frequent token count for the support, and their label for the rule without tokens
    rest = single.join(named.select("kind"), "kind", "left_anti").where(F.size("tokens") > 0).select(
        "kind", "blocked", "n", F.array().cast("array<string>").alias("items")
    )
    items = F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCKED))).otherwise(
        F.when(F.size("items") > 0, F.col("items")).otherwise(F.array(F.lit("")))
    )
    urls = named.unionByName(rest).select(items.alias("items"), F.explode(F.sequence(F.lit(1), F.col("n"))))
    miner = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence)
    found = miner.fit(urls.select("items")).associationRules
    rules = found.where(F.array_contains("consequent", BLOCKED)).select(
        F.array_sort("antecedent").alias("items"), "confidence", "support"
    )
    return rules, classes


def indexed(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """The inverted index: each rule under its rarest item, by how many urls hold the token that names it."""
    counts = counts.withColumnRenamed("token", "item")
    parts = rules.select("items", F.explode("items").alias("item")).join(counts, "item", "left")
    return parts.groupBy("items").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item"))["item"].alias("item")
    )


def judged(
    pages: DataFrame, labels: DataFrame | None = None, id_column: str = "page_id",
    url_column: str = "url", label_id: str = "doc_id", bad: Column | None = None, rules=LISTED,
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """(id, host, path, rule, verdict) of every page.

    Labelled are the urls that the list judges, by its verdict, and those of pages with a label,
    blocked where ``bad`` holds for one of the page's labels.
    """
    url = F.col(f"`{url_column}`").cast("string")
    host, path = F.col("host"), F.col("path")
    rule, verdict = listed_rule(host, path, rules)
    named = (
        pages.select(F.col(f"`{id_column}`").alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
        .select("_id", "host", "path", rule.alias("rule"), verdict.alias("listed"))
    )
    # A verdict hangs on host and path only, so equal ones are judged once.
    kinds = settle(
        named.select("host", "path", "listed").distinct().withColumn("tokens", tokens_of(host, path)),
        "urls",
    )
    # Support and confidence are shares of all labelled urls: each page counts once, whoever labels it.
    examples = named.where("listed IS NOT NULL").select(
        tokens_of(host, path).alias("tokens"), (F.col("listed") == "block").alias("blocked")
    )
    if labels is not None:
        told = labels.groupBy(F.col(label_id).alias("_id")).agg(F.max(bad).alias("blocked"))
        more = named.where("listed IS NULL").join(told.where("blocked IS NOT NULL"), "_id")
        examples = examples.unionByName(more.select(tokens_of(host, path).alias("tokens"), "blocked"))
    counts = kinds.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    mined, classes = mined_rules(examples, min_support, min_confidence)
    index = settle(indexed(mined, counts), "rules")
    open_ = with_items(kinds.where("listed IS NULL"), ["host", "path"], classes)
    hit = (
        open_.select("host", "path", F.col("items").alias("_own"), F.explode("items").alias("item"))
        .join(index, "item")
        .where(F.size(F.array_except("items", "_own")) == 0)
        .select("host", "path", F.lit(True).alias("_hit")).distinct()
    )
    return named.join(hit, ["host", "path"], "left").select(
        F.col("_id").alias(id_column), "host", "path", "rule",
        F.coalesce("listed", F.when(F.col("_hit"), "block").otherwise("allow")).alias("verdict"),
    )
