"""Registered queries of the operators, with the SQL of the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchsafe.llm import (
    chat_format,
    counting,
    license_join,
    packing,
    probminhash,
    pu_quality,
    square_runs,
    toxicity,
    training_order,
    url_rules,
    vantage_clusters,
    weak_rules,
    winnowing,
)
from vouchsafe.llm.common import crc32_of, shared_folder
from vouchsafe.session import prepare, small_frame

QUERIES = {}
CHECK_SQL = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            CHECK_SQL[function.__name__] = sql
        return function

    return register


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words_sql(text: str) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"regexp_extract_all({_LOWER.format(text)}, '{pattern}')"


CONTAMINATION_SQL = f"""WITH items AS (
  SELECT *, least(13, len(w)) AS n
  FROM (SELECT CAST(item_id AS VARCHAR) AS item, {_words_sql("text")} AS w FROM benchmark) WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS span
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
docs AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents),
doc_windows AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS span
  FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
found AS (SELECT doc_id, n, i, item FROM doc_windows JOIN item_windows USING (n, span)),
hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _license_sql() -> str:
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in license_join.PHRASES)
    templates = ", ".join(
        f"('{t.label}', '{t.text}', '{t.must}', '{t.without}', {t.width})" for t in license_join.TEMPLATES
    )
    return f"""WITH docs AS (SELECT doc_id, text, {_words_sql("text")} AS w FROM documents),
phrases AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {phrases}) t(phrase, label)),
places AS (
  SELECT doc_id, i - 1 AS place, label
  FROM (SELECT d.doc_id, d.w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM docs d, phrases
        WHERE len(w) >= len(p) AND list_has_all(w, p))
  WHERE list_slice(w, i, i + len(p) - 1) = p),
templates AS (
  SELECT label, list_distinct(string_split(words, ' ')) AS t, string_split(must, ' ') AS must,
    string_split(without, ' ') AS without, width FROM (VALUES {templates}) v(label, words, must, without, width)),
blocks AS (
  SELECT doc_id, label, t, must, without, list_distinct(list_slice(w, i, i + width - 1)) AS b
  FROM (SELECT d.doc_id, d.w, v.*, unnest(range(1, len(w) + 1)) AS i FROM docs d, templates v
        WHERE list_has_all(w, must) AND len(list_intersect(list_distinct(w), t)) >= ceil({license_join.THRESHOLD} * len(t) - 1e-9))
  WHERE list_contains(t, w[i])),
shares AS (
  SELECT doc_id, label, len(list_intersect(b, t)) / len(t) AS share FROM blocks
  WHERE list_has_all(b, must) AND NOT list_has_any(b, without)
    AND len(list_intersect(b, t)) >= ceil({license_join.THRESHOLD} * len(t) - 1e-9)),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY 1),
more AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
    SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM shares) GROUP BY 1),
best AS (SELECT doc_id, max(share) AS share FROM shares GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id) LEFT JOIN best USING (doc_id)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_feistel_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sequence of ids stands in the written shards."""
    docs = table(spark, sf_dir, "documents")
    return training_order.write_shards(docs, shared_folder(spark, "training"), key=20240229)


def toxic_held_out() -> Column:
    return F.coalesce(crc32_of("doc_id") % 5 == 0, F.lit(False))


@query()
def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, ~toxic_held_out())
    return toxicity.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", toxic_held_out().alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query()
def op3_resynchronised_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes")
    )
    return counting.counted(docs).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > counting.LIMIT).alias("over_limit")
    )


@query()
def op4_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def quality_held_out() -> Column:
    return F.coalesce(crc32_of("doc_id") % 4 == 2, F.lit(False))


@query()
def op5_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = pu_quality.train(docs, labels, ~quality_held_out())
    return pu_quality.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", quality_held_out().alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@query()
def op6_association_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return url_rules.judged(pages, labels, bad=(F.col("quality") == 0) | (F.col("toxic") == 1))


@query()
def op7_weak_supervision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    verdict, column = weak_rules.judged(docs, carry=["doc_id"])
    wanted = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept posterior"
    return verdict.select("doc_id", *(f"{column}.{c}" for c in wanted.split()))


@query(CONTAMINATION_SQL)
def op8_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        winnowing.is_contaminated().alias("contaminated"),
    )


@query(_license_sql())
def op9_set_similarity_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_join.scanned(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


@query()
def op10_probminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


def _clusters_sql(k: int = 16, dim: int = 64, rounds: int = 3) -> str:
    steps = [f"""WITH points AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS p
  FROM embeddings WHERE len(embedding) = {dim}
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dim}),
centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, p) - 1 AS c, p AS q
  FROM points QUALIFY c < {k})"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""placed{r} AS MATERIALIZED (
  SELECT row_id, vec_id, p, c, d FROM (
    SELECT *, list_sum([(p[i] - q[i]) * (p[i] - q[i]) FOR i IN range(1, {dim + 1})]) AS d
    FROM points, centroids{r})
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, c) = 1)""")
        if r < rounds:
            steps.append(f"""sums{r} AS (
  SELECT c, i, sum(p[i]) AS s, count(*) AS n FROM placed{r}, range(1, {dim + 1}) t(i) GROUP BY c, i),
means{r} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM sums{r} GROUP BY c),
centroids{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.q, o.q) AS q FROM centroids{r} o LEFT JOIN means{r} m USING (c))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(list_aggregate(q, 'string_agg', ',')) AS centroid_sha256
FROM placed{rounds} JOIN centroids{rounds} USING (c)"""


@query(_clusters_sql())
def op11_vantage_point_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, centroids = vantage_clusters.clusters(table(spark, sf_dir, "embeddings"), dim=64, k=16, rounds=3, seed=1)
    return vantage_clusters.with_inertia(members, centroids)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; of a tenth of the documents, chosen by their ids, the end repeats a few of their words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = (
        docs.where(h % 10 == 0).select("doc_id", words.alias("w"), F.floor(h / 10).alias("g"))
        .where(F.size("w") > 0)
        .select("*", (F.col("g") % F.size("w")).cast("int").alias("a"))
        .select("*", (1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    )
    repeated = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    as_they_are = docs.where(F.coalesce((h % 10 != 0) | (F.size(words) == 0), F.lit(True)))
    return as_they_are.select("doc_id", "text").unionAll(chosen.select("doc_id", F.array_join(repeated, " ")))


@query()
def op12_dyadic_square_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_period(table(spark, sf_dir, "documents"))
    found = square_runs.described(docs, carry=["doc_id"]).withColumn("best", square_runs.strongest("runs"))
    line = lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        digest(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


#: A conversation that says the marks of a common template.
CONTROL_TALK = [
    {"conv_id": -7, "turn": i, "role": role, "text": "</s>[INST] ok [/INST]"} for i, role in enumerate(("user", "assistant"))
]


def conversation_records(rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``record``: rows by turn (then role and text) in the layouts that such conversations come in.

    What a prompt, or an instruction with a system text, can hold is one; all else is a list of messages.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    said = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("said"))
    roles = F.transform("said", lambda t: t["role"])
    text = lambda i: F.get("said", F.lit(i))["content"]
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    messages = F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    record = (
        F.when(is_("user", "assistant"), F.to_variant_object(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(is_("system", "user", "assistant"), F.to_variant_object(F.struct(
            text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .otherwise(F.to_variant_object(F.struct(messages.alias("messages"))))
    )
    return said.select("conv_id", record.alias("record"))


_ESCAPED = "regexp_replace({}, '" + chat_format._FIRST + chat_format._REST + r"', '\1\\\2', 'g')"
_TEMPLATE = len(chat_format.OPEN + chat_format.MIDDLE + chat_format.CLOSE)
CHAT_SQL = f"""WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_TEMPLATE} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id"""


@query(CHAT_SQL)
def op13_fingerprinted_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(small_frame(spark, CONTROL_TALK, "conv_id bigint, turn bigint, role string, text string"))
    made = chat_format.formatted(chat_format.canonical_turns(conversation_records(rows)))
    read = made.select(
        "conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"),
        chat_format.read_back(F.col("formatted")).alias("turns"),
        chat_format.trained_text(F.col("formatted"), F.col("loss")).alias("trained"),
    )
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        digest(F.array_join(F.transform("turns", line), "")).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"),
        digest(F.col("trained")).alias("loss_sha256"), "formatted_chars",
    )
