"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from understory.llm import bpe, chat, langid, leaks, pii, quality, repeats, runs, simhash, spelling, token_files, topk, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_simhash_near_duplicates")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op2_preference_pairs", """
WITH turns AS (
  SELECT conv_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS said
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
last AS (
  SELECT conv_id, max(turn) AS final, arg_max(said.text, turn) AS reply FROM turns WHERE said.role = 'assistant' GROUP BY conv_id),
ends AS (
  SELECT l.conv_id, l.final, o.reply FROM last l LEFT JOIN last o ON o.conv_id = xor(l.conv_id, 1)),
sides AS (
  SELECT 'c' AS side, conv_id, turn, said.role AS role, said.text AS text FROM turns
  UNION ALL
  SELECT 'r', t.conv_id, turn, said.role, CASE WHEN turn = final THEN reply ELSE said.text END
  FROM turns t JOIN ends e USING (conv_id) WHERE turn < final OR turn = final AND reply IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY side, conv_id ORDER BY turn) - 1 AS place,
         '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS shown FROM sides),
faced AS (
  SELECT conv_id, place, c.role AS c_role, c.shown AS c_shown, r.role AS r_role, r.shown AS r_shown
  FROM (SELECT * FROM placed WHERE side = 'c') c FULL JOIN (SELECT * FROM placed WHERE side = 'r') r USING (conv_id, place)),
forked AS (
  SELECT *, coalesce(min(CASE WHEN c_shown IS DISTINCT FROM r_shown THEN place END) OVER (PARTITION BY conv_id),
                     count(*) OVER (PARTITION BY conv_id)) AS fork FROM faced),
laid AS (
  SELECT *, coalesce(sum(CASE WHEN place >= fork THEN length(c_shown) END) OVER before, 0) AS c_at,
         coalesce(sum(CASE WHEN place >= fork THEN length(r_shown) END) OVER before, 0) AS r_at
  FROM forked WINDOW before AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id AS pair_id, max(fork)::INT AS prompt_turns,
  coalesce(string_agg(c_shown, '' ORDER BY place) FILTER (WHERE place < fork), '') AS prompt,
  coalesce(string_agg(c_shown, '' ORDER BY place) FILTER (WHERE place >= fork), '') AS chosen,
  coalesce(string_agg((c_at + 14)::BIGINT || ':' || (c_at + length(c_shown) - 8)::BIGINT, ',' ORDER BY place)
    FILTER (WHERE place >= fork AND c_role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(r_shown, '' ORDER BY place) FILTER (WHERE place >= fork), '') AS rejected,
  coalesce(string_agg((r_at + 14)::BIGINT || ':' || (r_at + length(r_shown) - 8)::BIGINT, ',' ORDER BY place)
    FILTER (WHERE place >= fork AND r_role = 'assistant'), '') AS rejected_mask
FROM laid GROUP BY conv_id
""")
def preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return chat.preference_pairs(*chat.swapped_replies(table(spark, folder, "conversations")))


@query("op3_token_files")
def token_files_checked(spark: SparkSession, folder: str) -> DataFrame:
    index = token_files.write_token_files(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.checksums(index)


@query("op4_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    tokens = bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_personal_data")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"))
    counts = [pii.counted(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written_out(F.col("base")), 256).alias("base_sha256"),
                        pii.written_out(F.col("spans")).alias("spans"))


@query("op6_exact_top_k", """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])))::BIGINT AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
""")
def exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


@query("op7_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = langid.held_out(F.col("doc_id"), 5, 0)
    labels = table(spark, folder, "labels").filter(~held)
    made = quality.featured(docs)
    found = quality.scores_of(made, quality.train_on(made, labels))
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= quality.CUT, 1).otherwise(0).alias("predicted"))


@query("op8_benchmark_leaks")
def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: The contract's rules, and the names whose sites are blocked under any domain.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block")]
FAMILIES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


@query("op9_url_filter", f"""
WITH cut AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS place FROM pages),
parts AS (SELECT page_id, CASE WHEN place > 0 THEN substr(url, place + 3) ELSE '' END AS rest FROM cut),
hosts AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS h, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM parts),
judged AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM hosts),
rules(h, p, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
hits AS (
  SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM judged j JOIN rules r ON (j.host = r.h OR ends_with(j.host, '.' || r.h)) AND starts_with(j.path, r.p) GROUP BY page_id),
listed AS (
  SELECT DISTINCT host || path AS k FROM judged
  WHERE len(list_filter(string_split(host, '.'), lambda x: x IN ({", ".join(f"'{f}'" for f in FAMILIES)}))) > 0)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host || path IN (SELECT k FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN hits USING (page_id)
""")
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The list holds the addresses of all pages on sites of the families, so it grows with the table."""
    pages = table(spark, folder, "pages")
    host = urls.host_of(F.col("url"))
    bad = F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, FAMILIES)))
    return urls.verdicts(pages, RULES, pages.filter(bad).select(F.concat(host, urls.path_of(F.col("url"))).alias("key")))


@query("op10_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    found = langid.identify(docs, langid.prototypes(docs.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op12_repeated_substrings")
def repeated_substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.collapsed(table(spark, folder, "documents"), rewrite=runs.repeated_tail)
    best = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS start, -r.period AS period)))")
    lines = F.array_join(F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))"), "")
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op11_spelling_variants")
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"), read=spelling.slip)
