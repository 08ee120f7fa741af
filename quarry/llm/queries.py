"""The thin queries over the tables of a data directory, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, chat_tree, exact_dedup, license_scan, ngram_lm, packing, quality, simhash, suffix_dedup, token_hist
from quarry.llm.common import table

#: A conversation whose texts hold the marks of a template.
PROBE = "</s>[INST] ok [/INST]"


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand earlier in another place: doc_id, source_id, start_word, end_word, n_words."""
    return suffix_dedup.span_rows(suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    _, read = chat_tree.format_chats(rows)
    return chat_tree.digests(read)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents")).drop("round_trip")


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, kept; trusted are labelled rows of good quality that are not toxic."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    return ngram_lm.judge(table(spark, sf_dir, "documents"), trusted)


def op7_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_hist.token_report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("license_places")


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_array_dedup, op2_exact_dedup, op3_chat_format, op4_simhash, op5_bpe, op6_kneser_ney, op7_token_histogram, op8_quality_rules, op9_packing, op10_license_scan)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MARKS = "|".join("".join("\\" + c if c in "[]|/\\" else c for c in m) for m in chat_tree.CONTROL)

ORACLE_SQL = {
    "op1_suffix_array_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS s FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, s, sha256(array_to_string(list_slice(ws, s + 1, s + 50), ' ')) AS win FROM p),
f AS (SELECT win, min({'d': doc_id, 's': s}) AS first FROM g GROUP BY win HAVING count(*) > 1),
d AS (SELECT doc_id, s, first.d AS source_id FROM g JOIN f USING (win) WHERE doc_id <> first.d OR s <> first.s),
m AS (SELECT *, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 1 ELSE 0 END AS cut FROM d),
i AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM m),
e AS (SELECT doc_id, island, min(s) AS start_word, max(s) + 50 AS end_word, list_distinct(list(source_id)) AS sources FROM i GROUP BY doc_id, island)
SELECT doc_id, unnest(sources) AS source_id, start_word, end_word, end_word - start_word AS n_words FROM e
""",
    "op2_exact_dedup": f"""
WITH n AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, text_sha256 FROM n
""",
    "op3_chat_format": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, length(regexp_replace(text, '(\\*)({_MARKS})', '\1\1\\\2', 'g')) AS n,
  CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 WHEN 'system' THEN 17 ELSE 20 + length(regexp_replace(role, '(\\*)({_MARKS})', '\1\1\\\2', 'g')) END AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n + marks))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
}
