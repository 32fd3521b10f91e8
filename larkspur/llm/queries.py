"""The registered queries over these operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attribution import attribute_tokens, document_sections
from .chat import digest, format_conversations, linear_messages
from .decontaminate import decontaminate
from .lines import repeated_lines
from .lmscore import score_texts
from .media import describe_media, encode_texts
from .nearcopies import near_copies
from .packing import pack
from .quality import classify_quality
from .runtime import stored, table
from .substrings import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: A conversation that says the control strings of another template.
PROBE = "</s>[INST] ok [/INST]"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    formatted = stored(format_conversations(linear_messages(rows.unionByName(probe))))
    return digest(formatted).withColumnRenamed("tree", "conv_id")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = describe_media(encode_texts(table(spark, sf_dir, "documents")))
    return described.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_ms", F.size("keyframes").cast("long").alias("n_keyframes"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = attribute_tokens(document_sections(table(spark, sf_dir, "documents")))
    return counted.select("doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_decontaminate, op2_substrings, op3_chat, op4_lm_score, op5_lines, op6_media, op7_pack, op8_token_counts, op9_quality, op10_near_copies)}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

ORACLES: dict[str, str] = {
    "op3_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(~*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1~\2\3', 'g') AS body,
         regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '([<\[])(~*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1~\2\3', 'g') AS name
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + length(name) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op1_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents)
), bw AS (
  SELECT item_id, ws FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)
  WHERE len(ws) > 0
), win AS (
  SELECT DISTINCT item_id, array_to_string(ws[i : i + least(8, len(ws)) - 1], ' ') AS s, least(8, len(ws)) AS k
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 7))) AS i FROM bw)
), ks AS (SELECT DISTINCT k FROM win), dg AS (
  SELECT doc_id, p, k, string_agg(w, ' ') OVER (PARTITION BY doc_id, k ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS s8, n
  FROM dw CROSS JOIN ks WHERE k = 8
), dgs AS (
  SELECT doc_id, p, k, s8 AS s FROM dg WHERE p + k - 1 <= n
  UNION ALL
  SELECT a.doc_id, a.p, ks.k, (SELECT string_agg(b.w, ' ' ORDER BY b.p) FROM dw b WHERE b.doc_id = a.doc_id AND b.p BETWEEN a.p AND a.p + ks.k - 1)
  FROM dw a JOIN ks ON ks.k < 8 AND a.p + ks.k - 1 <= a.n
), occ AS (SELECT doc_id, p, dgs.k, item_id FROM dgs JOIN win USING (s, k)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id),
cnt AS (SELECT doc_id, count(*) AS n_words FROM dw GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM documents d LEFT JOIN cnt USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op5_lines": r"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k, len(ls) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), stripped AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS st FROM lines
), numbered AS (
  SELECT *, CAST(sum(CASE WHEN st <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS i FROM stripped
), own AS (SELECT doc_id, i, st FROM numbered WHERE st <> ''),
units AS (
  SELECT doc_id, i, 2 AS w, st || chr(10) || lead(st) OVER (PARTITION BY doc_id ORDER BY i) AS unit FROM own
  UNION ALL SELECT doc_id, i, 1, st FROM own WHERE len(regexp_extract_all(st, '[^\x09-\x0D\x20]+')) >= 50
), later AS (
  SELECT doc_id, i, w FROM (SELECT *, row_number() OVER (PARTITION BY w, unit ORDER BY doc_id, i) AS r FROM units WHERE unit IS NOT NULL) WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i FROM later UNION ALL SELECT doc_id, i + 1 FROM later WHERE w = 2)),
pieces AS (
  SELECT a.doc_id, a.k, a.st <> '' AS solid, g.i IS NOT NULL AS here, a.st <> '' AND g.i IS NOT NULL AND p.i IS NULL AS begins,
         CASE WHEN a.st = '' THEN CASE WHEN g.i IS NOT NULL AND q.i IS NOT NULL THEN '' ELSE a.line || CASE WHEN a.k < a.n THEN chr(10) ELSE '' END END
              WHEN g.i IS NULL THEN a.line || CASE WHEN a.k < a.n THEN chr(10) ELSE '' END
              WHEN p.i IS NULL THEN substr(a.line, 1, length(a.line) - length(ltrim(a.line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))))
              ELSE '' END AS piece
  FROM numbered a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.i = a.i LEFT JOIN gone p ON p.doc_id = a.doc_id AND p.i = a.i - 1 LEFT JOIN gone q ON q.doc_id = a.doc_id AND q.i = a.i + 1
)
SELECT doc_id, CAST(sum(CASE WHEN solid THEN 1 ELSE 0 END) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN solid AND here THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       CAST(sum(CASE WHEN begins THEN 1 ELSE 0 END) AS BIGINT) AS n_runs, sha256(string_agg(piece, '' ORDER BY k)) AS kept_sha256
FROM pieces GROUP BY doc_id
""",
}
