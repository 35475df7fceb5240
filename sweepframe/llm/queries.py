"""The operators applied to the shared tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sweepframe.llm import bpe, conversations, exact, lines, mixing, pii, quality, secrets, simhash, substrings
from sweepframe.llm import token_counts, warc, whitening
from sweepframe.session import scratch_path

#: Folder of the public vocabulary files; its ``path(name)`` is used if importable.
TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str) -> str:
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_repeated_substrings(spark: SparkSession, sf: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf, "documents"), texts=False)
    return found.withColumnRenamed("kept", "kept_sha256")


def op2_quality_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(quality.ledger(table(spark, sf, "documents")))


def op3_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.assigned(table(spark, sf, "documents")).drop("digest")


def op4_simhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.groups(table(spark, sf, "documents"))


def op5_exact_groups(spark: SparkSession, sf: str) -> DataFrame:
    return exact.groups(table(spark, sf, "documents"))


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.counted(
        table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096
    )


def op7_warc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    kind = pages.schema["page_id"].dataType
    found = warc.read(warc.write(pages, scratch_path(spark, "warc")), payloads=False)
    return found.select(
        found.page.cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        found.refers_to.cast(kind).alias("refers_to"),
    )


def op8_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = lines.without_repeats(table(spark, sf, "documents"), texts=False)
    return found.withColumnRenamed("kept", "kept_sha256")


def op10_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digests(table(spark, sf, "documents"))


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    found = conversations.digests(conversations.damaged(table(spark, sf, "conversations")))
    return found.withColumnRenamed("conv", "conv_id")


def op12_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digests(table(spark, sf, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(table(spark, sf, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_repeated_substrings,
        op2_quality_ledger,
        op3_source_mix,
        op4_simhash_groups,
        op5_exact_groups,
        op6_token_counts,
        op7_warc_round_trip,
        op8_bpe_round_trip,
        op9_repeated_lines,
        op10_personal_data,
        op11_conversation_repair,
        op12_secret_scan,
        op13_embedding_whitening,
    )
}

WORD = r"[^\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {}

ORACLE["op1_repeated_substrings"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS num, doc_id,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents
),
wins AS (
  SELECT r, num, i, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT r, num, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
),
again AS (
  SELECT r, i FROM wins QUALIFY min(num) OVER (PARTITION BY win) < num
),
gone AS (
  SELECT DISTINCT r, i + k AS p FROM again, (SELECT unnest(range(13)) AS k)
),
each_word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM each_word ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

ORACLE["op2_quality_ledger"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents
),
lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
),
line_counts AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY r
),
wins AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
),
again AS (
  SELECT r, i FROM wins
  QUALIFY count(*) OVER (PARTITION BY r, win) > 1
),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM again, (SELECT unnest(range(8)) AS k) GROUP BY r
),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN line_counts USING (r) LEFT JOIN covered USING (r)
)
SELECT *,
  ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
   + 4 * (10 * n_symbols > n_words)::BIGINT
   + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT
   + 16 * (word_chars < 2 * n_words)::BIGINT
   + 32 * (word_chars > 25 * n_words)::BIGINT) AS fail_bits,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
       OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
       OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM m
"""

ORACLE["op3_source_mix"] = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k
  FROM documents
),
s AS (
  SELECT k, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
         1 + (row_number() OVER (ORDER BY k) - 1) % 3 AS weight
  FROM d GROUP BY k
),
o AS (
  SELECT *, sum(source_size) OVER ()
           - coalesce(sum(most) OVER (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY most / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM s
),
f AS (SELECT *, most::DOUBLE * free <= rest::DOUBLE * weight AS is_full FROM o),
e AS (
  SELECT (sum(source_size) - coalesce(sum(most) FILTER (is_full), 0))::DOUBLE AS rest,
         sum(weight) FILTER (NOT is_full)::DOUBLE AS free
  FROM f
),
t AS (
  SELECT k, source_size,
         CASE WHEN is_full THEN most::DOUBLE ELSE e.rest * weight / e.free END AS target
  FROM f, e
),
p AS (
  SELECT d.*, source_size, target, floor(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY k ORDER BY md5('42:' || coalesce(doc_id::VARCHAR, 'null')), doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t USING (k)
)
SELECT doc_id, source, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size
                 + least(greatest(budget % source_size - before, 0), size) END::BIGINT AS taken
FROM p
"""

ORACLE["op5_exact_groups"] = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

ORACLE["op7_warc_round_trip"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hex, (k // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""

ORACLE["op9_repeated_lines"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS num,
         string_split(coalesce(text, ''), chr(10)) AS t
  FROM documents
),
every_line AS (SELECT r, num, unnest(t) AS line, unnest(range(1, len(t) + 1)) AS i FROM d),
spoken AS (
  SELECT r, num, line, i, row_number() OVER (PARTITION BY r ORDER BY i) AS pos
  FROM every_line WHERE regexp_matches(line, '{WORD}')
),
spoken_words AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS n FROM spoken),
wins AS (
  SELECT r, num, pos, line AS l1, lead(line) OVER w AS l2, lead(line, 2) OVER w AS l3, n AS n1,
         n + lead(n) OVER w AS n2
  FROM spoken_words WINDOW w AS (PARTITION BY r ORDER BY pos)
),
-- windows that count: three lines, or one or two with 25 words
sized AS (
  SELECT r, num, pos, 1 AS size, l1, NULL AS l2, NULL AS l3 FROM wins WHERE n1 >= 25
  UNION ALL
  SELECT r, num, pos, 2, l1, l2, NULL FROM wins WHERE n2 >= 25
  UNION ALL
  SELECT r, num, pos, 3, l1, l2, l3 FROM wins WHERE l3 IS NOT NULL
),
again AS (
  SELECT r, pos, size FROM sized
  QUALIFY min((num, pos)) OVER (PARTITION BY size, l1, l2, l3) < (num, pos)
),
gone AS (
  SELECT DISTINCT r, i FROM (SELECT r, pos + unnest(range(size)) AS pos FROM again) JOIN spoken USING (r, pos)
),
kept AS (
  SELECT r, string_agg(line, chr(10) ORDER BY i) AS kept FROM every_line ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, (SELECT count(*) FROM spoken WHERE spoken.r = d.r) AS n_lines,
       (SELECT count(*) FROM gone WHERE gone.r = d.r) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
