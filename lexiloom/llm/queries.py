"""One query per training-data operator, over its whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, tune


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    pieces = packing.pack(read_table(tune(spark), sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fingerprints

    return fingerprints.with_edited(read_table(tune(spark), sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    lines = line_dedup.dedup(read_table(tune(spark), sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the matrices to the shared folder and gives one row per sequence from reading them."""
    from . import token_output
    from .common import scratch_dir

    target = scratch_dir(tune(spark))
    token_output.write(read_table(spark, sf_dir, "documents"), target, tokenizer("word_bpe_49k.json"))
    rows = spark.read.parquet(target)
    return rows.select(
        "part", "shard", "row", "n_tokens", F.size("doc_ids").alias("n_segments"), F.crc32("ids").alias("ids_crc32"),
        F.crc32("position_ids").alias("positions_crc32"), "cu_seqlens", "doc_ids", "starts",
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm_scoring

    return lm_scoring.score(read_table(tune(spark), sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_classifier

    return quality_classifier.score(read_table(tune(spark), sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    verdicts = quality_rules.judge(read_table(tune(spark), sf_dir, "documents"))
    return verdicts.withColumn("host_rate", F.round("host_rate", 6))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.groups(read_table(tune(spark), sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.encode(read_table(tune(spark), sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.score(read_table(tune(spark), sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import conversations as c

    rows = c.digests(c.repair(c.damaged(read_table(tune(spark), sf_dir, "conversations"))))
    return rows.drop("n_rows")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    rows = pii.find(read_table(tune(spark), sf_dir, "documents"))
    counts = [pii.number_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    every = pii.joined(F.concat("base", "added")).alias("spans")
    return rows.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), every, F.size("added").cast("long").alias("n_added"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexical_search

    return lexical_search.search(read_table(tune(spark), sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


ORACLES = {
    "op13_lexical_search": r"""
WITH d AS (SELECT doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM d WHERE t <> '' GROUP BY doc_id), g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
p AS (SELECT doc_id, t, count(*) AS tf FROM d WHERE t <> '' AND t IN (SELECT t FROM i) GROUP BY doc_id, t),
f AS (SELECT t, floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score FROM i JOIN p ON p.t = i.t JOIN f ON f.t = p.t JOIN n USING (doc_id), g GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50""",
    "op11_conversation_repair": r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform(range(0, 8), lambda b: (ascii(k[i]) >> b::INTEGER) & 1)))),
  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 20 AS kind FROM t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS two FROM n),
f AS (SELECT *, bare = '' AS blank, again AND bare <> '' AS dup, NOT again AND bare <> '' AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM m),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
  count(*) FILTER (cut) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS last FROM f GROUP BY conv_id),
v(conv_id, k, s0, s1, s2, s3) AS (SELECT conv_id, 0::BIGINT, {c: 0, a: '', r: ''}, {c: 1000000000, a: '', r: ''}, {c: 2, a: 'I', r: 'user:'}, {c: 4, a: 'II', r: 'user:' || chr(10) || 'assistant:'} FROM s
UNION ALL SELECT conv_id, k, n0, n1, least(y2, {c: y3.c + 2, a: y3.a || 'I', r: y3.r || chr(10) || 'user:'}), y3 FROM (
  SELECT *, least(n3, {c: y2.c + 2, a: y2.a || 'I', r: y2.r || chr(10) || 'assistant:'}) AS y3 FROM (
  SELECT *, least(n2, {c: n0.c + 2, a: n0.a || 'I', r: 'user:'}, {c: n1.c + 2, a: n1.a || 'I', r: n1.r || chr(10) || 'user:'}, {c: n3.c + 2, a: n3.a || 'I', r: n3.r || chr(10) || 'user:'}) AS y2 FROM (
  SELECT v.conv_id, f.k, {c: s0.c + 3, a: s0.a || 'D', r: ''} AS n0,
    least({c: s1.c + 3, a: s1.a || 'D', r: s1.r}, {c: s0.c + stay + CASE i WHEN 's' THEN 0 ELSE 1000000000 END, a: s0.a || 'K', r: role || ':' || text}) AS n1,
    least({c: s2.c + 3, a: s2.a || 'D', r: s2.r}, {c: s0.c + stay + asked, a: s0.a || edit, r: said}, {c: s1.c + stay + asked, a: s1.a || edit, r: s1.r || chr(10) || said}, {c: s3.c + stay + asked, a: s3.a || edit, r: s3.r || chr(10) || said}) AS n2,
    least({c: s3.c + 3, a: s3.a || 'D', r: s3.r}, {c: s2.c + stay + CASE i WHEN 'a' THEN 0 ELSE 2 END, a: s2.a || CASE i WHEN 'a' THEN 'K' ELSE 'R' END, r: s2.r || chr(10) || CASE i WHEN 'a' THEN role ELSE 'assistant' END || ':' || text}) AS n3
  FROM v JOIN (SELECT *, CASE WHEN blank OR dup THEN 1000000000 WHEN cut THEN 1 ELSE 0 END AS stay, CASE i WHEN 'u' THEN 0 ELSE 2 END AS asked,
    CASE i WHEN 'u' THEN 'K' ELSE 'R' END AS edit, CASE i WHEN 'u' THEN role ELSE 'user' END || ':' || text AS said FROM f) f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.k = v.k + 1)))),
e AS (SELECT s.*, least(s0, s3) AS b FROM s JOIN v ON v.conv_id IS NOT DISTINCT FROM s.conv_id AND v.k = s.last)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.r, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op7_quality_rules": r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) u(i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM r WHERE c > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f GROUP BY source),
m AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v, avg(1.0 / n) AS inv FROM h),
s AS (SELECT m, least(1e6, greatest(1.0, m * (1 - m) / greatest(1e-9, v - m * (1 - m) * inv) - 1)) AS s FROM m),
j AS (SELECT source, n, (k + m * s) / (n + s) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate,
  NOT base_failed AND NOT (f.source IS NOT NULL AND rate >= 0.75 AND n >= 20) AS kept FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source""",
    "op8_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) u(i) UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(node, m) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.node)
SELECT r.node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.m) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
