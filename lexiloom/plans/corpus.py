"""Queries over the document corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import corpus as C
from lexiloom.operators.graph import cut_lineage
from lexiloom.plans.registry import query, table


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


#: The clean-up of text in DuckDB.
CLEAN = (
    "regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(173), ''), '[‐‒–—−]', '-', 'g'),"
    " '([\\p{{L}}\\p{{N}}_]+)-\\s+([\\p{{L}}\\p{{N}}_]+)', '\\1\\2', 'g'), '\\s*\\n\\s*', ' ', 'g'), chr(0), ' '),"
    " 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', ' ', 'g')"
)
RAW = f"""raw AS (SELECT doc_id, unnest(regexp_extract_all({CLEAN.format(x="lower(text)")}, '[a-z][a-z\\-]{{1,}}')) AS t0,
  generate_subscripts(regexp_extract_all({CLEAN.format(x="lower(text)")}, '[a-z][a-z\\-]{{1,}}'), 1) AS pos FROM documents),
stripped AS (SELECT doc_id, pos, trim(t0, '-') AS token FROM raw),
words AS (SELECT * FROM stripped WHERE length(token) >= 2 AND token NOT IN {_list(T.STOPWORDS)})"""
KEPT = RAW + f""",
kept AS (SELECT * FROM words WHERE token NOT IN {_list(T.BIBLIOGRAPHY)} AND (length(token) >= 3 OR token IN {_list(T.KEEP_SHORT)}))"""


@query(f"""WITH {KEPT} SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM kept GROUP BY token ORDER BY tf DESC, token LIMIT 50""")
def vocab_top_terms(spark, sf_dir):
    return C.term_statistics(C.tokenized(table(spark, sf_dir, "documents"))).orderBy(F.desc("tf"), "token").limit(50)


@query(
    f"""WITH {KEPT},
sized AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id HAVING count(*) >= 20),
mine AS (SELECT k.*, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM kept k WHERE doc_id IN (SELECT doc_id FROM sized)),
tf AS (SELECT token, count(*) AS c FROM mine GROUP BY token),
l AS (SELECT list_sort(list(n)) AS v, count(*) AS k FROM sized)
SELECT k AS documents, (SELECT count(*) FROM documents) AS documents_total, (SELECT count(*) FROM mine) AS total_tokens,
 (SELECT count(*) FROM tf) AS unique_tokens, round((SELECT count(*) FILTER (c = 1) / count(*) FROM tf), 6) AS hapax_share,
 v[1] AS len_min, v[k // 2 + 1] AS len_median, v[CAST(floor(0.95 * (k - 1)) AS INT) + 1] AS len_p95, v[CAST(floor(0.99 * (k - 1)) AS INT) + 1] AS len_p99,
 (SELECT count(DISTINCT token || '_' || nxt) FROM mine WHERE nxt IS NOT NULL) AS unique_bigrams FROM l"""
)
def vocab_stats_row(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = cut_lineage(C.tokenized(docs).where(F.size("tokens") >= 20))  # read three times
    terms = C.term_statistics(kept).agg(
        F.sum("tf").alias("total_tokens"), F.count(F.lit(1)).alias("unique_tokens"), F.round(F.count_if(F.col("tf") == 1) / F.count(F.lit(1)), 6).alias("hapax_share")
    )
    bigrams = kept.select(F.explode(T.ngrams(F.col("tokens"), 2)).alias("b")).distinct().agg(F.count(F.lit(1)).alias("unique_bigrams"))
    sizes = kept.select(F.size("tokens").cast("long").alias("n"))
    # one-row frames side by side
    out = sizes.agg(F.count(F.lit(1)).alias("documents")).crossJoin(docs.agg(F.count(F.lit(1)).alias("documents_total")))
    return out.crossJoin(terms).crossJoin(C.rank_statistics(sizes, "n")).crossJoin(bigrams)


@query(
    f"""WITH {RAW}, d AS (SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM words GROUP BY token),
b AS (SELECT * FROM d WHERE df >= 2 AND tf >= 2 AND df <= 0.7 * (SELECT count(*) FROM documents) ORDER BY tf DESC, token LIMIT 50000),
r AS (SELECT CASE WHEN token LIKE '%-' THEN 'trailing_hyphen' WHEN token IN {_list(T.BIBLIOGRAPHY)} THEN 'biblio_stoplist'
 WHEN token IN {_list(T.FRAGMENTS)} THEN 'fragment_suffix' WHEN length(token) < 3 AND token NOT IN {_list(T.KEEP_SHORT)} THEN 'too_short' ELSE 'kept' END AS reason FROM b)
SELECT reason, count(*) AS n FROM r GROUP BY reason"""
)
def dictionary_filter_reasons(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    terms = C.term_statistics(docs.select("doc_id", T.once(T.topic_tokens(F.col("text"))).alias("tokens")))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    bounded = terms.crossJoin(F.broadcast(n)).where("df >= 2 and tf >= 2 and df <= 0.7 * n_docs").orderBy(F.desc("tf"), "token").limit(50_000)
    return bounded.groupBy(F.coalesce(C.filter_reason(F.col("token")), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {KEPT}, g AS (SELECT doc_id, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM kept)
SELECT token || '_' || nxt AS bigram, count(*) AS n FROM g WHERE nxt IS NOT NULL GROUP BY 1 ORDER BY n DESC, bigram LIMIT 50"""
)
def bigram_counts(spark, sf_dir):
    grams = C.tokenized(table(spark, sf_dir, "documents")).select(F.explode(T.ngrams(F.col("tokens"), 2)).alias("bigram"))
    return grams.groupBy("bigram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bigram").limit(50)


@query(
    """WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, 0 AS i, text AS c FROM w WHERE len(w) <= 512
 UNION ALL SELECT doc_id, CAST(i AS INT), array_to_string(w[i * 462 + 1 : i * 462 + 512], ' ') FROM w, range((len(w) + 461) // 462) t(i) WHERE len(w) > 512)
SELECT doc_id, CAST(i AS INT) AS chunk_index, md5(c) AS chunk_md5, length(c) AS n_chars FROM s"""
)
def word_chunks(spark, sf_dir):
    chunks = C.word_chunks(table(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"), F.length("chunk").cast("long").alias("n_chars"))


@query(
    """WITH s AS (SELECT doc_id, i, i * 700 AS a, least(i * 700 + 1000, length(text)) AS z, trim(substr(text, i * 700 + 1, 1000), ' ' || chr(10) || chr(9) || chr(13)) AS c
 FROM documents, range(greatest(0, CAST(ceil((length(text) - 1000) / 700.0) AS BIGINT)) + 1) t(i)),
m AS (SELECT *, max(CASE WHEN length(c) < 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS cut FROM s)
SELECT doc_id, CAST(i AS INT) AS chunk_index, CAST(a AS INT) AS start_char, CAST(z AS INT) AS end_char, md5(c) AS chunk_md5 FROM m WHERE cut = 0"""
)
def char_chunks(spark, sf_dir):
    chunks = C.char_chunks(table(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "chunk_index", "start_char", "end_char", F.md5("chunk").alias("chunk_md5"))


@query(f"SELECT doc_id, md5({CLEAN.format(x='text')}) AS clean_md5 FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("clean_md5"))


@query("SELECT * FROM (VALUES (1, 'autoencoder and well-known pretrained'), (2, 'state-of-the-art'), (3, 'a b')) t(id, fixed)")
def fix_hyphenation(spark, sf_dir):
    rows = [(1, "auto- encoder and well-known pre-\ntrained"), (2, "state–of—the‐art"), (3, "a\n b­")]
    return spark.createDataFrame(rows, "id int, x string").select("id", T.fix_hyphenation(F.col("x")).alias("fixed"))


@query(
    """SELECT doc_id, length(regexp_replace(text, '\\P{L}', '', 'g')) AS letters, text = '' OR length(regexp_replace(text, '\\P{L}', '', 'g')) / greatest(length(text), 1) < 0.75 AS noise
FROM documents"""
)
def ocr_noise_flags(spark, sf_dir):
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.regexp_replace(x, r"\P{L}", "")).cast("long").alias("letters"), T.is_ocr_noise(x, 0.75).alias("noise"))


@query("SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"), "doc_id")
    return keyed.groupBy("text_md5").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(
    """WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY text)
SELECT CAST(sum(n - 1) AS BIGINT) AS excess, count(*) FILTER (n > 1) AS groups, round(count(*) / sum(n), 6) AS unique_ratio FROM g"""
)
def duplicate_summary(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum(F.col("n") - 1).alias("excess"), F.count_if(F.col("n") > 1).alias("groups"), F.round(F.count(F.lit(1)) / F.sum("n"), 6).alias("unique_ratio"))


@query(
    """SELECT d.doc_id, coalesce(source, '') AS source, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def metadata_left_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    fill = lambda c: F.coalesce(F.col(c), F.lit(-1)).alias(c)
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), fill("quality"), fill("toxic"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT source FROM documents EXCEPT SELECT d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND l.quality = 0")
def uncovered_items(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("toxic = 1 and quality = 0")
    return docs.select("source").distinct().join(docs.join(labels, "doc_id").select("source").distinct(), "source", "left_anti")


@query(
    f"""WITH {KEPT}, c AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS body FROM kept GROUP BY doc_id HAVING count(*) >= 20)
SELECT doc_id, md5('doc_' || doc_id || ' |text ' || body) AS line_md5 FROM c"""
)
def vw_lines(spark, sf_dir):
    kept = C.tokenized(table(spark, sf_dir, "documents")).where(F.size("tokens") >= 20)
    line = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(" |text "), F.array_join(F.transform("tokens", T.vw_token), " "))
    return kept.select("doc_id", F.md5(line).alias("line_md5"))


@query(
    """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)
SELECT doc_id, CAST(page AS INT) AS page, CAST(coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM p"""
)
def page_offsets(spark, sf_dir):
    """Running start of each line, as of pages joined by two characters."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    above = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("doc_id", (F.col("p") + 1).alias("page"), F.coalesce(F.sum((F.length("line") + 2).cast("long")).over(above), F.lit(0)).alias("start_char"))
