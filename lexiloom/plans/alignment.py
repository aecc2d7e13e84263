"""Alignment of documents with an ontology made of the benchmark's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import alignment as A
from lexiloom.operators import questions as Q
from lexiloom.operators import rdf as R
from lexiloom.plans.questions import NORMAL
from lexiloom.plans.registry import query, table

_STOP = "(" + ", ".join(f"'{w}'" for w in sorted(T.LEXICON_STOPWORDS)) + ")"
WORD = "[\\p{{L}}\\p{{N}}_]+".replace("{{", "{").replace("}}", "}")
#: Each passage of the benchmark names a class by two words, an object property by the next two and a data
#: property by one.
NAMES = f"""b AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark), s AS (SELECT 'ex#Item_' || item_id AS iri, 'class' AS kind, w[1] || ' ' || w[2] AS said FROM b WHERE len(w) > 4
 UNION ALL SELECT 'ex#rel' || item_id, 'object_property', w[3] || ' ' || w[4] FROM b WHERE len(w) > 4 UNION ALL SELECT 'ex#val' || item_id, 'data_property', w[5] FROM b WHERE len(w) > 4),
n0 AS (SELECT iri, kind, lower(string_split(iri, '#')[2]) AS text FROM s UNION SELECT iri, kind, said FROM s), n1 AS (SELECT * FROM n0 UNION SELECT iri, kind, regexp_replace(text, '[_\\-]+', ' ', 'g') FROM n0),
n AS (SELECT *, regexp_extract_all(text, '{WORD}') AS tokens FROM n1), m AS (SELECT *, list_filter(tokens, lambda t: t NOT IN {_STOP} AND length(t) > 2) AS f FROM n)"""
SEEN = f"""q AS (SELECT doc_id AS id, text, regexp_extract_all({NORMAL.format(x="coalesce(text, '')")}, '{WORD}') AS w FROM documents),
h AS (SELECT DISTINCT id, iri, kind FROM q JOIN m ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(tokens, ' ') || ' ') OR (len(f) >= 2 AND list_has_all(w, f)) OR (len(f) = 1 AND length(f[1]) >= 5 AND list_contains(w, f[1])) WHERE len(tokens) > 0)"""
_INTENTS = " ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN '{k}' END," for k, p in sorted(Q.INTENTS.items())).rstrip(",")
GROUNDED = f"""i AS (SELECT doc_id AS id, list_filter([{_INTENTS}], lambda y: y IS NOT NULL) AS intents FROM (SELECT doc_id, {NORMAL.format(x="coalesce(text, '')")} AS x FROM documents)),
g AS (SELECT i.id, any_value(intents) AS intents, count(h.iri) FILTER (h.kind = 'class') AS nc, count(h.iri) FILTER (h.kind <> 'class') AS np FROM i LEFT JOIN h ON h.id = i.id GROUP BY i.id),
v AS (SELECT *, nc + np > 0 AS grounded, list_filter(intents, lambda x: x <> 'numeric' AND np = 0) AS lacks FROM g)"""


def names(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", T.word_tokens(F.lower("text")).alias("w")).where("size(w) > 4")
    w = lambda *k: F.array_join(F.array(*[F.get("w", F.lit(i)) for i in k]), " ")
    out = []
    for prefix, kind, said in (("ex#Item_", "owl:Class", w(0, 1)), ("ex#rel", R.OBJECT_PROPERTY, w(2, 3)), ("ex#val", R.DATA_PROPERTY, w(4))):
        iri = F.concat(F.lit(prefix), F.col("item_id").cast("string"))
        out += [b.select(iri.alias("s"), F.lit(R.TYPE).alias("p"), F.lit(kind).alias("o"), F.lit(False).alias("literal")), b.select(iri.alias("s"), F.lit(R.LABEL).alias("p"), said.alias("o"), F.lit(True).alias("literal"))]
    return A.lexicon(R.statements(*out))


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {NAMES}, {SEEN} SELECT id, iri, kind FROM h")
def alignment_mentions(spark, sf_dir):
    return A.mentions(_questions(spark, sf_dir), names(spark, sf_dir))


@query(f"WITH {NAMES}, {SEEN}, {GROUNDED} SELECT id, nc AS n_classes, np AS n_properties, grounded, array_to_string(lacks, ',') AS unsupported, grounded AND len(lacks) = 0 AS supported FROM v")
def alignment_grounding(spark, sf_dir):
    rows = A.grounding(_questions(spark, sf_dir), names(spark, sf_dir))
    return rows.select("id", F.size("classes").cast("long").alias("n_classes"), F.size("properties").cast("long").alias("n_properties"), "grounded", F.array_join("unsupported", ",").alias("unsupported"), "supported")


@query(
    f"""WITH {NAMES}, {SEEN}, {GROUNDED}, c AS (SELECT iri, any_value(kind) AS kind, count(*) AS c FROM h GROUP BY iri), t AS (SELECT count(*) AS n FROM v), k AS (SELECT DISTINCT iri, kind FROM n),
e AS (SELECT -sum(c / (SELECT sum(c) FROM c) * ln(c / (SELECT sum(c) FROM c))) AS h, count(*) AS k FROM c)
SELECT round(count(*) FILTER (grounded) / any_value(n), 6) AS grounded_ratio, round(sum(nc + np) / any_value(n), 6) AS avg_entities, round(count(*) FILTER (grounded AND len(lacks) = 0) / any_value(n), 6) AS answerable_ratio,
 count(*) FILTER (list_contains(lacks, 'causal')) AS unsupported_causal, count(*) FILTER (list_contains(lacks, 'comparative')) AS unsupported_comparative, count(*) FILTER (list_contains(lacks, 'numeric')) AS unsupported_numeric,
 count(*) FILTER (list_contains(lacks, 'temporal')) AS unsupported_temporal, round((SELECT count(*) FROM c WHERE kind = 'class') / (SELECT count(*) FROM k WHERE kind = 'class'), 6) AS classes_covered,
 round((SELECT count(*) FROM c WHERE kind <> 'class') / (SELECT count(*) FROM k WHERE kind <> 'class'), 6) AS properties_covered, round((SELECT h FROM e), 6) AS coverage_entropy, round((SELECT h / ln(k) FROM e), 6) AS coverage_entropy_norm FROM v, t"""
)
def alignment_summary(spark, sf_dir):
    known = names(spark, sf_dir)
    return A.summary(A.grounding(_questions(spark, sf_dir), known), known)


@query(
    f"""WITH {NAMES}, {SEEN}, k AS (SELECT DISTINCT iri, CASE WHEN kind = 'class' THEN 'class' ELSE 'property' END AS kind FROM n WHERE iri NOT IN (SELECT iri FROM h))
SELECT kind, iri FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY iri) <= 20"""
)
def alignment_uncovered(spark, sf_dir):
    known = names(spark, sf_dir)
    return A.examples(A.grounding(_questions(spark, sf_dir), known), known)
