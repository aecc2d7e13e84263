"""Alignment of questions with an ontology's names.

Null and empty texts have no tokens and are grounded in nothing; repeated rows count each, since
questions go by their id; an ontology without names grounds nothing; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.similarity import entropy_term
from lexiloom.operators import questions as Q
from lexiloom.operators import rdf as R


def filtered(tokens: Column) -> Column:
    """Tokens that carry a name's meaning."""
    return F.filter(tokens, lambda t: ~t.isin(*T.LEXICON_STOPWORDS) & (F.length(t) > 2))


def lexicon(graph: DataFrame) -> DataFrame:
    """``iri``, ``kind`` (class, object_property, data_property), ``text`` and ``tokens``: normalized local
    names, labels, preferred labels and comments, and those with ``_`` and ``-`` taken apart."""
    kind = F.when(F.col("o").isin(*R.CLASS_TYPES), "class").when(F.col("o") == R.OBJECT_PROPERTY, "object_property").when(F.col("o") == R.DATA_PROPERTY, "data_property")
    kinds = graph.where(F.col("p") == R.TYPE).select(F.col("s").alias("iri"), kind.alias("kind")).where("kind is not null").groupBy("iri").agg(F.min("kind").alias("kind"))
    said = graph.where(F.col("p").isin(R.LABEL, R.PREFERRED, R.COMMENT)).select(F.col("s").alias("iri"), F.col("o").alias("text"))
    surfaces = kinds.select("iri", "kind", T.local_name(F.col("iri")).alias("text")).unionByName(kinds.join(said, "iri"))
    plain = surfaces.withColumn("text", T.normalize_cq(F.col("text")))
    apart = F.explode(F.array_distinct(F.array(F.col("text"), T.normalize_cq(T.split_camel(F.col("text"))))))
    return plain.select("iri", "kind", apart.alias("text")).where("text <> ''").distinct().withColumn("tokens", T.word_tokens(F.col("text")))


def mentions(questions: DataFrame, names: DataFrame) -> DataFrame:
    """``id``, ``iri``, ``kind``: names that a question mentions: as a run of tokens, or by all of two or more
    meaningful tokens, or by a single one of five letters or more.

    Every way needs one certain token in the question, the longest of the name (the longest meaningful
    one for the last two), so an equi-join on it finds the candidates of a question; they come back
    to its text once and the rule is checked there.
    """
    q = questions.select("id", T.word_tokens(T.normalize_cq(F.coalesce("text", F.lit("")))).alias("w"))
    longest = lambda a: F.get(F.array_sort(a, lambda x, y: F.coalesce(F.nullif(F.length(y) - F.length(x), F.lit(0)), F.when(x < y, -1).when(x > y, 1).otherwise(0))), F.lit(0))
    n = names.where("size(tokens) > 0").select("iri", "kind", "tokens", filtered(F.col("tokens")).alias("f"))
    any_of = (F.size("f") >= 2) | ((F.size("f") == 1) & (F.length(F.get("f", F.lit(0))) >= 5))
    inside = lambda words: F.concat(F.lit(" "), words, F.lit(" "))
    keyed = n.select(
        F.struct("iri", "kind", inside(F.array_join("tokens", " ")).alias("run"), F.when(any_of, F.transform("f", inside)).alias("f")).alias("name"),
        F.explode(F.array_distinct(F.array_compact(F.array(longest(F.col("tokens")), F.when(any_of, longest(F.col("f"))))))).alias("key"),
    )
    seen = q.select("id", F.explode(F.array_distinct("w")).alias("key"))
    wanted = seen.join(keyed, "key").groupBy("id").agg(F.collect_set("name").alias("found"))
    pairs = q.select("id", inside(F.array_join("w", " ")).alias("said")).join(wanted, "id")
    true = F.filter("found", lambda c: F.contains(F.col("said"), c["run"]) | F.coalesce(F.forall(c["f"], lambda t: F.contains(F.col("said"), t)), F.lit(False)))
    return pairs.select("id", F.explode(true).alias("c")).select("id", "c.iri", "c.kind").distinct()


def grounding(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Per question: ``id``, sorted ``classes`` and ``properties``, ``grounded``, ``intents`` and ``supported``
    (grounded, with a data property in the ontology for numbers, and a property mentioned for the other
    intents)."""
    found = mentions(questions, names).groupBy("id").agg(
        F.sort_array(F.collect_set(F.when(F.col("kind") == "class", F.col("iri")))).alias("classes"), F.sort_array(F.collect_set(F.when(F.col("kind") != "class", F.col("iri")))).alias("properties")
    )
    none = F.array().cast("array<string>")
    rows = questions.select("id", "text").join(found, "id", "left").join(names.agg(F.count_if(F.col("kind") == "data_property").alias("n_data")))
    rows = rows.select("id", F.coalesce("classes", none).alias("classes"), F.coalesce("properties", none).alias("properties"), Q.intents(T.normalize_cq(F.coalesce("text", F.lit("")))).alias("intents"), "n_data")
    grounded = (F.size("classes") > 0) | (F.size("properties") > 0)
    lacks = unsupported()
    return rows.select("id", "classes", "properties", grounded.alias("grounded"), "intents", lacks.alias("unsupported"), (grounded & (F.size(lacks) == 0)).alias("supported"))


def unsupported() -> Column:
    """Intents that the ontology can't serve."""
    return F.filter("intents", lambda x: F.when(x == "numeric", F.col("n_data") == 0).otherwise(F.size("properties") == 0))


def summary(rows: DataFrame, names: DataFrame) -> DataFrame:
    """One row of ``grounding``: ratios, coverage of the ontology's names, entropy of mentions and unserved
    intents."""
    total = F.count(F.lit(1))
    main = rows.agg(
        F.round(F.count_if("grounded") / total, 6).alias("grounded_ratio"), F.round(F.sum(F.size("classes") + F.size("properties")) / total, 6).alias("avg_entities"),
        F.round(F.count_if("supported") / total, 6).alias("answerable_ratio"), *[F.count_if(F.array_contains("unsupported", k)).alias(f"unsupported_{k}") for k in sorted(Q.INTENTS)],
    )
    said = rows.select(F.explode(F.concat("classes", "properties")).alias("iri")).groupBy("iri").agg(F.count(F.lit(1)).alias("c"))
    shares = said.crossJoin(said.agg(F.sum("c").alias("n"))).agg(F.coalesce(F.sum(entropy_term(F.col("c") / F.col("n"))), F.lit(0.0)).alias("h"), F.count(F.lit(1)).alias("k"))
    norm = F.when(F.col("k") > 1, F.col("h") / F.log(F.col("k").cast("double"))).otherwise(F.lit(0.0))
    known = names.select("iri", (F.col("kind") == "class").alias("is_class")).distinct().join(said, "iri", "left")
    ratio = lambda own: F.coalesce(F.round(F.count_if(own & F.col("c").isNotNull()) / F.nullif(F.count_if(own), F.lit(0)), 6), F.lit(0.0))
    covered = known.agg(ratio(F.col("is_class")).alias("classes_covered"), ratio(~F.col("is_class")).alias("properties_covered"))
    return main.crossJoin(covered).crossJoin(shares.select(F.round("h", 6).alias("coverage_entropy"), F.round(norm, 6).alias("coverage_entropy_norm")))


def examples(rows: DataFrame, names: DataFrame, most: int = 20) -> DataFrame:
    """``kind``, ``iri`` of names that no question mentions, the first ``most`` of each kind in order."""
    said = rows.select(F.explode(F.concat("classes", "properties")).alias("iri")).distinct()
    left = names.select("iri", F.when(F.col("kind") == "class", "class").otherwise("property").alias("kind")).distinct().join(said, "iri", "left_anti")
    first = left.groupBy("kind").agg(F.slice(F.array_sort(F.collect_list("iri")), 1, most).alias("iris"))  # names of one ontology
    return first.select("kind", F.explode("iris").alias("iri"))
