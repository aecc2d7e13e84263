"""From local topics to clusters and canonical topics; questions to a provider; reports.

Nulls count as empty texts; repeated rows stay; ties are ordered by the columns named; an empty table gives
an empty one, or one row of zeros where one row is promised; further columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.graph import written

ARTICLE = ("article_id", "article_title", "section_id", "section_heading")
TOPIC = ("local_topic_id", "title", "description", "text_span")


def exploded_topics(records: DataFrame) -> DataFrame:
    """One row per topic of records (``record``, article columns, ``topics``: array of structs), missing texts
    empty, with ``place`` in its record."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = records.select("record", *[text(c).alias(c) for c in ARTICLE], F.posexplode("topics").alias("place", "t"))
    return rows.select("record", "place", *ARTICLE, *[text(f"t.{c}").alias(c) for c in TOPIC])


def topic_text(title: Column, description: Column) -> Column:
    """``title. description``, or the one of them that isn't blank."""
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.concat_ws(". ", some(title), some(description))


def clusters(topics: DataFrame) -> DataFrame:
    """``cluster_id`` (``CLUSTER_0000`` on, by label), ``size`` and ``indices`` (rising) of labelled topics (``index``,
    ``label``); noise, label -1 or null, is one row each without an id."""
    named = topics.where("label >= 0")
    number = named.select("label").distinct().withColumn("n", F.row_number().over(Window.orderBy("label")) - 1)  # labels are few
    grouped = named.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("index")).alias("indices")).join(F.broadcast(number), "label")
    own = grouped.select(F.concat(F.lit("CLUSTER_"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("cluster_id"), "size", "indices", F.lit(False).alias("is_noise"))
    noise = topics.where("label is null or label < 0").select(F.lit(None).cast("string").alias("cluster_id"), F.lit(1).cast("long").alias("size"), F.array("index").alias("indices"), F.lit(True).alias("is_noise"))
    return own.unionByName(noise)


def first_sources(topics: DataFrame, key: str = "label", order: str = "index") -> DataFrame:
    """Of each cluster the distinct (``article_id``, ``section_id``) in order of first appearance: ``place``, and the rest of
    the article's columns as first seen."""
    first = F.row_number().over(Window.partitionBy(key, "article_id", "section_id").orderBy(order))
    once = topics.withColumn("_f", first).where("_f = 1")
    return once.select(key, *ARTICLE, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("place"))


def usable_sources(sources: DataFrame) -> DataFrame:
    """Sources with trimmed ids, but those without an article."""
    rows = sources.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("article_id", "section_id")})
    return rows.where("article_id <> ''")


def batches(rows: DataFrame, size: int = 20, order: str = "index") -> DataFrame:
    """``batch``, ``items``: rows in runs of ``size`` by their order. Rows are numbered per range of the order and the ranges
    by their sums, so no task holds more than its range. The ranges are written down, as two readings may cut them differently."""
    spread = written(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    counts = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("_p", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # a row per partition
    place = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    numbered = spread.withColumn("_i", place).join(F.broadcast(before), "_p").withColumn("_i", F.col("_i") + F.col("b"))
    item = F.struct("_i", *rows.columns)
    return numbered.groupBy(F.floor(F.col("_i") / size).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(*[s[c].alias(c) for c in rows.columns])).alias("items"))


def ask(rows: DataFrame, provider: Callable[[str], str], payload: str = "payload", tries: int = 3, wait: float = 0.0, reason: str | None = None) -> DataFrame:
    """``rows`` with ``answer``: the provider's JSON for each payload, null if ``tries`` attempts fail. Between attempts it waits ``wait``
    seconds, twice as long each time; ``reason`` names a column for the last error of rows without an answer.

    The provider is any function of one JSON text; without a network a deterministic stub stands for it.
    """

    def run(frames):
        for pdf in frames:
            out, errors = [], []
            for x in pdf[payload]:
                answer = error = None
                for turn in range(tries):
                    try:
                        answer, error = provider(x), None
                        break
                    except Exception as e:  # a provider may fail in any way; the next attempt may not
                        error = f"{type(e).__name__}: {e}"
                        if turn + 1 < tries:
                            time.sleep(wait * 2**turn)
                out.append(answer)
                errors.append(error)
            more = {"answer": out} | ({reason: errors} if reason else {})
            yield pdf.assign(**{c: pd.Series(v, index=pdf.index, dtype=object) for c, v in more.items()})

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInPandas(run, ", ".join([*schema, "answer string", *([f"`{reason}` string"] if reason else [])]))


def payload(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def matched_answers(answers: DataFrame, topics: DataFrame, key: str = "local_topic_id") -> DataFrame:
    """Answered items (``answer``: JSON list of ids and names) joined back to the topics they name; ids that
    no topic has are dropped, an item that keeps no topic too."""
    item = "array<struct<id:string,title:string,keep:boolean>>"
    rows = answers.select(F.explode(F.from_json("answer", item)).alias("a")).where("a.id is not null and coalesce(a.keep, true)")
    return rows.select(F.col("a.id").alias(key), F.col("a.title").alias("canonical")).join(topics, key)


def modality_weights(x: Column) -> Column:
    """Map of weights from ``2:1:0.5``: text, bigrams, trigrams; one weight or none is text's alone."""
    parts = F.transform(F.split(x, ":"), lambda p: F.trim(p).cast("double"))
    names = F.array(F.lit("text"), F.lit("bigrams"), F.lit("trigrams"))
    return F.when(F.coalesce(F.trim(x), F.lit("")) == "", F.create_map(F.lit("text"), F.lit(1.0))).otherwise(F.map_from_arrays(F.slice(names, 1, F.size(parts)), parts))


def finite(x: Column) -> Column:
    """A number that JSON can hold; NaN and infinities are missing."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def bootstrap(docs: DataFrame, share: float, seed: int, key: str = "doc_id") -> DataFrame:
    """A sample with replacement: every row as often as a Poisson variable of mean ``share`` says, drawn from a
    hash of key and seed, so it is the same whatever the partitions. The reference draws a fixed number; the
    size here is that number on average."""
    u = (F.xxhash64(F.col(key), F.lit(seed)).bitwiseAND(F.lit(2**52 - 1)) / float(2**52)).cast("double")
    below, term, total = F.lit(0), pow(2.718281828459045, -share), 0.0
    for k in range(12):
        total += term
        below = below + (u >= F.lit(total)).cast("int")
        term *= share / (k + 1)
    return docs.withColumn("_k", below).where("_k > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1), "_k")).alias("draw"))


def diverse(chunks: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` chunks (``chunk``, ``paper``, ``start``) whose paper or start hasn't been seen before, in order."""
    paper = F.row_number().over(Window.partitionBy("paper").orderBy("chunk"))
    start = F.row_number().over(Window.partitionBy("start").orderBy("chunk"))
    return chunks.withColumns({"_p": paper, "_s": start}).where("_p = 1 or _s = 1").orderBy("chunk").limit(most).drop("_p", "_s")


def capped_lists(rows: DataFrame, key: str, value: str, most: int = 10) -> DataFrame:
    """``key``, ``examples``: the first ``most`` values of each key. Only these are gathered, not the whole group."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(value))
    return rows.withColumn("_n", place).where(F.col("_n") <= most).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), " ").alias("examples"))


def file_order(name: Column) -> Column:
    """The number before the first hyphen of a file's name, 999999 without one."""
    return F.coalesce(F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "-")[0].try_cast("int"), F.lit(999999))


def last_by_key(rows: DataFrame, order: str) -> DataFrame:
    """``pid`` and the last row's ``title``, ``year``, ``venue`` of reference rows: by ``ref_id``, else by the name of the PDF
    without its ending; rows with neither are left out."""
    stem = F.regexp_replace(F.substring_index(F.coalesce(F.col("pdf_url"), F.lit("")), "/", -1), r"\.[^.]*$", "")
    pid = F.coalesce(F.nullif("ref_id", F.lit("")), F.nullif(stem, F.lit("")))
    return rows.withColumn("pid", pid).where("pid is not null").groupBy("pid").agg(F.max_by(F.struct("title", "year", "venue"), order).alias("r")).select("pid", "r.*")


def log_errors(logs: DataFrame, most: int = 10) -> DataFrame:
    """``kind``, ``n``: the most frequent error and warning types of log rows (``level``, ``kind``)."""
    return logs.where(F.col("level").isin("error", "warning")).groupBy("level", "kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "level", "kind").limit(most)


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``bucket`` (1 on; 0 and bins + 1 for what lies outside), ``n``; missing values are left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def papers(document: Column) -> Column:
    """Papers of a survey document; an error if it has no list of them, or one lacks a title."""
    listed = F.from_json(document, "papers array<struct<id:string,title:string,year:int>>")["papers"]
    checked = F.when(F.exists(listed, lambda p: F.coalesce(F.trim(p["title"]), F.lit("")) == ""), F.raise_error(F.lit("a paper lacks its title"))).otherwise(listed)
    return F.when(listed.isNull(), F.raise_error(F.lit("no list of papers"))).otherwise(checked)


def filled_patterns(patterns: DataFrame, entities: DataFrame) -> DataFrame:
    """``pattern``, ``question``: patterns (``pattern``, ``text`` with one ``[slot]``, ``entity_list``) with each entity of their list
    (``entity_list``, ``entity``) in the slot."""
    return patterns.join(entities, "entity_list").select("pattern", F.regexp_replace("text", r"\[[^\]]*\]", F.col("entity")).alias("question"))
