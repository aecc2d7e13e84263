"""File sources and sinks: text, JSON lines, CSV, manifests, N-Triples, partitions by folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import clean_str

#: Columns of the reference table and of the metrics table.
REFERENCE_SCHEMA = (
    "ref_id string, ref_number string, title string, year int, doi string, arxiv_id string, venue string, "
    "first_author string, authors string, article_url string, pdf_url string, additional_urls string"
)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``file_name``, ``doc_id`` (name without characters that ids may not have) and ``text``."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    rows = spark.read.text(path, wholetext=True).select(name.alias("file_name"), F.col("value").alias("text"))
    stem = F.regexp_replace(F.regexp_replace("file_name", r"\.[^.]*$", ""), " ", "_")
    safe = F.regexp_replace(stem, r"[^\p{L}\p{N}_\-]", "")
    return rows.select("file_name", F.when(safe == "", "doc").otherwise(safe).alias("doc_id"), "text")


def json_lines(spark: SparkSession, path: str, schema: str, bad: str = "raise") -> DataFrame:
    """JSON lines under a schema. Bad lines: ``raise``, ``drop``, or ``keep`` in ``_bad``."""
    mode = {"raise": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad]
    reader = spark.read.schema(schema + (", _bad string" if bad == "keep" else "")).option("mode", mode)
    if bad == "keep":
        reader = reader.option("columnNameOfCorruptRecord", "_bad")
    return reader.json(path)


def question_records(rows: DataFrame) -> DataFrame:
    """``id`` and ``text`` by the first alias that is there; a missing id is a hash of the text."""
    have = lambda names: [F.col(n).cast("string") for n in names if n in rows.columns]
    none = F.lit(None).cast("string")
    text = F.coalesce(*have(("cq", "question", "text")), none)
    ids = F.coalesce(*[F.when(F.trim(c) != "", c) for c in have(("id", "cq_id"))], none)
    return rows.select(F.coalesce(ids, F.concat(F.lit("cq_"), F.left(F.sha1(text), F.lit(12)))).alias("id"), text.alias("text"))


def references(spark: SparkSession, path: str) -> DataFrame:
    """The enriched reference table; missing values are null, links an array."""
    rows = spark.read.option("header", True).option("escape", "\\").csv(path)
    clean = rows.select(*[clean_str(F.col(c)).alias(c) for c in rows.columns])
    out = clean.withColumn("additional_urls", F.from_json("additional_urls", "array<string>"))
    return out.withColumn("year", F.expr("try_cast(left(year, 4) as int)"))


def write_references(rows: DataFrame, path: str) -> None:
    """All fields quoted, missing ones empty, arrays as JSON."""
    arrays = [f.name for f in rows.schema.fields if f.dataType.typeName() == "array"]
    flat = rows.select(*[(F.to_json(c) if c in arrays else F.col(c).cast("string")).alias(c) for c in rows.columns])
    flat.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", "\\").option("nullValue", "").csv(path)


def by_suffix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Datasets that name both their id and their graph."""
    rows = spark.read.option("header", True).csv(path)
    return rows.where("coalesce(trim(dataset_id), '') <> '' and coalesce(trim(kg_path), '') <> ''")


def with_dataset(rows: DataFrame, depth: int = 2) -> DataFrame:
    """``dataset``: the name of the folder ``depth`` levels above the file."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.select("*", F.element_at(parts, -depth).alias("dataset"))


def _term(x: Column) -> Column:
    return F.when(x.startswith("<"), "iri").when(x.startswith("_:"), "blank").otherwise("literal")


def unescaped(x: Column) -> Column:
    """The characters of a literal between its quotes. JSON knows all escapes but those of the apostrophe and of eight digits, which are
    rewritten first; null where an escape is none (or stands for a character past the basic plane by eight digits)."""
    plain = F.regexp_replace(x, r"(?<!\\)((?:\\\\)*)\\'", "$1'")
    short = F.regexp_replace(plain, r"(?<!\\)((?:\\\\)*)\\U0000([0-9A-Fa-f]{4})", r"$1\\u$2")
    read = F.from_json(F.concat(F.lit('{"x":"'), short, F.lit('"}')), "x string", {"allowUnquotedControlChars": "true"})
    return F.when(x.contains("\\"), read["x"]).otherwise(x)


def n_triples(spark: SparkSession, path: str, bad: str = "raise") -> DataFrame:
    """``s``, ``p``, ``o``, ``o_kind``, ``o_datatype``, ``o_lang`` of N-Triples lines. Blank lines and comments are skipped; another line that
    is no triple ends the read with an error that shows it, or goes with ``bad="drop"``."""
    if bad not in ("raise", "drop"):
        raise ValueError("bad must be 'raise' or 'drop'")
    line = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:[^\s.]\S*?|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.regexp_extract("value", line, i)
    raw = rows.select("value", part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    after = lambda mark: F.nullif(F.regexp_extract("o", rf'^"(?:[^"\\]|\\.)*"{mark}$', 1), F.lit(""))
    literal = unescaped(F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1))
    value = F.when(F.col("o").startswith('"'), literal).otherwise(bare("o"))
    told = raw.withColumns({"x": value, "o_kind": _term(F.col("o")), "o_datatype": after(r"\^\^<([^>]*)>"), "o_lang": after("@([A-Za-z0-9-]+)")})
    wrong = (F.col("s") == "") | F.col("x").isNull()
    if bad == "drop":
        told = told.where(~wrong)
    else:
        told = told.withColumn("s", F.when(wrong, F.raise_error(F.concat(F.lit("no N-Triples line: "), "value"))).otherwise(F.col("s")))
    return told.select(bare("s").alias("s"), bare("p").alias("p"), F.col("x").alias("o"), "o_kind", "o_datatype", "o_lang")


def write_n_triples(triples: DataFrame, path: str) -> None:
    """Triples (``s``, ``p``, ``o``, ``o_kind``; optional ``o_datatype``, ``o_lang``) as lines that read back as the same values."""
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    text = F.col("o")
    for plain, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(escape))
    kind = F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">")) if "o_datatype" in triples.columns else F.lit(None)
    lang = F.concat(F.lit("@"), F.col("o_lang")) if "o_lang" in triples.columns else F.lit(None)
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), text, F.lit('"'), F.coalesce(lang, kind, F.lit("")))).otherwise(node("o"))
    triples.select(F.concat_ws(" ", node("s"), F.concat(F.lit("<"), F.col("p"), F.lit(">")), o, F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def stoplist(spark: SparkSession, path: str) -> DataFrame:
    token = F.lower(F.trim("value"))
    return spark.read.text(path).select(token.alias("token")).where("token <> '' and not startswith(token, '#')").distinct()


def append_new(rows: DataFrame, path: str, key: str, done: DataFrame | None) -> None:
    """Append the rows whose key isn't in ``done``: how an interrupted run goes on."""
    todo = rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")
    todo.write.mode("append").json(path)


def numbered_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped, and a bad one raises an error with its file and number. Each
    file is read as a whole to number its lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where("trim(line) <> ''")
    good = F.col("line").rlike(r"^\s*\{") & F.try_parse_json("line").isNotNull()
    told = F.raise_error(F.concat(F.lit("bad line "), (F.col("n") + 1).cast("string"), F.lit(" of "), F.col("f")))
    checked = whole.select(F.when(good, F.col("line")).otherwise(told.cast("string")).alias("line"))
    return checked.select(F.from_json("line", schema).alias("r")).select("r.*")


def write_lines(rows: DataFrame, path: str) -> None:
    """One text column as lines: Vowpal Wabbit and the like."""
    rows.write.mode("overwrite").text(path)


def write_metrics(rows: DataFrame, path: str, columns: list[str], ranked_path: str | None = None, order=None) -> None:
    """A table of metrics as CSV in a fixed order of columns, and in the order given as a second file. There is a
    row for each data set, so one file holds them."""
    fixed = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])
    fixed.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    if ranked_path is not None:
        order(rows).select(*[c for c in columns if c in rows.columns]).coalesce(1).write.mode("overwrite").option("header", True).csv(ranked_path)


def write_document(row: DataFrame, path: str) -> None:
    """A row of metrics as one JSON document; numbers that JSON can't hold are missing."""
    clean = [F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in row.schema.fields]
    row.select(*clean).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_table(rows: DataFrame, path: str) -> str:
    """Parquet or, where a column's type or name isn't allowed there, CSV; gives the format."""
    from pyspark.errors import AnalysisException

    try:
        rows.write.mode("overwrite").parquet(path)
        return "parquet"
    except AnalysisException:
        rows.select(*[F.col(f"`{c}`").cast("string") for c in rows.columns]).write.mode("overwrite").option("header", True).csv(path)
        return "csv"


def write_by_dataset(rows: DataFrame, path: str, key: str = "dataset") -> None:
    """The vector store's tables: Parquet in a folder for each data set, which a rerun replaces alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
