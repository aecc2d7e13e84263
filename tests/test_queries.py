"""Every registered query of the library against its DuckDB SQL, and sources and streams."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiloom.plans import catalogue
from lexiloom.sources import files
from lexiloom.streaming import windows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def canon(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "None"
        return f"{float(v):.5f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    columns = ", ".join(f'"{n}"' for n in names)
    assert canon(map(tuple, got.select(*names).collect())) == canon(want.select(columns).fetchall())


def test_model_queries_have_rows(spark):
    assert catalogue.queries()["kmeans_clusters"](spark, SF).count() > 0
    assert catalogue.queries()["lda_topics"](spark, SF).count() == 40


def test_entry_imports_without_the_llm_part(tmp_path):
    """In a copy of the repository without the two folders and the pipeline."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "lexiloom"), tmp_path / "lexiloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op1') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q); print(e.__file__)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0 and str(tmp_path) in done.stdout, done.stderr


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1012.2599v1 a.txt").write_text("x\ny")
    assert files.whole_texts(spark, str(tmp_path / "t")).collect()[0][1:] == ("10122599v1_a", "x\ny")
    (tmp_path / "q.jsonl").write_text('{"cq": "What?", "cq_id": " "}\nnot json\n{"question": "Why?", "id": "7"}\n')
    rows = files.json_lines(spark, str(tmp_path / "q.jsonl"), "cq string, question string, id string, cq_id string", "drop")
    got = {r["text"]: r["id"] for r in files.question_records(rows).collect()}
    assert got["Why?"] == "7" and got["What?"].startswith("cq_")
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "q.jsonl"), "cq string").collect()


def test_references_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 'A "title", here', "2020", ["u1", "u2"]), ("r2", None, "nan", None)], "ref_id string, title string, year string, additional_urls array<string>")
    files.write_references(rows, str(tmp_path / "r"))
    got = {r["ref_id"]: r for r in files.references(spark, str(tmp_path / "r")).collect()}
    assert got["r1"]["title"] == 'A "title", here' and got["r1"]["year"] == 2020 and got["r1"]["additional_urls"] == ["u1", "u2"]
    assert got["r2"]["title"] is None and got["r2"]["year"] is None and got["r2"]["additional_urls"] is None


def test_n_triples_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("http://a/1", "http://p", "http://b/2", "iri"), ("_:x", "http://p", 'say "hi"', "literal")], "s string, p string, o string, o_kind string")
    files.write_n_triples(rows, str(tmp_path / "n"))
    got = files.n_triples(spark, str(tmp_path / "n"))
    assert got.where("o_kind = 'iri'").collect()[0][:3] == ("http://a/1", "http://p", "http://b/2")
    assert got.where("o_kind = 'literal'").count() == 1


def test_n_triples_keep_their_values(spark, tmp_path):
    odd = ['say "hi"', "back\\slash", "two\nlines", "\\n is no line end", "ends in \\", "tab\tand \r", "é漢😀", "", "it's", '\\"']
    rows = [("_:x", "http://p", o, "literal", d, lang) for o in odd for d, lang in ((None, None), ("http://t", None), (None, "en-GB"))] + [("http://a/1", "http://p", "http://b/2", "iri", None, None)]
    files.write_n_triples(spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string, o_lang string"), str(tmp_path / "n"))
    assert {tuple(r) for r in files.n_triples(spark, str(tmp_path / "n")).collect()} == set(rows)
    (tmp_path / "m.nt").write_text("# c\n\n<a> <b> 'x' .\n<a> <b> \"\\u00e9\\'\\U0000006e\" . # end\n_:a <b> _:c .\n")
    with pytest.raises(Exception, match="no N-Triples line"):
        files.n_triples(spark, str(tmp_path / "m.nt")).collect()
    assert {r["o"] for r in files.n_triples(spark, str(tmp_path / "m.nt"), "drop").collect()} == {"é'n", "_:c"}


def test_append_new_resumes(spark, tmp_path):
    rows = spark.range(5).withColumnRenamed("id", "k")
    files.append_new(rows.where("k < 3"), str(tmp_path / "o"), "k", None)
    files.append_new(rows, str(tmp_path / "o"), "k", spark.read.json(str(tmp_path / "o")))
    assert sorted(r["k"] for r in spark.read.json(str(tmp_path / "o")).collect()) == [0, 1, 2, 3, 4]


def test_stream_takes_each_event_once(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    batch.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = windows.unique_events(windows.read(spark, str(tmp_path / "in"), schema), late="3650 days")
    windows.run_once(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
