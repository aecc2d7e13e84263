"""Queries over tables and captions of papers that are made of orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import layout as L
from lexiloom.operators import tables as X
from lexiloom.plans.registry import query, table

#: Header lines by the order's number: one line of names, a line a name, and names of three lines each; and rows of one line or of three.
HEADERS = [["Item Quantity Line"], ["Ordered", "Place"], ["Ordered", "amount", "net", "Place", "in", "order"]]
NAMES = ["item|quantity|line", "|ordered|place", "|ordered_amount_net|place_in_order"]
PROSE = "The order was placed by a customer who asked for all of these parts at once and without any delay or further notice"


def paper_lines(spark, sf_dir):
    """Lines (``doc``, ``n``, ``line``): prose, a blank line, the header, a row per line of the order, the caption and more prose."""
    line = table(spark, sf_dir, "lineitem")
    rank = F.row_number().over(L.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    cells = [F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")]
    stacked = F.array(*cells)
    rows = line.select(F.col("l_orderkey").alias("doc"), (10 * rank + 100).alias("n"), F.when(F.col("l_orderkey") % 2 == 0, F.array(F.concat_ws(" ", *cells))).otherwise(stacked).alias("x"))
    order = line.select(F.col("l_orderkey").alias("doc")).distinct()
    head = F.array(*[F.array(*map(F.lit, h)) for h in HEADERS])
    top = order.select("doc", F.lit(0).alias("n"), F.concat(F.array(F.lit(PROSE), F.lit(PROSE), F.lit("")), F.get(head, (F.col("doc") % 3).cast("int"))).alias("x"))
    caption = F.concat(F.lit("Table "), F.lit("1: Lines of order "), F.col("doc").cast("string"))
    end = order.select("doc", F.lit(1_000_000).alias("n"), F.array(caption, F.lit(PROSE)).alias("x"))
    every = rows.unionByName(top).unionByName(end)
    return every.select("doc", "n", F.posexplode("x").alias("k", "line")).select("doc", (10 * F.col("n") + F.col("k")).alias("n"), "line")


@query(
    f"""SELECT l_orderkey AS doc, 'Table 1: Lines of order ' || l_orderkey AS caption, ['{NAMES[0]}', '{NAMES[1]}', '{NAMES[2]}'][l_orderkey % 3 + 1] AS columns,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, 'p' || l_partkey || '|' || l_quantity::INT || '|' || l_linenumber AS cells
FROM lineitem"""
)
def tables_from_lines(spark, sf_dir):
    found = X.tables(paper_lines(spark, sf_dir))
    rows = found.select("doc", "caption", F.array_join("columns", "|").alias("columns"), F.posexplode("rows").alias("i", "row"))
    return rows.select("doc", "caption", "columns", (F.col("i") + 1).alias("i"), F.array_join("row", "|").alias("cells"))


#: Blocks of a customer's page from the orders: every third one is a caption; heights and places leave gaps, touch and overlap.
BLOCKS = """o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, sum(CASE WHEN o_orderkey % 7 = 0 THEN 130 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS far FROM orders),
b AS (SELECT o_custkey AS page, o_orderkey AS block, o_orderkey % 4 * 100 AS x0, o_orderkey % 4 * 100 + 150 AS x1, 60 * i + far AS y0, 60 * i + far + 20 + o_orderkey % 5 * 10 AS y1,
CASE WHEN i % 3 = 1 THEN 'Table ' || i || ': Orders of ' || o_custkey WHEN o_orderkey % 11 = 0 THEN 'a | 1 22 333 4444' WHEN o_orderkey % 11 = 1 THEN NULL ELSE 'note ' || o_orderkey % 97 END AS text FROM o)"""


def page_blocks(spark, sf_dir):
    page = L.Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("i", F.row_number().over(page)).withColumn("far", F.sum(F.when(F.col("o_orderkey") % 7 == 0, 130).otherwise(0)).over(page))
    key, y = F.col("o_orderkey"), 60 * F.col("i") + F.col("far")
    said = lambda *x: F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in x])
    text = F.when(F.col("i") % 3 == 1, said("Table ", F.col("i").cast("string"), ": Orders of ", F.col("o_custkey").cast("string")))
    text = text.when(key % 11 == 0, "a | 1 22 333 4444").when(key % 11 != 1, said("note ", (key % 97).cast("string")))
    return o.select(F.col("o_custkey").alias("page"), key.alias("block"), (key % 4 * 100).alias("x0"), (key % 4 * 100 + 150).alias("x1"), y.alias("y0"), (y + 20 + key % 5 * 10).alias("y1"), text.alias("text"))


@query(
    f"""WITH RECURSIVE {BLOCKS}, c AS (SELECT * FROM b WHERE text LIKE 'Table %'),
h AS (SELECT c.page, c.block, b.y0, b.y1, coalesce(b.text, '') AS text, b.x1 >= c.x0 AND b.x0 <= c.x1 AS over, row_number() OVER (PARTITION BY c.page, c.block ORDER BY b.y0, b.x0, b.block) AS k
 FROM c JOIN b ON b.page = c.page AND b.y0 - c.y1 > 0 AND b.y0 - c.y1 <= 200),
f(page, block, k, bottom, done, text, n) AS (SELECT page, block, 0::BIGINT, y1, false, text, 0 FROM c
 UNION ALL SELECT page, block, k, CASE WHEN taken THEN y1 ELSE bottom END, stop, CASE WHEN taken THEN was || ' ' || text ELSE was END, n + taken::INT
 FROM (SELECT *, NOT stop AND over AND text <> '' AS taken FROM (SELECT f.page, f.block, h.k, f.bottom, h.y1, f.text AS was, h.text, h.over, f.n, f.done OR h.y0 - f.bottom > 100 OR h.text LIKE 'Table %' OR (h.over AND h.text LIKE 'a |%') AS stop
 FROM f JOIN h ON h.page = f.page AND h.block = f.block AND h.k = f.k + 1)))
SELECT page, block, max_by(text, k) AS caption, max_by(n, k) AS n FROM f GROUP BY page, block"""
)
def continued_captions(spark, sf_dir):
    return X.continued_captions(page_blocks(spark, sf_dir))
