"""Tables out of lines, and captions that go on: rules, odd cases."""

from lexiloom.operators import tables as X

PROSE = "Words of a text that goes on and on without any number so that nobody takes it for a table at all, ever, anywhere."


def test_blocks_end_where_a_table_begins():
    rows = ["head a b", "r1 1 2", "r2 3 4", "r3 5 6", "r4 7 8"]
    assert X.block_before([PROSE, *rows]) == rows and X.block_before(["x 1 2", "", "", *rows]) == rows
    assert X.block_before(["Figure 3: y", *rows]) == rows and X.block_before(["Table 1: y", "z", *rows]) == ["z", *rows]
    assert X.block_before([PROSE, "", *rows]) == rows and X.block_before(["up 1 2", "", *rows]) == ["up 1 2", *rows]
    assert X.block_before([]) == []


def test_headers():
    assert X.header_names(["A B C"], 3) == ["A", "B", "C"] and X.header_names(["A B"], 3) == ["", "A", "B"]
    assert X.header_names(["Middle Eastern East Asian"], 3) == ["", "Middle Eastern", "East Asian"]
    assert X.header_names(["a b c d"], 3) == ["a", "b", "c d"] and X.header_names(["a"], 3) == ["", "a", "col2"]
    assert X.header_names(["a", "b", "c", "d", "e"], 3) == ["", "a b c", "d e"] and X.header_names(["a", "b", "c", "d"], 3) == ["a", "b", "c d"]
    assert X.header_names([], 2) == ["", "col1"] and X.header_names(["a", "b"], 2) == ["a", "b"]
    assert X.column_names(["x", "y", "y"], 3, "Table 2. Top-1 accuracy") == ["x", "y_top1", "y_top1_2"]


def test_parse():
    assert X.parse(["m v w", "a", "1", "2", "b c", "3", "4"], "t") == (["m", "v", "w"], [["a", "1", "2"], ["b c", "3", "4"]])
    assert X.parse(["m v w", "a 1 2 b 3 4", "c 5"], "t")[1] == [["a", "1", "2"], ["b", "3", "4"], ["c", "5"]]
    assert X.parse(["a  b", "c  d  e"], "t") == (["col1", "col2", "col3"], [["a", "b", ""], ["c", "d", "e"]])
    assert X.parse(["no table"], "t") == (["col1"], [["no table"]]) and X.parse([], "t") == (["col1"], [[""]])
    assert X.parse(["h", "a", "1%", "2 ± 0.1", "b", "-3", "+4"], "t")[1][0] == ["a", "1%", "2 ± 0.1"]


def test_documents_of_many_lines_and_odd_ones(spark):
    lines = [("d", i, f"r{i} {i} 2", 1) for i in range(3000)] + [("d", 3000, "Table II: many", 1), ("e", 1, None, 1), ("e", 2, "Table 3 x", 1), (None, 1, "Table 4 y", 1), ("f", 1, "a 1 2", 1)]
    got = {r["doc"]: r for r in X.tables(spark.createDataFrame(lines, "doc string, n long, line string, caption int")).collect()}
    assert set(got) == {"d", "e"} and len(got["d"]["rows"]) == 220 and got["d"]["rows"][-1] == ["r2999", "2999", "2"]
    assert got["e"]["rows"] == [[""]] and got["e"]["n"] == 2
    assert X.tables(spark.createDataFrame([], "doc string, n long, line string")).count() == 0


def test_captions_go_on(spark):
    kind = "page int, block int, x0 double, y0 double, x1 double, y1 double, text string, at int, hits string"
    rows = [
        (1, 1, 0.0, 0.0, 100.0, 10.0, "Table 1: Accuracy of", 0, ""), (1, 2, 100.0, 20.0, 200.0, 30.0, "all models", 0, ""),  # touches
        (1, 3, 201.0, 40.0, 300.0, 50.0, "beside it", 0, ""), (1, 4, 0.0, 110.0, 50.0, 120.0, "in percent.", 0, ""),
        (1, 5, 0.0, 205.0, 50.0, 210.0, "within a gap", 0, ""), (1, 6, 0.0, 209.0, 50.0, 215.0, "last one", 0, ""), (1, 7, 0.0, 230.0, 50.0, 240.0, "out of two gaps", 0, ""),
        (2, 1, 0.0, 0.0, 100.0, 10.0, "Table 2. A", 0, ""), (2, 2, 0.0, 111.0, 100.0, 120.0, "too far", 0, ""),
        (3, 1, 0.0, 0.0, 100.0, 10.0, "table iv x", 0, ""), (3, 2, 0.0, 20.0, 100.0, 30.0, "1-2 3-4 5-6", 0, ""), (3, 3, 0.0, 40.0, 9.0, 50.0, "behind data", 0, ""),
        (4, 1, 0.0, 0.0, 100.0, 10.0, "Table 3: y", 0, ""), (4, 2, 300.0, 20.0, 400.0, 30.0, "Table 4: z", 0, ""), (4, 3, 0.0, 40.0, 9.0, 50.0, "whose", 0, ""),
        (5, 1, None, None, None, None, "Table 5: nowhere", 0, ""), (5, 2, 0.0, 1.0, 2.0, 3.0, None, 0, ""), (None, 1, 0.0, 0.0, 1.0, 1.0, "Table 6: no page", 0, ""),
        (6, 1, 0.0, 0.0, 100.0, 10.0, "Table 7: One. We " + "accuracy " * 14, 0, ""),
    ]
    got = {(r["page"], r["block"]): (r["caption"], r["n"]) for r in X.continued_captions(spark.createDataFrame(rows, kind)).collect()}
    assert got[1, 1] == ("Table 1: Accuracy of all models in percent. within a gap last one", 4)
    assert got[2, 1] == ("Table 2. A", 0) and got[3, 1] == ("table iv x", 0) and got[4, 1] == ("Table 3: y", 0) and got[4, 2] == ("Table 4: z", 0)
    assert got[5, 1] == ("Table 5: nowhere", 0) and got[6, 1] == ("Table 7: One.", 0) and got[None, 1] == ("Table 6: no page", 0)
    assert X.continued_captions(spark.createDataFrame([], kind)).count() == 0
