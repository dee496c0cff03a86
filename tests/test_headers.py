"""Headers of several rows, numbered independents and folded positions by golden rows."""

from pyspark.sql import functions as F

from tabloom.operators import headers


def test_header_rows_are_combined(spark):
    rows = [
        ("a", 0, ["SL. NO.", "Polling Station", "No. of valid votes cast in favour of", "", "", "Total"]),
        ("a", 1, ["", "", "RAMAN", "KUMAR (X)", "LONE", None]),
        ("a", 2, ["PARTY ABBREVIATION", "", "DMK", "", "", ""]),
        ("b", 0, ["A", "", "valid votes"]),
        ("c", 0, ["A", "B", "", ""]), ("c", 1, ["a1", "", " "]),
        ("d", 0, ["Party", "x"]), ("d", 1, ["z", "KUMAR (BJP)", "y"]), ("d", 2, ["w", "v", None, "u"]),
    ]
    df = spark.createDataFrame(rows, "table_id string, row_idx int, cells array<string>")
    got = {}
    for r in headers.combine_header_rows(df).orderBy("table_id", "col_idx").collect():
        got.setdefault(r["table_id"], []).append(r["header"])
    assert got == {"a": ["SL. NO.", "Polling Station", "DMK", "KUMAR (X)", "LONE", "Total"], "b": ["A", "", "valid votes"], "c": ["a1", "B", "Column 3", "Column 4"], "d": ["w", "x", "y", "u"]}


def test_candidates_above_the_party_row(spark):
    rows = [("a", 0, ["No", "No. of votes", "top"]), ("a", 1, ["x", "KUMAR (BJP)", "RAMAN"]), ("a", 2, ["Party", "", "DMK"])]
    got = headers.combine_header_rows(spark.createDataFrame(rows, "table_id string, row_idx int, cells array<string>")).orderBy("col_idx").collect()
    assert [r["header"] for r in got] == ["x", "BJP", "DMK"]


def test_independents_are_numbered(spark):
    names = ["Sl. No", "RAMAN (DMK)", "A (IND)", None, "B (Independent)", "Total", "NOTA", "plain name", "C (ind)"]
    df = spark.createDataFrame([("t", i, n) for i, n in enumerate(names)], "table_id string, col_idx int, header string")
    got = [(r["standard"], r["is_party"]) for r in headers.standard_headers(df).orderBy("col_idx").collect()]
    assert got == [("SL. NO", False), ("DMK", True), ("IND_1", True), ("Column_3", False), ("IND_2", True), ("TOTAL", False), ("NOTA", False), ("plain name", False), ("IND_3", True)]


def test_positions_after_folding(spark):
    names = [("No", None), ("VCK Votes", "VCK"), ("DMK Votes", "DMK"), ("BJP Votes", "BJP"), ("INC Votes", "INC"), ("PT", "PT"), ("DMK 2", "DMK")]
    df = spark.createDataFrame([("t", i, h, p) for i, (h, p) in enumerate(names)] + [("u", 0, "DMK Votes", "DMK")], "table_id string, col_idx int, header string, party string")
    allies = spark.createDataFrame([("DMK", "VCK"), ("DMK", "INC"), ("AIADMK", "PT"), ("NTK", "NONE"), ("DMK", "VCK")], "main string, ally string")
    got = {(r["table_id"], r["col_idx"]): (r["new_idx"], r["new_header"]) for r in headers.fold_positions(df, allies).collect()}
    assert got == {
        ("t", 1): (0, "DMK Votes"), ("t", 2): (0, "DMK Votes"), ("t", 4): (0, "DMK Votes"), ("t", 6): (0, "DMK Votes"), ("t", 5): (1, "AIADMK Votes"),
        ("t", 0): (2, "No"), ("t", 3): (3, "BJP Votes"), ("u", 0): (0, "DMK Votes"),
    }


def test_duplicate_headers_by_words(spark):
    rows = [["1", "2"], ["Sl. No", "Candidate"], ["party", "x"], ["", None], ["head", "er", "x"]]
    df = spark.createDataFrame([("t", i, r) for i, r in enumerate(rows)], "table_id string, row_idx int, cells array<string>")
    heads = df.where("row_idx = 4")
    assert {r["row_idx"] for r in headers.drop_duplicate_headers(df, heads).collect()} == {0, 2, 3}
    assert [r["v"] for r in df.orderBy("row_idx").select(headers.is_title_row(F.col("cells")).alias("v")).collect()] == [True, True, True, False, False]
