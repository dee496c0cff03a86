"""From pages of cells to one checked table, by golden rows."""

from pyspark.sql import functions as F

from tabloom.operators import chains

ROWS = "table_id string, page int, row_idx int, cells array<string>"


def frame(spark, *pages):
    return spark.createDataFrame([("t", p, i, r) for p, rows in pages for i, r in enumerate(rows)], ROWS)


def test_pages_under_one_header(spark):
    rows = frame(
        spark,
        (1, [["Polling", "Candidate", "Total of"], ["Station", "RAMAN (DMK)", "valid votes"], ["1", "2", "3"], ["101", "50", "70"], ["102", "", "9"]]),
        (2, [["Polling Station", "Total of valid votes", "Candidate RAMAN (DMK)"], ["103", "88", "61"], ["", " ", None]]),
        (3, [["104", "5", "6"]]),
    )
    master, data = chains.merged_table(rows)
    assert [(r["pos"], r["header"]) for r in master.orderBy("pos").collect()] == [(0, "Polling Station"), (1, "Candidate RAMAN (DMK)"), (2, "Total of valid votes")]
    got = [(r["page"], r["row_idx"], r["cells"]) for r in data.orderBy("page", "row_idx").collect()]
    assert got == [(1, 3, ["101", "50", "70"]), (1, 4, ["102", "", "9"]), (2, 1, ["103", "61", "88"])]
    carried = chains.merged_table(rows, carry=True)[1].where("page = 3").collect()
    assert [r["cells"] for r in carried] == [["104", "6", "5"]]
    assert chains.merged_table(rows.limit(0))[1].count() == 0


def test_station_tables(spark):
    heads = ["SL. NO.", "Polling\nStation", "RAMAN (DMK)", "KUMAR (A) (BJP)", "LONE", "NOTA", "Rejected Votes", "TOTAL VALID VOTES", "Tendered"]
    rows = frame(spark, (1, [heads, ["1", " 12 ", "100", "50", "x", "3", "9", "153", "0"], ["2", "13", "1", "1", "1"], ["", "Total", "1"], ["3", "14", "1", "", "", "", "", "2"], ["x"]]))
    own, got = chains.station_table(rows)
    told = [(r["station"], len(r["cells"]), r["stated"], r["computed"], r["valid"]) for r in got.orderBy("row_idx").collect()]
    assert told == [(12, 9, 153, 153, True), (13, 9, None, 3, False), (14, 9, 2, 1, False)]
    named = [(r["col_idx"], r["candidate"], r["party"]) for r in chains.candidate_columns(own).orderBy("col_idx").collect()]
    assert named == [(2, "RAMAN", "DMK"), (3, "KUMAR (A)", "BJP"), (4, "LONE", "")]
    assert chains.station_table(frame(spark, (1, [["a", "b"], ["1", "2"]])))[1].count() == 0
    only = chains.station_table(frame(spark, (1, [["polling station", "b"], ["1", "2"]])))[1].collect()
    assert [(r["computed"], r["stated"], r["valid"]) for r in only] == [(2, None, False)]


def test_titles_end_at_the_table(spark):
    text = "\n FORM  20 \nGeneral Election to Lok Sabha\nsomething else\nTotal No of Electors: 5\nSl. No. Polling Station\nAssembly constituency\n"
    pages = [("d", 2, "election"), ("d", 1, text), ("e", 1, None), ("f", 1, "\n".join(["x"] * 15 + ["Election"])), ("g", 1, "polling station election")]
    got = chains.document_titles(spark.createDataFrame(pages, "doc_id string, page int, text string")).collect()
    assert sorted((r["doc_id"], r["line_no"], r["title"]) for r in got) == [("d", 0, "FORM 20"), ("d", 1, "General Election to Lok Sabha"), ("d", 2, "Total No of Electors: 5")]


def test_reports(spark):
    rows = spark.createDataFrame([("a", ["1", "2"]), ("a", ["1"]), ("a", ["Polling Station", "x"]), ("a", ["", None])], "table_id string, cells array<string>")
    heads = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"])], "table_id string, headers array<string>")
    got = {r["table_id"]: tuple(r)[1:] for r in chains.verification(rows, heads).collect()}
    assert got == {"a": (2, 4, 1, 1, 1, 2, "warning"), "b": (1, 0, 0, 0, 0, 0, "success")}
    headers = spark.createDataFrame([("x",), ("x",), ("y",), ("",), (None,)], "header string")
    mapping = spark.createDataFrame([("S", "x"), ("S", "y"), ("S", "z")], "standard string, variant string")
    assert tuple(chains.mapping_coverage(headers, mapping).first()) == (2, 2, 1.0, 0.95)
    assert tuple(chains.mapping_coverage(headers.where(F.lit(False)), mapping).first()) == (0, 0, 0.0, 0.0)
