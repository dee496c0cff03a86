"""Roll workbooks: named sheets, metadata in three places, the merged table and the report."""

from tabloom.operators import rolls
from tabloom.sources import workbook

CELLS = "table_id string, sheet string, row_idx int, col_idx int, value string"


def sheet(table, name, rows):
    return [(table, name, r, c, v) for r, row in rows.items() for c, v in enumerate(row, 1)]


def test_sheets_to_one_table(spark):
    body = ["வ.எண்"], ["1", "RAMAN", "MURUGAN", "F", "1A", "30", "Male", "ABC1234567", "Main"], ["", "", "", "x"], ["", "SITA"], ["Serial No"], ["2", None, " "]
    cells = sheet("a.xlsx", "Booth 51", {1: ["AC No (x): 149"], 2: ["Booth No : 51"], 4: ["Serial No", "Name"], **{5 + i: r for i, r in enumerate(body)}})
    cells += sheet("a.xlsx", " SUMMARY ", {4: ["Serial No"], 6: ["9", "NOBODY"]})
    cells += sheet("b.xlsx", "s", {1: ["AC No", None, None, "no 7"], 2: ["Part No", "", "", "12"], 14: ["SERIAL"], 16: ["5", "LATE"]})
    cells += sheet("b.xlsx", "AC 149 - 3 x", {1: ["Serial No"], 2: ["x", "SKIPPED"], 3: ["1", "FIRST"]}) + sheet("c.xlsx", "no header", {1: ["AC No: 1"], 15: ["serial"], 17: ["1", "x"]})
    df = spark.createDataFrame(cells, CELLS)
    meta = {(r["table_id"], r["sheet"]): (r["ac_no"], r["part_no"]) for r in rolls.sheet_metadata(df).collect()}
    assert meta == {("a.xlsx", "Booth 51"): ("149", "51"), ("b.xlsx", "s"): ("7", "12"), ("b.xlsx", "AC 149 - 3 x"): ("149", "3"), ("c.xlsx", "no header"): ("1", "")}
    got = rolls.merge_rolls(df).orderBy("Serial No").collect()
    assert tuple(got[0].asDict()) == rolls.MERGED
    assert [(r["Serial No"], r["voter_name"], r["ac_number"], r["part_number"], r["section_name"], r["section_name_tamil"]) for r in got] == [
        (1, "LATE", "7", "12", "Ariyalur North", "அரியலூர் வடக்கு"), (2, "FIRST", "149", "3", "Ariyalur North", "அரியலூர் வடக்கு"),
        (3, "RAMAN", "149", "51", "Ariyalur Town", "அரியலூர் நகரம்"), (4, "SITA", "149", "51", "Ariyalur Town", "அரியலூர் நகரம்"), (5, "", "149", "51", "Ariyalur Town", "அரியலூர் நகரம்"),
    ]
    assert (got[2]["relation_name"], got[2]["epic_number"], got[2]["street_name"], got[2]["house_number"]) == ("MURUGAN", "ABC1234567", "Main", "1A")
    assert rolls.merge_rolls(df.limit(0)).count() == 0


def test_names_of_sheets():
    content = workbook.sheet_bytes(["a", "b"], [[1, None], ["x", "y"]], "Booth & 1")
    assert workbook.sheet_names(content) == ["Booth & 1"]
    assert list(workbook.read_named_cells(content)) == [("Booth & 1", 1, 1, "a"), ("Booth & 1", 1, 2, "b"), ("Booth & 1", 2, 1, "1"), ("Booth & 1", 3, 1, "x"), ("Booth & 1", 3, 2, "y")]


def test_report(spark, tmp_path):
    files = [(0, "a", "1", "10", None), (1, "b", "1", "2", None), (2, "c", "2", "1", None), (3, "d", "2", "3", "bad"), (4, "e", "1", "4", None)]
    df = spark.createDataFrame(files, "pdf_index int, filename string, ac_no string, part_no string, error string")
    voters = spark.createDataFrame([(0, "A"), (0, "B"), (1, "C"), (2, "D"), (3, "E")], "pdf_index int, name string")
    summary, errors = rolls.roll_report(voters, df)
    got = {(r["level"], r["ac_no"], r["pdf_index"]): (r["part_no"], r["files"], r["voters"], r["share"]) for r in summary.collect()}
    assert got == {
        ("booth", "1", 0): ("10", 1, 2, 0.5), ("booth", "1", 1): ("2", 1, 1, 0.25), ("booth", "2", 2): ("1", 1, 1, 0.25),
        ("constituency", "1", None): (None, 2, 3, 0.75), ("constituency", "2", None): (None, 1, 1, 0.25), ("all", None, None): (None, 3, 4, 1.0),
    }
    assert {(r["pdf_index"], r["error"]) for r in errors.collect()} == {(3, "bad"), (4, "No voters extracted")}
    rolls.write_report(voters, df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/voters")).where("ac_no = 1 AND part_no = 10").count() == 2
    assert spark.read.parquet(str(tmp_path / "out/errors")).count() == 2
    rolls.write_report(voters, df.where("pdf_index < 3"), str(tmp_path / "fine"))
    assert not (tmp_path / "fine/errors").exists()


def test_places_are_asked_for_in_three_ways_and_never_again(spark, tmp_path):
    from tabloom.operators import columns, connect

    log = str(tmp_path)

    def connector(queries):
        import uuid
        from pathlib import Path

        Path(log, uuid.uuid4().hex).write_text("\n".join(queries))
        if any("fails" in q for q in queries):
            raise ValueError
        at = {"North Street, India": "1.5,2.5", "South Street": "3,4", "PS No. 5 West Street, India": "5,6"}
        return queries.map(lambda q: at.get(q, "nothing"))

    texts = ["North Street", "12. North  Street", "South Street", "PS No. 5 West Street", "Lost Street", "it fails", None, " ", "known"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_index int, a string").coalesce(1)
    known = spark.createDataFrame([("known|india", None, None, "not_found")], "key string, latitude double, longitude double, status string")
    path = str(tmp_path / "answers.parquet")
    connect.geocode_answers(rows, "a", connector, known=known).write.parquet(path)
    answers = spark.read.parquet(path)
    got = {r["row_index"]: (r["latitude"], r["longitude"], r["status"]) for r in connect.with_places(rows, "a", answers).collect()}
    assert [got[i] for i in range(4)] == [(1.5, 2.5, "success"), (1.5, 2.5, "success"), (3.0, 4.0, "success"), (5.0, 6.0, "success")]
    assert [got[i][2] for i in range(4, 9)] == ["not_found", "not_found", "error", "error", "not_found"]
    calls = [p.read_text() for p in tmp_path.iterdir() if p.is_file()]
    assert not any("known" in c for c in calls)
    connect.geocode_answers(rows, "a", connector, known=answers).collect()
    assert len([p for p in tmp_path.iterdir() if p.is_file()]) == len(calls)
    heads = spark.createDataFrame([("t", 0, "DMK Votes"), ("t", 1, None), ("t", 2, "Total")], "table_id string, col_idx int, header string")
    assert [r["col_idx"] for r in columns.search_columns(heads, " votes").collect()] == [0] and columns.search_columns(heads, "").count() == 3
