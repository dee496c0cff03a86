"""The remaining operators on small golden tables."""

import json

from pyspark.sql import functions as F

from tabloom import model
from tabloom.operators import columns, labels, lookup, merge, quality, records, rows, segment
from tabloom.sources import files

CELLS = "table_id string, row_idx int, col_idx int, value string"


def cells_of(spark, data, table="t"):
    return spark.createDataFrame([(table, r, c, v) for r, row in enumerate(data) for c, v in enumerate(row)], CELLS)


def test_model_round_trip(spark):
    table = spark.createDataFrame([("t", 1, 0, ["a", None, "c"]), ("t", 1, 1, ["d"])], model.ROWS)
    dense = model.to_rows(model.to_cells(table)).orderBy("row_idx").collect()
    assert [r["cells"] for r in dense] == [["a", "", "c"], ["d", "", ""]]
    assert [tuple(r)[3:] for r in model.to_wide(table, ["x", "y"]).orderBy("row_idx").collect()] == [("a", ""), ("d", "")]


def test_master_headers(spark):
    h = [("t", p, c, n) for p in (1, 2, 3) for c, n in enumerate(["Polling Station", "DMK", "Total"])] + [("t", 3, 3, "17")]
    got = merge.master_headers(spark.createDataFrame(h, "table_id string, page int, col_idx int, header string")).orderBy("pos").collect()
    assert [r["header"] for r in got] == ["Polling Station", "DMK", "Total"]
    pages = spark.createDataFrame([("t", 1, ["a"]), ("t", 2, None)], "table_id string, page int, headers array<string>")
    assert [r["headers"] for r in merge.carry_header(pages).orderBy("page").collect()] == [["a"], ["a"]]
    d = spark.createDataFrame([("b", 2), ("a", 1), ("b", 0)], "v string, i int")
    assert [r["v"] for r in merge.ordered_distinct(d, "v", ["i"]).orderBy("i").collect()] == ["b", "a"]


def test_page_classes_and_grids(spark):
    pages = spark.createDataFrame([("a", p, 600, 0.9) for p in range(6)] + [("b", p, 10, 0.9) for p in range(3)], "doc_id string, page int, n_chars int, image_cover double")
    assert {r["doc_id"]: r["kind"] for r in quality.classify_pages(pages).collect()} == {"a": "text", "b": "image"}
    grids = spark.createDataFrame([("p", 0, [0.0, 1.0, 5.0, 6.0], [0.0, 1.0, 9.0]), ("p", 1, [0.0, 2.0, 4.0, 6.0], [0.0, 4.0, 8.0]), ("p", 2, [0.0], [0.0])], "page_id string, pos int, h array<double>, v array<double>")
    assert quality.best_grid(grids).first()["pos"] == 1


def test_cards(spark):
    card = "doc_id string, page int, card_idx int, x0 double, top double, x1 double, bottom double"
    cards = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 50.0, 50.0), ("d", 1, 1, 100.0, 0.0, 150.0, 50.0)], card)
    words = spark.createDataFrame([("d", 1, "a", 10.0, 20.0, 10.0, 12.0), ("d", 1, "b", 110.0, 120.0, 10.0, 12.0), ("d", 1, "c", 300.0, 310.0, 10.0, 12.0)], model.WORDS)
    assert {(r["text"], r["card_idx"]) for r in segment.words_in_cards(words, cards).collect()} == {("a", 0), ("b", 1)}
    stamps = spark.createDataFrame([("d", 1, 120.0, 20.0)], "doc_id string, page int, x double, y double")
    assert [r["card_idx"] for r in segment.deleted_cards(cards, stamps).collect()] == [0]
    boxes = spark.createDataFrame([(0, 1.0, 2.0), (0, 11.0, 2.0), (1, 6.0, 1.0), (1, 40.0, 1.0)], "row int, x double, width double")
    ext = segment.column_extents(boxes.where("row = 0"), ["row"])
    assert [r["column"] for r in segment.box_columns(boxes, ext).orderBy("row", "x").collect()] == [0, 1, 1, 1]
    lines = spark.createDataFrame([("d", 1, 0, "name", ["A", "B"]), ("d", 1, 1, "epic", ["E1", "E2"]), ("d", 1, 2, "name", ["C"])], "doc_id string, page int, line_no int, kind string, values array<string>")
    assert [(r["name"], r["epic"]) for r in segment.card_rows(lines).orderBy("batch", "slot").collect()] == [("A", "E1"), ("B", "E2"), ("C", None)]
    ocr = spark.createDataFrame([(1, 0, 0, 5, 0, "b", 80.0), (1, 0, 0, 1, 0, "a", 90.0)], "page int, block_num int, line_num int, x int, y int, text string, confidence double")
    assert segment.lines_by_number(ocr).first()["text"] == "a b"


def test_text_segments(spark):
    def one(expr, v):
        return spark.createDataFrame([(v,)], "v string").select(expr.alias("o")).first()["o"]

    v = F.col("v")
    assert one(segment.split_cards(v, 2), "a\fb") == ["a", "b"] and one(segment.split_cards(v, 2), "a") == ["a", ""]
    assert one(segment.label_segments(v), "Name: A Age: 3") == ["Name: A", "Age: 3"]
    assert one(segment.join_continuations(v), "Name: A\nFather: B\nlong\nAge: 3") == "Name: A\nFather: B long\nAge: 3"
    lines = spark.createDataFrame([("d", 1, 0, "Name : A"), ("d", 1, 1, "ABC1234567"), ("d", 1, 2, "Name : B"), ("d", 1, 3, "Name : C"), ("d", 1, 4, "DEF1234567 GHI1234567")], model.LINES)
    pairs, orphans = segment.name_id_pairs(lines)
    assert [(r["name"], r["epic"]) for r in pairs.orderBy("seg").collect()] == [("A", "ABC1234567"), ("B", None), ("C", "DEF1234567")] and orphans.count() == 0
    offs = spark.createDataFrame([("g", 1, 2), ("g", 2, 3)], "g string, o int, n int")
    assert [(r["start_row"], r["end_row"]) for r in segment.running_offsets(offs, "g", "o", "n").orderBy("o").collect()] == [(0, 1), (2, 4)]


def test_voter_rules(spark):
    full = "doc_id string, page int, pos int, strategy string, name string, father_husband_name string, house_no string, age string, gender string, voter_id string"
    v = spark.createDataFrame(
        [("d", 1, 0, "text", "Kumar", "R", "1", "30", "M", "ABC1234567"), ("d", 1, 1, "text", "Total electors", "", "", "", "", ""), ("d", 1, 0, "cards", "X", "", "", "", "", "")], full
    )
    assert {r["strategy"] for r in records.choose_strategy(v, ["cards", "text"]).collect()} == {"text"}
    assert [r["name"] for r in records.clean_voters(v).collect()] == ["Kumar"]
    h = spark.createDataFrame([("d", 1, x) for x in ("1A", "2B", "3C", "48", "7")], "doc_id string, page int, house_no string")
    assert sorted(r["house_no"] for r in records.fix_house_numbers(h).collect()) == ["1A", "2B", "3C", "4B", "7"]
    t = spark.createDataFrame([("Assembly Constituency : 149 Part No: 12 Total electors: 900\nSection Name: 1 - Main Street",)], "t string")
    head = t.select(records.roll_header(F.col("t")).alias("h"), records.section_name(F.col("t")).alias("s"), records.is_header_card(F.col("t")).alias("c"), records.has_voter_content(F.col("t")).alias("v")).first()
    assert (head["h"]["ac_no"], head["h"]["part_no"], head["h"]["total_voters"], head["s"], head["c"], head["v"]) == ("149", "12", "900", "Main Street", True, False)
    line = spark.createDataFrame([("1  12/3  Kumar  Raman  34  M  ABC1234567",)], "t string").select(records.voters_from_table_line(F.col("t")).alias("v")).first()["v"]
    assert (line["serial_no"], line["name"], line["voter_id"]) == ("1", "Kumar", "ABC1234567")


def test_sheets(spark, tmp_path):
    table = spark.createDataFrame([("s", 1, 0, ["", "Votes", "Votes"]), ("s", 1, 1, ["No", "DMK", "BJP"]), ("s", 1, 2, ["1", "5", "6"])], model.ROWS)
    assert {r["col_idx"]: r["header"] for r in files.sheet_headers(table).collect()} == {0: "No", 1: "Votes - DMK", 2: "Votes - BJP"}
    meta = cells_of(spark, [["AC No: 149", ""], ["Part No", "12"]])
    assert tuple(files.roll_metadata(meta).first())[1:] == ("149", "12")
    far = spark.createDataFrame([("t", 0, 0, "a"), ("t", 3, 0, "b"), ("t", 90, 0, "c")], CELLS)
    assert sorted(r["value"] for r in files.used_range(far).collect()) == ["a", "b"]
    (tmp_path / "x.json").write_text(json.dumps([{"candidate": "A", "party": "P", "constituency": "C"}, {"candidate": "A", "party": "Q", "constituency": "C"}]))
    assert [tuple(r) for r in files.candidate_list(spark, str(tmp_path / "x.json")).collect()] == [("C", "Q", "A")]
    (tmp_path / "m.json").write_text('{"A": "P"}')
    assert files.candidate_map(spark, str(tmp_path / "m.json")).first()["party"] == "P"
    (tmp_path / "t.txt").write_text("a\nb\fc")
    lines = files.text_lines(spark, str(tmp_path / "t.txt"))
    assert [(r["page"], r["line_no"], r["text"]) for r in lines.orderBy("page", "line_no").collect()] == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]
    assert [r["text"] for r in files.page_texts(lines).orderBy("page").collect()] == ["a\nb", "c"]
    roll = spark.createDataFrame([("1", "2", "x"), ("1", "3", "y")], "ac_no string, part_no string, name string")
    files.write_rolls(roll, str(tmp_path / "rolls"))
    assert spark.read.parquet(str(tmp_path / "rolls")).where("part_no = 3").first()["name"] == "y"


def test_lookup_more(spark):
    people = spark.createDataFrame([("C1", "DMK", "T R Balu"), ("C1", "BJP", "Vinoj Selvam"), ("C2", "INC", "Other Person")], "constituency string, party string, candidate string")
    vals = spark.createDataFrame([("T R Balu", None), ("Vinoj Selvan", None), ("C. N. Annadurai", None), ("dmk", None), ("unknown text", None)], "text string, constituency string")
    assert {r["text"]: r["party"] for r in lookup.legacy_ladder(vals, people).collect()} == {"T R Balu": "DMK", "Vinoj Selvan": "BJP", "C. N. Annadurai": "DMK", "dmk": "DMK", "unknown text": "unknown text"}
    heads = spark.createDataFrame([("t", 0, "t r balu"), ("t", 1, "VINOJ SELVAM"), ("t", 2, "Other Person")], "table_id string, col_idx int, header string")
    assert tuple(lookup.majority_constituency(heads, people).first()) == ("t", "C1", 2)
    al = spark.createDataFrame([("DMK", "VCK")], "main string, ally string")
    got = labels.alliance_columns(spark.createDataFrame([("VCK",), ("AIADMK",)], "header string"), al).collect()
    assert [(r["header"], r["main"]) for r in got] == [("VCK", "DMK")]


def test_columns_more(spark):
    df = spark.createDataFrame([(i, str(i + 1), str(i + 1), "x") for i in range(6)], "i int, `Sl No` string, `S.No` string, v string")
    assert columns.drop_twin_serials(df, ["i"]).columns == ["i", "Sl No", "v"]
    base = spark.createDataFrame([("d1", "x", "P.U.M.S Town-638461")], "table_id string, a string, loc string")
    pages = spark.createDataFrame([("d1", 1, "nothing"), ("d1", 2, "AC no: 149")], "doc_id string, page int, text string")
    assert columns.with_ac_number(base, pages).first()["AC NO."] == "149"
    assert tuple(columns.with_booth_name(base, "loc").first())[2:] == ("P.U.M.S Town-638461", "P.U.M.S")
    assert columns.order_by_role(["t", "p", "x", "id"], {"id": "identifier", "p": "party", "t": "count"}) == ["id", "p", "x", "t"]
    inds = spark.createDataFrame([("t", 0, "IND"), ("t", 1, "DMK"), ("t", 2, "IND")], "table_id string, col_idx int, party string")
    assert [r["party"] for r in columns.number_independents(inds).orderBy("col_idx").collect()] == ["IND_1", "DMK", "IND_2"]
    heads = spark.createDataFrame([("t", 0, "A KUMAR (CPI(M))"), ("t", 1, "Total")], "table_id string, col_idx int, header string")
    assert [(r["name"], r["party"]) for r in columns.candidate_columns(heads).collect()] == [("A KUMAR", "CPI(M)")]
    after = rows.after_page_header(spark.createDataFrame([("t", 1, 0, ["junk"]), ("t", 1, 1, ["Sl. No", "Candidate"]), ("t", 1, 2, ["1", "x"]), ("t", 2, 0, ["2", "y"])], model.ROWS))
    assert sorted(r["cells"][0] for r in after.collect()) == ["1", "2"]


def test_quality_more(spark):
    c = cells_of(spark, [["=A1", "#REF!", ""], ["1", "2", "3"]])
    assert tuple(quality.workbook_quality(c).first())[1:] == (1, 1, 1, 6)
    assert quality.compare_structure(c, c).first()["same"]
    prof = {r["column"]: r["blank"] for r in quality.missing_profile(spark.createDataFrame([("a", ""), (None, "b")], "x string, y string")).collect()}
    assert prof == {"x": 1, "y": 1}
    batch = spark.createDataFrame([(10, 5, 2.0, True), (0, 0, 1.0, False)], "pages int, rows int, seconds double, ok boolean")
    r = quality.batch_totals(batch).first()
    assert (r["files"], r["good"], r["pages"], round(r["cost"], 2)) == (2, 1, 10, 0.1)
    dup = spark.createDataFrame([("t", 1, i, [k]) for i, k in enumerate(["1", "", "", "1"])], model.ROWS)
    assert [(r["n"], r["v"]) for r in quality.duplicate_stations(dup).orderBy("n").collect()] == [(2, ""), (3, "1")]
