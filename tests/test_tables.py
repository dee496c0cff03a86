from pyspark.sql import functions as F

from tabloom import model
from tabloom.operators import columns, connect, fold, labels, lookup, merge, quality, records, rows, segment
from tabloom.sources import files, workbook


def rows_of(spark, table, data, page=1):
    return spark.createDataFrame([(table, page, i, r) for i, r in enumerate(data)], model.ROWS)


def test_fold_and_others(spark):
    df = spark.createDataFrame([("1", "100", "1,050", "30")], "PS string, DMK string, INC string, BJP string")
    got = fold.fold(df, {"DMK": ["INC"]})
    assert got.columns == ["PS", "DMK", "BJP"] and tuple(got.first()) == ("1", 1150.0, "30")
    df2 = spark.createDataFrame([("1", "5", "abc")], "PS string, DMDK string, PT string")
    assert tuple(fold.fold(df2, {"AIADMK Votes": ["DMDK", "PT"]}).first()) == ("1", 5.0)
    assert fold.fold(df, {"DMK": ["VCK"]}).columns == df.columns
    o = spark.createDataFrame([("1", "2", "20", "x"), ("2", "3", "1,050", "1")], "PS string, DMK string, INC string, BJP string")
    assert [r[2] for r in fold.others(o, ["PS", "DMK"], ["INC", "BJP"]).collect()] == [20, 1051]
    assert [r[2] for r in fold.others(o, ["PS", "DMK"], ["INC", "BJP"], legacy=True).collect()] == [20, 1]
    assert fold.numeric_columns(o) == ["PS", "DMK", "INC", "BJP"]
    assert [tuple(r) for r in fold.with_total_row(o, "PS", ["DMK"]).collect()][-1] == ("TOTAL", "5.0", "", "")


def test_rows(spark):
    data = [["1", "2", "3", "4", "5"], ["2", "3", "4"], ["1", "2"], ["6", "7", "8"], ["1", "3", "4"], ["x", "1", "2"]]
    got = [r[0] for r in rows_of(spark, "t", data).orderBy("row_idx").select(rows.is_column_number_row(F.col("cells"))).collect()]
    assert got == [True, True, False, False, False, False]
    st = rows_of(spark, "t", [["12"], ["12A"], [""], ["Total"]]).orderBy("row_idx").select(rows.is_station_row(F.col("cells"), 0))
    assert [r[0] for r in st.collect()] == [True, False, False, False]
    sd = rows_of(spark, "t", [["12A", "5", "6"], ["12(B)", "5", "6"], ["12", "5", "x"]]).orderBy("row_idx").select(rows.is_structured_data_row(F.col("cells")))
    assert [r[0] for r in sd.collect()] == [True, True, False]
    tot = rows_of(spark, "t", [["Grand Total", "1"], ["Total", "1"], ["1", "Total"], ["Totally", "1"]]).orderBy("row_idx").select(rows.is_total_row(F.col("cells")))
    assert [r[0] for r in tot.collect()] == [True, True, False, False]
    split = rows.split_header(rows_of(spark, "t", [["Sl. No", "Name of candidate"], ["1", "5"], ["2", "Name of x"]])).orderBy("row_idx")
    assert [r["is_header"] for r in split.collect()] == [True, False, False]
    heads = rows_of(spark, "t", [["A", "B"]])
    assert rows.drop_repeated_headers(rows_of(spark, "t", [["a", "b"], ["1", "2"]]), heads).count() == 1


def test_merge(spark):
    data = [["1", "", "A", "x"], ["1", "A", "", "y"], ["", "", "", "z"], ["", "", "", "z"], ["2", "b"]]
    got = merge.merge_pages(rows_of(spark, "t", data)).orderBy("row_idx").collect()
    assert [r["cells"] for r in got] == [["1", "", "A", "x"], ["", "", "", "z"], ["2", "b", "", ""]]
    again = merge.merge_pages(spark.createDataFrame(got, model.ROWS).repartition(3)).orderBy("row_idx").collect()
    assert [r["cells"] for r in again] == [r["cells"] for r in got]
    n = merge.number_rows(spark.range(100).repartition(7), ["id"]).orderBy("id").collect()
    assert [r["serial"] for r in n] == list(range(1, 101))
    assert [r["page"] for r in merge.paginate(spark.range(5), ["id"], 2).orderBy("id").collect()] == [0, 0, 1, 1, 2]
    roll = spark.createDataFrame([("2", "1", 0), ("1", "9", 1)], "ac_no string, part_no string, position int")
    assert [r["ac_no"] for r in roll.orderBy(*merge.roll_order(roll)).collect()] == ["1", "2"]
    assert [r["ac_no"] for r in roll.orderBy(*merge.roll_order(roll, legacy_sort=True)).collect()] == ["2", "1"]
    fitted, named = merge.align(rows_of(spark, "t", [["1"], ["1", "2"], ["3", "4"]]), spark.createDataFrame([("t", ["A"])], model.HEADERS))
    assert {len(r["cells"]) for r in fitted.collect()} == {2} and named.first()["headers"] == ["A", "Column 2"]
    cells = spark.createDataFrame([("t", 2, 0, 0, "x"), ("t", 2, 0, 1, "y")], "table_id string, page int, row_idx int, col_idx int, value string")
    ph = spark.createDataFrame([("t", 2, 0, " b "), ("t", 2, 1, "A")], "table_id string, page int, col_idx int, header string")
    master = spark.createDataFrame([("t", 0, "A"), ("t", 1, "B")], "table_id string, pos int, header string")
    assert model.to_rows(merge.to_master(cells, ph, master)).first()["cells"] == ["y", "x"]


def test_consolidate(spark):
    rolls = spark.createDataFrame([(0, "a", "1", "10", None), (1, "b", "1", "2", None), (2, "c", "1", "", None), (3, "d", "1", "3", "bad"), (4, "e", "1", "4", None)], "pdf_index int, filename string, ac_no string, part_no string, error string")
    voters = spark.createDataFrame([(0, 0, "v1"), (0, 1, "v2"), (1, 0, "v3"), (2, 0, "v4")], "pdf_index int, pos int, name string")
    out = merge.consolidate(voters, rolls)
    assert [(r["pdf_index"], r["start_row"], r["end_row"]) for r in out["booths"].orderBy("start_row").collect()] == [(2, 0, 0), (1, 1, 1), (0, 2, 3)]
    assert [(r["serial"], r["name"]) for r in out["voters"].orderBy("serial").collect()] == [(1, "v4"), (2, "v3"), (3, "v1"), (4, "v2")]
    assert [(r["filename"], r["error"]) for r in out["failed"].collect()] == [("d", "bad"), ("e", "No voters extracted")]


def test_labels(spark):
    names = ["DMK", "KMD", "AIADMK", "CPI(M)", "RAMAN - BJP", "SL NO", "TOTAL", "NOTA", "PARTY", "zzz"]
    df = spark.createDataFrame([(n,) for n in names], "header string")
    got = {r["header"]: (r["label"], r["confidence"]) for r in labels.label_columns(df).collect()}
    assert got["DMK"] == ("DMK Votes", 1.0) and got["KMD"] == ("DMK Votes", 1.0) and got["AIADMK"] == ("AIADMK Votes", 1.0)
    assert got["CPI(M)"] == ("CPI(M) Votes", 1.0) and got["RAMAN - BJP"] == ("BJP Votes", 1.0)
    assert got["SL NO"][0] == "SL. NO." and got["TOTAL"][0] == "Total Valid Votes" and got["NOTA"][0] == "NOTA Votes"
    assert "PARTY" not in got and "zzz" not in got
    old = labels.match_labels(df.where("header = 'PARTY'"), labels.party_dictionary(spark), legacy_containment=True).first()
    assert (old["label"], old["confidence"]) == ("BJP Votes", 0.92)


def test_columns(spark):
    df = spark.createDataFrame([("1", "x", "2")], "`SL. NO.` string, `Polling Station` string, V string")
    got = columns.select_columns(df, ["sl no", "polling station name", "V"], {"V": "SL. NO."})
    assert got.columns == ["SL. NO.", "Polling Station", "SL. NO. (2)"]
    try:
        columns.select_columns(df, ["unknown thing"])
        raise AssertionError
    except ValueError as e:
        assert "unknown thing" in str(e)
    assert columns.order_columns(["c", "a", "b"], ["b"]) == ["b", "c", "a"]
    assert columns.distinct_names(["a", "a", "b", "a"]) == ["a", "a (2)", "b", "a (3)"]
    block = spark.createDataFrame([("t", 0, 0, "No"), ("t", 0, 1, "Votes"), ("t", 0, 2, "Votes"), ("t", 0, 3, "Votes"), ("t", 1, 1, "A KUMAR (DMK)"), ("t", 1, 2, "B"), ("t", 1, 4, "")], "table_id string, row_idx int, col_idx int, value string")
    heads = {r["col_idx"]: r["header"] for r in columns.combine_headers(block).collect()}
    assert heads == {0: "No", 1: "DMK", 2: "B", 3: "Votes", 4: "Column 5"}
    base = spark.createDataFrame([(0, "a"), (1, "b")], "row_idx int, v string")
    assert [tuple(r) for r in columns.insert_row(base, 0, above=False).orderBy("row_idx").collect()] == [(0, "a"), (1, None), (2, "b")]
    assert [tuple(r) for r in columns.delete_row(base, 0).collect()] == [(0, "b")]
    assert [r["v"] for r in columns.edit_cell(base, 1, "v", "z").orderBy("row_idx").collect()] == ["a", "z"]


def test_lookup(spark):
    people = spark.createDataFrame([("Tiruvallur (SC)", "INC", "Sasikanth Senthil"), ("Chennai North", "DMK", "Kalanidhi Veerasamy")], "constituency string, party string, candidate string")
    asked = spark.createDataFrame([("Sasikanth Senthil", "Tiruvallur (SC)"), ("Sasikanth Senthil", "Chennai North"), ("LIHTNES HTNAKISAS", "Tiruvallur (SC)"), ("Kalanidhi Verasamy", "Chennai North"), ("Total", "Chennai North")], "text string, constituency string")
    got = {(r["text"], r["constituency"]): (r["party"], r["rung"]) for r in lookup.candidates_in_constituency(asked, people).collect()}
    assert got[("Sasikanth Senthil", "Tiruvallur (SC)")] == ("INC", 1)
    assert ("Sasikanth Senthil", "Chennai North") not in got and ("Total", "Chennai North") not in got
    assert got[("LIHTNES HTNAKISAS", "Tiruvallur (SC)")] == ("INC", 3) and got[("Kalanidhi Verasamy", "Chennai North")] == ("DMK", 6)
    norm = {r["text"]: r["party"] for r in lookup.normalize_headers(asked.where("constituency = 'Chennai North'"), people).collect()}
    assert norm["Sasikanth Senthil"] == "Sasikanth Senthil"
    parts = spark.createDataFrame([(str(n),) for n in (43, 44, 84, 109, 166, 330, 331, "x")], "part string")
    sec = {r["part"]: r["section"] for r in lookup.range_lookup(parts, "part", lookup.section_ranges(spark)).collect()}
    assert sec == {"43": "Ariyalur North", "44": "Ariyalur Town", "84": "Ariyalur South", "109": "Ariyalur North", "166": "Thirumanur East", "330": "T Palur West", "331": None, "x": None}


def test_validation_golden(spark):
    heads = ["Polling Station No.", "Candidate 1 (BJP)", "Candidate 2 (INC)", "Candidate 3 (DMK)", "NOTA", "Total Valid Votes"]
    data = ["1,150,200,180,10,540", "2,175,190,195,8,568", "3,O,200,180,10,390", "4,-5,200,180,10,385", "5,150,200,180,10,540", "TOTAL,625,990,915,48,2578"]
    table = rows_of(spark, "t", [d.split(",") for d in data]).repartition(3)
    header = spark.createDataFrame([("t", heads)], model.HEADERS)
    report, issues = quality.validate(table, header, spark.createDataFrame([("t", "ocr")], "table_id string, method string"))
    r = report.first()
    assert (round(r["structure"], 4), round(r["types"], 4), round(r["consistency"], 4)) == (0.96, 1.0, 0.96)
    assert round(r["confidence"], 6) == 0.889333 and r["grade"] == "B" and r["passed"] and (r["errors"], r["warnings"]) == (0, 4)
    assert sorted((i["code"], i["col_idx"]) for i in issues.collect()) == [("FEW_COLUMNS", None), ("FEW_ROWS", None), ("TOTAL_MISMATCH", 1), ("TOTAL_MISMATCH", 5)]


def test_gaps_and_clusters(spark):
    g = quality.station_gaps(rows_of(spark, "t", [["1"], ["2"], ["9"]])).collect()
    assert [(r["before"], r["number"], r["gap"]) for r in g] == [(2, 9, 7)]
    many = quality.gap_issues(rows_of(spark, "t", [[str(n)] for n in (1, 7, 14, 21, 28)])).collect()
    assert [(r["severity"], r["code"]) for r in many] == [("warning", "LARGE_STATION_GAPS")]
    v = spark.createDataFrame([(1, float(x)) for x in (10, 12, 16, 30, 33)], "k int, v double")
    assert [round(r["mean"], 4) for r in segment.cluster_means(v, ["k"], "v", 5).orderBy("mean").collect()] == [12.6667, 31.5]
    y = spark.createDataFrame([(1, float(x), i) for i, x in enumerate((0, 10, 20, 30))], "k int, v double, i int").repartition(3)
    assert [[x["i"] for x in r["items"]] for r in segment.anchored_rows(y, ["k"], "v", 15, ["i"]).orderBy("row").collect()] == [[0, 1], [2, 3]]
    lone = spark.createDataFrame([("d", 1, "b", 5.0, 6.0, 0.0, 10.0), ("d", 1, "a", 1.0, 2.0, 1.0, 11.0), ("d", 1, "c", 1.0, 2.0, 30.0, 40.0)], model.WORDS)
    assert [r["text"] for r in segment.words_to_lines(lone).orderBy("line_no").collect()] == ["a b", "c"]


def test_segments(spark):
    lines = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(["head", "1 1 School A", "[1] x", "11 11 School B"])], model.LINES)
    got = segment.entries(lines).orderBy("entry").collect()
    assert [(r["serial_no"], r["id_no"], r["text"]) for r in got] == [(1, 1, "School A [1] x"), (11, 11, "School B")]
    assert [r["text"] for r in segment.entries(lines, legacy_continuation=True).orderBy("entry").collect()] == ["School A", "School B"]
    b = segment.blocks(lines, ["doc_id"], "line_no", F.col("text").rlike("^[0-9]")).orderBy("block").collect()
    assert [r["lines"] for r in b] == [["head"], ["1 1 School A", "[1] x"], ["11 11 School B"]]
    s = spark.createDataFrame([("d", i, p) for i, p in enumerate([None, 5, None, None, 9, None])], "d string, i int, p int")
    assert [r["serial"] for r in segment.carried_serials(s, ["d"], ["i"], "p").orderBy("i").collect()] == [1, 5, 6, 7, 9, 10]
    v = spark.createDataFrame([("d", 1, 0, "A"), ("d", 1, 1, None), ("d", 1, 2, "")], "doc_id string, page int, pos int, voter_id string")
    ids = spark.createDataFrame([("d", 1, i, e) for i, e in enumerate("ABC")], "doc_id string, page int, pos int, epic string")
    assert [r["voter_id"] for r in segment.fill_ids_by_position(v, ids).orderBy("pos").collect()] == ["A", "B", "C"]
    near = segment.greedy_nearest(
        spark.createDataFrame([("d", 1, 0, 0.0, 0.0), ("d", 1, 1, 0.0, 2.0)], "doc_id string, page int, pos int, x double, y double"),
        spark.createDataFrame([("d", 1, "E1", 0.0, 1.0), ("d", 1, "E2", 0.0, 90.0)], "doc_id string, page int, epic string, x double, y double"),
    )
    assert sorted((r["pos"], r["epic"]) for r in near.collect()) == [(0, "E1"), (1, "E2")]
    page = spark.createDataFrame([("d", 1, "x ABC1234567 y DEF1234567 z")], "doc_id string, page int, text string")
    assert [r["segment"] for r in segment.epic_segments(page).orderBy("n").collect()] == ["x ABC1234567 y ", " y DEF1234567 z"]


def test_records(spark):
    t = "12 ABC1234567\nName : Kumar\nFather Name : Raman\nHouse No : l2 Age : 34 Gender : Male"
    v = spark.createDataFrame([(t,)], "segment string").select(records.voter(F.col("segment")).alias("v")).first()["v"]
    assert (v["serial_no"], v["name"], v["father_husband_name"], v["relation_type"], v["house_no"], v["age"], v["gender"], v["voter_id"]) == ("12", "Kumar", "Raman", "F", "12", "34", "M", "ABC1234567")
    p = spark.createDataFrame([(["1", "2A", "Panchayat School [1] -North Street", "All Voters"],)], "cells array<string>").select(records.polling_row(F.col("cells")).alias("p")).first()["p"]
    assert (p["serial_num"], p["id_num"], p["location"], p["station_type"]) == (1, 2, "Panchayat School", "All Voters")
    exp = spark.createDataFrame([("d", 100, 3)], "k string, expected long, deleted long")
    act = spark.createDataFrame([("d", "x")] * 96, "k string, voter_id string")
    assert quality.reconcile(exp, act, "k").first()["missing"] == 1


def test_connect(spark):
    cells = spark.createDataFrame([(0, " School "), (1, "DMK"), (2, "School"), (3, "Hall"), (4, None)], "i int, value string")
    fixed = spark.createDataFrame([("Hall", "Halle")], "value string, answer string")
    got = connect.translate(cells, lambda s: s.str.upper(), fixed).orderBy("i").collect()
    assert [r["value"] for r in got] == [" SCHOOL ", "DMK", "SCHOOL", "Halle", None]
    failing = connect.ask(cells.where("i = 3"), "value", lambda s: 1 / 0, tries=1)
    assert failing.first()["answer"] == "Hall"
    rows = spark.createDataFrame([(0, "Main Road"), (1, "")], "row_index int, a string")
    geo = connect.geocode(rows, "a", lambda s: s.map(lambda _: "1.5,2.5")).orderBy("row_index").collect()
    assert [(r["latitude"], r["status"]) for r in geo] == [(1.5, "success"), (None, "failed")]


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a&b", 2.5), (2, None, 3.0)], "n int, t string, x double")
    workbook.write_workbook(df, str(tmp_path / "x.xlsx"), ["n"])
    (tmp_path / "bad.xlsx").write_bytes(b"no")
    got, errors = files.scan_documents(files.binary_files(spark, str(tmp_path), "*.xlsx"), workbook.read_sheets)
    assert [r["cells"] for r in got.orderBy("row_idx").collect()] == [["n", "t", "x"], ["1", "a&b", "2.5"], ["2", "", "3.0"]]
    assert errors.count() == 1
    pdf = b"%PDF" + b" " * 100 + b"%%EOF"
    flags = spark.createDataFrame([(bytearray(pdf),), (bytearray(b"no"),)], "content binary").select(files.is_pdf(F.col("content"))).collect()
    assert [r[0] for r in flags] == [True, False]


def test_streaming(spark, tmp_path):
    from tabloom.streaming import arrivals

    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.createDataFrame([(1, "a")], "n int, k string").write.json(src)
    stream = arrivals.arriving(spark, src, "n int, k string")
    arrivals.drain(stream, out, ck).awaitTermination()
    spark.createDataFrame([(2, "a")], "n int, k string").write.mode("append").json(src)
    arrivals.drain(stream, out, ck).awaitTermination()
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_number_rows_over_many_partitions(spark, tmp_path):
    """Every serial once, in order, where counts and numbers are computed from different plans of a wide table."""
    n = 600_000
    wide = spark.range(n).select((F.col("id") * 7 % n).alias("k"), F.col("id").alias("j"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 4).alias("pad"))
    wide.repartition(9).write.parquet(f"file://{tmp_path}/wide")
    rows = spark.read.parquet(f"file://{tmp_path}/wide")
    merge.number_rows(rows, ["k"]).write.parquet(f"file://{tmp_path}/numbered")
    got = spark.read.parquet(f"file://{tmp_path}/numbered")
    assert got.where("serial <> k + 1").count() == 0 and got.count() == n
    assert merge.paginate(rows, ["k"], 1000).groupBy("page").count().where("count = 1000").count() == 600


def test_number_rows_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3), (None, 4), ("a", 5)], "s string, i int")
    got = {r["i"]: r["serial"] for r in merge.number_rows(rows, ["s", "i"]).collect()}
    assert got == {1: 1, 4: 2, 3: 3, 5: 4, 2: 5}
    assert merge.number_rows(rows.limit(0), ["s"]).count() == 0
