"""House numbers, voter blocks, and tasks that expire, by golden rows and against plain Python."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabloom.functions import house
from tabloom.operators import voters
from tabloom.streaming import expiry


def golden(spark, fold, pairs):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, v string").withColumn("got", fold(F.col("v"))).orderBy("i").collect()
    assert [(r["v"], r["got"]) for r in rows] == pairs


def test_look_alike_digits(spark):
    pairs = [("l2", "12"), ("O8", "08"), ("1S3", "153"), ("l-2lB", "1-21B"), ("O8/l9l", "08/191"), ("12B", "12B"), ("3O", "30"), ("15/B", "15/B"), ("12A", "12A"), ("", ""), ("B", "8"), ("2lT", "217"), ("12/3B-", "12/38-")]
    golden(spark, house.look_alike_digits, pairs)


def test_clean_house_number(spark):
    pairs = [
        ("15 _- -", "15"), ("15 - Photo 6", "15"), ("எண் 08/191", "08/191"), ("15 அ", "15A"), ("3 சி", "3C"), ("43 ர", "43"), ("36&", "36A"), ("1A", "1A"),
        ("1/8", "1/8"), ("56J/11", "56J/11"), ("O8", "08"), ("1S3", "153"), ("4671 STREET", "4671"), ("16J,SWETHAN", "16J"), ("121,சண்முகா", "121"), ("0123", "123"),
        ("01A", "01A"), ("-", ""), ("", ""), (None, ""), ("ABC", "A8C"), ("HXY", ""), ("12345678901234567890123", ""), ("12 Photo is available", "12"), ("-5", "-5"), ("1-21B", "1-21B"),
    ]
    golden(spark, house.clean_house_number, pairs)


def test_house_numbers_of_a_line(spark):
    pairs = [
        ("வீட்டு எண்: 1A வீட்டு எண் : 12&", ["1A", "12A"]), ("வீட்டு எண்: 32 GLO) crevor: 320", ["32", "32"]), ("GLO) crevor: 320 ALG) crovor: 1/3.", ["320", "1/3"]),
        ("House No: 7-B, Age: 30", ["7-B"]), ("nothing", []), (None, []),
    ]
    golden(spark, house.house_numbers, pairs)


def parsed(spark, blocks, serial=None):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, lines array<string>")
    return [tuple(r["v"]) for r in df.withColumn("v", voters.parse_block(F.col("lines"), serial)).orderBy("i").collect()]


def test_blocks_with_labels(spark):
    got = parsed(spark, [
        ["Name: RAMAN", "KUMAR", "Father's Name: MURUGAN", "House No: l2 Photo is available", "Age: 45 Gender: Male", "ABC1234567"],
        ["Elector Name : SITA Husband's Name: RAM", "of the hill", "Age: 17", "Gender: F XYZ7654321", "more text"],
        ["பெயர் : முருகன்", "தந்தை பெயர் : கந்தன்", "வீட்டு எண் : 15 அ", "வயது : 33", "பாலினம் : ஆண்"],
        ["Name: A", "Name: B", "NOT1234567", "loose", None, ""],
    ])
    assert got[0] == ("", "RAMAN KUMAR", "MURUGAN", "F", "12", "45", "Male", "ABC1234567")
    assert got[1] == ("", "SITA", "RAM of the hill", "H", "", "", "Female", "XYZ7654321")
    assert got[2] == ("", "முருகன்", "கந்தன்", "F", "15A", "33", "Male", "")
    assert got[3] == ("", "A", "", "", "", "", "", "NOT1234567")


def test_blocks_without_labels(spark):
    got = parsed(spark, [["RAMAN K Male 44", "ABC1234567 extra"], ["ABC1234567", "12", "LATER"], [], None, ["F 150 18"]], F.lit("7"))
    assert got[0] == ("7", "RAMAN K", "", "", "", "44", "Male", "ABC1234567")
    assert got[2] == got[3] == ("7", "", "", "", "", "", "", "")
    assert got[4][5:7] == ("18", "Female")


def test_voters_of_pages(spark):
    text = ["head of the page", "1 RAMAN", "Father's Name: A", "", "Age: 20", "2", "Name: SITA", "Gender: Female", "3 "]
    lines = [("d", 1, i, t) for i, t in enumerate(text)] + [("d", 2, 0, "9 Name: LONE"), ("d", 2, 1, None)]
    got = voters.voters_from_lines(spark.createDataFrame(lines, "doc_id string, page int, line_no int, text string")).orderBy("page", "block").collect()
    assert [(r["page"], r["block"], r["serial_no"], r["name"], r["age"]) for r in got] == [
        (1, 0, "", "head of the page", ""), (1, 1, "1", "", "20"), (1, 2, "2", "SITA", ""), (2, 1, "9", "LONE", ""),
    ][:1] + [(1, 2, "2", "SITA", ""), (2, 1, "9", "LONE", "")]


def test_table_lines(spark):
    rows = ["12  RAMAN K  MURUGAN  O8  45  Male  ABC1234567", "13\tSITA\tRAM", "14  one", "x  a  b", "", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, line string").withColumn("v", voters.table_line_voter(F.col("line")))
    got = [r["v"] and tuple(r["v"]) for r in df.orderBy("i").collect()]
    assert got == [("12", "RAMAN K", "MURUGAN", "", "08", "45", "Male", "ABC1234567"), ("13", "SITA", "RAM", "", "", "", "", ""), None, None, None, None]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_idle_tasks_expire(rocks, tmp_path):
    """Late rows within the watermark move a task's timer, older ones revive nothing, and a task that returns begins anew."""
    spark, src = rocks, str(tmp_path / "in")
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    out = []
    for batch in (
        [("a", at(0), "new"), ("a", at(20), "running"), ("b", at(5), "new"), (None, at(5), "x"), ("n", None, "x")],
        [("a", at(50), "done"), ("a", at(45), "late"), ("c", at(52), "new")],  # a is alive until 110, b until 65
        [("c", at(90), "running")],  # watermark 80: b goes
        [("b", at(10), "too late"), ("c", at(140), "done")],  # watermark 130: a goes
        [("a", at(150), "again"), ("d", at(400), "new")],  # watermark 390: c and the new a go
        [("d", at(401), "new")],
    ):
        spark.createDataFrame(batch, "task_id string, ts timestamp, status string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("task_id string, ts timestamp, status string").parquet(src)
        query = expiry.expire_idle(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append")
        query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        rows = spark.read.schema(expiry.EXPIRED).parquet(str(tmp_path / "out")).collect()
        out.append({(r["task_id"], r["first_seen"], r["last_seen"], r["status"], r["n_rows"]) for r in rows})
    assert out[0] == out[1] == set() and out[-1] == {
        ("b", at(5), at(5), "new", 1), ("a", at(0), at(50), "done", 4), ("c", at(52), at(140), "done", 3), ("a", at(150), at(150), "again", 1),
    }


def test_idle_sessions(spark):
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    rows = [("a", at(0)), ("a", at(59)), ("a", at(150)), ("a", at(150)), ("b", at(7)), ("b", None), (None, at(1))]
    got = expiry.idle_sessions(spark.createDataFrame(rows, "k string, ts timestamp"), ["k"], "ts").collect()
    assert {(r["k"], r["first_seen"], r["last_seen"], r["n_rows"]) for r in got} == {("a", at(0), at(59), 2), ("a", at(150), at(150), 2), ("b", at(7), at(7), 1), (None, at(1), at(1), 1)}
