"""Global numbers where many rows are equal in the order."""

from pyspark.sql import functions as F

from tabloom.operators import merge, segment


def test_numbers_of_ties(spark):
    df = spark.range(6000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    df = df.union(df.where("v < 500").withColumn("k", F.lit(None).cast("long"))).union(df.where("v = 7")).union(df.where("v = 7"))
    got = merge.number_rows(df, ["k"]).collect()
    assert sorted(r["serial"] for r in got) == list(range(1, len(got) + 1)) and len(got) == 6502
    order = [(-1 if r["k"] is None else r["k"]) for r in sorted(got, key=lambda r: r["serial"])]
    assert order == sorted(order) and sorted(df.columns) == sorted(set(got[0].asDict()) - {"serial"})
    again = {(r["v"], r["k"], r["serial"]) for r in merge.number_rows(df.repartition(7), ["k"]).collect()}
    assert again == {(r["v"], r["k"], r["serial"]) for r in got}  # equal rows are alike, so the numbers are the same


def test_card_rows_keep_all_values(spark):
    lines = [("d", 1, 0, "name", ["A", "B", "C", "D", "E"]), ("d", 1, 1, "age", ["1", "2", "3", "4", "5"]), ("d", 1, 2, "epic", ["x"])]
    got = segment.card_rows(spark.createDataFrame(lines, "doc_id string, page int, line_no int, kind string, values array<string>")).orderBy("slot").collect()
    assert [(r["slot"], r["name"], r["age"], r["epic"]) for r in got] == [(0, "A", "1", "x"), (1, "B", "2", None), (2, "C", "3", None), (3, "D", "4", None), (4, "E", "5", None)]


def test_anchored_rows_are_those_of_plain_python(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *(float(rng.randrange(300)) for _ in range(9))]), i) for i in range(900)] + [("a", 5.0, 3)] * 3
    df = spark.createDataFrame(rows, "k string, y double, i int").repartition(5)
    got = {(r["k"], r["row"]): (r["anchor"], [(x["v"], x["i"]) for x in r["items"]]) for r in segment.anchored_rows(df, ["k"], "y", 7.0, ["i"]).collect()}
    want = {}
    for key in ("a", "b", None):
        anchor, row = None, -1
        for y, i in sorted(((y, i) for k, y, i in rows if k == key), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
            if row < 0 or y is None or anchor is None or abs(y - anchor) > 7:
                anchor, row = y, row + 1
            want.setdefault((key, row), (anchor, []))[1].append((y, i))
    assert got == want
