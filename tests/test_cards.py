"""Card boxes and the id ladder against plain Python on small pages."""

import random

import pytest

from tabloom.operators import cards

PAGES = "doc_id string, page int, width double, height double"
BOX = "doc_id string, page int, x0 double, top double, x1 double, bottom double"


def boxes(df):
    return [(r["page"], r["card_idx"], r["x0"], r["top"], r["x1"], r["bottom"], r["source"], r["closed"]) for r in df.orderBy("page", "card_idx").collect()]


def grid(page, xs, ys, skip=()):
    """Edges of a grid, a side each; ``skip`` names sides that are not drawn."""
    out = [("d", page, float(a), float(y), float(b), float(y)) for y in ys for a, b in zip(xs, xs[1:], strict=False) if ("h", y, a) not in skip]
    return out + [("d", page, float(x), float(a), float(x), float(b)) for x in xs for a, b in zip(ys, ys[1:], strict=False) if ("v", x, a) not in skip]


def test_card_boxes_of_three_sources(spark):
    pages = spark.createDataFrame([("d", p, 300.0, 400.0) for p in range(5)] + [("e", 1, 300.0, 400.0), ("f", 1, None, None)], PAGES)
    # page 0 comes before any card; page 1 has rectangles, one too large; page 2 a grid with an open cell; page 3 two rectangles only
    rects = [("d", 1, 10.0 + 100 * i, 50.4, 90.0 + 100 * i, 90.0) for i in range(3)] + [("d", 1, 0.0, 0.0, 300.0, 400.0), ("f", 1, 0.0, 0.0, 60.0, 40.0)]
    rects += [("d", 3, 0.0, 0.0, 80.0, 40.0)] * 2
    edges = grid(2, [0, 100, 200, 300], [20, 80, 140], skip=[("v", 100, 80)]) + [("d", 2, 0.0, 0.0, 90.0, 30.0), ("e", 1, 0.0, 5.0, 290.0, 5.0)]
    got = boxes(cards.card_boxes(pages, spark.createDataFrame(rects, BOX), spark.createDataFrame(edges, BOX)))
    assert [r for r in got if r[0] == 1] == [(1, i, 10.0 + 100 * i, 50.4, 90.0 + 100 * i, 90.0, "rects", True) for i in range(3)]
    lines = [r for r in got if r[0] == 2]
    assert [r[2:6] for r in lines] == [(x, y, x + 100.0, y + 60.0) for y in (20.0, 80.0) for x in (0.0, 100.0, 200.0)]
    assert [r[7] for r in lines] == [True, True, True, False, False, True] and {r[6] for r in lines} == {"lines"}
    # pages 3 and 4 learn from page 1: six sides, of which neighbours 100 - 90 and 20 apart stay, rows of 39.6
    learned = [r for r in got if r[0] in (3, 4)]
    assert {r[6] for r in learned} == {"learned"} and {r[7] for r in learned} == {None}
    assert sorted({(r[2], r[4]) for r in learned}) == [(10.0, 90.0), (110.0, 190.0), (210.0, 290.0)]
    tops, y = [], 39.6 * 0.5
    while y < 400 - 3.96:
        tops.append(y)
        y += 39.6
    ends = tops[1:] + ([min(y, 400.0)] if y <= 400 + 19.8 else [])
    want = [(a, b) for a, b in zip(tops, ends, strict=False) if b - a >= 14]
    assert [(pytest.approx(a), pytest.approx(b)) for a, b in want] == sorted({(r[3], r[5]) for r in learned if r[0] == 3})
    assert not [r for r in got if r[0] == 0]
    closed = boxes(cards.card_boxes(pages, spark.createDataFrame(rects, BOX), spark.createDataFrame(edges, BOX), closed_only=True))
    assert len([r for r in closed if r[0] == 2]) == 4


def test_interval_union_is_that_of_points(spark):
    rng = random.Random(1)
    rows = [(k, a, a + rng.randrange(6)) for k in range(6) for a in (rng.randrange(60) for _ in range(k * 5))]
    got = cards.interval_union(spark.createDataFrame(rows, "k int, lo int, hi int"), ["k"]).collect()
    for k in range(6):
        points = {x for r in rows if r[0] == k for x in range(2 * r[1], 2 * r[2] + 1)}
        own = [(r["lo"], r["hi"]) for r in got if r["k"] == k]
        assert {x for a, b in own for x in range(2 * a, 2 * b + 1)} == points and len(set(own)) == len(own)
        assert all(b < c for (_, b), (c, _) in zip(sorted(own), sorted(own)[1:], strict=False))


def test_header_strips(spark):
    rows = [("d", 1, 0, 10.0, 100.0, 90.0, 140.0), ("d", 1, 1, 110.0, 100.3, 190.0, 145.0), ("d", 1, 2, 10.0, 160.0, 90.0, 200.0), ("d", 2, 0, 10.0, 30.0, 90.0, 60.0)]
    got = cards.header_strips(spark.createDataFrame(rows, "doc_id string, page int, card_idx int, x0 double, top double, x1 double, bottom double"))
    assert {(r["page"], r["card_idx"]): round(r["strip"], 6) for r in got.collect()} == {(1, 0): 20.0, (1, 1): 20.3, (1, 2): 135.0, (2, 0): 2.0}


def ladder(rows, rungs=6):
    """Rung by rung in plain Python: every open card names its best free id, the first card gets it."""
    out = {}
    for page in {r[:2] for r in rows}:
        own = [r[2:] for r in rows if r[:2] == page and r[2] is not None and r[5] is not None]
        card, used = {}, set()
        for rung in range(rungs):
            named = {}
            for c in sorted({r[0] for r in own} - set(card)):
                free = sorted((r[2], r[3]) for r in own if r[0] == c and r[1] == rung and r[3] not in used)
                if free:
                    named.setdefault(free[0][1], c)
            for epic, c in named.items():
                card[c] = (epic, rung)
                used.add(epic)
        out |= {(*page, c): v for c, v in card.items()}
    return out


def test_id_ladder_with_ties_and_repeats(spark):
    rng = random.Random(2)
    rows = [(rng.choice("de"), rng.randrange(6), rng.randrange(7), rng.randrange(6), float(rng.randrange(3)), f"E{rng.randrange(8)}") for _ in range(700)]
    rows += rows[:50] + [("d", 1, None, 0, 0.0, "E1"), ("d", 1, 3, 0, 0.0, None)]
    df = spark.createDataFrame(rows, "doc_id string, page int, card_idx int, rung int, rank double, epic string")
    got = cards.id_ladder(df).collect()
    assert {(r["doc_id"], r["page"], r["card_idx"]): (r["epic"], r["rung"]) for r in got} == ladder(rows) and len(got) == len(ladder(rows))
    assert len({(r["doc_id"], r["page"], r["epic"]) for r in got}) == len(got)
    assert cards.id_ladder(df.limit(0)).count() == 0


def test_id_candidates_of_a_page(spark):
    own = [(0, 10.0, "1", "Name: A ABC1234567"), (1, 110.0, "002", "Name: B"), (2, 210.0, "3", "Name: C"), (3, 310.0, None, "Name: D"), (4, 410.0, "5", None), (5, 510.0, "6", "")]
    rows = [("d", 1, i, x, 100.0, x + 90, 180.0, s, t) for i, x, s, t in own]
    df = spark.createDataFrame(rows, "doc_id string, page int, card_idx int, x0 double, top double, x1 double, bottom double, serial string, text string")
    words = [("d", 1, "QRS1234567", 215.0, 280.0, 40.0, 50.0), ("d", 1, "XYZ12O4567", 311.0, 390.0, 130.0, 140.0), ("d", 1, "word", 310.0, 390.0, 120.0, 130.0)]
    w = spark.createDataFrame(words, "doc_id string, page int, text string, x0 double, x1 double, top double, bottom double")
    texts = spark.createDataFrame([("d", 1, "head\n2 DEF1234567\nfoot 5GHI1234567 and JKL7654321 6.")], "doc_id string, page int, text string")
    found = cards.id_candidates(df, w, texts)
    assert {r["card_idx"]: (r["epic"], r["rung"]) for r in cards.id_ladder(found).collect()} == {
        0: ("ABC1234567", 0), 1: ("DEF1234567", 1), 2: ("QRS1234567", 2), 3: ("XYZ1204567", 4), 4: ("GHI1234567", 5), 5: ("JKL7654321", 5),
    }


def test_last_learned_row_in_any_order_of_the_cards(spark):
    """Heights of 100 in the mean, whose sum as doubles is above or below 900 by their order."""
    heights = [(20.5, 81.5), (81.5, 260.8), (260.8, 320.5)]
    boxed = [("d", 0, x, top, x + 100.0, bottom) for top, bottom in heights for x in (0.0, 100.0, 200.0)]
    pages = spark.createDataFrame([("d", p, 300.0, 400.0) for p in range(2)], PAGES)
    sums = set()
    for i in range(12):
        order = random.Random(i).sample(boxed, 9)
        total = 0.0
        for r in order:
            total += r[5] - r[3]
        sums.add(total / 9)
        got = cards.learned_cards(pages, spark.createDataFrame(order, BOX).coalesce(1)).collect()
        tops = sorted({(round(r["top"], 6), round(r["bottom"], 6)) for r in got})
        assert tops == [(50.0, 150.0), (150.0, 250.0), (250.0, 350.0), (350.0, 400.0)], (i, tops)
    assert len(sums) > 1 and max(sums) > 100


def test_pages_before_the_first_week_are_those_of_sql(spark, tmp_path):
    import duckdb

    from tabloom.plans import queries

    rows = [(i, f"2023-12-{28 + i % 4} 10:00:00", 1, 100.0 + i % 20) for i in range(80)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").selectExpr("event_id", "ts::timestamp_ntz AS ts", "user_id", "value").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(map(tuple, queries.QUERIES["card_boxes"](spark, str(tmp_path)).collect()), key=str)
    assert got and got == sorted(duckdb.sql(queries.ORACLE_SQL["card_boxes"]).fetchall(), key=str)


def test_id_ladder_of_pages_in_parts(spark):
    """Pages that go on from batch to batch, held whole or in parts, are those of plain Python; candidates are sorted once."""
    rng = random.Random(6)
    rows = [(rng.choice(["d", "e", None]), rng.choice([None, 1, 2, 3, 3, 3]), rng.randrange(40), rng.randrange(8), rng.choice([None, 0.0, 1.0]), f"E{rng.randrange(60)}") for _ in range(4000)]
    df = spark.createDataFrame(rows, "doc_id string, page int, card_idx int, rung int, rank double, epic string")
    want = ladder([(*r[:4], -1.0 if r[4] is None else r[4], r[5]) for r in rows])
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size, most in (("7", 20), ("64", 300), ("10000", 1 << 18)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            out = cards.id_ladder(df, most=most)
            got = out.collect()
            assert {(r["doc_id"], r["page"], r["card_idx"]): (r["epic"], r["rung"]) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 2
